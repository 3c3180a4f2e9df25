"""Connected components of a graph given as edges (a, b long); every round is written to the shared folder, and nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph
from .common import scratch


def components(edges: DataFrame) -> DataFrame:
    """edges -> node, root: the smallest node that each node reaches, for nodes that have an edge."""
    return graph.components(edges, lambda df: scratch(df, "edges"))
