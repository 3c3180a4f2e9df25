"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets and verified pairs.

Vectors are compared only when their labels are equal and not null; equal vectors of a label form a class, of which one row is hashed. A table hashes a vector by two or more
pseudo-random rotations (three rounds of signs and a Hadamard transform each); the vertices of the cross-polytope nearest to the rotated vectors name its home bucket, and the next-nearest
combinations the buckets that it visits as well. A pair meets where one is at home and the other at home or on a visit. SCHEME has the numbers of rotations, tables and probes, the same at every size.

Plan. Membership rows (id, bucket) are slim; bucket sizes come from a partial aggregation, buckets with one member go, and a bucket of over ROWS rows is cut into strips, every pair of
strips being a task of its own. Vectors join the rows that are left. Each task verifies its pairs in double precision, and counts a pair only in the first
bucket where the two meet, so it returns a row per vector (root, links), never the pairs.

Defined results. Null vectors, empty ones, zero ones, ones with null or non-finite components, and ones whose label is null: no links, a component of their own. Vectors of different lengths do not link. Null ids: a
component's id is its smallest id that is not null. Repeated rows link with each other. Empty table: no rows. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, scratch
from .components import components

ROWS, PACK = 1_024, 16_384
SMALL = 48
#: Rotations that name a bucket, tables and probes: a pair at cosine 0.93 is found with probability over 0.998 at 64 to 1,024 dimensions. Larger buckets cost time, and are cut into strips.
SCHEME = (2, 6, 4)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d, h = len(x), x.shape[1], 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], -1).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(x: np.ndarray, scheme: tuple[int, int, int]) -> np.ndarray:
    """rows x tables x probes: the buckets of unit vectors, home first."""
    (n, width), (rotations, tables, probes) = x.shape, scheme
    d = 1 << max(1, (width - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - width)))
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        code, cost = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for r in range(rotations):
            y = x
            for s in range(3):
                y = hadamard(y * np.random.default_rng([t, r, s, d]).choice([-1.0, 1.0], d))
            y = np.concatenate([y, -y], 1)
            best = np.argpartition(-y, min(3, 2 * d - 1), 1)[:, :4]
            value = np.take_along_axis(y, best, 1)
            order = np.argsort(-value, 1, kind="stable")
            best, value = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
            code = (code[:, :, None] * (2 * d) + best[:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + ((value[:, :1] - value) ** 2)[:, None, :]).reshape(n, -1)
        first = np.argsort(cost, 1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(code, first, 1) + t * (2 * d) ** rotations
    return out


def _matrix(column) -> np.ndarray:
    """Lists of one length as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _members(scheme):
    def run(batches):
        for b in batches:
            width = np.array([len(v) for v in b.column("embedding")])
            for w in np.unique(width):
                part = b.filter(pa.array(width == w))
                found = cells(unit(_matrix(part.column("embedding"))), scheme)
                home = np.zeros(found.shape, bool)
                home[:, :, 0] = True
                take = pa.array(np.repeat(np.arange(len(found)), found.shape[1] * found.shape[2]))
                yield pa.RecordBatch.from_arrays([part.column("rep").take(take), part.column("grp").take(take), pa.array(found.reshape(-1)), pa.array(home.reshape(-1))], ["rep", "grp", "cell", "home"])

    return run


def _pairs(block: np.ndarray, x: np.ndarray, home: np.ndarray, strip: np.ndarray, cross: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (row numbers) within each block; rows are sorted by block."""
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    sizes = np.diff(np.append(starts, len(block)))
    found = []

    def verified(i, j):
        ok = (home[i] | home[j]) & (~cross[i] | (strip[i] != strip[j]))
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            hit = np.einsum("ij,ij->i", x[a], x[b]) >= least
            found.append((a[hit], b[hit]))

    small = np.repeat(sizes <= SMALL, sizes)
    rows = np.flatnonzero(small)
    for shift in range(1, min(SMALL, int(sizes.max(initial=0)))):
        same = block[rows[shift:]] == block[rows[:-shift]]
        if not same.any():
            break
        verified(rows[:-shift][same], rows[shift:][same])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        near = np.triu(x[s : s + n] @ x[s : s + n].T >= least - 1e-12, 1)
        i, j = np.nonzero(near)
        verified(i + s, j + s)
    return (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _verify(least: float, scheme):
    def run(table):
        table = table.sort_by([("grp", "ascending"), ("cell", "ascending"), ("s1", "ascending"), ("s2", "ascending")])
        rep, cell, copies, strip, s1, s2 = (table.column(c).to_numpy() for c in ("rep", "cell", "copies", "strip", "s1", "s2"))
        home = table.column("home").to_numpy()
        grp = table.column("grp").combine_chunks().dictionary_encode()
        grp = (grp.combine_chunks() if isinstance(grp, pa.ChunkedArray) else grp).indices.to_numpy()
        change = (grp[1:] != grp[:-1]) | (cell[1:] != cell[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        block = np.cumsum(np.append(0, change))
        width = np.array([len(v) for v in table.column("embedding")])
        ends, links = [], {}
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            x = unit(_matrix(table.column("embedding").take(pa.array(at))))
            i, j = _pairs(block[at], x, home[at], strip[at], (s1 != s2)[at], least)
            involved = np.unique(np.concatenate([i, j]))
            if not len(involved):
                continue
            code = cells(x[involved], scheme)
            where = np.searchsorted(involved, np.arange(len(at)))
            for lo in range(0, len(i), 50_000):
                a, b = i[lo : lo + 50_000], j[lo : lo + 50_000]
                ca, cb = code[where[a]], code[where[b]]
                far = np.iinfo(np.int64).max
                first = np.minimum(
                    np.where((ca[:, :, :1] == cb).any(2), ca[:, :, 0], far).min(1), np.where((cb[:, :, :1] == ca).any(2), cb[:, :, 0], far).min(1)
                )
                mine = first == cell[at[a]]
                ends.append(np.stack([rep[at[a[mine]]], rep[at[b[mine]]]], 1))
                for one, other in ((a, b), (b, a)):
                    ids, back = np.unique(rep[at[one[mine]]], return_inverse=True)
                    for k, v in zip(ids.tolist(), np.bincount(back, copies[at[other[mine]]]).tolist() if len(ids) else []):
                        links[k] = links.get(k, 0) + int(v)
        nodes = np.array(sorted(links), np.int64)
        root = np.arange(len(nodes))
        if len(nodes):
            e = np.searchsorted(nodes, np.concatenate(ends))
            while True:
                low = np.minimum(root[e[:, 0]], root[e[:, 1]])
                new = root.copy()
                np.minimum.at(new, e[:, 0], low)
                np.minimum.at(new, e[:, 1], low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
        return pa.table({"a": nodes, "b": nodes[root], "links": pa.array([links[k] for k in nodes.tolist()], pa.int64())})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id (smallest id reachable by links), kept for every row of vectors."""
    v = F.col("embedding")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~broken & F.exists(v, lambda x: x != 0)
    rows = numbered(rows.withColumn("good", F.coalesce(good, F.lit(False))), "vector-rows")
    twin = [F.concat_ws(":", F.size(v), "label").alias("grp"), F.xxhash64(v, F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), v).alias("h2")]
    facts = rows.select("rid", "vec_id", "good", *twin)
    classes = facts.filter("good").groupBy("grp", "h1", "h2").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"))
    classes = scratch(classes.filter("copies > 1").withColumn("good", F.lit(True)), "vector-classes")  # a table, so that adaptive execution can split the join's hot partitions
    members = scratch(facts.join(classes, ["good", "grp", "h1", "h2"], "left").select("rid", "vec_id", "grp", F.when(F.col("good"), F.coalesce("rep", "rid")).alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), "vector-members")
    reps = members.filter("rid = rep").select("rep", "grp", "copies")
    reps = scratch(rows.select(F.col("rid").alias("rep"), "embedding").join(reps, "rep"), "vector-reps")

    scheme = SCHEME
    placed = reps.select("rep", "grp", "embedding").mapInArrow(_members(scheme), "rep long, grp string, cell long, home boolean")
    busy = placed.groupBy("grp", "cell").agg(F.count("*").alias("rows"), F.max("home").alias("lived_in")).filter("rows > 1 and lived_in")
    busy = busy.select("grp", "cell", F.ceil(F.col("rows") / ROWS).cast("int").alias("strips"))
    tasks = placed.join(busy, ["grp", "cell"]).withColumn("strip", F.pmod(F.xxhash64("rep"), F.col("strips")).cast("int"))
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).withColumn("s1", F.least("strip", "other")).withColumn("s2", F.greatest("strip", "other"))
    tasks = scratch(tasks.select("rep", "grp", "cell", "home", "strip", "s1", "s2"), "vector-tasks")
    packs = tasks.count() // PACK + 1
    loaded = tasks.withColumn("pack", F.pmod(F.xxhash64("grp", "cell", "s1", "s2"), F.lit(packs))).join(reps.select("rep", "copies", "embedding"), "rep")
    links = scratch(loaded.groupBy("pack").applyInArrow(_verify(least, scheme), "a long, b long, links long"), "vector-links")

    roots = components(links.select("a", "b")).withColumnRenamed("node", "rep")
    counts = links.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    joined = members.join(scratch(counts.join(roots, "rep", "left"), "vector-linked"), "rep", "left")
    joined = joined.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("root", "rep", "rid").alias("root"))
    joined = scratch(joined, "vector-joined")
    names = joined.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    out = joined.join(scratch(names, "vector-names"), "root", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = """
with recursive v as (select row_number() over () as n, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings),
g as materialized (select * from v where label is not null and x is not null and len(x) > 0
  and len(list_filter(x, lambda y: y is null or isnan(y) or isinf(y))) = 0 and len(list_filter(x, lambda y: y <> 0)) > 0),
links as materialized (select a.n as a, b.n as b from g a join g b on a.label = b.label and a.n <> b.n and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.93),
reach(a, b) as (select n, n from v union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select r.a, min(v.vec_id) as component_id from reach r join v on r.b = v.n group by r.a),
k as (select a, count(*) as n_links from links group by a)
select v.vec_id, coalesce(k.n_links, 0) as n_links, c.component_id, v.vec_id is not distinct from c.component_id as kept
from v join c on v.n = c.a left join k on v.n = k.a
"""
