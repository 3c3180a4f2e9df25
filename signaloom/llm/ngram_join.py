"""N-gram Jaccard join: blocked sparse matrix product of the document by n-gram incidence matrix.

Documents with equal shingle sets form a class; only one row per class enters the product. Two classes link when den * |A and B| >= num * |A or B|.

Blocks. Linking sets of up to n shingles differ in at most D = floor(2 n (den - num) / (den + num)) of them. Sizes are dealt into bands so that a pair lies in one
band or in two neighbours; at each level the shingles are dealt by hash into D + 1 parts and some more, so a linking pair has one non-empty part in common. Shingles that many texts hold are left
out of the parts, so texts that merely share a passage do not meet; sets with little else also give the parts of the whole set, and sets with more empty parts than were added also name those: no pair is lost. Every part gives a key. Tasks combine their keys first: rows of a key become a star of edges around the
smallest row, and one row per key and task is shuffled and sorted, so a key of any size stays cheap. Components of these edges are the blocks of the matrix: no link crosses two of them.

Product. A block of at most LIMIT shingles and ROWS rows is multiplied in one task. A larger one is split by size band, and each band by hash into strips; every pair of strips is a task. Overlaps
of rare n-grams are counted pair by pair, those of frequent ones by dense products; pairs below the size bounds (num + den) * overlap >= num * (|A| + |B|) are
discarded. Each task returns a row per document: its root inside the task and the rows that it links with, never the pairs.

Defined results. Null, empty or blank text: 0 shingles, linked with nothing. Null ids: a component's id is its smallest id that is not null. Repeated rows: each counts. Empty table: no rows. Other
columns, of any name, are ignored. Shingles are compared as 64-bit hashes. Rows are numbered and written once; all later steps read that table, so numbers hold whatever becomes of executors.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, numbered, renamed, scratch
from .components import components
from .shingles import U, mix, shingle_sets

LIMIT, ROWS, COMBINE = 400_000, 1_024, 1_000_000
LOW_DF = 24
FREQUENT, OFTEN = 50_000, 1_000
PART = U(0xD1B54A32D192ED03)


def _parts(differ: int, least: float, deviations: int) -> tuple[int, int]:
    """Parts for sets of at least `least` shingles, and how many of them may be empty: as many as are added to differ + 1."""
    spare = 0
    for _ in range(6 if differ else 0):
        empty = (differ + 1 + spare) * math.exp(-least / (differ + 1 + spare))
        spare = math.ceil(empty + deviations * math.sqrt(empty))
    return differ + 1 + spare, spare


class Levels:
    """Size bands and parts for a threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.edges, self.parts = num, den, [1], []

    def _grow(self) -> None:
        low = self.edges[-1]
        high = max(low + 1, (low - 1) * self.den // self.num + 1)
        differ = 2 * (high - 1) * (self.den - self.num) // (self.den + self.num)
        self.parts.append((differ, _parts(differ, low * self.num / self.den, 4), _parts(differ, low * self.num / self.den, 2)))
        self.edges.append(high)

    def band(self, n: int) -> int:
        while self.edges[-1] <= n:
            self._grow()
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def of(self, level: int) -> tuple[int, tuple[int, int], tuple[int, int]]:
        """Most differing shingles; parts, and empty parts that do no harm, for whole sets and for sets without frequent shingles."""
        while len(self.parts) <= level:
            self._grow()
        return self.parts[level]


def _part_keys(shingles: np.ndarray, parts: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each part that holds shingles, and the numbers of those parts."""
    part = (mix(shingles, 7) >> U(32)) * U(parts) >> U(32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    total = np.add.reduceat(mix(shingles, 8)[order], first) if len(first) else np.zeros(0, np.uint64)
    return mix(total + part[first] * PART, salt), part[first]


def keys_of(shingles: np.ndarray, levels: Levels, frequent: np.ndarray | None = None) -> np.ndarray:
    """The keys of a set: those of its band's level and of the next, where its larger partners lie.

    Frequent shingles are left out, as they differ no more than whole sets do: then texts that merely share a passage have no key in common. A set that has too few others left, so that more of its parts are
    empty than were added, also gives the keys of its whole set; of two such sets that link, these meet.
    """
    found, own = [], levels.band(len(shingles))
    light = shingles
    if frequent is not None and len(frequent):
        light = shingles[frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] != shingles]
    for level in (own, own + 1):
        differ, whole, most = levels.of(level)
        if not differ:
            continue  # linking sets are equal: a class
        keys, held = _part_keys(light, most[0], 5_000_011 + level)
        found.append(keys)
        if most[0] - len(held) > most[1]:
            keys, held = _part_keys(shingles, whole[0], 9 + level)
            found.append(keys)
            if whole[0] - len(held) > whole[1]:
                empty = np.setdiff1d(np.arange(whole[0], dtype=np.uint64), held)
                found.append(mix(empty * PART, 1_000_003 + level))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _facts(k: int):
    """Facts of every row; after each COMBINE shingles or so, rows with rid -1 for the shingles (d1) that many of those texts hold, and how many (n)."""

    def run(batches):
        seen, cells, texts = [], 0, 0

        def often():
            grams, n = np.unique(np.concatenate(seen), return_counts=True)
            grams, n = (x[n >= max(4, texts // OFTEN)] for x in (grams, n))
            none = pa.nulls(len(grams), id_type)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), -1)), none, pa.array(n), pa.array(grams.view(np.int64)), pa.array(n)], names)

        names, id_type = ["rid", "doc_id", "n", "d1", "d2"], None
        for b in batches:
            id_type = b.schema.field("doc_id").type
            sets = shingle_sets(b.column("text"), k)
            digest = [np.array([mix(s, salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (21, 22)]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, digest)], names)
            seen += sets
            cells, texts = cells + sum(map(len, sets)), texts + len(sets)
            if cells >= 2 * COMBINE:
                yield often()
                seen, cells, texts = [], 0, 0
        if cells:
            yield often()

    return run


def _star_rows(keys: np.ndarray, rids: np.ndarray) -> list[pa.RecordBatch]:
    """One row per key with its smallest rid (b = -1), and an edge (a, b) for every other rid of the key."""
    order = np.lexsort((rids, keys))
    keys, rids = keys[order], rids[order]
    first = np.append(True, keys[1:] != keys[:-1])
    least = rids[np.flatnonzero(first)][np.cumsum(first) - 1]
    edges = np.unique(np.stack([rids[~first], least[~first]], 1), axis=0) if not first.all() else np.zeros((0, 2), np.int64)
    edges = edges[edges[:, 0] != edges[:, 1]]
    key = np.concatenate([keys[first], mix(edges[:, 0].astype(np.uint64), 5)]).view(np.int64)
    a, b = np.concatenate([rids[first], edges[:, 0]]), np.concatenate([np.full(first.sum(), -1), edges[:, 1]])
    return [pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (key, a, b)], ["key", "a", "b"]) for i in range(0, len(key), 100_000)]


def _signatures(k: int, num: int, den: int, frequent: np.ndarray):
    def run(batches):
        levels, keys, rids, held = Levels(num, den), [], [], 0
        for b in batches:
            for rid, s in zip(b.column("rid").to_numpy(), shingle_sets(b.column("text"), k)):
                if len(s):
                    keys.append(keys_of(s, levels, frequent))
                    rids.append(np.full(len(keys[-1]), rid))
                    held += len(keys[-1])
                if held >= COMBINE:
                    yield from _star_rows(np.concatenate(keys), np.concatenate(rids))
                    keys, rids, held = [], [], 0
        if held:
            yield from _star_rows(np.concatenate(keys), np.concatenate(rids))

    return run


def _stars(batches):
    """Sorted rows of keys -> edges to each key's smallest rid; edges pass. A key may run over any number of batches."""
    last, least = None, None
    for batch in batches:
        key, a, b = (batch.column(c).to_numpy() for c in ("key", "a", "b"))
        ready = b >= 0
        out = [np.stack([a[ready], b[ready]], 1)]
        key, a = key[~ready], a[~ready]
        if len(key):
            first = np.append(key[0] != last, key[1:] != key[:-1])
            heads = np.append(least if least is not None else -1, a[first])
            root = heads[np.cumsum(first)]
            out.append(np.stack([a[~first], root[~first]], 1))
            last, least = key[-1], root[-1]
        edges = np.concatenate(out)
        edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy(), pa.int64()), pa.array(edges[:, 1].copy(), pa.int64())], ["a", "b"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Upper triangle of incidence * incidence': the number of n-grams that two rows share."""
    rows, size = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets)
    grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.lexsort((rows, grams))
    grams, rows = grams[order], rows[order]
    first = np.append(True, grams[1:] != grams[:-1]) if len(grams) else np.zeros(0, bool)
    column = np.cumsum(first) - 1
    df = np.bincount(column)[column] if len(grams) else column
    out = np.zeros(size * size, np.float32)
    low = (df > 1) & (df <= LOW_DF)
    r, c = rows[low], column[low]
    for shift in range(1, LOW_DF):
        same = c[shift:] == c[:-shift]
        if not same.any():
            break
        out += np.bincount(r[:-shift][same] * size + r[shift:][same], minlength=size * size).astype(np.float32)
    out = out.reshape(size, size)
    r, c = rows[df > LOW_DF], column[df > LOW_DF]
    if len(c):
        c = np.cumsum(np.append(0, c[1:] != c[:-1]))
        for at in range(0, int(c[-1]) + 1, 2048):
            here = (c >= at) & (c < at + 2048)
            block = np.zeros((size, 2048), np.float32)
            block[r[here], c[here] - at] = 1
            out += np.triu(block @ block.T, 1)
    return out


def block_rows(rids, copies, sets, num, den, levels: Levels, level: int, strip, pair) -> tuple:
    """Roots and link counts of a block's rows. level -1: all pairs count; else only pairs whose larger set is of that level, across the two strips or inside the one."""
    n = np.array([len(s) for s in sets])
    linked = (num + den) * overlaps(sets).astype(np.float64) >= num * (n[:, None] + n[None, :])
    linked = np.triu(linked, 1)
    linked |= linked.T
    if level >= 0:
        band = np.array([levels.band(x) for x in n])
        linked &= np.maximum(band[:, None], band[None, :]) == level
        linked &= (strip[:, None] != strip[None, :]) if pair[0] != pair[1] else True
    root, free = np.arange(len(n)), np.ones(len(n), bool)
    for i in np.argsort(rids):
        if free[i]:
            reach = np.zeros(len(n), bool)
            reach[i] = True
            front = reach
            while front.any():
                found = linked[front].any(0) & ~reach
                reach = reach | found
                front = found
            root[reach] = i
            free &= ~reach
    return rids[root], (linked * copies[None, :]).sum(1)


def _product(k: int, num: int, den: int):
    def run(key, table):
        _, level, s1, s2 = (x.as_py() for x in key)
        rids, copies, strip = (table.column(c).to_numpy() for c in ("rid", "copies", "strip"))
        root, links = block_rows(rids, copies, shingle_sets(table.column("text"), k), num, den, Levels(num, den), level, strip, (s1, s2))
        keep = (root != rids) | (links > 0)
        return pa.table({"a": rids[keep], "b": root[keep], "links": links[keep].astype(np.int64)})

    return run


def _band_of(num: int, den: int):
    def run(batches):
        levels = Levels(num, den)
        for b in batches:
            yield b.append_column("band", pa.array([levels.band(x) for x in b.column("n").to_pylist()], pa.int32()))

    return run


def jaccard_groups(rows: DataFrame, k: int, threshold: str, id_col: str, text_col: str) -> DataFrame:
    """One row per row of a numbered table: rid, doc_id, n_shingles, root (the smallest rid of its component), n_links. threshold: a fraction such as "90/100"."""
    share = Fraction(threshold)
    num, den = share.numerator, share.denominator
    texts = rows.select("rid", F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    made = scratch(texts.mapInArrow(_facts(k), f"rid long, doc_id {id_type}, n long, d1 long, d2 long"), "ngram-facts")
    facts = made.filter("rid >= 0")
    often = made.filter("rid < 0").groupBy("d1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d1").limit(FREQUENT).collect()  # any set of shingles loses no link: the limit only bounds the driver
    frequent = np.sort(np.array([r["d1"] for r in often], np.int64).view(np.uint64))
    # Group tables are written before rows join them: then both sides are plain exchanges, whose hot partitions adaptive execution can split.
    classes = scratch(facts.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"), "ngram-classes")
    members = scratch(
        facts.join(classes, ["n", "d1", "d2"], "left").select("rid", "doc_id", "n", F.coalesce("rep", "rid").alias("rep"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies")), "ngram-members"
    )

    keyed = texts.select("rid", "text").mapInArrow(_signatures(k, num, den, frequent), "key long, a long, b long")
    stars = keyed.repartition("key").sortWithinPartitions("key", "a").mapInArrow(_stars, "a long, b long")
    copies = members.filter("rid <> rep").select(F.col("rid").alias("a"), F.col("rep").alias("b"))
    blocks = components(stars.unionByName(copies))

    reps = members.filter("rid = rep").select("rid", "n", "copies").join(blocks, F.col("rid") == F.col("node")).select("rid", "n", "copies", "root")
    reps = scratch(reps.mapInArrow(_band_of(num, den), "rid long, n long, copies long, root long, band int"), "ngram-reps")
    size = [F.sum("n").alias("cells"), F.count("*").alias("rows")]
    whole = reps.groupBy("root").agg(*size).filter("rows > 1").select("root", ((F.col("cells") <= LIMIT) & (F.col("rows") <= ROWS)).alias("small"))
    placed = reps.join(whole, "root").withColumn("level", F.explode(F.when(F.col("small"), F.array(F.lit(-1))).otherwise(F.array("band", F.col("band") + 1)))).drop("small")
    strips = placed.groupBy("root", "level").agg(*size).filter("rows > 1")
    strips = strips.select("root", "level", F.when(F.col("level") < 0, 1).otherwise(F.greatest(F.ceil(F.col("cells") / LIMIT), F.ceil(F.col("rows") / ROWS))).cast("int").alias("strips"))
    placed = scratch(placed.join(strips, ["root", "level"]).withColumn("strip", F.pmod(F.xxhash64("rid"), F.col("strips")).cast("int")), "ngram-placed")
    asked = texts.select("rid", "text").join(few(placed.select("rid").distinct()), "rid", "left_semi")  # only texts that meet another one are shuffled
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).withColumn("s1", F.least("strip", "other")).withColumn("s2", F.greatest("strip", "other"))
    tasks = placed.select("rid", "copies", "root", "level", "strip", "s1", "s2").hint("merge").join(asked, "rid")
    links = scratch(tasks.groupBy("root", "level", "s1", "s2").applyInArrow(_product(k, num, den), "a long, b long, links long"), "ngram-links")

    roots = components(links.select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    linked = members.filter("rid = rep").select("rep").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").filter("root is not null or links is not null")
    joined = members.join(scratch(linked, "ngram-linked"), "rep", "left")
    return joined.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))


def ngram_jaccard_join(docs: DataFrame, k: int = 5, threshold: str = "80/100", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), n_links (other rows linked directly) for every row of docs."""
    rows = numbered(docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1")), "ngram-rows")
    groups = scratch(jaccard_groups(rows, k, threshold, "c0", "c1"), "ngram-groups")
    names = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    return groups.join(scratch(names, "ngram-names"), "root", "left").select("doc_id", "n_shingles", F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "n_links")


def drop_near_copies(docs: DataFrame, k: int = 5, threshold: str = "80/100", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all columns: of each component the row with the smallest id."""
    held, name = renamed(docs)
    rows = numbered(held, "ngram-rows")
    groups = scratch(jaccard_groups(rows, k, threshold, name[id_col], name[text_col]).select("rid", "doc_id", "root"), "ngram-groups")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    stay = scratch(groups.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("root", F.col("first.rid").alias("first")), "ngram-stay")
    gone = scratch(groups.join(stay, "root").filter("rid <> first").select("rid"), "ngram-gone")
    return rows.join(few(gone), "rid", "left_anti").select(*held.columns).toDF(*docs.columns)


ORACLE_SQL = r"""
with recursive t as (select row_number() over () as n, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select n, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as grams from t),
g as materialized (select n, len(grams) as size, unnest(grams) as gram from s),
shared as (select x.n as a, y.n as b, any_value(x.size) as sa, any_value(y.size) as sb, count(*) as common from g x join g y on x.gram = y.gram and x.n <> y.n
  and 10 * least(x.size, y.size) >= 9 * greatest(x.size, y.size) group by 1, 2),
links as materialized (select a, b from shared where 100 * common >= 90 * (sa + sb - common)),
reach(a, b) as (select n, n from s union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select r.a, min(s.doc_id) as component_id from reach r join s on r.b = s.n group by r.a),
k as (select a, count(*) as n_links from links group by a)
select s.doc_id, cast(len(s.grams) as bigint) as n_shingles, c.component_id, coalesce(k.n_links, 0) as n_links
from s join c on s.n = c.a left join k on s.n = k.a
"""  # k = 3, threshold 90/100
