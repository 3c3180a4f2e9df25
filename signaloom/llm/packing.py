"""Packing by lexical retrieval: a sharded BM25 inverted index returns unused neighbours for each seed, which fill its window.

Every document is its token ids and an end id. Whole windows of a long document are sequences of their own; what is left of a document, less than a window, is a unit. The index is sharded by
content: units are sorted by a signature of what they say, and every UNITS of them in that order are a shard, so lexical neighbours share one. Document frequencies and the average length are those of the
whole corpus. The longest unused unit of a shard is its next seed; unused neighbours fill its window in the order of their BM25 scores, the one that passes its end is cut there, and its rest is a seed.

Two passes, by two signatures. (1) Close: the signature is a minhash of pairs of adjacent ids, which equal and near texts and texts that share passages have in common; a seed takes only neighbours that
score at least CLOSE of what it scores itself. A window that they fill is done; else what lies in it stays together, as one unit. (2) Fill: the signature is a minhash of ids weighted by the
squares of their BM25 weights; every window is filled. What a shard cannot fill goes on to the next one of its task, so a task has at most one sequence that is not full.

Plan. Tokenising is one pass over the scan, written to the shared folder as 16-bit ids; each pass is a range exchange by (signature, row), which no hot signature can unbalance, and a stream of
shards: a task holds one shard, however many units share a signature. The work grows in proportion to the input. The driver holds one number per vocabulary entry.

Limits of the method. Neighbours of different shards do not meet: of the best BM25 neighbours over the whole corpus that score at least 0.85 of the seed itself, about four in five share a shard with it in one of
the passes; of weaker ones, few do. README.md has the figures, and a test holds them against brute force.

Defined results. Null or empty text: the end id alone. Null or repeated ids and repeated rows: rows like others. Empty table: no rows. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .shingles import buffers, mix
from .tokens import default_vocabulary, encoder

WINDOW, END, UNITS, CLOSE, K1, B = 2_048, 1, 1_024, 0.8, 1.2, 0.75
VOCABULARY = 1 << 16
#: Units of a task at least, and at most where there are more tasks than shuffle partitions.
FEW, MANY = 1_024, 1 << 16
_PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
_UNIT = ("k1", "k2", "uid", "ids", "docs", "starts", "lengths", "totals")
_TYPES = {"ids": pa.binary(), "starts": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "totals": pa.list_(pa.int64())}


def _schema(id_type: str) -> str:
    """Rows of pieces (kind 0), units (1) and document frequencies (2: term in k1, number in k2)."""
    return (
        f"kind int, doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, "
        f"k1 long, k2 long, uid long, docs array<{id_type}>, starts array<long>, lengths array<long>, totals array<long>"
    )


def _batch(kind: int, rows: list[tuple], id_type) -> pa.RecordBatch:
    names = {0: _PIECE, 1: _UNIT, 2: ("k1", "k2")}[kind]
    held = dict(zip(names, zip(*rows)))
    types = {c: pa.int64() for c in (*_PIECE, *_UNIT)} | _TYPES | {"doc_id": id_type, "docs": pa.list_(id_type)}
    order = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "k1", "k2", "uid", "docs", "starts", "lengths", "totals")
    columns = [pa.array(held[c], types[c]) if c in held else pa.nulls(len(rows), types[c]) for c in order]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), *columns], ["kind", *order])


def pair_signature(ids: np.ndarray) -> tuple[int, int]:
    """Two minhashes of the pairs of adjacent ids; of a single id, a value of its own."""
    if len(ids) < 2:
        return 0, int(ids[0]) if len(ids) else 0
    pairs = (ids[:-1].astype(np.uint64) << np.uint64(16) | ids[1:]) * np.uint64(0x9E3779B97F4A7C15)
    pairs = (pairs ^ pairs >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    again = (pairs ^ pairs >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return int(pairs.min() >> np.uint64(1)), int(again.min() >> np.uint64(1))


def draws() -> np.ndarray:
    """For each term two exponential draws, by its hashes."""
    term = np.arange(VOCABULARY, dtype=np.uint64)
    return np.stack([-np.log(mix(term, salt).astype(np.float64) / 2.0**64 + 1e-12) for salt in (1, 2)])


def term_signature(terms: np.ndarray, weights: np.ndarray, drawn: np.ndarray | None = None) -> tuple[int, int]:
    """Two of the terms, drawn by weighted minhashes: a term is named with a probability in proportion to its squared weight. `drawn` is what `draws` gives, where the caller has it."""
    if not len(terms):
        return -1, -1
    drawn = draws() if drawn is None else drawn
    squared = weights.astype(np.float64) ** 2
    return tuple(int(terms[np.argmin(d[terms] / squared)]) for d in drawn)


def weigh_all(units: list[np.ndarray], idf: np.ndarray, average: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms of each unit and their BM25 weights; terms of no weight are left out. One sort serves all units."""
    size = np.array([len(u) for u in units], np.int64)
    key = np.sort(np.repeat(np.arange(len(units), dtype=np.uint64) << np.uint64(16), size) | np.concatenate([np.zeros(0, np.uint64), *units]))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    unit, term = (key[first] >> np.uint64(16)).astype(np.int64), (key[first] & np.uint64(VOCABULARY - 1)).astype(np.int64)
    tf = np.diff(np.append(first, len(key)))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[unit] / average))
    held = weight > 0
    unit, term, weight = unit[held], term[held], weight[held].astype(np.float32)
    cuts = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
    return [(term[a:b], weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def weigh(ids: np.ndarray, idf: np.ndarray, average: float) -> tuple[np.ndarray, np.ndarray]:
    """Terms of one unit and their BM25 weights."""
    return weigh_all([np.asarray(ids, np.uint16)], idf, average)[0]


class Index:
    """Inverted index: for each term the units that hold it and their BM25 weights."""

    def __init__(self, units: list[tuple[np.ndarray, np.ndarray]]):
        self.terms, self.size = [t for t, _ in units], len(units)
        term = np.concatenate(self.terms) if units else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in units]) if units else np.zeros(0, np.float32)
        unit = np.repeat(np.arange(len(units)), [len(t) for t in self.terms])
        order = np.argsort(term, kind="stable")
        self.unit, self.weight = unit[order], weight[order].astype(np.float64)
        self.first = np.searchsorted(term[order], np.arange(VOCABULARY + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all units for the terms of a seed."""
        start = self.first[self.terms[seed]]
        n = self.first[self.terms[seed] + 1] - start
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + n, n)
        return np.bincount(self.unit[at], self.weight[at], self.size)


def fill(sizes: np.ndarray, index: Index, window: int = WINDOW, least: float = 0.0) -> list[list[tuple[int, int, int]]]:
    """Sequences of (unit, from, to) that use every id once. Without `least` all but the last are full; with it, a seed takes neighbours of at least that share of its own score only."""
    done, sequences, cut = np.zeros(len(sizes), np.int64), [], None
    queue, at = np.argsort(-sizes, kind="stable").tolist(), 0
    while True:
        while at < len(queue) and done[queue[at]] >= sizes[queue[at]]:
            at += 1
        if at == len(queue):
            return sequences
        seed = cut if cut is not None and done[cut] < sizes[cut] else queue[at]
        sequence, room, cut = [(seed, int(done[seed]), int(sizes[seed]))], window - int(sizes[seed] - done[seed]), None
        done[seed] = sizes[seed]
        if room:
            scores = index.scores(seed)
            near = np.flatnonzero((done < sizes) & (scores >= least * scores[seed] if least else True))
            for k in near[np.argsort(-scores[near], kind="stable")].tolist():
                take = min(int(sizes[k] - done[k]), room)
                sequence.append((k, int(done[k]), int(done[k]) + take))
                done[k] += take
                room -= take
                if not room:
                    cut = k
                    break
        sequences.append(sequence)


class Unit:
    """Ids that lie together, and the parts of documents that they are."""

    def __init__(self, uid: int, ids: np.ndarray, parts: list[tuple]):
        self.uid, self.ids, self.parts = uid, ids, parts  # parts: doc, start, length, total

    def between(self, a: int, b: int):
        """The parts of the ids from a to b, with their ids."""
        at = 0
        for doc, start, length, total in self.parts:
            low, high = max(a, at), min(b, at + length)
            if low < high:
                yield doc, start + low - at, high - low, total, self.ids[low:high]
            at += length
            if at >= b:
                return


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(path: str, window: int, keep: bool):
    def run(batches):
        from pyspark import TaskContext

        encode, made, df = encoder(path), TaskContext.get().partitionId() << 33, np.zeros(VOCABULARY, np.int64)
        for b in batches:
            id_type, pieces, units = b.schema.field("doc_id").type, [], []
            for doc, uid, found in zip(b.column("doc_id").to_pylist(), b.column("uid").to_pylist(), encode(*buffers(b.column("text")))):
                ids = np.append(found, np.uint16(END)).astype("<u2", copy=False)
                full = len(ids) // window * window
                for s in range(0, full, window):
                    piece = ids[s : s + window]
                    pieces.append((doc, s, window, _crc(piece), len(ids), 3 * made, 0, piece.tobytes() if keep else None))
                    made += 1
                if len(ids) > full:
                    rest = ids[full:]
                    df[np.unique(rest)] += 1
                    units.append((*pair_signature(rest), uid, rest.tobytes(), [doc], [full], [len(rest)], [len(ids)]))
                if len(pieces) >= 2_000:
                    yield _batch(0, pieces, id_type)
                    pieces = []
                if len(units) >= 2_000:
                    yield _batch(1, units, id_type)
                    units = []
            if pieces:
                yield _batch(0, pieces, id_type)
            if units:
                yield _batch(1, units, id_type)
        terms = np.flatnonzero(df)
        if len(terms):
            yield _batch(2, [(int(t), int(df[t])) for t in terms], id_type)

    return run


def _packed(stage: int, least: float, idf: np.ndarray, average: float, window: int, keep: bool, units_of_shard: int):
    """Shards of sorted units -> pieces of finished sequences and, with `least`, units of what is left."""

    def shard(units: list[Unit], last: bool):
        """Finished sequences, and what is to go on: with `least` as units, else as the one that is not full."""
        index = Index(weigh_all([u.ids for u in units], idf, average))
        finished, left = [], []
        for sequence in fill(np.array([len(u.ids) for u in units]), index, window, least):
            if sum(b - a for _, a, b in sequence) == window or last and not least:
                finished.append([p for k, a, b in sequence for p in units[k].between(a, b)])
            else:
                parts = [p for k, a, b in sequence for p in units[k].between(a, b)]
                left.append(Unit(units[sequence[0][0]].uid, np.concatenate([p[4] for p in parts]), [p[:4] for p in parts]))
        return finished, left

    def run(batches):
        from pyspark import TaskContext

        made, held, carried, drawn = TaskContext.get().partitionId() << 33, [], [], draws()

        def pack(units, last):
            nonlocal made
            finished, left = shard(units, last)
            rows = []
            for sequence in finished:
                at = 0
                for doc, start, length, total, ids in sequence:
                    rows.append((doc, start, length, _crc(ids), total, 3 * made + stage, at, ids.tobytes() if keep else None))
                    at += length
                made += 1
            out = [_batch(0, rows, id_type)] if rows else []
            if least:
                named = [term_signature(*w, drawn) for w in weigh_all([u.ids for u in left], idf, average)]
                rows = [(*name, u.uid, u.ids.tobytes(), *([p[k] for p in u.parts] for k in range(4))) for name, u in zip(named, left)]
                return out + ([_batch(1, rows, id_type)] if rows else []), []
            return out, left

        for b in batches:
            id_type = b.schema.field("docs").type.value_type
            for uid, ids, *parts in zip(*(b.column(c).to_pylist() for c in ("uid", "ids", "docs", "starts", "lengths", "totals"))):
                held.append(Unit(uid, np.frombuffer(ids, "<u2"), list(zip(*parts))))
                if len(held) >= units_of_shard:
                    out, carried = pack(carried + held, False)
                    held = []
                    yield from out
        if held or carried:
            yield from pack(carried + held, True)[0]

    return run


def _sorted(units: DataFrame, n: int) -> DataFrame:
    spark = units.sparkSession
    tasks = max(1, min(-(-n // FEW), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // MANY))))
    return units.repartitionByRange(tasks, "k1", "k2", "uid").sortWithinPartitions("k1", "k2", "uid")


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with keep_ids also ids (16-bit, little-endian)."""
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = _schema(texts.schema["doc_id"].dataType.simpleString())
    made = scratch(texts.mapInArrow(_tokenised(vocabulary or default_vocabulary(), window, keep_ids), schema), "pack-tokens")
    units = made.filter("kind = 1").select(*_UNIT)
    n, total = units.agg(F.count("*"), F.sum(F.octet_length("ids") / 2)).first()
    df = np.zeros(VOCABULARY)
    for term, held in made.filter("kind = 2").groupBy("k1").agg(F.sum("k2")).collect():  # at most one row per vocabulary entry
        df[term] = held
    idf = np.where(df > 0, np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5))), 0.0)
    average = (total or 1) / max(1, n)
    close = scratch(_sorted(units, n).mapInArrow(_packed(1, CLOSE, idf, average, window, keep_ids, UNITS), schema), "pack-close")
    rest = _sorted(close.filter("kind = 1").select(*_UNIT), n).mapInArrow(_packed(2, 0.0, idf, average, window, keep_ids, UNITS), schema)
    columns = _PIECE if keep_ids else _PIECE[:-1]
    whole, done = (x.filter("kind = 0").select(*columns) for x in (made, close))
    return whole.unionByName(done).unionByName(rest.select(*columns))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids (binary) of pieces made with keep_ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
