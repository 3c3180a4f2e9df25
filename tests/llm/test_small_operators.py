"""Exact dedup, mixing, sharding, WARC and near vectors against brute force and at the edges."""

import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from signaloom.llm import exact_dedup, mixing, near_embed, ngram_join, sharding, warc

EDGE = [(1, "a b", "x"), (2, "ab ", "x"), (2, "ab ", "x"), (3, None, None), (4, "", "y"), (5, " \t", "y"), (None, "ab", "x"), (7, "Ä" * 50_000, "z"), (8, "aB", ""), (None, None, None)]


def frame(spark, rows=EDGE):
    return spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, source string, rid int, hash string").coalesce(1).cache()


def test_exact_dedup_edges(spark):
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(frame(spark)).collect()), key=repr)
    groups = defaultdict(list)
    for n, (i, t, _) in enumerate(EDGE):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, n))
    want = []
    for norm, rows in groups.items():
        best = min(rows)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        want += [(EDGE[r[3]][0], EDGE[best[3]][0], len(rows), r == best, sha) for r in rows]
    assert got == sorted(want, key=repr)
    assert exact_dedup.drop_copies(frame(spark)).count() == len(groups)
    assert exact_dedup.exact_dedup(frame(spark).limit(0)).collect() == []


def resplit(spark, path, run):
    """What `run` gives for a table whose scan is cut otherwise whenever it is planned anew: every write moves the number of splits."""
    from pyspark.sql import DataFrameWriter

    plain, n = DataFrameWriter.parquet, [3]

    def write(self, *a, **b):
        n[0] = n[0] % 13 + 2
        spark.conf.set("spark.sql.files.minPartitionNum", n[0])
        return plain(self, *a, **b)

    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", n[0])
    DataFrameWriter.parquet = write
    try:
        df = run(spark.read.parquet(path))
        n[0] = 6
        spark.conf.set("spark.sql.files.minPartitionNum", 29)
        return df.collect()
    finally:
        DataFrameWriter.parquet = plain
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("split") / "documents")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.union(docs.limit(60).withColumn("doc_id", F.col("doc_id") + 100_000)).repartition(12).write.parquet(path)
    return path


def test_numbers_hold_when_splits_change(spark, many_files):
    """Splits that change between two readings of a table lose nothing and swap nothing."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(many_files).collect()}
    distinct = {re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in docs.values()}
    kept = resplit(spark, many_files, exact_dedup.drop_copies)
    assert len(kept) == len(distinct) and all(docs[r.doc_id] == r.text for r in kept)
    assert {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept} == distinct
    want = sorted(map(tuple, ngram_join.ngram_jaccard_join(spark.read.parquet(many_files)).collect()))
    assert sorted(map(tuple, resplit(spark, many_files, ngram_join.ngram_jaccard_join))) == want
    assert {r.doc_id for r in resplit(spark, many_files, ngram_join.drop_near_copies)} == {r[2] for r in want}
    size = {i: len((t or "").split()) for i, t in docs.items()}
    taken = {r.doc_id: r.taken for r in mixing.weighted_fair_mix(spark.read.parquet(many_files)).collect()}
    copies = Counter(r.doc_id for r in resplit(spark, many_files, mixing.mixed))
    assert copies == Counter({i: int(t / size[i] + 0.5) for i, t in taken.items() if t and int(t / size[i] + 0.5)})


def test_numbers_of_other_tables_hold_when_splits_change(spark, tmp_path):
    vectors, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("embeddings", "pages"))
    for df, name, run in ((vectors, "v", near_embed.near_vectors), (pages, "p", warc.round_trip)):
        path = str(tmp_path / name)
        df.repartition(12).write.parquet(path)
        assert sorted(map(tuple, resplit(spark, path, run))) == sorted(map(tuple, run(df).collect()))
    docs = str(tmp_path / "d")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(12).write.parquet(docs)
    out = str(tmp_path / "shards")
    resplit(spark, docs, lambda df: sharding.write_shards(df, out) or df.limit(0))
    back, whole = spark.read.parquet(out), spark.read.parquet(docs)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in whole.collect())


def test_exact_dedup_splits_colliding_hashes(spark):
    weak = lambda c: F.encode(F.substring(c, 1, 1), "UTF-8")
    a = exact_dedup.exact_dedup(frame(spark), digest=weak)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, exact_dedup.exact_dedup(frame(spark)).collect()))


def brute_mix(rows):
    """The whole schedule, sorted by virtual finish time and cut at the budget, a word at a time at its end."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    entries = []
    for k, s in enumerate(sources):
        order = sorted((hashlib.md5(f"mix-1:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), len((t or "").split()), i) for i, t, z in rows if z == s)
        at = 0
        for _ in range(2):
            for _, n, i in order:
                at += n
                if n:
                    entries.append((at / (5.0, 2.0, 1.0)[k % 3], k, n, i))
    left, taken = int(1.5 * sum(len((t or "").split()) for _, t, _ in rows)), Counter()
    for _, _, n, i in sorted(entries, key=lambda e: e[:2]):
        taken[i] += min(n, left)
        left -= min(n, left)
    return +taken


def test_mixing_reaches_targets(spark):
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(i % 17)), s) for i, s in enumerate(["a"] * 400 + ["b"] * 30 + ["c"] * 300 + [None] * 20 + [""] * 5)]
    got = mixing.weighted_fair_mix(frame(spark, rows)).collect()
    size = Counter()
    for i, t, s in rows:
        size[s] += len(t.split())
    by, taken = {rows[r.doc_id][2]: r for r in got}, Counter()
    for r in got:
        taken[rows[r.doc_id][2]] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.size == len(rows[r.doc_id][1].split())
    assert sum(r.target for r in by.values()) == pytest.approx(1.5 * sum(size.values()))
    for s, r in by.items():
        assert r.source_size == size[s] and r.target <= 2 * size[s] + 1e-9 and abs(taken[s] - r.target) <= 17
    assert sum(taken.values()) == int(1.5 * sum(size.values()))
    assert brute_mix(rows) == Counter({r.doc_id: r.taken for r in got if r.taken})
    weight = dict(zip(sorted((s for s in by if s is not None)), (5, 2, 1, 5))) | {None: 5}
    level = [r.target / weight[s] for s, r in by.items() if r.target < 2 * size[s] - 1e-6]
    assert max(level) == pytest.approx(min(level)) and all(2 * size[s] / weight[s] <= max(level) + 1e-6 for s, r in by.items() if r.target >= 2 * size[s] - 1e-6)
    copies = Counter(r.doc_id for r in mixing.mixed(frame(spark, rows)).collect())
    assert all(copies[r.doc_id] <= 2 for r in got)
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in mixing.weighted_fair_mix(frame(spark, rows).repartition(3)).collect())


def test_mixing_edges(spark):
    got = mixing.weighted_fair_mix(frame(spark)).collect()
    assert len(got) == len(EDGE) and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.weighted_fair_mix(frame(spark).limit(0)).collect() == []
    assert mixing.mixed(frame(spark).limit(0)).collect() == [] and mixing.mixed(frame(spark)).columns == frame(spark).columns
    none = [(None, f"w{i} x", "s") for i in range(3_000)]
    assert len(set(spread(spark, none))) > 1_000 and mixing.mixed(frame(spark, none)).count() == 4_500


def spread(spark, rows):
    queued = mixing._queued(frame(spark, rows), (1,), 1.0, 1, "s", "doc_id", "text", "source", [])
    return [r["end"] for r in queued.collect()]


def test_shards_are_exact(spark, tmp_path):
    rows = [(i % 90, str(i), "x") for i in range(101)]
    got = sharding.shard_digest(frame(spark, rows).repartition(3).cache()).collect()
    count = Counter(r.shard for r in got)
    assert max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(8))
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(t) + 1) for i, t, _ in rows)
    few = sharding.shard_digest(frame(spark)).collect()
    assert sorted(r.size for r in few) == sorted(len((t or "").encode()) + 1 for _, t, _ in EDGE)
    assert sharding.shard_digest(frame(spark).limit(0)).collect() == []
    assert {(r.size, r.text_crc32) for r in few} == {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in EDGE}
    clash = frame(spark, rows).withColumn("shard", F.lit("s")).withColumn("slot", F.lit(1)).withColumn("__rid__", F.lit(2))
    sharding.write_shards(clash, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*clash.columns, "shard_"]) and sorted(r.text for r in back.collect()) == sorted(t for _, t, _ in rows)


def test_communication_matrix(monkeypatch):
    m = sharding.communication_matrix([100, 1, 0, 57, 3], 8)
    assert m.sum(1).tolist() == [100, 1, 0, 57, 3] and np.ptp(m.sum(0)) <= 1 and (m >= 0).all()
    monkeypatch.setattr(sharding, "MOST", 1_000)  # above the population that numpy's own draw takes
    wide = sharding.communication_matrix([10_000, 65_536, 5], 3)
    assert wide.sum(1).tolist() == [10_000, 65_536, 5] and np.ptp(wide.sum(0)) <= 1 and (wide >= 0).all() and abs(wide[0, 0] - 3_333) < 300
    monkeypatch.undo()
    draws = np.array([sharding.communication_matrix([40, 40], 4, s)[0] for s in range(400)])
    assert abs(draws.mean() - 10) < 1e-9 and abs(draws.std() - np.sqrt(40 * 0.25 * 0.75 * 40 / 79)) < 0.25


def test_warc_edges(spark):
    long = "ü" * 200_000
    rows = [(1, "u", "x" * 100), (2, "u\n2", "x" * 100), (3, None, "x" * 99), (4, "u", "x" * 99), (None, "u", "x" * 100), (5, "u", None), (6, "u", ""), (7, "u", long), (7, "u", long), (8, "u", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").coalesce(2).cache()
    got = sorted((tuple(r) for r in warc.round_trip(df, split=500).collect()), key=repr)
    want = []
    for n, (i, _, h) in enumerate(rows):
        p = (h or "").encode()
        first = 1 if h == "x" * 100 else 7
        again = len(p) >= 100 and (i != first or n == 8)
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).collect() == []


@pytest.mark.parametrize("step", [1, 7, 64, 1000])
def test_warc_ranges_own_every_record_once(step):
    rng = np.random.default_rng(0)
    whole, starts = b"", []
    for i in range(30):
        payload = bytes(rng.integers(0, 256, 300, dtype=np.uint8)) + warc.MAGIC * (i % 5)
        starts.append(len(whole))
        whole += warc.member(warc.record("response", f"r{i}", "u", "", len(payload), payload, None, "d"))
    found = [at for s in range(0, len(whole), step) for at, _ in warc.records_in(io.BytesIO(whole), len(whole), s, min(s + step, len(whole)))]
    assert found == starts


def test_warc_damage_padding_and_several_records():
    made = [warc.record("response", f"r{i}", "u", "", 300, bytes([i]) * 300, None, "d") for i in range(6)]
    members = [warc.member(made[0]), b"\0" * 70, warc.member(made[1] + made[2]), warc.member(made[3])[:-30], warc.member(made[4]), warc.member(b"no record"), warc.member(made[5])]
    whole = b"".join(members)
    for step in (1, 50, len(whole)):
        found = [f for s in range(0, len(whole), step) for _, f in warc.records_in(io.BytesIO(whole), len(whole), s, min(s + step, len(whole)))]
        assert [f["record_id"] for f in found] == ["r0", "r1", "r2", None, "r4", "r5"] and [f["type"] for f in found].count("damaged") == 1
        assert all(f["payload"] == bytes([int(f["record_id"][1])]) * 300 for f in found if f["record_id"])


def brute_vectors(rows, least=0.93):
    good = [k for k, (_, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in good:
        for j in good:
            if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    least_id = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least_id[root(i)] = min(r[0], least_id.get(root(i), r[0]))
    return sorted(((r[0], n, least_id.get(root(i)), r[0] == least_id.get(root(i))) for i, (r, n) in enumerate(zip(rows, links))), key=repr)


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(25):
        c = rng.normal(size=64)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), [float(x) for x in np.float32(c + rng.normal(size=64) * rng.choice([0.02, 0.2, 0.27]))], int(rng.integers(0, 2))))
    rows += [(len(rows) + k, rows[3][1], rows[3][2]) for k in range(4)] + [(900, [2 * x for x in rows[3][1]], rows[3][2])]
    rows += [(901, None, 0), (902, [0.0] * 64, 0), (903, [float("nan")] * 64, 0), (904, [], 0), (905, [None] + [1.0] * 63, 0), (906, rows[3][1], None), (907, [1.0, 2.0], 0), (908, [1.0, 2.1], 0), (None, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, label int, rep int, cell string").coalesce(1).cache()
    want = brute_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    for most in (1_024, 3):
        monkeypatch.setattr(near_embed, "ROWS", most)
        assert sorted((tuple(r) for r in near_embed.near_vectors(df).collect()), key=repr) == want
    assert near_embed.near_vectors(df.limit(0)).collect() == []


def test_near_vectors_recall(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    got = {r.vec_id: r for r in near_embed.near_vectors(spark.read.parquet(path)).collect()}
    v = duckdb.sql(f"select vec_id, label, embedding from read_parquet('{path}') order by vec_id").fetchall()
    x = near_embed.unit(np.array([r[2] for r in v], float))
    near = (x @ x.T >= 0.93) & (np.array([r[1] for r in v])[:, None] == np.array([r[1] for r in v])[None, :])
    links = {v[k][0]: int(near[k].sum()) - 1 for k in range(len(v))}
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links.values()) and all(got[k].n_links <= links[k] for k in got)


@pytest.mark.parametrize("width", [64, 100, 768])
def test_pairs_at_the_threshold_are_found(width):
    rng, scheme = np.random.default_rng(0), near_embed.SCHEME
    a, z = near_embed.unit(rng.normal(size=(2_000, width))), rng.normal(size=(2_000, width))
    z = near_embed.unit(z - (z * a).sum(1, keepdims=True) * a)
    ca, cb = (near_embed.cells(x, scheme) for x in (a, 0.93 * a + np.sqrt(1 - 0.93**2) * z))
    met = (ca[:, :, :1] == cb).any((1, 2)) | (cb[:, :, :1] == ca).any((1, 2))
    assert met.mean() > 0.98
