import random
import re
import time

import numpy as np
import pytest

from signaloom.llm import ngram_join
from signaloom.llm.common import CLEAN, scratch
from signaloom.llm.shingles import shingle_sets

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def spelled(text, k):
    words = re.findall(SPACE, (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(docs, k, num, den):
    sets = [spelled(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)), n) for i, ((d, _), s, n) in enumerate(zip(docs, sets, links))), key=repr)


def corpus(seed=3):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    docs = []
    for base in range(12):
        n = r.choice([2, 5, 9, 12, 14, 40, 130, 300])
        text = [r.choice(words) for _ in range(n)]
        for _ in range(r.choice([1, 3, 8])):
            own = list(text)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(words)
            docs.append(" ".join(own) if r.random() < 0.8 else "\t ".join(own).upper() + "\n")
    docs += [None, "", "  \n", "One", "one ", "a b", "A\x0bB", "a b c", "Ä b c", "ä b c"]
    return [(i, t) for i, t in enumerate(docs)] + [(3, docs[3]), (None, docs[4])]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_equals_brute_force(spark, k, num, den, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ngram_join.ngram_jaccard_join(df.cache(), k, f"{num}/{den}")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [(d, n, c, x) for d, n, c, x in brute(docs, k, num, den)]


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIMIT", 900)
    monkeypatch.setattr(ngram_join, "ROWS", 6)
    r = random.Random(1)
    base = ["w%d" % r.randrange(500) for _ in range(120)]
    docs = []
    for i in range(60):
        own = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5])):
            own[r.randrange(120)] = "x%d" % r.randrange(40)
        docs.append((i, " ".join(own[: r.choice([120, 119, 112, 108])])))
    df = spark.createDataFrame(docs, "doc_id long, text string").cache()
    assert sorted((tuple(r) for r in ngram_join.ngram_jaccard_join(df, 3, "90/100").collect()), key=repr) == brute(docs, 3, 90, 100)


def test_real_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in ngram_join.ngram_jaccard_join(df, 3, "90/100").collect()), key=repr) == brute(docs, 3, 90, 100)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, rid long, n long")
    assert ngram_join.ngram_jaccard_join(df).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f", 5, 5), (2, "a b c d e f", 6, 6)], "doc_id long, text string, rid long, n long").cache()
    assert [tuple(r) for r in ngram_join.drop_near_copies(df).collect()] == [(1, "a b c d e f", 5, 5)]


def test_very_long_text_is_hashed_whole():
    import pyarrow as pa

    words = ["v%d" % (i % 70_000) for i in range(400_000)]
    sets = shingle_sets(pa.array([" ".join(words), "x" * 3_000_000 + " b c d", None]), 3)
    assert len(sets[0]) == len(spelled(" ".join(words), 3)) and [len(s) for s in sets[1:]] == [2, 0]


def test_levels_lose_no_pair():
    for num, den in ((9, 10), (4, 5)):
        levels = ngram_join.Levels(num, den)
        r = np.random.default_rng(0)
        for n in (10, 17, 33, 60, 200):
            for _ in range(20):
                a = r.integers(1, 2**63, n, dtype=np.uint64)
                o = n - int(r.integers(0, n // 8 + 1))
                b = np.concatenate([a[:o], r.integers(1, 2**63, int(r.integers(0, n // 8 + 1)), dtype=np.uint64)])
                if den * o >= num * (len(a) + len(b) - o) and len(b) > o:
                    for share in (0, 0.2, 0.6, 1):
                        often = np.sort(r.choice(np.concatenate([a, b]), int(share * n), replace=False))
                        assert np.isin(ngram_join.keys_of(np.sort(a), levels, often), ngram_join.keys_of(np.sort(b), levels, often)).any()


def test_steps_leave_no_shuffle_files(spark):
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in held.split("\n") if "/shuffle_" in f and f.endswith(".data")}

    before, setting = files(), spark.conf.get(CLEAN, None)
    written = scratch(spark.range(20_000).repartition(5, "id"), "no-shuffle")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(CLEAN, None) == setting
    assert written.count() == 20_000
