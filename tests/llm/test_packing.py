import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from signaloom.llm import packing, tokens
from signaloom.llm.shingles import buffers
from signaloom.llm.tokens import default_vocabulary, encoder


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def held(rows, docs):
    """Every id lies in one piece, offsets are gapless, checksums are right; returns the padding."""
    t, pieces, places = tokenizer(), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
    used = [sum(n for _, n in p) for p in places.values()]
    return sum(2048 - u for u in used) / max(1, 2048 * len(used))


def test_round_trip(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(df).collect()
    assert held(rows, [(r.doc_id, r.text) for r in df.collect()]) < 0.01


ODD = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext| >", "a  b\n \nc \t d ", " x", "  ", "  　 x", "é　 漢字  \n", "it's 'tis  can't ", "\n\n a \n b", "12 345,6 .. !! ?"]
ODD += ["a\x85 b", "a ​ b", "x\x1c y \x1f z", "", " ", "à « b", "x   y", "", "", " \n", "\n ", "a\xa0 \xa0b c", "y" * 9_000, "z " * 5_000, "😀 😀   k"]


def test_edges(spark, monkeypatch):
    docs = [(1, None), (2, ""), (3, "a  b\n \nc \t d "), (4, " x" * 5_000), (5, "<|endoftext|> é　 漢字  \n"), (6, "word " * 2047), (7, "y" * 9_000)] + [(i, f"t{i} common words here") for i in range(10, 400)]
    df = spark.createDataFrame([(*d, "k", 2, 7) for d in docs], "doc_id long, text string, ids string, kind int, k1 int").coalesce(2).cache()
    monkeypatch.setattr(packing, "UNITS", 100)
    held(packing.pack(df).collect(), docs)
    assert packing.pack(df.limit(0)).collect() == []
    whole = packing.sequences(packing.pack(df, keep_ids=True)).collect()
    assert all(len(r.ids) == 2 * r.length for r in whole)


def test_repeated_rows_and_null_ids_are_packed_each(spark):
    same = spark.createDataFrame([(None, "p q")] * 3 + [(4, "r")] * 2, "doc_id long, text string").coalesce(1).cache()
    rows = packing.pack(same).collect()
    assert sorted((r.doc_id is None, r.start, r.length, r.doc_tokens) for r in rows) == [(False, 0, 2, 2)] * 2 + [(True, 0, 3, 3)] * 3
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows)[0] == 0


@pytest.mark.parametrize("slice_, cached", [(1 << 22, 1_500_000), (1 << 10, 3), (64, 50)])
def test_ids_equal_the_tokenizer(spark, monkeypatch, slice_, cached):
    monkeypatch.setattr(tokens, "SLICE", slice_)
    monkeypatch.setattr(tokens, "CACHED", cached)
    t, encode = tokenizer(), encoder(default_vocabulary())
    encode.forget()
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text, ids in zip(texts, encode(*buffers(pa.array(texts)))):
        assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids


def brute_scores(units, k):
    """BM25 of every unit for the distinct ids of unit k, from the formula."""
    n, average = len(units), np.mean([len(u) for u in units])
    out = np.zeros(n)
    for term in set(units[k]):
        df = sum(term in u for u in units)
        idf = max(0.0, np.log((n - df + 0.5) / (df + 0.5)))
        for j, u in enumerate(units):
            tf = u.count(term)
            out[j] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(u) / average))
    return out


def weighed(units):
    df = np.bincount(np.concatenate([np.unique(u) for u in units]), minlength=packing.VOCABULARY).astype(float)
    idf = np.where(df > 0, np.maximum(0, np.log((len(units) - df + 0.5) / (df + 0.5))), 0)
    return [packing.weigh(u, idf, float(np.mean([len(u) for u in units]))) for u in units]


def test_scores_equal_brute_force():
    rng = np.random.default_rng(3)
    units = [rng.integers(0, 60, rng.integers(1, 50)).astype("<u2") for _ in range(80)]
    index = packing.Index(weighed(units))
    for k in range(0, 80, 9):
        assert np.allclose(index.scores(k), brute_scores([u.tolist() for u in units], k), rtol=1e-5)


def test_neighbours_are_lexical():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1_000 * k, 1_000 * k + 300, (40, 200)).astype("<u2") for k in range(1, 9)]
    units = [u for t in topics for u in t]
    found = packing.fill(np.array([len(u) for u in units]), packing.Index(weighed(units)))
    assert np.mean([sum(p[0] // 40 == s[0][0] // 40 for p in s) / len(s) for s in found]) > 0.8


def test_close_neighbours_meet_across_the_corpus(spark, monkeypatch):
    """Pairs of related texts, far more units than a shard holds: a seed gets its own partner, wherever it lies, and every id is used once."""
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(3_000)]
    docs = []
    for k in range(300):
        own = list(rng.choice(words, 200))
        docs += [(k, " ".join(own)), (1_000 + k, " ".join(own[:170] + list(rng.choice(words, 20))))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).cache()
    df.count()
    monkeypatch.setattr(packing, "UNITS", 40)
    rows = packing.pack(df).collect()
    assert held(rows, docs) < 0.1
    places = defaultdict(set)
    for r in rows:
        places[r.doc_id].add(r.sequence_id)
    assert np.mean([bool(places[k] & places[1_000 + k]) for k in range(300)]) > 0.75


def test_share_of_best_neighbours_that_share_a_shard(spark, monkeypatch):
    """Against brute force over the whole corpus: the best neighbour of a unit, where it scores CLOSE of the unit's own score, is in its shard in one of the passes."""
    t = tokenizer()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    units = [np.array((t.encode(x, add_special_tokens=False).ids + [1])[-1_500:], "<u2") for x in texts]
    made = weighed(units)
    index, shards = packing.Index(made), []
    for keys in ([packing.pair_signature(u) for u in units], [packing.term_signature(*w) for w in made]):
        order = sorted(range(len(units)), key=lambda k: (keys[k], k))
        shards.append({k: place // 64 for place, k in enumerate(order)})
    met = []
    for k in range(len(units)):
        scores = index.scores(k)
        own, scores[k] = scores[k], -1
        best = int(np.argmax(scores))
        if scores[best] >= packing.CLOSE * own > 0:
            met.append(any(s[k] == s[best] for s in shards))
    assert len(met) > 30 and np.mean(met) > 0.7, (len(met), np.mean(met))
