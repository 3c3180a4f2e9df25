"""Every stage against brute force on its own input."""

import re
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_ngram_join import spelled  # noqa: E402
from tests.llm.test_packing import held  # noqa: E402


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, inputs = docs.columns, [docs]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, inputs[-1], sf_dir).write.parquet(str(tmp_path / str(n)))
        inputs.append(spark.read.parquet(str(tmp_path / str(n))))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert inputs[-1].columns == columns
    texts = [[(r.doc_id, r.text) for r in df.collect()] for df in inputs[:5]]

    assert len(texts[1]) >= 0.97 * len(texts[0]) and set(texts[1]) <= set(texts[0])

    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in texts[1]:
        groups[bare(t)].append((-len(t), i))
    assert sorted(i for i, _ in texts[2]) == sorted(min(g)[1] for g in groups.values())

    sets = [spelled(t, 5) for _, t in texts[2]]
    up = list(range(len(sets)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(sets)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                up[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(texts[2]):
        first[root(i)] = min(d, first.get(root(i), d))
    assert sorted(i for i, _ in texts[3]) == sorted(first.values())

    copies = Counter(i for i, _ in texts[4])
    assert max(copies.values()) <= 2 and set(texts[4]) <= set(texts[3])
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in rows)
    assert abs(words(texts[4]) / words(texts[3]) - 1.5) < 0.1

    pieces, once = inputs[5].collect(), dict(texts[4])
    tokens = {i: n for i, n in ((r.doc_id, r.doc_tokens) for r in pieces)}
    assert sum(r.length for r in pieces) == sum(tokens[i] * copies[i] for i in once)
    assert all(len(r.ids) == 2 * r.length for r in pieces)
    assert held is not None and corpus_pipeline.ORACLE_SQL is None


def test_stages_at_the_edges(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing names; then the same columns without rows."""
    words = ["the of and that with this", "der die und nicht ein das"]
    rows = [(i, f"{words[i % 2]} w{i} x{i} y{i} z{i} v{i}", ["en", "de"][i % 2], "ab"[i % 2]) for i in range(60)]
    rows += [(61, None, None, None), (62, "", "en", "a"), (63, " \t", None, "a"), (None, "the of and that with this one is null", None, None), (64, "der die und nicht ein das " * 8_000, "de", None)]
    rows += [rows[0], rows[0], (65, rows[0][1], "en", None), (66, "12 34", None, "b")]
    docs = spark.createDataFrame([(*r, 1, "k", 2.0, "s") for r in rows], "doc_id long, text string, lang string, source string, rid int, c0 string, size double, kept string").coalesce(2).cache()
    counts = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out, none = stage(spark, docs, ""), stage(spark, docs.limit(0), "")
        assert none.collect() == []
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == none.columns == docs.columns
        counts.append(out.collect())
    ids = [sorted((r.doc_id for r in c), key=repr) for c in counts[:4]]
    assert not {61, 62, 63, 66} & set(ids[0]) and None in ids[0] and ids[0].count(0) == 3
    assert len(ids[1]) == len(rows) - 5 and ids[1].count(0) == 1 and 65 not in ids[1]  # three copies of a row and three blank texts
    assert ids[2].count(0) == 1 and 65 not in ids[2] and {61, 62, 63} <= set(ids[2]) and None in ids[2]
    assert not {61, 62, 63} & set(ids[3]) and all(ids[3].count(i) <= 2 for i in range(1, 60))
    assert sum(r.start == 0 for r in counts[4]) == len(rows)
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source")
    assert corpus_pipeline.identify_language(spark, unlabelled, "").count() == len(rows)
