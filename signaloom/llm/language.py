"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of +1 and -1; for each of its bits a binary classifier over hashed byte n-grams (lengths ORDERS, letters A-Z lowered, everything that is no letter as a
blank) learns which side a text is on: naive Bayes weights, averaged over the text and scaled by a logistic fit on short and long pieces of
the training texts. Decoding takes the language whose codeword has the least logistic loss, each bit weighted by how well its classifier did for that language in training; a small gap to the
second is flagged as ambiguous.

Training. The sample is bounded: about PER_LANGUAGE texts of each language, fewer where that makes more than IN_ALL, chosen by a hash of the id, none over LONGEST characters; it is read by the driver. Prediction covers whole texts, as numpy operations on
the Arrow buffers, without a shuffle.

Defined results. Null text, or no letter: `und`, score 0, not ambiguous. Nothing to learn from: `und`. One language: that one. Null ids: not learnt from, not held out. Repeated rows: a row each. Empty table: no rows. Other columns, of
any name, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import buffers

ORDERS, BITS, PER_LANGUAGE, IN_ALL, LONGEST, CLOSE, CHUNK = (2, 3), 16, 800, 12_800, 20_000, 0.1, 1 << 18

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """n x bits of +-1: the exhaustive code up to 6 languages, else the best of 50 random codes of 15 bits per doubling."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 6:
        return np.array([[1] + [1 - 2 * (b >> k & 1) for k in range(n - 1)] for b in range(1, 2 ** (n - 1))], float).T
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, 15 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = ((code[:, None] != code[None, :]).sum(2) + 10_000 * np.eye(n, dtype=int)).min()
        if apart > far:
            best, far = code, apart
    return best


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that starts at each byte; one for each position but the last."""
    h = data[: len(data) - order + 1].astype(np.uint32)
    for k in range(1, order):
        h = h * np.uint32(257 if order == 2 else 0x01000193) + data[k : len(data) - order + 1 + k]
    return (h if order == 2 else (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)) & np.uint32((1 << BITS) - 1)


def _regions(offsets: np.ndarray):
    """Ranges of texts of about CHUNK bytes each."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, end
        at = end


def margins(data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """texts x bits: the mean weight of a text's n-grams; 0 for a text without any."""
    bits = tables[0].shape[1]
    total, count = np.zeros((len(offsets) - 1, bits)), np.zeros(len(offsets) - 1)
    for at, end in _regions(offsets):
        cuts = offsets[at : end + 1]
        for low in range(int(cuts[0]), int(cuts[-1]), CHUNK):  # a very long text in pieces
            high = min(low + CHUNK, int(cuts[-1]))
            inside = np.clip(cuts, low, high)
            for order, table in zip(ORDERS, tables):
                part = _FOLD[data[low : min(high + order - 1, int(cuts[-1]))]]
                if len(part) < order:
                    continue
                gram = _grams(part, order)
                begin, stop = np.minimum(inside[:-1] - low, len(gram)), np.minimum(np.maximum(np.where(cuts[1:] > high, inside[1:], np.maximum(inside[1:] - order + 1, inside[:-1])) - low, 0), len(gram))
                n = np.maximum(stop - begin, 0)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                edges = np.stack([begin[some], begin[some] + n[some]], 1).reshape(-1)
                weight = np.concatenate([table[gram], np.zeros((1, bits), np.float32)])
                total[at + some] += np.add.reduceat(weight, edges, axis=0)[::2]
                count[at + some] += n[some]
    return total / np.maximum(count, 1)[:, None]


def _logistic(x: np.ndarray, y: np.ndarray) -> float:
    """Slope of a logistic fit through the origin."""
    slope = 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
        slope = np.clip(slope + ((y - p) * x).sum() / ((p * (1 - p) * x * x).sum() + 1e-6 * len(x) + 1e-9), 0.05, 60)
    return float(slope)


class Model:
    """Languages, codewords, weight tables, slopes and the weights of decoding."""

    def __init__(self, texts: list[str], languages: list[str], seed: int = 0):
        self.languages = sorted(set(languages))
        self.code = codewords(len(self.languages))
        bits = self.code.shape[1]
        if not bits:
            return
        label = np.array([self.languages.index(x) for x in languages])
        counts = [np.zeros((len(self.languages), 1 << BITS)) for _ in ORDERS]
        for text, k in zip(texts, label):
            data = _FOLD[np.frombuffer(text.encode(), np.uint8)]
            for c, order in zip(counts, ORDERS):
                if len(data) >= order:
                    c[k] += np.bincount(_grams(data, order), minlength=1 << BITS)
        self.tables = []
        for c in counts:
            rate = c / np.maximum(c.sum(1, keepdims=True), 1)  # languages weigh alike
            rate = rate * max(1.0, c.sum() / len(c))
            table = np.empty((1 << BITS, bits), np.float32)
            for j in range(bits):
                plus, minus = rate[self.code[:, j] > 0].sum(0) + 0.5, rate[self.code[:, j] < 0].sum(0) + 0.5
                table[:, j] = np.log(plus / plus.sum()) - np.log(minus / minus.sum())
            self.tables.append(table)
        rng, pieces, owner = np.random.default_rng(seed), [], []
        for text, k in zip(texts, label):
            at = int(rng.integers(0, max(1, len(text) - 20)))
            pieces += [text, text[at : at + int(rng.integers(20, 200))]]
            owner += [k, k]
        owner = np.array(owner)
        m = margins(*buffers(pa.array(pieces)), self.tables)
        side = self.code[owner]
        self.slope = np.array([_logistic(m[:, j], (side[:, j] > 0).astype(float)) for j in range(bits)])
        right = (np.sign(m) == side).astype(float)
        self.weight = np.array([right[owner == k].mean(0) + 1e-3 for k in range(len(self.languages))])
        self.weight /= self.weight.sum(1, keepdims=True)

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and ambiguity for each row of margins."""
        f = margin * self.slope
        loss = np.stack([np.logaddexp(0, -f * self.code[k]) @ self.weight[k] for k in range(len(self.languages))], 1)
        bits = self.code.shape[1]
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * bits)
        p /= p.sum(1, keepdims=True)
        second = np.sort(p, 1)[:, -2]
        return loss.argmin(1), p.max(1), p.max(1) - second < CLOSE


def _held_out(id_col):
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, learn, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows where `learn` holds."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return Model([], [])
    per_language = max(1, min(per_language, IN_ALL // len(counts)))
    share = {r["lang"]: min(1.0, 1.2 * per_language / r["count"]) for r in counts}
    part = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang"))
    drawn = rows.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000) & (F.length("text") <= LONGEST) & F.col("text").rlike(r"\p{L}"))
    found = drawn.orderBy(F.xxhash64("doc_id"), "text").limit(2 * per_language * len(share)).collect()
    return Model([r["text"] for r in found], [r["lang"] for r in found])


def _predict(model: Model, columns: list[str]):
    def run(batches):
        for b in batches:
            text, letters = b.column("__text__"), b.column("__letters__").to_numpy(zero_copy_only=False)
            n = len(text)
            if not model.languages:
                known, best, score, close = np.zeros(n, bool), np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
            elif len(model.languages) == 1:
                known, best, score, close = letters, np.zeros(n, int), np.ones(n), np.zeros(n, bool)
            else:
                known, (best, score, close) = letters, model.decode(margins(*buffers(text), model.tables))
            names = np.array([*model.languages, "und"], object)
            out = [pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & close)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), *out], [*columns, "lang_pred", "score", "ambiguous"])

    return run


def _with_prediction(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    held = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(text_col).alias("__text__"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters__"))
    schema = T.StructType([*docs.schema, *(T.StructField(n, t) for n, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())))])
    return held.mapInArrow(_predict(model, docs.columns), schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row; learns from rows that are not held out."""
    out = F.col(id_col)
    model = fit(docs, ~_held_out(out), id_col, text_col, lang_col)
    rows = docs.select(out.alias("doc_id"), _held_out(out).alias("held_out"), F.col(text_col).alias("text"))
    return _with_prediction(rows, model, "text").drop("text").select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is identified without ambiguity, with all columns. Where there is nothing to learn from, nothing can be told and all rows stay."""
    model = fit(docs, ~_held_out(F.col(id_col)), id_col, text_col, lang_col)
    if not model.languages:
        return docs
    names = [f"__c{i}__" for i in range(len(docs.columns))]
    marked = _with_prediction(docs.toDF(*names), model, names[docs.columns.index(text_col)])
    return marked.filter("lang_pred <> 'und' and not ambiguous").select(*names).toDF(*docs.columns)
