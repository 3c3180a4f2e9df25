"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of its character n-grams; a window's vector adds up the vectors of consecutive words (a mean, but for a constant), and goes into a linear softmax. There are two
such bags, by SPANS: single words, and windows of five. A text has its most toxic word and its most toxic window: so a few words count in a text of any length, and a phrase of ordinary words counts as their
sum. (README.md has the held-out figures, also of the windows alone.) Embeddings and softmax are trained jointly in numpy. Only texts carry labels, so training alternates: the window of a toxic text that scores highest counts as toxic, the highest windows of clean texts and some others as clean. The share DOUBTED of toxic
texts that score lowest is left out of later epochs, as labels may be wrong. A misspelling that was never seen shares n-gram vectors with the word it stands for. The two highest scores are mapped
to a probability by a logistic fit on texts that training left out.

Training. The sample is bounded: at most TOXIC toxic and CLEAN clean texts by a hash of the id, none over LONGEST characters; the driver reads it. Their ids are drawn from the labels first, so one scan of
the documents finds the texts. Scoring covers whole texts: as means are linear, each n-gram has one number, and numpy sums them on the Arrow buffers; a text of over CHUNK bytes is read in regions, whose
longer windows look AHEAD bytes past their end.

Defined results. Null, empty or blank text: the score of no word, below 0.3 unless all labels are toxic. Null ids: not learnt from, not held out. Labels that are null: not learnt from. Nothing to learn from, or one
class only: that class's score (0 or 1). Repeated rows: a row each. Empty table: no rows. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import buffers

ORDERS, BITS, DIM, TOXIC, CLEAN, LONGEST, CHUNK = (3, 4, 5), 17, 8, 2_500, 3_500, 20_000, 1 << 18
EPOCHS, RATE, THRESHOLD, FLOOR, SPANS, DOUBTED, AHEAD, RARE = 12, 0.5, 0.3, -8.0, (1, 5), 0.05, 2_048, 8

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets, the word of each, and where words begin, of bytes that start and end a text or a blank. An n-gram may begin or end with the blank beside its word."""
    x = np.concatenate([[32], _FOLD[data], [32]]).astype(np.uint32)
    blank = x == 32
    begins = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), begins
    word = np.cumsum(~blank & np.append(True, blank[:-1])) - 1
    blanks = np.cumsum(blank)
    grams, words = [], []
    for order in ORDERS:
        n = len(x) - order + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint32)
        for k in range(order):
            h = (h + x[k : k + n] + np.uint32(1)) * np.uint32(0x01000193)
        inner = blanks[order - 2 : order - 2 + n] - blanks[:n]  # blanks strictly inside
        at = np.flatnonzero(inner == 0)
        grams.append(((h[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64))
        words.append(word[at + 1])
    return np.concatenate(grams), np.concatenate(words), begins - 1


def word_scores(data: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and for each bag the mean number of each word's n-grams. Every word has some: those with the blanks beside it."""
    gram, word, begins = features(data)
    n = np.maximum(np.bincount(word, minlength=len(begins)), 1)
    return begins, np.stack([np.bincount(word, own[gram], len(begins)) / n for own in number], 1)


def window_sums(score: np.ndarray, stop: np.ndarray, span: int) -> np.ndarray:
    """For the window that begins at each word: the sum of the scores of its words up to `stop`."""
    if span == 1:
        return score
    total = np.append(0.0, np.cumsum(score))
    return total[np.minimum(np.arange(len(score)) + span, stop)] - total[:-1]


def text_scores(data: np.ndarray, offsets: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The highest window score of each text for each bag, FLOOR for none. Regions of about CHUNK bytes end where a text does or after a blank."""
    out = np.full((len(offsets) - 1, len(number)), FLOOR)
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        while end < n:  # back to the last end of a text or blank, or on to the next
            stops = np.flatnonzero(_FOLD[data[at:end]] == 32)
            k = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            best = max(k, at + int(stops[-1]) + 1 if len(stops) else 0)
            if best > at:
                end = best
                break
            end = min(n, end + CHUNK)
        after = int(offsets[np.searchsorted(offsets, end, "left")])  # the end of the text that the region ends in
        reach = min(after, end + AHEAD)
        cuts = np.unique(np.clip(offsets, at, reach))
        # A blank goes between texts, so that no word spans two.
        parts = np.insert(data[at:reach], cuts[1:-1] - at, 32) if len(cuts) > 2 else data[at:reach]
        begins, score = word_scores(parts, number)
        if len(begins):
            inside = np.flatnonzero((offsets[:-1] < end) & (offsets[1:] > at))
            shift = np.searchsorted(cuts[1:-1], np.maximum(offsets[inside], at), "right")
            starts = np.maximum(offsets[inside], at) - at + shift
            owner = np.searchsorted(starts, begins, "right") - 1
            stop = np.searchsorted(owner, owner, "right")
            mine = np.flatnonzero(begins < end - at + np.searchsorted(cuts[1:-1], end, "right"))
            first = np.flatnonzero(np.append(True, owner[mine][1:] != owner[mine][:-1])) if len(mine) else mine
            for k, span in enumerate(SPANS[: len(number)]):
                best = np.maximum.reduceat(window_sums(score[:, k], stop, span)[mine], first) if len(mine) else np.zeros(0)
                at_text = inside[owner[mine[first]]]
                out[at_text, k] = np.maximum(out[at_text, k], best)
        at = end
    return out


def _softmax(x):
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


class Model:
    """number: for each bag a weight per n-gram bucket (its embedding through the softmax); scale and shift map a text's highest scores to a probability."""

    def __init__(self, texts: list[str], toxic: np.ndarray, prior: float = 0.5, seed: int = 0):
        self.prior = prior
        toxic = np.asarray(toxic, int)
        self.number, self.scale, self.shift = np.zeros((len(SPANS), 1 << BITS)), np.zeros(len(SPANS)), (-20.0 if not toxic.any() else 20.0)
        self.none = self.shift
        if not toxic.any() or toxic.all():
            return
        rng = np.random.default_rng(seed)
        apart = rng.random(len(texts)) < 0.25
        train = np.flatnonzero(~apart) if len({*toxic[~apart]}) == 2 and len({*toxic[apart]}) == 2 else np.arange(len(texts))
        kinds, bags = {}, []
        for k in train:
            words = bytes(_FOLD[np.frombuffer((texts[k] or "").encode(), np.uint8)]).split()
            bags.append(np.array([kinds.setdefault(w, len(kinds)) for w in words], np.int32))
        gram, word, _ = features(np.frombuffer(b" ".join(kinds), np.uint8))
        order = np.argsort(word, kind="stable")
        gram, word = gram[order], word[order]
        first = np.searchsorted(word, np.arange(len(kinds) + 1))
        grams = np.maximum(np.diff(first), 1)
        label = toxic[train]
        sequence = np.concatenate(bags)
        ends = np.cumsum([len(b) for b in bags])
        begins, size = ends - [len(b) for b in bags], np.array([len(b) for b in bags])
        stop = np.repeat(ends, size)
        bad, all_of = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for bag, toxic_one in zip(bags, label):
            ids = np.unique(bag)
            n = first[ids + 1] - first[ids]
            found = np.unique(gram[np.arange(n.sum()) + np.repeat(first[ids] - np.cumsum(n) + n, n)])
            all_of[found] += 1
            bad[found] += toxic_one
        odds = np.log((bad + 1) / (label.sum() + 2)) - np.log((all_of - bad + 1) / ((1 - label).sum() + 2))
        odds *= all_of / (all_of + RARE)  # what few texts hold tells little
        def head(span):
            """An n-gram's weight: its embedding through the softmax."""
            embed, out, bias = rng.normal(0, 0.1, (1 << BITS, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
            seen = np.full(1 << BITS, 1e-6)

            def step(window, target, rate):
                nonlocal out, bias
                place = window[:, None] + np.arange(span)
                row, column = np.nonzero(place < stop[window][:, None])
                ids, which = np.unique(sequence[place[row, column]], return_inverse=True)
                n = first[ids + 1] - first[ids]
                edge = np.cumsum(n) - n
                g = gram[np.arange(n.sum()) + np.repeat(first[ids] - edge, n)]
                vector = np.add.reduceat(embed[g], edge, axis=0) / n[:, None]
                hidden = np.stack([np.bincount(row, vector[which, d], len(window)) for d in range(DIM)], 1)
                delta = _softmax(hidden @ out + bias) - np.stack([1 - target, target], 1)
                back = (delta @ out.T)[row]
                back = np.stack([np.bincount(which, back[:, d], len(ids)) for d in range(DIM)], 1) / n[:, None]
                kind, inverse = np.unique(g, return_inverse=True)
                grad = np.stack([np.bincount(inverse, np.repeat(back[:, d], n), len(kind)) for d in range(DIM)], 1)
                seen[kind] += (grad**2).mean(1)
                embed[kind] -= rate * grad / np.sqrt(seen[kind])[:, None]
                out -= rate * hidden.T @ delta / len(window)
                bias -= rate * delta.mean(0)

            some = np.flatnonzero(size)
            clean, guilty = some[label[some] == 0], some[label[some] == 1]
            for epoch in range(EPOCHS):
                number = embed @ (out[:, 1] - out[:, 0]) if epoch else odds
                score = np.bincount(word, number[gram], len(kinds)) / grams
                window = window_sums(score[sequence], stop, span)

                def top(k, part=0, parts=1):
                    low, high = begins[k] + size[k] * part // parts, begins[k] + size[k] * (part + 1) // parts
                    return low + int(np.argmax(window[low:high])) if high > low else int(begins[k])

                positive = np.array([top(k) for k in guilty], np.int64)
                if epoch >= EPOCHS // 3:
                    positive = positive[np.argsort(window[positive], kind="stable")[int(DOUBTED * len(positive)) :]]
                hard = np.array([top(k, part, 3) for k in clean for part in range(3)], np.int64)
                easy = (begins[clean][:, None] + rng.integers(0, size[clean][:, None], (len(clean), 4))).reshape(-1)
                windows = np.concatenate([np.repeat(positive, 3), hard, easy])
                target = np.append(np.ones(3 * len(positive)), np.zeros(len(hard) + len(easy)))
                shuffled = rng.permutation(len(windows))
                for at in range(0, len(windows), 512):
                    step(windows[shuffled[at : at + 512]], target[shuffled[at : at + 512]], RATE / (1 + epoch))
            return embed @ (out[:, 1] - out[:, 0])

        self.number = np.stack([head(span) for span in SPANS])
        check = np.flatnonzero(apart) if len(train) < len(texts) else train
        x, y = text_scores(*buffers(pa.array([texts[k] or "" for k in check], pa.string())), self.number), toxic[check]
        w = np.where(y == 1, self.prior / max(1, (y == 1).sum()), (1 - self.prior) / max(1, (y == 0).sum()))  # classes as in the labels, not as sampled
        middle, wide = x.mean(0), x.std(0) + 1e-9
        z, a, b = (x - middle) / wide, np.ones(x.shape[1]), 0.0
        for _ in range(3_000):
            p = 1 / (1 + np.exp(-np.clip(z @ a + b, -30, 30)))
            a, b = np.maximum(0.0, a - 0.5 * (z * (w * (p - y))[:, None]).sum(0) - 1e-4 * a), b - 0.5 * (w * (p - y)).sum()
        self.scale, self.shift = a / wide, float(b - (a * middle / wide).sum())
        self.none = float(z.min(0) @ a + b)  # no word: as the least toxic text

    def probability(self, data, offsets) -> np.ndarray:
        x = text_scores(data, offsets, self.number)
        logit = np.where(x[:, 0] == FLOOR, self.none, x @ self.scale + self.shift)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _held_out(id_col):
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> Model:
    """A model from labelled rows that are not held out."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~_held_out(F.col(id_col))).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("toxic"))
    some = marks.groupBy("toxic").count().collect()  # one row per class
    drawn = []
    for r in some:
        most = TOXIC if r["toxic"] == 1 else CLEAN
        part = min(1.0, 1.3 * most / r["count"])
        drawn.append(marks.filter((F.col("toxic") == r["toxic"]) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000)).orderBy(F.xxhash64("doc_id")).limit(int(1.3 * most) + 1))
    if not drawn:
        return Model([], np.zeros(0, int))
    chosen = F.broadcast(functools.reduce(DataFrame.unionByName, drawn))  # at most 1.3 * (TOXIC + CLEAN) rows of two numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") <= LONGEST)
    found = rows.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(int(1.3 * (TOXIC + CLEAN)) + 2).collect()
    texts, toxic = [], []
    for r in some:
        own = [x["text"] for x in found if x["toxic"] == r["toxic"]][: TOXIC if r["toxic"] == 1 else CLEAN]
        texts += own
        toxic += [int(r["toxic"] == 1)] * len(own)
    share = sum(r["count"] for r in some if r["toxic"] == 1) / max(1, sum(r["count"] for r in some))
    return Model(texts, np.array(toxic, int), prior=min(max(share, 0.01), 0.99))


def _score(model: Model):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.probability(*buffers(b.column("text"))))], ["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), _held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_score(model), f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))
