"""Micro-states: fitting templates back to maps, variables of the fit, clustering and its criteria, clean-up of labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import maps as M
from . import markers as MK

TEMPLATES_MOST = 10_000


def correlations(maps: DataFrame, templates: DataFrame) -> DataFrame:
    """tf, k, corr, gfp: every map with every template (non-competitive fitting). Templates are a few dozen rows: their number is checked, then they travel as one literal row."""
    rows = templates.orderBy("k").limit(TEMPLATES_MOST + 1).collect()
    if len(rows) > TEMPLATES_MOST:
        raise ValueError(f"more than {TEMPLATES_MOST} templates")
    known = F.array(*[F.struct(F.lit(r["k"]).alias("k"), F.array(*[F.lit(float(x)) for x in r["t"]]).alias("t")) for r in rows])
    out = maps.withColumn("m", F.explode(known))
    return out.select(*[c for c in maps.columns if c != "v"], F.col("m.k").alias("k"), M.correlation(F.col("v"), F.col("m.t")).alias("corr"), M.gfp(F.col("v")).alias("gfp"))


def fitted(maps: DataFrame, templates: DataFrame, least: float | None = None) -> DataFrame:
    """The best template of each map, as `label` of `correlations` gives it (polarity ignored), found in the map's own row: no shuffle. Templates travel as one literal row, referenced and scaled to norm 1."""
    rows = templates.orderBy("k").limit(TEMPLATES_MOST + 1).collect()
    if len(rows) > TEMPLATES_MOST:
        raise ValueError(f"more than {TEMPLATES_MOST} templates")
    known = F.array(*[F.struct(F.lit(-r["k"]).alias("k"), F.array(*[F.lit(float(x)) for x in _unit(np.array([r["t"]], float))[0]]).alias("t")) for r in rows])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    out = maps.withColumn("_u", M.average_reference(F.col("v"))).withColumn("gfp", M.gfp(F.col("v")))
    out = out.withColumn("_n", F.nullif(F.sqrt(dot(F.col("_u"), F.col("_u"))), F.lit(0.0)))
    tried = F.transform(known, lambda m: F.struct((dot(F.col("_u"), m["t"]) / F.col("_n")).alias("corr"), m["k"].alias("k")))
    best = F.array_max(F.transform(tried, lambda m: F.struct(F.round(F.abs(m["corr"]), 9).alias("c"), m["k"].alias("k"), m["corr"].alias("corr"))))
    out = out.withColumn("_b", best)
    seg = -F.col("_b.k")
    kept = [c for c in maps.columns if c != "v"]
    return out.select(*kept, (F.when(F.col("_b.c") >= least, seg) if least is not None else seg).alias("seg"), F.col("_b.corr").alias("corr"), "gfp")


def label(fits: DataFrame, keys=("tf",), polarity: bool = False, least: float | None = None) -> DataFrame:
    """The best template of each map: keys, seg, corr, gfp; the smaller k on a tie; none (null) below the least correlation. One aggregation, no window."""
    c = F.round("corr" if polarity else F.abs("corr"), 9)
    best = F.max(F.struct(c.alias("c"), (-F.col("k")).alias("k"), "corr", "gfp")).alias("b")
    out = fits.groupBy(*keys).agg(best)
    seg = -F.col("b.k")
    return out.select(*keys, (F.when(F.col("b.c") >= least, seg) if least is not None else seg).alias("seg"), F.col("b.corr").alias("corr"), F.col("b.gfp").alias("gfp"))


def worksheet(labels: DataFrame, order: str = "tf") -> DataFrame:
    """The variables of a fit, one row per template."""
    t = F.col(order)
    all_rows = W.partitionBy()  # over one row per template
    first = lambda *c: F.max(F.struct(*c))
    out = labels.groupBy("seg").agg(
        F.min(t).alias("first_onset"), F.max(t).alias("last_offset"), F.count("*").alias("n_tf"), F.avg(F.abs("corr")).alias("mean_corr"), F.sum(F.pow(F.col("gfp") * F.col("corr"), 2)).alias("ev"),
        (F.sum(t * F.col("gfp")) / F.sum("gfp")).alias("tf_centroid"), first(F.round(F.abs("corr"), 9).alias("c"), (-t).alias("t"), "gfp").alias("bc"), first(F.round("gfp", 9).alias("g"), (-t).alias("t")).alias("bg"), F.avg("gfp").alias("mean_gfp"), F.sum(F.col("gfp") * F.col("gfp")).alias("power"),
    )
    out = out.withColumn("power", F.sum("power").over(all_rows)).withColumn("frames", F.sum("n_tf").over(all_rows)).filter("seg is not null")
    return out.select(
        "seg", "first_onset", "last_offset", "n_tf", "mean_corr", (F.col("ev") / F.col("power")).alias("gev"), "tf_centroid", F.col("bc.c").alias("best_corr"), (-F.col("bc.t")).alias("tf_best_corr"),
        F.col("bc.gfp").alias("gfp_best_corr"), F.col("bg.g").alias("max_gfp"), "mean_gfp", (-F.col("bg.t")).alias("tf_max_gfp"), (F.col("n_tf") / F.col("frames")).alias("coverage"),
    )


def segments(labels: DataFrame, by=("rec",), order: str = "tf") -> DataFrame:
    return MK.runs(labels, "seg", by, order)


def durations(labels: DataFrame, by=("rec",), order: str = "tf") -> DataFrame:
    """seg, segments, mean_duration, density (segments per frame)."""
    runs = segments(labels, by, order)
    n = runs.agg(F.sum("n").alias("frames"))
    return runs.groupBy("seg").agg(F.count("*").alias("segments"), F.avg("n").alias("mean_duration")).crossJoin(n).withColumn("density", F.col("segments") / F.col("frames")).drop("frames")


def markov(labels: DataFrame, ahead: int = 1, by=("rec",), order: str = "tf") -> DataFrame:
    """seg, next, n, p: transitions between segments, `ahead` segments on."""
    w = W.partitionBy(*by).orderBy("from_tf")
    moves = segments(labels, by, order).withColumn("next", F.lead("seg", ahead).over(w)).filter("next is not null and seg is not null")
    counts = moves.groupBy("seg", "next").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("seg")))


def sequentialise(labels: DataFrame, by=("rec",), order: str = "tf") -> DataFrame:
    """by, from_tf, to_tf, seg: segments numbered in time, so that a cluster that returns gets a new number."""
    runs = segments(labels, by, order)
    return runs.select(*by, "from_tf", "to_tf", F.row_number().over(W.partitionBy(*by).orderBy("from_tf")).alias("seq"), "seg")


def gfp_peaks(df: DataFrame, by=("rec",), order: str = "tf") -> DataFrame:
    w = W.partitionBy(*by).orderBy(order)
    return df.withColumn("_b", F.lag("gfp").over(w)).withColumn("_a", F.lead("gfp").over(w)).filter((F.col("gfp") > F.col("_b")) & (F.col("gfp") > F.col("_a"))).drop("_a", "_b")


# --- clustering: sequential algorithms, each trial in one Arrow group -------------------------------------------------------------------------------------------------------


def _unit(x):
    x = x - x.mean(1, keepdims=True)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _centre(x, polarity):
    """Mean of the members, or their first eigenvector when polarity is ignored; the largest component is positive then."""
    if polarity:
        c = x.mean(0)
    else:
        c = np.linalg.eigh(x.T @ x)[1][:, -1]
        c = c * np.sign(c[np.abs(c).argmax()])
    return c / max(np.linalg.norm(c), 1e-300)


def kmeans_trial(x: np.ndarray, k: int, seed: int, polarity: bool = False, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Modified k-means (Pascual-Marqui 1995) on maps as rows: labels, templates, explained variance."""
    u, rng = _unit(x), np.random.default_rng(seed)
    power = ((x - x.mean(1, keepdims=True)) ** 2).sum(1)
    templates, labels = u[rng.choice(len(u), k, replace=False)], np.full(len(u), -1)
    for _ in range(rounds):
        c = u @ templates.T
        new = (c if polarity else np.abs(c)).argmax(1)
        if (new == labels).all():
            break
        labels = new
        for j in range(k):
            if (labels == j).any():
                templates[j] = _centre(x[labels == j] - x[labels == j].mean(1, keepdims=True), polarity)
    c = (u * templates[labels]).sum(1)
    return labels, templates, float((power * c * c).sum() / power.sum())


def taahc(x: np.ndarray, least: int, most: int, polarity: bool = False) -> dict[int, np.ndarray]:
    """Topographic atomise and agglomerate hierarchical clustering (Murray 2008): labels for each k from most down to least."""
    u, out = _unit(x), {}
    members = {i: [i] for i in range(len(u))}
    centres = {i: u[i] for i in range(len(u))}
    while len(members) > least:
        keys = list(members)
        worst = min(keys, key=lambda k: (sum(abs(u[i] @ centres[k]) for i in members[k]), k))
        loose = members.pop(worst)
        centres.pop(worst)
        keys = list(members)
        stack = np.stack([centres[k] for k in keys])
        c = u[loose] @ stack.T
        for i, j in zip(loose, (c if polarity else np.abs(c)).argmax(1)):
            members[keys[j]].append(i)
        for j in set((c if polarity else np.abs(c)).argmax(1)):
            centres[keys[j]] = _centre(u[members[keys[j]]], polarity)
        if len(members) <= most:
            labels = np.empty(len(u), int)
            for n, k in enumerate(sorted(members, key=lambda k: min(members[k]))):
                labels[members[k]] = n
            out[len(members)] = labels
    return out


def cluster(maps: DataFrame, ks, trials: int, group: str = "label", polarity: bool = False) -> DataFrame:
    """group, k, tf, seg, gev of the best of the trials for each number of clusters. Work is spread over (group, k); a group's maps (GFP peaks) fit a task."""
    ks = [int(k) for k in ks]
    kind = dict(maps.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tf")
        k = min(int(pdf.k.iloc[0]), len(pdf))
        labels, _, gev = max((kmeans_trial(np.stack(pdf.v.to_numpy()), k, seed, polarity) for seed in range(trials)), key=lambda t: t[2])
        return pd.DataFrame({group: pdf[group].to_numpy(), "k": pdf.k.to_numpy(), "tf": pdf.tf.to_numpy(), "seg": labels, "gev": gev})

    spread = maps.select(group, "tf", "v").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return spread.groupBy(group, "k").applyInPandas(run, f"{group} {kind}, k int, tf long, seg int, gev double")


def cluster_taahc(maps: DataFrame, least: int, most: int, group: str = "label") -> DataFrame:
    kind = dict(maps.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tf")
        found = taahc(np.stack(pdf.v.to_numpy()), least, most)
        return pd.concat([pd.DataFrame({group: pdf[group].to_numpy(), "k": k, "tf": pdf.tf.to_numpy(), "seg": lab}) for k, lab in found.items()] or [pd.DataFrame(columns=[group, "k", "tf", "seg"])])

    return maps.select(group, "tf", "v").groupBy(group).applyInPandas(run, f"{group} {kind}, k int, tf long, seg int")


#: Distances of pairs that a task holds at once.
PAIRS = 1 << 22


def _pair_distances(u: np.ndarray):
    """Every pair of rows once, in pieces of at most PAIRS / 8 or a row: distances, first and second row."""
    step = max(1, PAIRS // 8 // max(1, len(u)))
    for at in range(0, len(u), step):
        d = 1 - np.abs(np.clip(u[at : at + step] @ u[at:].T, -1, 1))
        i, j = np.triu_indices(len(d), 1, d.shape[1])
        yield d[i, j], i + at, j + at


def _ranges(u: np.ndarray) -> list[tuple[float, float]]:
    """Ranges [low, high) that cover all distances, each of at most PAIRS pairs, but for a single value that more pairs share."""
    if len(u) * (len(u) - 1) // 2 <= PAIRS:
        return [(-np.inf, np.inf)]
    out, todo = [], [(0.0, np.nextafter(1.0, 2.0))]
    while todo:
        low, high = todo.pop()
        edges = np.unique(np.append(np.linspace(low, high, 4097)[:-1], high))
        n = np.zeros(len(edges) - 1, np.int64)
        for d, _, _ in _pair_distances(u):
            d = d[(d >= low) & (d < high)]
            n += np.bincount(np.searchsorted(edges, d, "right") - 1, minlength=len(n))[: len(n)]
        begin, held = 0, 0
        for k, x in enumerate([*n, PAIRS + 1]):
            if held and held + x > PAIRS:
                out.append((edges[begin], edges[k]))
                begin, held = k, 0
            if k < len(n) and x > PAIRS and np.nextafter(edges[k], 2) < edges[k + 1]:
                todo.append((edges[k], edges[k + 1]))
                begin, held = k + 1, 0
            else:
                held += x
                begin = k if not held else begin
    return sorted(out)


def _pair_criteria(u: np.ndarray, labels: list[np.ndarray]) -> list[tuple[float, float, float]]:
    """Gamma, point-biserial and robust Dunn of several labellings of the same maps, over all pairs, exactly: ranges of distances are sorted one after the other, so memory does not grow with the pairs."""
    total, tops = len(u) * (len(u) - 1) // 2, []
    count, sums = np.zeros((len(labels), 2), np.int64), np.zeros((len(labels), 2))
    mean = square = 0.0
    for d, i, j in _pair_distances(u):
        mean += d.sum() / max(1, total)
        for k, lab in enumerate(labels):
            same = lab[i] == lab[j]
            count[k] += (~same).sum(), same.sum()
            sums[k] += d[~same].sum(), d[same].sum()
    for d, _, _ in _pair_distances(u):
        square += ((d - mean) ** 2).sum() / max(1, total)
    # The order statistics next to a percentile, as numpy interpolates them: the 5th of pairs across clusters, the 95th of pairs inside one.
    at = [[(n - 1) * q for n, q in zip(c, (0.05, 0.95))] for c in count]
    held = [[{}, {}] for _ in labels]
    plus, minus, done = np.zeros(len(labels)), np.zeros(len(labels)), np.zeros((len(labels), 2), np.int64)
    for low, high in _ranges(u):
        parts = [[], [], []]
        for d, i, j in _pair_distances(u):
            near = (d >= low) & (d < high)
            for part, x in zip(parts, (d, i, j)):
                part.append(x[near].astype(np.float64 if x is d else np.int32))
        d, i, j = map(np.concatenate, parts)
        order = np.argsort(d)
        d, i, j = d[order], i[order], j[order]
        for k, lab in enumerate(labels):
            same = lab[i] == lab[j]
            outer, inner = d[~same], d[same]
            below = done[k, 0] + np.searchsorted(outer, inner, "left")
            above = count[k, 0] - done[k, 0] - np.searchsorted(outer, inner, "right")
            minus[k] += below.sum()
            plus[k] += above.sum()
            for side, x in enumerate((outer, inner)):
                for rank in {int(np.floor(at[k][side])), int(np.ceil(at[k][side]))}:
                    if 0 <= rank - done[k, side] < len(x):
                        held[k][side][rank] = x[rank - done[k, side]]
                done[k, side] += len(x)
    out = []
    for k in range(len(labels)):
        if not count[k].all():
            out.append((np.nan, np.nan, np.nan))
            continue
        fifth, last = (np.interp(p % 1, (0, 1), [held[k][s].get(int(r), np.nan) for r in (np.floor(p), np.ceil(p))]) for s, p in enumerate(at[k]))  # none among distances that are no numbers
        share, (across, inside) = count[k, 1] / total, sums[k] / count[k]
        out.append((float((plus[k] - minus[k]) / max(1, plus[k] + minus[k])), float((across - inside) * np.sqrt(share * (1 - share)) / max(np.sqrt(square), 1e-12)), float(fifth / max(last, 1e-12))))
    return out


def _mean_distances(u: np.ndarray, labels: list[np.ndarray]) -> list[np.ndarray]:
    """For each labelling: summed distances of every map to every cluster (clusters in the order of np.unique)."""
    ones = [(lab[:, None] == np.unique(lab)[None, :]).astype(float) for lab in labels]
    out, step = [[] for _ in labels], max(1, PAIRS // 8 // max(1, len(u)))
    for at in range(0, len(u), step):
        d = 1 - np.abs(np.clip(u[at : at + step] @ u.T, -1, 1))
        for found, one in zip(out, ones):
            found.append(d @ one)
    return [np.concatenate(found) for found in out]


def criteria(maps: DataFrame, clusters: DataFrame, group: str = "label") -> DataFrame:
    """group, k: gamma, silhouettes, davies_bouldin, point_biserial, dunn_robust, krzanowski_lai, mean (their median) and meta (mean of min-max scaled criteria). Distance: 1 - |correlation|.

    All pairs of a group's maps count. A task holds the group's maps and PAIRS distances at a time; its time grows with the square of the group, and with one more pass over the pairs for every PAIRS of them.
    """
    kind = dict(maps.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, spread, same_maps = [], {}, {}
        for k, p in pdf.groupby("k"):
            p = p.sort_values("tf", kind="stable")
            same_maps.setdefault(p.tf.to_numpy().tobytes(), []).append((k, p))
        for members in same_maps.values():
            u, labels = _unit(np.stack(members[0][1].v.to_numpy())), [p.seg.to_numpy() for _, p in members]
            n = u.shape[1]
            for (k, _), lab, sums, (gamma, pb, dunn) in zip(members, labels, _mean_distances(u, labels), _pair_criteria(u, labels)):
                ids, own, size = *np.unique(lab, return_inverse=True), np.bincount(np.unique(lab, return_inverse=True)[1])
                mine = sums[np.arange(len(u)), own]
                spread[k] = sum(mine[own == c].sum() / (2 * size[c]) for c in range(len(ids)))
                if len(ids) < 2 or size.max() < 2:
                    rows.append((k, *[np.nan] * 5))
                    continue
                a = mine / np.maximum(1, size[own] - 1)
                other = sums / size
                other[np.arange(len(u)), own] = np.inf
                b = other.min(1)
                silhouette = float(((b - a) / np.maximum(np.maximum(a, b), 1e-12)).mean())
                centre = {c: _centre(u[own == c], False) for c in range(len(ids))}
                s = {c: (1 - np.abs(u[own == c] @ centre[c])).mean() for c in centre}
                db = float(np.mean([max((s[c] + s[e]) / max(1e-12, 1 - abs(centre[c] @ centre[e])) for e in centre if e != c) for c in centre]))
                rows.append((k, gamma, silhouette, db, pb, dunn))
        out = pd.DataFrame(rows, columns=["k", "gamma", "silhouettes", "davies_bouldin", "point_biserial", "dunn_robust"]).sort_values("k")
        diff = {k: (k - 1) ** (2 / n) * spread[k - 1] - k ** (2 / n) * spread[k] for k in spread if k - 1 in spread}
        out["krzanowski_lai"] = [abs(diff[k] / diff[k + 1]) if k in diff and k + 1 in diff and diff[k + 1] else np.nan for k in out.k]
        six = out.iloc[:, 1:7].copy()
        six["davies_bouldin"] = -six["davies_bouldin"]
        scaled = (six - six.min()) / (six.max() - six.min()).replace(0, np.nan)
        out["mean_criterion"], out["meta_criterion"] = scaled.median(axis=1), scaled.mean(axis=1)
        return out.assign(**{group: pdf[group].iloc[0]})[[group, *out.columns[:9]]]

    names = ["gamma", "silhouettes", "davies_bouldin", "point_biserial", "dunn_robust", "krzanowski_lai", "mean_criterion", "meta_criterion"]
    joined = clusters.select(group, "k", "tf", "seg").join(maps.select(group, "tf", "v"), [group, "tf"])
    return joined.groupBy(group).applyInPandas(run, f"{group} {kind}, k int, " + ", ".join(f"{n} double" for n in names))


def smooth(labels: DataFrame, fits: DataFrame, half: int, strength: float, by=("rec",), rounds: int = 50) -> DataFrame:
    """Temporal smoothing (Pascual-Marqui 1995): a frame's label minimises its residual less strength times the share of equal labels within half frames; repeated to a fixed point."""
    wide = fits.groupBy(*by, "tf").agg(F.array_sort(F.collect_list(F.struct("k", "corr"))).alias("c")).join(labels.select(*by, "tf", "seg"), [*by, "tf"])
    kinds = dict(wide.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tf")
        ks = [p["k"] for p in pdf.c.iloc[0]]
        miss = 1 - np.array([[p["corr"] for p in row] for row in pdf.c]) ** 2
        lab = np.array([ks.index(s) if s in ks else 0 for s in pdf.seg])
        for _ in range(rounds):
            one = np.pad(np.eye(len(ks))[lab], ((half, half), (0, 0)))
            total = np.cumsum(np.vstack([np.zeros(len(ks)), one]), 0)
            near = total[2 * half + 1 :] - total[: -2 * half - 1]
            new = (miss / (2 * miss.mean() + 1e-12) - strength * near / (2 * half)).argmin(1)
            if (new == lab).all():
                break
            lab = new
        return pdf[[*by, "tf"]].assign(seg=[ks[j] for j in lab])

    return wide.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + f", tf long, seg {dict(labels.dtypes)['seg']}")


def reject_small(labels: DataFrame, most: int, by=("rec",)) -> DataFrame:
    """Segments of `most` frames or fewer are given to their neighbours, shortest first: the earlier half to the one before, the rest to the one after."""
    cols = labels.select(*by, "tf", "seg")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tf")
        lab = pdf.seg.to_numpy().copy()
        while True:
            cuts = np.flatnonzero(np.append(True, lab[1:] != lab[:-1]))
            size = np.diff(np.append(cuts, len(lab)))
            small = [(n, s) for n, s in zip(size, cuts) if n <= most]
            if not small or len(cuts) == 1:
                return pdf.assign(seg=lab)
            n, s = min(small)
            half = s + n if s + n == len(lab) else s if s == 0 else s + (n + 1) // 2
            if s > 0:
                lab[s:half] = lab[s - 1]
            if s + n < len(lab):
                lab[half : s + n] = lab[s + n]

    return cols.groupBy(*by).applyInPandas(run, cols.schema)


def merge_correlated(templates: DataFrame, least: float) -> DataFrame:
    """k, root: templates whose correlation reaches `least`, chained; a handful of rows, whose number is checked."""
    rows = templates.select("k", "t").orderBy("k").limit(TEMPLATES_MOST + 1).collect()
    if len(rows) > TEMPLATES_MOST:
        raise ValueError(f"more than {TEMPLATES_MOST} templates")
    u, ks = _unit(np.array([r["t"] for r in rows])), [r["k"] for r in rows]
    near, root = np.abs(u @ u.T) >= least, np.arange(len(ks))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(ks))])
        if (new == root).all():
            break
        root = new
    return templates.sparkSession.createDataFrame([(k, ks[r]) for k, r in zip(ks, root)], f"k {dict(templates.dtypes)['k']}, root {dict(templates.dtypes)['k']}")


def eigenvector(maps: DataFrame, group: str = "label") -> DataFrame:
    """group, v: the first eigenvector of a group's average-referenced maps, without regard to polarity. Cross products are summed by Spark; a matrix of electrodes goes to each task."""
    long = maps.select(group, "tf", F.posexplode(M.average_reference(F.col("v"))).alias("e", "x"))
    cross = long.join(long.select(group, "tf", F.col("e").alias("f"), F.col("x").alias("y")), [group, "tf"]).groupBy(group, "e", "f").agg(F.sum(F.col("x") * F.col("y")).alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.e.max()) + 1
        m = np.zeros((n, n))
        m[pdf.e, pdf.f] = pdf.c
        v = np.linalg.eigh(m)[1][:, -1]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "v": [v * np.sign(v[np.abs(v).argmax()])]})

    return cross.groupBy(group).applyInPandas(run, f"{group} {dict(maps.dtypes)[group]}, v array<double>")


def medoid(maps: DataFrame, group: str = "label") -> DataFrame:
    """group, tf: the map whose summed absolute correlation with its group is highest; the smaller tf on a tie. A group's maps fit a task."""
    cols = maps.select(group, "tf", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tf")
        u = _unit(np.stack(pdf.v.to_numpy()))
        total = np.concatenate([np.abs(u[at : at + 512] @ u.T).sum(1) for at in range(0, len(u), 512)])
        return pd.DataFrame({group: [pdf[group].iloc[0]], "tf": [pdf.tf.iloc[int(np.round(total, 9).argmax())]]})

    return cols.groupBy(group).applyInPandas(run, f"{group} {dict(maps.dtypes)[group]}, tf long")
