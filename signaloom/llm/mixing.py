"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, offered at most `repeats` times. The virtual finish time of an entry is the number of words of its source up to its end, divided by the
source's weight. Entries of all sources are sorted by virtual finish time, and the schedule is cut at the total budget: what finishes before is taken, and the entry at the cut in part. A source that
runs out leaves its share to the others, so each is served its target (its share by weight, at most `repeats` times its size, the excess reshared) up to one document.

Plan. Shuffled order is the order of an MD5 of seed, id and text digest, whose leading hexadecimal digits deal each source into 4096 buckets; so documents with null or repeated ids spread as others do.
Bucket sums (partial aggregation) are accumulated per source over at most 4096 rows; the words before a document are those of earlier buckets plus a running sum inside its own bucket. The global
sort is by ranges: sums of SLOTS equal ranges of virtual time (partial aggregation, at most SLOTS rows) tell which range the budget ends in, and only the entries of that range, about one in SLOTS, are
sorted. The cut is one row. No task ever holds a source, and texts do not travel. No Python runs.

Defined results. Null text: size 0. Size 0: taken 0. Null source: a source of its own, last in order. Null or repeated ids: ordered by text digest, then by size; rows that are equal
are interchangeable. Source of size 0: target 0. Empty table: no rows. Other columns, of any name, are ignored or carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few, numbered, renamed, scratch, word_count

WEIGHTS, SHARE, REPEATS, SEED, SLOTS = (5, 2, 1), 1.5, 2, "mix-1", 1 << 16


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """no_source, src, total -> the same, weight and target. Sources by code point weigh as `weights` says, repeating; a target stops at repeats * total, the excess goes to the rest by weight.

    In the order of cap / weight, source j stops at its cap when the level (budget less the caps before it) / (weights from it on) is above its own cap / weight.
    """
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sources.withColumn("place", F.row_number().over(W.orderBy("no_source", "src")))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("total") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = W.orderBy("ratio", "place")
    ranked = ranked.withColumn("budget", F.sum("total").over(every) * share)
    ranked = ranked.withColumn("capped", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    ranked = ranked.withColumn("final", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    target = F.when(F.col("level") > F.col("ratio"), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    return ranked.select("no_source", "src", "total", "weight", target.alias("target"))


def _queued(docs: DataFrame, weights, share, repeats, seed, id_col, text_col, source_col, carry) -> DataFrame:
    """doc_id, size, total, target, weight, end (words of the source up to the document's end) and `carry` of every document, written to the shared folder."""
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        word_count(F.col(text_col)).alias("size"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), digest)).alias("order"),
        *carry,
    )
    rows = scratch(rows.withColumn("bucket", F.substring("order", 1, 3)), "mix-rows")
    queue = ["no_source", "src"]
    sums = rows.groupBy(*queue, "bucket").agg(F.sum("size").alias("words"))
    before = sums.withColumn("before", F.sum("words").over(W.partitionBy(*queue).orderBy("bucket")) - F.col("words"))
    levels = targets(sums.groupBy(*queue).agg(F.sum("words").alias("total")), weights, share, repeats)
    buckets = scratch(before.join(levels, queue).select(*queue, "bucket", "before", "total", "target", "weight"), "mix-buckets")
    inside = W.partitionBy(*queue, "bucket").orderBy("order", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.join(buckets, [*queue, "bucket"]).withColumn("end", F.col("before") + F.sum("size").over(inside))
    return scratch(placed.drop("bucket", "before", "order"), "mix-queued")


def _cut(queued: DataFrame, share: float, repeats: int):
    """The entry that the budget ends in: finish, no_source, src, and the words of it that are taken; None where there is nothing to take."""
    entries = queued.filter("size > 0").select("size", "no_source", "src", F.explode(F.array(*[(F.col("end") + turn * F.col("total")) / F.col("weight") for turn in range(repeats)])).alias("finish"))
    words, last = queued.agg(F.floor(F.sum("size") * share), F.max((F.col("end") + (repeats - 1) * F.col("total")) / F.col("weight"))).first()
    if not words:
        return None
    slot = F.least(F.floor(F.col("finish") / last * SLOTS), F.lit(SLOTS - 1))
    sums = entries.groupBy(slot.alias("slot")).agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(W.orderBy("slot")))  # at most SLOTS rows
    there = sums.filter(F.col("upto") >= words).orderBy("slot").limit(1).first()
    if there is None:  # the budget is more than everything there is
        return last, True, None, 0
    line = W.orderBy("finish", "no_source", "src").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = entries.filter(slot == there["slot"]).withColumn("upto", F.sum("size").over(line) + (there["upto"] - there["words"]))
    r = near.filter(F.col("upto") >= words).orderBy("upto").limit(1).first()
    return r["finish"], r["no_source"], r["src"], r["size"] - (r["upto"] - words)


def _taken(cut, repeats: int) -> F.Column:
    """Words of a document that the schedule has before its cut."""
    taken = F.lit(0).cast("long")
    if cut is None:
        return taken
    finish, no_source, src, part = cut
    for turn in range(repeats):
        own = (F.col("end") + turn * F.col("total")) / F.col("weight")
        if src is None:
            taken = taken + F.col("size")
            continue
        here = (own == finish) & (F.col("size") > 0)
        at, sooner = here & (F.col("no_source") == no_source) & (F.col("src") == src), F.struct("no_source", "src") < F.struct(F.lit(no_source).alias("no_source"), F.lit(src).alias("src"))
        taken = taken + F.when(own < finish, F.col("size")).when(at, F.lit(part)).when(here & sooner, F.col("size")).otherwise(F.lit(0))
    return taken.cast("long")


def weighted_fair_mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS, seed=SEED, id_col="doc_id", text_col="text", source_col="source", carry=()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, finish (its first virtual finish time) and the columns of `carry`, whose names must not clash with these."""
    queued = _queued(docs, weights, share, repeats, seed, id_col, text_col, source_col, [F.col(f"`{c}`") for c in carry])
    taken = _taken(_cut(queued, share, repeats), repeats)
    return queued.select("doc_id", "size", F.col("total").alias("source_size"), "target", taken.alias("taken"), (F.col("end") / F.col("weight")).alias("finish"), *[F.col(f"`{c}`") for c in carry])


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it was taken, the part taken of a document in service rounded to none or the whole."""
    held, name = renamed(docs)
    rows = numbered(held, "mix-docs")
    chosen = weighted_fair_mix(rows, id_col=name[id_col], text_col=name[text_col], source_col=name[source_col], carry=["rid"], **options).filter("taken > 0")
    chosen = chosen.select("rid", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies")).filter("copies > 0")
    whole = rows.join(few(scratch(chosen, "mix-chosen")), "rid").withColumn("turn", F.explode(F.sequence(F.lit(1), "copies")))
    return whole.select(*held.columns).toDF(*docs.columns)


ORACLE_SQL = r"""
with d as (select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, source is null as no_source, coalesce(source, '') as src,
           md5('mix-1:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as ord from documents),
s as (select no_source, src, cast(sum(size) as bigint) as total from d group by all),
p as (select *, row_number() over (order by no_source, src) as place from s),
w as (select *, case (place - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, total * 2.0::double as cap from p),
l as (select *, cap / weight as ratio, cast(sum(total) over () as double) * 1.5::double as budget,
      coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0.0::double) as capped,
      sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0.0::double) as free from w),
v as (select *, (budget - capped) / free as level from l),
t as (select no_source, src, total, weight, case when level > ratio then cap else max(case when level <= ratio then level end) over () * weight end as target from v),
q as (select d.doc_id, d.size, d.no_source, d.src, t.total, t.target, t.weight, cast(sum(d.size) over (partition by d.no_source, d.src order by ord, d.size, d.doc_id rows unbounded preceding) as bigint) as fin
      from d join t on d.no_source = t.no_source and d.src = t.src),
e as (select *, (fin + turn * total) / weight as finish, row_number() over () as entry from q, (values (0), (1)) turns(turn)),
c as (select *, least(size, greatest(0, (select floor(sum(size) * 1.5::double) from q)
      - (sum(size) over (order by finish, no_source, src, size, entry rows unbounded preceding) - size))) as part from e)
select doc_id, any_value(size) as size, any_value(total) as source_size, any_value(target) as target, cast(sum(part) as bigint) as taken, min(finish) as finish
from c group by doc_id
"""
