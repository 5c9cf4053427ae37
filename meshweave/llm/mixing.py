r"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1 over all tokens of the mix. Source s has a weight schedule
``share_s(t) = target_s / total * (1 + tilt_s * (2 t - 1))``: early sources have a negative tilt, late ones a
positive one; the tilts are centred by target, so that the shares add up to 1 at every time. Integrated, the
schedule is the source's cumulative demand ``F_s(t) = t + tilt_s (t^2 - t)`` as a part of its target. A
source's documents, in hashed order and pass after pass up to three passes, supply its tokens; a copy whose
middle token lies within the target is taken, and inverting the demand at that token gives its training
position. Copies are then range-sorted by position.

The running sum is made without a task for a whole source: documents fall into hash buckets of a bounded
mean size, one narrow row a (source, bucket) is summed over the buckets, and each bucket adds its offset.
Sources are ranked and given their targets by aggregates over them, so the driver holds a few numbers, however
many sources there are.

Defined results: null text has size 0; a document of size 0 is never taken; sources are ordered by code
point, null last; of a source that is all empty nothing is taken; rows with equal ids are separate
documents; an empty table gives no rows; other columns are kept by ``mix`` and ignored by
``assign``. Reruns agree, as the order depends on a hash of id and size alone, which also deals out null ids and ids of many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import discard, materialize
from .text import WORD, count_words, table

#: Weights by the source's place, repeating.
WEIGHTS = (1, 2, 3)
#: Most copies of a document, and so the ratio at which a source's target stops.
PASSES = 3
#: Mean documents of a source in a bucket.
BUCKET_ROWS = 2_000
#: Largest tilt; 1 would start or end a source's share at zero.
MOST_TILT = 0.5


def _ranked(sums: DataFrame) -> DataFrame:
    """The written sources with ``sid``, their place by code point, null last: counted within ranges, so that no task has all."""
    key = F.asc_nulls_last("source")
    cut = materialize(sums.repartitionByRange(key).withColumn("p", F.spark_partition_id()), "sources")
    # one narrow row a range
    before = F.coalesce(F.sum("c").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = cut.groupBy("p").agg(F.count(F.lit(1)).alias("c")).select("p", before.alias("ahead"))
    place = F.row_number().over(W.partitionBy("p").orderBy(key)) - 1
    out = materialize(cut.withColumn("sid", place).join(ahead, "p").withColumn("sid", (F.col("sid") + F.col("ahead")).cast("long")).drop("p", "ahead"), "ranked")
    discard(cut)
    return out


def _level(sources: DataFrame) -> float:
    """What a weight of 1 gets: the level at which the targets min(weight * level, PASSES * size) add up to all sizes.

    Newton's method on a concave, piecewise linear function: each round is one aggregate over the sources, the level
    only rises, and the round that stops no further source ends it, with the exact value.
    """
    most = F.col("source_size") * PASSES
    level, stopped = 0.0, -1
    while True:
        over = most / F.col("weight") < F.lit(level)
        got = sources.agg(F.sum("source_size"), F.sum(F.when(over, most).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count(F.when(over, 1))).first()
        if not got[0] or got[3] == stopped or not got[2]:
            return level
        level, stopped = (got[0] - got[1]) / got[2], got[3]


def source_plan(docs: DataFrame) -> DataFrame:
    """One row a source: place, size, target, tilt, buckets. Tilts go from early to late in source order, centred by target."""
    sums = docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = _ranked(sums).withColumn("weight", F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS)).cast("int")))
    level = _level(ranked)
    plan = ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), (F.col("source_size") * PASSES).cast("double")))
    ends = plan.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    raw = F.col("sid") * (2.0 / max(1, ends[0] - 1)) - 1
    mean = 0.0
    if ends[1]:
        # decimals add up to the same in any order
        mean = float(plan.agg(F.sum((raw * F.col("target")).cast("decimal(38,6)"))).first()[0]) / ends[1]
    tilt = (raw - mean) * (MOST_TILT / 2) if ends[0] > 1 and ends[1] else F.lit(0.0)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).cast("long")
    return plan.select("sid", "source", "source_size", "target", tilt.alias("tilt"), buckets.alias("buckets"))


def assign(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Add source_size, target, ``positions`` (of the copies taken, ascending by pass) and taken to (doc_id, source, size, ...).

    ``docs`` is read three times: for the totals a source, for those a bucket, and for the assignment.
    """
    plan = source_plan(docs)
    same = docs["source"].eqNullSafe(plan["source"])
    d = docs.join(plan, same, "left").drop(plan["source"])
    # the bucket is the leading part of the order, so that the buckets' order is the documents' order
    d = d.withColumn("ord", F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("size").cast("string")), 256), 1, 15), 16, 10).cast("long"))
    d = d.withColumn("bucket", F.floor(F.col("ord").cast("double") / F.lit(2.0**60) * F.col("buckets")).cast("long"))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.join(sums.select("sid", "bucket", before.alias("offset")), ["sid", "bucket"])
    w = W.partitionBy("sid", "bucket").orderBy("ord", F.asc_nulls_first("doc_id"), "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    middle = [(F.lit(float(p)) * F.col("source_size") + F.col("start") + F.col("size") / 2.0) for p in range(PASSES)]
    f = [m / F.col("target") for m in middle]
    a = F.col("tilt")
    position = [2 * x / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * x)) for x in f]
    taken = [F.when((F.col("size") > 0) & (m <= F.col("target")), p) for m, p in zip(middle, position)]
    d = d.withColumn("positions", F.filter(F.array(*taken), lambda x: x.isNotNull()))
    d = d.withColumn("taken", F.col("size") * F.size("positions"))
    return d.drop("sid", "tilt", "buckets", "ord", "bucket", "offset", "start")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed stream: a row for each copy taken, with all columns of ``docs``, range-sorted by position."""
    columns = docs.columns
    own = docs.select(F.struct(*columns).alias("row"), "doc_id", "source", count_words(F.col("text")).alias("size"))
    copies = assign(own, seed).select("row", "doc_id", F.posexplode("positions").alias("pass", "position"))
    return copies.select("row.*", F.struct("position", "doc_id", "pass").alias("__mw_at")).repartitionByRange("__mw_at").sortWithinPartitions("__mw_at").drop("__mw_at")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix of what is left, in training order; columns as they were."""
    return mix(docs).select(*docs.columns)


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written, as it is read three times: the texts are counted once
    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("size")), "sized")
    out = assign(docs)
    at = F.get("positions", F.lit(0))
    out = out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", at.alias("at"))
    return out.repartitionByRange(F.asc_nulls_last("at"), "doc_id").sortWithinPartitions(F.asc_nulls_last("at"), "doc_id").drop("at")


def _w(x: str) -> str:
    return f"(1 + ({x} % {len(WEIGHTS)}))"


#: Targets by water-filling in closed form: sources by size for their weight; the capped ones come first.
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    ('0x' || left(sha256(CASE WHEN doc_id IS NULL THEN '0:' || size ELSE '0:' || doc_id || ':' || size END), 15))::BIGINT AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
o AS (SELECT *, {_w("i")} AS wt, {PASSES} * source_size / {_w("i")} AS room, (SELECT sum(source_size) FROM s) AS total FROM s),
c AS (SELECT *, coalesce(sum({PASSES} * source_size) OVER (ORDER BY room, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(wt) OVER (ORDER BY room, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
l AS (SELECT *, coalesce((SELECT (total - used) / open FROM c WHERE (total - used) / open <= room ORDER BY room, i LIMIT 1), max(room) OVER ()) AS level FROM c),
t AS (SELECT source, source_size, least(wt * level, {PASSES} * source_size)::DOUBLE AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * ({" + ".join(f"(CASE WHEN size > 0 AND {float(k)} * source_size + start + size / 2.0 <= target THEN 1 ELSE 0 END)" for k in range(PASSES))}))::BIGINT AS taken FROM p
"""
