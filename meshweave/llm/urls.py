r"""URL filters: prefix rules as intervals of reversed-host keys, joined to URLs by a sorted sweep.

A rule (host, path, verdict) fits the host, all its subdomains, and every path that starts with its path.
Each host suffix of a URL makes one probe with the key ``reversed suffix + # + path`` (``com.example#`` then
``/en/x``); a rule's key is made alike, and the keys that start with a rule's key form an interval.
Such intervals are nested or disjoint, and as no host holds the end mark, only rules of one host nest. Keys are dealt to range blocks, rules also to every block that
their interval meets; a sweep in key order keeps the stack of the rule that started last and of the
rules around it, and a probe takes the longest rule of the stack that its key starts with. Blocks are
cut at (key, salt), so that a key that many probes share fills several blocks.

DataFrame functions only; the driver sees one key a block. URLs are judged once each, before a join
back to the rows; rules are never broadcast and never collected.

Defined results: null URLs and URLs without ``://`` have an empty host and path, and only a rule with an
empty host can fit them; of fitting rules the longest (host and path) wins, then the longer host, and
``block`` wins among equal rules; without a rule the default verdict holds and rule is null; repeated
rows each get a row; an empty table gives no rows, an empty rule table the default for all; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.dealing import count_at_most
from .text import lower_ascii, table

#: The rules of op4, as (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Blocks for each shuffle partition.
BLOCKS_PER_PARTITION = 4
#: Ends the host in a key: sorts before the dot, and hosts of URLs end before it.
END = "#"


def _reversed(host):
    return F.reverse(F.split(host, r"\."))


def split_url(df: DataFrame, url: str) -> DataFrame:
    whole = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns({"host": lower_ascii(F.regexp_extract(whole, HOST, 1)), "path": F.regexp_extract(whole, PATH, 1)})


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule key the rules that its key starts with, itself last.

    The rules around a rule have its host and a prefix of its path: an equi-join of rules with prefixes.
    """
    r = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.where(~F.col("host").rlike("[/?#]"))  # fits no URL
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    r = r.withColumn("key", F.concat(F.array_join(_reversed(F.col("host")), "."), F.lit(END), "path"))
    prefixes = r.select("key", "host", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"), "path")
    prefixes = prefixes.select("key", "host", F.expr("left(path, n)").alias("path"))
    around = r.select("host", "path", F.struct(F.length("key").alias("n"), F.col("key").alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("h")).alias("one"))
    return prefixes.join(around, ["host", "path"]).groupBy("key").agg(F.sort_array(F.collect_list("one")).alias("stack"))


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path) to (url, host, path, best): the winning rule of each distinct URL, null if none fits."""
    spark = urls.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = urls.withColumn("labels", _reversed(F.col("host")))
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.array_join(F.slice("labels", F.lit(1), n), ".")))
    probes = labels.select("url", suffix.alias("suffix"), "path").select("url", F.concat("suffix", F.lit(END), "path").alias("key"))
    probes = probes.withColumn("salt", F.xxhash64("url"))
    point = F.struct("key", "salt")
    dealt = probes.select("key", "salt").repartitionByRange(parts * BLOCKS_PER_PARTITION, "key", "salt")
    firsts = [x["p"] for x in dealt.groupBy(F.spark_partition_id().alias("b")).agg(F.min(point).alias("p")).collect()]
    cuts = sorted((x["key"].encode(), x["salt"]) for x in firsts)[1:]
    cuts = [(k.decode(), s) for k, s in cuts]
    kind, keys = "struct<key:string,salt:bigint>", [k for k, _ in cuts]
    pairs = [F.struct(F.lit(k).alias("key"), F.lit(s).cast("bigint").alias("salt")) for k, s in cuts]
    probes = probes.withColumn("block", count_at_most(pairs, point, kind) if cuts else F.lit(0))
    stacks = rule_stacks(rules)
    # a rule is needed from the block before the first cut above its key up to the last cut that is not beyond its interval
    low = count_at_most(keys, F.col("key"), "string", lambda c, v: c < v)
    high = count_at_most(keys, F.col("key"), "string", lambda c, v: F.left(c, F.length(v)) <= v)
    stacks = stacks.withColumn("block", F.explode(F.sequence(low, high)))
    both = probes.select("block", "key", F.lit(1).alias("kind"), "url", F.lit(None).cast(dict(stacks.dtypes)["stack"]).alias("stack")).unionByName(
        stacks.select("block", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), "stack")
    )
    sweep = W.partitionBy("block").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = both.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = swept.select("url", F.expr("try_element_at(filter(open, r -> startswith(key, r.key)), -1)").alias("r"))
    rank = F.struct(F.length("r.rule").alias("n"), F.col("r.h").alias("h"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    return fits.where("r is not null").groupBy("url").agg(F.max(rank).alias("best"))


def judge(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """Host, path, winning rule and verdict for each row."""
    rows = split_url(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")), "url")
    best = best_rules(rows.select("url", "host", "path").distinct(), rules)
    out = rows.join(best, "url", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    names = ("host", "path", "verdict")
    rows = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, r)]) for r in rules])
    return spark.range(1).select(F.inline(rows))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


OP4_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '{HOST}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM pages),
rules(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
f AS (SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM u LEFT JOIN f ON f.r = u.r AND k = 1
"""
