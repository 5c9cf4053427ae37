r"""Quality rules: a ledger of rule bits. Every rule is evaluated once; policies are applied to the bits.

``measure`` computes the measurements, ``ledger`` stores them with one bit for each failed rule,
``apply_policy`` reads a versioned policy (a mask of the rules that reject) and ``ablations`` tells from
the counts of each distinct bit set what every rule rejects alone. Nothing but DataFrame functions; a
map without a shuffle, but for the ablations, which group by the bits (at most 2^rules groups,
combined before the shuffle).

Words are ``[^\x20\x09-\x0D]+``; windows of three words are compared by their 64-bit hashes.

Defined results: null or empty text has no words, all counts 0 and fails ``few_words``; ratios over zero
words are 0; repeated rows each get a row; an empty table gives no rows; other columns are kept by
``ledger`` unless their names clash with its own, which replace them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import WORD, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words")
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: What makes a word count as one with letters.
LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"


@dataclass(frozen=True)
class Rule:
    """``fails`` is an expression over the measures; bit ``1 << position`` is set where it holds."""

    name: str
    fails: str


#: The rules, in bit order; integer arithmetic only, so that every engine agrees.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "2 * word_chars < 5 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("dup_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule("no_letters", "10 * n_alpha_words < 6 * n_words"),
)
BASE = ("few_words", "repeats")
#: Policies by version: the names of the rules that reject.
POLICIES = {1: BASE, 2: tuple(r.name for r in RULES)}
CURRENT = 2


def bit(name: str) -> int:
    return 1 << [r.name for r in RULES].index(name)


def mask(names) -> int:
    return sum({bit(n) for n in names})


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures. Lambdas refer to nothing outside themselves: linear in the words of a text."""
    own = "__mw_text"
    df = df.drop(*MEASURES).withColumn(own, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("__mw_w", F.regexp_extract_all(own, F.lit(f"({WORD})"), F.lit(1)))
    df = df.withColumn("n_words", F.size("__mw_w").cast("long"))
    shift = lambda k: F.slice("__mw_w", k, F.greatest(F.col("n_words").cast("int") - 2, F.lit(0)))
    windows = F.when(F.col("n_words") > 2, F.arrays_zip(shift(1).alias("a"), shift(2).alias("b"), shift(3).alias("c")))
    # windows sorted by hash lie beside their equals
    df = df.withColumn("__mw_s", F.sort_array(F.transform(windows, lambda z, i: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("h"), i.alias("i")))))
    beside = lambda c: F.zip_with(
        F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    )
    same = F.filter(beside("__mw_s"), lambda p: p["x"]["h"] == p["y"]["h"])
    df = df.withColumn("__mw_r", F.sort_array(F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["x"]["i"], p["y"]["i"]))))))
    # a repeated window covers three words, less what the next one covers
    covered = F.aggregate(beside("__mw_r"), F.lit(0), lambda acc, p: acc + F.least(F.lit(3), p["y"] - p["x"])) + F.lit(3)
    df = df.withColumn("n_repeat_words", F.when(F.size("__mw_r") > 0, covered).otherwise(0).cast("long")).drop("__mw_s", "__mw_r")
    df = df.withColumn("__mw_l", F.filter(F.split(own, "\n"), lambda x: x.rlike(WORD)))
    kept = F.translate(own, SYMBOLS, "")
    return df.withColumns(
        {
            "word_chars": F.length(F.regexp_replace(own, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": (F.length(own) - F.length(kept)).cast("long"),
            "n_dup_lines": (F.size("__mw_l") - F.size(F.array_distinct("__mw_l"))).cast("long"),
            "n_lines": F.size("__mw_l").cast("long"),
            "n_alpha_words": F.size(F.filter("__mw_w", lambda x: x.rlike(LETTER))).cast("long"),
        }
    ).drop(own, "__mw_w", "__mw_l")


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with its measures and ``fail_bits``."""
    bits: Column = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(df.drop("fail_bits"), text_col).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """Add ``base_failed`` and ``kept`` from the stored bits; the texts are not read again."""
    hit = lambda names: F.col("fail_bits").bitwiseAND(F.lit(mask(names)).cast("long")) != 0
    return book.withColumns({"base_failed": hit(BASE), "kept": ~hit({*BASE, *POLICIES[version]})})


def ablations(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy without it keeps."""
    policy = mask({*BASE, *POLICIES[version]})
    counts = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(bit(r.name)).cast("long").alias("bit")) for r in RULES if bit(r.name) & policy])
    each = counts.select("n", "bits", F.inline(rules))
    without = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total(without == 0).alias("n_kept_without"),
        F.sum("n").cast("long").alias("n_documents"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the current policy rejects go.

    The bits pass a generator of one row each, through which the optimizer moves no filter on them: else it
    would put the rules' whole expressions into the filter, and evaluate every measure for each use.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__mw_doc"), F.col("text").alias("__mw_rules"))
    book = ledger(rows, "__mw_rules").select("__mw_doc", F.explode(F.array("fail_bits")).alias("__mw_bits"))
    return book.where(F.col("__mw_bits").bitwiseAND(F.lit(mask({*BASE, *POLICIES[CURRENT]})).cast("long")) == 0).select("__mw_doc.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return book.select("doc_id", *MEASURES[:5], "base_failed", "kept", "fail_bits", *MEASURES[5:])


def _measured_sql(source: str) -> str:
    w = WORD
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM (SELECT *, coalesce(text, '') AS t_ FROM {source})),
w AS (SELECT *, regexp_extract_all(t_, '{w}') AS ws, [x FOR x IN string_split(t_, chr(10)) IF regexp_matches(x, '{w}')] AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY r),
m AS (SELECT w.* EXCLUDE (ws, ls, r, t_), len(ws)::BIGINT AS n_words,
  length(regexp_replace(t_, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t_) - length(translate(t_, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
  len([x FOR x IN ws IF regexp_matches(x, '{LETTER}')])::BIGINT AS n_alpha_words
  FROM w LEFT JOIN cov ON cov.r = w.r),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULES))})::BIGINT AS fail_bits FROM m)"""


OP7_SQL = f"""{_measured_sql("(SELECT doc_id, text FROM documents)")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask(BASE)}) <> 0 AS base_failed,
  (fail_bits & {mask({*BASE, *POLICIES[CURRENT]})}) = 0 AS kept, fail_bits, n_lines, n_alpha_words FROM b
"""
