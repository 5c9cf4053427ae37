"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only.

Levels, bottom up (all digests are SHA-256 in hex):

* piece: a run of up to 160 code points that ends after sentence punctuation; the digest of the piece,
  followed by its length as three hex digits;
* paragraph: one line of the text; the digest of its pieces' digests;
* section: successive paragraphs up to one whose digest starts with 0 or 1 (one in eight), so that an
  insertion moves no later boundary; the digest of its paragraphs' digests;
* root: the digest of the sections' digests. It determines the text, so equal roots mean equal texts.

Likeness of two trees: twice the code points in pieces that both have, over the code points in the
distinct pieces of each; 1 exactly if the roots are equal. Where trees differ, the first section whose
digest differs is reported, and the comparison of the section lists locates the edit.

Defined results: null text is the empty text (one empty paragraph, no piece); likeness of two empty
texts is 1 and of an empty and another text 0; repeated rows each get a row; rows with equal ids are
ordered by text; null ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.dealing import count_at_most
from .text import table

#: A piece; the pieces of a paragraph cover it.
PIECE = r"[^.!?|]{1,160}[.!?|]{0,16}[ \t]{0,16}|[.!?|]{1,160}"
#: First hex digits of the paragraph digests that end a section.
SECTION_ENDS = ("0", "1")
#: Blocks of neighbouring ids for each shuffle partition.
BLOCKS_PER_PARTITION = 4
#: Code points of a text that help to order rows with equal ids.
HEAD = 16


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add ``<prefix>root``, ``<prefix>sections``, ``<prefix>paragraphs`` and ``<prefix>keys`` (pieces as longs).

    No lambda refers to a column from outside, so that no array is computed again for each element.
    """
    pieces, paras, joined = f"{prefix}__pieces", f"{prefix}paragraphs", f"{prefix}__joined"
    df = df.withColumn(
        pieces,
        F.transform(
            F.split(F.col(text), "\n"),
            lambda p: F.transform(
                F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)),
                lambda s: F.concat(F.sha2(s, 256), F.lpad(F.hex(F.length(s)), 3, "0")),
            ),
        ),
    )
    df = df.withColumn(paras, F.transform(pieces, lambda x: F.sha2(F.concat(F.lit("P"), F.array_join(x, "")), 256)))
    df = df.withColumn(
        joined,
        F.array_join(F.transform(paras, lambda h: F.when(F.substring(h, 1, 1).isin(*SECTION_ENDS), F.concat(h, F.lit("\n"))).otherwise(h)), ""),
    )
    df = df.withColumn(f"{prefix}sections", F.transform(F.split(joined, "\n"), lambda s: F.sha2(F.concat(F.lit("S"), s), 256)))
    df = df.withColumn(f"{prefix}root", F.sha2(F.concat(F.lit("D"), F.array_join(f"{prefix}sections", "")), 256))
    key = lambda x: F.conv(F.concat(F.substring(x, 1, 12), F.substring(x, 65, 3)), 16, 10).cast("long")
    return df.withColumn(f"{prefix}keys", F.array_distinct(F.transform(F.flatten(pieces), key))).drop(pieces, joined)


def _weight(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, x: acc + x.bitwiseAND(F.lit(4095).cast("long")))


def likeness(a: str, b: str) -> Column:
    """Likeness of the trees with prefixes ``a`` and ``b``."""
    both, total = _weight(F.array_intersect(f"{a}keys", f"{b}keys")), _weight(F.col(f"{a}keys")) + _weight(F.col(f"{b}keys"))
    dice = F.when(total > 0, 2.0 * both / total).otherwise(F.lit(0.0))
    return F.when(F.col(f"{a}root") == F.col(f"{b}root"), F.lit(1.0)).otherwise(F.least(dice, F.lit(0.999999)))


def first_change(a: str, b: str, level: str) -> Column:
    """1-based place of the first differing branch at ``level`` (sections or paragraphs), 0 if there is none."""
    return F.array_position(F.zip_with(f"{a}{level}", f"{b}{level}", lambda x, y: ~x.eqNullSafe(y)), True)


def fingerprint(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: id, fingerprint (root), section and paragraph digests. A map without a shuffle."""
    own = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tree = with_tree(own, "text", "t_")
    return tree.select(F.col("id").alias(id_col), F.col("t_root").alias("fingerprint"), F.col("t_sections").alias("sections"), F.col("t_paragraphs").alias("paragraphs"))


def with_next(df: DataFrame, more=lambda d: d, carry: tuple[str, ...] = ("text",)) -> DataFrame:
    """Add ``next_<c>`` for each ``carry`` column, of the row that follows by (id, text); after the last the first.

    Rows are cut into blocks by (id, first ``HEAD`` code points of the text), at the least of each part of a range sort of these
    keys alone (the driver gets one key a block). Whole rows travel once, to their block, and the rows that open a block also go to
    the block before it, as the followers of its last row. So neither null ids nor an id that many rows have fill one task,
    but for rows that begin alike too. ``more`` adds columns after the rows have travelled.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("key", F.struct("id", F.left("text", F.lit(HEAD)).alias("head")))
    keys = df.select("key.id", "key.head").repartitionByRange(parts * BLOCKS_PER_PARTITION, F.asc_nulls_first("id"), "head")
    found = keys.groupBy(F.spark_partition_id().alias("b")).agg(F.min(F.struct("id", "head")).alias("k")).collect()
    opened = sorted({(r["k"]["id"] is not None, r["k"]["id"] or 0, r["k"]["head"]) for r in found}, key=lambda x: (*x[:2], x[2].encode()))
    kind = "struct<id:bigint,head:string>"
    points = [F.struct(F.lit(i if known else None).cast("bigint").alias("id"), F.lit(head).alias("head")) for known, i, head in opened]
    cuts = points[1:]
    df = df.withColumn("block", count_at_most(cuts, F.col("key"), kind))
    same = lambda k: F.col("key.id").eqNullSafe(k["id"]) & (F.col("key.head") == k["head"])
    first = same(points[0]) if points else F.lit(False)
    opens = F.col("block") > 0
    if cuts:
        opens &= same(F.get(F.array(*cuts).cast(f"array<{kind}>"), F.col("block") - 1))
    to = F.filter(
        F.array(
            F.struct(F.col("block").alias("b"), F.lit(0).alias("guest")),
            F.when(opens, F.struct((F.col("block") - 1).alias("b"), F.lit(1).alias("guest"))),
            F.when(first, F.struct(F.lit(len(cuts)).alias("b"), F.lit(2).alias("guest"))),
        ),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("to", F.explode(to)).select("*", "to.b", "to.guest").drop("to", "block", "key")
    df = more(df.repartition(parts, "b"))
    w = W.partitionBy("b").orderBy("guest", F.asc_nulls_first("id"), "text")
    for c in carry:
        df = df.withColumn(f"next_{c}", F.lead(c).over(w))
    return df.where("guest = 0").drop("b", "guest")


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, its edited text and its successor, and tell how alike their trees are."""
    own = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = with_next(own, lambda x: with_tree(x, "text", "t_"), ("text", "t_root", "t_keys"))
    d = d.withColumn("n", F.length("text")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    d = d.withColumn("edited", F.expr("concat(substring(text, 1, n - half), substring(next_text, 1, half))")).drop("next_text", "text")
    d = with_tree(d, "edited", "e_").withColumnsRenamed({"next_t_root": "n_root", "next_t_keys": "n_keys"})
    return d.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("t_root").alias("fingerprint"),
        F.col("e_root").alias("edited_fingerprint"),
        likeness("t_", "e_").alias("near_edited"),
        likeness("t_", "n_").alias("near_next"),
        F.size("t_sections").cast("long").alias("n_sections"),
        F.size("t_paragraphs").cast("long").alias("n_paragraphs"),
        first_change("t_", "e_", "sections").cast("long").alias("first_changed_section"),
        first_change("t_", "e_", "paragraphs").cast("long").alias("first_changed_paragraph"),
    )


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))


_TREE = """
  SELECT *, [sha256('P' || array_to_string(p, '')) FOR p IN {p}pieces] AS {p}paragraphs FROM (
    SELECT *, [[sha256(s) || lpad(format('{{:X}}', length(s)), 3, '0') FOR s IN regexp_extract_all(q, '{piece}')]
               FOR q IN string_split({text}, chr(10))] AS {p}pieces FROM {src})"""
_TREE2 = """
  SELECT *, sha256('D' || array_to_string({p}sections, '')) AS {p}root,
    list_distinct([('0x' || x[1:12] || x[65:67])::BIGINT FOR x IN flatten({p}pieces)]) AS {p}keys FROM (
    SELECT *, [sha256('S' || s) FOR s IN string_split(array_to_string(
        [h || CASE WHEN h[1:1] IN ('0', '1') THEN chr(10) ELSE '' END FOR h IN {p}paragraphs], ''), chr(10))] AS {p}sections
    FROM {src})"""
_W = "coalesce(list_sum([k & 4095 FOR k IN {}]), 0)::DOUBLE"


def _near(a: str, b: str) -> str:
    total = f"({_W.format(a + 'keys')} + {_W.format(b + 'keys')})"
    return f"CASE WHEN {a}root = {b}root THEN 1.0::DOUBLE WHEN {total} = 0 THEN 0.0::DOUBLE ELSE least(2.0::DOUBLE * {_W.format(f'list_intersect({a}keys, {b}keys)')} / {total}, 0.999999::DOUBLE) END"


def _change(a: str, b: str, level: str) -> str:
    return f"coalesce(list_position([x[1] IS DISTINCT FROM x[2] FOR x IN list_zip({a}{level}, {b}{level})], true), 0)::BIGINT"


OP1_SQL = f"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t1 AS ({_TREE.format(p="t_", piece=PIECE, text="text", src="own")}),
t2 AS ({_TREE2.format(p="t_", src="t1")}),
nx AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
         coalesce(lead(t_root) OVER w, first_value(t_root) OVER w) AS n_root,
         coalesce(lead(t_keys) OVER w, first_value(t_keys) OVER w) AS n_keys
       FROM t2 WINDOW w AS (ORDER BY doc_id, text)),
ed AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM nx),
e1 AS ({_TREE.format(p="e_", piece=PIECE, text="edited", src="ed")}),
e2 AS ({_TREE2.format(p="e_", src="e1")})
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, t_root AS fingerprint, e_root AS edited_fingerprint,
  {_near("t_", "e_")} AS near_edited, {_near("t_", "n_")} AS near_next,
  len(t_sections)::BIGINT AS n_sections, len(t_paragraphs)::BIGINT AS n_paragraphs,
  {_change("t_", "e_", "sections")} AS first_changed_section, {_change("t_", "e_", "paragraphs")} AS first_changed_paragraph
FROM e2
"""
