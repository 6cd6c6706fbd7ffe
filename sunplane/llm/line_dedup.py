"""Line dedup: windows of three consecutive lines that occur earlier in the corpus are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sunplane.staging import staged


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row for each `width` consecutive lines that aren't blank: id, mark of the text, index of the first and the last
    line among all lines of the text, and a 128-bit hash. Blanks, tabs and CRs at a line's ends don't count."""
    bare = lambda line: F.btrim(line, F.lit(" \t\r"))
    solid = F.filter(
        F.transform(_lines(F.col("body")), lambda line, i: F.struct(i.alias("i"), bare(line).alias("s"))), lambda x: x["s"] != ""
    )
    hashed = F.transform(
        solid, lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["s"]).alias("a"), F.xxhash64(F.lit("b"), x["s"]).alias("b"))
    )
    at = lambda k, j: F.get(F.col("solid"), k + j)
    window = lambda k: F.struct(
        at(k, 0)["i"].alias("s"),
        at(k, width - 1)["i"].alias("e"),
        F.xxhash64(*[at(k, j)["a"] for j in range(width)]).alias("h1"),
        F.xxhash64(*[at(k, j)["b"] for j in range(width)]).alias("h2"),
    )
    return (
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("body"))
        .select("id", "t", hashed.alias("solid"))
        .filter(F.size("solid") >= width)
        .select("id", "t", F.explode(F.transform(F.sequence(F.lit(0), F.size("solid") - width), window)).alias("w"))
        .select("id", "t", "w.s", "w.e", "w.h1", "w.h2")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with the lines of repeated windows removed from `text_col`, plus `n_lines` and `n_removed`.

    A window is `width` consecutive lines that aren't blank. Its first occurrence, by id (a null id first), then text
    (by its hash, among rows that share an id) and then position, stays; the lines from first to last of every later occurrence are removed, blank lines between them
    included, overlapping occurrences merged. Other lines stay as they are.

    Defined results: a null text stays null with 0 lines; a text with fewer than `width` lines that aren't
    blank stays as it is; a text all of whose lines go becomes empty; rows that share an id are documents of their
    own if their texts differ, and equal ones, which lose the same lines, if their texts are equal. Other columns
    pass through, except earlier ones named n_lines or n_removed, which are replaced. An empty table gives an
    empty result.

    Repeated windows are found by an aggregate that combines on the map side, then joined back: a very common
    window makes a skewed join, which adaptive execution splits, never a group gathered in one task.
    """
    spots = staged(line_windows(docs, id_col, text_col, width), "line-windows")
    first = (
        spots.groupBy("h1", "h2")
        .agg(F.min(F.struct("id", "t", "s")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("h1", "h2", F.col("first.id").alias("first_id"), F.col("first.t").alias("first_t"), F.col("first.s").alias("first_s"))
    )
    later = spots.join(first, ["h1", "h2"]).filter(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("t") == F.col("first_t")) & (F.col("s") == F.col("first_s"))))
    past = F.coalesce(F.lag("e").over(Window.partitionBy("id", "t").orderBy("s", "e")) + 1, F.lit(0))
    cuts = (
        later.select("id", "t", "s", "e", past.alias("past"))
        .groupBy(F.col("id").alias("_cut_id"), F.col("t").alias("_cut_mark"))
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("s") > F.col("past"), F.struct("past", "s")))).alias("_cut_gaps"),
            (F.max("e") + 1).alias("_cut_tail"),
        )
    )
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", text_col.lower())]
    lines = _lines(F.col("_cut_text"))
    kept = F.concat(
        F.flatten(F.transform("_cut_gaps", lambda g: F.slice(lines, g["past"] + 1, g["s"] - g["past"]))),
        F.slice(lines, F.col("_cut_tail") + 1, F.greatest(F.size(lines) - F.col("_cut_tail"), F.lit(0))),
    )
    whole = F.coalesce(F.length("_cut_text") - F.length(F.replace("_cut_text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return (
        docs.select(*rest, F.col(text_col).alias("_cut_text"))
        .join(cuts, F.col(id_col).eqNullSafe(F.col("_cut_id")) & (F.xxhash64("_cut_text") == F.col("_cut_mark")), "left")
        .select(*rest, "_cut_text", whole.cast("long").alias("n_lines"), F.when(F.col("_cut_mark").isNotNull(), kept).alias("_cut_kept"))
        .select(
            *rest,
            F.when(F.col("_cut_kept").isNull(), F.col("_cut_text")).otherwise(F.array_join("_cut_kept", "\n")).alias(text_col),
            "n_lines",
            F.when(F.col("_cut_kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("_cut_kept")).cast("long").alias("n_removed"),
        )
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "n_removed")


OP10_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents),
b AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS s FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
w AS (
  SELECT doc_id, i AS s0, lead(i, 2) OVER p AS e0, s AS a, lead(s, 1) OVER p AS b, lead(s, 2) OVER p AS c
  FROM b WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, s0) AS nth FROM w WHERE e0 IS NOT NULL),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN r ON r.doc_id = l.doc_id AND r.nth > 1 AND l.i BETWEEN r.s0 AND r.e0),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text, count(*) AS n
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
