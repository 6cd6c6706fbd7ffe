"""Quality rules: text statistics, and lines that many documents of one host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunplane.llm.common import WHITE, in_batches, list_hashes, mix, run_hashes, runs, same_bytes, text_chunks, windows
from sunplane.staging import staged

# The symbols that count, and the limits of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEAT_PERCENT = 20, 8, 30
#: A line in more than this many documents of a host is removed from all of them.
MOST_DOCS = 10
#: A document is depleted if fewer than LEAST_WORDS words or less than this share of its words are left.
LEAST_LEFT_PERCENT = 30

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key whether it occurs twice or more, and the one equal to it just before it, or -1."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, before = np.zeros(len(key), bool), np.full(len(key), -1)
    before[order[1:][same]] = order[:-1][same]
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice, before


def _line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: np.ndarray) -> np.ndarray:
    """A hash of the words of each line; head: the index of each line's first word."""
    if not len(head):
        return np.zeros(0, np.uint64)
    first = np.append(head, len(starts))
    return list_hashes(run_hashes(data, starts, ends), np.arange(len(starts)) - np.repeat(head, np.diff(first)), first)


def chunk_stats(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each text between the bounds, and of each of its different lines (ASCII case and runs of
    white space set aside): text index, hash, words of all its occurrences."""
    n = len(bounds) - 1
    starts, ends, first = runs(data, bounds, WHITE)
    of = np.repeat(np.arange(n), np.diff(first))
    seed = mix(np.arange(1, n + 1, dtype=np.uint64))
    total = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[bounds])
    out = {"n_words": np.diff(first), "word_chars": total(WHITE[data] & ((data & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[data])}

    grams = windows(run_hashes(data, starts, ends), REPEAT_WINDOW)
    own = of[: len(grams)] == of[REPEAT_WINDOW - 1 :] if len(grams) else np.zeros(0, bool)
    twice = np.zeros(len(grams), bool)
    twice[own] = _repeats(grams[own] ^ seed[of[: len(grams)][own]])[0]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = np.bincount(of[np.cumsum(cover[:-1]) > 0], minlength=n)

    breaks = np.flatnonzero(data == 10)
    after = np.searchsorted(breaks, starts)
    line = after + of
    head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    line_of, k = of[head], after[head]
    edges = np.concatenate([[-1], breaks, [len(data)]])
    low, high = np.maximum(edges[k] + 1, bounds[line_of]), np.minimum(edges[k + 1], bounds[line_of + 1])
    before = _repeats(run_hashes(data, low, high) ^ seed[line_of])[1]
    again = np.flatnonzero(before >= 0)
    out["n_dup_lines"] = np.bincount(line_of[again[same_bytes(data, low, high, again, before[again])]], minlength=n)

    words = np.diff(np.concatenate([head, [len(starts)]]))
    bare = _line_hashes(_LOWER[data], starts, ends, head)
    order = np.lexsort([bare, line_of])
    new = np.concatenate([[True], (bare[order][1:] != bare[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])]) if len(order) else np.zeros(0, bool)
    out["line_of"], out["line_hash"] = line_of[order][new], bare[order][new]
    out["line_words"] = np.add.reduceat(words[order], np.flatnonzero(new)) if len(order) else words
    return out


_KEY = ("id", "host", "t1", "t2")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, bounds in text_chunks(batch.column("text")):
            s = chunk_stats(data, bounds)
            offsets = pa.array(np.searchsorted(s["line_of"], np.arange(end - row + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(row, end - row) for c in _KEY]
                + [pa.array(s[c].astype(np.int64)) for c in _COUNTS]
                + [pa.ListArray.from_arrays(offsets, pa.array(s["line_hash"].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(s["line_words"].astype(np.int32)))],
                [*_KEY, *_COUNTS, "line_hash", "line_words"],
            )


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in zip(_KEY[1:], _marks(text_col, host_col))], F.col(text_col).alias("text"))


def _marks(text_col: str, host_col: str) -> list[Column]:
    """The host, null as '', and 128 bits of the text: what a verdict depends on."""
    return [F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.xxhash64(text_col), F.xxhash64(F.lit("t"), text_col)]


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_docs: int = MOST_DOCS, copies_count: bool = True) -> tuple[DataFrame, DataFrame]:
    """Verdicts and removed lines. Verdicts: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_removed_words, kept, one row for each row of docs. Removed lines: for each host and text (by its marks
    t1, t2) that loses any, `lines`, their hashes (as line_keys makes them), and `lost`, the number of their words.

    Words are runs of anything but space and U+0009 to U+000D. base_failed: fewer than LEAST_WORDS words, or
    over MOST_REPEAT_PERCENT percent of the words in REPEAT_WINDOW-word windows found twice in the text. A line
    (ASCII case and white space set aside) is common if more than `most_docs` distinct documents of one host have it; all
    documents of the host lose it. A document that loses so many words that fewer than LEAST_WORDS or
    LEAST_LEFT_PERCENT percent are left is rejected as depleted.

    Distinct documents differ in id or text, so equal rows count once. Without `copies_count` they differ in text: exact copies,
    which a later stage reduces to one, then don't reject each other.

    Null texts count as empty, with no words, and fail the base rules; a null host is a host of its own together with
    the empty one; a verdict depends on the row's host and text alone, so rows that share an id are judged each, and a
    null id is as good as any; other columns are ignored; an empty table gives empty results. Counts are
    map-side aggregates over (host, line, text), so a line that every document has is never gathered in one task.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, host string, t1 long, t2 long, {', '.join(f'{c} long' for c in _COUNTS)}, line_hash array<long>, line_words array<int>"
    digest = staged(_keyed(in_batches(docs), id_col, text_col, host_col).mapInArrow(_digest, schema), "quality-digest")
    lines = digest.select("id", "host", "t1", "t2", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")).select("id", "host", "t1", "t2", F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("words"))
    each = lines.groupBy("host", "line", "t1", "t2", *["id"] * copies_count).agg(F.max("words").alias("words"))
    common = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > most_docs).drop("n_docs")
    losses = lines.groupBy("host", "line", "t1", "t2").agg(F.max("words").alias("words")).join(common, ["host", "line"])
    lost = staged(losses.groupBy("host", "t1", "t2").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("lines")), "lost-lines")
    n_lost = F.coalesce("lost", F.lit(0))
    left = F.col("n_words") - n_lost
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    verdicts = (
        digest.drop("line_hash", "line_words")
        .join(lost.drop("lines"), list(_KEY[1:]), "left")
        .select(
            F.col("id").alias(id_col),
            *_COUNTS,
            failed.alias("base_failed"),
            n_lost.cast("long").alias("n_removed_words"),
            (~failed & (left >= LEAST_WORDS) & (100 * left >= LEAST_LEFT_PERCENT * F.col("n_words"))).alias("kept"),
            *_KEY[1:],
        )
    )
    return verdicts, lost


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_docs: int = MOST_DOCS, copies_count: bool = True) -> DataFrame:
    """docs without rejected documents and without common lines (see judge_documents), columns as they are, one row
    for each row that is kept. Texts that lose no line stay as they are."""

    @F.pandas_udf("string")
    def cut(texts, lines):
        out = []
        for text, gone in zip(texts, lines):
            gone = set(gone)
            out.append("\n".join(x for x, key in zip(text.split("\n"), line_keys(text)) if key not in gone))
        return texts.__class__(out, dtype=object)

    verdicts, gone = judge_documents(docs, id_col, text_col, host_col, most_docs, copies_count)
    hidden = [f"_rules_{k}" for k in _KEY[1:]]
    keep = verdicts.filter("kept").select(*_KEY[1:]).distinct().join(gone.select(*_KEY[1:], "lines"), list(_KEY[1:]), "left").select(*[F.col(k).alias(h) for k, h in zip(_KEY[1:], hidden)], F.col("lines").alias("_rules_lines"))
    match = [m == F.col(h) for m, h in zip(_marks(text_col, host_col), hidden)]
    text = F.when(F.col("_rules_lines").isNull(), F.col(text_col)).otherwise(cut(F.coalesce(text_col, F.lit("")), F.coalesce("_rules_lines", F.array().cast("array<bigint>"))))
    return docs.join(keep, match).select(*[text.alias(c) if c == text_col else c for c in docs.columns])


def line_keys(text: str) -> list[int | None]:
    """For each line of the text its hash as chunk_stats makes it; None for lines without a word."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = runs(data, np.array([0, len(data)]), WHITE)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    out: list[int | None] = [None] * (text.count("\n") + 1)
    if len(line):
        head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        for k, key in zip(line[head], _line_hashes(_LOWER[data], starts, ends, head).view(np.int64)):
            out[k] = int(key)
    return out


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0].drop(*_KEY[1:])


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
ws AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws),
g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p
  || ' ' || lead(w, 5) OVER p || ' ' || lead(w, 6) OVER p || ' ' || lead(w, 7) OVER p AS g FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM g),
c AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM r),
rep AS (SELECT doc_id, count(*) FILTER (WHERE covered) AS n FROM c GROUP BY doc_id),
l0 AS (SELECT doc_id, host, md5(text) AS t, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM l0),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, count(*) AS n FROM l WHERE len(lw) > 0 GROUP BY doc_id, line) GROUP BY doc_id),
norm AS (SELECT doc_id, host, t, len(lw) AS n, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line FROM l WHERE len(lw) > 0),
common AS (SELECT host, line FROM norm GROUP BY host, line HAVING count(DISTINCT t || coalesce(CAST(doc_id AS VARCHAR), 'null')) > 10),
lost AS (SELECT n.doc_id, sum(n.n) AS n FROM norm n JOIN common c ON n.host = c.host AND n.line = c.line GROUP BY n.doc_id),
s AS (SELECT ws.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
  FROM ws LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  n_removed_words, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 20
  AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept
FROM s
"""
