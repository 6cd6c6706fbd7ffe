"""Language ID: averaged embeddings of hashed byte n-grams and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from sunplane.llm.common import ALNUM, in_batches, text_chunks
from sunplane.staging import staged

BUCKET_BITS, DIM, ORDERS = 15, 12, (2, 3, 4)
#: The fit's bound: at most so many documents of a language, and of each so many segments, spread over the whole text.
SAMPLE_DOCS, SEGMENTS, SEGMENT_CHARS = 400, 12, 200
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.6, 7
#: Predictions under the score at which so large a share of the validation segments was right are marked as rejected.
WANTED_PRECISION = 0.99

_LETTER = ALNUM.copy()
_LETTER[0x30:0x3A] = False
_FOLD = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint32)
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def gram_buckets(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each order and byte the bucket of the n-gram that starts there; one more bucket, the last, stands for
    n-grams that would leave their text. Bytes that belong to no letter count as spaces."""
    folded = _FOLD[data]
    ends = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(len(data))
    out = np.full((len(ORDERS), len(data)), 1 << BUCKET_BITS, np.int32)
    for k, n in enumerate(ORDERS):
        if len(data) >= n:
            h = np.full(len(data) - n + 1, np.uint32(n) * _PRIMES[3], np.uint32)
            for j in range(n):
                h = (h ^ folded[j : len(data) - n + 1 + j]) * _PRIMES[j % 3]
                h ^= h >> np.uint32(15)
            inside = at[: len(h)] + n <= ends[: len(h)]
            out[k, : len(h)][inside] = (h >> np.uint32(32 - BUCKET_BITS))[inside]
    return out


@dataclass
class Model:
    """langs in order; for each bucket its embedding times the output weights; bias, temperature, rejection score."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        out, count = np.zeros((n, len(self.langs)), np.float64), np.zeros(n)
        full = np.flatnonzero(np.diff(bounds) > 0)
        if len(full):
            for row in gram_buckets(data, bounds):
                out[full] += np.add.reduceat(self.table[row], bounds[full], axis=0)
                count[full] += np.add.reduceat((row < 1 << BUCKET_BITS).astype(np.int64), bounds[full])
        return out / np.maximum(count, 1)[:, None] + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.lower().encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def train(samples: list[tuple[str, str, bool]]) -> Model | None:
    """Fits the model on (text, language, is for validation). None without samples."""
    langs = sorted({lang for _, lang, _ in samples})
    if not langs:
        return None
    rng = np.random.default_rng(SEED)
    code = {lang: k for k, lang in enumerate(langs)}
    fit, check = [s for s in samples if not s[2]] or samples, [s for s in samples if s[2]]
    y = np.array([code[s[1]] for s in fit])
    share = np.bincount(y, minlength=len(langs))
    weight = (len(y) / np.maximum(share, 1) / len(langs))[y]
    embedding = rng.normal(0, 0.1, ((1 << BUCKET_BITS) + 1, DIM)).astype(np.float32)
    embedding[-1] = 0
    out, bias = rng.normal(0, 0.3, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    steps, done = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for k in range(0, len(fit), BATCH):
            pick = order[k : k + BATCH]
            texts = []
            for i in pick:
                size = int(rng.integers(20, SEGMENT_CHARS + 1))
                start = int(rng.integers(0, max(1, len(fit[i][0]) - size + 1)))
                texts.append(fit[i][0][start : start + size])
            data, bounds = _bytes_of(texts)
            grams = gram_buckets(data, bounds)
            of = np.tile(np.repeat(np.arange(len(pick)), np.diff(bounds)), len(ORDERS))
            flat = grams.ravel()
            of, flat = of[flat < 1 << BUCKET_BITS], flat[flat < 1 << BUCKET_BITS]
            count = np.maximum(np.bincount(of, minlength=len(pick)), 1).astype(np.float32)
            mean = np.stack([np.bincount(of, embedding[flat, d], len(pick)) for d in range(DIM)], axis=1).astype(np.float32) / count[:, None]
            rate = RATE * (1 - done / steps)
            done += 1
            error = _softmax(mean @ out + bias)
            error[np.arange(len(pick)), y[pick]] -= 1
            error = (error * weight[pick][:, None] / len(pick)).astype(np.float32)
            back = (error @ out.T) / count[:, None] * 40
            different, which = np.unique(flat, return_inverse=True)
            for d in range(DIM):
                embedding[different, d] -= rate * np.bincount(which, back[of, d], len(different)).astype(np.float32)
            out -= rate * mean.T @ error * 10
            bias -= rate * error.sum(axis=0)
    model = Model(langs, (embedding @ out).astype(np.float32), bias.astype(np.float64))
    if check:
        logits = model.logits(*_bytes_of([s[0] for s in check]))
        truth = np.array([code[s[1]] for s in check])
        loss = {t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in np.geomspace(0.05, 5, 41)}
        model.temperature = float(min(loss, key=loss.get))
        score = model.scores(logits)
        right, best = score.argmax(axis=1) == truth, score.max(axis=1)
        order = np.argsort(-best)
        good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= WANTED_PRECISION
        model.reject_below = float(best[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str, bool]]:
    """The bounded sample: of each language the SAMPLE_DOCS documents with the least hash of their id that aren't held
    out, and of each SEGMENTS segments, those with the least hash, from the whole text. A fifth is for validation."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("id is not null and lang is not null and length(text) > 0").filter(~held_out(F.col("id")))
    # Hashes are even, so those under four times the wanted share hold the least SAMPLE_DOCS. The counts are one row for
    # each language, as is the model that is fitted.
    hashed = rows.select("id", "lang", F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h"))
    limits = rows.groupBy("lang").count().select(F.col("lang").alias("of"), (F.least(F.lit(1.0), F.lit(4.0 * SAMPLE_DOCS) / F.col("count")) * F.lit(float(1 << 63))).alias("limit"))
    few = hashed.join(F.broadcast(limits), F.col("lang") == F.col("of")).filter(F.col("h") <= F.col("limit")).select("id", "lang", "h")
    ranked = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).filter(f"nth <= {SAMPLE_DOCS}")
    picked = staged(ranked.select(F.col("id").alias("picked"), F.col("lang").alias("picked_lang")).distinct(), "language-sample")
    last = F.floor((F.length("text") - 1) / SEGMENT_CHARS)
    order = F.array_sort(F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.struct(F.xxhash64("id", i).alias("h"), i.alias("i"))))
    cut = F.transform(F.slice(order, 1, SEGMENTS), lambda s: F.substr("text", s["i"] * SEGMENT_CHARS + 1, F.lit(SEGMENT_CHARS)))
    found = rows.join(picked, (F.col("id") == F.col("picked")) & (F.col("lang") == F.col("picked_lang"))).select("id", "lang", (F.pmod(F.xxhash64("id", F.lit("v")), F.lit(5)) == 0).alias("check"), F.explode(cut).alias("segment"))
    return sorted((r["segment"], r["lang"], r["check"]) for r in found.collect())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, lang_pred, score (the calibrated probability of that language) and
    rejected (score below the model's rejection score).

    A null text or one without letters is `und` with score 0 and rejected, and so is every text without a model
    (no labelled rows). Whole texts of any length are used; rows that share an id are predicted each; a null id
    stays null; other columns, language and source among them, are ignored; an empty table gives no rows.
    """
    id_type = to_arrow_schema(docs.select(F.col(id_col).alias("id")).schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for row, end, data, bounds in text_chunks(batch.column(1), lower=True):
                letters = np.concatenate([[0], np.cumsum(_LETTER[data])])[bounds]
                ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 0x80))])[bounds]
                some = np.diff(ascii_letters) > 0
                for k in np.flatnonzero(~some & (np.diff(letters) > 0)):
                    some[k] = any(c.isalpha() for c in data[bounds[k] : bounds[k + 1]].tobytes().decode())
                if model is None:
                    names += ["und"] * (end - row)
                    scores += [0.0] * (end - row)
                    continue
                share = model.scores(model.logits(data, bounds))
                best = share.argmax(axis=1)
                names += [model.langs[b] if s else "und" for b, s in zip(best, some)]
                scores += np.where(some, share.max(axis=1), 0.0).tolist()
            reject = model.reject_below if model else 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([n == "und" or s < reject for n, s in zip(names, scores)], pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(training_samples(docs))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
