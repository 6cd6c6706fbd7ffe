import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunplane.llm.language_id import BUCKET_BITS, ORDERS, Model, _bytes_of, gram_buckets, op9_language_id, predict, train, training_samples


@pytest.fixture(scope="module")
def fitted(spark):
    return train(training_samples(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_held_out_accuracy_and_columns(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op9_language_id(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_training_leaves_held_out_and_unlabelled_rows_out(spark, docs):
    df = docs(["text number of some length"] * 40)
    used = training_samples(df)
    assert len(used) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(1, 41))
    assert training_samples(df.withColumn("lang", F.lit(None).cast("string"))) == []


def test_texts_without_letters(docs, fitted):
    out = {r["doc_id"]: r for r in predict(docs([None, "", "123 !?", "— … «»", "é", "日本", "the and of", "😀"]), fitted).collect()}
    assert [out[k]["lang_pred"] == "und" for k in range(1, 9)] == [True, True, True, True, False, False, False, True]
    assert all(out[k]["score"] == 0 and out[k]["rejected"] for k in (1, 2, 3, 4, 8))


def test_prediction_is_the_mean_over_grams(fitted):
    texts = ["la maison", "und der", "x", "a b c d " * 50]
    data, bounds = _bytes_of(texts)
    together = fitted.logits(data, bounds)
    for k, t in enumerate(texts):
        d, b = _bytes_of([t])
        grams = gram_buckets(d, b)
        grams = grams[grams < len(fitted.table) - 1]
        want = fitted.table[grams].sum(axis=0) / max(1, len(grams)) + fitted.bias
        assert np.allclose(together[k], want, atol=1e-4) and np.allclose(fitted.logits(d, b)[0], want, atol=1e-4)


def test_long_texts_and_edges(spark, docs, fitted):
    assert predict(docs([]), fitted).count() == 0
    out = [r["lang_pred"] for r in predict(docs(["der die und das ist nicht " * 40_000, "der die und das ist nicht " * 40]), fitted).collect()]
    assert out[0] == out[1]
    df = spark.createDataFrame([(None, "the of and", 1), (2, "the of and", 2), (2, "the of and", 2)], "doc_id long, text string, score int")
    assert len({r["lang_pred"] for r in predict(df, fitted).collect()}) == 1
    assert {r["lang_pred"] for r in predict(df, None).collect()} == {"und"}
    assert train([]) is None and isinstance(train([("only one language", "xx", False)]), Model)


def plain_prediction(model, text):
    """The forward pass in plain Python: lower case, letters and spaces, hashed n-grams of bytes, their mean, softmax."""
    data = [b if (0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80) else 0x20 for b in text.lower().encode()]
    factors = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
    total, count = [0.0] * len(model.langs), 0
    for n in ORDERS:
        for k in range(len(data) - n + 1):
            h = n * 0x27D4EB2F & 0xFFFFFFFF
            for j in range(n):
                h = (h ^ data[k + j]) * factors[j % 3] & 0xFFFFFFFF
                h ^= h >> 15
            row = model.table[h >> 32 - BUCKET_BITS]
            total = [t + float(x) for t, x in zip(total, row)]
            count += 1
    logits = [(t / max(1, count) + b) / model.temperature for t, b in zip(total, model.bias)]
    shares = [math.exp(x - max(logits)) for x in logits]
    return model.langs[shares.index(max(shares))], max(shares) / sum(shares)


def test_predictions_against_plain_python(spark, fitted):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000").limit(60)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()} | {-1: "Kurz", -2: "a", -3: "MAYÚSCULAS ñ 12"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in predict(df, fitted).collect():
        if r["lang_pred"] != "und":
            lang, score = plain_prediction(fitted, texts[r["doc_id"]])
            assert (r["lang_pred"] == lang or score < 0.51) and abs(r["score"] - score) < 1e-3
        assert r["rejected"] == (r["lang_pred"] == "und" or r["score"] < fitted.reject_below)
