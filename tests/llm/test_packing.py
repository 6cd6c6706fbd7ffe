import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from sunplane.llm.common import text_chunks  # noqa: E402
from sunplane.llm.packing import WordEncoder, binary_pieces, op6_packing, pack_documents, write_buckets  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = WordEncoder(PATH)


def ids(text):
    return ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


def encode(text):
    if "<|" in text:
        return ENCODER.encode_alone(text).tolist()
    for _, _, data, bounds in text_chunks(pa.array([text])):
        return ENCODER.encode(data, bounds)[0].tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abIJs' \n\t.,'-&<|>12̧̌É́ΣİK—½ﬁ \x1c"), st.characters(codec="utf-8")), max_size=40))
def test_unitwise_ids_equal_whole_ids(text):
    assert encode(text) == ids(text)


@pytest.mark.parametrize("text", ["don't 'S's it'S (\"'ve", "a.b,c x<|endoftext|>y", "<|STARTOFTEXT|>", "J̌ ≮ a̸ ﬁ", "word " * 5000, "x" * 50_000])
def test_odd_texts(text):
    assert encode(text) == ids(text)


def test_words_that_a_polynomial_hash_confuses_are_told_apart():
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    text = f"{word} {word.translate({97: 98, 98: 97})} {word}"
    assert encode(text) == ids(text)


def test_units_that_share_a_hash_are_compared(monkeypatch):
    monkeypatch.setattr("sunplane.llm.packing.run_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    for text in ("one two the six", "é à one two ok"):
        assert encode(text) == ids(text)


def test_forgetting_keeps_ids():
    small = WordEncoder(PATH)
    for text in ("alpha beta", "gamma alpha"):
        small.forget()
        for _, _, data, bounds in text_chunks(pa.array([text])):
            assert small.encode(data, bounds)[0].tolist() == ids(text)


def test_binary_pieces():
    for n in (1, 2, 3, 4095, 4096, 4097, 10_000, 81_921):
        pieces = binary_pieces(n, 4096)
        assert [s for s, _ in pieces] == np.cumsum([0] + [k for _, k in pieces])[:-1].tolist()
        assert sum(k for _, k in pieces) == n and all(k & (k - 1) == 0 and k <= 4096 for _, k in pieces)
        assert len({k for _, k in pieces if k < 4096}) == len([k for _, k in pieces if k < 4096])


def check(rows, texts):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for k, parts in by_doc.items():
        want = np.array([*ids(texts[k] or ""), 2], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["offset"]) == (at, len(want), 0)
            piece = want[at : at + r["length"]]
            assert zlib.crc32(piece.tobytes()) == r["ids_crc32"]
            if "ids" in r.asDict():
                assert r["ids"] == piece.tolist()
            at += r["length"]
        assert at == len(want)
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_round_trip(spark, docs):
    texts = [None, "", "one", "a b <|endoftext|> c", "Great 'tis don't. " * 4000, "é" * 9]
    check(pack_documents(docs(texts), PATH).collect(), dict(enumerate(texts, 1)))


def test_query(spark, sample_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sample_dir}/documents.parquet").collect()}
    check(op6_packing(spark, sample_dir).collect(), texts)


def test_edges(spark, docs):
    assert pack_documents(docs([]), PATH).count() == 0
    df = spark.createDataFrame([(None, "a b", 1), (3, "a b", 2), (3, "a b", 2)], "doc_id long, text string, start int")
    rows = pack_documents(df, PATH).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) == 6


def test_buckets_hold_equal_lengths(spark, docs, tmp_path):
    pieces = pack_documents(docs(["some words here " * k for k in range(1, 40)]), PATH)
    write_buckets(pieces, str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    assert all(len(r["ids"]) == r["length"] == 1 << r["bucket"] for r in rows)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, rows)) == sorted(map(key, pieces.collect()))
    assert (tmp_path / "packed" / "bucket=2").is_dir()
