"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths, each a sequence."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sunplane.llm.common import in_batches, run_hashes, same_bytes, text_chunks

#: Units whose ids a worker remembers; at more it starts anew, so its memory is bounded.
REMEMBERED = 450_000
#: Bytes of text encoded at once.
AT_ONCE = 1 << 20
#: Between units that are encoded together; its id doesn't occur otherwise, as texts that have `<|` are encoded by themselves.
MARK = "<|endoftext|>"

_SPACE, _ALPHA, _PUNCT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, 0x0A]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _ALPHA
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = _PUNCT
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first of each text (as common.runs) of the units that can be encoded apart: parted by spaces
    and newlines, and between an ASCII letter and ASCII punctuation but an apostrophe, which may begin a
    contraction."""
    kind = _CLASS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    pair = kind[1:] + kind[:-1]
    cut[1:-1] |= (pair == _ALPHA + _PUNCT) & (kind[1:] != kind[:-1]) & (kind[1:] != _SPACE) & (kind[:-1] != _SPACE)
    cut[1:-1] |= (kind[1:] == _SPACE) != (kind[:-1] == _SPACE)
    solid = kind != _SPACE
    starts, ends = np.flatnonzero(cut[:-1] & solid), np.flatnonzero(cut[1:] & solid) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    """The array with room for `size`, doubled where it must grow."""
    return a if len(a) >= size else np.concatenate([a, np.zeros(max(size - len(a), len(a)), a.dtype)])


class WordEncoder:
    """Token ids of texts, for tokenizers that drop white space, fold case and never join tokens across white space or
    between letters and punctuation. Equal units of a chunk are found by hash and compared byte by byte; each different
    one is looked up by its bytes, encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(MARK)
        self.forget()

    def forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.n_ids = 0

    def _learn(self, words: list[bytes]) -> None:
        flat = np.array(self.tokenizer.encode_batch_fast([MARK.join(w.decode() for w in words) + MARK], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(flat == self.mark)
        lengths = np.diff(np.concatenate([[-1], ends])) - 1
        k, n = len(self.code), int(lengths.sum())
        self.ids, self.starts, self.lengths = _grown(self.ids, self.n_ids + n), _grown(self.starts, k + len(words)), _grown(self.lengths, k + len(words))
        self.starts[k : k + len(words)] = self.n_ids + np.cumsum(lengths) - lengths
        self.lengths[k : k + len(words)] = lengths
        self.ids[self.n_ids : self.n_ids + n] = flat[flat != self.mark]
        self.n_ids += n
        self.code.update(zip(words, range(k, k + len(words))))

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the UTF-8 texts between the bounds one after the other, and the bounds of the texts among them."""
        if len(self.code) > REMEMBERED:
            self.forget()
        starts, ends, first = units(data, bounds)
        high = np.concatenate([[0], np.cumsum(data >= 0x80)])
        plain = _LOWER[data]
        foreign = high[ends] > high[starts]
        if foreign.any():  # only ASCII units are told apart by lower case alone
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts[foreign]] += 1
            edge[ends[foreign]] -= 1
            plain = np.where(np.cumsum(edge[:-1]) > 0, data, plain)
        which, _ = pd.factorize(run_hashes(plain, starts, ends))
        at = np.zeros(which.max(initial=-1) + 1, np.int64)
        at[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        if not same_bytes(plain, starts, ends, at[which], np.arange(len(which))).all():  # two units share a hash: number them by their bytes
            which, _ = pd.factorize(np.array([plain[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], object))
            at = np.zeros(which.max(initial=-1) + 1, np.int64)
            at[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        raw = plain.tobytes()
        different = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        codes = np.array([self.code.get(w, -1) for w in different], np.int64)
        if len(new := np.flatnonzero(codes < 0)):
            for k in range(0, len(new), 4096):
                self._learn([different[i] for i in new[k : k + 4096]])
            codes[new] = np.arange(len(self.code) - len(new), len(self.code))
        codes = codes[which]
        lengths = self.lengths[codes].astype(np.int64)
        after = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[codes] - after[:-1], lengths) + np.arange(after[-1])
        return self.ids[at], after[first]

    def encode_alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, WordEncoder] = {}


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of n tokens cut into as many pieces of `longest` as fit and then the binary digits of the rest."""
    out = [(k * longest, longest) for k in range(n // longest)]
    at, size = n - n % longest, longest // 2
    while size:
        if n % longest & size:
            out.append((at, size))
            at += size
        size //= 2
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, longest: int = 4096, with_ids: bool = True) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, bucket (log2 of the length),
    sequence_id, offset, and with `with_ids` the token ids themselves.

    A document is its ids and then end_id. It is cut into pieces of `longest` (a power of two) and of the powers of
    two that make up the rest; each piece is a whole sequence, so no sequence crosses documents and none is
    padded. write_buckets lays them out for training, which draws batches from one bucket at a time.

    Null and empty texts are the end id alone; a text of any length is packed whole; rows that repeat an id are
    packed each, with sequences of their own; a null id stays null; columns besides the two are ignored; an
    empty table gives no rows. Nothing is shuffled: sequence_id is the partition and the place in it, the same
    whenever a task of the same scan runs again.
    """
    id_type = docs.schema[id_col].dataType
    schema = f"id {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids
    out_schema = to_arrow_schema(docs.select(F.col(id_col).alias("id")).schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = WordEncoder(tokenizer_path)
        encoder = _encoders[tokenizer_path]
        for batch in batches:
            for row, end, data, edges in text_chunks(batch.column(1), size=AT_ONCE):
                raw = data.tobytes()
                alone = [k for k in range(end - row) if b"<|" in raw[edges[k] : edges[k + 1]]] if b"<|" in raw else []
                if alone:  # their bytes count as spaces, and they are encoded by themselves
                    data = data.copy()
                    for k in alone:
                        data[edges[k] : edges[k + 1]] = 0x20
                ids, bounds = encoder.encode(data, edges)
                apart = {k: encoder.encode_alone(raw[edges[k] : edges[k + 1]].decode()) for k in alone}
                of, rows, lists = [], [], []
                for k in range(end - row):
                    own = np.append(apart.get(k, ids[bounds[k] : bounds[k + 1]]), np.uint32(end_id)).astype("<u4")
                    for start, length in binary_pieces(len(own), longest):
                        piece = own[start : start + length]
                        of.append(row + k)
                        rows.append((start, length, zlib.crc32(piece.tobytes()), len(own), length.bit_length() - 1))
                        if with_ids:
                            lists.append(piece.view("<i4"))
                columns = np.array(rows, np.int64).reshape(-1, 5).T
                arrays = [batch.column(0).take(pa.array(of, pa.int64())).cast(out_schema.field(0).type), *[pa.array(c) for c in columns[:4]], pa.array(columns[4].astype(np.int32))]
                if with_ids:
                    flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(columns[1])]).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "ids_crc32", "doc_tokens", "bucket"] + ["ids"] * with_ids)

    pieces = in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(pack, schema)
    return pieces.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "bucket", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids
    )


def write_buckets(pieces: DataFrame, path: str, rows_a_file: int = 100_000) -> None:
    """Writes pack_documents' pieces as a table with a folder for each bucket, so that equal lengths lie together. Every task
    writes its own files, at most one more for a bucket than its rows need; nothing is shuffled."""
    pieces.write.option("maxRecordsPerFile", rows_a_file).partitionBy("bucket").parquet(path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"
    )
