"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide, groups are linked components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sunplane.llm.common import doc_shingles, in_batches, mix, set_similar
from sunplane.staging import discard, staged

WIDTH = 5
THRESHOLD = (4, 5)
TARGET_RECALL, MOST_HASHES = 0.9995, 64
#: A bucket is compared in blocks of about so many documents or bytes of text; each pair of blocks is one unit of work.
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20


def choose_bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows, and then the fewest bands, that find a pair at the threshold with at least
    this probability, 1 - (1 - threshold^rows)^bands, with at most so many hashes."""
    for rows in range(most_hashes, 0, -1):
        miss = 1 - threshold**rows
        bands = 1
        while bands * rows <= most_hashes and 1 - miss**bands < recall:
            bands += 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("more hashes are needed for this recall")


class MinHasher:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
        self.flip, self.factor = seeds[0::2, None], seeds[1::2, None] | np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full((self.bands * self.rows, 1), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(shingles), 4096):
            least = np.minimum(least, ((shingles[None, k : k + 4096] ^ self.flip) * self.factor).min(axis=1, keepdims=True))
        grid = least.reshape(self.bands, self.rows)
        key = mix(np.arange(1, self.bands + 1, dtype=np.uint64))
        for r in range(self.rows):
            key = mix(key ^ grid[:, r])
        return key.view(np.int64)


def set_print(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that are equal for equal sets."""
    return int(mix(shingles).sum(dtype=np.uint64).astype(np.int64)), int(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def _prints(hasher: MinHasher, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, bands = [], [], []
            for _, shingles in doc_shingles(batch.column("text"), width):
                s = np.unique(shingles)
                sizes.append(len(s))
                marks.append(set_print(s) if len(s) else (0, 0))
                bands.append(hasher(s) if len(s) else np.zeros(0, np.int64))
            a, b = zip(*marks) if marks else ((), ())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists, batch.column("bytes")], ["id", "mark", "n", "f1", "f2", "bands", "bytes"])

    return run


def _linked_in_cell(left: list[dict], right: list[dict] | None, band: int, threshold: tuple[int, int]) -> Iterator[tuple]:
    """(node, root, links) of the documents of one unit of work that have a link in it. Links whose documents meet
    in an earlier band are left to that one, so that each counts once."""
    rows = left + (right or [])
    sizes = np.array([len(r["set"]) for r in rows])
    every, of = np.concatenate([r["set"] for r in rows]), np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    of, column = of[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    split = len(left) if right is not None else 0
    common = np.zeros((len(rows) - split, len(rows) if right is None else split), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 4097, 4096))
    for k in range(len(edges) - 1):
        part = np.zeros((len(rows), 4096), np.float32)
        part[of[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - 4096 * k] = 1
        common += part[split:] @ (part if right is None else part[:split]).T
    i, j = np.arange(split, len(rows)), np.arange(common.shape[1])
    link = set_similar(common.astype(np.int64), sizes[i][:, None], sizes[j][None, :], threshold)
    ids = np.array([r["rank"] for r in rows])
    link &= ids[i][:, None] != ids[j][None, :]
    keys = np.stack([r["bands"] for r in rows])
    for k in range(band):
        link &= keys[i, k][:, None] != keys[j, k][None, :]
    if not link.any():
        return
    copies = np.array([r["copies"] for r in rows])
    links = np.zeros(len(rows), np.int64)
    links[i] += link @ copies[j]
    root = np.arange(len(rows))
    if right is not None:
        links[j] += link.T @ copies[i]
    high = len(rows)
    while True:
        before = root.copy()
        root[i] = np.minimum(root[i], np.where(link, root[j][None, :], high).min(axis=1))
        if right is not None:
            root[j] = np.minimum(root[j], np.where(link, root[i][:, None], high).min(axis=0))
        if (root == before).all():
            break
    for k in np.flatnonzero(links):
        yield rows[k]["node"], rows[root[k]]["node"], int(links[k])


def _verify(hasher: MinHasher, width: int, threshold: tuple[int, int], id_type: pa.DataType):
    names, node = ["id", "root", "links"], pa.struct([("rep", id_type), ("f1", pa.int64()), ("f2", pa.int64())])
    types = (node, node, pa.int64())
    told = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def cell(rows: list[dict], meta: tuple) -> Iterator[tuple]:
        seen, kept = set(), []
        for r in sorted(rows, key=lambda r: (*r["node"].values(), r["side"])):  # repeated rows bring a set's text more than once
            if (key := (*r["node"].values(), r["side"])) not in seen:
                seen.add(key)
                kept.append(r)
        for k, r in enumerate(kept):
            r["rank"] = k
        left = [r for r in kept if r["side"] == 0]
        right = [r for r in kept if r["side"] == 1]
        if meta[1] == meta[2]:
            if len(left) > 1:
                yield from _linked_in_cell(left, None, meta[3], threshold)
        elif left and right:
            yield from _linked_in_cell(left, right, meta[3], threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in batches:
            meta = list(zip(*[batch.column(k).to_pylist() for k in ("key", "i", "j", "band")]))
            rest = {k: batch.column(k).to_pylist() for k in ("id", "side", "copies", "f1", "f2")}
            for k, shingles in doc_shingles(batch.column("text"), width):
                if meta[k] != now:
                    if now:
                        out += cell(rows, now)
                    now, rows = meta[k], []
                s = np.unique(shingles)
                if set_print(s) == (rest["f1"][k], rest["f2"][k]):
                    rows.append({"node": {"rep": rest["id"][k], "f1": rest["f1"][k], "f2": rest["f2"][k]}, "side": rest["side"][k], "copies": rest["copies"][k], "set": s, "bands": hasher(s)})
            if len(out) > 10_000:
                yield told(out)
                out = []
        if now:
            out += cell(rows, now)
        if out:
            yield told(out)

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for each id of the edges (id, root): the least id that it is connected with. Large-star and
    small-star steps over staged tables, until a round changes nothing; stars of any size are joined, never
    gathered. Null ids aren't edges. The ids may be of any type that has an order; each round's table goes with the next."""
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = staged(edges.select(F.col("id").alias("a"), F.col("root").alias("b")).filter("a <> b").select(most.alias("a"), least.alias("b")).distinct(), "edges")
    told = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    state = told(edges)
    while state[0]:
        both = edges.union(edges.select("b", "a"))
        heads = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        stars = both.join(heads, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = stars.groupBy("a").agg(F.min("b").alias("m"))
        before, edges = edges, staged(
            stars.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").select(most.alias("a"), least.alias("b")).distinct(),
            "edges",
        )
        new = told(edges)
        discard(before)
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: tuple[int, int], recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (id, mark of the text, n, f1, f2: size and fingerprint of its set), and for each set that
    occurs, known by its node (rep, f1, f2), rep being its least id: the node, the least node of its group, and its links."""
    bands, rows = choose_bands(threshold[0] / threshold[1], recall, MOST_HASHES)
    hasher = MinHasher(bands, rows)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = staged(
        texts.withColumns({"bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "mark": F.xxhash64("text")}).mapInArrow(_prints(hasher, width), f"id {kind}, mark long, n long, f1 long, f2 long, bands array<long>, bytes long"),
        "prints",
    )
    solid = prints.filter("n > 0 and id is not null")
    reps = staged(
        solid.groupBy("f1", "f2").agg(F.min(F.struct("id", "mark")).alias("least"), F.count(F.lit(1)).alias("copies"), F.min("bands").alias("bands"), F.min("bytes").alias("bytes")).select(F.struct(F.col("least.id").alias("rep"), "f1", "f2").alias("node"), "least", "copies", "bands", "bytes"),
        "representatives",
    )
    places = reps.select("node", "least", "copies", "bytes", F.posexplode("bands").alias("band", "key"))
    buckets = (
        places.groupBy("key", "band")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"), F.bit_xor(F.xxhash64("node.f1", "node.f2")).alias("x"), F.bit_xor(F.xxhash64("node.f2", "node.f1")).alias("y"))
        .filter("n > 1")
        .groupBy("n", "x", "y")
        .agg(F.min(F.struct("band", "key")).alias("first"), F.min("total").alias("total"))
        .select("first.key", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("node.f1", "node.f2"), F.col("blocks")).cast("int")
    cells = (
        places.join(buckets, "key")
        .withColumn("own", own)
        .select("node", "least", "copies", "band", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("node", "least", "copies", "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )
    work = (
        cells.join(texts, (F.col("least.id") == F.col("id")) & (F.col("least.mark") == F.xxhash64("text")))
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .select("key", "i", "j", "band", "id", "side", "copies", "node.f1", "node.f2", "text")
    )
    node = f"struct<rep:{kind},f1:bigint,f2:bigint>"
    found = staged(work.mapInArrow(_verify(hasher, width, threshold, to_arrow_type(docs.schema[id_col].dataType)), f"id {node}, root {node}, links long"), "links")
    groups = connected_components(found.select("id", "root")).select(F.col("id").alias("node"), "root")
    links = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    told = reps.select("node", "copies").join(links, "node", "left").join(groups, "node", "left")
    return prints.drop("bands", "bytes"), told.select("node", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))


def join_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """One row for each row of docs: the id, `class_id`, the least id of its group, and `n_links`, the number of
    other documents whose sets of `width`-word shingles have a Jaccard similarity of at least the threshold.
    A group is a connected component of these links.

    Documents of equal sets collapse to one representative first; only representatives are hashed into buckets.
    A bucket's documents are compared in blocks, in numpy, without writing its pairs; a link counts in the first
    band that its documents share. Buckets with the same members are compared once. Text is sent only for
    documents that share a bucket. Links at the threshold are found with a probability of `recall` or more, and
    closer ones with a higher one; every reported link is exact.

    Null and empty texts and null ids have no link and are classes of their own (a null id has a null class);
    rows that share an id are documents of their own, told apart by their sets, and equal ones count one each for
    n_links; other columns are ignored; texts of any length are compared whole; an empty table gives an empty result.
    """
    prints, told = _classes(docs, id_col, text_col, width, threshold, recall)
    told = told.select(F.col("node.f1").alias("g1"), F.col("node.f2").alias("g2"), F.col("root.rep").alias("class_id"), "links")
    return prints.join(told, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left").select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")
    )


#: Whether a text has a word as common.py defines it.
_WORDED = r"[0-9A-Za-z]|[^\x00-\x7F]"


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of join_near: of the rows with the group's least id, and among these the least set,
    one. Rows with a null id or a text without words are no copies and stay."""
    prints, told = _classes(docs, id_col, text_col, WIDTH, THRESHOLD, TARGET_RECALL)
    roots = told.filter("node = root").select(F.col("node.rep").alias("rep"), F.col("node.f1").alias("g1"), F.col("node.f2").alias("g2"))
    chosen = prints.filter("n > 0").join(roots, (F.col("id") == F.col("rep")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))).groupBy("g1", "g2").agg(F.min(F.struct("id", "mark")).alias("least"))
    keep = chosen.select(F.col("least.id").alias("_near_id"), F.col("least.mark").alias("_near_mark"))
    worded = F.col(id_col).isNotNull() & F.coalesce(F.col(text_col).rlike(_WORDED), F.lit(False))
    marked = docs.filter(worded).withColumn("_near_text", F.xxhash64(text_col))
    kept = marked.join(keep, (F.col(id_col) == F.col("_near_id")) & (F.col("_near_text") == F.col("_near_mark")), "left_semi").dropDuplicates([id_col, "_near_text"]).drop("_near_text")
    return kept.unionByName(docs.filter(~worded))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_near(spark.read.parquet(f"{sf_dir}/documents.parquet"))
