"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found in multi-index Hamming blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sunplane.llm.common import ALNUM, in_batches, run_hashes, runs, text_chunks, windows

WIDTH = 5
THRESHOLD = (4, 5)
#: Fingerprints within this many bits are candidates. Two windows whose weighted similarity is 0.8 differ in 9.7 of
#: 64 bits on average, with a deviation of 2.9; windows that are more alike differ in fewer. A shingle that is repeated pulls
#: the bag's fingerprint as often, so the set's is compared too.
RADIUS, BLOCKS = 20, 4
#: Items, and bytes of their texts, that one pass over the documents holds. More items mean more passes.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 5000, 16 << 20

_ONES = np.array([bin(k).count("1") for k in range(1 << 16)], np.uint8)


def _bits(h: np.ndarray) -> np.ndarray:
    """(n, 64) of +1 and -1, the bits of each hash."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _sign(sums: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of 64 sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def simhash(shingles: np.ndarray) -> int:
    """The fingerprint of a bag of shingles; a shingle weighs as often as it occurs."""
    return int(_sign(_bits(shingles).sum(axis=0, keepdims=True))[0])


def weighted_common(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> int:
    """The sum over shingles of the lesser weight; each side is its different shingles, sorted, and their weights."""
    at = np.searchsorted(right[0], left[0])
    at[at == len(right[0])] = 0
    same = right[0][at] == left[0]
    return int(np.minimum(left[1][same], right[1][at[same]]).sum())


def window_starts(near: np.ndarray, width: int, need: int, size: int) -> np.ndarray:
    """The starts, in 0 to size - width, of the windows of `width` that hold at least `need` of the sorted places `near`:
    those from the last of so many places less the width up to the first of them. As many numbers as there are places
    or starts are held at once."""
    if len(near) < need:
        return np.zeros(0, np.int64)
    low, high = np.maximum(near[need - 1 :] - width + 1, 0), np.minimum(near[: len(near) - need + 1], size - width)
    low, high = low[low <= high], high[low <= high]
    low[1:] = np.maximum(low[1:], high[:-1] + 1)  # both ascend, so only neighbours overlap
    low, high = low[low <= high], high[low <= high]
    sizes = high - low + 1
    return np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(low) else low


def window_prints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(starts, 2): the fingerprints of the bag and of the set of the n shingles from each start."""
    bits = _bits(shingles)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0)])
    bag = _sign(sums[starts + n] - sums[starts])
    order = np.argsort(shingles, kind="stable")
    same = np.flatnonzero(shingles[order][1:] == shingles[order][:-1])
    if not len(same):
        return np.stack([bag, bag], axis=1)
    before, after = np.full(len(shingles), -1), np.full(len(shingles), len(shingles) + n)
    before[order[same + 1]], after[order[same]] = order[same], order[same + 1]
    k = np.arange(len(shingles) - n)  # from the window at k to the next one: a shingle goes, another comes
    moves = bits[n:] * (before[n:] <= k)[:, None] - bits[: len(k)] * (after[: len(k)] >= k + n)[:, None]
    sums = np.cumsum(np.concatenate([(bits[:n] * (before[:n] < 0)[:, None]).sum(axis=0, keepdims=True, dtype=np.int32), moves]), axis=0)
    return np.stack([bag, _sign(sums[starts])], axis=1)


class WindowIndex:
    """Benchmark items of one shingle width, by the fingerprints of their bags and of their sets: for each 16-bit block the different block values and
    the items that have them. Two fingerprints within RADIUS bits agree to RADIUS // BLOCKS bits in some block,
    so visiting the values that near in every block finds all of them."""

    def __init__(self, width: int, items: list[tuple[int, int, np.ndarray]], threshold: tuple[int, int]):
        """items: row of the item, its words, its shingles."""
        self.width, self.threshold = width, threshold
        self.rows = np.array([r for r, _, _ in items])
        self.words = np.array([w for _, w, _ in items])
        self.bags = [np.unique(s, return_counts=True) for _, _, s in items]
        #: Of each item the fingerprints of its bag and of its set.
        self.prints = np.array([[simhash(s) for _, _, s in items], [simhash(b) for b, _ in self.bags]], np.uint64)
        self.known = np.unique(np.concatenate([s for _, _, s in items]))
        self.of_size = {int(n): np.isin(self.known, np.concatenate([s for _, w, s in items if w == n])) for n in np.unique(self.words)}
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.blocks: list[list] = [[], []]
        for kind in (0, 1):
            for b in range(BLOCKS):
                values = (self.prints[kind] >> np.uint64(16 * b)).astype(np.uint16)
                order = np.argsort(values, kind="stable")
                different, first = np.unique(values[order], return_index=True)
                self.blocks[kind].append((different, np.append(first, len(order)), order))

    def within(self, mark: int, kind: int = 0) -> np.ndarray:
        """The items whose fingerprint of the kind (0: bag, 1: set) is within RADIUS bits of the mark."""
        found = []
        for b, (values, first, order) in enumerate(self.blocks[kind]):
            near = np.flatnonzero(_ONES[values ^ np.uint16(mark >> (16 * b) & 0xFFFF)] <= RADIUS // BLOCKS)
            found += [order[first[k] : first[k + 1]] for k in near]
        items = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        apart = self.prints[kind, items] ^ np.uint64(mark)
        return items[sum(_ONES[(apart >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)].astype(int) for b in range(4)) <= RADIUS]

    def search(self, shingles: np.ndarray, spots: np.ndarray, which: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        """For each item that a window of one text matches: start, words, common weight, joint weight of the best
        window (the first of equals). spots: where shingles of items stand; which: which of self.known they are. A
        window with fewer shingles of items of its size than the threshold asks for matches none, so it has no
        fingerprint."""
        best: dict[int, tuple[int, int, int, int]] = {}
        num, den = self.threshold
        for words, mask in self.of_size.items():
            near, full = spots[mask[which]], words - self.width + 1
            n, need = min(full, len(shingles)), -(-num * full // den)
            if n < need or len(near) < need:
                continue
            starts = window_starts(near, n, need, len(shingles))
            breaks = np.flatnonzero(np.diff(starts) > 4 * n) + 1
            for run in np.split(starts, breaks):
                for part in np.array_split(run, -(-len(run) // 4096)) if len(run) else []:
                    low, high = part[0], part[-1] + n
                    marks, which_mark = np.unique(window_prints(shingles[low:high], part - low, n), axis=0, return_inverse=True)
                    nearby = [np.union1d(self.within(a), self.within(b, 1) if a != b else ()).astype(np.int64) for a, b in marks.tolist()]
                    nearby = [items[self.words[items] == words] for items in nearby]
                    for start, mark in zip(part, which_mark.ravel()):
                        items = [k for k in nearby[mark] if best.get(int(self.rows[k]), (0, 0, 0, 1))[2:] != (full, full)]
                        if not items:
                            continue
                        bag = np.unique(shingles[start : start + n], return_counts=True)
                        for k in items:
                            common = weighted_common(bag, self.bags[k])
                            joint = n + full - common
                            row = int(self.rows[k])
                            if common * den >= num * joint and (row not in best or common * best[row][3] > best[row][2] * joint):
                                best[row] = (int(start), n + self.width - 1, common, joint)
        return best


def build_index(texts: list[str | None], width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> list[WindowIndex]:
    """Indexes of the items, one for each shingle width: `width`, and less for items of fewer words."""
    by_width: dict[int, list] = {}
    for row, end, data, bounds in text_chunks(pa.array(texts, pa.string()), lower=True):
        starts, ends, first = runs(data, bounds, ALNUM)
        words = run_hashes(data, starts, ends)
        for k in range(end - row):
            own = words[first[k] : first[k + 1]]
            if len(own):
                w = min(width, len(own))
                by_width.setdefault(w, []).append((row + k, len(own), windows(own, w)))
    return [WindowIndex(w, items, threshold) for w, items in by_width.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row for each document and benchmark item of which it has a copy: the ids, start_word and n_words of
    the best window, and its `similarity` to the item.

    A window is as many consecutive words of a document as the item has, or the whole document if it has
    fewer. A copy is a window with a weighted Jaccard similarity (weights: occurrences) of `width`-word shingles
    of at least the threshold. Windows are fingerprinted at every word; the index returns every item within
    RADIUS bits of the bag's or the set's fingerprint, and the similarity is then exact. Of 80,000 simulated windows whose
    similarity is just 0.8, 17 were further apart than RADIUS, 0.02 %; those are missed.

    The benchmark is read in blocks of at most ITEMS_AT_ONCE items and BYTES_AT_ONCE bytes, each sent to the executors and compared with all
    documents, so what is sent is bounded whatever the benchmark's size. Nothing is shuffled.

    Items without words match nothing; items of fewer than `width` words are one shingle and match exactly;
    equal items match each; null and empty texts match nothing; a text of any length is compared whole; null
    ids stay null; rows that share an id give a row each; other columns are ignored; empty tables give no rows.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, item {benchmark.schema[item_col].dataType.simpleString()}, start_word long, n_words long, similarity double"
    arrow = to_arrow_schema(docs.select(F.col(id_col).alias("id")).schema).field(0).type, to_arrow_schema(benchmark.select(F.col(item_col).alias("id")).schema).field(0).type
    rows = in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = []
    for block in _blocks(benchmark.select(F.col(item_col).alias("item"), F.col(text_col if text_col in benchmark.columns else "text").alias("text"))):
        names, indexes = [r["item"] for r in block], build_index([r["text"] for r in block], width, threshold)
        parts.append(rows.mapInArrow(_search(names, indexes, *arrow), schema))
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], schema)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start_word", "n_words", "similarity")


def _blocks(items: DataFrame) -> Iterator[list]:
    """The benchmark's rows, up to ITEMS_AT_ONCE and BYTES_AT_ONCE (or one longer item) at a time; the driver holds one block
    and one partition of it."""
    block: list = []
    size = 0
    for r in items.toLocalIterator():
        n = len((r["text"] or "").encode())
        if block and (len(block) == ITEMS_AT_ONCE or size + n > BYTES_AT_ONCE):
            yield block
            block, size = [], 0
        block.append(r)
        size += n
    if block:
        yield block


def _search(names: list, indexes: list[WindowIndex], id_type: pa.DataType, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for row, end, data, bounds in text_chunks(batch.column(1), lower=True):
                starts, ends, first = runs(data, bounds, ALNUM)
                words = run_hashes(data, starts, ends)
                for index in indexes:
                    every = windows(words, index.width)
                    maybe = np.flatnonzero(index.filter[(every >> np.uint64(44)).astype(np.int64)])
                    at = np.searchsorted(index.known, every[maybe])
                    at[at == len(index.known)] = 0
                    there = index.known[at] == every[maybe]
                    spots, which = maybe[there], at[there]
                    for k in np.unique(np.searchsorted(first, spots, "right") - 1):
                        a, b = int(first[k]), int(first[k + 1]) - index.width + 1
                        own = slice(*np.searchsorted(spots, (a, b)))
                        for item, (start, n, common, joint) in sorted(index.search(every[a:b], spots[own] - a, which[own]).items()) if a < b else []:
                            of.append(row + k)
                            out.append((names[item], start, n, common / joint))
            if out:
                item, start, n, alike = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of, pa.int64())).cast(id_type), pa.array(item, item_type), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(alike, pa.float64())],
                    ["id", "item", "start_word", "n_words", "similarity"],
                )

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without rows that have a copy of a benchmark item. Rows that share an id are judged each by its text."""
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark")).alias("_leak")
    leaks = find_leaks(docs.select(row, F.col(text_col).alias("text")), benchmark, "_leak").select("_leak.*").distinct()
    return docs.join(leaks.select(F.col("id").alias("_leak_id"), F.col("mark").alias("_leak_mark")), F.col(id_col).eqNullSafe(F.col("_leak_id")) & (F.xxhash64(text_col) == F.col("_leak_mark")), "left_anti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
