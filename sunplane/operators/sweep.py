"""How many points a plane needs: least-squares planes of ever larger drawn subsets of each polygon's points.

A trial orders a polygon's points by a hash that doesn't depend on the polygon, and its subsets are the first points of that
order. So polygons near each other share one group with the points around them; each point is hashed once for each trial, and no
row is written for a polygon and a point, nor for a trial.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window

from sunplane.functions import shapes
from sunplane.operators.planes import clips, in_order
from sunplane.operators.points import by_home
from sunplane.staging import discard, staged

#: Polygons up to which all values are kept for the percentiles; of more, a part of about half as many tells where they lie.
ALL_KEPT = 65_536
#: Equal bins that the values around a percentile are counted in.
BINS = 1 << 16
#: Points drawn that the kernel takes at once, nine numbers each.
AT_ONCE = 1 << 15

ROTATIONS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]

Range = tuple[float, float]
MEASURES = ("tilt", "error")
PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def md5_words(words: list[np.ndarray | None], shape: tuple) -> list[np.ndarray]:
    """The digests' four words of one-block messages: sixteen words each, padding and length included, that broadcast to the shape;
    None is zero."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        turn = i // 16
        at = (i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += SINES[i]
        if words[at] is not None:
            f += words[at]
        by = ROTATIONS[turn][i % 4]
        np.left_shift(f, np.uint32(by), out=g)
        f >>= np.uint32(32 - by)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [v + s for v, s in zip((a, b, c, d), START)]


class Hashes:
    """The order of points in each trial k: md5 of `k:floor(10000 x):floor(10000 y)`, told by its first eight bytes."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        whole = [pa.array(np.floor(v * 10000).astype(np.int64)).cast(pa.string()) for v in (x, y)]
        self.texts = pc.binary_join_element_wise(*whole, ":")
        self.size = len(x)
        self.laid: dict[int, list[np.ndarray | None]] = {}

    def _words(self, start: int) -> list[np.ndarray | None]:
        """The words of the messages, `start` bytes left free before each."""
        if start not in self.laid:
            offsets, data = (np.frombuffer(b, t) for b, t in zip(self.texts.buffers()[1:], (np.int32, np.uint8)))
            lengths = np.diff(offsets[: self.size + 1])
            block = np.zeros((self.size, 64), np.uint8)
            block[:, start:][np.arange(64 - start) < lengths[:, None]] = data[offsets[0] : offsets[self.size]]
            block[np.arange(self.size), start + lengths] = 0x80
            words = np.ascontiguousarray(block.view("<u4").T)
            words[14] = 8 * (start + lengths)
            self.laid[start] = [w if w.any() else None for w in words]
        return self.laid[start]

    def keys(self, first: int, last: int) -> np.ndarray:
        """(last - first, points): numbers that sort as the first eight bytes of the digests of trials first..last."""
        out = np.empty((last - first, self.size), np.uint64)
        k = first
        while k < last:
            digits = len(str(k))
            end = min(last, 10**digits, k + max(1, 8192 // max(1, self.size)))
            heads = np.zeros((end - k, 64), np.uint8)
            for i in range(k, end):
                heads[i - k, : digits + 1] = list(f"{i}:".encode())
            heads = heads.view("<u4")
            words = self._words(digits + 1)
            for at in range(0, self.size, 8192):
                part = [w if w is None else w[None, at : at + 8192] for w in words]
                part = [w if not h.any() else h[:, None] if w is None else w | h[:, None] for w, h in zip(part, heads.T)]
                a, b, _, _ = md5_words(part, (end - k, len(self.texts[at : at + 8192])))
                out[k - first : end - first, at : at + 8192] = a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()
            k = end
        return out

    def text(self, k: int, i: int) -> str:
        return f"{k}:{self.texts[i].as_py()}"


def drawn(keys: np.ndarray, most: int, at: np.ndarray, hashes: Hashes, first: int) -> np.ndarray:
    """(trials, most): the places in `at` of the first points in each trial's order. keys: those of the points `at`, which are in
    order themselves; the low bits make room for the place, and where that leaves two keys alike the whole digests tell."""
    bits = np.uint64(max(1, (len(at) - 1).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((keys & ~mask) | np.arange(len(at), dtype=np.uint64), axis=1)
    out = (packed & mask).astype(np.intp)
    packed >>= bits
    for t in np.flatnonzero((packed[:, 1:] == packed[:, :-1]).any(axis=1)):
        alike = packed[t, 1:] == packed[t, :-1]
        near = np.flatnonzero(np.concatenate([alike, [False]]) | np.concatenate([[False], alike]))
        order = sorted(near, key=lambda j: (packed[t, j], hashlib.md5(hashes.text(first + t, at[out[t, j]]).encode()).hexdigest(), out[t, j]))
        out[t, near] = out[t, order]
    return out[:, :most]


def least_normals(n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(3, fits): angles.least_variance_normal of fits to n points with the sums (9, fits) of x, y, z, xx, xy, xz, yy, yz, zz; nan
    where the points are all in one spot."""
    x, y, z = sums[:3] / n
    xx, xy, xz, yy, yz, zz = sums[3:] / n
    xx, xy, xz, yy, yz, zz = xx - x * x, xy - x * y, xz - x * z, yy - y * y, yz - y * z, zz - z * z
    with np.errstate(divide="ignore", invalid="ignore"):
        q = (xx + yy + zz) / 3
        a, d, f = xx - q, yy - q, zz - q
        p = np.sqrt((a * a + d * d + f * f + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
        p[~((p > 0) & (q > 0))] = np.nan
        half = (a * (d * f - yz * yz) - xy * (xy * f - yz * xz) + xz * (xy * yz - d * xz)) / (2 * p**3)
        least = q + 2 * p * np.cos(np.arccos(np.clip(half, -1.0, 1.0)) / 3 + 2 * math.pi / 3)
        a, d, f = xx - least, yy - least, zz - least
        crosses = [(xy * yz - xz * d, xz * xy - a * yz, a * d - xy * xy), (xy * f - xz * yz, xz * xz - a * f, a * yz - xy * xz), (d * f - yz * yz, yz * xz - xy * f, xy * yz - d * xz)]
        best, size = np.array(crosses[0]), sum(v * v for v in crosses[0])
        for c in crosses[1:]:
            other = sum(v * v for v in c)
            longer = other > size
            for v, w in zip(best, c):
                v[longer] = w[longer]
            size = np.maximum(size, other)
        size[~(size > 0)] = np.nan
        best /= np.sqrt(size) * np.where(best[2] < 0, -1.0, 1.0)
    return best


def _wrap(degrees: np.ndarray) -> np.ndarray:
    return degrees - 360.0 * np.floor(degrees / 360.0)


RESULT = pa.schema(
    [("n", pa.int32()), ("polygons", pa.int64()), ("trials", pa.int64()), ("sines", pa.float64()), ("cosines", pa.float64())]
    + [(f"{m}_{k}", t) for m in MEASURES for k, t in (("n", pa.int64()), ("sum", pa.float64()), ("squares", pa.float64()), ("below", pa.list_(pa.int64())), ("inside", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())))]
)


def _row(n: int, polygons: int, tilt: np.ndarray, azimuth: np.ndarray, error: np.ndarray, ranges: dict[tuple[int, str], list[Range]]) -> dict:
    """What a group tells of one size: counts, sums, and the values within the ranges."""
    out = {"n": n, "polygons": polygons, "trials": len(tilt), "sines": float(np.nansum(np.sin(np.radians(azimuth)))), "cosines": float(np.nansum(np.cos(np.radians(azimuth))))}
    for measure, v in zip(MEASURES, (tilt, error)):
        v = np.sort(v[~np.isnan(v)])
        spans = [(np.searchsorted(v, lo, "left"), np.searchsorted(v, hi, "right")) for lo, hi in ranges.get((n, measure), [(-math.inf, math.inf)])]
        told = {"n": len(v), "sum": float(v.sum()), "squares": float((v * v).sum()), "below": [int(a) for a, _ in spans], "inside": [int(b - a) for a, b in spans], "values": np.concatenate([v[a:b] for a, b in spans])}
        out |= {f"{measure}_{k}": t for k, t in told.items()}
    return out


def _kernel(key: str, sizes: Sequence[int], trials: int, least: int, erosion: float, ranges: dict[tuple[int, str], list[Range]]):
    sizes = np.array(sorted(set(sizes)))

    def run(k: tuple, table: pa.Table, shape: pa.Table) -> pa.Table:
        if not len(table) or not len(shape):
            return RESULT.empty_table()
        pts = in_order(np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1))
        parts: dict = {}
        for i, ident in enumerate(shape.column(key).to_pylist()):
            parts.setdefault(ident, []).append(i)
        bounds = np.stack([shape.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1)
        edges, truth = shape.column("edges").to_pylist(), shape.column("true_azimuth").to_numpy()
        wanted = []
        for own in parts.values():
            inside = []
            for i in own:
                a, b = np.searchsorted(pts[:, 0], bounds[i, 0], "left"), np.searchsorted(pts[:, 0], bounds[i, 2], "right")
                inside.append(a + np.flatnonzero(clips(bounds[i], edges[i], erosion, pts[a:b, 0], pts[a:b, 1])))
            at = inside[0] if len(own) == 1 else np.sort(np.concatenate(inside))
            if len(at) >= max(least, sizes[0]):
                wanted.append((at, truth[own]))
        if not wanted:
            return RESULT.empty_table()
        used = np.zeros(len(pts), bool)
        for at, _ in wanted:
            used[at] = True
        place, pts = np.cumsum(used) - 1, pts[used]
        wanted = [(place[at], true) for at, true in wanted]
        hashes, measured, room = Hashes(pts[:, 0], pts[:, 1]), [], np.empty(9 * max(AT_ONCE, int(sizes[-1])))
        step = max(1, min(trials, 64 * AT_ONCE // len(pts)))
        for first in range(0, trials, step):
            last = min(trials, first + step)
            keys, waiting, held = hashes.keys(first, last), [], 0
            for at, true in wanted:
                fits = sizes[sizes <= len(at)]
                few = max(1, AT_ONCE // int(fits[-1]))
                for a in range(0, last - first, few):
                    sums = _sums(pts, at, fits, keys[a : a + few], hashes, first + a, room)
                    waiting += [(fits, angle, sums) for angle in true.tolist()]
                    held += len(true) * sums.shape[1]
                    if held >= 16384:
                        measured.append(_angles(waiting))
                        waiting, held = [], 0
            if waiting:
                measured.append(_angles(waiting))
        n, *values = (np.concatenate(v) for v in zip(*measured))
        rows = []
        for size in sizes.tolist():
            polygons = sum(len(true) for at, true in wanted if len(at) >= size)
            if polygons:
                rows.append(_row(size, polygons, *(v[n == size] for v in values), ranges))
        return pa.Table.from_pylist(rows, RESULT)

    return run


def _sums(pts: np.ndarray, at: np.ndarray, fits: np.ndarray, keys: np.ndarray, hashes: Hashes, first: int, room: np.ndarray) -> np.ndarray:
    """(9, sizes * trials): the sums of the first points, as least_normals takes them, about one of the points. room: where to
    work, in the processor's cache."""
    most = int(fits[-1])
    order = drawn(np.take(keys, at, axis=1), most, at, hashes, first)
    own = pts[at]
    moments = room[: 9 * order.size].reshape(9, *order.shape)
    for v, out in zip(np.ascontiguousarray((own - own[len(own) // 2]).T), moments):
        np.take(v, order, out=out, mode="clip")
    for (i, j), out in zip(PAIRS, moments[3:]):
        np.multiply(moments[i], moments[j], out=out)
    sums = np.add.reduceat(moments, np.concatenate([[0], fits[:-1]]), axis=2)
    np.cumsum(sums, axis=2, out=sums)
    squares = sums[3] + sums[6] + sums[8]
    centred = squares - (sums[0] ** 2 + sums[1] ** 2 + sums[2] ** 2) / fits
    for t, s in np.argwhere(~(centred > 1e-9 * squares)):
        d = (own[order[t, : fits[s]]] - own[order[t, 0]]).T  # close together: about the first of them
        sums[:, t, s] = [*d.sum(axis=1), *((d[i] * d[j]).sum() for i, j in PAIRS)]
    return sums.transpose(0, 2, 1).reshape(9, -1)


def _angles(waiting: list[tuple[np.ndarray, float, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Size, tilt, azimuth and its error of the planes with these sums."""
    n = np.concatenate([np.repeat(fits, s.shape[1] // len(fits)) for fits, _, s in waiting])
    true = np.repeat([angle for _, angle, _ in waiting], [s.shape[1] for _, _, s in waiting])
    x, y, z = least_normals(n, np.concatenate([s for _, _, s in waiting], axis=1))
    azimuth = _wrap(np.degrees(np.arctan2(x, y)))
    return n, np.degrees(np.arctan2(np.hypot(x, y), z)), azimuth, _wrap(azimuth - true + 180.0) - 180.0


def size_sweep(points: DataFrame, polygons: DataFrame, sizes: Sequence[int], trials: int, least: int = 20, erosion: float = 0.15, key: str = "polygon_id") -> DataFrame:
    """For each size n the trials of all polygons (key, edges, x0..y1, true_azimuth) with n and `least` points inside, as clip
    tells: the mean, sample deviation, 10th and 90th percentile of tilt, the deviation of the azimuth error, its 10th and 90th
    percentile, and the circular deviation of azimuth. One row for each size that some polygon has points for. Coordinates
    aren't null.

    Percentiles are exact. Of many polygons, a part of the groups is measured first to tell where the percentiles lie; the pass
    over all then keeps the values there and counts those below. Where a percentile lies elsewhere after all, the pass is done
    again with all values of that size kept."""
    box = F.coalesce(shapes.is_box(F.col("edges"), *map(F.col, ("x0", "y0", "x1", "y1"))), F.lit(False))
    told = polygons.select(key, "x0", "y0", "x1", "y1", F.when(~box, F.col("edges")).alias("edges"), "true_azimuth")
    dealt, housed = by_home(points.select("x", "y", "z"), told, key, block=100.0)
    share = polygons.count() // (ALL_KEPT // 2)
    if share > 1:
        dealt, housed = staged(dealt, "dealt"), staged(housed, "housed")

    def measured(ranges: dict, part: bool = False) -> DataFrame:
        p, h = ([df.filter(F.pmod(F.xxhash64("home", "part"), F.lit(share)) == 0) for df in (dealt, housed)] if part else (dealt, housed))
        return staged(p.groupBy("home", "part").cogroup(h.groupBy("home", "part")).applyInArrow(_kernel(key, sizes, trials, least, erosion, ranges), from_arrow_schema(RESULT)), "sweep")

    ranges = _around(measured({}, True)) if share > 1 else {}
    while True:
        result = measured(ranges)
        told = _told(result)
        missed = {(n, m): [(-math.inf, math.inf)] for n, one in told.items() for m in MEASURES if any(_rank(one, m, r) is None for _, rs in _ranks(one, m) for r in rs)}
        if not missed:
            return _table(result, told)
        discard(result)
        ranges |= missed


def _told(result: DataFrame) -> dict[int, dict]:
    """The sums of each size."""
    plain = ["polygons", "trials", "sines", "cosines"] + [f"{m}_{k}" for m in MEASURES for k in ("n", "sum", "squares")]
    lists = [F.sum(F.get(f"{m}_{k}", F.lit(i))).alias(f"{m}_{k}_{i}") for m in MEASURES for k in ("below", "inside") for i in (0, 1)]
    ends = [f(g(f"{m}_values")).alias(f"{m}_{k}") for m in MEASURES for k, f, g in (("min", F.min, F.array_min), ("max", F.max, F.array_max))]
    return {r["n"]: r.asDict() for r in result.groupBy("n").agg(*[F.sum(c).alias(c) for c in plain], *lists, *ends).collect()}


def _ranks(one: dict, measure: str) -> list[tuple[float, list[int]]]:
    """For the 10th and 90th percentile its place among the values, and the ranks of the values on either side."""
    places = [(one[f"{measure}_n"] - 1) * p for p in (0.1, 0.9)] if one[f"{measure}_n"] else []
    return [(at, [math.floor(at), math.ceil(at)]) for at in places]


def _rank(one: dict, measure: str, rank: int) -> int | None:
    """A value's rank among those kept, if it is kept."""
    before = 0
    for i in (0, 1):
        below, inside = one[f"{measure}_below_{i}"], one[f"{measure}_inside_{i}"]
        if below is not None and below <= rank < below + inside:
            return before + rank - below
        before += inside or 0
    return None


def _around(result: DataFrame) -> dict[tuple[int, str], list[Range]]:
    """Where each size's percentiles lie, as far as this part of the polygons tells: six deviations of a share of so many polygons
    to either side, as a polygon's trials are much alike."""
    off = {r["n"]: 6 * math.sqrt(0.09 / r["polygons"]) + 0.0005 for r in result.groupBy("n").agg(F.sum("polygons").alias("polygons")).collect()}
    ends = {n: [0.1 - o, 0.1 + o, 0.9 - o, 0.9 + o] for n, o in off.items()}
    every = sorted({min(1.0, max(0.0, e)) for es in ends.values() for e in es})
    found = _lists(result).select("n", "measure", F.explode("values").alias("v")).groupBy("n", "measure").agg(F.percentile_approx("v", every, 20_000).alias("at")).collect() if every else []
    out = {}
    for r in found:
        at = dict(zip(every, r["at"]))
        lo, a, b, hi = (at[e] if 0 < e < 1 else math.copysign(math.inf, e - 0.5) for e in ends[r["n"]])
        out[r["n"], r["measure"]] = [(lo, hi)] if a >= b else [(lo, a), (b, hi)]
    discard(result)
    return out


def _lists(result: DataFrame) -> DataFrame:
    """The kept values: n, measure, values."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_values").alias("values")) for m in MEASURES]))
    return result.select("n", each.alias("e")).select("n", "e.*")


def _selected(result: DataFrame, told: dict[int, dict]) -> dict[tuple[int, str, int], float]:
    """The kept values of the ranks that the percentiles ask for: counted in bins, then sorted in the bins that hold them."""
    spark = result.sparkSession
    wanted = [(n, m, _rank(one, m, r)) for n, one in told.items() for m in MEASURES for r in sorted({r for _, rs in _ranks(one, m) for r in rs})]
    if not wanted:
        return {}
    ends = F.broadcast(spark.createDataFrame([(n, m, one[f"{m}_min"], one[f"{m}_max"]) for n, one in told.items() for m in MEASURES if one[f"{m}_n"]], "n int, measure string, lo double, hi double"))
    lists = _lists(result).join(ends, ["n", "measure"])
    values = lists.select("n", "measure", "lo", "hi", F.explode("values").alias("v"))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(BINS)))).otherwise(F.lit(0)).cast("int")
    binned = values.select("n", "measure", "v", at.alias("bin"))
    asked = F.broadcast(spark.createDataFrame(wanted, "n int, measure string, rank long"))
    before = lambda *order: F.sum("count").over(Window.partitionBy("n", "measure").orderBy(*order)) - F.col("count")
    holds = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("count"))
    bins = binned.groupBy("n", "measure", "bin").count().withColumn("before", before("bin")).join(asked, ["n", "measure"]).filter(holds).select("n", "measure", "bin", "before", "rank").collect()
    held = F.broadcast(spark.createDataFrame(sorted({(b["n"], b["measure"], b["bin"], b["before"]) for b in bins}), "n int, measure string, bin int, first long"))
    inner = F.sum("count").over(Window.partitionBy("n", "measure", "bin").orderBy("v")) - F.col("count") + F.col("first")
    found = binned.join(held, ["n", "measure", "bin"]).groupBy("n", "measure", "bin", "first", "v").count().withColumn("before", inner)
    return {(r["n"], r["measure"], r["rank"]): r["v"] for r in found.join(asked, ["n", "measure"]).filter(holds).select("n", "measure", "rank", "v").collect()}


def _table(result: DataFrame, told: dict[int, dict]) -> DataFrame:
    kept = _selected(result, told)
    rows = []
    for n, one in sorted(told.items()):
        row = {"n": n, "trials": one["trials"]}
        for m, name in (("tilt", "tilt"), ("error", "azimuth_error")):
            count, total = one[f"{m}_n"], one[f"{m}_sum"]
            row[f"{name}_mean"] = total / count if count else None
            row[f"{name}_std"] = math.sqrt(max(0.0, one[f"{m}_squares"] - total * total / count) / (count - 1)) if count > 1 else None
            for p, (at, (low, high)) in zip((10, 90), _ranks(one, m)):
                a, b = (kept[n, m, _rank(one, m, r)] for r in (low, high))
                row[f"{name}_p{p}"] = a + (b - a) * (at - low)
        r = min(1.0, math.hypot(one["sines"], one["cosines"]) / one["tilt_n"]) if one["tilt_n"] else 0.0
        row["azimuth_circular_std"] = math.degrees(math.sqrt(-2.0 * math.log(r))) if r > 0 else None
        rows.append(tuple(row.get(c) for c in COLUMNS))
    discard(result)
    return result.sparkSession.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'n' else 'long' if c == 'trials' else 'double'}" for c in COLUMNS))


COLUMNS = ("n", "trials", "tilt_mean", "tilt_std", "tilt_p10", "tilt_p90", "azimuth_error_std", "azimuth_error_p10", "azimuth_error_p90", "azimuth_circular_std")
