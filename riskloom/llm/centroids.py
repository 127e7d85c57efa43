"""Centroid clustering over whole-number vectors by an equal-average equal-variance search.

Vectors of exactly ``width`` components, none of them null, NaN or infinite, are kept; a component x
becomes the integer floor(scale * x). Centroids start as the ``k`` kept vectors with the smallest
SHA-256 of ``seed:<id>``; vectors without an id come after all others, equal hashes go by the vector
itself, and fewer than ``k`` kept vectors give fewer centroids. Each round assigns every vector to its
nearest centroid and moves every centroid that has vectors to the floor of their exact mean.

The search: centroids lie in order of the sum of their components. From the vector's own sum it goes
outward, always to the nearer of the two next centroids. With ``d`` components, sums S and deviations
D = d * (sum of squares) - S * S, the squared distance obeys

    d * distance >= (S_x - S_c)^2 + (sqrt(D_x) - sqrt(D_c))^2 .

The first term alone ends the scan, both together reject a centroid, and only what is left is measured,
in whole numbers. The roots are lowered by more than their rounding error, and a bound that equals the
best distance rejects nothing, so ties still go to the smaller number.

Whole blocks of vectors go through the scan together as 64-bit integers while no intermediate value can
overflow (components up to 2^30 / width); any larger component, up to the largest double, goes the same
way in Python's unbounded integers. Partial sums leave each task in limbs of 48 bits and are added up by
Spark as decimals, so at most ``k * (width + 1)`` sums reach the driver, exact at any size.

Empty table: an empty result. Repeated rows and repeated ids are vectors of their own. A distance, or a
sum of distances, that doesn't fit a long is null.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.scratch import saved

WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
LIMB = 48
LONG = (1 << 63) - 1


def is_kept(vector: Column, width: int = WIDTH) -> Column:
    """Exactly ``width`` components, each a finite number."""
    def finite(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return vector.isNotNull() & (F.size(vector) == width) & F.forall(vector, finite)


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), exact for every finite double."""
    top, bottom = x.as_integer_ratio()
    return scale * top // bottom


class Search:
    """Nearest centroids; distances and their ties are exact."""

    def __init__(self, centroids: list[list[int]], width: int = WIDTH):
        self.width, self.limit = width, (1 << 30) // width
        self.all = centroids
        small = [c for c in range(len(centroids)) if max(map(abs, centroids[c])) <= self.limit]
        self.large = [c for c in range(len(centroids)) if c not in small]
        self.exact = sorted((self._traits(v) + (c,) for c, v in enumerate(centroids)))
        points = np.array([centroids[c] for c in small], np.int64).reshape(-1, width)
        sums = points.sum(1)
        order = np.argsort(sums, kind="stable")
        self.number = np.array(small, np.int64)[order]
        self.points, self.sums = points[order], sums[order]
        self.spread = np.sqrt((width * (self.points * self.points).sum(1) - self.sums * self.sums).astype(float))

    def _traits(self, v: list[int]) -> tuple[int, int]:
        total = sum(v)
        return total, math.isqrt(self.width * sum(a * a for a in v) - total * total)

    def block(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Numbers and squared distances of the nearest centroids of vectors within the limit."""
        n, k = len(x), len(self.number)
        near, best = np.full(n, -1, np.int64), np.full(n, LONG // self.width, np.int64)
        sums = x.sum(1)
        spread = np.sqrt((self.width * (x * x).sum(1) - sums * sums).astype(float))
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        rows = np.arange(n)
        far = np.int64(1) << np.int64(40)
        for _ in range(k):
            down = np.where(low[rows] >= 0, sums[rows] - self.sums[np.maximum(low[rows], 0)], far)
            up = np.where(high[rows] < k, self.sums[np.minimum(high[rows], k - 1)] - sums[rows], far)
            gap, below = np.minimum(down, up), down <= up
            on = gap < far
            on[on] = gap[on] * gap[on] <= self.width * best[rows[on]]
            rows, gap, below = rows[on], gap[on], below[on]
            if not len(rows):
                break
            at = np.where(below, low[rows], high[rows])
            low[rows], high[rows] = low[rows] - below, high[rows] + ~below
            rest = np.maximum(np.abs(spread[rows] - self.spread[at]) - 2.0 ** -20, 0)
            bound = gap * gap + np.floor(rest * rest * (1 - 1e-12)).astype(np.int64)
            ok = bound <= self.width * best[rows]
            some, at = rows[ok], at[ok]
            apart = x[some] - self.points[at]
            square = (apart * apart).sum(1)
            better = (square < best[some]) | ((square == best[some]) & (self.number[at] < near[some])) | (near[some] < 0)
            near[some[better]], best[some[better]] = self.number[at[better]], square[better]
        distance = best.tolist()
        for c in self.large:
            other = np.array([max(-1e300, min(1e300, a)) for a in self.all[c]], float)
            with np.errstate(over="ignore"):
                about = ((x - other) ** 2).sum(1)
            for i in np.flatnonzero((near < 0) | (about * (1 - 1e-6) <= best)).tolist():
                true = sum((int(a) - b) ** 2 for a, b in zip(x[i], self.all[c]))
                if near[i] < 0 or (true, c) < (distance[i], near[i]):
                    near[i], distance[i] = c, true
                    best[i] = min(true, LONG)
        return near, distance

    def one(self, x: list[int]) -> tuple[int, int]:
        """The same scan in unbounded integers, for a vector with any larger component."""
        total, spread = self._traits(x)
        found = None
        for gap, c, other in sorted((abs(total - s), c, d) for s, d, c in self.exact):
            if found and gap * gap > self.width * found[0]:
                break
            rest = max(abs(spread - other) - 1, 0)
            if found and gap * gap + rest * rest > self.width * found[0]:
                continue
            square = sum((a - b) ** 2 for a, b in zip(x, self.all[c]))
            found = min(found, (square, c)) if found else (square, c)
        return found[1], found[0]

    def batch(self, column: pa.Array, scale: int = SCALE):
        """(row numbers, whole-number vectors, centroids, distances), in at most two parts."""
        raw = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, self.width)
        small = (np.abs(raw) <= (self.limit - 1) / scale).all(1)
        rows = np.flatnonzero(small)
        if len(rows):
            x = np.floor(scale * raw[rows]).astype(np.int64)
            yield rows, x, *self.block(x)
        rows = np.flatnonzero(~small)
        if len(rows):
            x = [[whole(a, scale) for a in raw[i].tolist()] for i in rows]
            found = [self.one(v) for v in x]
            yield rows, x, np.array([c for c, _ in found], np.int64), [d for _, d in found]


def limbs(value: int):
    """(place, limb) so that the limbs times 2^(LIMB * place) add up to ``value``."""
    place = 0
    while not -(1 << 62) <= value < 1 << 62:
        yield place, value & ((1 << LIMB) - 1)
        value, place = value >> LIMB, place + 1
    yield place, value


def _sums(kept: DataFrame, search: Search, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number and exact component sums of the vectors of each centroid that has any."""
    width = search.width

    def work(batches):
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for _, x, near, _ in search.batch(batch.column("vec"), scale):
                for c in np.unique(near).tolist():
                    mine = np.flatnonzero(near == c)
                    part = x[mine].sum(0).tolist() if isinstance(x, np.ndarray) else [sum(v) for v in zip(*(x[i] for i in mine))]
                    old = sums.setdefault(c, [0] * (width + 1))
                    sums[c] = [a + b for a, b in zip(old, [*part, len(mine)])]
        out = [(c, i, place, limb) for c, row in sums.items() for i, v in enumerate(row) for place, limb in limbs(v)]
        columns = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["c", "i", "place", "limb"])

    parts = (kept.select("vec").mapInArrow(work, "c long, i long, place long, limb long")
             .groupBy("c", "i", "place").agg(F.sum(F.col("limb").cast("decimal(20,0)")).alias("limb")))
    total: dict[int, list[int]] = {}
    for r in parts.collect():
        total.setdefault(r["c"], [0] * (width + 1))[r["i"]] += int(r["limb"]) << (LIMB * r["place"])
    return {c: (row[width], row[:width]) for c, row in total.items()}


def _first(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.orderBy(rank.asc_nulls_last(), F.col("vec").cast("array<double>")).limit(k).collect()
    return [[whole(a, scale) for a in r["vec"]] for r in rows]


def centroids_of(kept: DataFrame, width: int = WIDTH, scale: int = SCALE, k: int = CENTROIDS,
                 rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Centroids after ``rounds`` moves; ``kept`` has columns id and vec."""
    found = _first(kept, k, seed, scale)
    for _ in range(rounds if found else 0):
        for c, (n, row) in _sums(kept, Search(found, width), scale).items():
            found[c] = [a // n for a in row]
    return found


def clusters(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", width: int = WIDTH,
             scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    The kept vectors and their last assignment are written to the scratch folder once each.
    """
    spark = rows.sparkSession
    kept = saved(rows.select(F.col(ident).alias("id"), F.col(vector).alias("vec")).where(is_kept(F.col("vec"), width)), "kept")
    found = centroids_of(kept, width, scale, k, rounds, seed)
    kind = kept.schema["id"].dataType.simpleString()
    search = Search(found, width)

    def work(batches):
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for at, _, near, square in search.batch(batch.column("vec"), scale):
                cluster[at] = near
                for i, d in zip(at.tolist(), square):
                    distance[i] = d if d <= LONG else None
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster), pa.array(distance, pa.int64())],
                                             ["id", "cluster", "distance"])

    near = saved(kept.mapInArrow(work, f"id {kind}, cluster int, distance long"), "assigned")
    sums = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total"),
                                       F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    everything = None if any(r["lost"] for r in sums) else sum(int(r["total"]) for r in sums)
    facts = [(r["cluster"], None if r["lost"] or r["total"] > LONG else int(r["total"]),
              None if everything is None or everything > LONG else everything,
              hashlib.sha256(",".join(map(str, found[r["cluster"]])).encode()).hexdigest()) for r in sums]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (near.join(F.broadcast(table), "cluster")
            .select(F.col("id").alias(ident), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
