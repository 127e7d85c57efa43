"""Nearest neighbours through shifted Hilbert curves.

Each of ``CURVES`` curves has its own random projection to ``DIMS`` dimensions and its own shift,
and orders all vectors by their place on the curve: Spark range-partitions the keys, and the rows of
a curve are numbered through. Runs of ``block_rows`` numbers are blocks. A query looks at its own
block and the two beside it on every curve, and keeps its nearest ones; what the curves found is
merged and ranked by the true distance of the original vectors in double precision.

Neighbours that are far apart on one curve are close on another. How many curves and how long blocks
have to be depends on the data; ``recall`` measures it against all rows. Blocks grow as the number
of rows to the power 0.75, so that recall holds as data of a high dimension grows. Vectors of
different lengths have no distance, so each length has curves of its own, in the same jobs.

Equal vectors are one class, known by its least ids: as many as a query can return, so a large
class neither fills the windows of others nor loses a row that belongs into a result.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part;
a query leaves out its own row only, so rows that repeat its id, and rows without an id (last among
ties), are candidates; query rows alike are queries each; fewer candidates than asked for are all
returned; an empty table gives an empty result.
"""

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.scratch import saved
from riskloom.llm.vectors import by_width, dtype_of, matrix, sample_of, valid_vectors, widths

CURVES = 28
DIMS = 8
BITS = 7
#: Rows that show how far the projections reach; vectors beyond lie at the rim of the curve's cube.
SAMPLE = 4096
LEAST_BLOCK = 64
SEED = 5
BROADCAST_RUNS = 100_000


def block_rows(total: int) -> int:
    return max(LEAST_BLOCK, ceil(0.225 * total ** 0.75))


def curve_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with ``bits``-bit coordinates, one point a row.

    The cube is halved along every axis, level by level. At each level the corner that a point lies in
    has a number in the Gray order of the curve's entry corner and direction; both are then those of
    the part of the curve that runs through the corner.
    """
    n, dims = cells.shape
    whole = (1 << dims) - 1
    entry, turn = np.zeros(n, np.int64), np.zeros(n, np.int64)
    key = np.zeros(n, np.int64)

    def rotated(x, by):  # to the right, among ``dims`` bits
        by = by % dims
        return ((x >> by) | (x << (dims - by))) & whole

    for level in range(bits - 1, -1, -1):
        corner = (((cells >> level) & 1) << np.arange(dims)).sum(1)
        gray = rotated(corner ^ entry, turn + 1)
        number = gray.copy()
        for by in (1, 2, 4, 8, 16, 32):
            if by < dims:
                number ^= number >> by
        key = key << dims | number
        # Where the curve enters that corner's own cube, and along which axis it leaves it.
        even = np.where(number > 0, (number - 1) & ~1, 0)
        start = even ^ (even >> 1)
        odd = np.where(number % 2 == 1, number, number - 1)
        axis = np.where(number == 0, 0, _trailing_ones(odd, dims) % dims)
        entry = entry ^ rotated(start, -(turn + 1))
        turn = (turn + axis + 1) % dims
    return key


def _trailing_ones(x: np.ndarray, dims: int) -> np.ndarray:
    out, on = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for k in range(dims):
        on &= (x >> k) & 1 == 1
        out += on
    return out


class Curves:
    """Projections, shifts and scales of all curves."""

    def __init__(self, sample: np.ndarray, curves: int):
        random = np.random.default_rng(SEED)
        width = sample.shape[1]
        dims = min(DIMS, width)
        self.axes = np.stack([np.linalg.qr(random.standard_normal((width, dims)))[0] for _ in range(curves)])
        self.shift = random.random((curves, dims)) / 2
        seen = np.einsum("nw,cwd->cnd", sample, self.axes)
        self.low = np.quantile(seen, 0.0005, axis=1)
        self.span = np.maximum(np.quantile(seen, 0.9995, axis=1) - self.low, 1e-300)

    def parts(self) -> tuple:
        return self.axes, self.shift, self.low, self.span


def _keys(shared, kind):
    def work(batches):
        shapes = shared.value
        for batch in batches:
            for width, rows, x in by_width(batch, kind):
                first, (axes, shift, low, span) = shapes[width]
                for c in range(len(axes)):
                    place = (x @ axes[c] - low[c]) / span[c] / 2 + shift[c]
                    cells = np.clip(place * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), first + c, np.int32)), pa.array(curve_keys(cells, BITS)),
                         rows.column("class")], ["curve", "key", "class"])
    return work


def _numbered(keys: DataFrame, tasks: int) -> DataFrame:
    """(curve, class, place): rows of each curve numbered in the order of their keys."""
    ordered = saved(keys.repartitionByRange(tasks, "curve", "key", "class")
                    .sortWithinPartitions("curve", "key", "class")
                    .select("curve", "class", F.monotonically_increasing_id().alias("at")), "curves")
    task = F.shiftright("at", 33).alias("task")
    runs = ordered.groupBy("curve", task).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    ahead = Window.partitionBy("curve").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = saved(runs.select(F.col("curve").alias("c"), F.col("task").alias("t"), "first",
                       F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead")), "runs")
    # A row for each curve and task; so few that they can be broadcast, unless there are very many tasks.
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    return (ordered.join(runs, (F.col("curve") == F.col("c")) & (F.shiftright("at", 33) == F.col("t")))
            .select("curve", "class", (F.col("ahead") + F.col("at") - F.col("first")).alias("place")))


def _nearest(kind, keep: int):
    """For each block its queries' nearest candidates; the block's queries come first."""
    def search(asked, given):
        if not asked or not given:
            return
        width = len(given[0][1]) // np.dtype(kind).itemsize
        q = matrix(pa.array([v for _, v in asked]), kind, width)
        x = matrix(pa.array([v for _, v in given]), kind, width)
        names = np.array([i for i, _ in given])
        for (own, _), row in zip(asked, q):
            away = np.sqrt(((x - row) ** 2).sum(1))
            if len(away) > keep:
                most = np.partition(away, keep - 1)[keep - 1]
                near = np.flatnonzero(away <= most)
            else:
                near = np.arange(len(away))
            near = near[np.lexsort((names[near], away[near]))][:keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(near), own)), pa.array(names[near]), pa.array(away[near])], ["query", "class", "score"])

    def work(batches):
        key, asked, given = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("curve", "block", "asks", "class", "vec")]
            for curve, block, asks, name, vec in zip(*columns):
                if (curve, block) != key:
                    yield from search(asked, given)
                    key, asked, given = (curve, block), [], []
                (asked if asks else given).append((name, vec))
        yield from search(asked, given)
    return work


def nearest(rows: DataFrame, is_query: Column, k: int = 10, curves: int = CURVES, ident: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each query.

    ``is_query`` is a condition on the column ``id``, the row's id.
    """
    spark, kind = rows.sparkSession, dtype_of(rows, vector)
    vectors = saved(valid_vectors(rows, ident, vector), "vectors").withColumn("same", F.md5("vec"))
    first = Window.partitionBy("same").orderBy(F.col("id").asc_nulls_last())
    least = vectors.select("same", "id").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    ids = least.groupBy("same").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("ids"))
    # Of rows with equal ids the first one stands for a query's own row.
    ids = ids.select("same", F.transform("ids", lambda x, i: F.struct(x["id"].alias("id"), (
        (i == 0) | ~x["id"].eqNullSafe(F.get("ids", i - 1)["id"])).alias("leads"))).alias("ids"))
    bodies = vectors.groupBy("same").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    classes = saved(ids.join(bodies, "same"), "vector_classes")
    totals = widths(classes)
    if not totals:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = sum(totals.values())
    tasks = max(8, ceil(total * curves / 500_000))
    # An id may be null or name several vectors, so classes go by numbers, in the order of their least ids.
    least_first = [F.col("ids")[0]["id"].asc_nulls_last(), F.col("same")]
    classes = saved(classes.repartitionByRange(tasks, *least_first).sortWithinPartitions(*least_first)
                    .withColumn("class", F.monotonically_increasing_id()), "numbered_classes")
    shapes = {}
    for n, width in enumerate(totals):
        sample = matrix(sample_of(classes, width, SAMPLE).column("vec").combine_chunks(), kind, width)
        shapes[width] = n * curves, Curves(sample, curves).parts()
    keys = classes.select("class", "vec").mapInArrow(
        _keys(spark.sparkContext.broadcast(shapes), kind), "curve int, key long, class long")
    sizes = F.array(*[F.lit(block_rows(n)).cast("long") for n in totals.values()])
    size = F.get(sizes, F.floor(F.col("curve") / curves).cast("int"))
    blocks = _numbered(keys, tasks).groupBy("class").agg(F.collect_list(F.struct(
        "curve", F.floor(F.col("place") / size).alias("block"))).alias("blocks"))
    queries = saved(vectors.where(is_query).groupBy("same", F.col("id").alias("query_id")).agg(F.count("*").alias("times"))
                    .join(classes.select(F.col("same").alias("its"), "class"), F.col("same") == F.col("its"))
                    .select("query_id", "class", "times"), "queries")
    asking = queries.select(F.col("class").alias("asking")).distinct()
    placed = (classes.select("class", "vec").join(blocks.withColumnRenamed("class", "of"), F.col("class") == F.col("of"))
              .join(asking, F.col("class") == F.col("asking"), "left")
              .select("class", "vec", "blocks", F.col("asking").isNotNull().alias("asks")))
    given = F.transform("blocks", lambda b: F.struct(b["curve"].alias("curve"), b["block"].alias("block"), F.lit(0).alias("asks")))
    asked = F.flatten(F.transform("blocks", lambda b: F.array(*[F.struct(
        b["curve"].alias("curve"), (b["block"] + d).alias("block"), F.lit(1).alias("asks")) for d in (-1, 0, 1)])))
    sent = (placed.select("class", "vec", F.explode(F.when(F.col("asks"), F.concat(given, asked)).otherwise(given)).alias("at"))
            .select("at.curve", "at.block", "at.asks", "class", "vec"))
    met = (sent.repartition(max(8, ceil(total * curves / 100_000)), "curve", "block")
           .sortWithinPartitions("curve", "block", F.desc("asks"), "class")
           .mapInArrow(_nearest(kind, k + 1), "query long, class long, score double"))
    best = Window.partitionBy("query").orderBy("score", "class")
    found = (met.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
             .select("query", "class", "score"))
    listed = (found.join(classes.select(F.col("class").alias("its"), "ids"), F.col("class") == F.col("its"))
              .select("query", "its", "score", F.explode("ids").alias("one")))
    own = (F.col("its") == F.col("class")) & F.col("one.id").eqNullSafe(F.col("query_id")) & F.col("one.leads")
    order = Window.partitionBy("query_id", "class").orderBy("score", F.col("one.id").asc_nulls_last())
    ranked = (queries.join(listed, F.col("class") == F.col("query")).where(~own)
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return (ranked.withColumn("each", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("one.id").alias("vec_id"), "score"))


def recall(rows: DataFrame, queries: int = 200, k: int = 10, ident: str = "vec_id", vector: str = "embedding",
           **more) -> float:
    """The share of the true nearest rows that ``nearest`` finds, over a bounded set of queries.

    Queries are the ``queries`` rows of least hash. Their true neighbours come from a pass over all rows:
    every task measures its rows against the broadcast queries, a batch at a time, and keeps the ``k``
    nearest of each. A found row counts if it is no farther than the true ``k``-th one; without
    candidates recall is 1. Ids must be unique.
    """
    spark, kind = rows.sparkSession, dtype_of(rows, vector)
    vectors = saved(valid_vectors(rows, ident, vector), "vectors").where("id is not null")
    asked = vectors.orderBy(F.xxhash64("id"), "id").limit(queries).toArrow()
    if not asked.num_rows:
        return 1.0
    wanted: dict = {}
    for batch in asked.to_batches():
        for width, own, x in by_width(batch, kind):
            ids, old = wanted.get(width, (np.zeros(0, np.int64), np.zeros((0, width))))
            wanted[width] = np.concatenate([ids, own.column("id").to_numpy()]), np.concatenate([old, x])
    shared = spark.sparkContext.broadcast(wanted)

    def measure(batches):
        for batch in batches:
            for width, own, x in by_width(batch, kind):
                if width not in shared.value:
                    continue
                ids = own.column("id").to_numpy()
                for query, v in zip(*shared.value[width]):
                    away = np.sqrt(((x - v) ** 2).sum(1))
                    away[ids == query] = np.inf
                    near = np.sort(away)[:k]
                    near = near[np.isfinite(near)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), query)), pa.array(near)], ["query", "score"])

    best = Window.partitionBy("query").orderBy("score")
    true = (vectors.mapInArrow(measure, "query long, score double")
            .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
            .groupBy("query").agg(F.count("*").alias("all"), F.max("score").alias("farthest")))
    chosen = [int(i) for ids, _ in wanted.values() for i in ids]
    found = nearest(rows, F.col("id").isin(chosen), k, ident=ident, vector=vector, **more)
    hits = (true.join(found, F.col("query") == F.col("query_id"), "left").groupBy("query", "all")
            .agg(F.count(F.when(F.col("score") <= F.col("farthest"), 1)).alias("hit"))
            .agg(F.sum("hit"), F.sum("all")).first())
    return hits[0] / hits[1] if hits[1] else 1.0
