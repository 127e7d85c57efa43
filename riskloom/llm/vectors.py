"""Checked vectors of a table, and classes of equal ones."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec, dim): the raw numbers of every vector that counts.

    Left out are vectors that are null, empty, zero or hold null or non-finite numbers; an id may be
    null. Negative zeros become zeros, so that equal vectors have equal bytes.
    """
    wide = "double" in dict(rows.dtypes)[vector]
    kind = np.float64 if wide else np.float32

    def work(batches):
        for batch in batches:
            column = batch.column("vec")
            for i, id_ in zip(range(batch.num_rows), batch.column("id").to_pylist()):
                if not column[i].is_valid:
                    continue
                numbers = column[i].values
                if not len(numbers) or numbers.null_count:
                    continue
                x = numbers.to_numpy().astype(kind) + kind(0)
                if np.isfinite(x).all() and x.any():
                    yield id_, x

    def rows_of(batches):
        for batch in batches:
            found = list(work([batch]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary()),
                 pa.array([len(x) for _, x in found], pa.int32())], ["id", "vec", "dim"])

    return (rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("vec"))
            .mapInArrow(rows_of, "id long, vec binary, dim int"))


def dtype_of(rows: DataFrame, vector: str = "embedding"):
    return np.float64 if "double" in dict(rows.dtypes)[vector] else np.float32


def widths(classes: DataFrame) -> dict[int, int]:
    """The number of rows of each length; vectors of different lengths have nothing to do with each other."""
    return {r["dim"]: r["count"] for r in classes.groupBy("dim").count().orderBy("dim").collect()}


def matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(np.float64)


def by_width(batch: pa.RecordBatch, kind, vector: str = "vec"):
    """(length, its rows, their vectors as a matrix) for each length in a batch."""
    sizes = pc.binary_length(batch.column(vector)).to_numpy() // np.dtype(kind).itemsize
    for width in np.unique(sizes).tolist():
        rows = batch.filter(pa.array(sizes == width)) if len(sizes) else batch
        yield width, rows, matrix(rows.column(vector), kind, width)


def sample_of(classes: DataFrame, width: int, count: int) -> pa.Table:
    """A bounded sample that any run and any partitioning finds again: the least hashes of vectors."""
    return classes.where(F.col("dim") == width).select("same", "vec").orderBy("same").limit(count).toArrow()


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that neither large nor tiny numbers overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
