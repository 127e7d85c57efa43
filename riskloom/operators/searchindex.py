"""Text search over stored runs through an index of the three-letter pieces of each file.

``filters.search`` reads every column of every row. Here the distinct texts of each file are cut into
their three-letter pieces once, A-Z in lower case, and ``(piece, file)`` is stored in order of the
pieces. A search takes the texts that every match of the pattern has to hold, looks up the files that
have all their pieces, and runs the pattern over these files only, so the rows are the same.

A pattern without such a text (``a.b``, alternatives, groups) searches all files, as do files that came
after the index was made. Texts are matched without regard to case for A-Z only, as the pattern is.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.filters import search

PIECE = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Escapes of one place in a text, signs that end the reading of a pattern
CLASSES, OPEN = "dDwWsSbB", "|()[]"


def certain_texts(pattern: str) -> list[str]:
    """Texts that every match of the pattern holds; none where that is in doubt."""
    out, run, i = [], "", 0

    def close() -> str:
        if run:
            out.append(run)
        return ""

    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c in OPEN:
            return []
        if c == "\\":
            following = pattern[i:i + 1]
            i += 1
            if following in CLASSES and following:
                run = close()
                continue
            if not following or following.isalnum():
                return []
            c = following
        elif c in "*?":
            run = run[:-1]
            run = close()
            continue
        elif c == "{":
            end = pattern.find("}", i)
            if end < 0:
                return []
            run, i = run[:-1], end + 1
            run = close()
            continue
        elif c in "+.^$":
            run = close()
            continue
        run += c
    close()
    return out


def _folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def pieces(pattern: str) -> list[str]:
    """Pieces that a text must hold to match the pattern."""
    folded = [t.translate(str.maketrans(_UPPER, _LOWER)) for t in certain_texts(pattern)]
    return sorted({t[i:i + PIECE] for t in folded for i in range(len(t) - PIECE + 1)})


def build_index(df: DataFrame, path: str, cols: list[str] | None = None) -> None:
    """Indexes the files behind ``df``, which reads stored files without further steps.

    Equal texts of a file are cut once. A row with an empty piece tells that a file is covered.
    """
    texts = F.explode(F.array_distinct(F.array(*[F.col(c).cast("string") for c in cols or df.columns]))).alias("text")
    values = df.select(F.col("_metadata.file_path").alias("file"), texts).where("text is not null").distinct()
    cut = F.regexp_extract_all(_folded(F.col("text")), F.lit(f"(?s)(?=(.{{{PIECE}}}))"), F.lit(1))
    found = values.select("file", F.explode(F.array_distinct(cut)).alias("piece"))
    every = df.select(F.col("_metadata.file_path").alias("file"), F.lit("").alias("piece"))
    (found.unionByName(every).distinct().repartitionByRange("piece").sortWithinPartitions("piece", "file")
     .write.mode("errorifexists").parquet(path))


def matching_files(spark: SparkSession, df: DataFrame, path: str, pattern: str) -> list[str]:
    """The files of ``df`` that may hold a match."""
    there = {_plain(f): f for f in df.inputFiles()}
    wanted = pieces(pattern.strip())
    if not wanted:
        return sorted(there.values())
    index = spark.read.parquet(path).where(F.col("piece").isin("", *wanted))
    hits = index.groupBy("file").agg(F.count("*").alias("n")).collect()
    known = {_plain(r.file): r.n == len(wanted) + 1 for r in hits}
    return sorted(f for name, f in there.items() if known.get(name, True))


def _plain(path: str) -> str:
    """File names as both listings give them, without the slashes that they differ in."""
    scheme, _, rest = path.rpartition(":/")
    return f"{scheme}:/{rest.lstrip('/')}"


def search_indexed(spark: SparkSession, df: DataFrame, path: str, pattern: str,
                   cols: list[str] | None = None) -> DataFrame:
    """The rows of ``search(df, pattern, cols)`` for a table read from stored files."""
    files = matching_files(spark, df, path, pattern)
    if not files:
        return df.where(F.lit(False))
    if len(files) == len(df.inputFiles()):
        return search(df, pattern, cols)
    return search(spark.read.schema(df.schema).parquet(*files).select(*df.columns), pattern, cols)
