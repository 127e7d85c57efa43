"""Matching of unknown column names to the required ones, for many files in one job.

Input is a table of column names ``(file_id, pos, name)``. The required side is a fixed list of
twelve names, so a name is scored against all of it inside its own row; the best source per
(file, required column) is picked by an aggregation that combines before its shuffle.
"""

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schema
from riskloom.functions.text import bigrams, normalise, similarity_of

THRESHOLD = 0.60


class MappingConflict(ValueError):
    """One source column is mapped to two required columns."""


def synonym_dimension(spark: SparkSession) -> DataFrame:
    """Known spellings, one row each: ``(required, synonym, synonym_norm)``."""
    rows = [(req, syn) for req, syns in schema.SYNONYMS.items() for syn in syns]
    return spark.createDataFrame(rows, "required string, synonym string").withColumn(
        "synonym_norm", normalise(F.col("synonym")))


def synonym_hits(names: DataFrame) -> DataFrame:
    """Names that are a known spelling; the dimension is a fixed list of 95 rows."""
    dim = synonym_dimension(names.sparkSession).select("required", "synonym_norm").distinct()
    return (names.withColumn("synonym_norm", normalise(F.col("name")))
            .join(F.broadcast(dim), "synonym_norm"))


def _required_array() -> Column:
    entries = []
    for req in schema.REQUIRED:
        norm = req.lower()      # required names are plain ASCII already
        grams = sorted({norm[i:i + 2] for i in range(len(norm) - 1)})
        entries.append(F.struct(
            F.lit(req).alias("required"), F.lit(norm).alias("norm"),
            F.array(*[F.lit(g) for g in grams]).alias("grams"),
            F.array(*[normalise(F.lit(s)) for s in schema.SYNONYMS[req]]).alias("spellings")))
    return F.array(*entries)


def judged_names(names: DataFrame, threshold: float = THRESHOLD,
                 strict: bool = False) -> DataFrame:
    """Every distinct name once, with the array of required columns it may stand for."""
    prepared = (names.select("name").distinct()
                .withColumn("_norm", normalise(F.col("name")))
                .withColumn("_grams", bigrams(F.col("_norm"))))

    def shared(r: Column) -> Column:
        return F.struct(r.alias("r"), F.size(F.array_intersect(r.grams, F.col("_grams")))
                        .alias("shared"))

    def judge(x: Column) -> Column:
        r = x["r"]
        score = similarity_of(r["norm"], F.col("_norm"), F.size(r["grams"]), F.size("_grams"),
                              x["shared"], 0 if strict else 2)
        exact = r["required"] == F.col("name")
        spelled = F.array_contains(r["spellings"], F.col("_norm"))
        return F.struct(
            r["required"].alias("required"),
            F.when(exact, 1).when(spelled, 2).otherwise(3).alias("prio"),
            F.when(exact, 1.0).when(spelled, 0.95).otherwise(score).alias("score"))

    judged = F.filter(F.transform(F.transform(_required_array(), shared), judge),
                      lambda x: x["score"] >= threshold)
    # no filter on empty arrays here: it would be pushed below the distinct, onto every row
    return prepared.select("name", judged.alias("_judged"))


def candidates(names: DataFrame, threshold: float = THRESHOLD,
               strict: bool = False) -> DataFrame:
    """Possible sources per required column: ``prio`` 1 exact, 2 known spelling, 3 similar.

    Headers repeat the same names over and over, so each distinct name is scored once and
    joined back; adaptive execution broadcasts the scored names if they turn out small and
    splits a name that fills a partition otherwise. ``strict`` lets names of no or one letter
    count as contained in others. A name without candidates keeps a row with null ``required``.
    """
    scored = names.join(judged_names(names, threshold, strict), "name", "left")
    return (scored.select("file_id", "pos", "name", F.explode_outer("_judged").alias("c"))
            .select("file_id", "pos", "name", "c.*"))


def best_sources(names: DataFrame, threshold: float = THRESHOLD,
                 strict: bool = False) -> DataFrame:
    """Best source per (file, required): exact, then first known spelling, then most similar,
    the first in file order on a tie. Files without any match keep one row of nulls."""
    pick = F.min_by(F.struct("name", "score", "prio"),
                    F.struct("prio", -F.col("score"), F.col("pos"), F.col("name")))
    best = candidates(names, threshold, strict).groupBy("file_id", "required").agg(
        pick.alias("b"))
    method = F.element_at(F.create_map(*chain.from_iterable(
        (F.lit(k), F.lit(v)) for k, v in {1: "exacta", 2: "sinonimo", 3: "similar"}.items())),
        F.col("b.prio"))
    hit = F.col("required").isNotNull()
    return best.select(
        "file_id", "required", F.when(hit, F.col("b.name")).alias("name"),
        F.when(hit, F.col("b.score")).alias("score"), F.when(hit, method).alias("method"))


def match_columns(names: DataFrame, threshold: float = THRESHOLD,
                  strict: bool = False) -> DataFrame:
    return best_sources(names, threshold, strict).filter(F.col("required").isNotNull())


def mapping_verdicts(best: DataFrame) -> DataFrame:
    """Verdict per file over ``best_sources``; at most twelve entries are gathered per file."""
    wanted = len(schema.REQUIRED)
    per_file = best.groupBy("file_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("required").isNotNull(), F.struct(
            "required", "name")))).alias("mapeo"))

    def distinct_sources(entries: Column) -> Column:
        return F.size(F.array_distinct(F.transform(entries, lambda m: m["name"]))).cast("long")

    changed = F.filter("mapeo", lambda m: m["name"] != m["required"])
    counted = per_file.select(
        "file_id", "mapeo", F.size("mapeo").cast("long").alias("n_encontradas"),
        distinct_sources(changed).alias("n_renombradas"),
        distinct_sources(F.col("mapeo")).alias("_sources"))
    found, renamed = F.col("n_encontradas"), F.col("n_renombradas")
    verdict = (F.when((found == wanted) & (renamed == 0), F.lit("ok"))
               .when(found == wanted, F.lit("auto"))
               .when(found * 2 >= wanted, F.lit("parcial"))
               .when(found > 0, F.lit("vacio")).otherwise(F.lit("imposible")))
    missing = F.array_except(F.array(*[F.lit(r) for r in schema.REQUIRED]),
                             F.transform("mapeo", lambda m: m["required"]))
    out = counted.select(
        "file_id", verdict.alias("estado"), "n_encontradas", "n_renombradas",
        (found > F.col("_sources")).cast("int").alias("conflicto"), "mapeo",
        missing.alias("faltantes"))
    left, texts = wanted - found, schema.MAPPING_TEXTS
    values = {"ok": [], "auto": [renamed], "parcial": [found, F.lit(wanted), left],
              "vacio": [found, left], "imposible": []}
    message = F.lit(None).cast("string")
    for state, numbers in values.items():
        text = F.format_string(texts[state], *numbers) if numbers else F.lit(texts[state])
        message = F.when(F.col("estado") == state, text).otherwise(message)
    return out.withColumn("mensaje", message)


def merge_manual(best: DataFrame, manual: DataFrame, names: DataFrame) -> DataFrame:
    """Automatic mapping, with gaps filled from manual choices that name an existing column.

    One row per (file, required); ``name`` is null where the column is still missing.
    """
    existing = names.select("file_id", "name").distinct()
    usable = manual.withColumn("name", F.trim("name")).join(
        existing, ["file_id", "name"], "left_semi")
    wanted = F.explode(F.array(*[F.lit(r) for r in schema.REQUIRED])).alias("required")
    files = best.select("file_id").distinct().select("file_id", wanted)
    auto = best.filter(F.col("required").isNotNull()).select(
        "file_id", "required", F.col("name").alias("_auto"))
    hand = usable.select("file_id", "required", F.col("name").alias("_hand"))
    keys = ["file_id", "required"]
    joined = files.join(auto, keys, "left").join(hand, keys, "left")
    origin = F.when(F.col("_auto").isNotNull(), F.lit("automatico")).when(
        F.col("_hand").isNotNull(), F.lit("manual"))
    return joined.select(*keys, F.coalesce("_auto", "_hand").alias("name"),
                         F.coalesce(origin, F.lit("falta")).alias("origen"))


def schema_difference(names: DataFrame, expected: list[str]) -> DataFrame:
    """Missing and extra names per file: ``(file_id, tipo, name)``."""
    known = F.col("name").isin(expected)
    extra = names.filter(~known).select("file_id", F.lit("extra").alias("tipo"), "name").distinct()
    found = names.groupBy("file_id").agg(F.collect_set(F.when(known, F.col("name"))).alias("f"))
    absent = F.explode(F.array_except(F.array(*[F.lit(e) for e in expected]), F.col("f")))
    return extra.unionByName(found.select("file_id", F.lit("falta").alias("tipo"),
                                          absent.alias("name")))


def header(df: DataFrame, file_id: str = "archivo") -> DataFrame:
    """Column-name table of one frame."""
    rows = [(file_id, i, name) for i, name in enumerate(df.columns)]
    kind = T.StructType([T.StructField("file_id", T.StringType()),
                         T.StructField("pos", T.LongType()),
                         T.StructField("name", T.StringType())])
    return df.sparkSession.createDataFrame(rows, kind)


def detect_mapping(df: DataFrame) -> dict[str, str]:
    """Required name to source name for one frame (twelve rows at most)."""
    return {r.required: r.name for r in match_columns(header(df)).collect()}


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Renames sources to required names; refuses a source that would serve two of them."""
    sources = list(mapping.values())
    twice = sorted({s for s in sources if sources.count(s) > 1})
    if twice:
        raise MappingConflict("asignada a dos columnas: " + ", ".join(twice))
    return df.withColumnsRenamed({src: req for req, src in mapping.items() if src != req})
