"""Mixing sources to target word counts by Efraimidis-Spirakis sampling.

Every source gets a target: its weight's share of the total, at most ``most`` times its own size,
the excess going to the other sources by weight. A target of several times a source takes that many
complete epochs first; the rest of it is filled in the order of exponential keys ``-ln(u) / w`` with
``w`` the quality weight of a document, so better documents tend to come first. The last document
that is needed gives only the words still missing.

No source is ever ordered as a whole: keys fall into 256 buckets an octave, bucket totals locate the
bucket in which the budget ends, and only the rows of that bucket are ordered, in ranges of about
``TOGETHER`` rows. Rows with one id, or none, have one key; ranges part them by number, so they are
spread like others.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, last
in order; a null, zero or negative weight counts as ``LEAST_WEIGHT``; repeated rows are documents of
their own; rows of one key come by id, then size, then ``tie``; an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.scratch import numbered, saved

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WEIGHT = 1e-6
PER_OCTAVE = 256
#: Sources beyond this number are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Rows that are ordered together where a budget ends.
TOGETHER = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, ident: Column) -> Column:
    """A number in (0, 1) from an md5 of the seed and the id; ids alike get numbers alike."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(ident.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float,
                   most: float) -> DataFrame:
    """One row per source of (source, source_size): weight, and target by filling up to a level.

    Sources whose cap lies lowest against their weight are full first; the level is what the rest
    of the total gives each unit of the remaining weight. This is a table of sources, not of
    documents, so its running sums use one partition.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (sizes.withColumn("weight", weight)
            .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
            .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
            .withColumn("all_weight", F.sum("weight").over(whole)))
    fullest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("level", level)
    # The first source under its cap sets the level of all after it.
    under = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    rows = rows.withColumn("level", F.first(under, ignorenulls=True).over(whole))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _behind(rows: DataFrame, ranges: int, few: bool) -> DataFrame:
    """``rows`` with ``behind``: the words of all rows before each in the order of its source."""
    order = ["key", "doc_id", "size", "tie", "number"]
    rows = saved(rows.repartitionByRange(ranges, "source", *order).withColumn("range", F.spark_partition_id()), "mix_last")
    earlier = Window.partitionBy("part_source").orderBy("part_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy(F.col("source").alias("part_source"), F.col("range").alias("part_range"))
              .agg(F.sum("size").alias("words"))
              .select("part_source", "part_range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")))
    inside = Window.partitionBy("source", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(F.broadcast(before) if few else before,
                  F.col("part_source").eqNullSafe(F.col("source")) & (F.col("part_range") == F.col("range")))
            .withColumn("behind", F.col("before") + F.col("inside")))


def mix(docs: DataFrame, size: Column, quality: Column, seed: str = "mix",
        weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        ident: str = "doc_id", source: str = "source", tag: str | None = None,
        tie: Column | None = None) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken, tag), one for each row of ``docs``.

    ``tag`` names a column to hand through, to find the rows again; ``tie`` orders rows of one id and size.
    """
    key = -F.log(uniform(seed, F.col(ident))) / F.greatest(
        F.coalesce(quality.cast("double"), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    keyed = saved(docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"),
                              size.cast("long").alias("size"), key.alias("key"),
                              (F.col(tag) if tag else F.lit(None).cast("long")).alias("tag"),
                              (F.lit(0).cast("long") if tie is None else tie).alias("tie"),
                              F.monotonically_increasing_id().alias("number"))
                  .withColumn("bucket", F.floor(F.log2("key") * PER_OCTAVE).cast("int")), "mix")
    buckets = saved(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows")),
                    "mix_buckets")
    targets = source_targets(
        buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = F.round("target").cast("long")
    targets = (targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(
                   budget / F.col("source_size"))).otherwise(0).cast("long"))
               .withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (buckets.withColumn("ahead", F.coalesce(F.sum("words").over(running), F.lit(0)))
            .withColumnRenamed("source", "its")
            .join(targets, F.col("its").eqNullSafe(F.col("source")))
            .where((F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("words")))
            .select("its", F.col("bucket").alias("last_bucket"), "ahead", "rows"))
    plan = saved(targets.join(ends, F.col("its").eqNullSafe(F.col("source")), "left")
                 .select(F.col("source").alias("its"), "source_size", "target", "epochs", "rest",
                         "last_bucket", "ahead", "rows"), "mix_plan")
    sources, to_order = plan.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    few = sources <= BROADCAST_SOURCES
    plan = plan.drop("rows")
    rows = keyed.join(F.broadcast(plan) if few else plan, F.col("its").eqNullSafe(F.col("source")))
    ends_here = F.coalesce(F.col("bucket") == F.col("last_bucket"), F.lit(False))
    clear = rows.where(~ends_here).withColumn("extra", F.when(
        F.col("bucket") < F.col("last_bucket"), F.col("size")).otherwise(F.lit(0).cast("long")))
    ranges = 1 + to_order // TOGETHER
    last = _behind(rows.where(ends_here), ranges, sources + ranges <= BROADCAST_SOURCES)
    left = F.col("rest") - F.col("ahead") - F.col("behind")
    last = last.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    return clear.unionByName(last.select(*clear.columns)).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"), "tag")


def mixed(docs: DataFrame, size: Column, quality: Column, ident: str = "doc_id", **more) -> DataFrame:
    """``docs`` as often as the mix takes them, all columns as they were.

    Copies are whole: the document at which a budget ends counts once more if at least half of it is
    wanted. A document without words is never taken.
    """
    rows, row = numbered(docs, "mixed")
    content = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    own = [row + name for name in ("_size", "_quality", "_tie")]
    plan = mix(rows.withColumns(dict(zip(own, (size, quality, content)))), F.col(own[0]), F.col(own[1]),
               ident=ident, tag=row, tie=F.col(own[2]), **more)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    wanted = plan.select(F.col("tag").alias("its_row"), copies.alias("its_copies")).where("its_copies > 0")
    body = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("body"), F.col(row).alias("own_row"))
    return (body.join(wanted.hint("shuffle_hash"), F.col("own_row") == F.col("its_row"))
            .select("body", F.explode(F.array_repeat(F.lit(0), F.col("its_copies"))))
            .select(*[F.col("body")[c].alias(c) for c in docs.columns]))
