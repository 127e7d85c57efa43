"""Names of two tables that are similar, both of any size.

``matching`` holds every name against twelve fixed ones inside its row. Here both sides are tables, and
pairs are found by joins on pieces of the names; no pair is built that shares no such piece.

Work is done once per distinct normalised name. Its tokens are its distinct letter pairs, numbered from
the rarest one of both tables up, so the first tokens of a name are its most telling ones. Of a pair
that reaches a threshold t one of these holds, and each is one equi-join:

* both names are equal;
* one holds the other. All letter pairs of the shorter one then are in the longer one, so the rarest of
  them meets all tokens of the longer one;
* their token sets overlap by Jaccard t or more. The overlap then is at least a = ceil(t * size) for
  either size, so the two rarest common tokens are among the first size - a + 2 of both (``PAIRED``).
  Pairs of such tokens are the join key. Sizes and what can still follow are compared before the sets
  are, and a pair of names counts at its first common key only, so nothing has to be made distinct.
  Where one common token is all that t asks for, and above ``LONG`` tokens, where pairs of tokens
  would be too many, single tokens of the first size - a + 1 are the key.

A token is one of ``len(ALPHABET) ** 2``, which bounds the counts that reach the driver. The distinct
names are written to the scratch folder once, as several joins read them. Frequent keys are left to
adaptive execution, which splits large partitions. Null names match nothing.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import bigrams, normalise, similarity_of
from riskloom.operators.matching import THRESHOLD
from riskloom.session import written

# Fixed value: what is left of a normalised name
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789_"
LONG = 64
PAIRED, SINGLE = 2, 1
CONTAINED = 0.85


def _place(letter: Column) -> Column:
    return F.position(letter, F.lit(ALPHABET)) - 1


def _code(gram: Column) -> Column:
    return _place(F.substring(gram, 1, 1)) * len(ALPHABET) + _place(F.substring(gram, 2, 1))


def distinct_norms(names: DataFrame, name: str = "name") -> DataFrame:
    return names.where(F.col(name).isNotNull()).select(normalise(F.col(name)).alias("norm")).distinct()


def token_ranks(*sides: DataFrame) -> list[int]:
    """Rank of each possible letter pair by its number of names, rarest first."""
    grams = sides[0].select(F.explode(bigrams(F.col("norm"))).alias("g"))
    for side in sides[1:]:
        grams = grams.unionByName(side.select(F.explode(bigrams(F.col("norm"))).alias("g")))
    seen = {r.code: r.n for r in grams.groupBy(_code(F.col("g")).alias("code")).agg(
        F.count("*").alias("n")).collect()}
    ranks = [0] * len(ALPHABET) ** 2
    for rank, code in enumerate(sorted(range(len(ranks)), key=lambda c: (seen.get(c, 0), c))):
        ranks[code] = rank
    return ranks


def tokenised(norms: DataFrame, ranks: list[int]) -> DataFrame:
    """(norm, tokens, size): token numbers in ascending order."""
    table = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<int>")
    tokens = F.array_sort(F.transform(bigrams(F.col("norm")), lambda g: table[_code(g)]))
    return norms.select("norm", tokens.alias("tokens")).withColumn("size", F.size("tokens"))


def _least(size: Column, threshold: float) -> Column:
    """Tokens that a set has to share with any other one to reach the threshold."""
    return F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int")


def _overlap_keys(side: DataFrame, threshold: float) -> DataFrame:
    """Rows (kind, key, at, norm, tokens, size); ``at`` is the place of the key's last token."""
    size, tokens = F.col("size"), F.col("tokens")

    def first(count: int) -> Column:
        return F.slice(tokens, 1, F.greatest(F.lit(0), F.least(size, size - _least(size, threshold) + count)))

    def entry(kind: int, key: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("long").alias("key"), at.cast("int").alias("at"))

    none = F.array().cast("array<struct<kind:int,key:bigint,at:int>>")
    scale = len(ALPHABET) ** 2
    pairs = F.flatten(F.transform(first(2), lambda b, j: F.transform(
        F.slice(tokens, 1, j), lambda a: entry(PAIRED, a * scale + b, j))))
    singles = F.transform(first(1), lambda a, j: entry(SINGLE, a, j))
    many = F.when(size <= int(LONG / threshold) + 1, pairs).otherwise(none)
    one = F.when((_least(size, threshold) == 1) | (size > LONG), singles).otherwise(none)
    return side.select(F.explode(F.concat(many, one)).alias("e"), "norm", "tokens", "size").select(
        "e.*", "norm", "tokens", "size")


def _overlapping(left: DataFrame, right: DataFrame, threshold: float, shortest: int) -> DataFrame:
    l, r = _overlap_keys(left, threshold).alias("l"), _overlap_keys(right, threshold).alias("r")
    sl, sr = F.col("l.size"), F.col("r.size")
    both_one = (_least(sl, threshold) == 1) & (_least(sr, threshold) == 1)
    wanted = F.when(both_one | (F.least(sl, sr) > LONG), SINGLE).otherwise(PAIRED)
    left_over = F.least(sl - F.col("l.at"), sr - F.col("r.at")) - 1
    enough = F.ceil((sl + sr) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    near = ((F.col("l.kind") == F.col("r.kind")) & (F.col("l.key") == F.col("r.key"))
            & (F.col("l.kind") == wanted)
            & (F.greatest(sl, sr) * F.lit(threshold) <= F.least(sl, sr) + F.lit(1e-9))
            & (F.col("l.kind") + left_over >= enough))
    common = F.array_intersect("l.tokens", "r.tokens")
    scale = len(ALPHABET) ** 2
    met = l.join(r, near).select(
        F.col("l.norm").alias("a"), F.col("r.norm").alias("b"), sl.alias("sa"), sr.alias("sb"),
        F.col("l.kind").alias("kind"), F.col("l.key").alias("key"), common.alias("common"))
    first = F.when(F.col("kind") == SINGLE, F.col("common")[0]).otherwise(
        F.col("common")[0] * scale + F.try_element_at("common", F.lit(2)))
    score = similarity_of(F.col("a"), F.col("b"), F.col("sa"), F.col("sb"), F.size("common"), shortest)
    held = (F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))) & (
        F.least(F.length("a"), F.length("b")) >= shortest)
    return met.where((first == F.col("key")) & ~held).select("a", "b", score.alias("score")).where(
        F.col("score") >= threshold)


def _held(short: DataFrame, long: DataFrame, shortest: int) -> DataFrame:
    """(short, long): names that other names hold, on their rarest token. Names of one letter meet
    the letters of others, the empty name all of them."""
    letters = F.array_distinct(F.transform(F.split("norm", ""), lambda c: -2 - _place(c)))
    none = F.array(F.lit(-1))
    key = F.when(F.length("norm") > 1, F.col("tokens")[0]).when(
        F.length("norm") == 1, -2 - _place(F.col("norm"))).otherwise(-1)
    keys = F.concat("tokens", letters, none) if shortest < 2 else F.col("tokens")
    s = short.where(F.length("norm") >= shortest).select("norm", key.alias("key")).alias("s")
    h = long.where(F.length("norm") > shortest).select("norm", F.explode(keys).alias("key")).alias("h")
    on = ((F.col("s.key") == F.col("h.key")) & (F.length("s.norm") < F.length("h.norm"))
          & F.col("h.norm").contains(F.col("s.norm")))
    return s.join(h, on).select(F.col("s.norm").alias("short"), F.col("h.norm").alias("long"))


def similar_norms(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD,
                  strict: bool = False) -> DataFrame:
    """(a, b, score) of all pairs of normalised names whose similarity reaches the threshold.

    Both sides hold distinct names in a column ``norm``. ``strict`` lets names of no or one letter
    count as contained in others.
    """
    if threshold <= 0:
        raise ValueError("every pair reaches a threshold of 0")
    shortest = 0 if strict else 2
    left, right = written(left.select("norm"), "names"), written(right.select("norm"), "names")
    ranks = token_ranks(left, right)
    a, b = tokenised(left, ranks), tokenised(right, ranks)
    pairs = _overlapping(a, b, threshold, shortest)
    if threshold <= 1:
        pairs = pairs.unionByName(left.join(right, "norm").select(
            F.col("norm").alias("a"), F.col("norm").alias("b"), F.lit(1.0).alias("score")))
    if threshold <= CONTAINED:
        for found, names in ((_held(a, b, shortest), ("a", "b")), (_held(b, a, shortest), ("b", "a"))):
            pairs = pairs.unionByName(found.toDF(*names).withColumn("score", F.lit(CONTAINED)))
    return pairs


def similar_names(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD,
                  strict: bool = False) -> DataFrame:
    """(name, wanted, score) of the distinct names of ``left.name`` and ``right.name``."""
    a, b = (written(side.select("name").where("name is not null").distinct()
                    .withColumn("norm", normalise(F.col("name"))), "names") for side in (left, right))
    pairs = similar_norms(a.select("norm").distinct(), b.select("norm").distinct(), threshold, strict)
    return (pairs.join(a.select("name", F.col("norm").alias("a")), "a")
            .join(b.select(F.col("name").alias("wanted"), F.col("norm").alias("b")), "b")
            .select("name", "wanted", "score"))


def name_candidates(names: DataFrame, wanted: DataFrame, synonyms: DataFrame | None = None,
                    threshold: float = THRESHOLD, strict: bool = False) -> DataFrame:
    """(name, wanted, prio, score): 1 exact, 2 known spelling, 3 similar.

    ``wanted`` has a column ``name``; ``synonyms`` has ``(wanted, synonym)``.
    """
    found = similar_names(names, wanted, threshold, strict).select(
        "name", "wanted", F.when(F.col("name") == F.col("wanted"), 1).otherwise(3).alias("prio"), "score")
    if synonyms is None or threshold > 0.95:
        return found
    spelled = synonyms.select("wanted", normalise(F.col("synonym")).alias("norm")).where(
        "wanted is not null and norm is not null").distinct()
    spelled = spelled.join(wanted.select(F.col("name").alias("wanted")).distinct(), "wanted", "left_semi")
    known = names.select("name").where("name is not null").distinct().withColumn("norm", normalise(F.col("name")))
    return found.unionByName(known.join(spelled, "norm").select(
        "name", "wanted", F.lit(2).alias("prio"), F.lit(0.95).alias("score")))


def match_catalogues(names: DataFrame, wanted: DataFrame, synonyms: DataFrame | None = None,
                     threshold: float = THRESHOLD, strict: bool = False) -> DataFrame:
    """Best source per (file, wanted name): exact, then known spelling, then most similar, the first
    in file order on a tie. ``names`` has ``(file_id, pos, name)``; a wanted name that a file has
    nothing for gives no row."""
    pick = F.min_by(F.struct("name", "score", "prio"),
                    F.struct("prio", -F.col("score"), F.col("pos"), F.col("name")))
    method = F.when(F.col("b.prio") == 1, "exacta").when(F.col("b.prio") == 2, "sinonimo").otherwise("similar")
    return (names.join(name_candidates(names, wanted, synonyms, threshold, strict), "name")
            .groupBy("file_id", "wanted").agg(pick.alias("b"))
            .select("file_id", "wanted", F.col("b.name").alias("name"), F.col("b.score").alias("score"),
                    method.alias("method")))
