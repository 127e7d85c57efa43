"""Verdicts over URLs: rules first, then logistic regression on hashed character n-grams.

The host of a URL is what follows its first ``://`` up to ``/``, ``?``, ``#`` or its end, A-Z lower-cased;
the path goes on from there up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has both
empty. A rule fits its host and all subdomains of it where the path starts with the rule's; the longest
rule wins, of equally long ones the first in code-point order.

URLs that no rule fits go by the model. Features are the distinct character n-grams (``SIZES``) of the
host, with marks at its ends, and of the path, hashed apart from each other into ``BUCKETS`` cells, each
worth one over the root of their number. Weights are fitted by full-batch gradient descent with momentum on at most
``SAMPLE`` labelled URLs (the least hashes), and a URL is blocked if its probability exceeds ``THRESHOLD``.
A URL without n-grams goes by the intercept, and an untrained model allows everything.

Everything is DataFrame functions: n-grams come from one look-ahead pattern, so a long URL takes linear
time; descent is a fold over an array of weights in a single row, whose size is bounded by ``SAMPLE`` and
``BUCKETS``; the scan of the pages reads two columns, shuffles nothing and gets the weights as a scalar.
Repeated rows and ids are judged row by row; an empty table gives an empty result.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.scratch import saved

BUCKETS, SIZES = 1 << 13, (3, 4, 5)
SAMPLE, TURNS, RATE, MOMENTUM, DECAY = 1000, 200, 2.0, 0.9, 1e-4
THRESHOLD = 0.5
BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Verdict, host and path of each rule
RULES = (Rule(BLOCK, "net", "/"), Rule(ALLOW, "example.net", "/en/"), Rule(BLOCK, "example.com", "/de/"),
         Rule(ALLOW, "org", "/fr/"))

#: Words that unwanted and wanted sites go by; the labelled table puts each into every pattern below.
UNWANTED = ("casino poker jackpot betting viagra pills pharmacy porn xxx escort payday replica torrent crack keygen "
            "lottery phishing malware clickbait adserver popup tracker freemoney miracle").split()
WANTED = ("news library school museum garden recipe weather science history health travel music forum docs research "
          "university journal council market sports kitchen books wiki stories river mountain station teacher "
          "village harvest winter letter cinema family bridge painter").split()
PATTERNS = tuple(f"http://{host}.example/{path}" for host in ("www.{0}", "{0}-{1}", "{1}{0}", "m.{0}s") for path in ("{2}/{3}", "{0}/{3}.html"))
_FILL, _LANGS = ("best", "online", "top", "my", "daily", "city"), ("en", "de", "fr", "es")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label): 1 for unwanted. Both classes share all patterns."""
    rows = [(p.format(w, _FILL[(i + j) % 6], _LANGS[(i + j) % 4], 37 * i + 101 * j + 5), label)
            for label, words in ((1, UNWANTED), (0, WANTED)) for i, w in enumerate(words) for j, p in enumerate(PATTERNS)]
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(url).alias("url"), F.lit(label).alias("label")) for url, label in rows])))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def features(host: Column, path: Column) -> Column:
    """Distinct cells, from 1, of the n-grams of a host and a path."""
    def cells(text: Column, part: str, size: int) -> Column:
        grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
        return F.transform(grams, lambda g: (F.pmod(F.xxhash64(F.lit(part), g), F.lit(BUCKETS)) + 1).cast("int"))

    ends = F.when(host == "", "").otherwise(F.concat(F.lit("^"), host, F.lit("$")))
    return F.array_distinct(F.concat(*[cells(text, part, n) for part, text in (("host", ends), ("path", path)) for n in SIZES]))


def _scale(cells: Column) -> Column:
    return 1 / F.sqrt(F.greatest(F.size(cells), F.lit(1)).cast("double"))


def probability(weights: Column, cells: Column) -> Column:
    """Probability of being unwanted; ``weights`` holds the intercept first."""
    total = F.aggregate(cells, F.lit(0.0), lambda a, j: a + weights[j])
    return 1 / (1 + F.exp(-(weights[0] + total * _scale(cells))))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def learn(labelled: DataFrame, url: str = "url", label: str = "label") -> DataFrame:
    """One row with the weights. Rows without a label or URL teach nothing."""
    spark = labelled.sparkSession
    rows = (labelled.select(F.col(url).alias("url"), (F.col(label) == 1).cast("double").alias("y"))
            .where("url is not null and y is not null").orderBy(F.xxhash64("url"), "url", "y").limit(SAMPLE))
    one = rows.select(F.struct("url", "y", features(host_of(F.col("url")), path_of(F.col("url"))).alias("cells")).alias("r"))
    texts = saved(one.agg(F.sort_array(F.collect_list("r")).alias("rows")), "labelled")
    at = texts.select(F.posexplode("rows").alias("u", "r")).select("u", F.col("r.cells").alias("cells"))
    seen = at.select("u", _scale(F.col("cells")).alias("s"), F.explode("cells").alias("j"))
    seen = seen.unionByName(at.select("u", F.lit(1.0).alias("s"), F.lit(0).alias("j")))
    lists = seen.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("u", "s"))).alias("l"))
    every = spark.range(BUCKETS + 1).select(F.col("id").cast("int").alias("j")).join(lists, "j", "left")
    postings = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("j", F.coalesce(
        "l", F.array().cast("array<struct<u:int,s:double>>")).alias("l")))), lambda x: x["l"]).alias("p"))

    def turn(state: Column, docs: Column, p: Column) -> Column:
        errors = F.transform(docs, lambda d: probability(state["w"], d["cells"]) - d["y"])
        rate = F.lit(RATE) / F.greatest(F.size(docs), F.lit(1))

        def slope(e: Column, j: Column) -> Column:
            decay = F.when(j == 0, 0.0).otherwise(RATE * DECAY) * state["w"][j]
            return decay + rate * F.aggregate(p[j], F.lit(0.0), lambda a, x: a + e[x["u"]] * x["s"])

        pushed = _with(errors, lambda e: F.transform(state["m"], lambda m, j: MOMENTUM * m - slope(e, j)))
        return _with(pushed, lambda m: F.struct(F.zip_with(state["w"], m, lambda v, d: v + d).alias("w"), m.alias("m")))

    held = spark.range(1).select(texts.scalar().alias("docs"), postings.scalar().alias("p"))
    held = saved(held, "postings")
    zero = F.array_repeat(F.lit(0.0), BUCKETS + 1)
    last = F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), F.struct(zero.alias("w"), zero.alias("m")),
                       lambda state, _: turn(state, F.col("docs"), F.col("p")), lambda state: state["w"])
    return saved(held.select(last.alias("weights")), "weights")


def judge(pages: DataFrame, model: DataFrame, rules: tuple[Rule, ...] = RULES, ident: str = "page_id",
          url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, probability); the last is null where a rule decides."""
    rows = pages.select(F.col(ident).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                        model.select("weights").scalar().alias("weights"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = F.when(name.isNull(), probability(F.col("weights"), features(F.col("host"), F.col("path"))))
    ruled = rows.select("id", "host", "path", name.alias("rule"), verdict.alias("ruled"), score.alias("probability"))
    learned = F.when(F.col("probability") > THRESHOLD, BLOCK).otherwise(ALLOW)
    return ruled.select(F.col("id").alias(ident), "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "probability")
