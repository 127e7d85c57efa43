"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean query over trigrams. The index holds, for the
trigrams that the rules name, posting lists of row numbers in blocks of at most ``BLOCK`` rows, so
a trigram that most texts have is still many short lists. Posting lists are intersected and united
per block as the rules say; only the rows that remain are verified with the expression itself. A
rule that names no trigram is verified on every row.

Spans are (start, end) in code points, leftmost and non-overlapping within a rule.

Defined cases: a null text is empty; null and repeated ids are rows like any other, as rows are
numbered by the operator; an empty table gives an empty result; columns of any other name stay out
of the scan and come through ``redact`` unchanged, whatever they are called.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.scratch import saved
from riskloom.llm.trigrams import Query, trigram_query, trigrams

#: Rows in a posting list, at most.
BLOCK = 4096


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters are secrets."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern

    @property
    def query(self) -> Query:
        return trigram_query(self.pattern)


#: The three base rules, then published formats of access keys and tokens.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("github", r"(ghp_|gho_|ghu_|ghs_|ghr_|github_pat_)[A-Za-z0-9_]+", 36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"(sk_live_|rk_live_)[A-Za-z0-9]+", 24),
    Rule("pem", r"-----BEGIN[A-Z\x20]* PRIVATE KEY-----", 20),
)
RULES = BASE_RULES + MORE_RULES


def _number(docs: DataFrame, text: str) -> DataFrame:
    """Rows with a number of their own, written once so that the numbers never change."""
    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    names = {c for c in docs.columns}
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]) if len(names) > 1 else F.struct(F.lit(0))
    return saved(docs.select(body, F.col(f"`{text}`").isNull().alias("no_text"), kept.alias("rest"))
                 .withColumn("row", F.monotonically_increasing_id()), "secrets")


def postings(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index: (trigram, block, rows), lists of at most ``BLOCK`` row numbers."""
    low = rows.select("row", F.lower("body").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in wanted]))
    block = F.floor(F.col("row") / BLOCK).alias("block")
    return (low.select("row", block, F.explode(held).alias("trigram"))
            .groupBy("block", "trigram").agg(F.collect_list("row").alias("rows")))


def _lists(query: Query) -> Column:
    """Posting lists of a block combined as the query says."""
    if query[0] == "has":
        return F.coalesce(F.col(f"`{query[1]}`"), F.array().cast("array<long>"))
    meet = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(meet, [_lists(p) for p in query[1]])


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, mask): bit k is set if the row may match rule k; rules without trigrams are left out."""
    asked = [(k, r.query) for k, r in enumerate(rules) if r.query is not None]
    wanted = sorted(set().union(*(trigrams(q) for _, q in asked)))
    wide = postings(rows, wanted).groupBy("block").agg(*[
        F.first(F.when(F.col("trigram") == t, F.col("rows")), ignorenulls=True).alias(t) for t in wanted])
    found = F.flatten(F.array(*[
        F.arrays_zip(_lists(q).alias("row"), F.array_repeat(F.lit(1 << k), F.size(_lists(q))).alias("bit"))
        for k, q in asked]))
    return (wide.select(F.explode(found).alias("hit")).groupBy("hit.row")
            .agg(F.bit_or("hit.bit").alias("mask")))


def _hits(rule: Rule, body: Column) -> Column:
    """Array of (gap before the match, its length, length of the group), with one end entry."""
    regex = F.lit(rule.regex)
    gaps = F.transform(F.split(body, rule.regex, -1), F.length)
    whole = F.transform(F.regexp_extract_all(body, regex, F.lit(0)), F.length)
    group = (F.transform(F.regexp_extract_all(body, regex, F.lit(rule.group)), F.length)
             if rule.group else whole)
    return F.arrays_zip(gaps.alias("gap"), whole.alias("len"), group.alias("size"))


def spans(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, kind_no, start, end) of every secret in the rows (row, body)."""
    unscanned = F.array().cast("array<struct<gap:int,len:int,size:int>>")
    mask = candidates(rows, rules).withColumnRenamed("row", "at").hint("shuffle_hash")
    judged = (rows.select("row", "body").join(mask, F.col("row") == F.col("at"), "left")
              .withColumn("mask", F.coalesce("mask", F.lit(0))))
    per_rule = [F.when((F.col("mask").bitwiseAND(1 << k) != 0) if r.query is not None else F.lit(True),
                       _hits(r, F.col("body"))).otherwise(unscanned) for k, r in enumerate(rules)]
    hits = (judged.select("row", F.posexplode(F.array(*per_rule)).alias("kind_no", "hits"))
            .where(F.size("hits") > 1)
            .select("row", "kind_no", F.posexplode("hits").alias("n", "hit"))
            .where("hit.len is not null"))
    so_far = Window.partitionBy("row", "kind_no").orderBy("n")
    end = F.sum(F.col("hit.gap") + F.col("hit.len")).over(so_far)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind_no") + 1)
    return (hits.withColumn("end", end).where(F.col("hit.size") >= least)
            .select("row", "kind_no", (F.col("end") - F.col("hit.len")).alias("start"), "end"))


def _joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _only(found: Column, kind_no: int) -> Column:
    return F.filter(found, lambda s: s["kind_no"] == kind_no)


def _of_rows(found: DataFrame) -> DataFrame:
    """(at, found): the spans of a row, by start and then by the order of the rules."""
    return (found.groupBy(F.col("row").alias("at"))
            .agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end"))).alias("found")))


def scan(docs: DataFrame, text: str = "text", ident: str = "doc_id",
         rules: tuple[Rule, ...] = RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """One row per document: (doc_id, n_<kind> of the first ``base`` rules, base_sha256, spans)."""
    rows = _number(docs.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{text}`").alias("text")), "text")
    both = (rows.select("row", F.col("rest.ident").alias("doc_id"))
            .join(_of_rows(spans(rows, rules)), F.col("row") == F.col("at"), "left")
            .withColumn("found", F.coalesce("found", F.array().cast(
                "array<struct<start:bigint,kind_no:int,end:bigint>>"))))
    counts = [F.size(_only(F.col("found"), k)).cast("long").alias(f"n_{r.kind}")
              for k, r in enumerate(rules[:base])]
    of_base = F.filter("found", lambda s: s["kind_no"] < base)
    return both.select("doc_id", *counts, F.sha2(_joined(of_base, rules), 256).alias("base_sha256"),
                       _joined(F.col("found"), rules).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]",
           rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping spans get one mark."""
    rows = _number(docs, text)
    found = _of_rows(spans(rows, rules))
    # Overlapping spans are merged by how far the spans before them reach.
    reach = F.aggregate("found", F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["start"].alias("start"),
            F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    merged = found.select("at", reach.alias("cuts"))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda s: s["end"]))
    starts = F.concat(F.transform("cuts", lambda s: s["start"]), F.array(F.lit(1 << 31).cast("long")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substr(
        F.col("body"), (p["a"] + 1).cast("int"), F.least(p["b"] - p["a"], F.lit((1 << 31) - 1)).cast("int")))
    clean = F.when(F.col("cuts").isNull(), F.col("body")).otherwise(F.array_join(pieces, mark))
    whole = (rows.join(merged.hint("shuffle_hash"), F.col("row") == F.col("at"), "left")
             .select(F.when(~F.col("no_text"), clean).alias("body"), "rest"))
    return whole.select(*[F.col("body").alias(c) if c == text else F.col("rest")[c].alias(c)
                          for c in docs.columns])
