"""Column expressions over names and texts."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is one ASCII letter plus combining marks."""
    source, target = [], []
    for code in range(0x80, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code))
                       if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base.isascii() and base.isalnum():
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(c: Column) -> Column:
    return F.translate(c, _ACCENTED, _PLAIN)


def normalise(c: Column) -> Column:
    """Lower case, no accents, separator runs as one underscore, nothing but ``[a-z0-9_]``."""
    c = F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    c = F.regexp_replace(strip_accents(c), r"(?U)[\s\-.]+", "_")
    return F.regexp_replace(c, r"[^a-z0-9_]", "")


def bigrams(c: Column) -> Column:
    """Set of adjacent character pairs; empty below two characters."""
    last = F.length(c) - 1
    # sequence(1, 0) counts down, so the short case needs its own branch
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(steps, lambda i: F.substring(c, i, F.lit(2))))


def similarity(a: Column, b: Column, min_contained: int = 0) -> Column:
    """1.0 if equal, 0.85 if one holds the other, else Jaccard of the bigram sets.

    Takes names that are already normalised. ``min_contained`` is the shortest text that may
    count as contained; 0 lets an empty name be contained in every other one.
    """
    grams_a, grams_b = bigrams(a), bigrams(b)
    return similarity_of(a, b, F.size(grams_a), F.size(grams_b),
                         F.size(F.array_intersect(grams_a, grams_b)), min_contained)


def similarity_of(a: Column, b: Column, size_a: Column, size_b: Column, shared: Column,
                  min_contained: int = 0) -> Column:
    """The same from the sizes of both bigram sets and of what they share."""
    contained = b.contains(a) | a.contains(b)
    if min_contained:
        contained = contained & (F.least(F.length(a), F.length(b)) >= min_contained)
    return (F.when(a == b, F.lit(1.0))
            .when(contained, F.lit(0.85))
            .when((size_a == 0) | (size_b == 0), F.lit(0.0))
            .otherwise(shared / F.greatest(size_a + size_b - shared, F.lit(1))))


def human_label(c: Column) -> Column:
    """``Tipo_tarjeta`` as ``Tipo Tarjeta``."""
    return F.initcap(F.regexp_replace(c, "_", " "))


def output_name(c: Column, active: str, suffix: str = ".joblib") -> Column:
    """Safe file name for a model; an empty name means the active model."""
    name = F.trim(c)
    name = F.when(name.endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix)))
    safe = F.regexp_replace(name, r'[\\/:*?"<>|]', "_")
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(active)).otherwise(safe)


def date_text(c: Column, unknown: str = "desconocido") -> Column:
    """``YYYY-MM-DD``; anything that is not a date, and null, become the unknown word."""
    parsed = F.try_to_timestamp(c.cast("string"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.lit(unknown))
