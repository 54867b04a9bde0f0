"""Vector and trigram similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity(a: Column, b: Column) -> Column:
    """1 minus the cosine distance, held between 0 and 1; null where a vector is zero."""
    held = lambda c: F.when(c > 1, 1.0).when(c < 0, 0.0).otherwise(c)  # noqa: E731  greatest and least would pass over null
    return F.get(F.transform(F.array(cosine(a, b)), held), F.lit(0))  # so that the cosine is computed once


def vector_problem(v: Column, size: int) -> Column:
    """The first of empty, dimension, nan, inf, zero that applies; null for a good vector."""
    return (
        F.when(v.isNull() | (F.size(v) == 0), "empty").when(F.size(v) != size, "dimension").when(F.exists(v, F.isnan), "nan")
        .when(F.exists(v, lambda x: F.abs(x) == float("inf")), "inf").when(F.forall(v, lambda x: F.abs(x) <= 1e-12), "zero")
    )


def fingerprint(v: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(v, lambda x: x.cast("string")), ","), 256))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-case words, each padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    return F.array_distinct(grams)


def overlap(x: Column, y: Column) -> Column:
    """Share of what two sets have in common in all of them; 0 where there is none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return overlap(trigrams(a), trigrams(b))


def token_containment(needle: Column, hay: Column) -> Column:
    """Share of the needle's words that occur in the other text."""
    words = F.filter(F.split(F.lower(needle), r"\s+"), lambda w: w != "")
    low = F.lower(hay)
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.contains(low, w))).cast("double"), F.size(words)), F.lit(0.0))
