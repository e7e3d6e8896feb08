"""Similarity of two ARRAY<DOUBLE> columns, as column expressions.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def _fold(a: Column, b: Column, terms: Callable[[Column, Column], dict[str, Column]], finish: Callable[[Column], Column]) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    names = list(terms(F.lit(0.0), F.lit(0.0)))
    start = F.struct(*[F.lit(0.0).alias(n) for n in names])

    def step(acc: Column, p: Column) -> Column:
        return F.struct(*[(acc[n] + t).alias(n) for n, t in terms(p["a"], p["b"]).items()])

    same = F.size(a) == F.size(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(~same, F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(F.aggregate(pairs, start, step, finish))


def cosine(a: Column, b: Column) -> Column:
    """dot / sqrt(|a|^2 |b|^2), 0 where that root isn't above the machine epsilon."""
    root = lambda s: F.sqrt(s["aa"] * s["bb"])
    return _fold(a, b, lambda x, y: {"ab": x * y, "aa": x * x, "bb": y * y}, lambda s: F.when(root(s) > EPS, F.try_divide(s["ab"], root(s))).otherwise(F.lit(0.0)))


def euclidean(a: Column, b: Column, gamma: float = 1.0) -> Column:
    """exp(-gamma |a - b|)."""
    return _fold(a, b, lambda x, y: {"d": (x - y) * (x - y)}, lambda s: F.exp(-F.lit(gamma) * F.sqrt(s["d"])))


def manhattan(a: Column, b: Column, gamma: float = 1.0) -> Column:
    """exp(-gamma sum |a_i - b_i|)."""
    return _fold(a, b, lambda x, y: {"d": F.abs(x - y)}, lambda s: F.exp(-F.lit(gamma) * s["d"]))


def pearson(a: Column, b: Column) -> Column:
    """Correlation; 0 where its denominator isn't above the machine epsilon."""
    n = F.size(a).cast("double")

    def finish(s: Column) -> Column:
        up = s["ab"] - F.try_divide(s["a"] * s["b"], n)
        down = F.sqrt((s["aa"] - F.try_divide(s["a"] * s["a"], n)) * (s["bb"] - F.try_divide(s["b"] * s["b"], n)))
        return F.when((down > EPS) & ~F.isnan(down), F.try_divide(up, down)).otherwise(F.lit(0.0))

    return _fold(a, b, lambda x, y: {"ab": x * y, "a": x, "b": y, "aa": x * x, "bb": y * y}, finish)


def jaccard(a: Column, b: Column, threshold: float = EPS) -> Column:
    """Positions that differ by less than the threshold (both-zero positions too) over positions where
    either is positive; 0 if there is none of the latter, and more than 1 where zeros agree often."""
    one = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return _fold(
        a, b, lambda x, y: {"i": one(F.abs(x - y) < threshold), "u": one((x > 0) | (y > 0))},
        lambda s: F.when(s["u"] > 0, F.try_divide(s["i"], s["u"])).otherwise(F.lit(0.0)),
    )


MEASURES: dict[str, Callable[..., Column]] = {"cosine": cosine, "euclidean": euclidean, "pearson": pearson, "manhattan": manhattan, "jaccard": jaccard}


def pair_similarity(vectors: DataFrame, pairs: DataFrame, measure: str, id_col: str = "id", features: str = "features", **params: float) -> DataFrame:
    """(id_a, id_b, similarity) for the candidate pairs (id_a, id_b): two equi-joins, no pair that isn't
    asked for."""
    if measure not in MEASURES:
        raise ValueError(f"measure must be one of {sorted(MEASURES)}")
    side = lambda s: vectors.select(F.col(id_col).alias(f"id_{s}"), F.col(features).alias(f"_{s}"))
    joined = pairs.select("id_a", "id_b").join(side("a"), "id_a").join(side("b"), "id_b")
    return joined.select("id_a", "id_b", MEASURES[measure](F.col("_a"), F.col("_b"), **params).alias("similarity"))
