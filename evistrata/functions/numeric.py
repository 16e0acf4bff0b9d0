"""Column expressions on numbers: floors, sigmoids, bands, combined scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def half_even(x: Column, digits: int) -> Column:
    """Rounded to ``digits``, a half to the even neighbour, as arrays of doubles are rounded: scaled, to the nearest integer, and back."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def neg_log10(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def sigmoid(z: Column, midpoint: float = 2.0, steepness: float = 0.5) -> Column:
    return 1.0 / (1.0 + F.exp(-steepness * (z - midpoint)))


def combined_score(fe_1: Column, p_1: Column, fe_2: Column, p_2: Column, consistency: Column, n: Column) -> Column:
    """Two enrichments by their significance, direction consistency, and how much evidence there is."""
    return F.log1p(fe_1) * neg_log10(p_1) + F.log1p(fe_2) * neg_log10(p_2) + 5.0 * consistency + 0.25 * F.log1p(n)


def sign_label(x: Column) -> Column:
    return F.when(x > 0, "Up").when(x < 0, "Down").otherwise("Mixed")


def consistency_label(x: Column) -> Column:
    return F.when(x.isNull(), "Unknown").when(x >= 0.60, "Consistent").when(x <= 0.40, "Opposite").otherwise("Mixed")


def pocket_probability(score: Column, volume: Column, hydrophobicity: Column, density: Column, polarity: Column) -> Column:
    """Weighted mean of the descriptors that are there; 0 if none is."""
    terms = (
        (0.35, score, F.least(score, F.lit(1.0))),
        (0.25, volume, F.when(volume.between(500, 2000), 1.0).when(volume < 500, volume / 500.0).otherwise(F.greatest(F.lit(0.3), 2000.0 / volume))),
        (0.20, hydrophobicity, F.when(hydrophobicity.between(0.3, 0.7), 1.0).when(hydrophobicity < 0.3, F.greatest(F.lit(0.5), hydrophobicity / 0.3)).otherwise(F.greatest(F.lit(0.3), (1.0 - hydrophobicity) / 0.5))),
        (0.10, density, F.least(density / 15.0, F.lit(1.0))),
        (0.10, polarity, F.when(polarity.between(0.2, 0.6), 1.0).otherwise(0.6)),
    )
    total = sum(F.when(field.isNotNull(), w * value).otherwise(0.0) for w, field, value in terms)
    weight = sum(F.when(field.isNotNull(), w).otherwise(0.0) for w, field, _ in terms)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def scaled_edges(score: Column, most: Column) -> Column:
    """Edge scores between 0 and 1, from a scale that ends at 1, at 1000, or at the largest score."""
    return score / F.when(most <= 1.0, 1.0).when(most <= 1000.0, 1000.0).otherwise(most)


def fold_enrichment(observed: Column, expected: Column, undefined: float | None = 0.0) -> Column:
    return F.when(expected > 0, observed / expected).otherwise(F.lit(undefined).cast("double"))


def safe_ratio(a: Column, b: Column, undefined: float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(undefined).cast("double"))
