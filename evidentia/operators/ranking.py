"""Weighted scores, bands and the lattice of verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the comparison levels.
LEVEL_WEIGHTS = {"structural": 2.0, "dimensional": 1.5, "numerical": 3.0, "limit": 2.0, "symmetry": 1.0, "embedding": 0.5}
# Weights of the criteria for premises.
PREMISE_WEIGHTS = {"consistency": 3.0, "convergence": 2.0, "obstacle": 2.0, "simplification": 2.0, "historical": 1.0, "novelty": 1.0}
# Dimensions of known topics.
TOPIC_DIMENSIONS = {
    "spectral_dimension": "dimensionless",
    "newton_correction": "[L]^{-1}",
    "black_hole_entropy": "dimensionless",
    "bh_entropy_log_correction": "dimensionless",
    "area_gap": "[L]^2",
    "graviton_propagator_modification": "[L]^2",
    "dispersion_relation_modification": "[L]^{-1}",
}


def weighted_mean(scores: Mapping[str, Column], weights: Mapping[str, float] = LEVEL_WEIGHTS) -> Column:
    """Mean of the scores that are not null, by weight; 0 if all are null."""
    total = reduce(Column.__add__, (F.coalesce(s * weights[k], F.lit(0.0)) for k, s in scores.items()))
    weight = reduce(Column.__add__, (F.when(s.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, s in scores.items()))
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def match_label(score: Column) -> Column:
    return F.when(score > 0.9, "exact").when(score > 0.7, "structural").when(score > 0.5, "partial").when(score > 0.3, "analogous").otherwise("none")


def dimension_score(a: Column, b: Column, dimensions: Mapping[str, str] = TOPIC_DIMENSIONS) -> Column:
    """1 for one known topic, 0.5 if a dimension is unknown, 0.8 for equal dimensions, else 0."""
    table = F.create_map(*(F.lit(x) for pair in dimensions.items() for x in pair))
    da, db = F.try_element_at(table, a), F.try_element_at(table, b)
    return F.when((a == b) & da.isNotNull(), 1.0).when(da.isNull() | db.isNull(), 0.5).when(da == db, 0.8).otherwise(0.0)


def premise_score(scores: Mapping[str, Column]) -> Column:
    return reduce(Column.__add__, (s * PREMISE_WEIGHTS[k] for k, s in scores.items())) / sum(PREMISE_WEIGHTS.values())


def novelty_band(hits: Column, highly_cited: Column) -> Column:
    """Novelty by how many works a search found, and how many of those are cited more than 20 times; unknown is 0.5."""
    return F.when(hits.isNull(), 0.5).when(hits == 0, 1.0).when(highly_cited >= 3, 0.0).when(highly_cited >= 1, 0.2).when(hits >= 5, 0.3).when(hits >= 2, 0.5).otherwise(0.7)


def is_novel(hits: Column, highly_cited: Column) -> Column:
    """Three-way verdict of a search: true without hits, false with three highly cited ones, else null."""
    return F.when(hits == 0, True).when(highly_cited >= 3, False)


def status(algebraic: Column, numerical: Column, dimensional: Column, counterexample: Column, novel: Column) -> Column:
    """Verdict from five flags that may be null, in order of precedence."""
    no = lambda c: c.isNotNull() & ~c
    yes = lambda c: c.isNotNull() & c
    return (
        F.when(yes(counterexample), "disproved")
        .when(no(algebraic) | no(numerical) | no(dimensional), "disproved")
        .when(no(novel), "known")
        .when(yes(algebraic) | yes(numerical), "verified")
        .when(yes(dimensional) & yes(novel), "verified")
        .otherwise("inconclusive")
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each key, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
