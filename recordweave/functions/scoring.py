"""Materiality, decay and evidence ladder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordweave import dims


def weight_of(key: Column, weights: dict[str, float], default: float) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, key), F.lit(default))


def magnitude_bucket(amount: Column) -> Column:
    out = F.when(amount.isNull() | (amount == 0), 0.0)
    for bound, value in dims.MAGNITUDE_BUCKETS:
        out = out.when(amount < bound, value)
    return out.otherwise(1.0)


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Unclamped position between two bounds; equal bounds give 0."""
    return F.when(low == high, 0.0).otherwise(F.try_divide(value - low, high - low))


def magnitude(amount: Column, low: Column, high: Column, points: Column) -> Column:
    """Min-max over a window with enough points, else fixed buckets; null counts as 0."""
    wide = F.coalesce(points, F.lit(0)) >= dims.MAGNITUDE_MIN_WINDOW
    return F.when(amount.isNull(), 0.0).when(wide, minmax(amount, low, high)).otherwise(magnitude_bucket(amount))


def materiality(
    source_id: Column, magnitude_: Column, entity_type: Column, corroboration: Column, desk_count: Column,
    source_weights: dict[str, float] | None = None, entity_importance: dict[str, float] | None = None,
) -> Column:
    """Weighted score in which every candidate of a window is new, capped at 1."""
    authority = weight_of(source_id, source_weights or dims.SOURCE_WEIGHTS, dims.DEFAULT_SOURCE_WEIGHT)
    importance = weight_of(entity_type, entity_importance or dims.ENTITY_IMPORTANCE, dims.DEFAULT_ENTITY_IMPORTANCE)
    extra_desks = F.least(F.greatest(desk_count - 1, F.lit(0)), F.lit(2))
    base = (
        authority * 0.30
        + 0.20
        + magnitude_ * 0.25
        + importance * 0.15
        + F.least(corroboration, F.lit(3)) / 3 * 0.10
    )
    return F.least(base + extra_desks * dims.CROSS_SECTOR_WEIGHT, F.lit(1.0))


def recency_weight(age_days: Column, half_life: float = dims.HALF_LIFE_DAYS) -> Column:
    if half_life <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / half_life)


def confidence(weight: Column) -> Column:
    return 1 - F.pow(F.lit(0.5), F.greatest(weight, F.lit(0.0)))


def attribution(source_id: Column, citation_supported: Column, analysis_only: Column | None = None) -> Column:
    """confirmed / reported / analysis / speculative from source class and support."""
    lookup = F.create_map(*[F.lit(x) for kv in dims.EVIDENCE_CLASS.items() for x in kv])
    evidence = F.coalesce(F.try_element_at(lookup, source_id), F.lit("reported"))
    ladder = (
        F.when(evidence == "signal", "speculative")
        .when(evidence == "reported", "reported")
        .when(citation_supported, "confirmed")
        .otherwise("analysis")
    )
    return ladder if analysis_only is None else F.when(analysis_only, "analysis").otherwise(ladder)


def attribution_rank(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in reversed(dims.ATTRIBUTIONS)]), label)


def license_class(source_id: Column) -> Column:
    return F.when(source_id.isin(dims.LINK_ONLY_SOURCES), "scrape_gray").otherwise("public_domain")
