"""Score bands, ceilings, rarities and rounded contributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ("INSUFFICIENT", "LOW", "MODERATE", "HIGH")

# Lower edges of LOW, MODERATE and HIGH.
SOURCE_EDGES = (0.30, 0.55, 0.80)
FACTOR_EDGES = (0.25, 0.50, 0.75)


def band_ordinal(score: Column, edges: tuple[float, float, float]) -> Column:
    return sum((F.when(score >= e, 1).otherwise(0) for e in edges), F.lit(0))


def tier_name(ordinal: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), ordinal + 1)


def band(score: Column, edges: tuple[float, float, float]) -> Column:
    return tier_name(band_ordinal(score, edges))


def capped_band(score: Column, edges: tuple[float, float, float], ceiling: Column | str) -> Column:
    """Band name held down to a ceiling, and whether the ceiling applied."""
    names = F.array(*[F.lit(t) for t in TIERS])
    ceil_col = F.lit(ceiling) if isinstance(ceiling, str) else ceiling
    top = (F.array_position(names, ceil_col) - 1).cast("int")
    raw = band_ordinal(score, edges)
    return F.struct(tier_name(F.least(raw, top)).alias("tier"), (raw > top).alias("capped"))


def contribution(value: Column, weight: Column) -> Column:
    return F.bround(value * weight, 4)


def rarity_above_median(pct: Column) -> Column:
    return F.when(pct.isNotNull(), F.greatest(F.lit(0.0), 2.0 * (pct - 0.5)))


def rarity_two_sided(pct: Column) -> Column:
    return F.greatest(rarity_above_median(pct), rarity_above_median(1.0 - pct))


def flow_anomaly_ratio(magnitude: Column, speed: Column) -> Column:
    known = magnitude.isNotNull() & speed.isNotNull()
    return F.when(known, F.least(magnitude / F.greatest(speed, F.lit(0.1)), F.lit(1.0)))


def in_dry_sector(from_deg: Column) -> Column:
    return from_deg.between(247.5, 360.0)


def fixed(value: Column, digits: int) -> Column:
    """A number with ``digits`` decimals, rounded from its exact binary value, an exact tie to even.

    Java's formatter rounds the shortest decimal form instead: 1.15 lies below the tie and is 1.1, not 1.2.
    """
    size, unit = F.abs(value), 10**digits
    whole = F.floor(size)
    # Split so that both products are exact; the sign of ``over`` then tells on which side of the tie the value lies.
    part = size - whole
    head = F.floor(part * 2.0**26) / 2.0**26
    units = F.floor(head * unit)
    over = (head * unit - units - 0.5) + (part - head) * unit
    total = whole * unit + units + F.when((over > 0) | ((over == 0) & (units % 2 == 1)), 1).otherwise(0)
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, F.call_function("div", total, F.lit(unit)).cast("string"), F.lit("."), F.lpad((total % unit).cast("string"), digits, "0"))
    return F.when(size < 2.0**52, text).otherwise(F.format_string(f"%.{digits}f", value))


def rate_display(rate: Column) -> Column:
    """Two decimals below one tonne per hour, one above."""
    return F.when(F.abs(rate) < 1.0, fixed(rate, 2)).otherwise(fixed(rate, 1))
