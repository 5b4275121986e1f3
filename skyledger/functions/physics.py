"""Plume and atmosphere formulae as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def pixel_area_m2(lat: Column, dx_deg: float | Column, dy_deg: float | Column) -> Column:
    """Ground area of a latitude/longitude pixel."""
    return (
        F.lit(dx_deg) * F.lit(dy_deg) * (C.METERS_PER_DEGREE**2) * F.cos(F.radians(lat))
    )


def cell_area_km2(lat: Column, dlat: float = 1.0, dlon: float = 1.0) -> Column:
    km = C.EARTH_RADIUS_KM * math.pi / 180.0
    return F.lit(dlat * km * dlon * km) * F.cos(F.radians(lat))


def n_air(p_pa: Column, t_k: Column, strict: bool = False) -> Column:
    """Molar air density; a non-physical state gives NULL, or an error when strict."""
    bad = F.raise_error(F.lit("non-physical pressure or temperature")) if strict else F.lit(None)
    return F.when((p_pa > 0) & (t_k > 0), p_pa / (C.GAS_CONSTANT * t_k)).otherwise(bad.cast("double"))


def ppm_m_to_kg_m2(enh: Column, n_air_mol: Column) -> Column:
    return enh * 1.0e-6 * n_air_mol * C.CH4_KG_PER_MOL


def u_eff(u10: Column) -> Column:
    return F.when(u10 > 0, C.ALPHA_1 * F.log(u10) + C.ALPHA_2)


def q_kg_s(ime_kg: Column, u_eff_ms: Column, length_m: Column) -> Column:
    return F.when(length_m > 0, u_eff_ms * ime_kg / length_m)


def wind_sigma(u10: Column, u10_sigma: Column) -> Column:
    """Fractional wind terms on the rate: slope, wind speed and both in quadrature."""
    ue = u_eff(u10)
    a = F.abs(F.log(u10)) * C.ALPHA_1_SIGMA
    u = F.abs(C.ALPHA_1 / u10) * u10_sigma
    ok = (u10 > 0) & (ue > 0)
    return F.struct(
        F.when(ok, a / ue).alias("alpha1_term"),
        F.when(ok, u / ue).alias("u10_term"),
        F.when(ok, F.sqrt(a * a + u * u) / ue).alias("total"),
    )


def u10_sample_sigma(hour_distance_h: Column) -> Column:
    return F.when(hour_distance_h.isNotNull(), F.least(F.lit(3.0), 1.6 + 0.4 * hour_distance_h))


def dry_air_column(p_pa: Column) -> Column:
    return p_pa / F.lit(C.STANDARD_GRAVITY * C.AIR_KG_PER_MOLECULE) * 1.0e-4


def excess_column_per_ppm_m(p_pa: Column, t_k: Column) -> Column:
    return 1.0e-6 * (p_pa / (F.lit(C.BOLTZMANN) * t_k)) * 1.0e-4


def air_number_density_cm3(p_pa: Column, t_k: Column) -> Column:
    return p_pa / (F.lit(C.BOLTZMANN) * t_k) * 1.0e-6


def air_mass_factor(sza_deg: Column, vza_deg: Column) -> Column:
    return 1.0 / F.cos(F.radians(sza_deg)) + 1.0 / F.cos(F.radians(vza_deg))


def wind_from_deg(u: Column, v: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))


def wind_regime(u10: Column) -> Column:
    """Validity of the wind model: inside its range, margins, and closeness to the low edge."""
    return F.struct(
        u10.between(C.U10_MIN, C.U10_MAX).alias("in_regime"),
        (u10 - C.U10_MIN).alias("margin_low"),
        (C.U10_MAX - u10).alias("margin_high"),
        ((u10 - C.U10_MIN) < 1.0).alias("near_low"),
    )
