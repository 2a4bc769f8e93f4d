"""Threshold bands.  A NULL value fails every comparison and lands in the last band.

The bounds and labels below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def at_least(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """First step whose lower bound the value reaches (steps from high to low)."""
    case = None
    for bound, label in steps:
        hit = value >= bound
        case = F.when(hit, label) if case is None else case.when(hit, label)
    return case.otherwise(rest)


def above(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """As ``at_least`` with a strict bound."""
    case = None
    for bound, label in steps:
        hit = value > bound
        case = F.when(hit, label) if case is None else case.when(hit, label)
    return case.otherwise(rest)


def below(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """First step the value stays under (steps from low to high)."""
    case = None
    for bound, label in steps:
        hit = value < bound
        case = F.when(hit, label) if case is None else case.when(hit, label)
    return case.otherwise(rest)


def category_health(margin: Column) -> Column:
    return at_least(margin, [(0.20, "Saludable"), (0.10, "Ajustado")], "Crítico")


def product_state(margin: Column) -> Column:
    return below(margin, [(0.0, "NEG"), (0.10, "LOW")], "OK")


def promo_exposure_state(margin: Column) -> Column:
    return at_least(margin, [(0.20, "OK"), (0.10, "MED")], "LOW")


def margin_alert(margin: Column) -> Column:
    return below(margin, [(0.0, "Negativo"), (0.05, "Bajo <5%"), (0.35, "Normal")], "Alto")


def penetration_alert(penetration: Column) -> Column:
    return above(penetration, [(0.7, "Muy alta"), (0.4, "Alta"), (0.1, "Normal")], "Sin promo")


def trend(delta: Column) -> Column:
    return (
        F.when(delta > 0.01, "Mejorando").when(delta < -0.01, "Deteriorando").otherwise("Estable")
    )


def promo_light(margin: Column, roi: Column, coverage: Column) -> Column:
    good = (margin >= 0.20) & (roi >= 2) & (coverage >= 0.3)
    fair = (margin >= 0.10) | (F.coalesce(roi, F.lit(0.0)) >= 1)
    return F.when(good, "Buena").when(fair, "Regular").otherwise("Crítica")


def quadrant(margin: Column, units: Column, mid_margin: Column, mid_units: Column) -> Column:
    return (
        F.when((margin >= mid_margin) & (units >= mid_units), "Alto margen · alta rotación")
        .when((margin >= mid_margin) & (units < mid_units), "Alto margen · baja rotación")
        .when((margin < mid_margin) & (units >= mid_units), "Bajo margen · alta rotación")
        .otherwise("Bajo margen · baja rotación")
    )


def discount_zone(discount: Column, margin: Column) -> Column:
    return (
        F.when((discount > 0.20) & (margin < 0.15), "Peligro: desc. alto + margen bajo")
        .when((discount <= 0.20) & (margin >= 0.15), "Ideal: desc. bajo + margen alto")
        .when((discount > 0.20) & (margin >= 0.15), "Alto margen con descuento alto")
        .otherwise("Sin descuento significativo")
    )


def elasticity(correlation: Column) -> Column:
    return (
        F.when(correlation < -0.3, "Elástica (precio↑ → vol↓)")
        .when(correlation > 0.3, "Inelástica (precio no afecta vol)")
        .otherwise("Sin correlación clara")
    )
