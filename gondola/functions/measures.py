"""The measure library: every business figure as an aggregate ``Column``.

Sums stay DECIMAL (exact); only ratios go to DOUBLE.  A ratio over zero is NULL, never NaN or an
ANSI error.  Spark evaluates a repeated aggregate such as ``sum(Importe)`` once per query, so
measures are free to mention the same sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, functions as F


def over(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as DOUBLE, NULL when the denominator is zero."""
    bottom = denominator.cast("double")
    return numerator.cast("double") / F.nullif(bottom, F.lit(0.0))


def total(column: str) -> Column:
    return F.sum(F.col(column))


def total_where(condition: Column, column: str) -> Column:
    return F.sum(F.when(condition, F.col(column)).otherwise(F.lit(0)))


def in_promo() -> Column:
    return F.col("Cod_promo").isNotNull()


def coded_promo() -> Column:
    """A promo code that is present and not blank."""
    return F.coalesce(F.trim(F.col("Cod_promo")) != "", F.lit(False))


def flagged(flag: int) -> Column:
    return F.col("has_promo") == flag


def _margin() -> Column:
    return total("Importe") - total("Costo_total")


def _discount() -> Column:
    return total("Precio_x_Cant") - total("Importe")


def month_key(column: str = "Anio_mes") -> Column:
    """A month's text as a number in the same order, so that its extremes can live in a
    hash-aggregation buffer: the seven bytes as one integer."""
    return F.conv(F.hex(F.col(column).cast("binary")), 16, 10).try_cast("bigint")


def month_text(key: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(key), 14, "0")), "UTF-8")


def _distinct(column: str) -> Callable[[], Column]:
    return lambda: F.countDistinct(F.col(column))


MEASURES: dict[str, Callable[[], Column]] = {
    # additive
    "Ingresos": lambda: total("Importe"),
    "Unidades": lambda: total("Cantidad"),
    "Costo": lambda: total("Costo_total"),
    "Ing_lista": lambda: total("Precio_x_Cant"),
    "Margen": _margin,
    "Descuento": _discount,
    "Tickets": lambda: total("n_tickets"),
    "Tkt_promo": lambda: total("n_tkt_promo"),
    # promo / no promo split by code
    "Ing_con_codigo": lambda: total_where(in_promo(), "Importe"),
    "Ing_sin_codigo": lambda: total_where(~in_promo(), "Importe"),
    "Und_con_codigo": lambda: total_where(coded_promo(), "Cantidad"),
    "Und_sin_codigo": lambda: total_where(~coded_promo(), "Cantidad"),
    "Ing_codigo_no_vacio": lambda: total_where(coded_promo(), "Importe"),
    # promo / no promo split by flag
    "Cant_promo": lambda: total_where(flagged(1), "Cantidad"),
    "Cant_sin_promo": lambda: total_where(flagged(0), "Cantidad"),
    "Ing_promo": lambda: total_where(flagged(1), "Importe"),
    "Ing_sin_promo": lambda: total_where(flagged(0), "Importe"),
    "Costo_promo": lambda: total_where(flagged(1), "Costo_total"),
    "Costo_sin_promo": lambda: total_where(flagged(0), "Costo_total"),
    # ratios
    "Mg_pct": lambda: over(_margin(), total("Importe")),
    "Desc_pct": lambda: over(_discount(), total("Precio_x_Cant")),
    "ROI": lambda: over(total("Importe"), _discount()),
    "Markup": lambda: over(_margin(), total("Costo_total")),
    "Precio_ef": lambda: over(total("Importe"), total("Cantidad")),
    "Precio_lista": lambda: over(total("Precio_x_Cant"), total("Cantidad")),
    "Costo_unit": lambda: over(total("Costo_total"), total("Cantidad")),
    "Mix_promo": lambda: over(total_where(in_promo(), "Importe"), total("Importe")),
    "Penetracion": lambda: over(total_where(flagged(1), "Cantidad"), total("Cantidad")),
    "Penetracion_ing": lambda: over(total_where(flagged(1), "Importe"), total("Importe")),
    # span and reach
    "Primer_mes": lambda: month_text(F.min(month_key())),
    "Ultimo_mes": lambda: month_text(F.max(month_key())),
    "Meses": _distinct("Anio_mes"),
    "N_tiendas": _distinct("Tiendas"),
    "N_promos": _distinct("Cod_promo"),
}


def measure(name: str, instead: Mapping[str, Column] | None = None) -> Column:
    """One measure by name; ``"Alias=Name"`` renames it, and ``instead`` may compute it another way."""
    alias, _, source = name.partition("=")
    source = source or alias
    return (instead[source] if instead and source in instead else MEASURES[source]()).alias(alias)


def measures(names: str | Iterable[str], instead: Mapping[str, Column] | None = None) -> list[Column]:
    parts = names.split() if isinstance(names, str) else list(names)
    return [measure(n, instead) for n in parts]
