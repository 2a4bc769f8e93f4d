"""Pricing alerts on products and promos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gondola.functions import bands
from gondola.functions.measures import over
from gondola.operators.filters import between
from gondola.functions.whole import one_row
from gondola.plans.reports import sorted_by

_PRODUCT = ["Producto", "Categoria"]

# Condition of each alert, shared by the lists and the counters.
PRODUCT_ALERTS = {
    "Margen_negativo": "Mg_pct < 0",
    "Margen_bajo": "Mg_pct >= 0 AND Mg_pct < 0.05 AND Ingresos > 50000",
    "Descuento_alto": "Desc_pct > 0.30D",
    "Bajo_costo": "Precio_ef < Costo_unit",
}
PROMO_ALERTS = {
    "ROI_bajo": "ROI < 1",
    "Descuento_excesivo": "Desc_pct > 0.40D",
}


def negative_margin(alertas: DataFrame) -> DataFrame:
    return sorted_by(alertas.where(PRODUCT_ALERTS["Margen_negativo"]), "Margen", _PRODUCT)


def low_margin(alertas: DataFrame) -> DataFrame:
    return sorted_by(alertas.where(PRODUCT_ALERTS["Margen_bajo"]), "-Ingresos", _PRODUCT)


def high_discount(alertas: DataFrame) -> DataFrame:
    return sorted_by(alertas.where(PRODUCT_ALERTS["Descuento_alto"]), "-Desc_pct", _PRODUCT)


def below_cost(alertas: DataFrame) -> DataFrame:
    gap = F.col("Precio_ef") - F.col("Costo_unit")
    rows = alertas.where(PRODUCT_ALERTS["Bajo_costo"]).withColumn("Gap", gap)
    return sorted_by(rows, "Gap", _PRODUCT)


def low_roi(alertas_promo: DataFrame) -> DataFrame:
    return sorted_by(alertas_promo.where(PROMO_ALERTS["ROI_bajo"]), "-Inversion", ["Promo"])


def excessive_discount(alertas_promo: DataFrame) -> DataFrame:
    rows = alertas_promo.where(PROMO_ALERTS["Descuento_excesivo"])
    return sorted_by(rows, "-Desc_pct", ["Promo"])


def alert_counts(alertas: DataFrame, alertas_promo: DataFrame) -> DataFrame:
    """One row of six counters: one pass over the products and one over the promos."""
    def counters(alerts: dict[str, str]) -> list[Column]:
        return [F.count_if(F.expr(c)).alias(name) for name, c in alerts.items()]

    promos = one_row(alertas_promo.agg(*counters(PROMO_ALERTS)))
    return alertas.agg(*counters(PRODUCT_ALERTS)).withColumns(
        {name: promos.getField(name) for name in PROMO_ALERTS})


def margin_band_top(alertas: DataFrame, n: int = 20) -> DataFrame:
    """Best sellers whose margin lies within ±200 %, with their band."""
    rows = between(alertas, "Mg_pct", -2, 2)
    rows = rows.withColumn("Estado", bands.margin_alert(F.col("Mg_pct")))
    return sorted_by(rows, "-Ingresos", _PRODUCT).limit(n)


def category_alerts(alertas: DataFrame) -> DataFrame:
    """Revenue-weighted margin per category with the number of weak products."""
    rows = alertas.groupBy("Categoria").agg(
        F.sum("Margen").alias("_margen"),
        F.sum("Ingresos").alias("Ingresos"),
        F.count(F.lit(1)).alias("Productos"),
        F.count_if(F.col("Mg_pct") < 0).alias("Neg"),
        F.count_if((F.col("Mg_pct") >= 0) & (F.col("Mg_pct") < 0.05)).alias("Bajo"),
    )
    weighted = F.when(F.col("Ingresos") > 0, over(F.col("_margen"), F.col("Ingresos")))
    rows = rows.withColumn("Mg_pct_w", F.coalesce(weighted, F.lit(0.0))).drop("_margen")
    rows = rows.withColumn("Estado", bands.margin_alert(F.col("Mg_pct_w")))
    return sorted_by(rows, "Mg_pct_w", ["Categoria"])
