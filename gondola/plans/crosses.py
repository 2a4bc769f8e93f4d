"""Cross analysis: margin by month, discount zones, promo intensity, price gap, elasticity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gondola.functions import bands
from gondola.functions.measures import over
from gondola.operators.filters import between, complete
from gondola.functions.whole import beside
from gondola.plans.promotions import month_matrix
from gondola.plans.reports import sorted_by

_PRODUCT = ["Producto", "Categoria"]


def margin_matrix(mg_cat_mes: DataFrame, months: list[str]) -> DataFrame:
    """Category by month margins, best row mean first; rows without any margin are left out.

    The mean is read off the row's own month columns, so the report is aggregated once.
    """
    wide = month_matrix(mg_cat_mes, "Categoria", "Mg_pct", months)
    known = F.filter(F.array(*[F.col(f"`{m}`") for m in months]), lambda x: x.isNotNull())
    mean = over(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    rows = wide.withColumn("Media", mean).where("Media IS NOT NULL")
    return sorted_by(rows, "-Media", ["Categoria"])


def margin_trend(mg_cat_mes: DataFrame) -> DataFrame:
    """Mean margin of the first half of the months against the second half.

    The first month of the second half is a scalar taken from the sorted list of months, whose
    length is bounded by the calendar.  With fewer than two months there is no trend.
    """
    listed = beside(mg_cat_mes, m=F.sort_array(F.collect_set("Anio_mes"))).getField("m")
    half = F.floor(F.size(listed) / 2).cast("int")
    cut = F.when(F.size(listed) >= 2, F.try_element_at(listed, half + 1))
    late = F.col("Anio_mes") >= F.col("_corte")
    rows = mg_cat_mes.withColumn("_corte", cut).groupBy("Categoria").agg(
        F.avg(F.when(~late, F.col("Mg_pct"))).alias("Mg_inicio"),
        F.avg(F.when(late, F.col("Mg_pct"))).alias("Mg_fin"),
    )
    rows = rows.dropna().withColumn("Delta", F.col("Mg_fin") - F.col("Mg_inicio"))
    return sorted_by(rows.withColumn("Tendencia", bands.trend(F.col("Delta"))), "Delta",
                     ["Categoria"])


def margin_volatility(mg_cat_mes: DataFrame, n: int = 15) -> DataFrame:
    rows = mg_cat_mes.groupBy("Categoria").agg(
        F.avg("Mg_pct").alias("Media"), F.stddev_samp("Mg_pct").alias("StdDev"),
        F.count("Mg_pct").alias("Meses"),
    )
    return sorted_by(rows.dropna(), "-StdDev", ["Categoria"]).limit(n)


def discount_zones(desc_mg_prod: DataFrame) -> DataFrame:
    rows = between(between(desc_mg_prod, "Desc_pct", 0, 1), "Mg_pct", -0.5, 1.0)
    return rows.withColumn("Zona", bands.discount_zone(F.col("Desc_pct"), F.col("Mg_pct")))


def zone_counts(zones: DataFrame) -> DataFrame:
    return zones.groupBy("Zona").agg(F.count(F.lit(1)).alias("Productos"))


def danger_zone(zones: DataFrame, n: int = 15) -> DataFrame:
    rows = zones.where(F.col("Zona").startswith("Peligro"))
    return sorted_by(rows, "-Ingresos", _PRODUCT).limit(n)


def promo_intensity(cat_promo_cross: DataFrame) -> DataFrame:
    """Categories with their margin band and the medians of promo mix and margin.

    The exact median holds one value per category, a dimension of the assortment.
    """
    middle = beside(cat_promo_cross, mix=F.median("Mix_promo"), mg=F.median("Mg_pct"))
    rows = cat_promo_cross.withColumns({
        "Mediana_mix": middle.getField("mix"),
        "Mediana_mg": middle.getField("mg"),
        "Estado": bands.promo_exposure_state(F.col("Mg_pct")),
    })
    return sorted_by(rows, "-Mg_pct", ["Categoria"])


def _means(*columns: str) -> list[Column]:
    return [F.avg(c).alias(c) for c in columns]


def price_gap_by_month(precio_gap: DataFrame, category: str | None = None) -> DataFrame:
    rows = precio_gap.where(F.col("Categoria") == category) if category else precio_gap
    out = rows.groupBy("Anio_mes").agg(*_means("Precio_lista", "Precio_ef", "Gap_pct"))
    return sorted_by(out, "Anio_mes")


def price_gap_by_category(precio_gap: DataFrame) -> DataFrame:
    out = precio_gap.groupBy("Categoria").agg(
        *_means("Gap_pct", "Precio_lista", "Precio_ef"), F.sum("Ingresos").alias("Ingresos"))
    return sorted_by(out, "-Gap_pct", ["Categoria"])


def price_volume_correlation(precio_evol: DataFrame) -> DataFrame:
    """Pearson correlation of monthly price and units per category.

    Only categories with three months or more and some movement in both series.  Written as
    covariance over the product of deviations, which gives NULL for a constant series where
    ``corr`` raises under ANSI rules; a month without a price takes no part in the pairs.
    """
    units = F.col("Unidades").cast("double")
    paired = F.when(F.col("Precio_ef").isNotNull(), units)
    rows = precio_evol.groupBy("Categoria").agg(
        F.covar_samp("Precio_ef", paired).alias("_cov"),
        F.stddev_samp("Precio_ef").alias("_sp"),
        F.stddev_samp(units).alias("_su"),
        F.stddev_samp(paired).alias("_sq"),
        F.count(F.lit(1)).alias("_n"),
        F.avg("Precio_ef").alias("Precio_prom"),
        F.avg(units).alias("Unidades_prom"),
        F.sum("Ingresos").alias("Ingresos_tot"),
    ).where("_n >= 3 AND _sp > 0 AND _su > 0")
    rows = rows.withColumn("Correlacion", over(F.col("_cov"), F.col("_sp") * F.col("_sq")))
    out = rows.select("Categoria", "Correlacion", "Precio_prom", "Unidades_prom", "Ingresos_tot",
                      bands.elasticity(F.col("Correlacion")).alias("Tipo"))
    return sorted_by(out, "Correlacion", ["Categoria"])


def price_ladder(price_ladder: DataFrame, category: str | None = None) -> DataFrame:
    """Products by falling price inside their category, with the gap to the list price.

    Without a category all ladders come at once, by a range-partitioned sort rather than a window
    per category, so a category with a third of the products is spread over many tasks.
    """
    rows = price_ladder.where(F.col("Categoria") == category) if category else price_ladder
    gap = over(F.col("Precio_lista") - F.col("Precio_ef"), F.col("Precio_lista")) * 100
    out = complete(rows, ["Precio_ef"]).withColumn("Gap_lista", F.bround(gap, 1))
    return sorted_by(out, "Categoria -Precio_ef", ["Producto"])
