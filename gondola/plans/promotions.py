"""Promo coverage, fatigue, penetration, rankings, evolution, tickets and the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gondola.functions import bands
from gondola.functions.cycles import attach_cycle
from gondola.functions.measures import over
from gondola.functions.text import code_cycle, matches, normalized_code, promo_label
from gondola.operators.rollup import period
from gondola.functions.whole import beside, one_row, over_limited
from gondola.plans.reports import sorted_by

_PROMO_ROW = ["Promo", "Cod_promo", "Categoria"]


# --- coverage, totals, month matrix, fatigue --------------------------------------------------

def promo_coverage(promos: DataFrame, kpis_t: DataFrame) -> DataFrame:
    """Stores reached over active stores, and the traffic light."""
    active = one_row(kpis_t, "tiendas").getField("tiendas")
    reach = F.coalesce(over(F.col("Tiendas"), active), F.lit(0.0))
    out = promos.withColumn("Cobertura", reach)
    light = bands.promo_light(F.col("Mg_pct"), F.col("ROI"), F.col("Cobertura"))
    return sorted_by(out.withColumn("Semaforo", light), "-Ingresos", ["Promo", "Cod_promo"])


def promo_totals(coverage: DataFrame) -> DataFrame:
    def count(light: str) -> Column:
        return F.count_if(F.col("Semaforo") == light)

    sums = coverage.agg(
        F.coalesce(F.sum("Ingresos"), F.lit(0)).alias("Ing_promo"),
        F.coalesce(F.sum("Margen"), F.lit(0)).alias("Margen_promo"),
        F.coalesce(F.sum("Descuento"), F.lit(0)).alias("Inversion"),
        count("Buena").alias("Buenas"),
        count("Regular").alias("Regulares"),
        count("Crítica").alias("Criticas"),
    )
    roi = F.when(F.col("Inversion") > 0, over(F.col("Ing_promo"), F.col("Inversion")))
    return sums.withColumn("ROI_global", F.coalesce(roi, F.lit(0.0)))


def month_matrix(
    df: DataFrame, row: str, value: str, months: list[str], fill: float | None = None
) -> DataFrame:
    """One column per month of the given list (see ``month_facet``)."""
    wide = df.groupBy(row).pivot("Anio_mes", months).agg(F.sum(value))
    return wide if fill is None else wide.fillna(fill, subset=months)


def promo_month_matrix(heatmap_promo: DataFrame, months: list[str]) -> DataFrame:
    return sorted_by(month_matrix(heatmap_promo, "Promo", "Ingresos", months, 0), "Promo")


def promo_fatigue(ventas: DataFrame) -> DataFrame:
    """Last month against the one two rows back, for every promo with three months or more.

    Rows are first summed per promo and month, so a window partition holds at most one row per
    calendar month even for a promo that makes up a third of the sales.  A label counts as a promo
    when any of its rows has a code.
    """
    monthly = ventas.groupBy(promo_label().alias("Promo"), "Anio_mes").agg(
        F.sum("Importe").alias("Ingresos"),
        F.max(F.col("Cod_promo").isNotNull()).alias("_codigo"),
    )
    by_month = Window.partitionBy("Promo").orderBy("Anio_mes")
    whole = Window.partitionBy("Promo")
    rows = monthly.select(
        "Promo", F.col("Anio_mes").alias("Ultimo_mes"), F.col("Ingresos").alias("Ing_ultimo"),
        F.lag("Ingresos", 2).over(by_month).alias("Ing_base"),
        F.row_number().over(by_month).alias("Meses"),
        F.count(F.lit(1)).over(whole).alias("_meses"),
        F.max("_codigo").over(whole).alias("_codigo"),
    ).where("Meses = _meses AND Meses >= 3 AND _codigo")
    last, base = F.col("Ing_ultimo").cast("double"), F.col("Ing_base").cast("double")
    state = (
        F.when(last < base * 0.75, "Fatiga").when(last > base * 1.20, "Crecimiento")
        .otherwise("Estable")
    )
    return rows.select("Promo", "Ultimo_mes", "Meses", "Ing_ultimo", "Ing_base",
                       (over(last, base) - 1).alias("Variacion"), state.alias("Estado"))


# --- penetration ------------------------------------------------------------------------------

def penetration_totals(penetracion_prod: DataFrame) -> DataFrame:
    sums = penetracion_prod.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
          for c in ("Cant_total", "Cant_promo", "Cant_sin_promo", "Ingresos", "Ing_promo")],
        F.count(F.lit(1)).alias("Productos"),
    )

    def positive_ratio(top: str, bottom: str) -> Column:
        ratio = F.when(F.col(bottom) > 0, over(F.col(top), F.col(bottom)))
        return F.coalesce(ratio, F.lit(0.0))

    return sums.withColumns({
        "Pen_unidades": positive_ratio("Cant_promo", "Cant_total"),
        "Pen_ingresos": positive_ratio("Ing_promo", "Ingresos"),
    })


def penetration_by_month(penetracion_mes: DataFrame) -> DataFrame:
    return sorted_by(attach_cycle(penetracion_mes, "CicloAno"), "Anio_mes")


def penetration_matrix(penetracion_cat_mes: DataFrame, months: list[str]) -> DataFrame:
    """Category by month, a missing month as 0, highest mean over the listed months first."""
    wide = month_matrix(penetracion_cat_mes, "Categoria", "Penetracion", months, 0)
    row_sum = sum((F.col(f"`{m}`") for m in months), F.lit(0.0))
    mean = over(row_sum, F.lit(len(months)))
    return sorted_by(wide.withColumn("Media", mean), "-Media", ["Categoria"])


def penetrated_products(
    penetracion_prod: DataFrame, minimum: float = 0.20, category: str | None = None,
    n: int = 15, complete_only: bool = False,
) -> DataFrame:
    """Best sellers above a minimum penetration, with margin inside and outside promos."""
    rows = penetracion_prod.where(F.col("Penetracion") >= minimum)
    if category:
        rows = rows.where(F.col("Categoria") == category)
    top = sorted_by(rows, "-Ingresos", ["Producto", "Categoria"]).limit(n)

    def margin(kind: str) -> Column:
        income = F.col(f"Ing_{kind}")
        return over(income - F.col(f"Costo_{kind}"), income)

    out = top.withColumns({"Mg_promo": margin("promo"), "Mg_sin_promo": margin("sin_promo")})
    return out.dropna(subset=["Mg_promo", "Mg_sin_promo"]) if complete_only else out


def penetration_table(penetracion_prod: DataFrame, category: str | None = None) -> DataFrame:
    rows = penetracion_prod
    if category:
        rows = rows.where(F.col("Categoria") == category)
    out = rows.withColumn("Alerta", bands.penetration_alert(F.col("Penetracion")))
    return sorted_by(out, "-Penetracion", ["Producto", "Categoria"])


def category_penetration(pen_cat_v: DataFrame, n: int = 20) -> DataFrame:
    rate = over(F.col("Unidades_promo"), F.col("Unidades_total"))
    out = pen_cat_v.withColumn("Penetracion", rate).withColumn(
        "Pct_sin", 1 - F.coalesce("Penetracion", F.lit(0.0)))
    return sorted_by(out, "-Penetracion", ["Categoria"]).limit(n)


# --- catalogue --------------------------------------------------------------------------------

def with_catalog(
    rows: DataFrame, catalog: DataFrame, no_format: str, normalize: bool
) -> DataFrame:
    """Pack size and format of each promo row; pack 1 where the catalogue has no such code.

    The catalogue holds one row per code, so rows keep their number.  It is not hinted: Spark
    broadcasts it while its size allows and shuffles it beyond that, where adaptive execution
    splits a code that many rows share.
    """
    return _packed(rows, catalog, no_format, normalize).drop("_codigo")


def _packed(rows: DataFrame, catalog: DataFrame, no_format: str, normalize: bool) -> DataFrame:
    """As ``with_catalog``, keeping the matched catalogue code."""
    code = normalized_code(F.col("Cod_promo")) if normalize else F.col("Cod_promo")
    packs = catalog.select(F.col("Cod_promo").alias("_codigo"), "Formato_promo",
                           "Unidades_por_promo")
    return rows.join(packs, code == F.col("_codigo"), "left").withColumns({
        "Unidades_por_promo": F.coalesce("Unidades_por_promo", F.lit(1)),
        "Formato_promo": F.coalesce("Formato_promo", F.lit(no_format)),
    })


def _transactions() -> Column:
    return over(F.col("Unidades"), F.col("Unidades_por_promo"))


def _whole_transactions() -> Column:
    return F.bround(_transactions(), 0).cast("bigint")


def promo_kpis(
    sku_por_promo: DataFrame, pen_cat_v: DataFrame, catalog: DataFrame, normalize: bool = False
) -> DataFrame:
    """Promo totals with units turned into transactions by pack size."""
    packed = with_catalog(sku_por_promo, catalog, "–", normalize)
    all_units = F.coalesce(pen_cat_v.agg(F.sum("Unidades_total")).scalar(), F.lit(0))
    sums = packed.agg(
        F.coalesce(F.sum("Ingresos"), F.lit(0)).alias("Ing_promo"),
        F.coalesce(F.sum("Unidades"), F.lit(0)).alias("Und_promo"),
        F.count(F.lit(1)).alias("Filas_promo"),
        F.coalesce(F.sum(_transactions()), F.lit(0.0)).alias("Transacciones"),
    ).withColumn("Und_total", all_units)
    some = F.col("Und_total") > 0
    rest = F.col("Und_total") - F.col("Und_promo")
    return sums.withColumns({
        "Und_sin_promo": F.when(some, rest).otherwise(F.lit(0)),
        "Penetracion": F.when(some, over(F.col("Und_promo"), F.col("Und_total")))
        .otherwise(F.lit(0.0)),
    })


# Columns a promo ranking can be ordered by.
RANKING_ORDERS = ["Transacciones", "Unidades", "Ingresos", "Penetracion", "Participacion"]


def promo_ranking(
    sku_por_promo: DataFrame, catalog: DataFrame, order: str = "Transacciones", n: int = 20,
    category: str | None = None, text: str = "", normalize: bool = False,
) -> DataFrame:
    """Top promo rows with transactions, share of units and share of transactions."""
    if order not in RANKING_ORDERS:
        raise ValueError(f"order must be one of {RANKING_ORDERS}")
    rows = sku_por_promo
    if category:
        rows = rows.where(F.col("Categoria") == category)
    if text.strip():
        rows = rows.where(matches(F.col("Promo"), text.strip()))
    packed = with_catalog(rows, catalog, "–", normalize)
    packed = packed.withColumn("Transacciones", _whole_transactions())
    totals = beside(packed, und=F.sum("Unidades"), tr=F.sum("Transacciones"))

    def share(column: str, whole: Column) -> Column:
        return F.when(whole > 0, over(F.col(column), whole)).otherwise(F.lit(0.0))

    out = packed.withColumns({
        "Penetracion": share("Unidades", totals.getField("und")),
        "Participacion": share("Transacciones", totals.getField("tr")),
    })
    return sorted_by(out, f"-{order} -Ingresos", _PROMO_ROW).limit(n)


def ranking_mix(ranking: DataFrame) -> DataFrame:
    """Each ranked row's share of the ranked revenue and transactions."""
    def share(column: str) -> Column:
        return over(F.col(column), over_limited(F.sum(column)))

    return ranking.select(
        *_PROMO_ROW, "Ingresos", "Transacciones",
        share("Ingresos").alias("Mix_ingresos"), share("Transacciones").alias("Mix_transacciones"))


def catalog_transactions(sku_por_promo: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every promo row with catalogue format, pack size and whole transactions."""
    packed = with_catalog(sku_por_promo, catalog, "Sin catalogo", normalize=True)
    out = packed.withColumn("Transacciones_promo", _whole_transactions())
    return sorted_by(out, "-Transacciones_promo", _PROMO_ROW)


def top_catalog_transactions(transactions: DataFrame, n: int = 20) -> DataFrame:
    return sorted_by(transactions, "-Transacciones_promo", _PROMO_ROW).limit(n)


def unsold_promos(catalog: DataFrame, sku_por_promo: DataFrame) -> DataFrame:
    """Planned promos that no sale refers to."""
    sold = sku_por_promo.select(normalized_code(F.col("Cod_promo")).alias("_codigo")).distinct()
    left = catalog.join(sold, normalized_code(F.col("Cod_promo")) == F.col("_codigo"), "left_anti")
    out = left.select(
        F.col("Cod_promo").alias("Codigo"), F.col("Nom_promo").alias("Nombre"),
        F.col("Formato_promo").alias("Formato"), F.col("Unidades_por_promo").alias("Pack"),
        code_cycle(F.col("Cod_promo")).alias("Ciclo"),
    )
    return sorted_by(out, "Ciclo", ["Codigo"])


def catalog_coverage(sku_por_promo: DataFrame, catalog: DataFrame) -> DataFrame:
    """Planned, sold and unsold promos, and their ratio.

    ``Cobertura`` counts every sold code, planned or not; ``Cobertura_catalogo`` only planned ones.
    """
    sold = _packed(sku_por_promo, catalog, "Sin catalogo", normalize=True).agg(
        F.countDistinct(normalized_code(F.col("Cod_promo"))).alias("Con_venta"),
        F.countDistinct("_codigo").alias("_planeadas"),
        F.coalesce(F.sum(_whole_transactions()), F.lit(0)).alias("Transacciones"),
    )
    n = F.col("Planificadas")
    return (
        sold.withColumn("Planificadas", catalog.agg(F.count(F.lit(1))).scalar())
        .withColumns({
            "Sin_venta": n - F.col("_planeadas"),
            "Cobertura": F.coalesce(over(F.col("Con_venta"), n), F.lit(0.0)),
            "Cobertura_catalogo": F.coalesce(over(F.col("_planeadas"), n), F.lit(0.0)),
        })
        .drop("_planeadas")
    )


# --- modality and evolution -------------------------------------------------------------------

def modality_mix(
    modalidad_venta: DataFrame, metric: str = "Unidades", category: str | None = None
) -> DataFrame:
    rows = modalidad_venta
    if category:
        rows = rows.where(F.col("Categoria") == category)
    out = rows.groupBy("Modalidad").agg(F.sum(metric).alias(metric))
    return sorted_by(out, f"-{metric}", ["Modalidad"])


def _series(
    rows: DataFrame, when: Column, metric: str, split: tuple[str, str] | None,
    promo: str, amounts: dict[str, str],
) -> DataFrame:
    """Sum or distinct promo count per period; rows without a breakdown value are left out."""
    keys = [when.alias("Periodo")]
    if split:
        column, alias = split
        rows = rows.where(F.col(column).isNotNull())
        keys.append(F.col(column).alias(alias))
    value = F.countDistinct(promo) if metric == "N_promos" else F.sum(amounts[metric])
    out = rows.groupBy(*keys).agg(value.alias("Valor"))
    return sorted_by(out, "Periodo", [split[1]] if split else [])


def daily_evolution(
    ventas_dia: DataFrame, grain: str, metric: str = "Ingresos", breakdown: str | None = None,
    category: str | None = None, text: str = "",
) -> DataFrame:
    """Revenue, units or distinct promos per day, week or month.

    Reads the daily rollup, which the filter specification does not touch.
    """
    rows = ventas_dia
    if category:
        rows = rows.where(F.col("Categoria") == category)
    if text.strip():
        rows = rows.where(matches(F.col("Nom_promo"), text.strip()))
    split = {"Categoria": ("Categoria", "Categoria"), "Promo": ("Nom_promo", "Promo")}
    return _series(rows, period(grain), metric, split.get(breakdown), "Nom_promo",
                   {"Ingresos": "Importe", "Unidades": "Cantidad"})


def _promo_search(evo_ciclo: DataFrame, category: str | None, text: str) -> DataFrame:
    rows = evo_ciclo.where(F.col("Categoria") == category) if category else evo_ciclo
    return rows.where(matches(F.col("Promo"), text.strip())) if text.strip() else rows


def cycle_evolution(
    evo_ciclo: DataFrame, metric: str = "Ingresos", breakdown: str | None = None,
    category: str | None = None, text: str = "",
) -> DataFrame:
    """Revenue, units or distinct promos per promo cycle."""
    split = (breakdown, breakdown) if breakdown else None
    return _series(_promo_search(evo_ciclo, category, text), F.col("Ciclo"), metric, split,
                   "Promo", {"Ingresos": "Ingresos", "Unidades": "Unidades"})


def promo_lines(
    evo_ciclo: DataFrame, text: str, metric: str = "Ingresos", category: str | None = None
) -> DataFrame:
    """One line per promo that matches a search, by cycle."""
    value = "Ingresos" if metric == "N_promos" else metric
    rows = _promo_search(evo_ciclo, category, text)
    out = rows.groupBy("Ciclo", "Promo").agg(F.sum(value).alias(value))
    return sorted_by(out, "Ciclo Promo")


# --- tickets ----------------------------------------------------------------------------------

def _priced_months(ticket_promo_mes: DataFrame) -> DataFrame:
    return ticket_promo_mes.dropna(subset=["Tkt_con_promo", "Tkt_sin_promo"])


def ticket_uplift(ticket_promo_mes: DataFrame) -> DataFrame:
    """Average ticket with, without and regardless of promo, and the uplift."""
    def average(income: str, count: str) -> Column:
        tickets = F.sum(count)
        ratio = F.when(tickets > 0, over(F.sum(income), tickets))
        return F.coalesce(ratio, F.lit(0.0))

    out = _priced_months(ticket_promo_mes).agg(
        average("Ing_promo", "Tkts_promo").alias("Tkt_con_promo"),
        average("Ing_sin_promo", "Tkts_sin_promo").alias("Tkt_sin_promo"),
        average("Ing_total", "Tkts_total").alias("Tkt_global"),
    )
    plain = F.col("Tkt_sin_promo")
    uplift = F.when(plain > 0, over(F.col("Tkt_con_promo") - plain, plain))
    return out.withColumn("Uplift", F.coalesce(uplift, F.lit(0.0)))


def ticket_uplift_by_month(ticket_promo_mes: DataFrame) -> DataFrame:
    plain = F.col("Tkt_sin_promo")
    out = _priced_months(ticket_promo_mes).select(
        "Anio_mes", "Tkt_con_promo", "Tkt_sin_promo",
        over(F.col("Tkt_con_promo") - plain, plain).alias("Uplift"))
    return sorted_by(out.dropna(subset=["Uplift"]), "Anio_mes")
