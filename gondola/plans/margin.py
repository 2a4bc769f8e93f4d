"""Product margin rankings, portfolio diagnosis, price and cost drift, repricing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gondola.functions import bands
from gondola.functions.whole import over_limited
from gondola.plans.reports import sorted_by

_PRODUCT = ["Producto", "Codigo", "Categoria"]


def top_margin(prod_mg: DataFrame, n: int = 15) -> DataFrame:
    return sorted_by(prod_mg, "-Mg_pct -Ingresos", _PRODUCT).limit(n)


def bottom_margin(prod_mg: DataFrame, n: int = 15) -> DataFrame:
    sold = prod_mg.where("Ingresos > 1000")
    return sorted_by(sold, "Mg_pct -Ingresos", _PRODUCT).limit(n)


def portfolio(prod_mg: DataFrame) -> DataFrame:
    """Quadrant of each product against the median margin and the median volume.

    ``prod_mg`` is a limited report, so the medians are taken over a bounded number of rows.
    """
    units = F.col("Unidades").cast("double")
    rows = prod_mg.where("Ingresos > 0").withColumns({
        "Mediana_und": over_limited(F.median(units)),
        "Mediana_mg": over_limited(F.median("Mg_pct")),
    })
    quadrant = bands.quadrant(F.col("Mg_pct"), units, F.col("Mediana_mg"), F.col("Mediana_und"))
    return rows.select(
        *_PRODUCT, "Unidades", "Mg_pct", "Ingresos", "Margen",
        F.greatest(F.col("Ingresos"), F.lit(0.01)).alias("Tamano"),
        "Mediana_und", "Mediana_mg", quadrant.alias("Cuadrante"),
    )


def product_list(prod_mg: DataFrame, n: int = 15) -> DataFrame:
    """First ``3n`` products by revenue, numbered, with a margin band.

    The window has no partition, but runs over the ``3n`` rows left by the limit.
    """
    first = sorted_by(prod_mg, "-Ingresos", _PRODUCT).limit(3 * n)
    order = Window.orderBy(F.col("Ingresos").desc_nulls_last(),
                           *[F.col(c).asc_nulls_last() for c in _PRODUCT])
    return first.withColumns({
        "Nro": F.row_number().over(order),
        "Estado": bands.product_state(F.col("Mg_pct")),
    })


def price_evolution(precio_evol: DataFrame, category: str | None = None) -> DataFrame:
    """Unweighted monthly mean of the category prices, costs and margins; total units."""
    rows = precio_evol.where(F.col("Categoria") == category) if category else precio_evol
    means = [F.avg(c).alias(c) for c in ("Precio_lista", "Precio_ef", "Costo_unit", "Mg_pct")]
    out = rows.groupBy("Anio_mes").agg(*means, F.sum("Unidades").alias("Unidades"))
    return sorted_by(out, "Anio_mes")


def _first(compresion: DataFrame, condition: str, n: int) -> DataFrame:
    return sorted_by(compresion.where(condition), "Delta_mg", ["Producto", "Categoria"]).limit(n)


def compressed(compresion: DataFrame, n: int = 15) -> DataFrame:
    return _first(compresion, "Delta_mg < -0.01", n)


def expanded(compresion: DataFrame, n: int = 15) -> DataFrame:
    return _first(compresion, "Delta_mg > 0.01", n)


def raise_price(compresion: DataFrame, n: int = 15) -> DataFrame:
    return _first(compresion, "Delta_mg < -0.02", n)


def lower_price(compresion: DataFrame, n: int = 15) -> DataFrame:
    return _first(compresion, "Mg_fin_pct > 35 AND Delta_mg > 0", n)
