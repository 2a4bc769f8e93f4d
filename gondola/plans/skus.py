"""Product (SKU) rankings.  The input report holds at most 500 rows, whatever the data size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gondola.operators.filters import complete
from gondola.functions.whole import over_limited
from gondola.plans.reports import sorted_by

# Metrics a ranking can be ordered by; a low discount ranks first.
METRICS = ["Ingresos", "Margen", "Unidades", "Mg_pct", "Desc_pct"]
_TIES = ["Producto", "Categoria"]


def selection(sku_ranking: DataFrame, category: str | None = None) -> DataFrame:
    return sku_ranking.where(F.col("Categoria") == category) if category else sku_ranking


def _order(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return metric if metric == "Desc_pct" else f"-{metric}"


def best(rows: DataFrame, metric: str = "Ingresos", n: int = 30) -> DataFrame:
    return sorted_by(rows, _order(metric), _TIES).limit(n)


def worst(rows: DataFrame, metric: str = "Ingresos", n: int = 30) -> DataFrame:
    """The last ``n`` of the ranking, lowest value of the metric first."""
    flipped = [c.desc_nulls_first() if metric == "Desc_pct" else c.asc_nulls_first()
               for c in [F.col(metric)]]
    tail = rows.orderBy(*flipped, *[F.col(t).desc_nulls_first() for t in _TIES]).limit(n)
    return sorted_by(tail, metric, _TIES)


def lowest_margin(rows: DataFrame, n: int = 30) -> DataFrame:
    return sorted_by(rows, "Mg_pct", _TIES).limit(n)


def selection_kpis(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("SKUs"),
        F.sum("Ingresos").alias("Ingresos"),
        F.avg("Mg_pct").alias("Mg_pct"),
        F.avg("Desc_pct").alias("Desc_pct"),
    )


def position_map(rows: DataFrame, metric: str = "Ingresos", n: int = 100) -> DataFrame:
    """First ``n`` of the ranking with the medians of revenue and margin among them."""
    first = complete(best(rows, metric, n), ["Mg_pct", "Ingresos"])
    return first.withColumns({
        "Mediana_ing": over_limited(F.median(F.col("Ingresos").cast("double"))),
        "Mediana_mg": over_limited(F.median("Mg_pct")),
        "Tamano": F.greatest(F.col("Unidades"), F.lit(0.01)),
    })


def tercile_table(rows: DataFrame, metric: str = "Ingresos") -> DataFrame:
    """The numbered ranking with a light at the 66 % and 33 % quantiles of the margin."""
    high, low = (over_limited(F.percentile("Mg_pct", q)) for q in (0.66, 0.33))
    margin = F.col("Mg_pct")
    light = F.when(margin > high, "OK").when(margin > low, "MED").otherwise("LOW")
    return rows.withColumns({"Nro": F.row_number().over(_numbering(metric)), "Semaforo": light})


def _numbering(metric: str) -> Window:
    def key(name: str) -> Column:
        column = F.col(name.lstrip("-"))
        return column.desc_nulls_last() if name[0] == "-" else column.asc_nulls_last()

    return Window.orderBy(*[key(c) for c in [_order(metric), *_TIES]])
