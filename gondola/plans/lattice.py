"""Shared sub-aggregates: the reports of one filter choice from few passes over the rollups.

A refresh of all reports would scan each rollup once a report.  Most of them group by month, category, store,
promo or product alone, so a small lattice of sub-aggregates answers them: ``shared`` computes those of one
rollup together (grouping sets, one scan, partial sums before the shuffle), keeps them cached, and
``run_report`` takes the first one that covers a report.  A sub-aggregate covers a report that needs nothing but
its columns: grouping columns, sums, the promo split, and distinct months and stores, which are kept as bits.
Reports that need more read their rollup as before.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from gondola.functions.bits import MAX_WORDS, Dimension
from gondola.functions.measures import month_key, month_text
from gondola.operators.filters import only_promos
from gondola.operators.normalize import PROMO_CODE_COLUMNS
from gondola.plans.reports import Report, no_condition, with_promo_cycle, with_store
from gondola.schema import MEASURES as AMOUNTS
from gondola.sources.rollups import Rollups

#: Whether a row has a promo code, and one that is not blank, in the place of the code itself.
SPLIT = "con_promo"
_PROMO = ("Nom_promo", "Cod_promo", *PROMO_CODE_COLUMNS)

#: Sub-aggregates of each rollup: their grouping columns, the smallest first.
SETS: dict[str, list[tuple[str, ...]]] = {
    "ventas": [("Anio_mes", "Categoria", SPLIT), ("Anio_mes", "Tiendas", SPLIT), (*_PROMO, "Categoria")],
    "productos": [("Cod_prod", "Nom_prod", "Categoria")],
    "promo_prod": [("Anio_mes", "Categoria", "has_promo"), ("Cod_prod", "Nom_prod", "Categoria", "has_promo")],
}

#: Columns behind the keys and measures of a report.
_KEY_NEEDS = {
    "month": "Anio_mes", "year": "Anio_mes", "month_no": "Anio_mes", "store": "Tiendas", "cat": "Categoria",
    "sin_cat": "Categoria", "prod": "Nom_prod Cod_prod", "prod_short": "Nom_prod Cod_prod",
    "prod_code": "Cod_prod", "promo": "Nom_promo Cod_promo", "promo_code": "Cod_promo", "cycle": "CicloAno_p",
    "mechanic": "Nom_promo", "modality": "TipoPromo", "type": "Tipo", "system": "Sistema",
}
_MEASURE_NEEDS = {
    "N_promos": "Cod_promo", "Mix_promo": SPLIT,
    **dict.fromkeys(["Ing_con_codigo", "Ing_sin_codigo", "Und_con_codigo", "Und_sin_codigo",
                     "Ing_codigo_no_vacio"], SPLIT),
    **dict.fromkeys(["Cant_promo", "Cant_sin_promo", "Ing_promo", "Ing_sin_promo", "Costo_promo",
                     "Costo_sin_promo", "Penetracion", "Penetracion_ing"], "has_promo"),
}
_CONDITION_NEEDS = {no_condition: "", only_promos: SPLIT, with_store: "Tiendas",
                    with_promo_cycle: f"{SPLIT} CicloAno_p"}
#: Distinct counts, which need the column itself where no bits of it are kept.
_COUNTED = {"Meses": "Anio_mes", "N_tiendas": "Tiendas"}


def needs(report: Report) -> set[str] | None:
    """Columns a report cannot do without; None if that is not known."""
    if report.where not in _CONDITION_NEEDS:
        return None
    found = set(_CONDITION_NEEDS[report.where].split())
    for key in report.keys.split():
        found |= set(_KEY_NEEDS[key].split())
    for name in report.measures.split():
        found |= set(_MEASURE_NEEDS.get(name.rpartition("=")[2], "").split())
    return found


@dataclass(frozen=True)
class Aggregates:
    """The cached sub-aggregates of one rollup, told apart by ``_conjunto``."""

    rows: DataFrame
    sets: list[tuple[str, ...]]
    dimensions: list[Dimension]

    def source(self, report: Report) -> tuple[DataFrame, dict[str, Column]] | None:
        wanted, spans = needs(report), self._spans()
        if wanted is None:
            return None
        measured = {name.rpartition("=")[2] for name in report.measures.split()}
        wanted |= {column for name, column in _COUNTED.items() if name in measured and name not in spans}
        for k, columns in enumerate(self.sets):
            given = set(columns) | ({SPLIT} if "Cod_promo" in columns else set())
            if wanted <= given:
                rows = self.rows.where(F.col("_conjunto") == k)
                if SPLIT in columns:
                    rows = rows.withColumn("Cod_promo", F.col(SPLIT))
                return rows, spans
        return None

    def _spans(self) -> dict[str, Column]:
        spans = {"Primer_mes": month_text(F.min("_primer")), "Ultimo_mes": month_text(F.max("_ultimo"))}
        counted = {column: name for name, column in _COUNTED.items()}
        return spans | {counted[d.column]: d.count_stored() for d in self.dimensions}


@dataclass(frozen=True)
class Lattice:
    tables: dict[str, Aggregates]

    def source(self, report: Report) -> tuple[DataFrame, dict[str, Column]] | None:
        """Rows that stand for the report's rollup, and how to compute its spans; None if none covers it."""
        found = self.tables.get(report.table)
        return found.source(report) if found else None


def aggregates(tables: Rollups, name: str) -> Aggregates:
    """The sub-aggregates of one rollup, in one pass over it and cached."""
    rows, sets = tables.table(name), SETS[name]
    dimensions = [tables.dimension(c) for c in _COUNTED.values()] if name == "ventas" else []
    # of a dimension with more values no bits are kept, and reports that count it read the rollup
    dimensions = [d for d in dimensions if d.words() <= MAX_WORDS]
    for d in dimensions:
        rows = d.numbered(rows)
    if name == "ventas":
        rows = rows.withColumn(SPLIT, F.when(F.col("Cod_promo").isNotNull(), F.when(
            F.trim("Cod_promo") == "", "").otherwise("si")))
    columns = list(dict.fromkeys(c for s in sets for c in s))
    bits = [d.word(k).alias(n) for d in dimensions for k, n in enumerate(d.stored())]
    sums = [F.sum(m).alias(m) for m in AMOUNTS]
    # month spans come from a column of their own: the grouping column is null in the sets without it
    rows = rows.withColumn("_mes", month_key())
    spans = [F.min("_mes").alias("_primer"), F.max("_mes").alias("_ultimo")]
    wanted = [*columns, "_mes", *AMOUNTS, *[d.number for d in dimensions]]
    grouped = rows.select(*wanted).groupingSets([list(s) for s in sets], *columns).agg(
        F.grouping_id().alias("_grupo"), *sums, *bits, *spans)
    number = F.lit(None).cast("int")
    for k, s in enumerate(sets):
        mask = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
        number = F.when(F.col("_grupo") == mask, k).otherwise(number)
    return Aggregates(grouped.withColumn("_conjunto", number).drop("_grupo").persist(), sets, dimensions)


def shared(tables: Rollups) -> Rollups:
    """The same tables, whose reports come from shared sub-aggregates where these cover them.

    To be used as a context manager or released, like a filtered set; filters are applied before.  The
    sub-aggregates are computed when a first report runs.  Lost parts of them are computed again.
    """
    found = {name: aggregates(tables, name) for name in SETS}
    held = [a.rows for a in found.values()]
    return replace(tables, shared=Lattice(found), held=tuple(held))
