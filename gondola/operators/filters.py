"""One filter specification, applied to every rollup with cross-filter propagation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, functions as F

from gondola.functions.cycles import cycle_of_month
from gondola.functions.text import matches
from gondola.sources.rollups import Rollups


@dataclass(frozen=True)
class FilterSpec:
    """Selections; an empty field selects everything, NULLs included."""

    months: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    systems: tuple[str, ...] = ()
    promo_text: str = ""
    product_text: str = ""
    product_code_text: str = ""
    cycle_years: tuple[str, ...] = ()
    cycle_numbers: tuple[str, ...] = ()
    years: tuple[str, ...] = ()
    promo_types: tuple[str, ...] = ()
    promo_cycles: tuple[str, ...] = ()
    promo_numbers: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    communes: tuple[str, ...] = ()
    formats: tuple[str, ...] = ()
    segments: tuple[str, ...] = ()
    stores: tuple[str, ...] = ()
    products: tuple[str, ...] = ()

    def is_empty(self) -> bool:
        return not any(_text(v) if isinstance(v, str) else v for v in vars(self).values())

    def by_store_attribute(self) -> bool:
        return bool(self.regions or self.communes or self.formats or self.segments)

    def narrows_sales(self) -> bool:
        """Whether sales are cut by anything but month and category.

        Those two cut the product tables in the same way, and both come from the same lines, so
        without a further choice the sales cannot lack a (month, category) the products have.
        """
        return replace(self, categories=()).by_more_than_months()

    def by_more_than_months(self) -> bool:
        return not replace(self, months=(), years=(), cycle_years=(), cycle_numbers=()).is_empty()

    def by_product(self) -> bool:
        return bool(self.products or _text(self.product_text) or _text(self.product_code_text))

    def without_full_selections(self, **facets: Iterable[str]) -> "FilterSpec":
        """Clear each field whose selection equals its whole facet list.

        Selecting every value means "no filter", which keeps rows where the column is NULL.
        """
        names = {f.name for f in fields(self)}
        full = {k: () for k, v in facets.items()
                if k in names and set(getattr(self, k)) == set(v)}
        return replace(self, **full)


def _text(value: str) -> str:
    return value.strip()


def _one_of(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    values = list(values)
    return df.where(F.col(column).isin(values)) if values else df


def _search(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(matches(F.col(column), _text(text))) if _text(text) else df


# --- facets -----------------------------------------------------------------------------------

def facet(df: DataFrame, column: str, skip_blank: bool = False) -> DataFrame:
    """Sorted distinct values of a filterable column."""
    values = df.select(column).where(F.col(column).isNotNull())
    if skip_blank:
        values = values.where(F.col(column) != "")
    return values.distinct().orderBy(column)


def year_facet(ventas: DataFrame) -> DataFrame:
    return facet(ventas.select(F.substring("Anio_mes", 1, 4).alias("Anio")), "Anio")


# --- single-table filters ---------------------------------------------------------------------

def month_facet(df: DataFrame) -> list[str]:
    """The months present in a table, in order.  They are its partition folders, so the list is as long
    as the calendar."""
    return [r[0] for r in df.select("Anio_mes").distinct().orderBy("Anio_mes").collect()]


def month_list(tables: Rollups, name: str) -> list[str]:
    """The months of one table of a set, in order, for the columns of a month matrix.

    Without other filters than those of months this is the list of folders, and no job runs (a folder whose
    rows are all of excluded categories is a month of it); else the months that have rows left.
    """
    if name in tables.months and not tables.narrowed:
        return list(tables.months[name])
    return month_facet(tables.table(name))


def known_months(tables: Rollups, name: str) -> list[str]:
    """Months in order that include all those of a table; no job where its folders are known."""
    return list(tables.months[name]) if name in tables.months else month_facet(tables.table(name))


def _cycle_months(spec: FilterSpec) -> list[str] | None:
    if not (spec.cycle_years or spec.cycle_numbers):
        return None
    return [
        month for month, cycle in cycle_of_month().items()
        if (not spec.cycle_years or cycle in spec.cycle_years)
        and (not spec.cycle_numbers or cycle.split("-")[0] in spec.cycle_numbers)
    ]


def filter_months(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Months ∩ years ∩ months of the chosen cycles: predicates on the partition column only, so
    they prune month folders at planning time."""
    df = _one_of(df, "Anio_mes", spec.months)
    if spec.years:
        df = df.where(F.substring("Anio_mes", 1, 4).isin(list(spec.years)))
    chosen = _cycle_months(spec)
    return df if chosen is None else df.where(F.col("Anio_mes").isin(chosen))


def months_left(months: Iterable[str], spec: FilterSpec) -> tuple[str, ...]:
    """What ``filter_months`` leaves of a list of months."""
    cycle = _cycle_months(spec)
    return tuple(m for m in months if (not spec.months or m in spec.months)
                 and (not spec.years or m[:4] in spec.years) and (cycle is None or m in cycle))


def filter_promo_code(ventas: DataFrame, spec: FilterSpec) -> DataFrame:
    ventas = _one_of(ventas, "TipoPromo", spec.promo_types)
    ventas = _one_of(ventas, "CicloAno_p", spec.promo_cycles)
    return _one_of(ventas, "PromoNum", spec.promo_numbers)


def stores_with(stores: DataFrame, spec: FilterSpec) -> DataFrame:
    """Store codes that carry the chosen attributes."""
    chosen = stores
    for column, values in (("Region", spec.regions), ("Comuna", spec.communes),
                           ("Formato", spec.formats), ("Segmento", spec.segments)):
        if column in stores.columns:
            chosen = _one_of(chosen, column, values)
    return chosen.select(F.col("FileCORR").cast("string").alias("Tiendas"))


def filter_stores(df: DataFrame, spec: FilterSpec, chosen: DataFrame | None) -> DataFrame:
    """By attribute (semi-join with the chosen codes), then by store code."""
    if chosen is not None:
        df = df.join(chosen, "Tiendas", "left_semi")
    return _one_of(df, "Tiendas", spec.stores)


def filter_products(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return _one_of(df, "Nom_prod", spec.products)


def only_promos(ventas: DataFrame) -> DataFrame:
    return ventas.where(F.col("Cod_promo").isNotNull())


def between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


# --- cross-filters ----------------------------------------------------------------------------

def measured(keys: DataFrame) -> tuple[DataFrame, int]:
    """A distinct key set, computed now, and its size.

    Once it is cached Spark plans with its true size: joins on it broadcast while it is under the
    broadcast threshold and shuffle beyond that, and a side filtered by a small key set is not
    shuffled at all.  Left to estimates, the large side would be shuffled before the small one had
    been measured.  A lost executor recomputes its part of the set.  ``Rollups.release`` drops it.
    """
    keys = keys.distinct().persist()
    return keys, keys.count()


def matching(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose values in the columns of ``wanted`` occur there; NULL matches NULL."""
    condition: Column = F.lit(True)
    for name in wanted.columns:
        condition = condition & df[name].eqNullSafe(wanted[name])
    return df.join(wanted, condition, "left_semi")


_MONTH_CATEGORY = ["Anio_mes", "Categoria"]


def apply_filters(
    tables: Rollups, stores: DataFrame, spec: FilterSpec, allow_empty: bool = False
) -> Rollups:
    """Every rollup under one specification.

    The store table lacks products and the product table lacks stores, so each choice travels to
    the other tables through their common key (month, category).  A side that comes out empty
    does not filter the others, unless ``allow_empty`` is set.  The key sets are computed here,
    one job each, and only where the specification makes them necessary; the returned tables are
    lazy.  The daily rollup is not filtered.  The key sets stay cached until the result is released;
    use it as a context manager, or call ``release``.
    """
    if spec.is_empty():
        return tables

    held: list[DataFrame] = []

    def usable(size: int) -> bool:
        return allow_empty or size > 0

    def kept(keys: DataFrame) -> tuple[DataFrame, int]:
        found, size = measured(keys)
        held.append(found)
        return found, size

    chosen = None
    if spec.by_store_attribute():
        codes, size = kept(stores_with(stores, spec))
        chosen = codes if usable(size) else None

    ventas = filter_months(tables.ventas, spec)
    for column, values in (("Categoria", spec.categories), ("Tipo", spec.types),
                           ("Sistema", spec.systems)):
        ventas = _one_of(ventas, column, values)
    ventas = _search(ventas, "Nom_promo", spec.promo_text)
    ventas = filter_stores(filter_promo_code(ventas, spec), spec, chosen)

    productos = _one_of(filter_months(tables.productos, spec), "Categoria", spec.categories)
    productos = _search(productos, "Nom_prod", spec.product_text)
    productos = _search(productos, "Cod_prod", spec.product_code_text)
    productos = filter_products(productos, spec)

    tickets = filter_stores(filter_months(tables.tickets, spec), spec, chosen)

    sold = None  # (month, category) of the filtered sales, while nothing changes them
    if spec.by_store_attribute() or spec.stores:
        sold, size = kept(ventas.select(*_MONTH_CATEGORY))
        if usable(size):
            productos = matching(productos, sold)
    if spec.by_product():
        keys, size = kept(productos.select(*_MONTH_CATEGORY))
        if usable(size):
            ventas, sold = matching(ventas, keys), None
            tickets = matching(tickets, keys.select("Anio_mes").distinct())

    promo_prod = _one_of(filter_months(tables.promo_prod, spec), "Categoria", spec.categories)
    promo_prod = filter_products(promo_prod, spec)
    if spec.narrows_sales():
        if sold is None:
            sold, size = kept(ventas.select(*_MONTH_CATEGORY))
        if usable(size):
            promo_prod = matching(promo_prod, sold)

    months = {name: listed if name == "ventas_dia" else months_left(listed, spec)
              for name, listed in tables.months.items()}
    chosen_tables = tables.with_tables(ventas=ventas, productos=productos, tickets=tickets, promo_prod=promo_prod)
    return replace(
        chosen_tables, months=months, narrowed=tables.narrowed or spec.by_more_than_months()).holding(held)


def drill_filter(ventas: DataFrame, spec: FilterSpec) -> DataFrame:
    """The narrower filter of a promo drill-down: no searches, promo codes or store attributes."""
    ventas = filter_months(ventas, spec)
    for column, values in (("Categoria", spec.categories), ("Tipo", spec.types),
                           ("Sistema", spec.systems), ("Tiendas", spec.stores)):
        ventas = _one_of(ventas, column, values)
    return ventas
