"""The filter specification, against a plain pandas restatement on a small fixture."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gondola import FilterSpec, Rollups, apply_filters
from gondola.operators.filters import measured, drill_filter, facet, filter_months, matching
from gondola.operators.normalize import promo_code_parts
from gondola.schema import MEASURES

MONTHS = ["2024-01", "2024-02", "2024-03", "2025-01"]


@pytest.fixture(scope="module")
def frames():
    cats, stores, kinds = ["A", "B", None], ["1", "2", "3"], ["x", None]
    ventas, productos, promo_prod, tickets = [], [], [], []
    for i, m in enumerate(MONTHS):
        for j, c in enumerate(cats):
            for k, s in enumerate(stores):
                if (i + j + k) % 3 == 0:
                    code = f"C1-2024-0{k}-CIRM" if (i + k) % 2 else None
                    ventas.append((m, s, c, code, f"Promo {s}" if code else None, kinds[i % 2],
                                   "S", 10 + i, 1))
            for p in ("Cola", "Pan", None):
                productos.append((m, f"c{p}", p, c, 5 + j, 1))
                promo_prod += [(m, f"c{p}", p, c, f, 5 + j, 1) for f in (0, 1)]
        tickets += [(m, s, 10, 4) for s in stores]
    return {
        "ventas": pd.DataFrame(ventas, columns=["Anio_mes", "Tiendas", "Categoria", "Cod_promo",
                                                "Nom_promo", "Tipo", "Sistema", "Importe",
                                                "Cantidad"]),
        "productos": pd.DataFrame(productos, columns=["Anio_mes", "Cod_prod", "Nom_prod",
                                                      "Categoria", "Importe", "Cantidad"]),
        "promo_prod": pd.DataFrame(promo_prod, columns=["Anio_mes", "Cod_prod", "Nom_prod",
                                                        "Categoria", "has_promo", "Importe",
                                                        "Cantidad"]),
        "tickets": pd.DataFrame(tickets, columns=["Anio_mes", "Tiendas", "n_tickets",
                                                  "n_tkt_promo"]),
        "tiendas": pd.DataFrame([("1", "Norte", "N1"), ("2", "Sur", "S1"), ("3", "Sur", "S2")],
                                columns=["FileCORR", "Region", "Comuna"]),
    }


@pytest.fixture(scope="module")
def loaded(spark, frames):
    def table(name):
        pdf = frames[name]
        types = ", ".join(
            f"{c} {'string' if pdf[c].dtype == object else 'bigint'}" for c in pdf.columns)
        rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
        df = spark.createDataFrame(rows, types)
        for m in MEASURES:
            if m not in df.columns and "Importe" in df.columns:
                df = df.withColumn(m, F.col("Importe"))
        return df

    ventas = table("ventas").withColumns(promo_code_parts(F.col("Cod_promo")))
    return Rollups(ventas, table("productos"), table("tickets"), table("promo_prod"),
                   table("ventas")), table("tiendas")


def expected(frames, spec):
    """The same rules, one statement each, on pandas frames."""
    v, p, t, pp = (frames[n].copy() for n in ("ventas", "productos", "tickets", "promo_prod"))

    def months(df):
        if spec.months:
            df = df[df.Anio_mes.isin(spec.months)]
        if spec.years:
            df = df[df.Anio_mes.str[:4].isin(spec.years)]
        return df

    def among(df, column, values):
        return df[df[column].isin(values)] if values else df

    v = months(v)
    v = among(among(among(v, "Categoria", spec.categories), "Tipo", spec.types), "Tiendas",
              spec.stores)
    if spec.promo_text:
        v = v[v.Nom_promo.str.contains(spec.promo_text, case=False, na=False)]
    if spec.promo_numbers:
        v = v[v.Cod_promo.str.split("-").str[2].isin(spec.promo_numbers)]
    p = among(among(months(p), "Categoria", spec.categories), "Nom_prod", spec.products)
    if spec.product_text:
        p = p[p.Nom_prod.str.contains(spec.product_text, case=False, na=False)]
    t = among(months(t), "Tiendas", spec.stores)
    if spec.regions:
        chosen = frames["tiendas"].loc[lambda d: d.Region.isin(spec.regions), "FileCORR"]
        if len(chosen):
            v, t = among(v, "Tiendas", list(chosen)), among(t, "Tiendas", list(chosen))

    key = ["Anio_mes", "Categoria"]
    if (spec.regions or spec.stores) and len(v):
        p = p.merge(v[key].drop_duplicates(), on=key)
    if (spec.products or spec.product_text) and len(p):
        v = v.merge(p[key].drop_duplicates(), on=key)
        t = t[t.Anio_mes.isin(p.Anio_mes)]
    pp = among(among(months(pp), "Categoria", spec.categories), "Nom_prod", spec.products)
    if len(v):
        pp = pp.merge(v[key].drop_duplicates(), on=key)
    return {"ventas": v, "productos": p, "tickets": t, "promo_prod": pp}


SPECS = [
    FilterSpec(),
    FilterSpec(months=("2024-01",)),
    FilterSpec(years=("2025",), categories=("A",)),
    FilterSpec(categories=("A", "B")),
    FilterSpec(types=("x",)),
    FilterSpec(promo_text="promo [12]"),
    FilterSpec(promo_numbers=("01",)),
    FilterSpec(regions=("Sur",)),
    FilterSpec(regions=("Nowhere",)),
    FilterSpec(stores=("2",), months=("2024-02", "2024-03")),
    FilterSpec(stores=("2",), promo_numbers=("09",)),
    FilterSpec(products=("Cola",)),
    FilterSpec(product_text="^p"),
    FilterSpec(product_text="absent"),
    FilterSpec(regions=("Norte",), products=("Pan",), years=("2024",)),
]


@pytest.mark.parametrize("spec", SPECS, ids=str)
def test_against_pandas(spec, frames, loaded):
    tables, stores = loaded
    got = apply_filters(tables, stores, spec)
    for name, want in expected(frames, spec).items():
        columns = list(frames[name].columns)
        left = sorted(map(str, (tuple(r) for r in got.table(name).select(*columns).collect())))
        right = sorted(str(tuple(None if pd.isna(x) else x for x in r))
                       for r in want[columns].itertuples(index=False))
        assert left == right, name


def test_null_category_survives_and_matches(loaded):
    tables, stores = loaded
    got = apply_filters(tables, stores, FilterSpec(stores=("1", "2", "3")))
    assert got.productos.where("Categoria IS NULL").count() > 0


def test_allow_empty_lets_an_empty_side_empty_the_others(loaded):
    tables, stores = loaded
    spec = FilterSpec(product_text="absent")
    assert not apply_filters(tables, stores, spec).ventas.isEmpty()
    assert apply_filters(tables, stores, spec, allow_empty=True).ventas.isEmpty()


def test_full_selection_is_no_filter():
    spec = FilterSpec(categories=("A", "B"), types=("x",))
    cleared = spec.without_full_selections(categories=["B", "A"], types=["x", "y"])
    assert cleared == FilterSpec(types=("x",))


def test_blank_search_is_no_filter():
    assert FilterSpec(promo_text="  ").is_empty()


def test_narrowing_choices():
    assert not FilterSpec(months=("2024-01",), categories=("A",)).narrows_sales()
    assert FilterSpec(types=("x",)).narrows_sales()


def test_drill_filter_ignores_searches_and_attributes(loaded):
    tables, _ = loaded
    spec = FilterSpec(promo_text="zzz", regions=("Sur",), promo_types=("CA",))
    assert drill_filter(tables.ventas, spec).count() == tables.ventas.count()


def test_facets(loaded):
    tables, _ = loaded
    assert [r[0] for r in facet(tables.ventas, "Categoria").collect()] == ["A", "B"]
    assert [r[0] for r in facet(tables.ventas, "TipoPromo", True).collect()] == ["CIRM"]


def test_month_filter_prunes_folders(spark, tables):
    plan = filter_months(tables.ventas, FilterSpec(cycle_years=("C1-2024",), years=("2024",)))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # the versions of months come before
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pruned = text[text.index("PartitionFilters"):]
    assert "2024-01" in pruned and "substring" in pruned


def test_small_key_set_does_not_shuffle_the_large_side(spark, tables):
    keys, size = measured(tables.ventas.where("Tipo = 'A'").select("Anio_mes", "Categoria"))
    joined = matching(tables.productos, keys)
    joined.count()
    assert 0 < size
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_semi_join_is_a_subset_and_keeps_duplicates(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "a"), (3, "b")], "k int, c string")
    keys, _ = measured(spark.createDataFrame([(1, None), (2, "a"), (2, "a")], "k int, c string"))
    assert sorted(map(tuple, matching(left, keys).collect()), key=str) == [
        (1, None), (1, None), (2, "a")]


def test_release_drops_the_key_sets(spark, loaded):
    cached = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    before = cached()
    with apply_filters(*loaded, FilterSpec(regions=("Sur",), products=("Cola",))) as chosen:
        assert chosen.held and cached() - before
        assert not chosen.ventas.isEmpty()
    assert not cached() - before
