"""Exact counts as bits, and reports from shared sub-aggregates."""

import pytest
from pyspark.sql import functions as F

from checks.queries import SPECS
from gondola.functions.bits import Dimension
from gondola.operators.filters import FilterSpec, apply_filters, month_facet, month_list
from gondola.plans import reports as plans
from gondola.plans.lattice import SETS, needs, shared
from gondola.plans.reports import REPORTS, REPORT_NAMES, all_reports, report
from gondola.sinks.exports import BUNDLE, write_csv
from gondola.testbed import stores


def plan(df):
    """The plan without the plans by which its cached tables were made."""
    kept, inside = [], None
    for text in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(text) - len(text.lstrip(" :+-"))
        if inside is not None and depth > inside:
            continue
        inside = depth if "InMemoryRelation" in text else None
        kept.append(text)
    return "\n".join(kept)


def content(df):
    return sorted(str(r) for r in df.collect())


@pytest.fixture(scope="module")
def lattice(tables):
    with shared(tables) as found:
        yield found


@pytest.mark.parametrize("name", REPORT_NAMES)
def test_shared_reports_equal_the_reports(tables, lattice, name):
    assert content(report(lattice, name)) == content(report(tables, name))


@pytest.mark.parametrize("spec", ["f05", "f09_none", "f01_empty"])
def test_shared_reports_of_a_filter_choice(spark, sf_dir, tables, spec):
    with apply_filters(tables, stores(spark, sf_dir), SPECS[spec]) as chosen, shared(chosen) as found:
        for name in ("kpis_v", "promos", "cobertura_prod", "heat_tiendas", "penetracion_cat", "sku_ranking"):
            assert content(report(found, name)) == content(report(chosen, name)), name


def test_most_reports_are_covered(lattice):
    left = {n for n, r in REPORTS.items() if r.table != "tickets" and lattice.shared.source(r) is None}
    assert left == {"promo_por_cat_ciclo"}
    assert needs(plans.Report("ventas", "month", "Ingresos", where=lambda df: df.limit(1))) is None


def test_a_bundle_reads_each_rollup_at_most_twice(lattice):
    results = all_reports(lattice)
    scans = {name: 1 for name in SETS}  # of the sub-aggregates
    for source, _ in BUNDLE.values():
        text = plan(results[source])
        if "InMemoryTableScan" not in text:
            scans[REPORTS[source].table if source in REPORTS else "ventas"] += 1
    assert scans == {"ventas": 2, "productos": 1, "promo_prod": 1}
    for name, expected in {"ventas": 3, "productos": 1, "promo_prod": 1}.items():
        # one scan for all sub-aggregates; those of the numbers of months and stores are cached
        leaves = lattice.shared.tables[name].rows._jdf.queryExecution().analyzed().collectLeaves()
        kinds = [leaves.apply(k).nodeName() for k in range(leaves.size())]
        assert kinds == ["LogicalRelation"] * expected, name


def test_distinct_counts_shuffle_labels_once(tables):
    for name in ("promos", "sku_por_promo"):
        text = plan(report(tables, name, ordered=False))
        assert text.count("Exchange hashpartitioning") == 1 and "Expand" not in text, name


def test_more_values_than_bits(tables, monkeypatch):
    usual = {n: content(report(tables, n)) for n in ("promos", "sku_por_promo")}
    monkeypatch.setattr(plans, "MAX_WORDS", 0)
    for name, expected in usual.items():
        df = report(tables, name)
        assert content(df) == expected and "bit_or" not in plan(df)


def test_bits_count_every_value_once(spark):
    rows = [(k % 3, f"v{k % 130}") for k in range(1_000)] + [(0, None), (7, None)]
    table = spark.createDataFrame(rows, "g int, v string").repartition(4)
    dimension = Dimension(table, "v")
    assert dimension.words() == 3
    numbered = dimension.numbered(table)
    usual = {r[0]: r[1] for r in table.groupBy("g").agg(F.countDistinct("v")).collect()}
    assert {r[0]: r[1] for r in numbered.groupBy("g").agg(dimension.count()).collect()} == usual
    words = [dimension.word(k).alias(n) for k, n in enumerate(dimension.stored())]
    stored = numbered.groupBy("g", F.length("v")).agg(*words)
    assert {r[0]: r[1] for r in stored.groupBy("g").agg(dimension.count_stored()).collect()} == usual
    dimension.release()
    assert Dimension(table.where("false"), "v").words() == 1


def test_a_value_without_a_number_is_an_error(spark):
    table = spark.createDataFrame([("a",), ("b",)], "v string")
    dimension = Dimension(table.where("v = 'a'"), "v")
    with pytest.raises(Exception, match="v without a number: b"):
        dimension.numbered(table).agg(dimension.count()).collect()


@pytest.mark.parametrize("partitions", ["8", "400"])
def test_export_is_in_order_without_a_sampling_pass(spark, tables, tmp_path, partitions):
    """By month, and with more partitions than months by store as well; files read by name are in order."""
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = report(tables, "resumen_export")
        assert "rangepartitioning" not in plan(found)
        write_csv(found, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    rows = []
    for file in sorted((tmp_path / "out").glob("part-*.csv")):
        rows += [x.split(";") for x in file.read_text(encoding="utf-8").splitlines()[1:]]
    keys = [(r[0], r[1] or "\U0010ffff", *r[2:5]) for r in rows]
    assert keys == sorted(keys) and len(keys) == report(tables, "resumen_export", ordered=False).count()


def test_month_lists_need_no_job(spark, tables, sf_dir):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("months"))
    spark.sparkContext.setJobGroup("months", "months")
    try:
        everything = month_list(tables, "ventas")
        some = apply_filters(tables, None, FilterSpec(years=("2024",), months=("2024-02", "2024-05", "2025-01")))
        assert month_list(some, "ventas") == ["2024-02", "2024-05"] and jobs() == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert everything == month_facet(tables.ventas)
    assert month_list(some, "promo_prod") == month_facet(some.promo_prod)
    for spec in (FilterSpec(cycle_numbers=("C2",), types=("A",)), FilterSpec(promo_text="no such promo")):
        with apply_filters(tables, None, spec) as chosen:
            assert month_list(chosen, "ventas") == month_facet(chosen.ventas)


def test_the_export_shuffles_the_sales_once(tables):
    spark = tables.ventas.sparkSession
    for partitions in ("8", "200"):  # one partition for each month, or several
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            plan = report(tables, "resumen_export")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        plan = plan.split("InMemoryRelation")[0]
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
        assert plan.count("Exchange shufflepartitionidpassthrough") == 1
