"""Rollup tables: sums kept, month replacement, missing tables."""

import time

import pytest
from pyspark.sql import functions as F

from gondola import session
from gondola.operators.rollup import build_rollup, detail
from gondola.plans.reports import report
from gondola.schema import MEASURES, ROLLUPS, rollup_schema
from gondola.sinks import rollups as sink
from gondola.sinks.rollups import (
    Parts, TooManyRejected, ingest, ingest_batch, merge_batch, products_of, write_rollups,
)
from gondola.sources.rollups import read_rollup, read_rollups
from gondola.sources.versions import ConcurrentBatch, Snapshot, drop_versions, publish, snapshot
from gondola.testbed import Testbed, lines as sold_lines
from tests.test_lines import line


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    return Testbed(spark, sf_dir).lines()


def sums(df):
    return df.agg(*[F.sum(m) for m in MEASURES]).first()


def content(spark, folder):
    return {n: sorted(map(str, read_rollup(spark, folder, n).collect())) for n in ROLLUPS}


@pytest.mark.parametrize("name", [n for n in ROLLUPS if n != "tickets"])
def test_rollups_keep_every_sum(name, lines):
    assert sums(build_rollup(lines, name)) == sums(lines)


def test_productos_from_promo_prod_equals_productos_from_lines(lines):
    direct = build_rollup(lines, "productos")
    derived = build_rollup(build_rollup(lines, "promo_prod"), "productos")
    assert direct.exceptAll(derived).isEmpty() and derived.exceptAll(direct).isEmpty()


def test_promo_plus_no_promo_is_everything(lines):
    by_flag = build_rollup(lines, "promo_prod").groupBy("has_promo").agg(F.sum("Importe")).collect()
    assert sum(r[1] for r in by_flag) == sums(lines)[0]


def test_write_read_and_month_replacement(spark, lines, tmp_path):
    folder = str(tmp_path)
    write_rollups(lines, folder)
    before = content(spark, folder)
    batch = lines.where("Anio_mes IN ('2024-05', '2024-06') AND Tipo = 'A'")
    assert merge_batch(batch, folder) == ["2024-05", "2024-06"]
    once = content(spark, folder)
    merge_batch(batch, folder)
    assert content(spark, folder) == once  # replacing twice equals replacing once
    kept = lines.where("Anio_mes NOT IN ('2024-05', '2024-06') OR Tipo = 'A'")
    for name in ROLLUPS:
        expected = build_rollup(kept, name).select(*rollup_schema(name).names)
        assert once[name] == sorted(map(str, expected.collect()))
        assert once[name] != before[name]
    stored = read_rollup(spark, folder, "ventas")
    assert stored.schema.names == rollup_schema("ventas").names


def test_empty_batch_is_rejected(spark, lines, tmp_path):
    folder = str(tmp_path)
    write_rollups(lines.where("Anio_mes = '2024-01'"), folder)
    before = content(spark, folder)
    with pytest.raises(ValueError):
        merge_batch(lines.where("Anio_mes = 'none'"), folder)
    assert content(spark, folder) == before


def test_replaced_month_without_stores_loses_its_tickets(spark, lines, tmp_path):
    folder = str(tmp_path)
    write_rollups(lines.where("Anio_mes IN ('2024-01', '2024-02')"), folder)
    batch = lines.where("Anio_mes = '2024-01'").withColumn("Tiendas", F.lit(None).cast("string"))
    merge_batch(batch, folder)
    months = read_rollup(spark, folder, "tickets").select("Anio_mes").distinct().collect()
    assert [r[0] for r in months] == ["2024-02"]


BATCH = "Anio_mes IN ('2024-02', '2024-03')"


@pytest.mark.parametrize("table", ["ventas", "tickets", "productos"])
def test_a_batch_that_ends_half_way_changes_nothing(spark, lines, tmp_path, monkeypatch, table):
    folder = str(tmp_path)
    write_rollups(lines.where("Anio_mes IN ('2024-01', '2024-02')"), folder)
    before, state = content(spark, folder), snapshot(spark, folder)
    write = sink.write_rollup

    def killed(rows, place, name, version):
        done = write(rows, place, name, version)
        if name == table:  # its files are complete, those of other tables may be or not
            raise RuntimeError("lost")
        return done

    monkeypatch.setattr(sink, "write_rollup", killed)
    batch = lines.where(BATCH).where("Tipo = 'A'")
    with pytest.raises(RuntimeError, match="lost"):
        merge_batch(batch, folder)
    assert content(spark, folder) == before and snapshot(spark, folder) == state
    monkeypatch.setattr(sink, "write_rollup", write)
    assert merge_batch(batch, folder) == ["2024-02", "2024-03"]
    assert all(content(spark, folder)[t] != before[t] for t in ROLLUPS)
    dropped = drop_versions(spark, folder, hours=0)
    assert any(d.startswith(f"{table}/") for d in dropped)  # what the killed batch left behind


def test_readers_of_the_old_version_go_on(spark, lines, tmp_path):
    folder = str(tmp_path)
    write_rollups(lines.where("Anio_mes IN ('2024-01', '2024-02')"), folder)
    old, before = read_rollups(spark, folder), content(spark, folder)
    merge_batch(lines.where(BATCH).where("Tipo = 'A'"), folder)
    after = content(spark, folder)
    for name in ROLLUPS:  # planned before the batch, run after it
        assert sorted(map(str, old.table(name).collect())) == before[name]
        assert sorted(map(str, read_rollups(spark, folder, number=1).table(name).collect())) == before[name]
    assert drop_versions(spark, folder, keep=2) == []
    merge_batch(lines.where("Anio_mes IN ('2024-01', '2024-02', '2024-03')").where("Tipo = 'R'"), folder)
    last = content(spark, folder)
    assert last != after
    assert len(drop_versions(spark, folder)) == 2 * len(ROLLUPS)
    assert content(spark, folder) == last
    with pytest.raises(ValueError):
        snapshot(spark, folder, number=9)


def test_a_batch_beside_another_is_an_error(spark, lines, tmp_path):
    folder = str(tmp_path)
    first = write_rollups(lines.where("Anio_mes = '2024-01'"), folder)
    publish(spark, folder, first.replacing([], {}))
    with pytest.raises(ConcurrentBatch):
        publish(spark, folder, first.replacing([], {}))


def test_tables_without_a_manifest_take_batches(spark, lines, tmp_path):
    """Folders written without versions: read as they are, replaced month by month."""
    folder = str(tmp_path)
    old = lines.where("Anio_mes IN ('2024-01', '2024-02')").withColumn(
        "Anio_mes", F.when(F.col("Anio_mes") == "2024-01", "20:1/%").otherwise(F.col("Anio_mes")))
    for name in ROLLUPS:
        build_rollup(old, name).drop(*["Anio_mes"] if name == "ventas_dia" else []).withColumns(
            {"Anio_mes": F.lit("2024-02")} if name == "ventas_dia" else {}).write.partitionBy("Anio_mes").parquet(f"{folder}/{name}")
    before = content(spark, folder)
    assert set(snapshot(spark, folder).of("ventas")) == {"20:1/%", "2024-02"}
    merge_batch(lines.where(BATCH), folder)
    stored = read_rollup(spark, folder, "ventas")
    assert sums(stored.where("Anio_mes = '20:1/%'")) == sums(old.where("Anio_mes = '20:1/%'"))
    assert sums(stored.where(BATCH)) == sums(lines.where(BATCH))
    assert content(spark, folder) != before


def test_missing_tables_read_as_empty(spark, tmp_path):
    tables = read_rollups(spark, str(tmp_path / "nothing"))
    for name in ROLLUPS:
        assert tables.table(name).schema.names == rollup_schema(name).names
        assert tables.table(name).isEmpty()


def test_old_product_table_without_list_price(spark, lines, tmp_path):
    old = build_rollup(lines, "productos").drop("Precio_x_Cant")
    old.write.partitionBy("Anio_mes").parquet(f"{tmp_path}/productos")
    rows = read_rollup(spark, str(tmp_path), "productos")
    assert rows.where("Precio_x_Cant <> Importe").isEmpty() and not rows.isEmpty()


def test_ingest_from_csv_to_rollups(spark, tmp_path):
    raw, folder, staging = (str(tmp_path / d) for d in ("raw", "rollups", "staging"))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("\n".join([
        line(net="100", qty="2"), line(net="50", ticket="u", day="20240203"), line(day="bad")]))
    assert ingest(spark, raw, folder, staging) == ["2024-01", "2024-02"]
    rows = read_rollup(spark, folder, "ventas").select("Anio_mes", "Importe").orderBy(1).collect()
    assert [(r[0], float(r[1])) for r in rows] == [("2024-01", 100.0), ("2024-02", 50.0)]


def test_lines_with_an_amount_that_does_not_fit_are_put_aside(spark, tmp_path):
    raw, folder, staging = (str(tmp_path / d) for d in ("raw", "rollups", "staging"))
    (tmp_path / "raw").mkdir()
    huge = "9" * 20
    (tmp_path / "raw" / "a.csv").write_text("\n".join([
        line(net="100", qty="2"), line(net="1e30", code="p2"), line(code="p3", qty=huge, price=huge, cost="-1e25"),
        line(net="1,5"), line(day="20240203", net="7")]))
    with pytest.raises(TooManyRejected, match="2 of 5 lines"):
        ingest_batch(spark, raw, folder, staging, max_rejected=1)
    assert all(read_rollup(spark, folder, n).isEmpty() for n in ROLLUPS)
    done = ingest_batch(spark, raw, folder, staging, max_rejected=2)
    assert (done.months, done.lines, done.rejected) == (["2024-01", "2024-02"], 5, 2)
    rows = read_rollup(spark, folder, "ventas").groupBy("Anio_mes").agg(F.sum("Importe")).collect()
    assert {r[0]: float(r[1]) for r in rows} == {"2024-01": 100.0, "2024-02": 7.0}
    aside = spark.read.parquet(done.rejected_path).collect()
    assert {(r["Fila"], r["Cod_prod"], r["Columna"], r["Motivo"], r["Texto"]) for r in aside} == {
        (1, "p2", "Importe", "number too large", "1e30"),
        (2, "p3", "Costo_unit", "number too large", "-1e25"),
        (2, "p3", "Precio_x_Cant", "product too large", f"{huge} * {huge}")}
    assert all(r["Archivo"].endswith("a.csv") and r["Bloque"] == 0 for r in aside)


def test_a_month_is_few_files(spark, sf_dir):
    """Rebalancing keeps a month together instead of one file per task."""
    folder = Testbed(spark, sf_dir).once("rollups", lambda p: None)
    files = spark.read.schema(rollup_schema("ventas")).parquet(f"{folder}/ventas").inputFiles()
    assert len(files) <= 2 * 80


def test_a_batch_reads_only_its_months(spark, lines, tmp_path):
    folder = str(tmp_path)
    state = write_rollups(lines.where("Anio_mes LIKE '2024-0%'"), folder)
    some = {m: v for m, v in state.of("promo_prod").items() if m in ("2024-05", "2024-06")}
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # the whole list of months is shown
    plan = products_of(spark, folder, Snapshot(0, {"promo_prod": some}))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    found = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "2024-05" in found and "2024-06" in found and "Join" not in plan


def test_reports_aggregate_by_hash(tables):
    for name in ("promos", "sku_por_promo", "sku_ranking", "compresion"):
        plan = report(tables, name)._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan, name


def test_top_reports_aggregate_their_table_once(tables):
    for name in ("heatmap_promo", "heat_tiendas"):
        df = report(tables, name)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("FileScan") == 1 or "Reused" in plan, name


def test_parts_hold_a_bounded_number_of_lines():
    sizes = {"2024-01": 10, "2024-02": 20, "2024-03": 1_200, None: 30}
    parts = Parts.cut(sizes, cores=1, lines=500)
    assert parts.of == {"2024-01": (0, 1), "2024-02": (0, 1), "2024-03": (1, 3), None: (4, 1)} and parts.total == 5
    assert Parts.cut(sizes, cores=8).total >= 8  # few lines still give every core a part
    assert Parts.cut({}, cores=8).total == 1
    many = Parts.cut({f"{m:02}": 1_000_000 for m in range(80)}, cores=8)
    assert many.total == 160 and [many.of["00"], many.of["79"]] == [(0, 2), (158, 2)]


def test_lines_are_shuffled_once_for_each_pair_of_rollups(spark, lines):
    parts = Parts.cut(sink.month_sizes(lines), cores=8)
    fine = detail(sink.in_parts(lines, parts, ["Tiendas"]), [sink._PART]).persist()
    both = build_rollup(sink.in_parts(lines, parts, ["Cod_prod"]), "promo_prod", [sink._PART]).persist()
    for first, name in ((fine, "ventas"), (both, "productos")):
        plan = first._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[1]
        assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1 and "hashpartitioning" not in plan
        first.count()
        second = build_rollup(first, name, [sink._PART])
        second.collect()
        plan = second._jdf.queryExecution().executedPlan().toString()
        final = plan[plan.index("Final Plan"):plan.index("Initial Plan")].split("InMemoryRelation")[0]
        assert "Exchange" not in final
        first.unpersist()


def test_unnamed_months_and_stores_are_kept_in_parts(spark, lines, tmp_path):
    odd = lines.limit(300).withColumns({
        "Anio_mes": F.when(F.col("Cod_prod").cast("int") % 3 > 0, F.col("Anio_mes")),
        "Tiendas": F.when(F.col("Cod_prod").cast("int") % 2 > 0, F.col("Tiendas"))}).localCheckpoint()
    plain = odd.unionByName(odd)
    parts = Parts.cut(sink.month_sizes(plain), cores=4, lines=50)
    for name, keys in (("ventas", ["Tiendas", "Categoria"]), ("productos", ["Cod_prod"])):
        placed = build_rollup(sink.in_parts(plain, parts, keys), name, [sink._PART]).drop(sink._PART)
        expected = build_rollup(plain, name)
        assert sorted(map(str, placed.collect())) == sorted(map(str, expected.collect()))


def test_test_lines_meet_their_orders_in_one_shuffle(spark, sf_dir):
    from gondola.testbed import text_lines

    plan = text_lines(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and plan.count("Exchange hashpartitioning(l_orderkey") == 1


def test_derived_text_is_compressed_where_it_need_not_be_split(spark, sf_dir):
    from checks.queries import TEXT_CODEC, _csv_lines, s01_breaks

    tb = Testbed(spark, sf_dir)
    assert TEXT_CODEC == "gzip"
    assert all(f.endswith(".csv.gz") for f in _csv_lines(tb).inputFiles())
    assert [r[0] for r in _csv_lines(tb).groupBy("Bloque").count().collect()] == [0]
    s01_breaks(tb)
    text = spark.read.text(tb.once("texto_con_saltos", lambda path: None))
    assert all(f.endswith(".csv") for f in text.inputFiles())


def _shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {block for block in held.split() if block.startswith("shuffle_")}


def _gone(spark, before, seconds=20):
    """Whether the shuffle files since ``before`` go, which Spark does beside its queries."""
    until = time.time() + seconds
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    return not _shuffle_files(spark) - before


def test_shuffles_leave_the_disk_with_their_step(spark, sf_dir, tmp_path, monkeypatch):
    """The lines' joins, each pair of rollups, the tickets: what one step shuffled is gone before the next one."""
    monkeypatch.setattr(sink, "RELEASE_LINES", 1)
    setting = spark.conf.get(session.FILE_CLEANUP)
    session.release(spark)
    before, held = _shuffle_files(spark), []
    staged = sink.stage_lines(sold_lines(spark, sf_dir), str(tmp_path / "staged"))
    assert _gone(spark, before)

    def released(of):
        session.release(of)
        held.append(_gone(spark, before))

    monkeypatch.setattr(sink, "release", released)
    write_rollups(staged, str(tmp_path / "rollups"))
    assert held == [True, True]
    assert spark.conf.get(session.FILE_CLEANUP) == setting
