"""Labels, bands, cycles, measures and dimensions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gondola.functions import bands, text
from gondola.functions.cycles import CYCLES, cycle_calendar, cycle_of_month, month_cycles
from gondola.functions.measures import measures, over
from gondola.functions.whole import beside, share_of_total
from gondola.operators.filters import month_facet
from gondola.operators.normalize import EXCLUDED_CATEGORIES, in_model, promo_code_parts
from gondola.plans import crosses, promotions, skus, yoy
from gondola.session import shared_folder
from gondola.sinks.exports import write_csv
from gondola.sources.dimensions import load_catalog, load_stores


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_calendar_is_gapless_and_months_agree(spark):
    spans = [(c[2], c[3]) for c in CYCLES]
    for (_, end), (start, _) in zip(spans, spans[1:]):
        assert (date.fromisoformat(start) - date.fromisoformat(end)).days == 1
    table = {r.Anio_mes: r.CicloAno_mes for r in month_cycles(cycle_calendar(spark)).collect()}
    assert table == cycle_of_month()
    assert len(table) == 40 and table["2024-01"] == "C1-2024" and table["2026-12"] == "C6-2026"


@pytest.mark.parametrize("code, parts", [
    ("C4-2024-001-CIRM", ("C4", "C4-2024", "2024", "001", "CIRM")),
    (" c4-2024-01-a-crm ", ("C4", "C4-2024", "2024", "01", "CRM")),
    ("C4-2024-06", ("C4", "C4-2024", "2024", "06", "06")),
    ("C4-2024", ("C4", "C4-2024", "2024", "", "2024")),
    ("C4", ("C4", "", "", "", "")),
    ("-2024", ("", "", "2024", "", "2024")),
    ("  ", ("", "", "", "", "")),
    (None, ("", "", "", "", "")),
])
def test_promo_code_parts(spark, code, parts):
    row = spark.createDataFrame([(code,)], "c string").select(
        *promo_code_parts(F.col("c")).values()).first()
    assert tuple(row) == parts


@pytest.mark.parametrize("name, label", [
    ("Monster 2x1", "2x1 / 2x precio"), ("2 X 3000", "2x1 / 2x precio"),
    ("Combo 2x", "2x1 / 2x precio"), ("PACK familiar", "Combo / Pack"),
    ("Lleva dos", "Lleva X Gratis"), ("20 % off", "Descuento Directo"), ("off", "Otras"),
    ("Premio CRM", "Promo CRM/Lealtad"), ("Summer", "Promo CRM/Lealtad"), ("Pan", "Otras"),
    (None, "Otras"),
])
def test_mechanic(spark, name, label):
    assert one(spark, text.mechanic(F.lit(name).cast("string"))) == label


def test_labels(spark):
    df = spark.createDataFrame(
        [(" Cola ", "1", None), ("  ", "2", "A"), (None, None, "B")],
        "Nom_prod string, Cod_prod string, Categoria string")
    rows = df.select(text.product_label(), text.category_label(), text.category_label("Sin cat."))
    assert [tuple(r) for r in rows.collect()] == [
        ("Cola", "–", "Sin cat."), ("2", "A", "A"), ("?", "B", "B")]


def test_code_cycle(spark):
    df = spark.createDataFrame([("C1-2024-01-CA",), ("C1",), (None,)], "c string")
    assert [r[0] for r in df.select(text.code_cycle(F.col("c"))).collect()] == ["C1-2024", "C1", ""]


def test_exclusion_keeps_null(spark):
    df = spark.createDataFrame([(None,), ("SERVICIOS",), ("A",)], "c string")
    assert [r[0] for r in df.where(in_model(F.col("c"))).collect()] == [None, "A"]
    assert len(EXCLUDED_CATEGORIES) == 17


@pytest.mark.parametrize("band, values", [
    (bands.category_health, {0.2: "Saludable", 0.19: "Ajustado", 0.1: "Ajustado", 0.09: "Crítico",
                             None: "Crítico"}),
    (bands.product_state, {-0.1: "NEG", 0.0: "LOW", 0.1: "OK", None: "OK"}),
    (bands.margin_alert, {-1.0: "Negativo", 0.0: "Bajo <5%", 0.05: "Normal", 0.35: "Alto"}),
    (bands.penetration_alert, {0.7: "Alta", 0.71: "Muy alta", 0.1: "Sin promo", 0.11: "Normal"}),
    (bands.trend, {0.01: "Estable", 0.011: "Mejorando", -0.02: "Deteriorando"}),
    (bands.elasticity, {-0.31: "Elástica (precio↑ → vol↓)", 0.3: "Sin correlación clara",
                        0.4: "Inelástica (precio no afecta vol)", None: "Sin correlación clara"}),
])
def test_bands(spark, band, values):
    for value, label in values.items():
        assert one(spark, band(F.lit(value).cast("double"))) == label


def test_promo_light_with_null_roi(spark):
    def light(m, r, c):
        return one(spark, bands.promo_light(*[F.lit(x).cast("double") for x in (m, r, c)]))

    assert light(0.2, 2.0, 0.3) == "Buena"
    assert light(0.2, None, 0.3) == "Regular"
    assert light(0.05, None, 0.9) == "Crítica"
    assert light(None, 1.5, 0.9) == "Regular"


def test_ratio_over_zero_is_null(spark):
    assert one(spark, over(F.lit(1), F.lit(0))) is None
    assert one(spark, over(F.lit(0), F.lit(0))) is None


def test_blank_code_counts_as_no_promo(spark):
    df = spark.createDataFrame([("x", 1), (" ", 2), (None, 4)], "Cod_promo string, Cantidad int")
    assert tuple(df.agg(*measures("Und_con_codigo Und_sin_codigo")).first()) == (1, 6)


def test_shares_sum_to_one_and_reuse_the_shuffle(spark, tables):
    sums = tables.ventas.groupBy("Categoria").agg(F.sum("Importe").alias("v"))
    shares = sums.withColumn("s", share_of_total(sums, "v"))
    assert abs(sum(r.s for r in shares.collect()) - 1) < 1e-12
    both = sums.withColumn("n", beside(sums, n=F.max("v")).getField("n"))
    both.collect()
    assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()


def test_catalog_headers_duplicates_and_packs(spark, tmp_path):
    default, custom = tmp_path / "c.csv", tmp_path / "custom.csv"
    default.write_text("Código promoción, Promoción nom promo ,Formato promo,Unidades por promoción\n"
                       " c1-2024-01-ca ,Uno,2x,2\nC1-2024-01-CA,Otro,3x,3\nx,Equis,,dos\n")
    rows = {r[0]: tuple(r)[1:] for r in load_catalog(spark, str(default), str(custom)).collect()}
    assert rows == {"C1-2024-01-CA": ("Uno", "2x", 2), "X": ("Equis", None, 1)}
    custom.write_text("Cod_promo,Unidades\nZ,4\n")
    assert [tuple(r) for r in load_catalog(spark, str(default), str(custom)).collect()] == [
        ("Z", "", "", 4)]
    assert load_catalog(spark, str(tmp_path / "none.csv")).isEmpty()


def test_store_codes(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("FileCORR ,Región,Comuna\n12.0,Norte,A\n 7 ,Sur,B\n K9 ,Sur,C\n,Sur,D\nNaN,X,E\n")
    rows = [(r.FileCORR, r.Region) for r in load_stores(spark, str(path)).collect()]
    assert rows == [("12", "Norte"), ("7", "Sur"), ("K9", "Sur"), ("", "Sur"), ("NaN", "X")]
    assert load_stores(spark, str(tmp_path / "none.csv")).isEmpty()


def test_only_plain_numbers_are_numbers(spark, tmp_path):
    codes = {"12D": "12D", "7f": "7f", "1e3": "1000", "55.0": "55", "inf": "inf", "-3": "-3", "08": "8"}
    path = tmp_path / "s.csv"
    path.write_text("FileCORR,Region\n" + "".join(f"{c},R\n" for c in codes))
    assert [r.FileCORR for r in load_stores(spark, str(path)).collect()] == list(codes.values())
    packs = {"2d": 1, "Infinity": 1, "99999999999": 99999999999, "1e400": 1, "3.7": 3, "1e3": 1000, "": 1}
    path = tmp_path / "c.csv"
    path.write_text("Cod_promo,Unidades\n" + "".join(f"c{k},{p}\n" for k, p in enumerate(packs)))
    rows = {r.Cod_promo: r.Unidades_por_promo for r in load_catalog(spark, str(path)).collect()}
    assert rows == {f"C{k}": n for k, n in enumerate(packs.values())}


def test_matrices_take_their_months_from_the_data(spark):
    rows = [("a", "2024-01", 0.4), ("a", "2031-05", 0.2), ("b", "2031-05", 0.6), ("a", "2024-02", 0.6)]
    df = spark.createDataFrame(rows, "Categoria string, Anio_mes string, v double")
    months = month_facet(df)
    assert months == ["2024-01", "2024-02", "2031-05"]
    found = {r.Categoria: r.asDict() for r in promotions.penetration_matrix(
        df.withColumnRenamed("v", "Penetracion"), months).collect()}
    assert found["a"]["2031-05"] == 0.2 and round(found["a"]["Media"], 9) == 0.4
    assert found["b"]["2024-01"] == 0.0 and round(found["b"]["Media"], 9) == 0.2
    found = {r.Categoria: r.Media for r in crosses.margin_matrix(
        df.withColumnRenamed("v", "Mg_pct"), months).collect()}
    assert {k: round(v, 9) for k, v in found.items()} == {"a": 0.4, "b": 0.6}


def test_first_and_last_month_as_numbers(spark):
    months = ["2024-01", "1999-12", "AAAA-BB", "2024-11"]
    df = spark.createDataFrame([(m,) for m in months], "Anio_mes string")
    row = df.agg(*measures("Primer_mes Ultimo_mes")).first()
    assert tuple(row) == (min(months), max(months))


def test_csv_export_uses_decimal_comma(spark, tmp_path):
    df = spark.sql("SELECT 'a.b' AS t, CAST(1234567890.5 AS DECIMAL(18,4)) AS d, 0.25D AS x, 3 AS n")
    write_csv(df, str(tmp_path / "out"))
    text_out = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.csv")))
    assert text_out.splitlines() == ["t;d;x;n", "a.b;1234567890,5;0,25;3"]
    df = spark.sql("SELECT 12.34BD AS a, CAST(5 AS DECIMAL(28,4)) AS b, 100D AS c, CAST(NULL AS DOUBLE) AS e")
    write_csv(df, str(tmp_path / "marked"), mark=True)
    text_out = "".join(p.read_text() for p in sorted((tmp_path / "marked").glob("*.csv")))
    assert text_out.splitlines() == ["\ufeffa;b;c;e", "12,34;5,0;100,0;"]


def test_half_even_transactions(spark):
    sku = spark.createDataFrame(
        [("p", c, "k", 1.0, u) for c, u in (("A", 5.0), ("B", 7.0), ("C", 4.0))],
        "Promo string, Cod_promo string, Categoria string, Ingresos double, Unidades double")
    cat = spark.createDataFrame([("A", "x", "2x", 2), ("B", "x", "2x", 2)],
                                "Cod_promo string, Nom_promo string, Formato_promo string, "
                                "Unidades_por_promo int")
    rows = {r.Cod_promo: (r.Transacciones_promo, r.Formato_promo)
            for r in promotions.catalog_transactions(sku, cat).collect()}
    assert rows == {"A": (2, "2x"), "B": (4, "2x"), "C": (4, "Sin catalogo")}


def test_correlation_guards(spark):
    rows = [("const", m, 5.0, u) for m, u in (("1", 1.0), ("2", 2.0), ("3", 3.0))]
    rows += [("short", "1", 1.0, 2.0), ("short", "2", 2.0, 1.0)]
    rows += [("down", m, p, u) for m, p, u in (("1", 1.0, 9.0), ("2", 2.0, 8.0), ("3", 3.0, 7.0),
                                              ("4", None, 0.0))]
    df = spark.createDataFrame(rows, "Categoria string, Anio_mes string, Precio_ef double, "
                                     "Unidades double").withColumn("Ingresos", F.lit(1))
    found = crosses.price_volume_correlation(df).collect()
    assert [(r.Categoria, round(r.Correlacion, 9)) for r in found] == [("down", -1.0)]


def test_single_year_and_single_month_give_no_comparison(spark):
    mes = spark.createDataFrame([("2024", 1.0, 1.0, 1.0)],
                                "Anio string, Ingresos double, Margen double, Unidades double")
    assert yoy.yoy_totals(mes).isEmpty()
    cat = spark.createDataFrame([("a", "2024", 1.0)], "Categoria string, Anio string, Ingresos double")
    assert yoy.yoy_by_category(cat).isEmpty()
    mg = spark.createDataFrame([("a", "2024-01", 0.5)],
                               "Categoria string, Anio_mes string, Mg_pct double")
    assert crosses.margin_trend(mg).isEmpty()


def test_new_category_has_no_change(spark):
    cat = spark.createDataFrame(
        [("old", "2023", 4.0), ("old", "2024", 5.0), ("new", "2024", 1.0), ("gone", "2023", 2.0),
         ("older", "2022", 9.0)], "Categoria string, Anio string, Ingresos double")
    rows = {r.Categoria: r.Var_pct for r in yoy.yoy_by_category(cat).collect()}
    assert rows == {"old": 0.25, "new": None, "gone": -1.0}


def test_fatigue_reads_the_last_three_months(spark):
    rows = [("P", f"2024-{m:02d}", v) for m, v in ((1, 1), (2, 100), (3, 90), (4, 70))]
    rows += [("Q", f"2024-{m:02d}", v) for m, v in ((1, 10), (2, 10), (3, 13))]
    rows += [("R", "2024-01", 5), ("R", "2024-02", 5)]
    df = spark.createDataFrame([(p, p, m, v) for p, m, v in rows],
                               "Nom_promo string, Cod_promo string, Anio_mes string, Importe int")
    found = {r.Promo: (r.Estado, round(r.Variacion, 6)) for r in
             promotions.promo_fatigue(df).collect()}
    assert found == {"P": ("Fatiga", -0.3), "Q": ("Crecimiento", 0.3)}


def test_unknown_ranking_order_is_an_error(spark):
    with pytest.raises(ValueError):
        skus.best(spark.range(1), "Nombre")


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
