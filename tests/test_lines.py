"""Raw line files: the flaws of real text, line order and the ticket rules."""

import csv
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gondola import normalize_lines, scan_sales_csv
from gondola.functions.cycles import attach_cycle
from gondola.operators.normalize import with_week
from gondola.operators.rollup import build_rollup, ticket_rollup
from gondola.sources.records import broken_files, records, text_lines


def line(store="1", ticket="t", day="20240105", code="p1", name="Cola", cat="BEBIDAS", qty="1",
         price="10", net="9", promo="", promo_name="", cost="5", kind="A", system="S"):
    return ";".join([store, ticket, day, "x", code, name, "x", cat, qty, price, net, "x", promo,
                     promo_name, "x", cost, kind, system])


@pytest.fixture
def load(spark, tmp_path):
    def write(**files):
        for name, rows in files.items():
            (tmp_path / f"{name}.csv").write_text("\n".join(rows) + "\n", encoding="utf-8")
        return normalize_lines(scan_sales_csv(spark, str(tmp_path)))

    return write


def by_code(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("Cod_prod", *columns).collect()}


def test_date_rules(load):
    rows = by_code(attach_cycle(with_week(load(a=[
        line(code="ok", day=" 20241230 "), line(code="short", day="2024123"),
        line(code="long", day="202412301"), line(code="impossible", day="20240230"),
        line(code="none", day=""), line(code="ancient", day="00010101"),
        line(code="words", day="AAAABBCC"),
    ]))), "Anio_mes", "Fecha", "Semana", "CicloAno_mes")
    assert rows == {
        "ok": ("2024-12", "2024-12-30", "2024-W01", "C6-2024"),
        "impossible": ("2024-02", "2024-02-30", "", "C1-2024"),
        "ancient": ("0001-01", "0001-01-01", "", ""),
        "words": ("AAAA-BB", "AAAA-BB-CC", "", ""),
    }


def test_numeric_text(load):
    texts = {"plain": "2.5", "padded": " 2.5 ", "comma": "2,5", "suffix": "2.5d", "empty": "",
             "not_a_number": "NaN", "missing": "n/a", "inf": "inf", "science": "25e-1", "point": ".5",
             "negative": "-2.5", "plus": "+2.5", "hex": "0x10", "word": "abc"}
    rows = by_code(load(a=[line(code=k, net=v) for k, v in texts.items()]), "Importe")
    good = {"plain": "2.5", "padded": "2.5", "science": "2.5", "point": "0.5",
            "negative": "-2.5", "plus": "2.5"}
    assert {k: v[0] for k, v in rows.items()} == {
        k: Decimal(good.get(k, "0")).quantize(Decimal("0.0001")) for k in texts}


def test_extensions_and_promo_flag(load):
    rows = by_code(load(a=[
        line(code="a", qty="3", price="10.5", cost="2", promo=" C1-2024-01-CA ", promo_name=" 2x "),
        line(code="b", promo="   ", promo_name="  "), line(code="c", promo="NA", promo_name="null"),
    ]), "Precio_x_Cant", "Costo_total", "Cod_promo", "Nom_promo", "has_promo")
    assert rows["a"] == (Decimal("31.5000"), Decimal("6.0000"), "C1-2024-01-CA", "2x", 1)
    assert rows["b"][2:] == (None, None, 0)
    assert rows["c"][2:] == (None, None, 0)


def test_ragged_and_quoted_lines(load):
    whole = line(code="whole")
    rows = load(a=[
        whole, line(code="extra") + ";more;fields", ";".join(line(code="short").split(";")[:9]),
        line(code="quoted", name='"Pan; ""dulce"""'), "",
    ])
    found = by_code(rows, "Nom_prod", "Importe", "Sistema")
    assert found["extra"] == ("Cola", Decimal("9.0000"), "S")
    assert found["short"] == ("Cola", Decimal("0.0000"), None)
    assert found["quoted"][0] == 'Pan; "dulce"'
    assert len(found) == 4


def test_first_line_decides_the_ticket(load):
    promo = "C1-2024-01-CA"
    rows = ticket_rollup(load(
        a=[line(ticket="t1"), line(ticket="t1", promo=promo), line(ticket="t2", promo=promo),
           line(ticket="t2"), line(ticket="t3", store=""), line(ticket="", promo=promo)],
        b=[line(ticket="t1", promo=promo)],
    )).collect()
    # t1 and t2 of the first file, t1 again in the second; the line without a ticket id is no
    # ticket but keeps its flag; the line without a store is left out.
    assert [tuple(r) for r in rows] == [("2024-01", "1", 3, 3)]


def test_line_order_survives_splits(spark, tmp_path):
    """A file cut into many splits still has one order."""
    promo = "C1-2024-01-CA"
    rows = []
    for t in range(3000):
        rows += [line(ticket=f"t{t}", promo=promo if t % 3 == 0 else ""),
                 line(ticket=f"t{t}", promo=promo if t % 3 else "")]
    (tmp_path / "a.csv").write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        lines = normalize_lines(scan_sales_csv(spark, str(tmp_path)))
        assert lines.rdd.getNumPartitions() > 5
        assert [tuple(r) for r in ticket_rollup(lines).collect()] == [("2024-01", "1", 3000, 1000)]
        ordered = lines.orderBy("Orden").select("Transaccion").collect()
        assert [r[0] for r in ordered] == [f"t{t}" for t in range(3000) for _ in range(2)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_hot_ticket(load):
    """One ticket with most of the lines counts once."""
    promo = "C1-2024-01-CA"
    rows = [line(ticket="hot", promo=promo)] + [line(ticket="hot") for _ in range(5000)]
    rows += [line(ticket=f"t{i}") for i in range(100)]
    assert [tuple(r) for r in ticket_rollup(load(a=rows)).collect()] == [("2024-01", "1", 101, 1)]


def test_daily_rollup_derives_period_columns_from_the_day(load):
    days = build_rollup(load(a=[line(), line(net="1"), line(day="20240230", net="4")]), "ventas_dia")
    rows = days.select("Fecha", "Semana", "Anio_mes", "CicloAno_mes", "Importe").collect()
    assert sorted(tuple(r)[:4] + (int(r.Importe),) for r in rows) == [
        ("2024-01-05", "2024-W01", "2024-01", "C1-2024", 10),
        ("2024-02-30", "", "2024-02", "C1-2024", 4)]


def test_store_code_is_trimmed_and_null_stays_null(load):
    rows = load(a=[line(code="a", store=" 12 "), line(code="b", store="NA")])
    assert by_code(rows, "Tiendas") == {"a": ("12",), "b": (None,)}


def test_unread_columns_are_not_scanned(load):
    plan = load(a=[line()]).groupBy("Anio_mes").agg(F.sum("Importe"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    schema = text[text.index("ReadSchema"):]
    assert "skip1" not in schema and "Sistema" not in schema


def test_large_amounts_are_kept(load):
    rows = by_code(load(a=[
        line(code="big", net="100000000000000", qty="10000000", price="100000000", cost="1e3"),
        line(code="max", net="99999999999999999999.9999"), line(code="text", net="1.5d"),
    ]), "Importe", "Precio_x_Cant", "Costo_total")
    assert rows["big"] == (Decimal("100000000000000.0000"), Decimal("1000000000000000.0000"),
                           Decimal("10000000000.0000"))
    assert rows["max"][0] == Decimal("99999999999999999999.9999") and rows["text"][0] == 0


def test_an_amount_that_does_not_fit_names_its_place(load):
    with pytest.raises(Exception, match=r"number too large: 1e30 in .*a\.csv"):
        load(a=[line(net="1e30")]).select("Importe").collect()


BREAKS = [
    line(code="a", name='"dos\nlineas"'), line(code="b"), line(code="c", name='"dice ""x"";\n\ny;""z"" "'),
    line(code="d", name='12" pizza'), line(code="e", name='"cerrado"', promo='"C1-2024\n-05-UM"'),
    line(code="f", name='pan "duro"\tx'), line(code="g", name='""'),
    line(code="h", name='"' + "\n".join(f"renglón {k} ; \"\"{k}\"\"" for k in range(40)) + '"', net="7"),
    line(code="i", kind='"A"'), line(code="j", system='"S\n"'), line(code="k", store='"1\n"', net="1.5"),
]


@pytest.mark.parametrize("size", [37, 100, 250, 1 << 20])
def test_quoted_line_breaks_at_any_split_size(spark, tmp_path, size):
    """A file with quoted breaks gives the lines that one reader of whole files gives, at any split size."""
    (tmp_path / "a.csv").write_text("\n".join(BREAKS) + "\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("\n".join(line(code=f"p{k}", name='3" clavo') for k in range(20)), encoding="utf-8")
    (tmp_path / "c.csv").write_text("\n".join(BREAKS[::-1]), encoding="utf-8")
    with open(tmp_path / "a.csv", newline="", encoding="utf-8") as file:
        expected = [(r[4], r[5], r[12], r[10]) for r in csv.reader(file, delimiter=";")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = scan_sales_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for r in sorted(rows, key=lambda r: (r["Archivo"], r["Bloque"], r["Fila"])):
        found.setdefault(r["Archivo"][-5], []).append(tuple(r[c] or "" for c in ("Cod_prod", "Nom_prod", "Cod_promo", "Importe")))
    assert found["a"] == expected and found["c"] == expected[::-1]
    assert [r[:2] for r in found["b"]] == [(f"p{k}", '3" clavo') for k in range(20)]


def test_a_quote_that_is_never_closed_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([line(name='"abierto'), *[line()] * 50]), encoding="utf-8")
    lines = text_lines(spark, str(tmp_path), ";")
    with pytest.raises(Exception, match="more than 20 lines"):
        records(lines, max_lines=20).collect()
    assert records(lines).count() == 1


def test_files_with_broken_records_need_a_regex_for_few_lines(spark, tmp_path):
    """Two quotes between separators change no state, outside quotes or within."""
    files = {
        "plain": ['a;b;c', 'a;"b;";c', 'a;b"c;d', 'a;"";"";c', 'a;"b;"";c";d', '"a"";"";b";c', 'a;"b;"";";c'],
        "opens": ['a;b;c', 'a;"b', 'c";d'], "after": ['a;"";"b', '"'], "within": ['a;"b;"";c', '"'],
        "late": ['a;"";"";"b;"";', 'c"'],
    }
    for name, rows in files.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(rows) + "\n")
    found = broken_files(spark, str(tmp_path), ";")
    assert sorted(r[0].rsplit("/", 1)[1] for r in found.collect()) == [
        "after.csv", "late.csv", "opens.csv", "within.csv"]
    as_before = text_lines(spark, str(tmp_path), ";").where("fuera = 1").select("Archivo").distinct()
    assert sorted(found.collect()) == sorted(as_before.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    condition = next(row for row in plan.splitlines() if "Filter" in row)
    assert 'Contains(replace(value' in condition
