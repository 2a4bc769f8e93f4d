"""The retail data model laid over the generic test tables (see FIXTURES.md, section 5).

Every table here is derived by Spark from the given parquet files, so the work grows with them.
Derived tables are written once per application and input folder into the shared folder and read
back from there: reports then run on stored rollups, and a lost executor only repeats reads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from gondola.operators.normalize import model_tables
from gondola.session import shared_folder, shuffles_removed
from gondola.sinks.rollups import stage_lines, write_rollups
from gondola.sources.rollups import Rollups, read_rollups

LINE_COLUMNS = [
    "Fecha", "Anio_mes", "Tiendas", "Transaccion", "Cod_prod", "Nom_prod", "Categoria",
    "Cod_promo", "Nom_promo", "Tipo", "Sistema", "has_promo", "Orden", "Importe", "Cantidad",
    "Precio_x_Cant", "Costo_total",
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, part and order.  Spark broadcasts ``part`` while it is small and shuffles it beyond that;
    adaptive execution splits a hot part or order.

    The join with the orders is the last one and always shuffles: it deals the lines out to all tasks, also
    those of a file that cannot be split, and leaves the lines of an order in one task, so that the rollups
    combine them before their own shuffles."""
    return (
        read(spark, sf_dir, "lineitem")
        .join(read(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        .join(read(spark, sf_dir, "orders").hint("merge"), F.expr("l_orderkey = o_orderkey"))
        .withColumn("dia", F.expr("cast(add_months(cast(o_orderdate AS DATE), 336) AS DATE)"))
        .withColumn("descuento", F.expr("CAST(round(l_discount * 100) AS INT)"))
        .withColumn("_tiendas", read(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar())
    )


# Column expressions shared by the normalized and the raw-text form of a line.
_SHARED = {
    "Tiendas": "CAST(o_custkey % _tiendas AS STRING)",
    "Transaccion": "CAST(l_orderkey AS STRING)",
    "Cod_prod": "CAST(l_partkey AS STRING)",
    "Nom_prod": "CASE WHEN l_partkey % 97 = 0 THEN '' ELSE p_name END",
    "Categoria": "CASE p_brand WHEN 'Brand#25' THEN 'SERVICIOS' WHEN 'Brand#24' THEN NULL "
                 "ELSE p_brand END",
    "Cod_promo": "CASE WHEN l_discount >= 0.045 THEN concat("
                 "'C', (month(dia) + 1) div 2, '-', year(dia), '-', "
                 "lpad(CAST(descuento AS STRING), 2, '0'), '-', "
                 "element_at(array('CIRM', 'CIRG', 'CA', 'UM', 'CRM', 'CRG'), "
                 "l_linenumber % 6 + 1)) END",
    "Nom_promo": "CASE descuento WHEN 5 THEN concat('2x ', p_brand) "
                 "WHEN 6 THEN concat('Combo ', p_brand) WHEN 7 THEN concat('Lleva 3 ', p_brand) "
                 "WHEN 8 THEN concat('20 % off ', p_brand) WHEN 9 THEN concat('CRM ', p_brand) "
                 "WHEN 10 THEN '' END",
    "Tipo": "l_returnflag",
    "Sistema": "l_linestatus",
}
_COST_CENTS = "(CAST(round(p_retailprice * 100) AS BIGINT) * (30 + l_partkey % 60) div 100)"
_NET = "l_extendedprice * (1 - (1 + 2 * (l_partkey % 5)) * l_discount)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized sales lines."""
    rows = _joined(spark, sf_dir).selectExpr(
        "date_format(dia, 'yyyy-MM-dd') AS Fecha",
        "date_format(dia, 'yyyy-MM') AS Anio_mes",
        *[f"{e} AS {c}" for c, e in _SHARED.items()],
        # Sorts as (line, product, supplier, list price); fixed width so that the ticket rollup
        # can aggregate by hash.
        "CAST(concat(l_linenumber, lpad(l_partkey, 12, '0'), lpad(l_suppkey, 10, '0'), "
        "lpad(CAST(round(l_extendedprice * 100) AS BIGINT), 13, '0')) AS DECIMAL(38,0)) AS Orden",
        "CAST(l_quantity AS DECIMAL(18,4)) AS Cantidad",
        f"CAST({_NET} AS DECIMAL(18,4)) AS Importe",
        "CAST(l_extendedprice AS DECIMAL(18,4)) AS Precio_x_Cant",
        "CAST(l_extendedprice * (30 + l_partkey % 60) / 100 AS DECIMAL(18,4)) AS Costo_total",
    )
    rows = rows.withColumn("has_promo", F.col("Cod_promo").isNotNull().cast("int"))
    return rows.select(*LINE_COLUMNS)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as raw text in the 18 positional columns, with the flaws of real files:
    short dates, padded numbers, decimal commas, NA tokens, blank promo codes, missing stores, and a
    few very large amounts."""
    return _joined(spark, sf_dir).selectExpr(
        "CASE WHEN l_suppkey % 41 = 0 THEN 'NA' ELSE concat(' ', CAST(o_custkey % _tiendas AS "
        "STRING), ' ') END AS Tiendas",
        f"{_SHARED['Transaccion']} AS Transaccion",
        "CASE WHEN l_partkey % 89 = 0 THEN date_format(dia, 'yyyy-MM') "
        "ELSE date_format(dia, 'yyyyMMdd') END AS Fecha_raw",
        "'x' AS skip1",
        f"{_SHARED['Cod_prod']} AS Cod_prod",
        f"{_SHARED['Nom_prod']} AS Nom_prod",
        "'' AS skip2",
        f"{_SHARED['Categoria']} AS Categoria",
        "CASE l_linenumber % 5 WHEN 0 THEN concat(' ', CAST(CAST(l_quantity AS INT) AS STRING), "
        "' ') WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '.0') "
        "ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS Cantidad",
        "CASE WHEN l_partkey % 53 = 0 THEN '1,5' WHEN l_partkey % 71 = 0 THEN '123456789012.5' ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) "
        "AS STRING) END AS Precio",
        "CASE WHEN l_partkey % 59 = 0 THEN '1.5d' WHEN l_partkey % 61 = 0 THEN 'n/a' "
        "WHEN l_partkey % 67 = 0 THEN '100000000000000' "
        f"ELSE CAST(CAST({_NET} AS DECIMAL(18,4)) AS STRING) END AS Importe",
        "'0' AS skip3",
        f"CASE WHEN l_discount < 0.005 THEN '  ' ELSE {_SHARED['Cod_promo']} END AS Cod_promo",
        f"{_SHARED['Nom_promo']} AS Nom_promo",
        "'y' AS skip4",
        f"concat({_COST_CENTS} div 100, '.', lpad({_COST_CENTS} % 100, 2, '0')) AS Costo_unit",
        f"{_SHARED['Tipo']} AS Tipo",
        f"{_SHARED['Sistema']} AS Sistema",
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store dimension."""
    rows = (
        read(spark, sf_dir, "supplier")
        .join(read(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    return rows.selectExpr(
        "CAST(s_suppkey AS STRING) AS FileCORR", "r_name AS Region", "n_name AS Comuna",
        "element_at(array('Tienda', 'Express', 'Kiosco'), CAST(s_suppkey % 3 AS INT) + 1) "
        "AS Formato",
        "CASE WHEN s_acctbal < 0 THEN 'C' WHEN s_acctbal < 5000 THEN 'B' ELSE 'A' END AS Segmento",
    )


def catalog(spark: SparkSession) -> DataFrame:
    """Promo catalogue: 6 cycles, 8 years, 5 numbers, 6 types; number 07 is missing from it and
    year 2030 is never sold."""
    rows = spark.range(6 * 8 * 5 * 6).selectExpr(
        "id % 6 + 1 AS c", "2023 + id div 6 % 8 AS y",
        "element_at(array('05', '06', '08', '09', '10'), CAST(id div 48 % 5 AS INT) + 1) AS n",
        "element_at(array('CIRM', 'CIRG', 'CA', 'UM', 'CRM', 'CRG'), CAST(id div 240 AS INT) + 1) "
        "AS t",
    )
    return rows.selectExpr(
        "concat('C', c, '-', y, '-', n, '-', t) AS Cod_promo", "concat('Promo ', n) AS Nom_promo",
        "CASE WHEN n IN ('05', '06') THEN '2x' WHEN n = '10' THEN 'Cruzada' ELSE '3x' END "
        "AS Formato_promo",
        "CASE WHEN n IN ('05', '06', '10') THEN 2 ELSE 3 END AS Unidades_por_promo",
    )


def _input_state(spark: SparkSession, sf_dir: str) -> str:
    """Path, size and modification time of each input table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    state = []
    for table in _INPUTS:
        path = hadoop.Path(f"{sf_dir}/{table}.parquet")
        status = path.getFileSystem(conf).getFileStatus(path)
        state.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return "\n".join(state)


_INPUTS = ["lineitem", "orders", "part", "supplier", "nation", "region"]


@dataclass(frozen=True)
class Testbed:
    """Derived tables of one input folder, written on first use."""

    __test__ = False  # not a test class

    spark: SparkSession
    sf_dir: str

    @property
    def folder(self) -> str:
        """Named after the application and the state of the input files, so changed input is never
        answered from tables derived earlier."""
        app = self.spark.sparkContext.applicationId
        digest = hashlib.sha256(_input_state(self.spark, self.sf_dir).encode()).hexdigest()[:16]
        return f"{shared_folder(self.spark)}/gondola/{app}/{digest}"

    def once(self, name: str, write: Callable[[str], None]) -> str:
        """Folder of a derived table, written by ``write`` unless this session has done so."""
        path = f"{self.folder}/{name}"
        if path not in _WRITTEN:
            with shuffles_removed(self.spark):
                write(path)
            _WRITTEN.add(path)
        return path

    def lines(self) -> DataFrame:
        folder = self.once("lines", lambda p: stage_lines(lines(self.spark, self.sf_dir), p))
        return self._open("lines", lambda: self.spark.read.parquet(f"{folder}/lineas"))

    def stored_rollups(self) -> Rollups:
        folder = self.once("rollups", lambda p: write_rollups(self.lines(), p))
        return self._open("rollups", lambda: read_rollups(self.spark, folder))

    def rollups(self) -> Rollups:
        """Rollups as the reports see them."""
        return self._open("model", lambda: model_tables(self.stored_rollups()))

    def _open(self, name: str, read_tables: Callable):
        """Reuse a reader, so a table's files are listed once."""
        key = (self.folder, name)
        if key not in _READERS:
            _READERS[key] = read_tables()
        return _READERS[key]


_WRITTEN: set[str] = set()
_READERS: dict[tuple[str, str], object] = {}
