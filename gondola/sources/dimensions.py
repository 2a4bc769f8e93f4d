"""Store dimension and promo catalogue."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gondola.functions.text import drop_na_tokens, normalized_code, plain_number, strip
from gondola.schema import CATALOG_COLUMNS, catalog_schema, store_schema


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A dimension file as text; ``None`` when it does not exist."""
    try:
        if path.rstrip("/").endswith(".parquet"):
            return spark.read.parquet(path)
        return spark.read.option("header", True).option("escape", '"').csv(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _catalog_column(header: str) -> str | None:
    """Which catalogue column a header stands for."""
    name = header.strip().lower().replace(" ", "_")
    # Header words per catalogue column, first match wins.
    rules = [
        (("cod", "promo"), "Cod_promo"),
        (("nom", "promo"), "Nom_promo"),
        (("formato",), "Formato_promo"),
        (("unid",), "Unidades_por_promo"),
        (("código",), "Cod_promo"),
        (("codigo",), "Cod_promo"),
    ]
    for words, target in rules:
        if all(w in name for w in words):
            return target
    return None


def load_catalog(spark: SparkSession, path: str, override: str | None = None) -> DataFrame:
    """Promo catalogue: one row per code, pack size 1 where it is not a number.

    ``override`` wins when it exists; with neither file the catalogue is empty.
    """
    table = _read(spark, override) if override else None
    if table is None:
        table = _read(spark, path)
    if table is None:
        return spark.createDataFrame([], catalog_schema())

    columns: dict[str, str] = {}
    for header in table.columns:
        target = _catalog_column(header)
        if target:
            columns.setdefault(target, header)

    def text(name: str):
        if name not in columns:
            return F.lit("")
        return drop_na_tokens(F.col(f"`{columns[name]}`"))

    pack = F.coalesce(plain_number(text("Unidades_por_promo")).try_cast("bigint"), F.lit(1))
    rows = table.select(
        normalized_code(text("Cod_promo")).alias("Cod_promo"),
        F.struct(
            text("Nom_promo").alias("Nom_promo"),
            text("Formato_promo").alias("Formato_promo"),
            pack.alias("Unidades_por_promo"),
        ).alias("fila"),
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id(),
        ).alias("_posicion"),
    )
    # The first row of a code, by position in the file.  An aggregation keeps one candidate per
    # task and code, so a code repeated millions of times does not pile up in one task.
    first = rows.groupBy("Cod_promo").agg(F.min_by("fila", "_posicion").alias("fila"))
    return first.select("Cod_promo", "fila.*").select(*CATALOG_COLUMNS)


def load_stores(spark: SparkSession, path: str) -> DataFrame:
    """Store dimension from CSV or parquet; ``FileCORR`` becomes integer-looking text."""
    table = _read(spark, path)
    if table is None or "FileCORR" not in [c.strip() for c in table.columns]:
        return spark.createDataFrame([], store_schema())
    plain = {re.sub(r"ó", "o", c.strip()): c for c in table.columns}  # Región -> Region
    raw = F.col(f"`{plain['FileCORR']}`").cast("string")
    code = F.coalesce(plain_number(raw).try_cast("bigint").cast("string"), strip(raw), F.lit(""))
    others = [F.col(f"`{header}`").alias(name) for name, header in plain.items()
              if name != "FileCORR"]
    return table.select(code.alias("FileCORR"), *others)
