"""Scan of raw point-of-sale line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gondola.functions.text import drop_na_tokens
from gondola.schema import KEPT_COLUMNS, RAW_COLUMNS, raw_schema
from gondola.sources.records import broken_files, records, text_lines

SEPARATOR = ";"
# Long lines are cut, short ones padded, none dropped.
_OPTIONS = {"sep": SEPARATOR, "encoding": "UTF-8", "mode": "PERMISSIVE", "escape": '"'}
_PLACE = ["Archivo", "Bloque", "Fila"]


def scan_sales_csv(spark: SparkSession, path: str | list[str], quoted_breaks: bool = True) -> DataFrame:
    """All line files under ``path`` as text, plus the place each line came from.

    ``Archivo`` and ``Bloque`` are the file and the byte offset of the split inside it; with ``Fila``, which
    grows within a split, they give every line a total order that does not depend on how splits are packed
    into tasks.  Files stay splittable, also those whose quoted fields hold line breaks (``records``): these
    are found by one narrow pass over the text, which ``quoted_breaks=False`` saves where there are none.
    Line breaks within a field are read as ``\\n``.
    """
    plain = spark.read.schema(raw_schema()).options(**_OPTIONS).csv(path).select(
        *RAW_COLUMNS, F.col("_metadata.file_path").alias("Archivo"),
        F.col("_metadata.file_block_start").alias("Bloque"), F.monotonically_increasing_id().alias("Fila"))
    if quoted_breaks:
        broken = broken_files(spark, path, SEPARATOR).persist()  # as many rows as files; a lost part is computed again
        if not broken.isEmpty():
            fields = F.from_csv("value", raw_schema().simpleString()[len("struct<"):-1].replace(":", " "), _OPTIONS)
            text = text_lines(spark, path, SEPARATOR).join(broken, "Archivo", "left_semi")
            mended = records(text).select(fields.alias("r"), *_PLACE)
            plain = plain.join(broken, "Archivo", "left_anti").select(*RAW_COLUMNS, *_PLACE).unionByName(
                mended.select("r.*", *_PLACE))
    return plain.select(*[drop_na_tokens(F.col(c)).alias(c) for c in KEPT_COLUMNS], *_PLACE)
