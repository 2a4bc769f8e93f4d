"""Helpers shared by the operators: scratch tables in the shared folder, and word counts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gondola.session import release, shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.TemporaryDirectory(prefix="gondola-")  # on the driver, which serves the file
    archive = f"{folder.name}/{package.name}-{context.applicationId}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(archive)
    _SHIPPED[context.applicationId] = folder

_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


class Scratch:
    """Tables of one operator run, in a folder of their own under the shared folder.

    Writing a table cuts the lineage: a lost executor only repeats reads of it.  ``write`` returns
    the table as read back.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/gondola-llm/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def release(self) -> None:
        """``gondola.session.release``, between steps."""
        release(self.spark)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
