"""Versions of stored rollups: which folder holds the current rows of each table and month.

A batch writes its months to folders of their own, ``<table>/version=<version>/Anio_mes=<month>``, which
nobody reads yet, and then adds one file to the manifest: a whole new list of (table, month, version),
under the next number.  Readers take the list with the greatest number.  That file appears at once or not
at all, so all five tables change together, and a batch that ends half way changes nothing.  Old folders
stay for readers that have begun, until ``drop_versions`` removes them.

Tables without a manifest (``<table>/Anio_mes=<month>``) are read as they are; their months keep that
folder, whose name stands for the version, until a batch replaces them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from gondola.schema import MONTH, ROLLUPS, rollup_schema

MANIFEST = "number long, tabla string, Anio_mes string, version string"
NULL_MONTH = "__HIVE_DEFAULT_PARTITION__"


class ConcurrentBatch(RuntimeError):
    """Another batch was published while this one was written; run this one again."""


@dataclass(frozen=True)
class Snapshot:
    """The version of each table's months; number 0 is a folder without a manifest."""

    number: int
    months: dict[str, dict[str, str]] = field(default_factory=dict)

    def of(self, table: str) -> dict[str, str]:
        return self.months.get(table, {})

    def replacing(self, months: list[str] | None, written: dict[str, dict[str, str]]) -> "Snapshot":
        """The next snapshot: all other months as they were (none for ``months=None``), and what was written."""
        kept = {t: {m: v for m, v in self.of(t).items() if months is not None and m not in months}
                for t in ROLLUPS}
        return Snapshot(self.number + 1, {t: kept[t] | written.get(t, {}) for t in ROLLUPS})


def or_nothing(frame, missing=None):
    """What ``frame`` reads, or ``missing`` if its folder does not exist."""
    try:
        return frame()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return missing


def months_of(table: DataFrame) -> dict[str, str]:
    """The months of a stored table and the names of their folders, as its files are listed; no job runs."""
    names = {m[1] for f in table.inputFiles() if (m := re.search(rf"/({MONTH}=[^/]*)/[^/]*$", f))}
    # a file is listed as a URL, in which the escapes of a folder's name are escaped once more
    folders = {unquote(n) for n in names}
    return {unquote(n.partition("=")[2]): n for n in sorted(folders) if not n.endswith(NULL_MONTH)}


def snapshot(spark: SparkSession, folder: str, number: int | None = None) -> Snapshot:
    """The current snapshot of a folder, or an earlier one by its number."""
    manifest = or_nothing(lambda: spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))
    if manifest is None:
        return Snapshot(0, {t: _unversioned(spark, folder, t) for t in ROLLUPS})
    wanted = manifest.agg(F.max("number")).scalar() if number is None else F.lit(number)
    rows = manifest.where(F.col("number") == wanted).collect()  # a row per table and month
    if not rows:
        raise ValueError(f"no snapshot {number} in {folder}")
    months: dict[str, dict[str, str]] = defaultdict(dict)
    for r in rows:
        if r["tabla"] is not None:
            months[r["tabla"]][r["Anio_mes"]] = r["version"]
    return Snapshot(rows[0]["number"], dict(months))


def _unversioned(spark: SparkSession, folder: str, table: str) -> dict[str, str]:
    place = f"{folder}/{table}"
    stored = spark.read.schema(rollup_schema(table)).option("basePath", place)
    found = or_nothing(lambda: stored.parquet(f"{place}/{MONTH}=*"))
    return {} if found is None else months_of(found)


def publish(spark: SparkSession, folder: str, new: Snapshot) -> None:
    """Make a snapshot the current one: one file, so one step.

    One writer at a time is expected; a batch that finds the folder changed since it began is an error and
    changes nothing.
    """
    if snapshot(spark, folder).number != new.number - 1:
        raise ConcurrentBatch(f"{folder} is no longer at snapshot {new.number - 1}")
    rows = [(new.number, t, m, v) for t, months in new.months.items() for m, v in sorted(months.items())]
    rows.append((new.number, None, None, None))  # so that a snapshot without months is one as well
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def read_version(spark: SparkSession, folder: str, table: str, months: dict[str, str]) -> DataFrame:
    """The rows of the given months of a table, each from its version.  Only those folders are read: the
    choice is a predicate over partition columns."""
    schema = rollup_schema(table)
    place = f"{folder}/{table}"
    by_version: dict[str, list[str]] = defaultdict(list)
    plain = []
    for month, version in sorted(months.items()):
        if "=" in version:
            plain.append(f"{place}/{version}")
        else:
            by_version[version].append(month)
    parts = []
    if plain:  # listed one by one, as folders of versions may stand beside them
        parts.append(spark.read.schema(schema).option("basePath", place).parquet(*plain))
    if by_version:
        versioned = T.StructType([*schema.fields, T.StructField("version", T.StringType())])
        stored = spark.read.schema(versioned).option("basePath", place).parquet(
            *[f"{place}/version={v}" for v in by_version])
        chosen = F.lit(False)
        for version, listed in by_version.items():
            chosen = chosen | ((F.col("version") == version) & F.col(MONTH).isin(listed))
        parts.append(stored.where(chosen))
    if not parts:
        return spark.createDataFrame([], schema)
    rows = [p.select(*schema.names) for p in parts]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


def drop_versions(spark: SparkSession, folder: str, keep: int = 1, hours: float = 24.0) -> list[str]:
    """Remove the folders that none of the last ``keep`` snapshots uses; gives their names.

    A version that no snapshot ever used may belong to a batch that is being written, and stays until it
    is ``hours`` old.  Readers of an earlier snapshot must have ended.
    """
    manifest = or_nothing(lambda: spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))
    if manifest is None:
        return []
    rows = manifest.where("version IS NOT NULL").select("number", "tabla", "version").distinct().collect()
    last = manifest.agg(F.max("number")).first()[0]
    used = {(r["tabla"], r["version"]) for r in rows if r["number"] > last - keep}
    known = {(r["tabla"], r["version"]) for r in rows}
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    dropped = []
    for table in ROLLUPS:
        place = files.Path(f"{folder}/{table}")
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(place):
            continue
        now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
        for status in system.listStatus(place):
            name = status.getPath().getName()
            version = name.partition("=")[2]
            if not name.startswith("version=") or (table, version) in used:
                continue
            if (table, version) in known or now - status.getModificationTime() >= hours * 3_600_000:
                system.delete(status.getPath(), True)
                dropped.append(f"{table}/{name}")
    return sorted(dropped)
