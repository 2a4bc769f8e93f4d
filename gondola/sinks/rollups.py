"""Writing rollups: full build and month replacement, each published in one step."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from gondola.operators.normalize import FAULTS, accepted, parse_lines, rejected
from gondola.operators.rollup import build_rollup, detail
from gondola.schema import MONTH, ROLLUPS, rollup_schema
from gondola.session import release, shuffles_removed
from gondola.sources.lines import scan_sales_csv
from gondola.sources.rollups import read_rollup
from gondola.sources.versions import Snapshot, months_of, publish, snapshot


CODEC = "zstd"
#: Lines of a task that aggregates one part of a month.
PART_LINES = 500_000
#: Lines from which the shuffle files of one pair of tables are removed before those of the next are written.
RELEASE_LINES = 2_000_000
_PART = "_parte"


@dataclass(frozen=True)
class Parts:
    """Months cut into parts of about ``PART_LINES`` lines, small months sharing one: (first, count) of each
    month and the number of all parts.  Fewer lines than that are cut finer, so that every core has a part."""

    of: dict[str | None, tuple[int, int]]
    total: int

    @classmethod
    def cut(cls, sizes: dict[str | None, int], cores: int, lines: int = PART_LINES) -> "Parts":
        lines = max(1, min(lines, math.ceil(sum(sizes.values()) / cores)))
        of, first, held = {}, 0, 0
        for month, size in sorted(sizes.items(), key=lambda s: (s[0] is None, s[0] or "")):
            if held and held + size > lines:
                first, held = first + 1, 0
            count = max(1, math.ceil(size / lines))
            of[month] = (first, count)
            first, held = (first, held + size) if count == 1 else (first + count, 0)
        return cls(of, first + 1 if held else max(first, 1))


def month_sizes(lines: DataFrame) -> dict[str | None, int]:
    """Lines of each month: one pass over one column."""
    return dict(map(tuple, lines.groupBy(MONTH).count().collect()))


def in_parts(rows: DataFrame, parts: Parts, keys: list[str]) -> DataFrame:
    """``rows`` dealt out by month and, within a month, by ``keys``, with the part as a column.

    Grouped by the part and whatever contains ``keys`` and the month, they need no further shuffle, and are
    written to their month's folder from there.
    """
    plan = rows.sparkSession.createDataFrame(
        [(m, first, count) for m, (first, count) in parts.of.items()],
        "_mes string, _primera int, _partes int")
    share = F.pmod(F.xxhash64(*keys), F.col("_partes")).cast("int")
    met = rows.join(F.broadcast(plan), F.col(MONTH).eqNullSafe(F.col("_mes")))
    placed = met.withColumn(_PART, F.col("_primera") + share).select(*rows.columns, _PART)
    return placed.repartitionById(parts.total, F.col(_PART))


def write_rollup(table: DataFrame, folder: str, name: str, version: str) -> dict[str, str]:
    """One rollup as parquet under a new version, a folder per month; gives the version of its months.

    REBALANCE brings the rows of a month together so that a month is a few files rather than one
    per task, and adaptive execution splits a month that is too big for one task; rows in parts
    (``in_parts``) are so already.  Nobody reads a version before it is published, so a lost job can
    simply run again under another one.
    """
    schema, path = rollup_schema(name), f"{folder}/{name}/version={version}"
    rows = table.select(*schema.names)
    rows = rows if _PART in table.columns else rows.hint("rebalance", MONTH)
    rows.write.partitionBy(MONTH).option("compression", CODEC).parquet(path)
    written = table.sparkSession.read.schema(schema).parquet(path)
    return dict.fromkeys(months_of(written), version)


def stage_lines(lines: DataFrame, folder: str) -> DataFrame:
    """Normalized lines as one parquet table.

    Raw text is parsed once; each rollup then reads only its own columns.  The table also cuts
    the lineage: a lost executor repeats parquet reads, not the parsing, and whatever the lines were
    shuffled for is removed from disk.
    """
    path = f"{folder}/lineas"
    with shuffles_removed(lines.sparkSession):
        lines.write.mode("overwrite").option("compression", CODEC).parquet(path)
    return lines.sparkSession.read.parquet(path)


def write_rollups(lines: DataFrame, folder: str, months: list[str] | None = None) -> Snapshot:
    """All five rollups; with the list of the lines' months, only those months are replaced.

    The lines are passed over three times: for ``tickets``, for ``promo_prod``, and for a detail that both
    ``ventas`` and ``ventas_dia`` are sums of.  The latter two have about as many keys as lines, so combining
    lines before the shuffle would only cost memory: the lines are dealt out by month and store or product,
    each once, and a task groups its part of a month and writes it.  The grouped parts are kept on disk until
    the second table of each is written from them, and a lost executor computes its part again.

    Both shuffles are about as large as the lines, so one pair of tables follows the other, and the first has
    left the disk before the second begins.  The tickets, a small shuffle, are written beside them.

    The new months are published together at the end (``sources.versions``): a reader sees all five
    tables before the batch or after it, and a job that ends half way leaves them as they were.  A month
    without rows in a table (lines without any store give no tickets) is empty there afterwards.
    """
    spark = lines.sparkSession
    before, version = snapshot(spark, folder), uuid.uuid4().hex
    with shuffles_removed(spark):
        sizes = month_sizes(lines)
    parts = Parts.cut(sizes, spark.sparkContext.defaultParallelism)

    def write(name: str, table: DataFrame) -> dict[str, dict[str, str]]:
        return {name: write_rollup(table, folder, name, version)}

    def of_products() -> dict[str, dict[str, str]]:
        rows = build_rollup(in_parts(lines, parts, ["Cod_prod", "Nom_prod"]), "promo_prod", [_PART])
        return _kept(rows, lambda kept: write("promo_prod", kept) | write(
            "productos", build_rollup(kept, "productos", [_PART])))

    def of_stores() -> dict[str, dict[str, str]]:
        rows = detail(in_parts(lines, parts, ["Tiendas", "Categoria"]), [_PART])
        return _kept(rows, lambda kept: write("ventas", build_rollup(kept, "ventas", [_PART])) | write(
            "ventas_dia", build_rollup(kept, "ventas_dia")))

    with shuffles_removed(spark), ThreadPoolExecutor(1) as pool:
        tickets = pool.submit(lambda: write("tickets", build_rollup(lines, "tickets")))
        written = {}
        for pair in (of_products, of_stores):
            written |= pair()
            if sum(sizes.values()) >= RELEASE_LINES:
                release(spark)
        written |= tickets.result()  # raises its failure
    new = before.replacing(months, {name: written[name] for name in ROLLUPS})
    publish(spark, folder, new)
    return new


def _kept(rows: DataFrame, use: Callable[[DataFrame], dict]) -> dict:
    """What ``use`` makes of ``rows``, which are kept on disk meanwhile."""
    rows.persist(StorageLevel.DISK_ONLY)
    try:
        return use(rows)
    finally:
        rows.unpersist(blocking=True)


def products_of(spark: SparkSession, folder: str, state: Snapshot) -> DataFrame:
    """The product rollup from the stored ``promo_prod`` of a snapshot."""
    return build_rollup(read_rollup(spark, folder, "promo_prod", state), "productos")


def merge_batch(lines: DataFrame, folder: str) -> list[str]:
    """Month replacement: the months of a new batch replace those months in every rollup, at once.

    Other months are not read or written.  Returns the replaced months in order; a batch without
    a single valid line is an error and leaves the tables as they are.  The months reach the driver:
    one per calendar month the lines span, and one per malformed date text of eight characters.
    """
    months = [r[0] for r in lines.select(MONTH).distinct().orderBy(MONTH).collect()]
    if not months:
        raise ValueError("the batch has no valid line")
    write_rollups(lines, folder, months)
    return months


class TooManyRejected(RuntimeError):
    """A batch with more rejected lines than its caller allows; the rollups are as they were."""


@dataclass(frozen=True)
class Batch:
    """What became of a batch: replaced months, lines read, lines put aside, and where these are."""

    months: list[str]
    lines: int
    rejected: int
    rejected_path: str


def ingest_batch(
    spark: SparkSession, csv_path: str, folder: str, staging: str, partitions: int | None = None,
    max_rejected: int | None = None,
) -> Batch:
    """Raw line files to rollups: parse once into ``staging``, then merge the months they hold.

    Works for the first load and for every later batch alike.  A caller whose files cannot be split
    (compressed text) may deal the lines out to a number of ``partitions``, at the price of a shuffle.

    Lines with an amount too large for its type are put aside: a row for each such amount, with file,
    split offset, row, column, reason and text, in ``<staging>/rechazos``.  The rest of the batch is loaded,
    unless more than ``max_rejected`` lines are put aside.  Lines are counted as they are staged.
    """
    lines = parse_lines(scan_sales_csv(spark, csv_path))
    lines = lines.repartition(partitions) if partitions else lines
    counts = Observation("lines")
    bad = F.when(F.size(FAULTS) > 0, 1)
    staged = stage_lines(lines.observe(
        counts, F.count(F.lit(1)).alias("lines"), F.count(bad).alias("rejected")), staging)
    found = counts.get
    path = f"{staging}/rechazos"
    rejected(staged).write.mode("overwrite").parquet(path)
    if max_rejected is not None and found["rejected"] > max_rejected:
        raise TooManyRejected(f"{found['rejected']} of {found['lines']} lines are in {path}")
    months = merge_batch(accepted(staged), folder)
    return Batch(months, found["lines"], found["rejected"], path)


def ingest(
    spark: SparkSession, csv_path: str, folder: str, staging: str, partitions: int | None = None,
    max_rejected: int | None = None,
) -> list[str]:
    """``ingest_batch``, of which only the replaced months are wanted."""
    return ingest_batch(spark, csv_path, folder, staging, partitions, max_rejected).months
