"""The promotional cycle calendar and the month that belongs to each cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Cycle, year, first day, last day.
CYCLES = [
    ("C5", "2023", "2023-09-06", "2023-11-02"),
    ("C6", "2023", "2023-11-03", "2024-01-02"),
    ("C1", "2024", "2024-01-03", "2024-03-05"),
    ("C2", "2024", "2024-03-06", "2024-05-07"),
    ("C3", "2024", "2024-05-08", "2024-07-02"),
    ("C4", "2024", "2024-07-03", "2024-09-03"),
    ("C5", "2024", "2024-09-04", "2024-11-05"),
    ("C6", "2024", "2024-11-06", "2025-01-07"),
    ("C1", "2025", "2025-01-08", "2025-03-04"),
    ("C2", "2025", "2025-03-05", "2025-05-06"),
    ("C3", "2025", "2025-05-07", "2025-07-01"),
    ("C4", "2025", "2025-07-02", "2025-09-02"),
    ("C5", "2025", "2025-09-03", "2025-11-04"),
    ("C6", "2025", "2025-11-05", "2026-01-06"),
    ("C1", "2026", "2026-01-07", "2026-03-03"),
    ("C2", "2026", "2026-03-04", "2026-05-05"),
    ("C3", "2026", "2026-05-06", "2026-06-30"),
    ("C4", "2026", "2026-07-01", "2026-09-01"),
    ("C5", "2026", "2026-09-02", "2026-11-03"),
    ("C6", "2026", "2026-11-04", "2027-01-05"),
]


def cycle_calendar(spark: SparkSession) -> DataFrame:
    """Twenty rows ``(ciclo, anio, ini, fin)``; VALUES keeps it a local relation of known size."""
    rows = ", ".join(f"('{c}', '{y}', DATE'{a}', DATE'{b}')" for c, y, a, b in CYCLES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS ciclos(ciclo, anio, ini, fin)")


def month_cycles(calendar: DataFrame) -> DataFrame:
    """One row per month: the cycle that holds its 15th day (the earliest, should two do)."""
    months = calendar.select(
        "ciclo", "anio", "ini", "fin",
        F.explode(F.sequence(F.trunc("ini", "MM"), F.col("fin"), F.expr("interval 1 month")))
        .alias("mes"),
    )
    inside = months.where(F.date_add("mes", 14).between(F.col("ini"), F.col("fin")))
    return (
        inside.groupBy(F.date_format("mes", "yyyy-MM").alias("Anio_mes"))
        .agg(F.min_by(F.struct("ciclo", "anio"), "ini").alias("c"))
        .select(
            "Anio_mes",
            F.concat_ws("-", "c.ciclo", "c.anio").alias("CicloAno_mes"),
            F.col("c.ciclo").alias("ciclo"),
        )
    )


def cycle_of_month() -> dict[str, str]:
    """Month to cycle as plain values.

    The calendar is a constant, so its months can be literals in a plan: a month filter then
    prunes partition folders at planning time, and tagging a row needs no join.
    """
    months: dict[str, str] = {}
    for cycle, year, first, last in CYCLES:
        for y in range(int(first[:4]), int(last[:4]) + 1):
            for m in range(1, 13):
                month = f"{y}-{m:02d}"
                if first <= f"{month}-15" <= last:  # ISO dates sort as text
                    months.setdefault(month, f"{cycle}-{year}")
    return months


def cycle_label(month: Column) -> Column:
    """Cycle of a month, '' outside the calendar."""
    months = cycle_of_month()
    table = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    return F.coalesce(F.try_element_at(table, month), F.lit(""))


def attach_cycle(df: DataFrame, alias: str = "CicloAno_mes") -> DataFrame:
    """Add the cycle of each row's month; a narrow column that is pruned where nobody uses it."""
    return df.withColumn(alias, cycle_label(F.col("Anio_mes")))


def week_label(day: Column) -> Column:
    """Calendar year plus ISO week (so 2024-12-30 is ``2024-W01``); '' for an impossible date."""
    # Dates outside the nanosecond timestamp range count as impossible.
    parsed = F.try_to_date(day, "yyyy-MM-dd")
    parsed = F.when(F.year(parsed).between(1678, 2261), parsed)
    label = F.concat(
        F.date_format(parsed, "yyyy"), F.lit("-W"),
        F.lpad(F.weekofyear(parsed).cast("string"), 2, "0"),
    )
    return F.coalesce(label, F.lit(""))
