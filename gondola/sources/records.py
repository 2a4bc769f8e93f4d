"""Records of line files whose quoted fields hold line breaks, at any split of the files.

A split starts anywhere, so it cannot tell by itself whether it begins inside a quoted field.  But every line
maps the state it begins in (outside or inside quotes) to the one it ends in, and such maps compose: each
either fixes the state, flips it or leaves it.  So every split of a file is summed up as one map, the maps of
a file are composed in the order of its splits (a few bytes a split), and that gives the state at the start
of each split, and from there that of each line.  Lines that begin inside quotes are then joined to the line
their record starts on, across splits as well.

Only files in which some line ends inside quotes are treated so.  A window is as large as one split of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A quote that is never closed would make the rest of its file one record; longer ones are an error.
MAX_LINES = 10_000
# A closed quoted part, the end of one that was open before, and a field that opens one.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_CLOSING = r'^[^"]*+(?:""[^"]*+)*+"'
_PLACE = ["Archivo", "Bloque"]


def _opens(line: Column, sep: str) -> Column:
    """Whether a line that begins outside quotes ends inside; a quote opens at the start of a field only."""
    rest = F.regexp_replace(line, f"(^|{sep}){_QUOTED}", "$1")
    return rest.rlike(f'(^|{sep})"')


def text_lines(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """Lines with their place, and the state each ends in from either state: ``fuera`` if it begins outside
    quotes, ``dentro`` if inside."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("Archivo"), F.col("_metadata.file_block_start").alias("Bloque"),
        F.monotonically_increasing_id().alias("Fila"))
    quoted = F.contains("value", F.lit('"'))
    closed = F.regexp_replace("value", _CLOSING, "x")  # what follows is not the start of a field
    return lines.withColumns({
        "fuera": F.when(quoted, _opens(F.col("value"), sep).cast("int")).otherwise(0),
        "dentro": F.when(~quoted | ~F.col("value").rlike(_CLOSING), 1).otherwise(_opens(closed, sep).cast("int")),
    })


def broken_files(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """Files in which some line, as read by itself, ends inside quotes.

    Two quotes between separators change no state: an empty field outside quotes, one quote within.  Writers
    make them of empty text, so they are taken out, and lines without any other quote need no regex."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("Archivo"))
    text = F.replace("value", F.lit(f'{sep}""{sep}'), F.lit(sep * 2))
    return lines.where(F.contains(text, F.lit('"'))).where(_opens(text, sep)).select("Archivo").distinct()


def _steps(rows: DataFrame, group: list[str], order: str, fixed: Column, flips: Column) -> DataFrame:
    """``_giros``, the flips before a step, and ``_ultimo``, the last state fixed before it with the flips
    until then; ``_marca`` is that of the step itself."""
    window = Window.partitionBy(*group).orderBy(order)
    until = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_hasta", F.sum(flips).over(until))
    rows = rows.withColumn("_marca", F.when(fixed.isNotNull(), F.struct(fixed.alias("v"), F.col("_hasta").alias("n"))))
    return rows.withColumns({
        "_giros": F.col("_hasta") - flips, "_ultimo": F.last("_marca", ignorenulls=True).over(before)})


def _state(start: Column) -> Column:
    fixed = F.col("_ultimo")
    return F.when(fixed.isNull(), start + F.col("_giros")).otherwise(fixed["v"] + F.col("_giros") - fixed["n"]) % 2


def with_states(lines: DataFrame) -> DataFrame:
    """``antes`` and ``despues``: whether a line begins and ends inside quotes."""
    fixed = F.when(F.col("fuera") == F.col("dentro"), F.col("fuera"))
    flips = F.when(F.col("fuera") > F.col("dentro"), 1).otherwise(0)
    steps = _steps(lines, _PLACE, "Fila", fixed, flips)
    splits = steps.groupBy(*_PLACE).agg(
        F.max_by("_marca", F.when(F.col("_marca").isNotNull(), F.col("Fila"))).alias("m"), F.sum(flips).alias("todos"))
    splits = splits.withColumn("sale", (F.col("m.v") + F.col("todos") - F.col("m.n")) % 2)
    splits = _steps(splits, ["Archivo"], "Bloque", F.col("sale"),
                    F.when(F.col("sale").isNull(), F.col("todos")).otherwise(0))
    starts = splits.select(F.col("Archivo").alias("_a"), F.col("Bloque").alias("_b"),
                           _state(F.lit(0)).alias("_inicio"))
    known = steps.join(starts, (F.col("Archivo") == F.col("_a")) & (F.col("Bloque") == F.col("_b")))
    known = known.withColumn("antes", _state(F.col("_inicio")))
    after = F.when(F.col("antes") == 0, F.col("fuera")).otherwise(F.col("dentro"))
    return known.withColumn("despues", after).select("value", *_PLACE, "Fila", "antes", "despues")


def records(lines: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """(value, Archivo, Bloque, Fila): one row per record, at the place of its first line."""
    known = with_states(lines)
    whole = known.where("antes = 0 AND despues = 0").where(F.trim("value") != "").select("value", *_PLACE, "Fila")
    window = Window.partitionBy(*_PLACE).orderBy("Fila")
    until = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = known.where("antes = 1 OR despues = 1").withColumn(
        "_de", F.last(F.when(F.col("antes") == 0, F.struct("Bloque", "Fila")), ignorenulls=True).over(until))
    pieces = pieces.withColumn("_n", F.row_number().over(Window.partitionBy(*_PLACE, "_de").orderBy("Fila")))
    # A split that begins inside a record continues the last one that was begun before it.
    begun = pieces.groupBy(*_PLACE).agg(F.max("_de").alias("_fin"))
    earlier = Window.partitionBy("Archivo").orderBy("Bloque").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select(F.col("Archivo").alias("_a"), F.col("Bloque").alias("_b"),
                         F.last("_fin", ignorenulls=True).over(earlier).alias("_previo"))
    pieces = pieces.join(begun, (F.col("Archivo") == F.col("_a")) & (F.col("Bloque") == F.col("_b")))
    long_ = F.raise_error(F.concat(
        F.lit(f"a quoted field goes on for more than {max_lines} lines in "), F.col("Archivo"),
        F.lit(" at "), F.col("Bloque").cast("string"))).cast("string")
    text = F.when(F.col("_n") > max_lines, long_).otherwise(F.col("value"))
    joined = pieces.groupBy("Archivo", F.coalesce("_de", "_previo").alias("de")).agg(
        F.sort_array(F.collect_list(F.struct("Bloque", "Fila", text.alias("t")))).alias("partes"))
    joined = joined.select(
        F.array_join(F.transform("partes", lambda p: p["t"]), "\n").alias("value"), "Archivo",
        F.col("de.Bloque").alias("Bloque"), F.col("de.Fila").alias("Fila"))
    return whole.unionByName(joined)
