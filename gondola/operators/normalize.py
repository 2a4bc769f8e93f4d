"""From raw text lines to typed sales lines, and from stored rollups to model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gondola.functions.cycles import attach_cycle, week_label
from gondola.functions.text import (
    blank_to_null, exact_product, normalized_code, number_or_zero, strip, too_large,
)
from gondola.schema import LINE_NUMBER, LINE_PRODUCT
from gondola.sources.rollups import Rollups

# Categories outside the pricing model.
EXCLUDED_CATEGORIES = [
    "ACCESORIOS AUTOMOTRIZ", "COMBOS COMIDA", "COMBUSTIBLES OTROS", "COMISIONES",
    "CUPONES SC - DESCUENTOS", "DONACIONES", "Descuento MiCopiloto", "IMPRESOS", "LUBRICANTES",
    "PROMOCIONES COMBUSTIBLE", "PROMOCIONES TIENDA", "RINCON ENEX", "SERVICIO AUTOMOTRIZ",
    "SERVICIOS", "SIN CATEGORIA", "TARJETA BIP", "TELEFONIA MOVIL",
]
PROMO_CODE_COLUMNS = ["CicloNum_p", "CicloAno_p", "PromoAno", "PromoNum", "TipoPromo"]
_ROWS_PER_TASK = 1 << 33  # monotonically_increasing_id: task number above bit 33, row below


def dated_lines(raw: DataFrame) -> DataFrame:
    """Keep lines whose trimmed date text has eight characters."""
    return raw.where(F.length(strip(F.col("Fecha_raw"))) == 8)


def with_dates(lines: DataFrame) -> DataFrame:
    """``Anio_mes`` and ``Fecha``, cut out of the date text."""
    day = strip(F.col("Fecha_raw"))
    month = F.concat(F.substring(day, 1, 4), F.lit("-"), F.substring(day, 5, 2))
    return lines.withColumns({
        "Anio_mes": month,
        "Fecha": F.concat(month, F.lit("-"), F.substring(day, 7, 2)),
    })


def with_week(df: DataFrame) -> DataFrame:
    """``Semana``, the ISO week label of ``Fecha``."""
    return df.withColumn("Semana", week_label(F.col("Fecha")))


_NUMBERS = ("Cantidad", "Precio", "Importe", "Costo_unit")
_PRODUCTS = {"Costo_total": "Costo_unit", "Precio_x_Cant": "Precio"}
#: What is wrong with a line: column, reason and text of each amount that does not fit.
FAULTS = "Rechazos"


def with_amounts(lines: DataFrame) -> DataFrame:
    """Numeric text to exact decimals, then the two line extensions.

    An amount that does not fit is never taken as some other one: ``Rechazos`` lists it, the column itself
    is 0, and ``accepted`` or ``strict`` decide what becomes of the line.
    """
    def fault(condition: Column, column: str, reason: str, text: Column) -> Column:
        return F.when(condition, F.struct(
            F.lit(column).alias("Columna"), F.lit(reason).alias("Motivo"), text.alias("Texto")))

    texts = lines.withColumns({f"_{c}": F.col(c) for c in _NUMBERS})
    typed = texts.withColumns({c: number_or_zero(F.col(f"_{c}"), LINE_NUMBER) for c in _NUMBERS})
    typed = typed.withColumns({
        name: exact_product(F.col(price), F.col("Cantidad"), LINE_PRODUCT) for name, price in _PRODUCTS.items()})
    faults = [fault(too_large(F.col(f"_{c}"), LINE_NUMBER), c, "number too large", F.col(f"_{c}"))
              for c in _NUMBERS]
    faults += [fault(F.col(name).isNull(), name, "product too large", F.concat_ws(" * ", f"_{price}", "_Cantidad"))
               for name, price in _PRODUCTS.items()]
    return typed.withColumn(FAULTS, F.filter(F.array(*faults), lambda x: x.isNotNull())).drop(
        *[f"_{c}" for c in _NUMBERS])


def accepted(lines: DataFrame) -> DataFrame:
    """The lines whose amounts fit."""
    return lines.where(F.size(FAULTS) == 0).drop(FAULTS)


def strict(lines: DataFrame) -> DataFrame:
    """All lines; an amount that does not fit is an error that names the file, offset and ticket."""
    parts = [F.col(c).cast("string") for c in ("Archivo", "Bloque") if c in lines.columns]
    first = F.get(F.col(FAULTS), F.lit(0))
    message = F.concat(first["Motivo"], F.lit(": "), first["Texto"], F.lit(" in "),
                       F.concat_ws(" at ", *parts, F.col("Transaccion")))
    checked = F.when(F.size(FAULTS) > 0, F.raise_error(message).cast(LINE_NUMBER))
    return lines.withColumns({c: F.coalesce(checked, F.col(c)) for c in ("Importe", *_PRODUCTS)}).drop(FAULTS)


def rejected(lines: DataFrame) -> DataFrame:
    """The other lines: one row for each amount that does not fit, with the place of its line."""
    order = F.col("Orden")
    return lines.where(F.size(FAULTS) > 0).select(
        "Archivo", F.floor(order / F.lit(_ROWS_PER_TASK)).cast("long").alias("Bloque"),
        F.pmod(order, F.lit(_ROWS_PER_TASK).cast("decimal(38,0)")).cast("long").alias("Fila"),
        "Fecha", "Tiendas", "Transaccion", "Cod_prod", F.inline(FAULTS))


def with_promo_flag(lines: DataFrame) -> DataFrame:
    """Blank promo code or name to NULL; ``has_promo`` is 1 where a code remains."""
    return (
        lines.withColumn("Cod_promo", blank_to_null(F.col("Cod_promo")))
        .withColumn("Nom_promo", blank_to_null(F.col("Nom_promo")))
        .withColumn("has_promo", F.col("Cod_promo").isNotNull().cast("int"))
    )


def with_line_order(lines: DataFrame) -> DataFrame:
    """``Orden``: position of a line within its file.

    The split's byte offset first, then the row number the scan task gives it.  Rows of one split
    are read by one task in file order, so the pair orders a whole file.  It is one DECIMAL rather
    than a struct because a fixed-width value can live in a hash-aggregation buffer.
    """
    row = F.pmod(F.col("Fila"), F.lit(_ROWS_PER_TASK))
    offset = F.col("Bloque").cast("decimal(20,0)") * F.lit(_ROWS_PER_TASK).cast("decimal(11,0)")
    return lines.withColumn("Orden", (offset + row).cast("decimal(38,0)")).drop("Bloque", "Fila")


def with_store_code(lines: DataFrame) -> DataFrame:
    """Trimmed store code; a missing store stays NULL.  Done once, before the rollups are written,
    so that a store filter on a rollup is a plain comparison the scan can use."""
    return lines.withColumn("Tiendas", strip(F.col("Tiendas")))


def parse_lines(raw: DataFrame) -> DataFrame:
    """The whole row-level path: narrow, no shuffle, one code-generated stage.  Lines with an amount that
    does not fit carry it in ``Rechazos``.

    Week and cycle are functions of the date, so they are added to rolled-up rows (a few thousand
    dates) rather than to every line.
    """
    lines = with_promo_flag(with_amounts(with_dates(with_store_code(dated_lines(raw)))))
    return with_line_order(lines).drop("Fecha_raw")


def normalize_lines(raw: DataFrame) -> DataFrame:
    """Parsed lines, all of whose amounts fit; one that does not is an error."""
    lines = with_promo_flag(strict(with_amounts(with_dates(with_store_code(dated_lines(raw))))))
    return with_line_order(lines).drop("Fecha_raw")


def in_model(category: Column) -> Column:
    """False for excluded categories; a NULL category stays in the model.

    Spelled as an OR because that form is pushed into the parquet scan, unlike ``coalesce``.
    """
    return category.isNull() | ~category.isin(EXCLUDED_CATEGORIES)


def promo_code_parts(code: Column) -> dict[str, Column]:
    """Cycle number, cycle-year, year, promo number and promo type of a promo code.

    ``C4-2024-06-CIRM`` gives C4, C4-2024, 2024, 06, CIRM; a missing part is ''.
    """
    parts = F.split(normalized_code(code), "-")

    def part(i: int) -> Column:
        return F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))

    number, year = part(1), part(2)
    return {
        "CicloNum_p": number,
        "CicloAno_p": F.when((number != "") & (year != ""), F.concat(number, F.lit("-"), year))
        .otherwise(""),
        "PromoAno": year,
        "PromoNum": part(3),
        "TipoPromo": F.when(F.size(parts) >= 2, part(-1)).otherwise(""),
    }


def model_tables(stored: Rollups) -> Rollups:
    """Stored rollups as the reports see them: exclusions, promo-code parts, cycle of the month.

    Tickets and the daily table carry no exclusion, as they must cover every sale.
    """
    def kept(table: DataFrame) -> DataFrame:
        return table.where(in_model(F.col("Categoria")))

    ventas = kept(stored.ventas).withColumns(promo_code_parts(F.col("Cod_promo")))
    return stored.with_tables(
        ventas=attach_cycle(ventas),
        productos=kept(stored.productos),
        promo_prod=kept(stored.promo_prod),
    ).numbered()
