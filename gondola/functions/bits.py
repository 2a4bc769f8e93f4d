"""Exact distinct counts as bits.

The values of a dimension (months, stores) get dense numbers; a group then keeps one bit a value, 63 to a
BIGINT, and its distinct count is the number of bits.  ``bit_or`` over BIGINTs combines on the map side and
lives in a hash-aggregation buffer, so counts of several dimensions and all sums are one aggregation with one
shuffle of a row per group and task, where ``count(DISTINCT ...)`` shuffles a row per group and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 63
#: Beyond so many BIGINTs a group of one dimension (2,016 values) callers count by values instead.
MAX_WORDS = 32


class Dimension:
    """Numbers of the values of one column, computed when first needed and then kept.

    They hold for the table they come from and for any filtered form of it.  Only as many rows as there are
    values are cached; a lost executor computes its part again, with the same numbers.
    """

    def __init__(self, table: DataFrame, column: str):
        self.column, self.number = column, f"_numero_{column}"
        self._table = table.select(column)
        self._numbers: DataFrame | None = None
        self._size = 0

    def numbers(self) -> DataFrame:
        if self._numbers is None:
            values = self._table.where(F.col(self.column).isNotNull()).distinct()
            order = Window.orderBy(self.column)  # one task, over the values of a dimension
            found = values.withColumn(self.number, F.row_number().over(order) - 1).persist()
            self._numbers, self._size = found, found.count()
        return self._numbers

    def size(self) -> int:
        """How many values there are, one at least."""
        self.numbers()
        return max(1, self._size)

    def words(self) -> int:
        return -(-self.size() // WIDTH)

    def numbered(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the number of their value.  The cached numbers have a known size, so Spark broadcasts
        them while they are small.  A value without a number would not be counted, so it is an error."""
        numbers = self.numbers().withColumnRenamed(self.column, "_valor")
        unknown = F.raise_error(F.concat(F.lit(f"{self.column} without a number: "), F.col(self.column))).cast("int")
        found = F.coalesce(F.col(self.number), F.when(F.col(self.column).isNotNull(), unknown))
        return rows.join(numbers, F.col(self.column) == F.col("_valor"), "left").withColumn(
            self.number, found).drop("_valor")

    def word(self, k: int) -> Column:
        """BIGINT ``k`` of a group of numbered rows."""
        bit = F.expr(f"shiftleft(1L, {self.number} % {WIDTH})")
        return F.bit_or(F.when(F.expr(f"{self.number} div {WIDTH} = {k}"), bit))

    def stored(self) -> list[str]:
        """Names of the BIGINTs where a table keeps them as columns."""
        return [f"_bits_{self.column}_{k}" for k in range(self.words())]

    def count(self) -> Column:
        """Distinct values of a group of numbered rows."""
        return ones([self.word(k) for k in range(self.words())])

    def count_stored(self) -> Column:
        """Distinct values of a group of rows that hold bits."""
        return ones([F.bit_or(name) for name in self.stored()])

    def release(self) -> None:
        if self._numbers is not None:
            self._numbers.unpersist()
            self._numbers = None


def ones(words: list[Column]) -> Column:
    total = F.lit(0).cast("long")
    for word in words:
        total = total + F.coalesce(F.bit_count(word), F.lit(0))
    return total
