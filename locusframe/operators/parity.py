"""Comparison of two result tables: keys must agree, numbers within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], numbers: dict[str, float]) -> DataFrame:
    """Rows that differ: (keys, occurrence, problem, a's and b's numbers).

    Repeated keys are numbered by their numbers' order and compared one by one.  Two nulls (or NaNs) agree; a
    number agrees with another within its tolerance.  One full join on the keys; equal tables give no rows.
    """
    order = Window.partitionBy(*keys).orderBy(*numbers)
    a, b = (x.select(*keys, *numbers).withColumn("occurrence", F.row_number().over(order)) for x in (a, b))
    a = a.select(*keys, "occurrence", F.struct(*numbers).alias("a"))
    b = b.select(*keys, "occurrence", F.struct(*numbers).alias("b"))
    both = a.join(b, [*keys, "occurrence"], "full_outer")

    def apart(c: str):
        x, y = (F.when(~F.isnan(F.col(f"{s}.{c}").cast("double")), F.col(f"{s}.{c}").cast("double")) for s in "ab")
        return F.when(x.isNull() | y.isNull(), ~(x.isNull() & y.isNull())).otherwise(F.abs(x - y) > numbers[c])

    problem = F.when(F.col("a").isNull(), "only in b").when(F.col("b").isNull(), "only in a")
    for c in numbers:
        problem = problem.when(apart(c), f"{c} differs")
    return both.withColumn("problem", problem).where("problem is not null")
