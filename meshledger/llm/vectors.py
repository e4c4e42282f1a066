"""What the operators on vectors share: which rows take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: Column) -> Column:
    """True if the vector and all its entries are there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))), F.lit(False))


def dimension(rows: DataFrame, column: str) -> int:
    """The commonest length of the vectors (the greatest of equally common ones); 0 without rows."""
    found = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0


def scaled(vector: Column, by: int, plus: int = 0) -> Column:
    """floor(by * x) + plus of each entry x, taken as double, as bigint."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(by))) + F.lit(plus).cast("long"))
