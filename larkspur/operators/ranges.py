"""Places of rows in an order of a whole table, or of a large group, that no task could sort by itself.

Rows are dealt by ranges of the order.  A range is known by its least key, which Spark finds for keys of
any type with an order; sums over the rows before a range then follow from one sum a range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def literal(value) -> Column:
    return F.struct(*[literal(v).alias(n) for n, v in value.asDict(False).items()]) if isinstance(value, Row) else F.lit(value)


def range_starts(df: DataFrame, key: str, n: int) -> list[Column]:
    """Least keys, in order, of up to ``n`` ranges of about as many rows (an entry a range comes to the driver)."""
    kind = df.schema[key].dataType.simpleString()
    ranged = df.select(key).repartitionByRange(max(1, n), key).groupBy(F.spark_partition_id()).agg(F.min(key).alias("low"))
    return [literal(r["low"]).cast(kind) for r in ranged.where("low IS NOT NULL").orderBy("low").collect()]


def range_of(key: Column, starts: list[Column]) -> Column:
    """Number of the range that a key lies in: blocks of ranges first, then within one.  Keys before the first range lie in it."""
    rest = starts[1:]
    if not rest:
        return F.lit(0)
    side = max(1, math.isqrt(len(rest)))
    blocks = [rest[i : i + side] for i in range(0, len(rest), side)]
    block = F.size(F.filter(F.array(*[b[0] for b in blocks]), lambda c: c <= key))
    inside = F.element_at(F.array(*[F.array(*b) for b in blocks]), F.greatest(block, F.lit(1)))
    return F.when(key.isNull() | (block == 0), 0).otherwise((block - 1) * side + F.size(F.filter(inside, lambda c: c <= key)))


#: Aggregates that can be carried over ranges: the function, how two results meet, and the result of no rows.
CARRIED = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "product": (F.product, lambda a, b: a * b, 1.0),
    "max": (F.max, F.greatest, None),
    "min": (F.min, F.least, None),
}


def running(df: DataFrame, order: str, name: str, *, keys: Sequence[str] = (), amount: str | None = None, how: str = "sum") -> DataFrame:
    """``df`` with the sum of ``amount`` (the number, where there is none) of the rows earlier in ``order`` among those of equal ``keys``.

    ``how`` may also be product, max or min.  ``order`` is distinct among rows of equal keys.  A group of
    any size is spread over as many tasks as there are shuffle partitions.  ``df`` is made once, and
    written to the shared folder, before its ranges are found.
    """
    df = checkpointed(df)
    own = "_".join(["", *df.columns])  # no column has a name that starts like this
    part, total, earlier, place = (f"{own}_{x}" for x in ("part", "total", "earlier", "place"))
    gather, meet, nothing = CARRIED[how]
    made = gather(amount) if amount else F.count("*")
    filled = lambda c: c if nothing is None else F.coalesce(c, F.lit(nothing))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn(place, F.struct(*keys, order) if keys else F.col(order))
    rows = rows.withColumn(part, range_of(F.col(place), range_starts(rows, place, n))).drop(place)
    sums = rows.groupBy(part, *keys).agg(made.alias(total))
    ranges = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = sums.withColumn(earlier, filled(gather(total).over(ranges)))
    sums = sums.select(*[F.col(c).alias(f"{own}_of_{c}") for c in (part, *keys)], earlier)
    within = Window.partitionBy(part, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{own}_of_{c}")) for c in (part, *keys)])
    return rows.withColumn(total, filled(made.over(within))).join(sums, same).select(*df.columns, meet(F.col(earlier), F.col(total)).alias(name))
