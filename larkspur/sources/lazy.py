"""User-supplied tables: a schema and a function that reads partitions, as a Python data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


#: The setting under which Spark hands filters to Python sources; a reader that takes them fails without it.
PUSHED = "spark.sql.python.filterPushdown.enabled"
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}


def comparison(f: Filter) -> tuple[str, str, object] | None:
    """``(column, operator, value)`` of a filter on a column of the table, if it is one of ``COMPARISONS``."""
    return (f.attribute[0], COMPARISONS[type(f)], f.value) if type(f) in COMPARISONS and len(f.attribute) == 1 else None


def from_lazy_source(
    spark: SparkSession, name: str, schema: StructType, parts: Sequence, read: Callable[..., Iterator], columns: Sequence[str] | None = None, *, filtered: bool = False
) -> DataFrame:
    """A table that ``read(part, wanted)`` yields for each of ``parts``, on the executors and only when it is needed: tuples, or Arrow batches.

    ``wanted`` are the columns to read, in the order of the schema: those in ``columns``, or all.  The
    table has just these.  If ``filtered``, ``read`` gets as a third argument the comparisons ``(column,
    operator, value)`` of the query, all of which a row has to pass, where the session pushes filters
    (``PUSHED``); it may use them to skip rows, Spark tests them again.
    """
    unknown = set(columns or ()) - set(schema.names)
    if unknown:
        raise KeyError(f"no column {', '.join(sorted(unknown))}; there are {', '.join(schema.names)}")
    wanted = [n for n in schema.names if columns is None or n in columns]
    pruned = StructType([schema[n] for n in wanted])

    class Reader(DataSourceReader):
        def __init__(self):
            self.tests = []

        def partitions(self):
            return [InputPartition(p) for p in parts]

        def read(self, partition):
            yield from read(partition.value, wanted, self.tests) if filtered else read(partition.value, wanted)

    class FilteredReader(Reader):
        def pushFilters(self, filters):
            for f in filters:
                if test := comparison(f):
                    self.tests.append(test)
                yield f

    reads = FilteredReader if filtered and spark.conf.get(PUSHED) == "true" else Reader

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return pruned

        def reader(self, schema):
            return reads()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
