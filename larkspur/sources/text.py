"""CSV with column types found from the data.

Types are the narrowest that every non-empty, trimmed cell fits: bool (true or false in any case),
int64, float64, else text; an empty cell is null, a column without a value is text.  One pass of
aggregates finds them for all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOL, WHOLE = r"(?i)^(true|false)$", r"^-?\d+$"
REAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def find_types(cells: DataFrame) -> dict[str, str]:
    """Type of each (text) column."""
    aggs = []
    for i, c in enumerate(cells.columns):
        v = F.trim(F.col(f"`{c}`"))
        for name, fits in (("b", v.rlike(BOOL)), ("w", v.rlike(WHOLE) & F.expr(f"try_cast(trim(`{c}`) AS bigint)").isNotNull()), ("r", v.rlike(REAL))):
            aggs.append(F.bool_and(F.when(v != "", fits)).alias(f"{name}{i}"))
    row = cells.agg(*aggs).first()
    return {c: "boolean" if row[f"b{i}"] else "bigint" if row[f"w{i}"] else "double" if row[f"r{i}"] else "string" for i, c in enumerate(cells.columns)}


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """Files with a header; quoted cells may hold commas, line ends and doubled quotes.  A ragged row raises when it is read, an odd number of quotes before.  Files stay splittable unless a cell holds a line end."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = spark.read.text(path).agg(F.coalesce(F.sum(quotes), F.lit(0)).alias("all"), F.count_if(quotes % 2 == 1).alias("open")).first()
    if counted["all"] % 2:
        raise ValueError("a quote isn't closed")
    cells = spark.read.csv(path, header=True, multiLine=counted["open"] > 0, quote='"', escape='"', mode="FAILFAST", inferSchema=False)
    if not infer:
        return cells
    kinds = find_types(cells)
    typed = [F.col(f"`{c}`") if k == "string" else F.trim(F.col(f"`{c}`")).cast(k) for c, k in kinds.items()]
    return cells.select(*[t.alias(c) for c, t in zip(kinds, typed)])


def write_csv(frame, path: str) -> None:
    """A folder of parts, each with the header, of the lines that ``Frame.to_csv`` makes."""
    frame.header_lines().write.text(path)
