"""Mix sources to target weights by capped water-filling.

Every source's target is ``min(cap, level * weight)``: sources whose share would need more than
``max_epochs`` passes stop at that cap and what they can't take is shared again by weight.  With the
sources ordered by cap / weight, the level at which no source is above its cap is the largest of
``(budget - caps of the sources before) / (weights of the sources from here on)``, so the rounds of
the iterative method collapse into one pass of running sums over the (small) table of sources.

A source takes ``floor(target / size)`` whole repetitions of all its documents.  The fraction that is
left is filled with documents in a seeded order (md5 of seed and id) until the target is met; the
last one may be taken in part.  The order is never sorted within a whole source: documents fall into
bins by the first digits of the md5, bins give running sums, and a window ranks documents within a
bin only, so that a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words (runs without ASCII white space); null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """``sizes(source, source_size)`` -> also ``target``; weights repeat over the sources in code point order, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by_need = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, rest = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    budget = total.cast("double") if share == 1.0 else total * F.lit(float(share))
    levels = caps.withColumn("here", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")) / F.sum("w").over(rest).cast("double"))
    level = F.max("here").over(everything)
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("w")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    share: float = 1.0,
    seed: str = "mix",
    bin_digits: int = 3,
) -> DataFrame:
    """Return ``(id_col, source, size, source_size, target, taken)``, one row per row of ``docs``.

    ``taken`` counts the words that the mix takes of the document, repetitions included: never more
    than ``max_epochs`` times its size; a source's sum is the floor of its target.  Defined cases: a
    null or empty text has size 0 and takes 0; null sources form one source, the last; repeated ids
    are rows of their own (order within equal md5: by size); an empty table gives no rows; other
    columns are ignored.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), digest.alias("h"))
    # nulls don't join: a flag and a filled value stand for the source from here on
    rows = rows.select("id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), "size", "h", F.substring("h", 1, bin_digits).alias("bin"))
    rows = rows.repartition("no_source", "source", "bin")
    bins = rows.groupBy("no_source", "source", "bin").agg(F.sum("size").alias("bin_size"))
    sizes = bins.groupBy("no_source", "source").agg(F.sum("bin_size").alias("source_size"))
    sizes = sizes.select(F.when(~F.col("no_source"), F.col("source")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, max_epochs, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), "source_size", "target", whole.alias("whole"))
    targets = targets.withColumn("extra", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
    running = Window.partitionBy("no_source", "source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(running), F.lit(0))).drop("bin_size")
    plan = bins.join(targets, ["no_source", "source"])
    inside = Window.partitionBy("no_source", "source", "bin").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(plan, ["no_source", "source", "bin"])
    left = F.col("extra") - F.col("bin_start") - F.col("before")
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select(F.col("id").alias(id_col), F.when(~F.col("no_source"), F.col("source")).alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as the mix takes them.

    Whole repetitions return the row as it is; a document taken in part adds one more row whose text
    ends with the last word taken (``n_chars``, if there is one, is its new length).  Documents the
    mix doesn't take are left out; so are those of size 0.  Defined cases: null and empty texts have
    size 0; rows of equal id, source and size share what the mix takes of them evenly; a null source is a
    source; an empty table stays empty; the columns are those of ``docs``, whatever their names.
    """
    names = docs.columns
    id_col, source_col, text_col = options.get("id_col", "doc_id"), options.get("source_col", "source"), options.get("text_col", "text")
    own = "_".join(["", *names])  # no column has a name that starts like this
    size, part = f"{own}_size", f"{own}_part"
    # a row's copies are decided alike for equal ids of equal source and size, so one row each suffices to join
    key = [f"{own}_id", f"{own}_source", f"{own}_of"]
    plan = mix(docs, **options).select(*[F.col(c).alias(k) for c, k in zip((id_col, source_col, "size"), key)], "taken")
    plan = plan.groupBy(*key).agg((F.sum("taken") / F.count("*")).alias(f"{own}_taken"))
    sized = docs.withColumn(size, word_count(F.col(text_col)))
    same = sized[id_col].eqNullSafe(plan[key[0]]) & sized[source_col].cast("string").eqNullSafe(plan[key[1]]) & (sized[size] == plan[key[2]])
    joined = sized.join(plan, same).where(F.col(size) > 0)
    whole = F.floor(F.col(f"{own}_taken") / F.col(size)).cast("int")
    rest = F.floor(f"{own}_taken").cast("long") - whole * F.col(size)
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    each = joined.withColumn(part, F.explode(copies))
    words = F.slice(F.split(F.col(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.col(part).cast("int"))
    text = F.when(F.col(part) == 0, F.col(text_col)).otherwise(F.array_join(words, ""))
    out = each.withColumn(text_col, text)
    if "n_chars" in names and text_col != "n_chars":
        out = out.withColumn("n_chars", F.when(F.col(part) == 0, F.col("n_chars")).otherwise(F.char_length(text_col)))
    return out.select(*names)


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', 'mix', doc_id::VARCHAR)) AS h
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes),
caps AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes)::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS here
  FROM caps),
targets AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT max(here) FROM levels) * w) AS target FROM levels),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, floor(p.target)::BIGINT - p.whole * p.source_size AS extra,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken
FROM placed
"""
