"""URL filter: host and path rules, and a tree of path templates judged by smoothed labelled purity.

Rules decide the urls they fit.  Their verdicts are also the labels from which the rest is judged:

1. A path's segments are generalised by shape (numbers, hex words, long or digit-heavy slugs), so that
   a host's paths collapse to few distinct shapes, which are counted before anything is shuffled on.
2. Going down the tree of a host, level by level to its deepest path, a segment becomes ``*`` if it is
   statistically similar to its siblings: both have enough labels to tell, their smoothed rates don't
   differ (two-sided test), and what follows looks alike.  Rare segments of a node with many children
   become ``*`` too, unless their labels differ from their siblings'.  A segment without labels thus
   stays a branch of its own, which no sibling's labels reach.
3. The share of blocked labels of each template is smoothed towards that of all urls, each label used
   once.  A template above ``reject`` is blocked.

Nodes and children are grouped to sums, which are joined back: no host's paths meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

END = ""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict; null where none does.  ``rules`` are (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer ones go on top
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def segment_shapes(path: Column) -> Column:
    """Segments of a path, variable ones by shape."""

    def shape(s: Column) -> Column:
        stem, tail = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        kind = (
            F.when(stem.rlike(r"^[0-9]+$"), "<number>")
            .when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "<date>")
            .when(stem.rlike(r"^[0-9a-fA-F]{8,}$|^[0-9a-fA-F-]{32,}$"), "<hex>")
            .when(stem.rlike(r"([0-9].*){4}") | (F.length(stem) > 40), "<slug>")
            .otherwise(stem)
        )
        return F.concat(kind, tail)

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    fan_out: int = 20,
    rare: float = 0.05,
    least: int = 5,
    z: float = 1.96,
    shift: float = 0.2,
    weight: float = 5.0,
    reject: float = 0.5,
) -> DataFrame:
    """Return ``(id_col, host, path, rule, verdict, template, block_share)``, one row per row of ``pages``.

    ``least`` labels on either side are enough to compare a segment with its siblings.  Defined cases:
    a null url or one without ``://`` has an empty host and path, and is judged with all others of that
    kind; without any label the share is one half, which allows; repeated rows and ids are judged each;
    paths may be of any depth (a step down the tree for each level of the deepest); an empty table gives
    no rows; other columns are ignored.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("given"), segment_shapes(F.col("path")).alias("shape"))
    label = F.when(F.col("given") == "block", 1).when(F.col("given") == "allow", 0)
    sums = ("n", "labelled", "blocked")
    tree = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("blocked"))
    tree = checkpointed(tree)  # each level reads it several times
    prior = tree.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("share")).scalar()
    deepest = tree.agg(F.max(F.size("shape"))).first()[0] or 0
    tree = tree.withColumn("template", F.lit(""))
    for level in range(1, deepest + 1):
        if level > 2:
            tree = checkpointed(tree)
        # paths that ended before have templates of fewer segments than any that goes on
        going = tree.where(F.size("shape") >= level - 1)
        segment = F.coalesce(F.try_element_at("shape", F.lit(level)), F.lit(END))
        after = F.coalesce(F.try_element_at("shape", F.lit(level + 1)), F.lit(END))
        going = going.withColumns({"segment": segment, "plain": (~after.startswith("<")).cast("int") * F.col("n")})
        child = going.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in (*sums, "plain")])
        node = child.groupBy("host", "template").agg(*[F.sum(c).alias(f"{c}_node") for c in (*sums, "plain")], F.count("*").alias("children"))
        both = child.join(node, ["host", "template"])
        rest, rest_blocked = F.col("labelled_node") - F.col("labelled"), F.col("blocked_node") - F.col("blocked")
        mine, theirs = (F.col("blocked") + 1) / (F.col("labelled") + 2), (rest_blocked + 1) / (rest + 2)
        enough = (F.col("labelled") >= least) & (rest >= least)
        near = F.abs(mine - theirs) <= z * F.sqrt(mine * (1 - mine) / (F.col("labelled") + 2) + theirs * (1 - theirs) / (rest + 2))
        alike = F.abs(F.col("plain") / F.col("n") - F.col("plain_node") / F.col("n_node")) <= shift
        is_rare = (F.col("children") > fan_out) & (F.col("n") < rare * F.col("n_node"))
        general = F.when(F.col("segment") == END, END).when(F.col("segment").startswith("<"), F.col("segment"))
        general = general.when((is_rare & ~(enough & ~near)) | (enough & near & alike), "*").otherwise(F.col("segment"))
        step = F.when(general == END, F.col("template")).otherwise(F.concat("template", F.lit("/"), general))
        steps = both.select("host", "template", "segment", step.alias("next"))
        moved = going.join(steps, ["host", "template", "segment"]).select("host", "shape", *sums, F.col("next").alias("template"))
        tree = moved.union(tree.where(F.size("shape") < level - 1))
    leaves = tree.groupBy("host", "template").agg(((F.sum("blocked") + weight * prior) / (F.sum("labelled") + weight)).alias("block_share"))
    judged = rows.join(tree.select("host", "shape", "template").join(leaves, ["host", "template"]), ["host", "shape"])
    decision = F.coalesce("given", F.when(F.col("block_share") > reject, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", decision.alias("verdict"), "template", "block_share")


def sql(rules: Sequence[tuple[str, str]], levels: int = 6, fan_out: int = 20, rare: float = 0.05, least: int = 5, z: float = 1.96, shift: float = 0.2, weight: float = 5.0, reject: float = 0.5) -> str:
    """``judge`` over the pages table in DuckDB's SQL, for paths of up to ``levels`` segments."""
    fits, verdicts = [], []
    for decision, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        test = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')"
        fits.append(f"WHEN {test} THEN '{text}'")
        verdicts.append(f"WHEN {test} THEN '{decision}'")
    stem, tail = (f"regexp_extract(s, '^(.*?)(\\.[A-Za-z]{{1,5}})?$', {k})" for k in (1, 2))
    shape = f"""CASE WHEN regexp_matches({stem}, '^[0-9]+$') THEN '<number>' WHEN regexp_matches({stem}, '^[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?$') THEN '<date>'
      WHEN regexp_matches({stem}, '^[0-9a-fA-F]{{8,}}$|^[0-9a-fA-F-]{{32,}}$') THEN '<hex>'
      WHEN regexp_matches({stem}, '([0-9].*){{4}}') OR length({stem}) > 40 THEN '<slug>' ELSE {stem} END || {tail}""".replace("\\\\", "\\")
    steps, last = [], "t0"
    for k in range(1, levels + 1):
        steps.append(f"""s{k} AS (SELECT *, coalesce(shape[{k}], '') AS segment, CASE WHEN starts_with(coalesce(shape[{k + 1}], ''), '<') THEN 0 ELSE n END AS plain FROM {last}),
c{k} AS (SELECT host, template, segment, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked, sum(plain) AS plain FROM s{k} GROUP BY 1, 2, 3),
n{k} AS (SELECT *, sum(n) OVER node AS n_node, sum(labelled) OVER node - labelled AS rest, sum(blocked) OVER node - blocked AS rest_blocked, sum(plain) OVER node AS plain_node, count(*) OVER node AS children
  FROM c{k} WINDOW node AS (PARTITION BY host, template)),
r{k} AS (SELECT *, (blocked + 1) / (labelled + 2) AS mine, (rest_blocked + 1) / (rest + 2) AS theirs, labelled >= {least} AND rest >= {least} AS enough FROM n{k}),
g{k} AS (SELECT *, abs(mine - theirs) <= {z} * sqrt(mine * (1 - mine) / (labelled + 2) + theirs * (1 - theirs) / (rest + 2)) AS near FROM r{k}),
b{k} AS (SELECT host, template, segment, CASE WHEN segment = '' THEN template WHEN starts_with(segment, '<') THEN template || '/' || segment
  WHEN (children > {fan_out} AND n < {rare} * n_node AND NOT (enough AND NOT near)) OR (enough AND near AND abs(plain / n - plain_node / n_node) <= {shift}) THEN template || '/*' ELSE template || '/' || segment END AS step FROM g{k}),
t{k} AS (SELECT s.host, shape, n, labelled, blocked, step AS template FROM s{k} s JOIN b{k} b ON s.host = b.host AND s.template = b.template AND s.segment = b.segment)""")
        last = f"t{k}"
    return f"""WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h FROM cut),
parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
ruled AS (SELECT *, CASE {' '.join(fits)} END AS rule, CASE {' '.join(verdicts)} END AS given, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda s: {shape}) AS shape FROM parts),
g AS (SELECT host, shape, count(*)::DOUBLE AS n, count(given)::DOUBLE AS labelled, count(*) FILTER (given = 'block')::DOUBLE AS blocked FROM ruled GROUP BY 1, 2),
t0 AS (SELECT *, '' AS template FROM g),
{", ".join(steps)},
leaves AS (SELECT host, template, (sum(blocked) + {weight} * ((SELECT sum(blocked) FROM g) + 1) / ((SELECT sum(labelled) FROM g) + 2)) / (sum(labelled) + {weight}) AS block_share FROM {last} GROUP BY 1, 2)
SELECT page_id, r.host, path, rule, coalesce(given, CASE WHEN block_share > {reject} THEN 'block' ELSE 'allow' END) AS verdict, l.template, block_share
FROM ruled r JOIN {last} t ON r.host = t.host AND r.shape = t.shape JOIN leaves l ON t.host = l.host AND t.template = l.template"""
