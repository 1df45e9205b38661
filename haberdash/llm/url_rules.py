"""URL filter: host and path rules first, then a tree of path templates per host.

The tree is grown from its roots over distinct host and path pairs, in DataFrame
operations only. Digits of segments become ``{n}``. At each node (host, template so far) a
node with many children that hardly repeat makes them one wildcard ``*``; and children
whose labelled share of blocked pages does not differ from the node's by more than ``Z``
standard errors are merged into ``~``. A child that stays as it is goes on, in the same
round, by all segments that its paths share: nodes with one child change nothing. Rounds
go on until no path has segments left, so they follow the branchings on one path, not its
length, and a path leaves with the round that ends it.
Labels are the verdicts of the rules. A template is rejected if its smoothed share of
blocked labels, drawn to the template's share on all hosts and that to the overall
share, is above one half.

Defined cases: NULL urls and those without ``://`` have empty host and path and share a
template; rows are kept one to one, repeated and NULL page ids included; extra columns
do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haberdash.llm.tables import stored, table

# A node is variable from this many children on, if pages are fewer than REPEATS times as many.
CHILDREN = 8
REPEATS = 2
Z = 1.96
# Rounds whose ended paths are read as one union before they are written as one table.
MAX_PARTS = 16
# Weight, in labelled pages, of the wider share.
PRIOR = 2.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path prefix, like ``example.org/es/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]

    def fits(self, host: Column, path: Column) -> Column:
        at_home = (host == self.host) | host.endswith("." + self.host)
        return at_home & path.startswith(self.path)


RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _first_fit(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """The value of the longest rule that fits, or NULL."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        found = F.when(rule.fits(host, path), F.lit(value(rule))).otherwise(found)
    return found


def _grow(rows: DataFrame) -> DataFrame:
    """Rows whose ``rest`` holds segments, with a template longer by one segment or more."""
    rows = rows.withColumn("child", F.col("rest")[0])
    # What lies between the least and the greatest rest shares their beginning.
    branches = rows.groupBy("host", "template", "child").agg(
        F.sum("pages").alias("pages"),
        F.sum("labelled").alias("labelled"),
        F.sum("blocked").alias("blocked"),
        F.min("rest").alias("least"),
        F.max("rest").alias("greatest"),
    )
    nodes = branches.groupBy("host", "template").agg(
        F.count("*").alias("kids"),
        F.sum("pages").alias("node_pages"),
        F.sum("labelled").alias("node_labelled"),
        F.sum("blocked").alias("node_blocked"),
    )
    share = F.col("blocked") / F.col("labelled")
    pool = F.col("node_blocked") / F.col("node_labelled")
    near = F.abs(share - pool) <= Z * F.sqrt(pool * (1 - pool) / F.col("labelled"))
    step = F.when((F.col("kids") >= CHILDREN) & (F.col("node_pages") < REPEATS * F.col("kids")), "*").when(
        (F.col("kids") > 1) & (F.col("labelled") > 0) & near, "~"
    )
    same = F.zip_with("least", "greatest", lambda a, b: a.eqNullSafe(b))
    differ = F.array_position(same, False)
    shared = F.when(differ > 0, differ - 1).otherwise(F.size("least")).cast("int")
    steps = branches.join(nodes, ["host", "template"]).select(
        "host",
        "template",
        "child",
        F.coalesce(step, F.array_join(F.slice("least", F.lit(1), shared), "/")).alias("step"),
        F.when(step.isNull(), shared).otherwise(1).alias("taken"),
    )
    return rows.join(steps, ["host", "template", "child"]).select(
        "host",
        "path",
        "pages",
        "labelled",
        "blocked",
        F.concat("template", F.lit("/"), "step").alias("template"),
        F.slice("rest", F.col("taken") + 1, F.size("rest")).alias("rest"),
    )


def templates(paths: DataFrame) -> DataFrame:
    """host, path, pages, labelled, blocked of distinct pairs, with the template of each."""
    segments = F.split(F.regexp_replace("path", "[0-9]+", "{n}"), "/")
    rest = F.slice(segments, F.lit(2), F.size(segments))
    # Each round reads its rows twice.
    growing = stored(paths.select("*", F.lit("").alias("template"), rest.alias("rest")), "url-paths")
    grown = None
    parts = 0
    while True:
        ended = growing.where(F.size("rest") == 0).drop("rest")
        grown = ended if grown is None else grown.unionByName(ended)
        parts += 1
        growing = growing.where(F.size("rest") > 0)
        if growing.isEmpty():
            return grown
        if parts == MAX_PARTS:
            grown, parts = stored(grown, "url-grown"), 1
        growing = stored(_grow(growing), "url-round")


def _smoothed(blocked: Column, labelled: Column, wider: Column) -> Column:
    return (blocked + PRIOR * wider) / (labelled + PRIOR)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, template, share of blocked labels and verdict of every page."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    host, path = F.col("host"), F.col("path")
    said = _first_fit(rules, host, path, lambda r: r.verdict)
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("pages"))
    paths = paths.select(
        "host",
        "path",
        "pages",
        F.when(said.isNotNull(), F.col("pages")).otherwise(0).alias("labelled"),
        F.when(said == "block", F.col("pages")).otherwise(0).alias("blocked"),
    )
    tree = templates(paths)
    sums = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    here = tree.groupBy("host", "template").agg(*sums)
    everywhere = here.groupBy("template").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    overall = here.agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b")).first()
    base = (overall["b"] or 0) / overall["n"] if overall["n"] else 0.0
    wider = _smoothed(F.col("all_blocked"), F.col("all_labelled"), F.lit(base))
    shares = here.join(everywhere, "template").select(
        "host", "template", _smoothed(F.col("blocked"), F.col("labelled"), wider).alias("blocked_share")
    )
    known = tree.select("host", "path", "template").join(shares, ["host", "template"])
    judged = rows.join(known, ["host", "path"])
    by_tree = F.when(F.col("blocked_share") > 0.5, "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        _first_fit(rules, host, path, lambda r: r.text).alias("rule"),
        F.coalesce(said, by_tree).alias("verdict"),
        "template",
        "blocked_share",
    )


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages")).drop("template", "blocked_share")


def _case(value) -> str:
    whens = "".join(
        f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'"
        for r in sorted(RULES, key=lambda r: -len(r.text))
    )
    return f"CASE{whens} END"


OP6_SQL = f"""
WITH RECURSIVE u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
),
v AS (SELECT *, {_case(lambda r: r.verdict)} AS said, {_case(lambda r: r.text)} AS rule FROM p),
r AS (
  SELECT host, path, string_split(path, '/')[2:] AS segments, count(*) AS pages,
    count(said) AS labelled, count(*) FILTER (said = 'block') AS blocked, '' AS template, 0 AS level
  FROM v GROUP BY host, path
  UNION ALL
  SELECT host, path, segments, pages, labelled, blocked, template || '/' || CASE
    WHEN kids >= {CHILDREN} AND np < {REPEATS} * kids THEN '*'
    WHEN kids > 1 AND cl > 0 AND abs(cb / cl - nb / nl) <= {Z}::DOUBLE * sqrt((nb / nl) * (1 - nb / nl) / cl) THEN '~'
    ELSE child END, level + 1
  FROM (
    SELECT *, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER node AS kids, sum(pages) OVER node AS np,
      sum(labelled) OVER node AS nl, sum(blocked) OVER node AS nb
    FROM (
      SELECT *, row_number() OVER (PARTITION BY host, template, child ORDER BY path) AS nth,
        sum(labelled) OVER (PARTITION BY host, template, child) AS cl,
        sum(blocked) OVER (PARTITION BY host, template, child) AS cb
      FROM (
        SELECT *, regexp_replace(segments[level + 1], '[0-9]+', '{{n}}', 'g') AS child FROM r
        WHERE level < len(segments)
      )
    )
    WINDOW node AS (PARTITION BY host, template)
  )
),
t AS (SELECT host, path, labelled, blocked, template FROM r WHERE level = len(segments)),
h AS (SELECT host, template, sum(labelled) AS l, sum(blocked) AS b FROM t GROUP BY ALL),
e AS (SELECT template, sum(l) AS al, sum(b) AS ab FROM h GROUP BY ALL),
o AS (SELECT coalesce(sum(b) / nullif(sum(l), 0), 0) AS base FROM h),
q AS (
  SELECT host, template, (b + {PRIOR}::DOUBLE * ((ab + {PRIOR}::DOUBLE * base) / (al + {PRIOR}::DOUBLE))) / (l + {PRIOR}::DOUBLE) AS share
  FROM h JOIN e USING (template), o
)
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN share > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM v JOIN t USING (host, path) JOIN q USING (host, template)
"""
