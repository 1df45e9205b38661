"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Documents of a source, in the order of a hash, are laid end to end and cut into blocks, of
one ``SLOTS``-th of all characters; a document belongs to the block in which it starts. The
schedule gives one slot to one block, over all blocks. A source of weight w, of all weights
1 in sum, gets a release time floor(j / w) and a deadline ceil((j + 1) / w) for its j-th
block, and in each slot the released block with the earliest deadline goes first: a source
is never a whole block ahead or behind its weight. When a source runs out, the others go
on from there by their weights among themselves, so every block has a slot and none stays
empty; ``on_target`` marks the slots up to the first such end, where all weights hold.

Weights are kept as whole numbers, in units of a 2 ** 36th of their sum, so that times
are exact.

Hot sources: running lengths are summed within hash buckets and over bucket totals, so no
window holds a whole source. The schedule is a table of ``SLOTS`` rows and one for each
source at most, made by one fold; nothing in it grows with the documents.

Defined cases: NULL and empty texts have length 0 and take part; documents with NULL
source are a source of their own; NULL and repeated ids are kept, in the order of id and
length; a source without positive weight is put behind all others (slot NULL), also one
without characters unless weights are given; an empty table gives no rows; extra columns
do not matter, and ``n_chars`` is not trusted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haberdash.llm.tables import stored, table

# Blocks that the whole text is cut into, but for each source's last one.
SLOTS = 500
# The sum of all weights, as whole numbers.
UNITS = 1 << 36
# Hash buckets of a source: hexadecimal digits of a digest.
BUCKET_DIGITS = 3
# Target weights, unless given: the size of a source to this power.
TEMPERATURE = 0.5


def _places(docs: DataFrame) -> DataFrame:
    """doc_id, source, chars and start: the characters before it in its source."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        "doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), order.alias("place")
    )
    rows = rows.withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    totals = rows.groupBy("source", "bucket").agg(F.sum("chars").alias("bucket_chars"))
    # One row per bucket: at most 16 ** BUCKET_DIGITS per source.
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("source").alias("of"),
        F.col("bucket").alias("in"),
        F.coalesce(F.sum("bucket_chars").over(before), F.lit(0)).alias("base"),
    )
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("place", "doc_id", "chars")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("offset", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    return rows.select("doc_id", "source", "chars", (F.col("base") + F.col("offset")).alias("start"))


def units(weights: DataFrame) -> DataFrame:
    """(source, units): positive weights as whole numbers, ``UNITS`` in sum but for rounding."""
    known = weights.where("weight > 0")
    # One row per source.
    part = F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))
    return known.select("source", F.greatest(F.lit(1), F.round(part * F.lit(UNITS))).cast("long").alias("units"))


def schedule(sources: DataFrame) -> DataFrame:
    """(source, block, slot, release, deadline, on_target) of every block of ``sources`` (source, units, blocks).

    Release and deadline are those since the last source ran out.
    """
    state = sources.where("blocks > 0").agg(
        F.array_sort(F.collect_list(F.struct("source", "units", "blocks"))).alias("tasks"),
        F.coalesce(F.sum("blocks"), F.lit(0)).alias("n"),
    )
    # The fold walks over the slots; start: the slot at which the last source ran out, total: the units still there.
    task = "struct<units:bigint,left:bigint,done:bigint>"
    pick = "struct<task:int,release:bigint,deadline:bigint,on_target:boolean>"
    order = F.expr(
        f"""
        aggregate(
          sequence(0L, n - 1),
          struct(
            cast(transform(tasks, x -> struct(x.units, x.blocks, 0L)) as array<{task}>) as tasks,
            0L as start, aggregate(tasks, 0L, (a, x) -> a + x.units) as total,
            cast(array() as array<{pick}>) as picks),
          (s, t) -> element_at(transform(
            array(array_min(filter(
              transform(s.tasks, (x, i) -> struct(
                (s.start + ((x.done + 1) * s.total + x.units - 1) div x.units) as deadline, i as i,
                (s.start + (x.done * s.total) div x.units) as release, x.left as left, x.units as units)),
              x -> x.left > 0 and x.release <= t))),
            p -> struct(
              transform(s.tasks, (x, i) -> struct(
                x.units as units, x.left - if(i = p.i, 1L, 0L) as left,
                if(p.left = 1, 0L, x.done + if(i = p.i, 1L, 0L)) as done)) as tasks,
              if(p.left = 1, t + 1, s.start) as start,
              s.total - if(p.left = 1, p.units, 0L) as total,
              concat(s.picks, array(struct(
                p.i as task, p.release as release, p.deadline as deadline, s.start = 0L as on_target))) as picks)), 1),
          s -> s.picks)
        """
    )
    picks = state.where("n > 0").select("tasks", F.posexplode(order).alias("slot", "pick"))
    picks = picks.select(
        F.col("tasks")[F.col("pick.task")]["source"].alias("source"),
        F.col("slot").cast("long").alias("slot"),
        "pick.release",
        "pick.deadline",
        "pick.on_target",
    )
    turn = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return picks.withColumn("block", turn.cast("long"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    slots: int = SLOTS,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """Per document: block, slot, release and deadline of its block, and its place in the slot.

    ``weights`` by source; by default the characters of a source to the power ``temperature``.
    """
    spark = docs.sparkSession
    places = stored(_places(docs), "mix-places")
    extent = places.groupBy("source").agg(F.sum("chars").alias("chars"), F.max("start").alias("last"))
    if weights is None:
        wanted = extent.select("source", F.pow(F.col("chars").cast("double"), F.lit(temperature)).alias("weight"))
    else:
        rows = [(k, float(v)) for k, v in weights.items()]
        wanted = spark.createDataFrame(rows, "source string, weight double")
    # One number.
    total = extent.agg(F.sum("chars").alias("chars")).first()["chars"] or 0
    size = max(1, -(-total // slots))
    wanted = units(wanted).withColumnRenamed("source", "own")
    blocks = extent.select("source", F.expr(f"last div {size}L + 1").alias("blocks"))
    sources = blocks.join(wanted, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    plan = stored(schedule(sources), "mix-schedule").withColumnRenamed("source", "of")
    plan = plan.withColumnRenamed("block", "turn")
    placed = places.withColumn("block", F.expr(f"start div {size}L"))
    # A row for each slot: ``slots`` and the number of sources at most.
    placed = placed.join(
        F.broadcast(plan), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("turn")), "left"
    )
    return placed.select(
        "doc_id",
        "source",
        "chars",
        "block",
        "slot",
        "release",
        "deadline",
        F.expr(f"start % {size}L").alias("place"),
        F.coalesce("on_target", F.lit(False)).alias("on_target"),
    )


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


OP3_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, CAST(coalesce(length(text), 0) AS BIGINT) AS chars,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
places_ AS (
  SELECT doc_id, source, chars, CAST(coalesce(sum(chars) OVER (PARTITION BY source ORDER BY h, doc_id, chars
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM rows_
),
size_ AS (SELECT greatest(1, CAST(ceil(sum(chars) / {SLOTS}) AS BIGINT)) AS size FROM rows_),
extent_ AS (
  SELECT source, CAST(sum(chars) AS BIGINT) AS chars, max(start) // any_value(size) + 1 AS blocks
  FROM places_, size_ GROUP BY source
),
weight_ AS (SELECT *, pow(CAST(chars AS DOUBLE), {TEMPERATURE}::DOUBLE) AS w FROM extent_ WHERE chars > 0),
task_ AS (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST) AS i, source, CAST(blocks AS BIGINT) AS blocks,
    greatest(1, CAST(round(w / sum(w) OVER () * {UNITS}) AS BIGINT)) AS units FROM weight_
),
walk_ AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS start, i, units, blocks AS rest, CAST(0 AS BIGINT) AS done,
    false AS picked, CAST(NULL AS BIGINT) AS release, CAST(NULL AS BIGINT) AS deadline, true AS on_target FROM task_
  UNION ALL
  SELECT t, CASE WHEN ended THEN t + 1 ELSE start END, i, units, rest - CASE WHEN p THEN 1 ELSE 0 END,
    CASE WHEN ended THEN 0 WHEN p THEN done + 1 ELSE done END, p, r, d, start = 0
  FROM (
    SELECT *, bool_or(p AND rest = 1) OVER () AS ended
    FROM (
      SELECT *, row_number() OVER (ORDER BY CASE WHEN rest > 0 AND r <= t THEN 0 ELSE 1 END, d, i) = 1 AS p
      FROM (
        SELECT *, start + (done * total) // units AS r, start + ((done + 1) * total + units - 1) // units AS d
        FROM (
          SELECT slot + 1 AS t, start, i, units, rest, done,
            CAST(sum(CASE WHEN rest > 0 THEN units ELSE 0 END) OVER () AS BIGINT) AS total,
            max(rest) OVER () AS most
          FROM walk_
        ) WHERE most > 0
      )
    )
  )
),
turn_ AS (
  SELECT t.source, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS turn, slot, release, deadline, on_target
  FROM walk_ JOIN task_ AS t USING (i) WHERE picked
)
SELECT doc_id, p.source, chars, CAST(start // size AS BIGINT) AS block, slot, release, deadline,
  CAST(start - (start // size) * size AS BIGINT) AS place, coalesce(on_target, false) AS on_target
FROM places_ AS p CROSS JOIN size_
LEFT JOIN turn_ AS t ON p.source IS NOT DISTINCT FROM t.source AND p.start // size = t.turn
"""
