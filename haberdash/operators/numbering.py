"""Row numbers and dense ranks inside groups of any size, by one plan.

A plain window sends each group to one task. Here rows are cut into slices of their
sort order, by range partitioning on keys and order, so a large group spreads over as
many slices as it needs. The slices are stored; rows are numbered inside their group and
slice, and the rows of the group's earlier slices are added. Only groups that reach over
a border have any, so the added table has at most one row per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haberdash.operators.sizes import sized

SLICE = "_slice"

# Gives the stored table of a name, building it on first use.
Keep = Callable[[str, Callable[[], DataFrame]], DataFrame]


def same(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str = "") -> Column:
    """Join condition that treats NULL keys as equal."""
    return reduce(
        lambda a, b: a & b, (left[n].eqNullSafe(right[f"{prefix}{n}"]) for n in names)
    )


def sliced(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with the slice of the order (keys, order) that holds them; to be stored.

    ``order`` must tell the rows of a key apart, or equal rows share a slice.
    """
    return rows.repartitionByRange(*keys, *order).withColumn(SLICE, F.spark_partition_id())


def numbered(
    slices: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    position: str = "position",
    previous: tuple[str, str] | None = None,
) -> DataFrame:
    """Add ``position``: 1, 2, ... inside each key group, by ascending ``order``.

    ``slices`` is a stored result of ``sliced`` for the same keys and order. ``previous``
    names the leading order column and the output for its value one row earlier.
    """
    inner = [*keys, SLICE]
    window = Window.partitionBy(*inner).orderBy(*order)
    added = {position: F.row_number().over(window).cast("bigint")}
    if previous:
        added[previous[1]] = F.lag(previous[0]).over(window)
    inside = slices.withColumns(added)
    # One row per group and slice, none of which is large.
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slices.groupBy(*inner)
        .agg(F.count("*").alias("_rows"), F.max(order[0]).alias("_end"))
        .select(
            *(F.col(n).alias(f"_at_{n}") for n in inner),
            F.sum("_rows").over(earlier).alias("_before"),
            F.max("_end").over(earlier).alias("_last"),
        )
        .where("_before > 0")
    )
    placed = inside.join(starts, same(inside, starts, inner, "_at_"), "left").withColumn(
        position, F.col(position) + F.coalesce("_before", F.lit(0))
    )
    if previous:
        placed = placed.withColumn(previous[1], F.coalesce(previous[1], "_last"))
    return placed.drop("_before", "_last", SLICE, *(f"_at_{n}" for n in inner))


def totals_before(slices: DataFrame, order: Sequence[str], amount: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows before, by ascending ``order``.

    ``slices`` is a stored result of ``sliced`` without keys, for the same order.
    """
    above = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = slices.withColumn(name, F.coalesce(F.sum(amount).over(above), F.lit(0)))
    # One row per slice.
    earlier = Window.partitionBy().orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slices.groupBy(SLICE)
        .agg(F.sum(amount).alias("_sum"))
        .select(F.col(SLICE).alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        inside.join(starts, F.col(SLICE) == F.col("_at"))
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop(SLICE, "_at", "_before")
    )


def dense_ranks(
    rows: DataFrame, key: str, measures: dict[str, str], name: str, keep: Keep
) -> DataFrame:
    """Add a dense rank, highest first, for each amount column in ``measures``.

    Only the distinct amounts are numbered, since equal ones share a rank; those of all
    measures are stacked, sliced and numbered once, stored as ``name``, and joined back.
    """
    amounts = F.array(
        *(F.struct(F.lit(m).alias("_measure"), (-F.col(m)).alias("_falling")) for m in measures)
    )
    inner, order = ["_measure", key], ["_falling"]

    def places() -> DataFrame:
        distinct = rows.select(key, F.inline(amounts)).distinct()
        return numbered(keep(f"{name}_slices", lambda: sliced(distinct, inner, order)), inner, order)

    ranked = keep(name, places).withColumnRenamed(key, f"_of_{key}")
    for measure, rank in measures.items():
        own = sized(ranked.where(F.col("_measure") == measure).withColumnRenamed("position", rank))
        rows = rows.join(
            own,
            rows[key].eqNullSafe(own[f"_of_{key}"]) & (-rows[measure]).eqNullSafe(own["_falling"]),
        ).drop("_measure", f"_of_{key}", "_falling")
    return rows


def group_totals(rows: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """Add the group's sum of ``amount``, from an aggregate joined back."""
    totals = rows.groupBy(key).agg(F.sum(amount).alias(name))
    totals = totals.withColumnRenamed(key, f"_of_{key}")
    return rows.join(totals, same(rows, totals, [key], "_of_")).drop(f"_of_{key}")
