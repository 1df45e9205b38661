"""Key checks: uniqueness, missing keys and broken references."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haberdash.operators.sizes import sized


def stacked(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns."""
    return reduce(DataFrame.unionByName, frames)


def key_counts(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, key, rows) of all key values of all tables: one scan each, one exchange in all.

    Keys of different types meet as text. Tables go by number until they are counted:
    names would make up half of the rows that move and wait in memory.
    """
    kinds = {frame.schema[key].dataType for frame, key in tables.values()}
    kind = kinds.pop() if len(kinds) == 1 else "string"
    every = stacked(
        frame.select(F.lit(place).alias("_table"), F.col(key).cast(kind).alias("key"))
        for place, (frame, key) in enumerate(tables.values())
    )
    names = F.array(*map(F.lit, tables))
    return (
        every.groupBy("_table", "key")
        .agg(F.count("*").alias("rows"))
        .select(names[F.col("_table")].alias("table_name"), "key", "rows")
    )


def _per_table(tables: Mapping[str, tuple[DataFrame, str]], **measures: Column) -> DataFrame:
    """A row for each table, also for those without rows, which count 0."""
    found = key_counts(tables).groupBy("table_name").agg(*(m.alias(n) for n, m in measures.items()))
    # Names alone, a row for each declared table.
    names = next(iter(tables.values()))[0].sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, tables))).alias("table_name")
    )
    zeros = names.select("table_name", *(F.lit(0).cast("bigint").alias(n) for n in measures))
    return found.unionByName(zeros).groupBy("table_name").agg(*(F.sum(n).alias(n) for n in measures))


def duplicate_keys(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per table, how many key values, NULL included, occur more than once."""
    return _per_table(tables, duplicate_keys=F.count(F.when(F.col("rows") > 1, 1)))


def key_violations(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per table, the rows with a NULL key and the values used twice or more."""
    key, rows = F.col("key"), F.col("rows")
    return _per_table(
        tables,
        null_keys=F.coalesce(F.sum(F.when(key.isNull(), rows)), F.lit(0)),
        duplicate_keys=F.count(F.when(key.isNotNull() & (rows > 1), 1)),
    )


def assert_keys(tables: Mapping[str, tuple[DataFrame, str]]) -> None:
    """Raise ``ValueError`` naming each table whose key is missing or repeated."""
    broken = (
        key_violations(tables).where("null_keys > 0 OR duplicate_keys > 0").orderBy("table_name")
    )
    # One row per declared table at most.
    found = [
        f"{r.table_name}: {r.null_keys} NULL, {r.duplicate_keys} repeated" for r in broken.toLocalIterator()
    ]
    if found:
        raise ValueError("primary key violated in " + "; ".join(found))


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``column`` of ``child`` holds keys (``key``) of ``parent``."""

    label: str
    child: str
    column: str
    parent: str
    key: str


def _orphan_counts(references: Sequence[Reference]) -> list[Column]:
    """Per reference, its rows in the key census that nothing holds."""
    slots = _slots(references)
    gone = F.col("held") == 0
    return [
        F.coalesce(F.sum(F.when(gone & (F.col("parent") == r.parent), F.col(f"rows_{slots[r]}"))), F.lit(0))
        for r in references
    ]


def _slots(references: Sequence[Reference]) -> dict[Reference, int]:
    """Number the references to one parent: each needs a counter beside that parent's keys."""
    return {r: sum(o.parent == r.parent for o in references[:n]) for n, r in enumerate(references)}


def key_census(source: Callable[[str], DataFrame], references: Sequence[Reference]) -> DataFrame:
    """(parent, key, held, rows_0, rows_1, …): who holds and who refers to each key of each parent.

    Each relation is read once: a row gives its own key, if it is a parent, and all its
    references, as (parent, key) pairs. Those are counted in the map task, so a popular,
    missing or NULL reference moves one row per task, and meet in one exchange.
    """
    slots = _slots(references)
    counters = [f"rows_{n}" for n in range(max(slots.values()) + 1)]

    def pair(parent: str, key: str, held: int, slot: int | None) -> Column:
        marks = [F.lit(int(n == slot)).cast("bigint").alias(c) for n, c in enumerate(counters)]
        return F.struct(F.lit(parent).alias("parent"), F.col(key).alias("key"), F.lit(held).alias("held"), *marks)

    parents = {r.parent: r.key for r in references}
    parts = []
    for name in sorted({r.child for r in references} | set(parents)):
        pairs = [pair(r.parent, r.column, 0, slots[r]) for r in references if r.child == name]
        if name in parents:
            pairs.append(pair(name, parents[name], 1, None))
        parts.append(source(name).select(F.inline(F.array(*pairs))))
    # A NULL key holds nothing: NULL references are orphans.
    held = F.max(F.when(F.col("key").isNotNull(), F.col("held")).otherwise(0))
    return stacked(parts).groupBy("parent", "key").agg(held.alias("held"), *(F.sum(c).alias(c) for c in counters))


def orphans(source: Callable[[str], DataFrame], references: Sequence[Reference], label: str) -> DataFrame:
    """Per reference, under ``label``: child rows whose reference is NULL or has no parent."""
    totals = key_census(source, references).agg(
        *(total.alias(f"_{n}") for n, total in enumerate(_orphan_counts(references)))
    )
    rows = F.array(
        *(
            F.struct(F.lit(r.label).alias(label), F.col(f"_{n}").alias("affected_rows"))
            for n, r in enumerate(references)
        )
    )
    return totals.select(F.inline(rows))


def mismatches(
    child: DataFrame,
    reference: str,
    detail,
    parent: DataFrame,
    key: str,
    expected,
    alias: str,
    repeated: bool = False,
) -> DataFrame:
    """One row: child rows whose ``detail`` differs from their parent's ``expected``.

    With ``repeated``, for references that many rows share with equal details, rows are
    counted before they move; else they move once, to the join, which splits a hot parent.
    """
    counts = child.select(F.col(reference).alias("_ref"), detail.alias("_detail"))
    if repeated:
        counts = counts.groupBy("_ref", "_detail").agg(F.count("*").alias("_rows"))
    else:
        counts = counts.withColumn("_rows", F.lit(1).cast("bigint"))
    parents = parent.select(F.col(key).alias("_ref"), expected.alias("_expected"))
    return (
        counts.join(sized(parents), "_ref")
        .where(F.col("_detail") != F.col("_expected"))
        .agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias(alias))
    )
