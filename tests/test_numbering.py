"""Splitting large groups must not change a single number."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from haberdash.operators.numbering import SLICE, dense_ranks, group_totals, numbered, sliced
from haberdash.sources.warehouse import Store


@pytest.fixture(scope="module")
def crowded(spark):
    """600 rows: a third under one key, another third under NULL, the rest spread."""
    random.seed(7)
    rows = []
    for n in range(600):
        key = 1 if n < 200 else None if n < 400 else 10 + n % 40
        rows.append((key, random.randrange(12), n, Decimal(random.randrange(-3000, 900000)) / 100))
    rows += [(1, 5, 1000 + n, Decimal("0.00")) for n in range(50)]
    return spark.createDataFrame(rows, "key INT, day INT, id INT, amount DECIMAL(12,2)").cache()


def _plain(frame):
    inside = Window.partitionBy("key").orderBy("day", "id")
    return frame.withColumns(
        {
            "position": F.row_number().over(inside).cast("bigint"),
            "before": F.lag("day").over(inside),
        }
    )


@pytest.fixture()
def keep(spark, tmp_path):
    return Store(spark, str(tmp_path)).table


def _in_slices(keep, rows, keys, order, slices):
    """Stored slices of a given number, whatever the session's setting."""
    cut = rows.repartitionByRange(slices, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    return keep(f"slices-{slices}", lambda: cut)


@pytest.mark.parametrize("slices", [1, 3, 20, 200])
def test_numbers_equal_plain_window(crowded, keep, slices):
    cut = _in_slices(keep, crowded, ["key"], ["day", "id"], slices)
    found = numbered(cut, ["key"], ["day", "id"], previous=("day", "before"))
    expected = _plain(crowded)
    assert sorted(found.columns) == sorted(expected.columns)
    assert found.select(expected.columns).exceptAll(expected).isEmpty()
    assert expected.exceptAll(found.select(expected.columns)).isEmpty()


def test_numbers_through_all_rows(crowded, keep):
    cut = _in_slices(keep, crowded, [], ["day", "id"], 30)
    found = numbered(cut, [], ["day", "id"]).orderBy("position").collect()
    assert [r.position for r in found] == list(range(1, 651))
    assert [(r.day, r.id) for r in found] == sorted((r.day, r.id) for r in found)


def test_a_large_group_is_cut_by_its_order(crowded, keep):
    cut = keep("cut", lambda: sliced(crowded.repartition(1), ["key"], ["day", "id"]))
    assert SLICE in cut.columns
    cut = _in_slices(keep, crowded, ["key"], ["day", "id"], 40)
    rows = cut.where("key = 1").groupBy(SLICE).agg(F.count("*").alias("n"), F.min("day"), F.max("day"))
    found = rows.orderBy(SLICE).collect()
    assert len(found) > 5 and max(r.n for r in found) < 100
    assert all(a["max(day)"] <= b["min(day)"] for a, b in zip(found, found[1:]))


def test_dense_ranks_and_totals_equal_plain_window(crowded, keep):
    inside = Window.partitionBy("key")
    expected = crowded.withColumns(
        {
            "place": F.dense_rank().over(inside.orderBy(F.desc("amount"))).cast("bigint"),
            "whole": F.sum("amount").over(inside),
        }
    )
    ranked = dense_ranks(crowded, "key", {"amount": "place"}, "places", keep)
    found = group_totals(ranked, "key", "amount", "whole").select(expected.columns)
    assert found.exceptAll(expected).isEmpty()
    assert expected.exceptAll(found).isEmpty()
