"""Joins in which a few keys hold a large part of the rows.

Keys that hold more than ``SHARE`` of all rows are found by a sketch of bounded size, so
there are at most ``1 / SHARE`` of them. Their rows are dealt over so many pieces that
none holds more than that share, and the other side's rows of these keys, and of no
other, are repeated for each piece.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haberdash.operators.sizes import sized

SHARE = 1 / 2000
# Fewer rows of a key than this never matter.
LEAST_ROWS = 1000
# Keys the sketch holds at once: a key that it drops has far less than ``SHARE``.
TRACKED = 100_000

PIECE = "_piece"


def heavy_keys(rows: DataFrame, *keys: str) -> dict[str, tuple[list, int]]:
    """Per key column its heavy values, and the pieces that each of them needs."""
    sketches = [F.expr(f"approx_top_k({key}, {round(1 / SHARE)}, {TRACKED})").alias(key) for key in keys]
    found = rows.agg(F.count("*").alias("_rows"), *sketches).first()
    limit = max(found["_rows"] * SHARE, LEAST_ROWS)
    heavy = {}
    for key in keys:
        counts = {t["item"]: t["count"] for t in found[key] or () if t["item"] is not None and t["count"] > limit}
        heavy[key] = (sorted(counts), math.ceil(max(counts.values(), default=0) / limit))
    return heavy


def salted_join(rows: DataFrame, parents: DataFrame, key: str, heavy: tuple[list, int], spread: str) -> DataFrame:
    """``rows`` joined with ``parents`` by ``key``; ``spread`` deals the rows of heavy keys over their pieces.

    Without heavy keys it is the plain join.
    """
    moved = sized(rows)
    # Parents may have to be derived to be counted: only if few rows ask for them.
    parents = sized(parents) if moved is rows else parents
    rows = moved
    values, pieces = heavy
    if not values:
        return rows.join(parents, key)
    is_heavy = F.col(key).isin(values)

    def piece(of_heavy: Column) -> Column:
        return F.when(is_heavy, of_heavy).otherwise(F.lit(0).cast("bigint"))

    dealt = rows.withColumn(PIECE, piece(F.pmod(F.xxhash64(spread), F.lit(pieces))))
    each = F.sequence(F.lit(0).cast("bigint"), F.lit(pieces - 1).cast("bigint"))
    none = F.array(F.lit(0).cast("bigint"))
    repeated = parents.withColumn(PIECE, F.explode(F.when(is_heavy, each).otherwise(none)))
    return dealt.join(repeated, [key, PIECE]).drop(PIECE)
