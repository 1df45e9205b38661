"""Run queries over a CSV export and write each result as Parquet.

    python -m haberdash --csv <folder> --out <folder> [query ...]

The folder holds ``<relation>.csv`` for the seven relations. Without names every
query runs.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from haberdash.registry import QUERIES
from haberdash.sources.warehouse import Warehouse


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="haberdash")
    parser.add_argument("--csv", required=True, help="folder with the seven CSV exports")
    parser.add_argument("--out", required=True, help="folder for the results")
    parser.add_argument("--store", help="folder for the stored layers")
    parser.add_argument(
        "--set-aside", action="store_true", help="write rows that do not fit to <out>/rejected_rows instead of stopping"
    )
    day = dt.date.fromisoformat
    parser.add_argument("--sales-cutoff", type=day, default=dt.date(2024, 1, 1))
    parser.add_argument("--event-cutoff", type=day, default=dt.date(2024, 1, 1))
    parser.add_argument("queries", nargs="*", metavar="query")
    chosen = parser.parse_args(arguments)
    unknown = sorted(set(chosen.queries) - set(QUERIES))
    if unknown:
        parser.error(f"unknown queries: {', '.join(unknown)}")

    spark = SparkSession.builder.appName("haberdash").getOrCreate()
    warehouse = Warehouse.from_csv(
        spark, chosen.csv, chosen.sales_cutoff, chosen.event_cutoff, root=chosen.store, set_aside=chosen.set_aside
    )
    if chosen.set_aside:
        warehouse.rejected().write.mode("overwrite").parquet(f"{chosen.out}/rejected_rows")
    warehouse.build_model()
    for name in chosen.queries or QUERIES:
        QUERIES[name](warehouse).write.mode("overwrite").parquet(f"{chosen.out}/{name}")


if __name__ == "__main__":
    main()
