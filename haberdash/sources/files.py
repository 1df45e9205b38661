"""CSV and Parquet sources and sinks for the raw relations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haberdash.sources.schemas import SOURCE_SCHEMAS

# A quote inside a quoted field is doubled, so JSON-like text survives, and
# blanks around a field are data: cleaning them is the next layer's work.
_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
# Holds the text of a row that does not fit, while rows are parsed.
_LINE = "__line"
_WRITTEN_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# Also the forms in which databases export UTC times.
_READ_TIME = "yyyy-MM-dd['T'][' ']HH:mm:ss[.SSSSSS][' UTC']['+00:00']"


def _typed_rows(
    spark: SparkSession, relation: str, path: str, line: str | None = None
) -> tuple[DataFrame, dict[str, str], list[str]]:
    """Rows by header name, the declared types and the header.

    A row that does not fit its types is an error or, with ``line``, kept with its text in
    the column of that name.
    """
    kinds = dict(field.split() for field in SOURCE_SCHEMAS[relation].split(","))
    header = spark.read.options(**_CSV).csv(path).columns or list(kinds)
    missing = sorted(set(kinds) - set(header))
    if missing:
        raise ValueError(f"{path}: the header does not conform, without {', '.join(missing)}")
    if line in header:
        raise ValueError(f"{path}: the header names the column {line}")
    options = {**_CSV, "timestampNTZFormat": _READ_TIME, "enforceSchema": False, "mode": "FAILFAST"}
    fields = [f"`{name}` {kinds.get(name, 'STRING')}" for name in header]
    if line:
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": line, "columnPruning": False}
        fields.append(f"`{line}` STRING")
    rows = spark.read.schema(", ".join(fields)).options(**options).csv(path)
    if line:
        # True of every row: only columns that a query reads are parsed, and all must be.
        rows = rows.where(F.xxhash64(*kinds) >= -(2**63))
    return rows, kinds, header


def read_csv(spark: SparkSession, relation: str, path: str, set_aside: bool = False) -> DataFrame:
    """One relation from CSV, columns by header name; extra ones are left out.

    A missing column is an error. So is a row with another number of fields than the
    header or a value that does not fit its type, unless such rows are ``set_aside``: then
    they are left out here, and :func:`rejected_rows` has them.
    """
    rows, kinds, _ = _typed_rows(spark, relation, path, _LINE if set_aside else None)
    if set_aside:
        rows = rows.where(F.col(_LINE).isNull())
    return rows.select(*kinds)


def rejected_rows(spark: SparkSession, relation: str, path: str) -> DataFrame:
    """What :func:`read_csv` sets aside: relation, file, line, and the columns whose text does not fit.

    ``columns`` is empty where only the number of fields is wrong.
    """
    rows, kinds, header = _typed_rows(spark, relation, path, _LINE)
    options = {key: str(value) for key, value in _CSV.items() if key not in ("header", "encoding")}
    fields = ", ".join(f"f{n} STRING" for n in range(len(header)))
    texts = F.from_csv(_LINE, fields, options)
    unfit = [
        F.when(F.col(f"`{name}`").isNull() & texts[f"f{n}"].isNotNull(), F.lit(name))
        for n, name in enumerate(header)
        if name in kinds
    ]
    return rows.where(F.col(_LINE).isNotNull()).select(
        F.lit(relation).alias("relation"),
        F.col("_metadata.file_path").alias("file"),
        F.col(_LINE).alias("line"),
        F.array_compact(F.array(*unfit)).alias("columns"),
    )


def write_csv(frame: DataFrame, path: str) -> None:
    """Write a relation in the format :func:`read_csv` reads back unchanged, each file packed."""
    options = {**_CSV, "timestampNTZFormat": _WRITTEN_TIME, "compression": "gzip"}
    frame.write.mode("overwrite").options(**options).csv(path)


def read_parquet(spark: SparkSession, relation: str, path: str) -> DataFrame:
    """One relation from Parquet with the declared schema."""
    return spark.read.schema(SOURCE_SCHEMAS[relation]).parquet(path)


def fingerprints(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, str]:
    """Per name, what changes when any file under its path does; lists files without reading them."""
    context = spark.sparkContext
    conf, path = context._jsc.hadoopConfiguration(), context._jvm.org.apache.hadoop.fs.Path
    owner = F.lit(None).cast("string")
    for name, place in paths.items():
        whole = path(place).getFileSystem(conf).makeQualified(path(place)).toString()
        own = (F.col("path") == whole) | F.col("path").startswith(f"{whole}/")
        owner = F.when(own, name).otherwise(owner)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths.values()))
    state = F.xxhash64("path", "length", "modificationTime")
    rows = files.groupBy(owner.alias("name")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.bit_xor(state).alias("state")
    )
    return {r.name: f"{r.files}-{r.bytes}-{r.state & 0xFFFFFFFFFFFFFFFF:016x}" for r in rows.collect()}
