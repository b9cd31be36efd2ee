"""File sources and sinks: partitioned CSV trees, JSON lines manifests, text blobs, routed and replaced writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of an all-text table.
ALL_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in ("Document ID", "Agency ID", "Docket ID", "Document Type", "Posted Date", "Title", "canonical_text")])
#: Files that a recursive discovery leaves out.
SKIPPED = r"(downloaded_content/|_all_text\.csv(\.gz)?$|_[0-9]+\.csv$)"


def read_csv_tree(spark: SparkSession, base: str, stem: str, schema: T.StructType = ALL_TEXT, years: Sequence[int] = ()) -> DataFrame:
    """``base/*/*/<stem>.csv[.gz]`` with one schema; of a plain and a gzipped file of one stem the gzipped one counts.

    Adds ``agency`` and ``period`` from the path. With ``years`` only paths that name one of them stay; the filter is on
    the path alone, so files that it drops are not parsed beyond their listing.
    """
    found = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", f"{stem}.csv*").csv(base)
    path = F.regexp_replace(F.input_file_name(), r"\.gz$", "")
    rows = found.withColumn("__file", F.input_file_name()).withColumn("__stem", path)
    best = rows.groupBy("__stem").agg(F.max(F.col("__file").endswith(".gz")).alias("__gz"))
    kept = rows.join(F.broadcast(best), "__stem").where(F.col("__file").endswith(".gz") == F.col("__gz"))  # one row a file
    if years:
        kept = kept.where(F.col("__stem").rlike("|".join(str(y) for y in years)))
    part = lambda k: F.element_at(F.split("__stem", "/"), k)
    return kept.withColumn("agency", part(-3)).withColumn("period", part(-2)).drop("__file", "__stem", "__gz")


def discover_csv(spark: SparkSession, base: str) -> DataFrame:
    """The paths of a tree's CSV files without downloads, outputs and numbered duplicates."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(base).select("path")
    return paths.where(~F.col("path").rlike(SKIPPED))


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object a line; lines that are none are left out, with their number of columns null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def manifest_dedup(manifest: DataFrame, order: str) -> DataFrame:
    """The first line of each (kind or "response", doc_id)."""
    kind = F.coalesce("kind", F.lit("response"))
    w = Window.partitionBy(kind, "doc_id").orderBy(order)
    return manifest.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def hydrate(docs: DataFrame, blobs: DataFrame, path_col: str, missing: str = "[missing text]") -> DataFrame:
    """Texts by their path; where a blob is missing, a sentinel."""
    return docs.join(blobs.select(F.col("path").alias(path_col), "content"), path_col, "left").withColumn("text", F.coalesce(F.decode("content", "UTF-8"), F.lit(missing))).drop("content")


def read_blobs(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "content")


def route(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Rows into folders by derived keys; each task writes the folders of its own keys only."""
    df.repartition(*keys).write.partitionBy(*keys).mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions that ``df`` holds and keep the others."""
    df.write.partitionBy(key).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def rule_sink(df: DataFrame, path: str, most: int | None = None) -> None:
    """CSV with nested columns as JSON, lists joined by semicolons, booleans as TRUE and FALSE. Nothing is cut unless ``most``
    says at how many characters nested columns are (the reference's spreadsheets take 500,000)."""

    def shown(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(c.cast("array<string>"), "; ")
        if isinstance(field.dataType, (T.StructType, T.MapType)):
            return F.to_json(c) if most is None else F.left(F.to_json(c), F.lit(most))
        if isinstance(field.dataType, T.BooleanType):
            return F.upper(c.cast("string"))
        return c.cast("string")

    df.select(*(shown(f).alias(f.name) for f in df.schema.fields)).write.mode("overwrite").option("header", True).csv(path)


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str, params: Sequence = (), parts: int = 1, key: str = "rowid") -> DataFrame:
    """The rows of a query on a SQLite file, ``parts`` tasks each taking the rows whose integer ``key`` leaves its remainder.

    The file must be readable at ``path`` on every executor. ``sql`` has ``?`` for each of ``params`` and, where there is
    more than one part, selects ``key``.
    """
    import sqlite3

    import pyarrow as pa
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    columns = T._parse_datatype_string(schema).names

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(k) for k in range(parts)]

        def read(self, partition):
            text = sql if parts == 1 else f"SELECT * FROM ({sql}) WHERE {key} % {parts} = {partition.value}"
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as connection:
                cursor = connection.execute(text, list(params))
                while rows := cursor.fetchmany(4096):
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=columns)

    class Sqlite(DataSource):
        @classmethod
        def name(cls):
            return "corvella_sqlite"

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Sqlite)
    return spark.read.format("corvella_sqlite").load()
