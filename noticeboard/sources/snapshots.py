"""Snapshots of sources, their history and the change batches between them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeboard import constants as C
from noticeboard.operators.common import ranked

RAW_CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("website", "title", "link", "heading_link", "content", "main_title", "year_month")]
)
POSITION = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("position", T.IntegerType())])
REJECT = T.StructType([*POSITION.fields, *[T.StructField(n, T.StringType()) for n in ("reason", "text")]])
#: Characters of one file of :func:`write_snapshot_json`, which readers hold as a whole several times over.
ARRAY_CHARS = 4 << 20
REQUIRED = ["link", "year_month", "title", "content"]


def read_arrays(spark: SparkSession, path: str, schema: T.StructType = RAW_CHUNK) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files that each hold one JSON array of objects, or one object.

    Rows have the fields of ``schema``, ``extra`` (a variant with all other fields, null if there
    are none), ``source_file`` and ``position`` in the file. Rejects name the file, the position (null for a
    whole file), a reason and the text: files that are no JSON, and elements that are no objects. A
    missing path and an empty array give no rows; files of zero bytes are not seen by Spark at all.
    """
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        none = T.StructType([*schema.fields, T.StructField("extra", T.VariantType()), *POSITION.fields])
        return spark.createDataFrame([], none), spark.createDataFrame([], REJECT)
    parsed = files.select("value", F.col("_metadata.file_name").alias("source_file"), F.from_json("value", "array<variant>").alias("elements"))
    # Only a file that is no array keeps its text: no element may carry the text of its whole file along.
    parsed = parsed.select("source_file", "elements", F.when(F.col("elements").isNull(), F.col("value")).alias("value"))
    elements = F.coalesce("elements", F.array(F.try_parse_json("value")))
    found = parsed.select("value", "source_file", F.posexplode(elements).alias("position", "item"))
    found = found.withColumn("fields", F.from_json(F.to_json("item"), "map<string,variant>"))
    is_object = F.col("fields").isNotNull()
    named = {f.name: f.dataType.simpleString() for f in schema.fields}
    others = F.map_filter("fields", lambda k, v: ~k.isin(*named))
    rows = found.filter(is_object).select(
        *[F.try_variant_get("item", f"$['{name}']", kind).alias(name) for name, kind in named.items()],
        F.when(F.size(others) > 0, F.try_parse_json(F.to_json(others))).alias("extra"),
        "source_file",
        "position",
    )
    whole = F.col("item").isNull()
    rejects = found.filter(~is_object).select(
        "source_file",
        F.when(~whole, F.col("position")).alias("position"),
        F.when(whole, "file is no JSON").otherwise("element is no object").alias("reason"),
        F.when(whole, F.col("value")).otherwise(F.to_json("item")).alias("text"),
    )
    return rows, rejects


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType = RAW_CHUNK) -> DataFrame:
    """The rows of :func:`read_arrays` without what they carry besides the fields of ``schema``."""
    return read_arrays(spark, path, schema)[0].select(*schema.fieldNames())


def count_rejects(rejects: DataFrame) -> DataFrame:
    """Rejects per file and reason."""
    return rejects.groupBy("source_file", "reason").agg(F.count("*").alias("n"))


def write_snapshot_json(df: DataFrame, path: str, chars: int = ARRAY_CHARS) -> None:
    """Files that each hold one JSON array of about ``chars`` characters at most, one or more per partition of ``df``.

    A file is read whole, so its size must not follow that of the partition. Only a single row may be longer.
    """

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, none = [], 0, True
        for batch in batches:
            for row in batch["value"]:
                if held and size + len(row) > chars:
                    yield pd.DataFrame({"value": ["[" + "\n,".join(held) + "\n]"]})
                    held, size = [], 0
                held.append(row)
                size, none = size + len(row) + 2, False
        if held or none:
            yield pd.DataFrame({"value": ["[" + "\n,".join(held) + "\n]" if held else "[]"]})

    rows = df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(arrays, "value string")
    rows.write.option("maxRecordsPerFile", 1).text(path)


def require_fields(df: DataFrame, fields: list[str] = REQUIRED) -> DataFrame:
    return df.dropna(subset=fields, how="any")


def validate_docs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with ``error``); a website must also be non-empty."""
    needed = [c for c in ("id", "link", "year_month", "title", "main_title", "content", "website") if c in df.columns]
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in needed]
    error = F.coalesce(*missing, F.when(F.col("website") == "", F.lit("website is empty")))
    checked = df.withColumn("error", error)
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(F.col("error").isNotNull())


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace the rows of the sources present in ``df``; other sources stay.

    The rebalance hint gathers the rows of small sources and splits those of a
    big one over many tasks, by the sizes seen at run time.
    """
    (
        df.hint("rebalance", "website")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("website")
        .parquet(path)
    )


def retain_history(snapshots: DataFrame, source: str, ts: str, tie: str, keep: int = C.SNAPSHOTS_KEPT) -> DataFrame:
    """The newest snapshots of every source."""
    return ranked(snapshots, [source], [F.col(ts).desc(), F.col(tie).desc()], keep, "age")


def change_sink(upserts: DataFrame, delete_ids: DataFrame, path: str, batch: str) -> None:
    """Full rows for additions and ids only for deletions, one folder per batch."""
    upserts.write.mode("overwrite").json(f"{path}/upsert/batch={batch}")
    delete_ids.select("id").write.mode("overwrite").json(f"{path}/delete/batch={batch}")


def latest_batch(batches: DataFrame, batch: str, ts: str) -> DataFrame:
    """Rows of the batch with the newest time."""
    newest = batches.agg(F.max_by(batch, F.struct(ts, batch)).alias("b")).scalar()
    return batches.filter(F.col(batch) == newest)


def newest_batch(spark: SparkSession, path: str) -> str | None:
    """The folder ``batch=...`` below ``path`` that was written last, by the time of its newest file; None without files.

    Only the list of files is read. Of batches written at the same moment the greater name counts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    folder = F.regexp_extract("path", r"^(.*/batch=[^/]*)/", 1)
    newest = files.select(folder.alias("folder"), "modificationTime").filter("folder <> ''")
    return newest.agg(F.max_by("folder", F.struct("modificationTime", "folder"))).first()[0]


def read_newest_batch(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the newest batch of change files; no other folder is opened."""
    folder = newest_batch(spark, path)
    return spark.read.schema(schema).json(folder) if folder else spark.createDataFrame([], schema)


def local_sync(spark: SparkSession, path: str, schema: T.StructType, files: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(every element of every array file in a folder as an addition, with its file as the source; rejects)."""
    rows, rejects = read_arrays(spark, f"{path}/{files}", schema)
    return rows.withColumn("op", F.lit("add")), rejects
