"""Readers and writers of record files: CSV, JSON arrays, append logs, vectors kept by content."""

from __future__ import annotations

import csv
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..runtime import write_once

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, skip: int = 0) -> DataFrame:
    """CSV with quoted fields that may hold line breaks and doubled quotes.

    skip: lines above the header (exported sheets have some), counted with blank ones. Such a file
    is read unsplit, as any file with line breaks in fields is.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "nullValue": ""}
    if not skip:
        return spark.read.csv(path, schema=schema, **options)
    head = [r[0] for r in spark.read.text(path).limit(skip + 1).collect()]
    names = next(csv.reader([head[-1]]))
    above = sum(1 for line in head if line.strip())  # the reader passes over blank lines
    raw = spark.read.csv(path, schema=StructType([StructField(n, StringType()) for n in names]), multiLine=True, escape='"', nullValue="")
    order = W.partitionBy(F.input_file_name()).orderBy(F.monotonically_increasing_id())
    body = raw.withColumn("__n", F.row_number().over(order)).where(F.col("__n") > above).drop("__n")
    if schema is None:
        return body
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return body.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that each hold one array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_log(spark: SparkSession, path: str, schema: StructType | str, *, recursive: bool = False, keep_corrupt: bool = False) -> DataFrame:
    """An append log with a record on each line; a line that is no record is dropped, or kept in ``_corrupt_record`` to be counted."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if not keep_corrupt:
        # a record of which only some field has another type is kept with a null there
        full = StructType([*wanted.fields, StructField(CORRUPT, StringType())])
        rows = reader.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return reader.schema(StructType([*wanted.fields, StructField(CORRUPT, StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def with_path_parts(df: DataFrame, parts: dict[str, int]) -> DataFrame:
    """Add columns from the folders of each row's file: name -> place from the end (-2 is the folder of the file)."""
    folders = F.split(F.col("_metadata.file_path"), "/")
    return df.select("*", *[F.element_at(folders, i).alias(n) for n, i in parts.items()])


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Append to a JSON log the rows whose keys it does not hold yet, one for each key; the number of rows written.

    Running it again with the same rows writes nothing, so a lost run can be repeated.
    """
    spark = df.sparkSession
    fresh = df.dropDuplicates(list(keys))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        done = spark.read.schema(df.select(*keys).schema).json(path)
        fresh = fresh.join(done.distinct(), list(keys), "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path)
    fresh.unpersist()
    return n


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Parquet folders by condition, model and the like, so that a filter on them reads only its folders."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


VECTORS = StructType([StructField("model_id", StringType()), StructField("text_sha1", StringType()), StructField("vector", ArrayType(DoubleType()))])


def with_vectors(texts: DataFrame, text: str, model_id: str, path: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``vector``; vectors are kept under (model, SHA-1 of the text) and only missing texts are embedded.

    embed: (text_sha1, text) -> (text_sha1, vector), called with the distinct missing texts.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("text_sha1", F.sha1(F.col(text)))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    held = spark.read.schema(VECTORS).parquet(path) if there else spark.createDataFrame([], VECTORS)
    missing = keyed.where(F.col(text).isNotNull()).select("text_sha1", F.col(text).alias("text")).dropDuplicates(["text_sha1"])
    missing = missing.join(held.where(F.col("model_id") == model_id), "text_sha1", "left_anti")
    new = embed(missing).select(F.lit(model_id).alias("model_id"), "text_sha1", F.col("vector").cast("array<double>").alias("vector"))
    new.write.mode("append").parquet(path)
    held = spark.read.schema(VECTORS).parquet(path).where(F.col("model_id") == model_id).dropDuplicates(["text_sha1"])
    return keyed.join(held.select("text_sha1", "vector"), "text_sha1", "left").select(*texts.columns, "vector")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled and null as nothing; line breaks within fields stay."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', nullValue="", emptyValue='""')


def write_json_array(df: DataFrame, path: str) -> None:
    """Text files that each hold one JSON array; with one partition the folder holds a single one, as ``read_json_array`` takes it.

    Each partition streams its own array, so a large table is never gathered.
    """
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for b in batches:
            lines = b.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([before + lines[0], *["," + x for x in lines[1:]]])], names=["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if before == "," else "[]"])], names=["value"])

    rows.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def snapshot(df: DataFrame, name: str, steps: list[dict]) -> DataFrame:
    """``df`` written once; its name, rows and columns are appended to ``steps``."""
    out = write_once(df)
    steps.append({"step": name, "rows": out.count(), "columns": len(out.columns)})
    return out


def matching_runs(df: DataFrame, *, model: str | None = None, strategy: str | None = None) -> DataFrame:
    """Rows of the runs asked for: ``model`` is any part of the column model_slug, ``strategy`` the whole of its column."""
    if model:
        df = df.where(F.contains(F.col("model_slug"), F.lit(model)))
    return df.where(F.col("strategy") == strategy) if strategy else df


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], *, batch: int = 20, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """(text_sha1, text) -> (text_sha1, vector) by calls of ``batch`` texts, tried again ``attempts`` times with growing pauses; a batch that still fails gives null vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors: list = []
            for at in range(0, len(b), batch):
                part = b["text"].iloc[at : at + batch].tolist()
                for i in range(attempts):
                    try:
                        vectors += embed(part)
                        break
                    except Exception:  # noqa: BLE001
                        if i == attempts - 1:
                            vectors += [None] * len(part)
                        else:
                            time.sleep(pause * (i + 1))
            yield pd.DataFrame({"text_sha1": b["text_sha1"], "vector": pd.Series(vectors, dtype=object, index=b.index)})

    return texts.select("text_sha1", "text").mapInPandas(run, "text_sha1 string, vector array<double>")
