"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quaystone.sources.store import shared_dir

#: Rows of an Arrow batch that goes to Python; Spark ends a batch at 64 MB besides (maxBytesPerBatch), so long texts don't add up.
BATCH_ROWS = 256
#: Parts into which the rows of a key are dealt in a join with a table that has few rows per key.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a frame from cut() that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS where they are larger; plans made later in the session go by it too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def arrow_types(schema: str) -> tuple[list[str], list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return arrow.names, arrow.types


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn: from a list of column lists to a list of column lists, once per Arrow batch."""
    bounded_batches(df.sparkSession)
    names, types = arrow_types(schema)

    def run(batches):
        for batch in batches:
            out = fn([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, column: Column, fn, schema: str, *kept: str) -> DataFrame:
    """The kept columns of df (all, if none are named) as they are, and those that fn makes from the list of a column's values."""
    bounded_batches(df.sparkSession)
    names, types = arrow_types(schema)
    before = df.select(*(kept or df.columns))
    n = len(before.columns)

    def run(batches):
        for batch in batches:
            made = [pa.array(v, t) for v, t in zip(fn(batch.column(n).to_pylist()), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*batch.schema.names[:n], *names])

    both = StructType([*before.schema.fields, *StructType.fromDDL(schema).fields])
    return df.select(*(kept or df.columns), column.alias("__in")).mapInArrow(run, both)


def text_bytes() -> Column:
    """The text's UTF-8 bytes, a null text as an empty one."""
    return F.coalesce(F.col("text").cast("binary"), F.lit(b""))


def as_bytes(df: DataFrame, *keys: str) -> DataFrame:
    """The key columns and the text as UTF-8 bytes."""
    return df.select(*keys, text_bytes().alias("text"))


def row_key() -> Column:
    """128 bits of the SHA-256 of doc_id and text: one key for the rows that agree in both."""
    head = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("\n")).cast("binary")
    return F.substring(F.unhex(F.sha2(F.concat(head, text_bytes()), 256)), 1, 16)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose row_key() is in gone (a column row). A hash join by that key at every size: texts are shuffled once and not sorted."""
    keyed = docs.withColumn("__row", row_key())
    return keyed.join(gone.select(F.col("row").alias("__row")).hint("shuffle_hash"), "__row", "left_anti").select(*docs.columns)


def salted_join(many: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner", parts: int = SALTS) -> DataFrame:
    """many joined with few on keys of which one may hold a large share of many: its rows are dealt by a hash of the column by, and few stands in every part."""
    left = many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    right = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")
