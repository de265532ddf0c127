"""JSON documents that wrap rows with facts about the run, and their columnar counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..runtime import _delete
from ..schemas import ROWS_FIELD
from ..schemas import schema as schema_of


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_envelope(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of the envelopes at ``path``; an empty table where there is none (a first run).

    ``pos`` is a row's place in its document, which is the corpus order.
    """
    schema = schema_of(kind)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("pos", F.lit(0))
    outer = StructType([StructField(ROWS_FIELD[kind], ArrayType(schema))])
    docs = spark.read.schema(outer).json(path, multiLine=True)
    return docs.select(F.posexplode(ROWS_FIELD[kind]).alias("pos", "r")).select("r.*", "pos")


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Replaces the Parquet table at ``path`` by ``df``, which may read the old one; gives the new one.

    The new table is written beside the old one and takes its place only when it is complete, so
    a failed run leaves the old one as it was.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    drop_table(spark, path + "_next")
    df.write.parquet(path + "_next")
    move_table(spark, path + "_next", path)
    return spark.read.schema(df.schema).parquet(path)


def move_table(spark: SparkSession, source: str, target: str) -> None:
    """Puts a stored folder in the place of another."""
    if path_exists(spark, target):
        drop_table(spark, target + "_last")
        _rename(spark, target, target + "_last")
    _rename(spark, source, target)
    drop_table(spark, target + "_last")


def _rename(spark: SparkSession, source: str, target: str) -> None:
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = make(source)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, make(target)):
        raise OSError(f"{source} can't be renamed to {target}")


def write_rows(df: DataFrame, path: str, facts: dict[str, str] | None = None) -> None:
    """Replaces the Parquet table at ``path``; facts about the run go beside it as JSON rows."""
    replace_table(df, path)
    if facts is not None:
        write_facts(df.sparkSession, path, facts)


def write_facts(spark: SparkSession, path: str, facts: dict) -> None:
    """Facts about the table at ``path``, beside it."""
    rows = spark.createDataFrame([(k, str(v)) for k, v in sorted(facts.items())], "fact string, value string")
    rows.coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "_facts")


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document per row of a report, nested columns and nulls included."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a stored table; a missing one is no error."""
    if path_exists(spark, path):
        _delete(spark, path)


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, file_name) of stored files, without their contents."""
    files = spark.read.format("binaryFile").load(glob).select("path")
    return files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
