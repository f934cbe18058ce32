"""Reading and writing files: JSON, CSV, Parquet, binary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from .shared import Files, written

_CORRUPT = "_corrupt"


def read_json(spark: SparkSession, path: str, schema: T.StructType, *, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, texts that aren't rows) of a JSON file: lines, or with multi_line an array."""
    whole = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    df = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).option("multiLine", multi_line).json(path)
    df = written(df)  # parsed once, and Spark answers no query about broken lines alone
    return df.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT), df.filter(F.col(_CORRUPT).isNotNull()).select(_CORRUPT)


def export(df: DataFrame, path: str, format: str = "JSON") -> None:
    """Writes a folder of JSON lines, CSV with a header (nested values as JSON, null as nothing) or Parquet."""
    kind = format.upper()
    if kind == "JSON":
        df.write.option("ignoreNullFields", "false").json(path)
    elif kind == "CSV":
        flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema]
        df.select(*flat).write.option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)
    elif kind == "PARQUET":
        df.write.parquet(path)
    else:
        raise ValidationError(f"can't export {format}")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder."""
    return spark.read.format("binaryFile").load(path)


def write_blob(spark: SparkSession, path: str, content: bytes) -> str:
    """Writes one file, which no one sees until it is whole; its path.  A file of this name is an error."""
    folder, _, name = path.rpartition("/")
    files = Files(spark, folder or ".")
    files.make()
    if not files.create(name, content):
        raise ValidationError(f"{path} exists")
    return path
