"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError

#: A side of a join is broadcast up to so many bytes, by count of its rows times an estimate of a row's size.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a folder of our own, if all of Spark runs on this machine."""
    if conf := spark.conf.get("spark.checkpoint.dir", None):
        return conf
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise EngineError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="fathom-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
    return str(sc.getCheckpointDir())


class Files:
    """The file system of a path, by way of Spark, so any that Spark knows will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self) -> None:
        self.fs.mkdirs(self.path(""))

    def list(self, name: str = "") -> list[str]:
        p = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str | bytes) -> bool:
        """Writes a file that no one sees until it is whole; False if there is one of this name."""
        if self.fs.exists(self.path(name)):
            return False
        hidden = f".{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(hidden), True)
        stream.write(bytearray(text.encode() if isinstance(text, str) else text))
        stream.close()
        if self.fs.rename(self.path(hidden), self.path(name)):
            return True
        self.fs.delete(self.path(hidden), True)
        return False

    def move(self, name: str, to: str) -> bool:
        """Renames a file; False if it isn't there (any more)."""
        return bool(self.fs.exists(self.path(name)) and self.fs.rename(self.path(name), self.path(to)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def checked(small: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """small, with a broadcast hint if its rows fit BROADCAST_BYTES; else a plain side that Spark shuffles."""
    return F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, deleted when the driver ends."""
    spark = df.sparkSession
    files = Files(spark, f"{shared_dir(spark).rstrip('/')}/fathom-{uuid.uuid4().hex}")
    files.make()
    files.fs.deleteOnExit(files.path(""))
    df.write.parquet(f"{files.root}/t")
    return spark.read.schema(df.schema).parquet(f"{files.root}/t")
