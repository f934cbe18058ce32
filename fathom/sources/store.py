"""Versions of written collections in a folder, swapped by one manifest, and the feed of changes."""

from __future__ import annotations

import json
import uuid
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from .shared import Files, shared_dir

CHANGES = "seq long, ts timestamp, collection string, change_type string, sid string, document string, old_document string, changed_fields array<string>"


class Store:
    """A folder with tables and manifests.

    A table is a list of files in the manifest.  A commit writes new files beside the
    old and then the next manifest, which appears whole or not at all, so readers see
    all of a commit or none, and of two that commit at once the later one fails; files
    that a commit doesn't touch are neither read nor written.  The manifest names the
    events of its commit as well; they are moved to the feed after it appeared, and by
    whoever opens the store next if the writer was lost in between, so none are lost
    and none seen of a commit that failed.  Tables are on the file system that all
    executors share; nothing is held in memory.  Its rename must not overwrite, as
    that of HDFS, of local disks and of hierarchical object stores doesn't.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        own = path is None
        self.files = Files(spark, path or f"{shared_dir(spark).rstrip('/')}/fathom-store-{uuid.uuid4().hex}")
        self.files.make()
        if own:
            self.files.fs.deleteOnExit(self.files.path(""))
        self.version, self.state = self._latest()

    def _latest(self) -> tuple[int, dict[str, Any]]:
        names = [n for n in self.files.list() if n.startswith("manifest-")]
        if not names:
            return 0, {"collections": {}, "migrations": [], "indexes": {}, "events": None}
        last = max(names, key=lambda n: int(n.split("-")[1].split(".")[0]))
        state = json.loads(self.files.read(last))
        self._publish(state["events"])
        return int(last.split("-")[1].split(".")[0]), state

    @property
    def changes_path(self) -> str:
        path = self.files.path("_changes")
        self.files.fs.mkdirs(path)
        return str(path)

    def _publish(self, at: str | None) -> None:
        """Moves the events of a commit to the feed; those that are there already stay."""
        if at is None:
            return
        self.files.fs.mkdirs(self.files.path("_changes"))
        for name in self.files.list(at):
            if name.endswith(".parquet") and not name.startswith("."):
                self.files.move(f"{at}/{name}", f"_changes/{name}")

    def write(self, name: str, df: DataFrame) -> list[str]:
        """New files of a table, not yet seen by anyone; those without rows are left out."""
        at = f"{name}/v{self.version + 1}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.files.root}/{at}")
        return [f"{at}/{n}" for n in self.files.list(at) if n.endswith(".parquet")]

    def read(self, names: list[str], schema) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.files.root}/{n}" for n in names))

    def hit(self, names: list[str], schema, condition) -> list[str]:
        """Which files hold rows that meet a condition."""
        if not names:
            return []
        found = self.read(names, schema).filter(condition).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
        hit = {"/".join(unquote(r["f"]).split("/")[-3:]) for r in found}
        return [n for n in names if n in hit]

    def commit(self, state: dict[str, Any], changes: DataFrame | None) -> None:
        """Makes the state, with the events of it, the latest."""
        state["events"] = None
        if changes is not None:
            state["events"] = f"_events/v{self.version + 1}-{uuid.uuid4().hex[:8]}"
            changes.write.parquet(f"{self.files.root}/{state['events']}")
        if not self.files.create(f"manifest-{self.version + 1:09d}.json", json.dumps(state)):
            raise EngineError("another commit came first")
        self.version, self.state = self.version + 1, state
        self._publish(state["events"])

    def changes(self) -> DataFrame:
        """All changes so far."""
        return self.spark.read.schema(CHANGES).parquet(self.changes_path)

    def stream(self, **options: Any) -> DataFrame:
        """The changes as they come, from the first one on."""
        return self.spark.readStream.schema(CHANGES).options(**options).parquet(self.changes_path)
