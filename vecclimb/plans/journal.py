"""An append-only journal of the steps that a job has committed, so that a broken-off job goes on where it stopped."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Journal:
    """The tables of a job in a folder that driver and executors share, and which of them are whole.

    A step is a table and, once that is written, an entry in the folder's journal; entries are only ever added. A step that has
    an entry is read; a table without one, which a broken-off run left, is written anew.
    """

    def __init__(self, spark: SparkSession, path: str, settings: str):
        """settings: what a run that goes on must share with the one that broke off; ValueError if it does not."""
        self.spark, self.path = spark, path
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/journal")
        self._fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.committed = {s.getPath().getName() for s in self._fs.listStatus(folder)} if self._fs.exists(folder) else set()
        if "begun" not in self.committed:
            self._enter("begun", json.dumps({"settings": settings, "at": datetime.now(timezone.utc).isoformat()}))
        begun = json.loads(spark.read.text(f"{path}/journal/begun").first()[0])
        if begun["settings"] != settings:
            raise ValueError(f"{path} holds a job of other settings: {begun['settings']}")
        self.started = datetime.fromisoformat(begun["at"])

    def _enter(self, name: str, text: str) -> None:
        """Add an entry whole: it is written under another name and then renamed."""
        jvm = self.spark.sparkContext._jvm
        under = lambda n: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
        out = self._fs.create(under(f"journal.{name}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(under("journal"))
        self._fs.rename(under(f"journal.{name}.new"), under(f"journal/{name}"))
        self.committed.add(name)

    def step(self, name: str, build: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
        """The table of a step: read if it is committed, else built, written and committed. Tables of one folder are read together."""
        path = f"{self.path}/{folder}/step={name}" if folder else f"{self.path}/{name}"
        if name not in self.committed:
            built = build()
            built.write.mode("overwrite").option("compression", "zstd").parquet(path)
            self._enter(name, "")
            return self.spark.read.schema(built.schema).parquet(path)
        return self.spark.read.parquet(path)

    def together(self, folder: str, most: int, schema: StructType) -> DataFrame:
        """The tables of the first `most` steps of a folder, folder0 to folder(most - 1), as one scan."""
        if not most:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{folder}/step={folder}{i}" for i in range(most)))
