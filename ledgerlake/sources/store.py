"""A dictionary as a table of versions: revisions are added, never changed, and each becomes visible at once.

A revision is written beside the others, claimed by creating a file that may not exist, and moved into its place. Of two writers that
start from the same revision one gets the claim; the other reads what the first has added and works its own out again, so no
token comes to mean two values and none is lost. Any file system will do whose creating of a file that may not exist is one step, as it is
on HDFS; Hadoop's own way on a local one is not, so there the operating system's is taken.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ledgerlake.errors import EngineError
from ledgerlake.operators import masking

SCHEMA = "kind string, normalized string, token string, spelling string"
WAIT_SECONDS = 60.0


class DictionaryStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._place = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._place("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def revisions(self) -> list[int]:
        """The revisions that are in place."""
        if not self._fs.exists(self._place("")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._place("")))
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"r\d{8}", n))

    def read(self, revision: int | None = None) -> DataFrame:
        """The dictionary (SCHEMA) as of a revision, of the last one if none is given. Before the first one it is empty."""
        wanted = [n for n in self.revisions() if revision is None or n <= revision]
        parts = [self.spark.read.schema(SCHEMA).parquet(f"{self.path}/r{n:08d}") for n in wanted]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def staged(self, values: DataFrame, kind: str, column: str, secret: bytes, base: int) -> str:
        """Where the rows that values add to revision `base` have been written, not yet visible."""
        name = f"_staged/{uuid.uuid4().hex}"
        masking.issue(values, kind, column, secret, self.read(base)).select(*(c.split()[0] for c in SCHEMA.split(", "))).write.parquet(f"{self.path}/{name}")
        return name

    def _create_once(self, name: str) -> bool:
        """Creates a file; False if it is there."""
        place = self._place(name)
        self._fs.mkdirs(place.getParent())
        try:
            if self._fs.getUri().getScheme() == "file":
                os.close(os.open(place.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            else:
                self._fs.create(place, False).close()
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def claim(self, name: str, revision: int) -> bool:
        """Puts a staged revision in its place; False if another writer has claimed it."""
        if not self._create_once(f"_claims/{revision:08d}"):
            return False
        return self._fs.rename(self._place(name), self._place(f"r{revision:08d}"))

    def add(self, values: DataFrame, kind: str, column: str, secret: bytes, wait: float = WAIT_SECONDS) -> int:
        """Adds the values that the dictionary lacks and gives the revision that has them. A claim that its writer never makes good on within
        `wait` seconds is an error; its file in `_claims` has to be removed once that writer is known to be gone."""
        while True:
            base = max(self.revisions(), default=0)
            name = self.staged(values, kind, column, secret, base)
            if self.claim(name, base + 1):
                return base + 1
            self._fs.delete(self._place(name), True)
            until = time.monotonic() + wait
            while max(self.revisions(), default=0) <= base:
                if time.monotonic() > until:
                    raise EngineError("pending_stale", f"revision {base + 1} is claimed but not in place")
                time.sleep(0.2)


class JournalStore:
    """A journal as an append-only table: a row when an operation opens and another when it closes, which may be read at any time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)
