"""A ledger: the newest of numbered notes says what is done, so that several writes stand or fall together.

A note is written under a temporary name and renamed, so it is there whole or not at all. There is one writer at a time,
as a streaming query has; readers take the newest note and see nothing that was written after it and not noted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

DIGITS = 12
KEPT = 10  # notes that stay besides the newest, for those who look at what was


class Ledger:
    """Notes ``000000000007.json`` in a folder that the driver sees; each holds the whole state after its step."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        files = self._files()
        if not files.exists(self._path()):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(self._path()) if s.getPath().getName().endswith(".json"))

    def latest(self) -> tuple[int, dict]:
        """The newest note's number and state; -1 and nothing before the first."""
        names = self._names()
        if not names:
            return -1, {}
        text = self.spark.read.text(f"{self.folder}/{names[-1]}", wholetext=True).first()[0]
        return int(names[-1].split(".")[0]), json.loads(text)

    def commit(self, state: dict) -> int:
        """Note a state as the newest; what was written before it counts from here on."""
        number = self.latest()[0] + 1
        files, name, passing = self._files(), f"{number:0{DIGITS}d}.json", f"_{uuid.uuid4().hex}"
        out = files.create(self._path(passing), True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if files.exists(self._path(name)) or not files.rename(self._path(passing), self._path(name)):
            raise RuntimeError(f"another writer has noted step {number} in {self.folder}")
        for old in self._names()[: -1 - KEPT]:
            files.delete(self._path(old), False)
        return number
