"""Datasets that are rewritten in place: whole versions side by side, one small record says which one counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RECORDS = "_versions"


class VersionConflict(Exception):
    """Another writer committed first."""


class VersionedTable:
    """A dataset below ``path`` whose versions are folders of their own.

    A version counts once its record ``_versions/<number>`` stands, which a rename that never replaces puts there. A
    write that fails before leaves the version before current and a folder that no record names. Readers take the
    version of the highest record; one that is being read stays until ``expire``.
    """

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet", **options):
        self.spark, self.path, self.fmt, self.options = spark, path.rstrip("/"), fmt, options
        jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._at(RECORDS).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def history(self) -> dict[int, str]:
        """Folder of every committed version, by number."""
        if not self._fs.exists(self._at(RECORDS)):
            return {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(RECORDS)))
        return {int(n): self._record(n)["folder"] for n in names if n.isdigit()}

    def _record(self, name: str) -> dict:
        stream = self._fs.open(self._at(f"{RECORDS}/{name}"))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def current(self) -> int | None:
        return max(self.history(), default=None)

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an earlier one that is still there."""
        known = self.history()
        if not known:
            raise FileNotFoundError(f"no version of {self.path}")
        number = max(known) if version is None else version
        if number not in known:
            raise FileNotFoundError(f"no version {number} of {self.path}")
        return self.spark.read.format(self.fmt).options(**self.options).load(f"{self.path}/{known[number]}")

    def write(self, df: DataFrame) -> int:
        """Writes df as the next version of the one that is current now."""
        seen = self.current()
        return self._commit(self._stage(df), seen)

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """The current version, changed, as the next one; fails if another one was committed meanwhile."""
        seen = self.current()
        return self._commit(self._stage(change(self.read(seen))), seen)

    def _stage(self, df: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        df.write.format(self.fmt).options(**self.options).save(f"{self.path}/{folder}")
        return folder

    def _commit(self, folder: str, seen: int | None) -> int:
        number = 0 if seen is None else seen + 1
        draft, record = self._at(f"{RECORDS}/.{folder}"), self._at(f"{RECORDS}/{number:012d}")
        stream = self._fs.create(draft, False)
        stream.writeUTF(json.dumps({"folder": folder}))
        stream.close()
        gateway = self.spark._sc._gateway
        never_replace = gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, record, never_replace)
        except Exception as error:
            if not self._fs.exists(record):
                raise
            self._fs.delete(draft, False)
            raise VersionConflict(f"version {number} of {self.path} was committed meanwhile") from error
        return number

    def expire(self, keep: int = 1) -> list[int]:
        """Removes all but the last ``keep`` versions, records first; returns their numbers."""
        if keep < 1:
            raise ValueError("the current version stays")
        known = self.history()
        gone = sorted(known)[:-keep]
        for number in gone:
            self._fs.delete(self._at(f"{RECORDS}/{number:012d}"), False)
            self._fs.delete(self._at(known[number]), True)
        return gone
