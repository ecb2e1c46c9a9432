"""Versions of a table that several writers share: a log whose entries are put in place whole, and only if they aren't there yet.

A folder's `_log` has a file a version; the one with the highest number is the table. A writer reads it, writes data beside it under names of its own, and
puts the next version. If another was faster the writer starts over from what that one left. Data of a version that was
never put is seen by nobody.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Other writers were faster every time."""


class CommitLog:
    """The versions of one folder. States are small JSON objects that name what belongs to the table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        path = self._path(f"{self.folder}/_log")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._local = self._fs.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _entry(self, version: int) -> str:
        return f"{self.folder}/_log/{version:020d}.json"

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/_log"))]
        return max((int(n[:20]) for n in names if n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """The state of a version, the newest if none is named; {} before the first."""
        at = self.version() if version is None else version
        if not at:
            return 0, {}
        stream = self._fs.open(self._path(self._entry(at)))
        try:
            return at, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, version: int, state: dict) -> bool:
        """Put a version in place; False if it is there already. Of several writers exactly one succeeds, and readers see it whole or not at all."""
        new = self._path(f"{self.folder}/_log/.{uuid.uuid4().hex}")
        stream = self._fs.create(new, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        try:
            return self._linked(new, version) if self._local else self._renamed(new, version)
        finally:
            self._fs.delete(new, False)

    def _linked(self, new, version: int) -> bool:
        """A link by the second name; the local file system's rename would replace what is there."""
        file = lambda p: self._jvm.java.io.File(self._path(p).toUri().getPath()).toPath()
        try:
            self._jvm.java.nio.file.Files.createLink(file(self._entry(version)), file(new.toString()))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _renamed(self, new, version: int) -> bool:
        options = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(options, 1)
        never[0] = options.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(new, self._path(self._entry(version)), never)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def commit(self, change: Callable[[dict], dict | None], tries: int = 20) -> tuple[int, dict]:
        """Put what change(state) makes of the newest state, from the newest again as often as another is faster. None changes nothing."""
        for _ in range(tries):
            at, old = self.state()
            new = change(old)
            if new is None:
                return at, old
            if self.put(at + 1, new):
                return at + 1, new
        raise Conflict(f"{self.folder}: {tries} tries, each time another writer was faster")

    def fresh(self, kind: str) -> str:
        """A folder that no other writer uses."""
        return f"{self.folder}/{kind}-{uuid.uuid4().hex}"

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)
