"""The published state of a deployment: one small JSON file per version, never overwritten.

A version is written aside and then put in its place only if no one else has taken that number, so of several publishers
one wins and the others read again and decide anew. Readers take the newest file and see one consistent state. The folder
must lie in a store that renames atomically and does not rename onto an existing file (HDFS and the like), or on a local
disk, where a hard link does the same.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import SparkSession

KEPT_VERSIONS = 10
_NAME = re.compile(r"([0-9]{12})\.json")


class Folder:
    """Files of the session's Hadoop file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = self._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def child(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path, name)

    def entries(self, below: str = "") -> list:
        """Status of each entry; nothing if the folder is not there."""
        at = self.child(below) if below else self.path
        return list(self.files.listStatus(at)) if self.files.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.child(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Whether the file was created by this call; its whole content appears at once."""
        aside, target = self.child(f".{uuid4().hex}"), self.child(name)
        stream = self.files.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.files.getUri().getScheme() != "file":
                return not self.files.exists(target) and bool(self.files.rename(aside, target))
            link, existing = (self._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, aside))
            try:
                self._jvm.java.nio.file.Files.createLink(link, existing)
                return True
            except Exception as error:  # Py4J wraps what Java throws
                if "FileAlreadyExistsException" in str(error):
                    return False
                raise
        finally:
            self.files.delete(aside, False)


class Versions:
    def __init__(self, spark: SparkSession, path: str, initial: dict):
        self.folder = Folder(spark, path)
        self.initial = initial

    def _numbers(self) -> list[int]:
        names = [e.getPath().getName() for e in self.folder.entries()]
        return sorted(int(m.group(1)) for m in map(_NAME.fullmatch, names) if m)

    def latest(self) -> tuple[int, dict]:
        """(number, state); number 0 and the initial state before the first."""
        numbers = self._numbers()
        if not numbers:
            return 0, dict(self.initial)
        return numbers[-1], self.initial | json.loads(self.folder.read(f"{numbers[-1]:012d}.json"))

    def publish(self, change: Callable[[dict], dict | None]) -> dict | None:
        """Publishes `change(state)` as the next version, anew from the newest state whenever another publisher was first.

        `change` returns None to give up; then nothing is published.
        """
        while True:
            number, state = self.latest()
            changed = change(state)
            if changed is None:
                return None
            if self.folder.put_if_absent(f"{number + 1:012d}.json", json.dumps(changed)):
                return changed

    def forget(self, kept: int = KEPT_VERSIONS) -> int:
        """Deletes all but the newest versions; returns how many."""
        old = self._numbers()[:-kept]
        for number in old:
            self.folder.files.delete(self.folder.child(f"{number:012d}.json"), False)
        return len(old)
