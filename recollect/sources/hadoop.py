"""Small control files on whatever file system the table lives on."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession

#: After this time the claim of a writer that never published is void.
CLAIM_HOURS = 0.25


class ControlFiles:
    """Text files and listings through Hadoop's FileSystem, never the driver's local disk."""

    def __init__(self, spark: SparkSession, home: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.home = home.rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}" if name else self.home)

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> str:
        path = self._path(name)
        stream = self._fs(path).open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write ``name`` whole or not at all; False when it exists already.

        Every writer has a draft of its own. A claim beside the target is created exclusively,
        which file systems and object stores do atomically; only its maker may publish. A claim
        whose writer died goes stale after CLAIM_HOURS.
        """
        target, draft = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.draft")
        fs = self._fs(target)
        if fs.exists(target):
            return False
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        claim = self._path(f"{name}.claim")
        if fs.exists(claim) and self.age_hours(f"{name}.claim") > CLAIM_HOURS and not fs.exists(target):
            fs.delete(claim, False)
        try:
            fs.create(claim, False).close()  # the one writer who makes this file publishes the version
        except Exception:
            fs.delete(draft, False)
            return False
        return bool(fs.rename(draft, target))

    def age_hours(self, name: str) -> float:
        path = self._path(name)
        return (time.time() - self._fs(path).getFileStatus(path).getModificationTime() / 1000) / 3600

    def drop(self, folder: str) -> bool:
        path = self._path(folder)
        return bool(self._fs(path).delete(path, True))

    def bytes_under(self, folder: str) -> int:
        path = self._path(folder)
        fs = self._fs(path)
        return int(fs.getContentSummary(path).getLength()) if fs.exists(path) else 0
