"""Binary files in the folder that all executors share, written and read within tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from recollect.session import checkpoint_folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the checkpoint folder, deleted when the application ends."""
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return str(files.makeQualified(path))


def _open(url: str):
    from pyarrow import fs

    if url.startswith("file:"):  # Hadoop writes file:/path
        url = "file:///" + url[5:].lstrip("/")
    return fs.FileSystem.from_uri(url)


class Written:
    """A file that takes its name once it is whole: an attempt that is lost leaves none behind.

    Attempts of one task write the same bytes, so it does not matter which comes last.
    """

    def __init__(self, url: str):
        self._fs, self._path = _open(url)
        self._draft = f"{self._path}.{uuid.uuid4().hex}.draft"
        self._out = self._fs.open_output_stream(self._draft)
        self.size = 0

    def write(self, data: bytes) -> int:
        """The place at which ``data`` begins."""
        at = self.size
        self._out.write(data)
        self.size += len(data)
        return at

    def __enter__(self) -> "Written":
        return self

    def finish(self) -> None:
        self._out.close()
        self._fs.move(self._draft, self._path)

    def __exit__(self, failed, *_) -> None:
        if failed:
            self._out.close()
            self._fs.delete_file(self._draft)
        else:
            self.finish()


def read(url: str, offset: int = 0, size: int | None = None) -> bytes:
    with reading(url) as f:
        f.seek(offset)
        return f.read(size) if size is not None else f.read()


def reading(url: str):
    """The file, open for reading at any place."""
    fs, path = _open(url)
    return fs.open_input_file(path)
