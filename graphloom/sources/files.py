"""Every file of a tree as rows, hidden and empty ones too, and those that can't be read with their problem."""

from __future__ import annotations

import hashlib
import os
import stat
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tree import IGNORED_DIRS, SECRETS, ignored

FORMAT = "loom_listing"
LISTED = "path string, bytes bigint, problem string"
FILE = "path string, text string, hash string, bytes bigint, problem string"
#: Texts go back to Spark once they hold so many bytes together.
BATCH_BYTES = 16 << 20


class Folders(InputPartition):
    """Folders below the root that a task lists, and whether with all that is below them."""

    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"]
        self.dirs = frozenset(options.get("ignored_dirs", "").split("\n"))
        self.parts = int(options.get("parts", "64"))

    def _entries(self, folder: str) -> tuple[list[os.DirEntry], list[os.DirEntry]]:
        with os.scandir(os.path.join(self.root, folder)) as found:
            entries = sorted(found, key=lambda e: e.name)
        below = [e for e in entries if e.is_dir(follow_symlinks=False) and e.name not in self.dirs]
        return below, [e for e in entries if not e.is_dir()]

    def partitions(self) -> list[Folders]:
        """Folders are opened from above until there are enough to share out; the driver sees names of folders alone."""
        out, queue = [], deque([""])
        while queue and len(queue) + len(out) < self.parts:
            folder = queue.popleft()
            out.append(Folders(folder, False))
            try:
                queue.extend(os.path.join(folder, e.name) for e in self._entries(folder)[0])
            except OSError:  # its own task says so
                continue
        return out + [Folders(f, True) for f in queue]

    def read(self, partition: Folders) -> Iterator[tuple[str, int | None, str | None]]:
        queue = deque([partition.folder])
        while queue:
            folder = queue.popleft()
            try:
                below, files = self._entries(folder)
            except OSError as e:
                yield folder, None, type(e).__name__
                continue
            for entry in files:
                path = os.path.join(folder, entry.name)
                try:
                    at = entry.stat()
                    if stat.S_ISREG(at.st_mode):
                        yield path, at.st_size, None
                except OSError as e:
                    yield path, None, type(e).__name__
            if partition.deep:
                queue.extend(os.path.join(folder, e.name) for e in below)


class Listing(DataSource):
    """(path below ``root``, bytes, problem) of all files outside of the folders named in ``ignored_dirs``, one a line."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))


def _with_texts(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("path", "text", "hash", "bytes", "problem")
        types = pa.schema([(n, pa.int64() if n == "bytes" else pa.string()) for n in names])
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                path, problem = row["path"], row["problem"]
                data = None
                if problem is None:
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            data = f.read()
                    except OSError as e:
                        problem = type(e).__name__
                text, code = (data.decode("utf-8", "replace"), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
                rows.append((path, text, code, len(data) if data is not None else row["bytes"], problem))
                held += len(data or b"")
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)

    return run


def scan(spark: SparkSession, root: str, parts: int = 64, dirs: tuple[str, ...] = IGNORED_DIRS, names: tuple[str, ...] = SECRETS) -> DataFrame:
    """(path, text, hash, bytes, problem) of every file of a tree that all executors can open under the same path.

    Unlike ``tree.scan``, which takes any storage, with names that begin with a dot or an underscore and with empty files. A file
    or folder that can't be read is a row with the kind of error as its problem and no text; other rows have none. Ignored folders
    aren't entered and ignored names not opened. Folders behind links are passed over, files behind links read. Folders are listed
    by ``parts`` tasks or more; then the paths alone are dealt evenly, since one folder may hold most files, and their contents read.
    """
    spark.dataSource.register(Listing)
    base = root.rstrip("/") or "/"
    listed = spark.read.format(FORMAT).option("root", base).option("ignored_dirs", "\n".join(dirs)).option("parts", parts).load()
    kept = listed.where(~ignored(F.col("path"), dirs, names))
    return kept.repartition(parts, "path").mapInArrow(_with_texts(base), FILE)


def problems(scanned: DataFrame) -> DataFrame:
    """(path, problem) of what couldn't be read."""
    return scanned.where("problem is not null").select("path", "problem")
