"""Tables whose files are named by a numbered manifest.

Files are written first, below fresh names, and become part of the table when a manifest that
names them is moved into place; readers follow the last manifest. A failure at any time leaves the
table as it was. What the last two manifests do not name any more is removed after a commit.
One writer at a time; a second one that commits the same number gets an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

from ..session import remove


class Manifest:
    """Named folders of a table below ``root``, as of each commit."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._folder = self._path(f"{self.root}/_manifest")
        self._files = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _at(self, number: int):
        return self._path(f"{self.root}/_manifest/{number}.json")

    def numbers(self) -> list[int]:
        """The commits that are still there, oldest first."""
        if not self._files.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def last(self) -> int:
        """The number of the last commit, -1 before the first one."""
        return max(self.numbers(), default=-1)

    def entries(self, number: int | None = None) -> dict[str, str]:
        """Name and folder (below ``root``) of each part of the table; none before the first commit."""
        number = self.last() if number is None else number
        if number < 0:
            return {}
        stream = self._files.open(self._at(number))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def fresh(self, purpose: str = "data") -> str:
        """A folder name that nothing uses yet."""
        return f"{purpose}/{uuid.uuid4().hex}"

    def commit(self, entries: dict[str, str], number: int | None = None) -> None:
        """Make ``entries`` the table, then remove what only commits before the last two name."""
        before = self.numbers()
        number = max(before, default=-1) + 1 if number is None else number
        if number in before:
            raise FileExistsError(f"commit {number} of {self.root} exists")
        draft = self._path(f"{self.root}/_manifest/_{uuid.uuid4().hex}")
        stream = self._files.create(draft, True)
        stream.write(json.dumps(entries, sort_keys=True).encode())
        stream.close()
        if not self._files.rename(draft, self._at(number)):
            raise FileExistsError(f"commit {number} of {self.root} could not be moved into place")
        older = before[:-1]
        if older:
            named = set(entries.values()) | set(self.entries(before[-1]).values())
            for old in older:
                for folder in set(self.entries(old).values()) - named:
                    remove(self.spark, f"{self.root}/{folder}")
                self._files.delete(self._at(old), False)

    def read(self, schema: T.StructType, names: list[str] | None = None) -> DataFrame:
        """The table, or the parts of it that are in ``names``; rows keep no trace of their part."""
        entries = self.entries()
        wanted = [f"{self.root}/{entries[n]}" for n in sorted(entries if names is None else entries.keys() & set(names))]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*wanted)

    def replace(self, name: str, df: DataFrame) -> None:
        """Write one part anew and commit it in place of the one of that name."""
        folder = self.fresh()
        df.write.parquet(f"{self.root}/{folder}")
        self.commit(self.entries() | {name: folder})
