"""Tables as lists of Parquet folders that change all at once.

A table owns numbered manifests, each the whole list of folders that make up one version. Writers
fill a new folder, then publish the next manifest; creating it fails if another writer was
first, and the change is then applied to that writer's version. Readers take the newest complete
manifest, so they see a version before or after a change, never parts of both, and a change
that ends halfway leaves only a folder nobody lists. Marks kept with a version tell which
batches of a stream it holds, so a batch that is sent again is not stored twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Version:
    number: int = 0
    folders: tuple[str, ...] = ()
    marks: dict[str, int] = field(default_factory=dict)

    def holds(self, mark: tuple[str, int] | None) -> bool:
        return mark is not None and self.marks.get(mark[0], -1) >= mark[1]

    def marked(self, mark: tuple[str, int] | None) -> Version:
        return self if mark is None else replace(self, marks={**self.marks, mark[0]: mark[1]})


class SnapshotTable:
    """A table below ``root``. Folders in ``origin``, where present, are what it starts from."""

    def __init__(self, spark: SparkSession, root: str, schema: str | None = None, origin: tuple[str, ...] = ()) -> None:
        self.spark, self.root, self.schema, self.origin = spark, root.rstrip("/"), schema, origin

    def _at(self, location: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(location)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> str:
        return f"{self.root}/_manifests/{number:012d}.json"

    def _numbers(self) -> list[int]:
        path, files = self._at(f"{self.root}/_manifests")
        if not files.exists(path):
            return []
        names = [entry.getPath().getName() for entry in files.listStatus(path)]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _load(self, number: int) -> Version | None:
        """A version, or None if its manifest is not complete."""
        path, files = self._at(self._manifest(number))
        try:
            stream = files.open(path)
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            content = json.loads(text)
        except (Py4JJavaError, ValueError):
            return None
        return Version(number, tuple(content["folders"]), content["marks"])

    def version(self) -> Version:
        """The newest complete version; without any, the folders it starts from."""
        for number in self._numbers():
            found = self._load(number)
            if found is not None:
                return found
        return Version(0, tuple(f for f in self.origin if (at := self._at(f))[1].exists(at[0])))

    def _publish(self, version: Version) -> bool:
        path, files = self._at(self._manifest(version.number))
        text = json.dumps({"folders": version.folders, "marks": version.marks})
        try:
            stream = files.create(path, False)
        except Py4JJavaError as error:
            if files.exists(path):
                return False
            raise error
        stream.write(text.encode())
        stream.close()
        return True

    def _change(self, step: Callable[[Version], Version | None]) -> Version:
        while True:
            before = self.version()
            after = step(before)
            if after is None:
                return before
            # Numbers above an unfinished manifest stay free of it.
            number = max([before.number, *self._numbers()[:1]]) + 1
            after = replace(after, number=number)
            if self._publish(after):
                return after

    def read(self, version: Version | None = None) -> DataFrame | None:
        """One version, the newest by default; None if it holds nothing."""
        version = version or self.version()
        if not version.folders:
            return None
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(*version.folders)

    def _written(self, df: DataFrame) -> str:
        folder = f"{self.root}/data-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def append(self, df: DataFrame, mark: tuple[str, int] | None = None) -> Version:
        """Add rows; a batch whose mark the table holds already adds none."""
        before = self.version()
        if before.holds(mark):
            return before
        folder = self._written(df)
        return self._change(lambda v: None if v.holds(mark) else replace(v.marked(mark), folders=(*v.folders, folder)))

    def replace(self, df: DataFrame) -> Version:
        """These rows instead of all others. Marks stay: what was replaced does not come back."""
        folder = self._written(df)
        return self._change(lambda v: replace(v, folders=(folder,)))

    def fold(self, build: Callable[[DataFrame], DataFrame]) -> Version:
        """Put one folder, made of the present ones, in their place; later appends stay beside it."""
        old = self.version()
        if not old.folders:
            return old
        folder, gone = self._written(build(self.read(old))), set(old.folders)

        def step(v: Version) -> Version | None:
            if not gone <= set(v.folders):
                return None  # replaced or folded meanwhile
            return replace(v, folders=(folder, *[f for f in v.folders if f not in gone]))

        return self._change(step)

    def clean(self, keep: int = 2) -> int:
        """Drop manifests but the newest ``keep``, and folders no kept one lists; returns their number.

        Readers of older versions, and writers that have not published yet, must be done.
        """
        kept = [v for v in map(self._load, self._numbers()) if v is not None][:keep]
        if not kept:
            return 0
        listed = {f.rsplit("/", 1)[-1] for v in kept for f in v.folders}
        for number in self._numbers():
            if number < kept[-1].number:
                path, files = self._at(self._manifest(number))
                files.delete(path, False)
        root, files = self._at(self.root)
        dropped = 0
        for entry in files.listStatus(root):
            name = entry.getPath().getName()
            if name.startswith("data-") and name not in listed:
                files.delete(entry.getPath(), True)
                dropped += 1
        return dropped
