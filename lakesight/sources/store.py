"""Versioned tables in one folder: immutable data folders and a manifest per version.

A version appears when its manifest does, with all its parts at once. Manifests
are numbered and created only if absent, so two writers get different numbers,
and a writer that dies leaves nothing but a data folder that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_ALREADY_THERE = ("FileAlreadyExistsException", "already exists")


class VersionedStore:
    """Parts (named tables) per version below ``path``, which every executor reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._manifests = f"{self.path}/manifests"

    def _hadoop(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._hadoop(self._manifests)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def manifest(self, version: int) -> dict:
        file, fs = self._hadoop(f"{self._manifests}/{version:010d}.json")
        stream = fs.open(file)
        try:
            return json.loads(self.spark._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A").next())
        finally:
            stream.close()

    def _created(self, version: int, content: dict) -> bool:
        """Create the manifest with all its content, or find that another writer has."""
        draft, fs = self._hadoop(f"{self._manifests}/.{uuid.uuid4().hex}")
        final, _ = self._hadoop(f"{self._manifests}/{version:010d}.json")
        stream = fs.create(draft, False)
        stream.write(json.dumps(content).encode())
        stream.close()
        jvm = self.spark._jvm
        try:
            if fs.getUri().getScheme() == "file":  # a local rename replaces; a link does not
                nio = lambda p: jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(nio(final), nio(draft))
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Py4JJavaError as error:
            if any(mark in str(error.java_exception) for mark in _ALREADY_THERE):
                return False
            raise
        finally:
            if fs.exists(draft):
                fs.delete(draft, False)
        return True

    def commit(self, build: Callable[[int, int | None], dict[str, DataFrame]]) -> int:
        """Add a version and return its number.

        ``build(number, last)`` gives the parts of version ``number`` from what
        version ``last`` (None: there is none) holds. If another writer takes
        the number first, the parts are built again on top of its version.
        """
        while True:
            last = (self.versions() or [None])[-1]
            number = 1 if last is None else last + 1
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            folders = {}
            for name, part in build(number, last).items():
                folders[name] = f"{folder}/{name}"
                part.write.parquet(folders[name])
            if self._created(number, {"version": number, "parts": folders}):
                return number

    def read(self, part: str, version: int | None = None) -> DataFrame | None:
        """A part of a version (default: the last); None if there is none."""
        known = self.versions()
        if not known:
            return None
        folder = self.manifest(known[-1] if version is None else version)["parts"].get(part)
        return None if folder is None else self.spark.read.parquet(folder)

    def read_all(self, part: str) -> DataFrame | None:
        """A part of all versions, one below the other."""
        folders = [f for f in (self.manifest(v)["parts"].get(part) for v in self.versions()) if f]
        return self.spark.read.parquet(*folders) if folders else None


def stores_below(spark: SparkSession, path: str) -> list[VersionedStore]:
    """The stores in the folders of ``path``, in order of their names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()) if fs.exists(folder) else []
    return [s for s in (VersionedStore(spark, f"{path.rstrip('/')}/{n}") for n in names) if s.versions()]
