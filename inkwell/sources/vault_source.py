"""A note vault as a source, and files by key as a sink, for ``spark.read.format`` and ``write.format``.

``vault`` reads the notes of a vault's folders. Conditions on ``kind`` (the folder), ``name`` and ``chapter`` are applied to the listing, so that
other files are neither opened nor planned; a folder's files are read in parts of ``FILES_A_PART``. A vault or a folder
that isn't there has no rows.

``keyed_files`` writes a row's ``value`` to a file of its ``name``: what a person edits or another program reads. Tasks write
beside the target, each attempt for itself; the driver moves the files when all tasks are done, so that a task that
fails leaves nothing, one that is repeated nothing twice, and a name that two rows give moves nothing at all.
Names and not contents pass the driver.

Both open paths by their URI's scheme (a local or mounted disk, or one of the stores that Arrow knows).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage

FILES_A_PART = 500
NOTE = "kind string, name string, chapter int, path string, value string"
_CHAPTER = re.compile(r"第(\d+)章")
#: What a pushed condition asks of a value; a value that is null meets none.
_TESTS = {
    EqualTo: lambda v, w: v == w, In: lambda v, w: v in w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w,
    LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w, StringStartsWith: lambda v, w: v.startswith(w), StringEndsWith: lambda v, w: v.endswith(w),
}


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


@dataclass
class Notes(InputPartition):
    """(kind, name, chapter, path) of some files."""

    files: Sequence[tuple]


class VaultReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.ending = options["path"], options.get("ending", ".md")
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for one in filters:
            if type(one) in _TESTS and one.attribute in (("kind",), ("name",), ("chapter",)):
                self.tests.append((one.attribute[0], type(one), one.value))
            else:
                yield one

    def wanted(self, row: dict) -> bool:
        return all(row[c] is not None and _TESTS[kind](row[c], value) for c, kind, value in self.tests)

    def partitions(self) -> list[Notes]:
        store, root = opened(self.uri)
        kinds = [i.base_name for i in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.type == pafs.FileType.Directory and not i.base_name.startswith(".")]
        asked = [(kind, value) for c, kind, value in self.tests if c == "kind"]
        parts = []
        for kind in sorted(k for k in kinds if all(_TESTS[t](k, v) for t, v in asked)):
            found = []
            for info in store.get_file_info(pafs.FileSelector(f"{root}/{kind}")):
                if info.type == pafs.FileType.File and info.base_name.endswith(self.ending):
                    name = info.base_name.removesuffix(self.ending)
                    chapter = _CHAPTER.search(name)
                    row = {"kind": kind, "name": name, "chapter": int(chapter[1]) if chapter else None}
                    if self.wanted(row):
                        found.append((*row.values(), info.path))
            found.sort()
            parts += [Notes(found[k : k + FILES_A_PART]) for k in range(0, len(found), FILES_A_PART)]
        return parts or [Notes([])]

    def read(self, partition: Notes) -> Iterator[tuple]:
        store, _ = opened(self.uri)
        for kind, name, chapter, path in partition.files:
            with store.open_input_stream(path) as file:
                yield kind, name, chapter, path, file.read().decode("utf-8", "replace").replace("\r\n", "\n")


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return NOTE

    def reader(self, schema) -> VaultReader:
        return VaultReader(dict(self.options))


@dataclass
class Staged(WriterCommitMessage):
    """Where a task has left its files."""

    folder: str
    names: list[str]


class KeyedWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: Sequence[str]):
        self.uri, self.ending = options["path"].rstrip("/"), options.get("ending", "")
        self.name_at, self.value_at = columns.index("name"), columns.index("value")
        self.staging = f".staging-{uuid.uuid4().hex}"
        store, root = opened(self.uri)
        store.create_dir(f"{root}/{self.staging}")

    def write(self, iterator: Iterator) -> Staged:
        store, root = opened(self.uri)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=False)  # an attempt that comes after the end leaves nothing
        names = []
        for row in iterator:
            name, value = row[self.name_at], row[self.value_at]
            if not name or "/" in name:
                raise ValueError(f"{name!r} can't be a file's name")
            if value is not None:
                with store.open_output_stream(f"{folder}/{len(names)}") as out:
                    out.write(value.encode())
                names.append(name + self.ending)
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = opened(self.uri)
        told = [m for m in messages if m]
        names = [n for m in told for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        for m in told:
            for k, name in enumerate(m.names):
                store.move(f"{m.folder}/{k}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """What tasks have staged goes, that of failed attempts too."""
        store, root = opened(self.uri)
        if store.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class KeyedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> KeyedWriter:
        return KeyedWriter(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    """Make both known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VaultSource)
    spark.dataSource.register(KeyedFiles)


def read_vault(spark: SparkSession, vault: str) -> DataFrame:
    """kind, name, chapter, path, value of a vault's notes."""
    register(spark)
    return spark.read.format("vault").load(vault)


def write_files(rows: DataFrame, folder: str, ending: str = "") -> None:
    """A file ``name`` with ``value`` in ``folder`` for each row of ``rows(name, value)``; files of other names stay, rows without a value write none."""
    register(rows.sparkSession)
    rows.select("name", "value").write.format("keyed_files").option("ending", ending).mode("append").save(folder)
