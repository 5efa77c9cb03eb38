"""A sink of files that are there whole or not at all: rows (name, offset, content) become files below a folder.

Tasks write into a staging folder beside the files; commit moves them to their names, abort deletes what was staged. A row without an
offset is appended to its file, so all rows of such a name stand in one partition, one after the other, and only one row is held. Rows
with offsets may come from any task: their file is made at its full size first, and the sum of what was written must be that size.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from fieldscope.sources.wav import store_of


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]
    placed: dict[str, int]


def _sound(name: str) -> str:
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"no name of a file below the folder: {name!r}")
    return name


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.sizes, self.remove, self.keep, self.extra = (json.loads(options.get(k, d)) for k, d in (("sizes", "{}"), ("remove", "[]"), ("keep", "[]"), ("extra", "{}")))
        self.whole = options.get("whole", "false") == "true"
        self.staging = f"{self.root}.staged-{uuid.uuid4().hex}"
        if self.sizes and not isinstance(store_of(self.root)[0], fs.LocalFileSystem):
            raise ValueError("files are written in places only where a file system can: a local or mounted one that all executors share")
        for name, size in self.sizes.items():
            path = self._at(self.staging, "placed", _sound(name))
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.truncate(size)

    def _at(self, *parts: str) -> str:
        return store_of("/".join(parts))[1]

    def write(self, iterator) -> Written:
        store, mine, names, placed, name, out = store_of(self.root)[0], uuid.uuid4().hex, [], {}, None, None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["offset"] is not None:
                        with open(self._at(self.staging, "placed", _sound(row["name"])), "r+b") as f:
                            f.seek(row["offset"])
                            f.write(row["content"])
                        placed[row["name"]] = placed.get(row["name"], 0) + len(row["content"])
                        continue
                    if row["name"] != name:
                        if out:
                            out.close()
                        name = row["name"]
                        if name in names:
                            raise ValueError(f"rows of {name} do not follow each other")
                        path = self._at(self.staging, mine, _sound(name))
                        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = store.open_output_stream(path)
                        names.append(name)
                    out.write(row["content"])
        finally:
            if out:
                out.close()
        return Written(mine, names, placed)

    def commit(self, messages) -> None:
        store, root = store_of(self.root)
        done, found = {}, {}
        for m in messages:
            for name, n in m.placed.items():
                done[name] = done.get(name, 0) + n
            for name in m.names:
                if name in found:
                    raise ValueError(f"rows of {name} stand in several partitions")
                found[name] = m.folder
        short = [name for name, size in self.sizes.items() if done.get(name, 0) != size]
        if short:
            raise ValueError(f"not all of {short[0]} was written")
        found |= {name: "placed" for name in self.sizes}
        try:
            for name, text in self.extra.items():
                path = self._at(self.staging, "extra", _sound(name))
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(text.encode())
                found[name] = "extra"
            if self.whole:
                self._swap(store, root, found)
            else:
                for name in {*self.keep} & {*found, *self.remove}:
                    self._set_aside(store, f"{root}/{name}")
                for name, folder in found.items():
                    self._move(store, self._at(self.staging, folder, name), f"{root}/{name}")
                for name in self.remove:
                    if name not in found and self._there(store, f"{root}/{_sound(name)}"):
                        store.delete_file(f"{root}/{name}")
        finally:
            self._clear(store)

    def abort(self, messages) -> None:
        self._clear(store_of(self.root)[0])

    def _clear(self, store) -> None:
        if self._there(store, self._at(self.staging)):
            store.delete_dir(self._at(self.staging))

    @staticmethod
    def _there(store, path: str) -> bool:
        return store.get_file_info(path).type != fs.FileType.NotFound

    @staticmethod
    def _move(store, a: str, b: str) -> None:
        store.create_dir(b.rsplit("/", 1)[0], recursive=True)
        store.move(a, b)

    def _set_aside(self, store, path: str) -> None:
        """A copy of a file beside it, under the first name that is free."""
        if not self._there(store, path):
            return
        stem, dot, end = path.rpartition(".")
        n, kept = 0, f"{stem}.damaged{dot}{end}"
        while self._there(store, kept):
            n += 1
            kept = f"{stem}.damaged.{n}{dot}{end}"
        store.copy_file(path, kept)

    def _swap(self, store, root: str, found: dict) -> None:
        """The files found, and no others, become the folder root."""
        fresh, old = f"{self._at(self.staging)}/fresh", f"{self._at(self.staging)}/old"
        store.create_dir(fresh, recursive=True)
        for name, folder in found.items():
            self._move(store, self._at(self.staging, folder, name), f"{fresh}/{name}")
        if self._there(store, root):
            store.move(root, old)
        store.move(fresh, root)


class Files(DataSource):
    """Sink of (name, offset, content). Options: path; sizes (JSON, name to bytes) of the files whose rows have offsets; remove (names that
    go if no row is theirs), keep (names of which a copy stays beside them), extra (name to text), whole (the folder gets these files only)."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, offset long, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options)


def write_files(rows: DataFrame, path: str, *, sizes: dict[str, int] | None = None, remove=(), keep=(), extra: dict[str, str] | None = None, whole: bool = False) -> None:
    """rows(name, content, and offset where files are written in places) as files below path."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(Files)
    offset = F.col("offset").cast("long") if "offset" in rows.columns else F.lit(None).cast("long")
    out = rows.select("name", offset.alias("offset"), F.col("content").cast("binary").alias("content")).write.format("whole_files").mode("append").option("path", path)
    for key, value in (("sizes", sizes or {}), ("remove", list(remove)), ("keep", list(keep)), ("extra", extra or {})):
        out = out.option(key, json.dumps(value))
    out.option("whole", str(whole).lower()).save()


def write_lines(lines: DataFrame, path: str, order: list[str], head: str = "", **options) -> None:
    """lines(name, line, ...) as text files, each in the order of some columns; a name's lines are sorted, not held, in one task."""
    first = lines.select("name").distinct().select("name", F.lit(head).alias("content"), F.lit(0).alias("_part"), *(F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order))
    rest = lines.select("name", F.col("line").alias("content"), F.lit(1).alias("_part"), *order)
    both = first.unionByName(rest) if head else rest
    write_files(both.repartition("name").sortWithinPartitions("name", "_part", *order).select("name", "content"), path, **options)
