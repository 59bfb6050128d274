"""SRC-01, SRC-02: .docx files as a data source: ``spark.read.format("docx").load(path)`` and ``spark.readStream.format("docx").load(path)`` after :func:`register`.

Option ``part`` is ``paragraphs`` (path, ord, text, bold, error) or ``cells`` (path, ord, text, error: what the first tables hold). Files are dealt to partitions by size, so a task has at most ``bytes_per_task`` or one file.
Conditions on ``path`` are answered by the listing: files they exclude aren't opened. A stream takes files by their time of change; those younger than ``settle`` seconds wait for the next batch, so
none is missed. Paths are those that Arrow's file systems open (local folders, HDFS, S3).
"""

from __future__ import annotations

import time
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .readers import docx_header, docx_paragraphs

SCHEMAS = {"paragraphs": "path string, ord int, text string, bold boolean, error string", "cells": "path string, ord int, text string, error string"}
BYTES_PER_TASK = 64 << 20
PathFilter = EqualTo | In | StringContains | StringEndsWith | StringStartsWith


@dataclass
class Files(InputPartition):
    """Files of one task."""

    names: tuple[str, ...]


@dataclass(frozen=True)
class Found:
    name: str
    size: int
    changed: int  # microseconds


def listed(path: str) -> list[Found]:
    """All .docx files below ``path``, by name."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((Found(f.path, f.size, f.mtime_ns // 1000) for f in found if f.is_file and f.base_name.endswith(".docx") and not f.base_name.startswith("~")), key=lambda f: f.name)


def dealt(files: list[Found], limit: int) -> list[Files]:
    """Neighbouring files up to ``limit`` bytes a task."""
    out: list[list[str]] = []
    held = 0
    for f in files:
        if not out or held + f.size > limit:
            out.append([])
            held = 0
        out[-1].append(f.name)
        held += f.size
    return [Files(tuple(x)) for x in out]


def accepts(name: str, condition: PathFilter) -> bool:
    value = condition.value
    if isinstance(condition, EqualTo):
        return name == value
    if isinstance(condition, In):
        return name in value
    return {StringContains: str.__contains__, StringEndsWith: str.endswith, StringStartsWith: str.startswith}[type(condition)](name, value)


def rows_of(path: str, part: str, names: tuple[str, ...]) -> Iterator[tuple]:
    from pyarrow import fs

    store = fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()
    for name in names:
        with store.open_input_file(name) as file:
            content = file.read()
        try:
            if part == "paragraphs":
                yield from ((name, k, text, bold, None) for k, (text, bold) in enumerate(docx_paragraphs(content)))
            else:
                yield from ((name, k, text, None) for k, text in enumerate(docx_header(content)))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            yield (name, None, None, None, repr(e)) if part == "paragraphs" else (name, None, None, repr(e))


class _Options:
    def __init__(self, options: dict):
        self.path, self.part = options["path"], options.get("part", "paragraphs")
        self.limit, self.settle = int(options.get("bytes_per_task", BYTES_PER_TASK)), float(options.get("settle", 1))


class DocxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = _Options(options)
        self.conditions: list[PathFilter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, PathFilter) and f.attribute == ("path",):
                self.conditions.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        files = [f for f in listed(self.options.path) if all(accepts(f.name, c) for c in self.conditions)]
        return dealt(files, self.options.limit) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.options.path, self.options.part, partition.names)


class DocxStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = _Options(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        old = (time.time() - self.options.settle) * 1e6
        return {"changed": max((f.changed for f in listed(self.options.path) if f.changed <= old), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt([f for f in listed(self.options.path) if start["changed"] < f.changed <= end["changed"]], self.options.limit) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.options.path, self.options.part, partition.names)


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "paragraphs")]

    def reader(self, schema: StructType) -> DocxReader:
        return DocxReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DocxStream:  # noqa: N802
        return DocxStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known, and let conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocxSource)
