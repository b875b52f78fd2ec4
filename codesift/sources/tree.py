"""A folder tree as a Spark data source: every name is seen, ignored folders are never listed.

Spark's own readers leave out names that begin with ``_`` and list all folders
before any filter.  This source lists on the executors: the planner opens
folders level by level, without those that are ignored, until there are enough
of them for the cluster; then each task walks its own and reads what passes.
Comparisons of size and extension are pushed down to the walk, so files that
they rule out are never opened.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from codesift.sources.files import MAX_BYTES, ignore_rules

NAME = "codesift_tree"
#: extension: in lower case, with its point; content is null where a file is not UTF-8 or could not be opened, and then error says why.
SCHEMA = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("extension", pa.string()), ("content", pa.large_string()), ("readable", pa.bool_()), ("error", pa.string())])
DDL = "path string, size long, modified timestamp, extension string, content string, readable boolean, error string"
#: Bytes of content, and files, in a batch.
BATCH_BYTES, BATCH_FILES = 8 << 20, 1_000
#: Levels of folders that the planner opens at most.
PLANNED_LEVELS = 4
#: Schemes that are other names of those that the file systems know.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs"}


@dataclass
class Folder(InputPartition):
    """A folder below the root; shallow: only the files that stand in it."""

    path: str
    shallow: bool


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    found = re.match(r"([A-Za-z][\w+.-]*):/", uri)
    if not found:
        return fs.LocalFileSystem(), uri
    if found[1] == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(SCHEMES.get(found[1], found[1]) + uri[len(found[1]) :])


def readable_by_tree(uri: str) -> bool:
    """Whether this source can open a path; Spark's readers know more kinds of stores."""
    try:
        system, path = opened(uri)
        return system.get_file_info(path).type != fs.FileType.NotFound
    except (pa.ArrowException, OSError, ValueError, ImportError):
        return False


class Walk:
    """What is listed, opened and read below a root."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/") or "/"
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.max_bytes = int(options.get("maxbytes", MAX_BYTES))
        rules = ignore_rules(json.loads(options.get("ignore", "[]")))
        self.rules = [(re.compile(e), back) for e, back in rules]
        self.sizes: list[tuple[str, int]] = []
        self.extensions: set[str] | None = None
        self._opened: tuple[fs.FileSystem, str] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_opened": None}

    @property
    def system(self) -> fs.FileSystem:
        if self._opened is None:
            self._opened = opened(self.root)
        return self._opened[0]

    @property
    def base(self) -> str:
        _ = self.system
        return self._opened[1].rstrip("/")

    def ignored(self, relative: str) -> bool:
        last = False
        for expression, back in self.rules:
            if expression.search(relative):
                last = not back
        return last

    def pruned(self, relative: str) -> bool:
        """Whether a folder is not listed.  As in ignore files, no later pattern takes back a file of an ignored folder."""
        name = relative.rsplit("/", 1)[-1]
        return name.startswith(".") and not self.hidden or self.ignored(relative + "/")

    def listed(self, relative: str) -> tuple[list[str], list[fs.FileInfo]]:
        """The folders (relative, to be walked) and the files of a folder; one that cannot be listed, or is gone, has none.  A file is its own only file."""
        try:
            if not relative and (alone := self.system.get_file_info(self.base or "/")).type == fs.FileType.File:
                return [], [alone] if self.wanted(alone.base_name, alone) else []
            found = self.system.get_file_info(fs.FileSelector(f"{self.base}/{relative}".rstrip("/") or "/", allow_not_found=True))
        except OSError:
            return [], []
        below = lambda i: f"{relative}/{i.base_name}" if relative else i.base_name
        folders = sorted(below(i) for i in found if i.type == fs.FileType.Directory and not self.pruned(below(i)))
        return folders, sorted((i for i in found if i.type == fs.FileType.File and self.wanted(below(i), i)), key=lambda i: i.base_name)

    def wanted(self, relative: str, info: fs.FileInfo) -> bool:
        if info.base_name.startswith(".") and not self.hidden or not 0 < info.size <= self.max_bytes or self.ignored(relative):
            return False
        if self.extensions is not None and extension(info.base_name) not in self.extensions:
            return False
        return all({"<": info.size < n, "<=": info.size <= n, ">": info.size > n, ">=": info.size >= n, "=": info.size == n}[sign] for sign, n in self.sizes)

    def push(self, f: Filter) -> bool:
        """Takes a comparison of size or extension; whether the walk answers for it alone."""
        column = getattr(f, "attribute", None)
        if column == ("size",):
            sign = {LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", EqualTo: "="}.get(type(f))
            if sign and isinstance(f.value, int):
                self.sizes.append((sign, f.value))
                return True
        if column == ("extension",) and isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.extensions = values if self.extensions is None else self.extensions & values
            return True
        return False

    def row(self, info: fs.FileInfo) -> tuple:
        name = f"{self.root}{info.path[len(self.base) :]}" if info.path.startswith(self.base) else info.path
        try:
            with self.system.open_input_stream(info.path) as stream:
                content, error = stream.read().decode("utf-8"), None
        except UnicodeDecodeError:
            content, error = None, "not UTF-8"
        except OSError as e:
            content, error = None, str(e)
        return name, info.size, info.mtime, extension(info.base_name), content, content is not None, error

    def batches(self, part: Folder) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        todo = [part.path]
        while todo:
            folders, files = self.listed(todo.pop())
            if not part.shallow:
                todo += reversed(folders)
            for info in files:
                rows.append(self.row(info))
                size += info.size
                if size >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


def extension(name: str) -> str:
    """In lower case with its point; none for names without one or that only begin with it."""
    at = name.rfind(".")
    return name[at:].lower() if at > 0 else ""


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.walk, self.wanted = Walk(options), int(options.get("partitions", "64"))

    def pushFilters(self, filters: Sequence[Filter]) -> Iterator[Filter]:
        return (f for f in filters if not self.walk.push(f))

    def partitions(self) -> Sequence[Folder]:
        """Folders to walk: those of a level are replaced by theirs until there are enough."""
        deep, shallow = [""], []
        for _ in range(PLANNED_LEVELS):
            if len(deep) >= self.wanted:
                break
            below = [self.walk.listed(f)[0] for f in deep]
            if not any(below):
                break
            shallow += deep
            deep = [x for folders in below for x in folders]
        return [*(Folder(f, False) for f in deep if f not in shallow), *(Folder(f, True) for f in shallow)] or [Folder("", False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.walk.batches(partition)


class TreeSource(DataSource):
    """Options: path; hidden (names with a point, false); ignore (lines of an ignore file, as JSON); maxBytes; partitions (folders to plan, about)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark: SparkSession, root: str, ignore: Sequence[str] = (), hidden: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, size, modified, extension, content, readable and error of the files below a folder, or of one file.

    ``ignore``: lines as in ignore files, on paths below the root.  Empty files
    and those over ``max_bytes`` are left out, as are, unless ``hidden``, names
    that begin with a point.  A file that is not UTF-8 or cannot be opened has
    no content and says why; a folder that cannot be listed has no files.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    options = {"ignore": json.dumps(list(ignore)), "hidden": str(hidden).lower(), "maxBytes": str(max_bytes), "partitions": str(2 * spark.sparkContext.defaultParallelism)}
    return spark.read.format(NAME).options(**options).load(root)
