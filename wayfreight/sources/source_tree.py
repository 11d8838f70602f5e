"""``source_tree``: the files of an estate as a data source that DataFrame and SQL users read by name.

    source_tree.register(spark)
    spark.read.format("source_tree").load("/mnt/apps").filter("kind = 'sql' AND path LIKE 'sql/%'")

One row a file: app_id, path, kind, size, mtime, content, error. With the option ``push``, filters on app_id,
path, kind and size go into the source: folders that cannot hold a match are not walked, and files that fail are
not opened.

Options:

- ``push`` (false): let Spark push filters. Spark keeps what it pushed with the loaded relation, and a later use of
  the same DataFrame, or a second one in the same query, would read by it. So a relation that pushes is for one
  filter: load it again for the next, as :func:`source_tree` does with each call.
- ``content`` (true): read the files. Off, the source only lists them and content is NULL.
- ``all`` (false): also files that the estate does not read (kind ``other``).
- ``listing``: a folder that :func:`wayfreight.sources.tree.save_listing` wrote. The walk, which runs where the
  query is planned, is left out then, and each row group of the listing is a partition: the way for estates
  too large to be walked from one place.
- ``folders`` (64): folders in one partition, without a listing.

A folder that cannot be listed is a row with ``error`` and no kind; a file that cannot be opened keeps its row,
with ``error`` and without content. Links to folders are not followed, but for linked applications.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from wayfreight import rules

# Readers travel by value, so that executors need no copy of this package; nor may they import from it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "app_id string, path string, kind string, size bigint, mtime double, content binary, error string"
BATCH_BYTES = 16 << 20
BATCH_ROWS = 4096
WALKERS = 16
PYTHON_SUFFIX, SQL_SUFFIX = rules.PYTHON_SUFFIX, rules.SQL_SUFFIX
REQUIREMENTS_NAME, MANIFEST_NAMES = rules.REQUIREMENTS_NAME, rules.MANIFEST_NAMES


def kind_name(path: str) -> str:
    """The same as :func:`wayfreight.sources.files.kind_of`, for one path."""
    if path.endswith(PYTHON_SUFFIX):
        return "python"
    if path.endswith(SQL_SUFFIX):
        return "sql"
    if path.rsplit("/", 1)[-1] == REQUIREMENTS_NAME:
        return "requirements"
    return "manifest" if path in MANIFEST_NAMES else "other"


# --- pushed filters --------------------------------------------------------------------------------

#: What can be decided from a listing, before a file is opened.
LISTED = ("app_id", "path", "kind", "size")
COMPARED = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
}


def decidable(one: Filter) -> bool:
    if isinstance(one, Not):
        return decidable(one.child)
    known = isinstance(one, (IsNull, IsNotNull, EqualNullSafe)) or type(one) in COMPARED
    return known and one.attribute[0] in LISTED and len(one.attribute) == 1


def verdict(one: Filter, row: dict) -> bool | None:
    """True, false, or None where SQL has NULL."""
    if isinstance(one, Not):
        inner = verdict(one.child, row)
        return None if inner is None else not inner
    value = row[one.attribute[0]]
    if isinstance(one, IsNull):
        return value is None
    if isinstance(one, IsNotNull):
        return value is not None
    if isinstance(one, EqualNullSafe):
        return value == one.value
    return None if value is None else COMPARED[type(one)](value, one.value)


def apps_named(filters: list[Filter]) -> set[str] | None:
    """The only applications that can match, if the filters name them."""
    named = None
    for one in filters:
        if isinstance(one, (EqualTo, In)) and one.attribute == ("app_id",):
            wanted = set(one.value) if isinstance(one, In) else {one.value}
            named = wanted if named is None else named & wanted
    return named


def may_hold(filters: list[Filter], app_id: str, folder: str) -> bool:
    """Whether a file below this folder can match, as far as application and start of the path tell."""
    for one in filters:
        if isinstance(one, (EqualTo, In, StringStartsWith)):
            wanted = one.value if isinstance(one, In) else (one.value,)
            whole = not isinstance(one, StringStartsWith)
            if one.attribute == ("app_id",):
                if not any(app_id == w if whole else app_id.startswith(w) for w in wanted):
                    return False
            elif one.attribute == ("path",) and folder:
                below = f"{folder}/"
                if not any(w.startswith(below) or (not whole and below.startswith(w)) for w in wanted):
                    return False
    return True


# --- listing and reading ---------------------------------------------------------------------------


class Tree:
    """A root on a mounted or remote file system."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.remote = "://" in root
        self.where, self.base = fs.FileSystem.from_uri(root) if self.remote else (fs.LocalFileSystem(), root)

    def at(self, *parts: str) -> str:
        return "/".join(p for p in (self.base, *parts) if p)

    def children(self, app_id: str, folder: str) -> Iterator[tuple[str, bool, int | None, float | None]]:
        """(name, whether a folder, size, mtime) of what a folder holds; nothing of it is kept."""
        import os

        if self.remote:
            from pyarrow import fs

            for info in self.where.get_file_info(fs.FileSelector(self.at(app_id, folder))):
                is_dir = info.type == fs.FileType.Directory
                yield info.base_name, is_dir, None if is_dir else info.size, info.mtime and info.mtime.timestamp()
            return
        with os.scandir(self.at(app_id, folder)) as found:
            for entry in found:
                if entry.is_dir():
                    # A linked application is one; links further down could lead in a circle.
                    if not app_id or not entry.is_symlink():
                        yield entry.name, True, None, None
                    continue
                try:
                    stat = entry.stat()
                    yield entry.name, False, stat.st_size, stat.st_mtime
                except OSError:
                    yield entry.name, False, None, None

    def read(self, app_id: str, path: str) -> bytes:
        with self.where.open_input_stream(self.at(app_id, path), compression=None) as source:
            return source.read()


@dataclass
class Folders(InputPartition):
    """Folders, (application, path), that a task lists and reads."""

    folders: list[tuple[str, str]]


@dataclass
class Listed(InputPartition):
    """One row group of a saved listing."""

    file: str
    group: int


class SourceTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        def on(name: str, default: str) -> bool:
            return str(options.get(name, default)).strip().lower() == "true"

        if not options.get("path"):
            raise ValueError("source_tree needs a path: the folder that holds the applications")
        self.root = plain_root(options["path"])
        self.content, self.all, self.push = on("content", "true"), on("all", "false"), on("push", "false")
        self.listing = plain_root(options["listing"]) if options.get("listing") else None
        self.per_task = max(1, int(options.get("folders", "64")))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if self.push and decidable(one):
                self.filters.append(one)
            else:
                yield one

    # Where the query is planned.

    def partitions(self) -> list[InputPartition]:
        if self.listing is not None:
            return self._listed()
        folders = self._walked()
        return [Folders(folders[k : k + self.per_task]) for k in range(0, len(folders), self.per_task)] or [Folders([])]

    def _listed(self) -> list[InputPartition]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        tree = Tree(self.listing)
        found = tree.where.get_file_info(fs.FileSelector(tree.base, recursive=True))
        parts: list[InputPartition] = []
        for file in sorted(f.path for f in found if f.path.endswith(".parquet")):
            with tree.where.open_input_file(file) as source:
                parts += [Listed(file, g) for g in range(pq.ParquetFile(source).metadata.num_row_groups)]
        return parts or [Folders([])]

    def _walked(self) -> list[tuple[str, str]]:
        """All folders that may hold a match, depth by depth; a folder that cannot be listed is left to its task."""
        from concurrent.futures import ThreadPoolExecutor

        tree, named = Tree(self.root), apps_named(self.filters)

        def below(at: tuple[str, str]) -> list[tuple[str, str]]:
            app_id, folder = at
            try:
                names = [name for name, is_dir, _, _ in tree.children(app_id, folder) if is_dir]
            except OSError:
                if not app_id:
                    raise  # the root itself
                return []
            inner = [(app_id, f"{folder}/{n}" if folder else n) if app_id else (n, "") for n in names]
            return [f for f in inner if may_hold(self.filters, *f) and (named is None or f[0] in named)]

        with ThreadPoolExecutor(WALKERS) as walkers:
            depth = below(("", ""))
            folders = list(depth)
            while depth:
                depth = [f for inner in walkers.map(below, depth) for f in inner]
                folders += depth
        return folders

    # In tasks.

    def read(self, partition: InputPartition):
        import pyarrow as pa

        schema = pa.schema(
            [("app_id", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("content", pa.binary()), ("error", pa.string())]
        )
        tree = Tree(self.root)
        rows, held = [], 0
        for row in self._rows(tree, partition):
            if any(verdict(one, row) is not True for one in self.filters):
                continue
            if self.content and row["error"] is None:
                try:
                    row["content"] = tree.read(row["app_id"], row["path"])
                    held += len(row["content"])
                except OSError as problem:
                    row["error"] = type(problem).__name__
            rows.append(row)
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _rows(self, tree: Tree, partition: InputPartition) -> Iterator[dict]:
        if isinstance(partition, Listed):
            yield from self._saved_rows(partition)
            return
        for app_id, folder in partition.folders:
            try:
                for name, is_dir, size, mtime in tree.children(app_id, folder):
                    path = f"{folder}/{name}" if folder else name
                    kind = kind_name(path)
                    if not is_dir and (self.all or kind != "other"):
                        yield {"app_id": app_id, "path": path, "kind": kind, "size": size, "mtime": mtime, "error": None}
            except OSError as problem:
                yield {"app_id": app_id, "path": folder, "kind": None, "size": None, "mtime": None, "error": type(problem).__name__}

    def _saved_rows(self, part: Listed) -> Iterator[dict]:
        import pyarrow.parquet as pq

        with Tree(self.listing).where.open_input_file(part.file) as source:
            for row in pq.ParquetFile(source).read_row_group(part.group).to_pylist():
                kind = None if row["error"] else kind_name(row["path"])
                if row["error"] or (not row["is_dir"] and (self.all or kind != "other")):
                    yield {k: row[k] for k in ("app_id", "path", "size", "mtime", "error")} | {"kind": kind}


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(self.options)


def plain_root(root: str) -> str:
    """The root as pyarrow takes it: ``file:`` URIs as plain paths, Hadoop's ``s3a`` as ``s3``."""
    if root.startswith("file:"):
        return "/" + root[len("file:"):].lstrip("/")
    return ("s3://" + root[len("s3a://"):] if root.startswith("s3a://") else root).rstrip("/")


def register(spark: SparkSession) -> None:
    """Make the source known to the session. Spark asks Python sources about filters only with the setting made here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)


def source_tree(spark: SparkSession, root: str, where: Column | str | None = None, content: bool = True, **options: str) -> DataFrame:
    """The files below ``root/<application>/`` that ``where`` selects; see the module for options.

    Each call loads the tree anew, so that what is pushed for one ``where`` never holds for another.
    """
    register(spark)
    chosen = {"content": str(content).lower(), "push": str(where is not None).lower(), **options}
    files = spark.read.format("source_tree").options(**chosen).load(root)
    return files if where is None else files.filter(where)
