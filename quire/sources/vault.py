"""The "notes" data source: a vault of Markdown files, read, watched and written.

A vault is a folder of any store that pyarrow opens. Each version of it is a
folder of whole files, and the numbered files of `_versions` say which folder a
version is: one is made in a single step at commit, so readers see whole
versions only. A vault without `_versions` is its own only version, as with
folders that another program fills.

    vault.save(df, root, expected=3)
    vault.load(spark, root).filter("folder = '01_Literature'")
    spark.readStream.format("notes").option("log", log).load(root)

* read: path, folder, text, size, mtime (ns), by path in no order. Comparisons
  of `folder` with values are pushed down: other folders aren't listed. Files
  are dealt over tasks by bytes, and each is read by its task only. `version`
  asks for an older version. Option `glob` names the files; the default is
  `*.md`. Files that aren't UTF-8 have a null text; hidden files and folders
  are left out.
* stream: every new or changed file once, by (path, mtime, size). What was seen
  is kept in numbered files under `log`, a folder that outlives the query.
* write: rows (path, text) become files of a new version, a null text an empty
  one. Tasks write files whole, under a name of their attempt, and report
  counts; the commit compares the version that stands with `expected`, if given,
  and fails if they differ or if another writer was first. A failed or late job
  removes its own folder; the old version stays. A path that isn't relative and
  in its shortest form, or that leaves the folder, fails the job, and so do two rows of one path, which `save`
  brings into one task.

The driver lists names and sizes, as Spark's own file sources do, and never texts.
"""

from __future__ import annotations

import fnmatch
import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, folder string, text string, size bigint, mtime bigint"
ARROW = pa.schema([("path", pa.string()), ("folder", pa.string()), ("text", pa.string()), ("size", pa.int64()), ("mtime", pa.int64())])
VERSIONS = "_versions"
PART_BYTES = 32 << 20
BATCH_BYTES = 8 << 20


class VersionConflict(Exception):
    """The version that stands isn't the expected one, or another writer was first."""


def opened(root: str) -> tuple[stores.FileSystem, str]:
    """The store of a path and the path in it."""
    if "://" in root or root.startswith("file:"):
        return stores.FileSystem.from_uri(root.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1).rstrip("/"))
    return stores.LocalFileSystem(), os.path.abspath(root)


def versions(fs: stores.FileSystem, root: str) -> list[int]:
    found = fs.get_file_info(stores.FileSelector(f"{root}/{VERSIONS}", allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))


def publish(fs: stores.FileSystem, root: str, version: int, content: dict) -> None:
    """Makes the file of a version unless it exists: one writer of several wins.

    Local and mounted stores link a whole file into place; HDFS refuses to
    rename onto one. Stores with neither are refused.
    """
    if not isinstance(fs, (stores.LocalFileSystem, stores.HadoopFileSystem)):
        raise ValueError(f"{fs.type_name} can't make a file only if it doesn't exist")
    fs.create_dir(f"{root}/{VERSIONS}")
    final, temporary = f"{root}/{VERSIONS}/{version:012d}.json", f"{root}/{VERSIONS}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(json.dumps(content).encode())
    try:
        if isinstance(fs, stores.LocalFileSystem):
            os.link(temporary, final)
        else:
            fs.move(temporary, final)
    except OSError as e:
        if fs.get_file_info(final).type == stores.FileType.NotFound:
            raise
        raise VersionConflict(f"version {version} was made by another writer") from e
    finally:
        if fs.get_file_info(temporary).type != stores.FileType.NotFound:
            fs.delete_file(temporary)


def content(fs: stores.FileSystem, root: str, version: int) -> dict:
    with fs.open_input_stream(f"{root}/{VERSIONS}/{version:012d}.json") as f:
        return json.loads(f.read())


@dataclass
class Files(InputPartition):
    """Files of one task: (path below the vault, size, mtime)."""

    base: str
    files: list[tuple[str, int, int]]


class Vault:
    """Listing and reading, shared by batches and streams."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.glob = options.get("glob", "*.md")
        self.version = options.get("version")

    def base(self, fs: stores.FileSystem, root: str) -> str:
        """The folder of the version that is read."""
        known = versions(fs, root)
        if self.version is None and not known:
            return root
        wanted = known[-1] if self.version is None else int(self.version)
        if wanted not in known:
            raise ValueError(f"{self.root} has no version {wanted}")
        return f"{root}/{content(fs, root, wanted)['folder']}"

    def listed(self, folders: set[str] | None = None) -> tuple[str, list[tuple[str, int, int]]]:
        fs, root = opened(self.root)
        base = self.base(fs, root)
        tops = fs.get_file_info(stores.FileSelector(base)) if folders is None else fs.get_file_info([f"{base}/{f}" for f in sorted(folders) if f and "/" not in f and f != ".."])
        out = []
        for top in tops:
            if top.base_name.startswith(".") or top.base_name == VERSIONS:
                continue
            if top.type == stores.FileType.Directory:
                out += fs.get_file_info(stores.FileSelector(top.path, recursive=True))
            elif folders is None:
                out.append(top)
        rel = lambda f: posixpath.relpath(f.path, base)
        shown = lambda p: not any(s.startswith(".") for s in p.split("/"))
        return base, sorted((rel(f), f.size, f.mtime_ns) for f in out if f.type == stores.FileType.File and fnmatch.fnmatchcase(f.base_name, self.glob) and shown(rel(f)))

    def dealt(self, base: str, files: list[tuple[str, int, int]]) -> list[Files]:
        """Neighbouring files in parts of about PART_BYTES."""
        parts, room = [], 0
        for f in files:
            if room <= 0:
                parts.append(Files(base, []))
                room = PART_BYTES
            parts[-1].files.append(f)
            room -= f[1] + 4096
        return parts

    def rows(self, part: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        held, size = [], 0
        for path, n, mtime in part.files:
            with fs.open_input_stream(f"{part.base}/{path}") as f:
                raw = f.read()
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = None
            held.append((path, path.split("/")[0] if "/" in path else "", text, n, mtime))
            size += n
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.vault, self.folders = Vault(options), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the folders that are asked for by value; the rest is Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("folder",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                # files beside the folders are in folder '', which isn't listed alone
                if "" not in asked:
                    self.folders = asked if self.folders is None else self.folders & asked
                    continue
            yield f

    def partitions(self) -> list[Files]:
        return self.vault.dealt(*self.vault.listed(self.folders)) or [Files("", [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.vault.rows(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets count the files of the log; each of them lists what was new."""

    def __init__(self, options: dict):
        self.vault, self.log = Vault(options), options["log"]

    def initialOffset(self) -> dict:
        return {"seen": 0}

    def latestOffset(self) -> dict:
        fs, log = opened(self.log)
        known = versions(fs, log)
        seen = {tuple(e) for v in known for e in content(fs, log, v)["files"]}
        base, files = self.vault.listed()
        new = [f for f in files if f not in seen]
        last = known[-1] if known else 0
        if new:
            last += 1
            publish(fs, log, last, {"base": base, "files": new})
        return {"seen": last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        fs, log = opened(self.log)
        parts = []
        for v in range(start["seen"] + 1, end["seen"] + 1):
            c = content(fs, log, v)
            parts += self.vault.dealt(c["base"], [tuple(f) for f in c["files"]])
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.vault.rows(partition)


def _files(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Buffer | bytes]]:
    """Paths and bytes of the texts of a batch, which are not copied; nulls are empty."""
    for path, text in zip(batch.column("path"), batch.column("text")):
        yield path.as_py() or "", text.as_buffer() or b""


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class Writer(DataSourceArrowWriter):
    """Takes Arrow batches, and from them one text at a time: a batch never becomes rows of Python."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("a vault keeps its versions: write in mode append")
        if not {"path", "text"} <= set(schema.fieldNames()):
            raise ValueError("rows of a vault have a path and a text")
        self.root, self.expected = options["path"], options.get("expected")
        self.folder = f"v-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.root)
        base, attempt, n, size, made = f"{root}/{self.folder}", uuid.uuid4().hex, 0, 0, set()
        names: set[str] = set()
        for path, raw in (row for batch in iterator for row in _files(batch)):
            if path != posixpath.normpath(path) or path in (".", "..") or path.startswith(("/", "../")) or "\0" in path:
                raise ValueError(f"not a path below the vault: {path!r}")
            if path in names:
                raise ValueError(f"two rows of {path!r}")
            names.add(path)
            parent = posixpath.dirname(path)
            if parent not in made:
                fs.create_dir(f"{base}/{parent}")
                made.add(parent)
            # whole or not at all, and the same file again if the task is run twice
            temporary = f"{base}/{parent}/.{attempt}"
            with fs.open_output_stream(temporary) as f:
                f.write(raw)
            try:
                fs.move(temporary, f"{base}/{path}")
            except OSError:  # a store that keeps the file of an earlier attempt
                if fs.get_file_info(f"{base}/{path}").type != stores.FileType.File:
                    raise
                fs.delete_file(temporary)
            n, size = n + 1, size + len(raw)
        return Written(n, size)

    def commit(self, messages: list) -> None:
        fs, root = opened(self.root)
        known = versions(fs, root)
        stands = known[-1] if known else 0
        try:
            if self.expected is not None and int(self.expected) != stands:
                raise VersionConflict(f"version {stands} stands, not {self.expected}")
            fs.create_dir(f"{root}/{self.folder}")
            done = [m for m in messages if m]
            publish(fs, root, stands + 1, {"folder": self.folder, "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)})
        except BaseException:
            self.abort(messages)
            raise

    def abort(self, messages: list) -> None:
        fs, root = opened(self.root)
        known = versions(fs, root)
        if known and content(fs, root, known[-1]).get("folder") == self.folder:
            return  # it stands; what failed came after
        if fs.get_file_info(f"{root}/{self.folder}").type != stores.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.folder}")


class Notes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """A session that knows the source and pushes filters down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Notes)
    return spark


def load(spark: SparkSession, root: str, **options: str) -> DataFrame:
    return registered(spark).read.format("notes").options(**options).load(root)


def watch(spark: SparkSession, root: str, log: str, **options: str) -> DataFrame:
    return registered(spark).readStream.format("notes").options(log=log, **options).load(root)


def save(df: DataFrame, root: str, expected: int | None = None) -> None:
    """Writes rows (path, text) as the next version; with `expected`, only after that one."""
    registered(df.sparkSession)
    out = df.select("path", "text").repartition("path").write.format("notes").mode("append")
    (out if expected is None else out.option("expected", expected)).save(root)


def described(root: str, version: int | None = None) -> dict:
    """What a version, the last one by default, says of itself: folder, files, bytes."""
    fs, below = opened(root)
    return content(fs, below, version or versions(fs, below)[-1])


def folder(root: str, version: int | None = None) -> str:
    """The folder of a version, the last one by default, for Spark's own file sources."""
    return f"{root.rstrip('/')}/{described(root, version)['folder']}"
