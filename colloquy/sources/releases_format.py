"""Releases as Spark data sources.

    spark.read.format("manifest").option("split", "train").load(uri)     rows of a release, in manifest order
    spark.readStream.format("manifest").load(root)                       rows of every version that appears below a root
    df.write.format("release").mode("append").options(...).save(folder)  rows, then the manifest, last and once

Call ``register`` once a session. Scans are planned from the manifest alone: no job and no
footer per file. Each file is one partition or, with ``slices``, several, which share its row groups.
Tasks read in batches, so memory doesn't grow with a file. Only the columns of the schema asked for are read.

Options of a scan: ``split`` (names, by comma; all without it), ``kind`` (``sft`` or ``dpo``, the declared
columns where no schema is given), ``limit`` (the first rows of each split, in manifest and file order: files
beyond it are in no partition; row counts come from the manifest, or from the footers of files up to the
limit where it has none), ``slices`` and ``sha256`` (the digest the manifest must have).

Columns that are no file's own: ``split``, ``file_pos`` (place of the file in the manifest), ``row_index``
(place of the row in the file) and ``manifest_uri``. A schema may also name ``ordinal``, a row's number in its
split by manifest and file order; it follows from row counts, as a limit does, so nothing is ranked or joined.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.functions.policy import POLICY_CLASSES
from colloquy.schemas import DPO_REQUIRED, DPO_ROW, SFT_ROW
from colloquy.sources.arrow_rows import conformed, exists, file_system

MANIFEST = "manifest.json"
BATCH_ROWS = 2048
#: A task of the sink writes what it holds once that passes this many bytes.
HELD_BYTES = 64 << 20
FILE_ROWS = 1_000_000
FOOTERS = 32
PLACES = [
    T.StructField("split", T.StringType()),
    T.StructField("file_pos", T.LongType()),
    T.StructField("row_index", T.LongType()),
    T.StructField("manifest_uri", T.StringType()),
]
ORDINAL = "ordinal"
KINDS = {"sft": (SFT_ROW, ()), "dpo": (DPO_ROW, DPO_REQUIRED)}


def register(spark: SparkSession) -> None:
    """Makes the formats ``manifest`` and ``release`` known to a session."""
    for source in (ManifestSource, ReleaseSink):
        spark.dataSource.register(source)


def scan(spark: SparkSession, uri: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Rows of a release with their places; the module lists the options."""
    register(spark)
    reader = spark.read.format("manifest").options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(uri)


@dataclass(frozen=True)
class Entry:
    """A usable file of a manifest."""

    split: str
    uri: str
    file_pos: int
    rows: int | None


def read_entries(uri: str, sha256: str | None = None) -> list[Entry]:
    """Usable files of a manifest, in its order; a digest that differs is an error."""
    system, path = file_system(uri)
    with system.open_input_stream(path) as stream:
        body = stream.read()
    actual = hashlib.sha256(body).hexdigest()
    wanted = (sha256 or "").strip().lower()
    if wanted and wanted != actual:
        raise ValueError(f"manifest digest mismatch: expected={wanted} actual={actual}")
    manifest = json.loads(body)
    if not isinstance(manifest, dict):
        raise ValueError("manifest must be a JSON object")
    listed = manifest.get("splits")
    entries = []
    for place, item in enumerate(listed if isinstance(listed, list) else []):
        if not isinstance(item, dict):
            continue
        split, key, rows = item.get("split"), item.get("key"), item.get("rows")
        if isinstance(split, str) and isinstance(key, str):
            known = rows if isinstance(rows, int) and not isinstance(rows, bool) else None
            entries.append(Entry(split, _address(uri, key), place, known))
    return entries


def _address(manifest_uri: str, key: str) -> str:
    """Where a key lies, as ``manifest.resolve_uri`` has it for columns."""
    if "://" in key:
        return key
    scheme, mark, rest = manifest_uri.partition("://")
    if mark and scheme in ("s3", "s3a"):
        return f"s3://{rest.split('/', 1)[0]}/{key.lstrip('/')}"
    return key if key.startswith("/") else posixpath.join(posixpath.dirname(manifest_uri), key)


def _footer_rows(uri: str) -> int:
    system, path = file_system(uri)
    with system.open_input_file(path) as source:
        return pq.ParquetFile(source).metadata.num_rows


def _row_counts(entries: list[Entry]) -> Iterator[int]:
    """Rows of the files in turn; footers are read a few at a time, as they are asked for."""
    with ThreadPoolExecutor(FOOTERS) as pool:
        for start in range(0, len(entries), FOOTERS):
            part = entries[start : start + FOOTERS]
            yield from pool.map(lambda entry: _footer_rows(entry.uri) if entry.rows is None else entry.rows, part)


@dataclass
class FileSlice(InputPartition):
    """A share of a file's row groups; rows from ``stop`` on aren't wanted."""

    manifest_uri: str
    split: str
    uri: str
    file_pos: int
    slice: int
    slices: int
    stop: int | None
    before: int | None


def plan_slices(uri: str, options: dict[str, str], *, numbered: bool = False) -> list[FileSlice]:
    """Partitions of the wanted splits, up to the limit of each; ``numbered`` adds the rows before each file."""
    entries = read_entries(uri, options.get("sha256"))
    names = [name.strip() for name in options.get("split", "").split(",") if name.strip()]
    limit = int(options["limit"]) if "limit" in options else None
    slices = max(1, int(options.get("slices", "1")))
    absent = [name for name in names if name not in {entry.split for entry in entries}]
    if absent:
        raise ValueError(f"no files in manifest split {absent[0]!r}")
    planned = []
    for split in dict.fromkeys(entry.split for entry in entries):
        if names and split not in names:
            continue
        files = [entry for entry in entries if entry.split == split]
        counts = _row_counts(files) if limit is not None or numbered else None
        before = 0
        for entry in files:
            if limit is not None and before >= limit:
                break
            rows = next(counts) if counts is not None else None
            stop = limit - before if limit is not None and before + rows > limit else None
            planned += [
                FileSlice(uri, split, entry.uri, entry.file_pos, n, slices, stop, before if rows is not None else None)
                for n in range(slices)
            ]
            before += rows or 0
    return planned


def read_slice(part: FileSlice | None, schema: T.StructType, required: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of a slice in the schema's columns and types.

    A scan without partitions is run with none for the slice.
    """
    if part is None:
        return
    target = to_arrow_schema(schema)
    placed = {kind.name for kind in PLACES} | {ORDINAL}
    system, path = file_system(part.uri)
    with system.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        present = file.schema_arrow.names
        missing = sorted(set(required) - set(present))
        if missing:
            raise ValueError(f"missing required preference columns in split {part.split}: {missing}")
        groups = file.num_row_groups
        first, last = groups * part.slice // part.slices, groups * (part.slice + 1) // part.slices
        row = sum(file.metadata.row_group(n).num_rows for n in range(first))
        wanted = [name for name in target.names if name in present and name not in placed]
        # A scan of places only still needs the number of rows.
        for batch in file.iter_batches(BATCH_ROWS, row_groups=range(first, last), columns=wanted or present[:1]):
            if part.stop is not None:
                if row >= part.stop:
                    return
                batch = batch.slice(0, part.stop - row)
            n = len(batch)
            own = {
                "split": pa.repeat(pa.scalar(part.split, pa.string()), n),
                ORDINAL: pa.array(range(part.before + row, part.before + row + n), pa.int64()) if part.before is not None else pa.nulls(n, pa.int64()),
                "file_pos": pa.repeat(pa.scalar(part.file_pos, pa.int64()), n),
                "row_index": pa.array(range(row, row + n), pa.int64()),
                "manifest_uri": pa.repeat(pa.scalar(part.manifest_uri, pa.string()), n),
            }
            arrays = []
            for column in target:
                if column.name in own:
                    arrays.append(own[column.name].cast(column.type))
                elif column.name in wanted:
                    arrays.append(conformed(batch.column(column.name), column.type))
                else:
                    arrays.append(pa.nulls(n, column.type))
            yield pa.RecordBatch.from_arrays(arrays, schema=target)
            row += n


class ManifestSource(DataSource):
    """Format ``manifest``: see the module."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def _kind(self) -> tuple[T.StructType, tuple[str, ...]]:
        kind = self.options.get("kind", "sft")
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {sorted(KINDS)}")
        return KINDS[kind]

    def schema(self) -> T.StructType:
        return T.StructType(self._kind()[0].fields + PLACES)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ManifestReader(schema, dict(self.options), self._kind()[1])

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return ManifestStreamReader(schema, dict(self.options), self._kind()[1])


class ManifestReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str], required: tuple[str, ...]):
        self.schema, self.options, self.required = schema, options, required

    def partitions(self) -> list[FileSlice]:
        return plan_slices(self.options["path"], self.options, numbered=ORDINAL in self.schema.fieldNames())

    def read(self, partition: FileSlice) -> Iterator[pa.RecordBatch]:
        return read_slice(partition, self.schema, self.required)


class ManifestStreamReader(DataSourceStreamReader):
    """Versions below a root, each once: an offset is the manifests seen so far.

    A version counts from the moment its manifest is there, which is when it is complete. A batch
    is planned from two offsets alone, so that it is the same when it runs again.
    """

    def __init__(self, schema: T.StructType, options: dict[str, str], required: tuple[str, ...]):
        self.schema, self.options, self.required = schema, options, required

    def _manifests(self) -> list[str]:
        """Manifests of ``dataset_id=*/dataset_version=*`` folders, by listing folders only."""
        root = self.options["path"].rstrip("/")
        system, path = file_system(root)

        def folders(parent: str, prefix: str) -> list[str]:
            found = system.get_file_info(fs.FileSelector(parent, allow_not_found=True))
            names = [info.base_name for info in found if info.type == fs.FileType.Directory]
            return sorted(name for name in names if name.startswith(prefix))

        uris = []
        for dataset in folders(path, "dataset_id="):
            for version in folders(f"{path}/{dataset}", "dataset_version="):
                inside = f"{dataset}/{version}/{MANIFEST}"
                if system.get_file_info(f"{path}/{inside}").type == fs.FileType.File:
                    uris.append(f"{root}/{inside}")
        return uris

    def initialOffset(self) -> dict:
        return {"seen": []}

    def latestOffset(self) -> dict:
        return {"seen": self._manifests()}

    def partitions(self, start: dict, end: dict) -> list[FileSlice]:
        known = set(start["seen"])
        numbered = ORDINAL in self.schema.fieldNames()
        fresh = [uri for uri in end["seen"] if uri not in known]
        return [part for uri in fresh for part in plan_slices(uri, self.options, numbered=numbered)]

    def read(self, partition: FileSlice) -> Iterator[pa.RecordBatch]:
        return read_slice(partition, self.schema, self.required)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the checkpoint."""


@dataclass
class Written(WriterCommitMessage):
    """Files a task has finished, as (split, name inside the folder, rows), and rows by class."""

    files: list[tuple[str, str, int]] = field(default_factory=list)
    classes: dict[str, int] = field(default_factory=dict)


class ReleaseSink(DataSource):
    """Format ``release``: files by split and, once all tasks have finished, the manifest.

    Options: ``dataset_id``, ``dataset_version``, ``construction`` (JSON), ``policy_class`` (a column whose
    classes are counted), ``split_column`` and ``key_root`` (what the manifest puts before a file's name).
    """

    @classmethod
    def name(cls) -> str:
        return "release"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a version is written once")
        if exists(f"{self.options['path']}/{MANIFEST}"):
            raise ValueError(f"the version exists: {self.options['path']}")
        return ReleaseWriter(dict(self.options))


class ReleaseWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.folder = options["path"].rstrip("/")
        self.split = options.get("split_column", "split")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One task: files of its own name by split. Files of a failed attempt are in no manifest."""
        task = TaskContext.get()
        files = _TaskFiles(self.folder, task.partitionId() if task else 0)
        classes: Counter[str] = Counter()
        counted = self.options.get("policy_class")
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            if counted:
                for item in pc.value_counts(batch.column(counted)).to_pylist():
                    name = (item["values"] or "").strip().upper()
                    if name:
                        classes[name] += item["counts"]
            splits = table.column(self.split).cast(pa.string())
            if splits.null_count:
                raise ValueError("rows without a split")
            rest = table.drop_columns([self.split])
            for name in pc.unique(splits).to_pylist():
                files.add(name, rest.filter(pc.equal(splits, name)))
        return Written(files.finish(), dict(classes))

    def commit(self, messages: list[Written | None]) -> None:
        """Every task has finished: the manifest appears whole, by a rename, from what the tasks said."""
        done = [message for message in messages if message is not None]
        files = sorted(item for message in done for item in message.files)
        totals: Counter[str] = Counter()
        classes: Counter[str] = Counter()
        for message in done:
            classes.update(message.classes)
        for split, _, rows in files:
            totals[split] += rows
        root = self.options.get("key_root", "")
        manifest = {
            "dataset_id": self.options["dataset_id"],
            "dataset_version": self.options["dataset_version"],
            "splits": [{"split": split, "key": f"{root}{name}", "rows": rows} for split, name, rows in files],
            "construction": json.loads(self.options.get("construction", "{}")),
            "stats": {**{f"{name}_rows": n for name, n in sorted(totals.items())}, "total_rows": sum(totals.values())},
        }
        if classes:
            ranks = {name: place for place, name in enumerate(POLICY_CLASSES)}
            present = sorted(classes, key=lambda name: (ranks.get(name, len(ranks)), name))
            manifest["governance"] = {
                "policy_classes_present": present,
                "policy_class_counts": {name: classes[name] for name in present},
                "max_policy_class": present[-1],
            }
        system, path = file_system(self.folder)
        system.create_dir(path, recursive=True)
        draft = f"{path}/.{MANIFEST}.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as stream:
            stream.write(json.dumps(manifest, indent=2).encode("utf-8"))
        system.move(draft, f"{path}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        """Without a manifest there is no release; files of finished tasks go."""
        system, path = file_system(self.folder)
        for message in messages:
            for _, name, _ in message.files if message is not None else ():
                if system.get_file_info(f"{path}/{name}").type == fs.FileType.File:
                    system.delete_file(f"{path}/{name}")


class _TaskFiles:
    """The files of one task: rows are held up to a bound, files end at a number of rows.

    Names begin with the task's number, so that the manifest keeps the order of sorted rows.
    """

    def __init__(self, folder: str, task: int):
        self.system, self.path = file_system(folder)
        self.task, self.attempt = task, uuid.uuid4().hex
        self.held: dict[str, list[pa.Table]] = {}
        self.bytes = 0
        self.open: dict[str, tuple[pq.ParquetWriter, str, int]] = {}
        self.number = 0
        self.done: list[tuple[str, str, int]] = []

    def add(self, split: str, rows: pa.Table) -> None:
        self.held.setdefault(split, []).append(rows)
        self.bytes += rows.nbytes
        if self.bytes > HELD_BYTES:
            self.flush()

    def flush(self) -> None:
        for split, tables in self.held.items():
            rows = pa.concat_tables(tables)
            writer, name, written = self.open.pop(split, None) or self._new(split, rows.schema)
            writer.write_table(rows)
            self.open[split] = (writer, name, written + len(rows))
            if written + len(rows) >= FILE_ROWS:
                self._close(split)
        self.held, self.bytes = {}, 0

    def _new(self, split: str, schema: pa.Schema) -> tuple[pq.ParquetWriter, str, int]:
        folder = f"split={quote(split, safe='')}"
        self.system.create_dir(f"{self.path}/{folder}", recursive=True)
        name = f"{folder}/part-{self.task:06d}-{self.number:05d}-{self.attempt}.parquet"
        self.number += 1
        return pq.ParquetWriter(f"{self.path}/{name}", schema, filesystem=self.system), name, 0

    def _close(self, split: str) -> None:
        writer, name, rows = self.open.pop(split)
        writer.close()
        self.done.append((split, name, rows))

    def finish(self) -> list[tuple[str, str, int]]:
        self.flush()
        for split in list(self.open):
            self._close(split)
        return self.done
