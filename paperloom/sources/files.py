"""Data sources of this library: archives of files, read whole or by their beginnings, and exports
of one file a row.

Both work on any file system that pyarrow knows by its address (local, hdfs, s3, gs). Workers must
be able to import this package. ``archive.read_archive`` and ``archive.write_files`` use them.
"""

from __future__ import annotations

import json
import os
import re
import stat
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_AT_ONCE = 8 << 20  # bytes of files in one batch of rows, unless one file has more


def _opened(address: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what goes before the path in an address."""
    local = re.sub("^file:(//)?", "", address)
    if "://" not in local:
        return fs.LocalFileSystem(), local.rstrip("/") or "/", "file:"
    system, path = fs.FileSystem.from_uri(address)
    return system, path.rstrip("/"), address[: address.index(path)] if path in address else address.split("://")[0] + "://"


def put_file(system: fs.FileSystem, folder: str, name: str, body: bytes) -> None:
    """A small file, there as a whole or not at all; one that is there is replaced."""
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/.{name}") as f:
        f.write(body)
    system.move(f"{folder}/.{name}", f"{folder}/{name}")


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(path, whether it is a folder, bytes, microseconds of its last change) of what lies in a folder; a
    local one is read as it is listed, so a folder of any number of files takes no more memory."""
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.type in (fs.FileType.File, fs.FileType.Directory):
                yield info.path, info.type == fs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1000
        return
    with os.scandir(folder) as there:
        for entry in there:
            try:
                found = entry.stat()
            except OSError:  # gone, or a link to nowhere
                continue
            if stat.S_ISREG(found.st_mode) or stat.S_ISDIR(found.st_mode):
                yield f"{folder.rstrip('/')}/{entry.name}", stat.S_ISDIR(found.st_mode), found.st_size, found.st_mtime_ns // 1000


@dataclass
class FilesPartition(InputPartition):
    """Files by (path, bytes, microseconds), packed: the driver holds all partitions at once."""

    address: str
    packed: bytes

    @classmethod
    def of(cls, address: str, files: list[tuple[str, int, int]]) -> FilesPartition:
        return cls(address, zlib.compress(json.dumps(sorted(files)).encode(), 6))

    def files(self) -> list[tuple[str, int, int]]:
        return [tuple(x) for x in json.loads(zlib.decompress(self.packed))]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.addresses = json.loads(options["addresses"])
        self.recursive = options.get("recursive", "false") == "true"
        self.prefix = int(options["prefix"]) if "prefix" in options else None
        self.with_content = options.get("content", "true") == "true"
        self.task_bytes, self.task_files = int(options.get("taskBytes", 64 << 20)), int(options.get("taskFiles", 4096))

    def _found(self, system: fs.FileSystem, path: str, head: str, listed: set, single: set) -> Iterator[tuple[str, int, int]]:
        """Files at an address, without those of folders ``listed`` before and of ``single`` files."""
        top = system.get_file_info(path)
        if top.type == fs.FileType.File:
            if not top.base_name.startswith(".") and (head, path) not in single and (head, os.path.dirname(path)) not in listed:
                single.add((head, path))
                yield path, top.size, (top.mtime_ns or 0) // 1000
        folders = [path] if top.type == fs.FileType.Directory else []
        while folders:
            folder = folders.pop()
            is_new, below = (head, folder) not in listed, []
            listed.add((head, folder))
            for inside, is_folder, size, changed in _entries(system, folder):
                if os.path.basename(inside).startswith("."):
                    continue
                if is_folder:
                    below.append(inside)
                elif is_new and (head, inside) not in single:
                    yield inside, size, changed
            if self.recursive:
                folders += sorted(below, reverse=True)

    def partitions(self) -> list[FilesPartition]:
        out, listed, single = [], set(), set()
        for address in self.addresses:
            system, path, head = _opened(address)
            held: list[tuple[str, int, int]] = []
            size = 0
            for file in self._found(system, path, head, listed, single):
                held.append(file)
                size += min(file[1], self.prefix if self.prefix is not None else file[1]) if self.with_content else 0
                if size >= self.task_bytes or len(held) >= self.task_files:
                    out.append(FilesPartition.of(address, held))
                    held, size = [], 0
            if held:
                out.append(FilesPartition.of(address, held))
        return out or [FilesPartition.of("", [])]

    def read(self, partition: FilesPartition) -> Iterator[pa.RecordBatch]:
        files = partition.files()
        if not files:
            return
        system, _, head = _opened(partition.address)
        rows, held = [], 0
        for path, size, changed in files:
            content, error, shown = None, None, path
            try:
                path.encode()
            except UnicodeEncodeError:
                error, shown = "its name is no UTF-8", os.fsencode(path).decode(errors="replace")
            if self.with_content and error is None:
                try:
                    with system.open_input_stream(path) as f:  # read from the start, and no further than asked
                        content = f.read(self.prefix) if self.prefix is not None else f.read()
                except OSError as e:
                    error = str(e)
            rows.append((f"{head}{shown}", changed, size, content, error))
            held += len(content or b"")
            if held >= _AT_ONCE or len(rows) >= 1024:
                yield _files_batch(rows)
                rows, held = [], 0
        if rows:
            yield _files_batch(rows)


_FILES = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


def _files_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FILES)], schema=_FILES)


class ArchiveSource(DataSource):
    """Files of folders and single files, each path once, hidden names (beginning with a dot) left out.

    Options: ``addresses`` (a JSON list), ``recursive``, ``prefix`` (bytes to read of each file),
    ``content`` (false: list only), ``taskBytes`` and ``taskFiles`` (of a partition). A file that
    cannot be read has its ``error`` and no content, and the run goes on."""

    @classmethod
    def name(cls) -> str:
        return "paperloom-archive"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long, content binary, error string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


@dataclass
class FilesWritten(WriterCommitMessage):
    staged: str
    written: int
    failed: int


class ExportsWriter(DataSourceArrowWriter):
    """Rows (format string, name string, body binary): a file ``<folder>/<format>/<name>`` each.

    A task writes into a staging folder of its attempt; the commit lists the attempts that succeeded,
    for ``place`` to move their files, and an abort removes the staging folder, so no attempt that
    failed or was repeated leaves a file."""

    def __init__(self, options: dict[str, str]):
        self.address, self.mode = options["path"], options.get("collision", "refuse")
        self.staging = options.get("staging") or new_staging()
        if self.mode not in ("refuse", "replace"):
            raise ValueError(f"collision is refuse or replace, not {self.mode}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FilesWritten:
        system, folder, _ = _opened(self.address)
        task = TaskContext.get()
        staged = f"{folder}/{self.staging}/{task.partitionId()}-{task.taskAttemptId()}"
        failures, seen, written, made = [], set(), 0, set()
        for batch in iterator:
            for kind, name, body in zip(*(batch.column(c).to_pylist() for c in ("format", "name", "body"))):
                reason = _refusal(kind, name, body)
                if reason is None and (kind, name) in seen:
                    reason = "the name was given twice"
                if reason is None:
                    reason = self._put(system, folder, staged, kind, name, body, made)
                    if reason is None:
                        written += 1
                        seen.add((kind, name))
                if reason is not None:
                    failures.append(json.dumps({"format": kind, "name": name, "reason": reason}))
        system.create_dir(f"{staged}/_failures", recursive=True)
        if failures:
            with system.open_output_stream(f"{staged}/_failures/part-{task.partitionId():05d}.json") as f:
                f.write("\n".join(failures).encode())
        return FilesWritten(staged, written, len(failures))

    def _put(self, system: fs.FileSystem, folder: str, staged: str, kind: str, name: str, body: bytes, made: set[str]) -> str | None:
        """Why the file could not be staged, or None."""
        target = f"{staged}/{kind}/{name}"
        try:
            if self.mode == "refuse" and system.get_file_info(f"{folder}/{kind}/{name}").type != fs.FileType.NotFound:
                return "already exists"
            if kind not in made:
                system.create_dir(f"{staged}/{kind}", recursive=True)
                made.add(kind)
            with system.open_output_stream(target) as f:
                f.write(body)
        except OSError as e:
            try:
                system.delete_file(target)  # what was written of it
            except OSError:
                pass
            return f"not written: {os.strerror(e.errno) if e.errno else type(e).__name__}"
        return None

    def commit(self, messages: list[FilesWritten | None]) -> None:
        system, folder, _ = _opened(self.address)
        done = [os.path.basename(m.staged) for m in messages if m is not None]
        put_file(system, f"{folder}/{self.staging}", _ATTEMPTS, json.dumps(done).encode())

    def abort(self, messages: list[FilesWritten | None]) -> None:
        clear(self.address, self.staging)


_ATTEMPTS = "attempts.json"


def new_staging() -> str:
    return f".staging-{uuid.uuid4().hex}"


def attempts(address: str, staging: str) -> list[str]:
    """The attempts that a commit has listed: one a task."""
    system, folder, _ = _opened(address)
    with system.open_input_stream(f"{folder}/{staging}/{_ATTEMPTS}") as f:
        return json.loads(f.read())


def place(address: str, staging: str, run: str, attempt: str) -> None:
    """Move the files of an attempt to their places and its list of failures beside them; what an earlier
    call has moved is not there any more."""
    system, folder, _ = _opened(address)
    with ThreadPoolExecutor(16) as pool:
        for inside, *_ in list(_entries(system, f"{folder}/{staging}/{attempt}")):  # a folder a format
            kind = os.path.basename(inside)
            target = make_folder(address, f"_failures/run={run}" if kind == "_failures" else kind)
            paths = [path for path, *_ in _entries(system, inside)]
            for k in range(0, len(paths), 1024):
                list(pool.map(lambda path: system.move(path, f"{target}/{os.path.basename(path)}"), paths[k : k + 1024]))


def make_folder(address: str, name: str) -> str:
    system, folder, _ = _opened(address)
    system.create_dir(f"{folder}/{name}", recursive=True)
    return f"{folder}/{name}"


def clear(address: str, staging: str) -> None:
    system, folder, _ = _opened(address)
    if system.get_file_info(f"{folder}/{staging}").type == fs.FileType.Directory:
        system.delete_dir(f"{folder}/{staging}")


def _refusal(kind: str | None, name: str | None, body) -> str | None:
    """Why a row cannot be a file, or None."""
    for part, what in ((name, "name"), (kind, "format")):
        if part is None or not part.strip():
            return f"no {what}"
        if any(c in part for c in "/\\\0") or part in (".", "..") or part.startswith((".staging-", "_failures")):
            return f"the {what} is a path"
    return "nothing to write" if body is None else None


class ExportsSink(DataSource):
    """Options: ``path``, ``collision`` (refuse or replace existing files), ``staging`` (a folder in
    ``path`` that ``place`` takes the files from)."""

    @classmethod
    def name(cls) -> str:
        return "paperloom-files"

    def writer(self, schema: StructType, overwrite: bool) -> ExportsWriter:
        return ExportsWriter(self.options)
