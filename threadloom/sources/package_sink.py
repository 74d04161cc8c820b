"""Documents as packages: a folder of three files each, visible all at once or not at all.

Every task writes into a staging folder of its own and reports what it holds.  Only the commit moves the reported folders,
one a task, below `packages` and writes the manifest that names them; what failed or repeated tasks left goes with the staging.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .log_source import _open

NAME = "document_packages"
VERSION = "1.0"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its folder, and how many packages and bytes."""

    folder: str
    packages: int
    size: int


def package_files(row: Row) -> dict[str, str]:
    """A row's files: the document as it is, its source, and a manifest with their hashes."""
    values = row.asDict()
    source = {k: values.get(k) for k in ("agent", "session_id")}
    body = {"memory.json": values["document"] or "{}", "source.json": json.dumps(source, ensure_ascii=False)}
    hashes = {name: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() for name, text in body.items()}
    manifest = {"version": VERSION, "memory_id": values["memory_id"], "files": hashes}
    return {"manifest.json": json.dumps(manifest, ensure_ascii=False), **body}


class PackageWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        self.staging = f"{self.path}/_staging-{self.job}"

    def write(self, rows: Iterator[Row]) -> Written:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        system, base = _open(f"{self.staging}/{name}")
        packages, size = 0, 0
        for row in rows:
            folder = f"{base}/{re.sub(r'[^A-Za-z0-9_.-]', '_', str(row['memory_id']))}-{packages}"
            system.create_dir(folder, recursive=True)
            for file, text in package_files(row).items():
                data = text.encode("utf-8", "surrogatepass")
                with system.open_output_stream(f"{folder}/{file}") as f:
                    f.write(data)
                size += len(data)
            packages += 1
        return Written(name if packages else "", packages, size)

    def commit(self, messages: list[Written | None]) -> None:
        good = sorted((m for m in messages if m and m.folder), key=lambda m: m.folder)
        system, base = _open(self.path)
        system.create_dir(f"{base}/packages", recursive=True)
        kept = [] if self.overwrite else _manifest(system, base)
        own = []
        for m in good:
            system.move(f"{base}/_staging-{self.job}/{m.folder}", f"{base}/packages/{self.job}-{m.folder}")
            own.append({"folder": f"{self.job}-{m.folder}", "packages": m.packages, "size": m.size})
        with system.open_output_stream(f"{base}/_manifest.new") as f:
            f.write(json.dumps({"version": VERSION, "parts": kept + own}).encode())
        system.move(f"{base}/_manifest.new", f"{base}/_manifest.json")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, staging = _open(self.staging)
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


def _manifest(system: fs.FileSystem, base: str) -> list[dict]:
    if system.get_file_info(f"{base}/_manifest.json").type != fs.FileType.File:
        return []
    with system.open_input_stream(f"{base}/_manifest.json") as f:
        return json.loads(f.read())["parts"]


class PackageSink(DataSource):
    """`df.write.format("document_packages").mode("append").save(path)` for rows of memory_id, session_id, agent, document (JSON)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        missing = {"memory_id", "document"} - set(schema.names)
        if missing:
            raise ValueError(f"packages need the columns {sorted(missing)}")
        return PackageWriter(self.options["path"], overwrite)


def packages_at(path: str) -> Iterator[str]:
    """The folders of the packages that the manifest names; those that it doesn't aren't there for readers."""
    system, base = _open(path)
    for part in _manifest(system, base):
        for info in system.get_file_info(fs.FileSelector(f"{base}/packages/{part['folder']}")):
            yield info.path
