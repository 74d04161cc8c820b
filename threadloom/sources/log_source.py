"""Logs of JSON values as a Spark data source: byte ranges as partitions, prefixes of files, and a stream of growing files.

A value may span lines, so a range can't tell by itself where its first value starts.  `planned_ranges` settles that: every
range is read from its first line on and says where its last value ends; where that isn't the place from which the next
range was read, the next range is read again from there.  Once all places fit, they are those of one reader of the whole file.
"""

from __future__ import annotations

import codecs
import fnmatch
import json
import math
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "json_log"
SCHEMA = "path string, seq long, record string, is_error boolean"
CUTS = "path string, k int, entry long, first long, exit long, n long"
#: Bytes read at once, and of a range unless said otherwise; bytes that a stream goes on per trigger.
CHUNK = 1 << 20
SPLIT_BYTES = 64 << 20
TRIGGER_BYTES = 64 << 20

_SPACE = re.compile(r"\s*")
_SURROGATES = re.compile("[\ud800-\udfff]")
_WORDS = ("true", "false", "null", "NaN", "Infinity", "-Infinity")


def _number(digits: str) -> float | None:
    """A float, or null for one too large: JSON has no infinity."""
    found = float(digits)
    return None if math.isinf(found) else found


def _decoder() -> Callable[[str, int], tuple[object, int]]:
    return json.JSONDecoder(parse_constant=lambda _: None, parse_float=_number).raw_decode


def _cut_off(error: ValueError, text: str) -> bool:
    """Whether a value may only be unreadable since the text ends too early."""
    if not isinstance(error, json.JSONDecodeError):
        return False
    if error.msg.startswith("Unterminated string"):
        return True
    rest = text[error.pos :]
    return not rest or any(w.startswith(rest) for w in _WORDS) or ("escape" in error.msg and len(rest) < 12)


def _record(text: str, value: dict) -> str | None:
    """The value as JSON text: bytes that aren't UTF-8 and halves of surrogate pairs become U+FFFD."""
    try:
        if not text.isascii() and _SURROGATES.search(text):
            value, _ = _decoder()(text.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), 0)
        return _SURROGATES.sub("�", json.dumps(value, ensure_ascii=False))
    except (ValueError, RecursionError):
        return None


def scan(read: Callable[[int, int], bytes], first: int, upto: int, stop: int, growing: bool = False, parse: bool = True) -> Iterator[tuple[int, str | None, bool]]:
    """The values that start from byte `first` on and before `upto`: where the next one starts, the object as text, error mark.

    read(offset, n) gives bytes of a file that ends at `stop`.  What can't be read, or nests too deep for the parser, and
    what is no object, is an error mark; after an unreadable value reading goes on at the next line.  Of a growing file,
    a value that later bytes may complete is held back.  A pair (first place, None, False) comes before all values.
    """
    decoder, decode = codecs.getincrementaldecoder("utf-8")("surrogateescape"), _decoder()
    text, at, place, loaded, step, opened = "", 0, first, first, CHUNK, False

    def more() -> None:
        nonlocal text, at, loaded, step
        data = read(loaded, min(step, stop - loaded))
        loaded = loaded + len(data) if data else stop
        step = min(2 * step, 1 << 28)
        text, at = text[at:] + decoder.decode(data, loaded >= stop), 0

    def go_to(new: int) -> None:
        nonlocal at, place
        piece = text[at:new]
        place += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogateescape"))
        at = new

    while True:
        go_to(_SPACE.match(text, at).end())
        if at == len(text) and loaded < stop:
            more()
            continue
        if not opened:
            opened = True
            yield place, None, False
        if at == len(text) or place >= upto:
            return
        bad, record, new = True, None, -1
        try:
            value, new = decode(text, at)
            if new == len(text) and not isinstance(value, (dict, list, str)) and (loaded < stop or growing):
                if loaded == stop:
                    return
                more()
                continue
            if isinstance(value, dict):
                record = _record(text[at:new], value) if parse else ""
                bad = record is None
        except (ValueError, RecursionError) as error:
            if isinstance(error, ValueError) and _cut_off(error, text):
                if loaded < stop:
                    more()
                    continue
                if growing:
                    return
            while (new := text.find("\n", at) + 1) == 0 and loaded < stop:
                more()
            if not new:
                if growing:
                    return
                new = len(text)
        go_to(new)
        step = CHUNK
        # the place to go on from is that of the next value, wherever white space ends
        while (end := _SPACE.match(text, at).end()) == len(text) and loaded < stop:
            go_to(end)
            more()
        go_to(end)
        yield place, record, bad


@dataclass
class File:
    path: str
    size: int
    modified: float = 0.0


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, or of a URI of any that pyarrow knows."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _named(system: fs.FileSystem, given: str, path: str) -> str:
    """A path as Spark's own file sources give it."""
    if isinstance(system, fs.LocalFileSystem):
        return f"file:{path}"
    return path if "://" in path else f"{given.split('://')[0]}://{path}"


def files_below(paths: Sequence[str], pattern: str) -> list[File]:
    """The files below the paths whose names fit; a path that isn't there has none.  Nothing of them is read."""
    out = {}
    for given in paths:
        system, path = _open(given)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else []
        if info.type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(path, recursive=True))
        for x in found:
            if x.type == fs.FileType.File and fnmatch.fnmatch(os.path.basename(x.path), pattern):
                name = _named(system, given, x.path)
                out[name] = File(name, x.size, x.mtime.timestamp() if x.mtime else 0.0)
    return [out[k] for k in sorted(out)]


def opened(path: str) -> Callable[[int, int], bytes]:
    system, local = _open(path)
    file = system.open_input_file(local)
    return lambda offset, n: file.read_at(n, offset) if n > 0 else b""


def line_start(read: Callable[[int, int], bytes], first: int, stop: int) -> int:
    """The first start of a line at or behind a byte that isn't the file's first."""
    at = first - 1
    while at < stop:
        data = read(at, min(CHUNK, stop - at))
        if not data:
            return stop
        if (k := data.find(b"\n")) >= 0:
            return at + k + 1
        at += len(data)
    return stop


class Range(InputPartition):
    """What one task reads, a list of path, k, start, entry (-1: the first line from start on), upto, stop, number of the first value."""

    def __init__(self, parts: list[tuple[str, int, int, int, int, int, int]]):
        super().__init__(parts)
        self.parts = parts


def _paths(options: dict) -> list[str]:
    return json.loads(options["paths"]) if "paths" in options else [options["path"]]


def _ranges(options: dict) -> list[tuple[str, int, int, int, int]]:
    """path, k, start, end, stop of all ranges of all files."""
    split, most = int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("maxbytes", 1 << 62))
    out = []
    for f in files_below(_paths(options), options.get("pattern", "*.jsonl")):
        stop = min(f.size, most)
        out += [(f.path, k, at, min(at + split, stop), stop) for k, at in enumerate(range(0, stop, split))]
    return out


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.cuts = options.get("mode") == "cuts"

    def partitions(self) -> list[Range]:
        """With `entries`, what is listed there: path, k, entry, number; else all ranges, from their first line on."""
        given = json.loads(self.options["entries"]) if "entries" in self.options else None
        split, out, size = int(self.options.get("splitbytes", SPLIT_BYTES)), [], math.inf
        wanted = None if given is None else {(p, k): (entry, number) for p, k, entry, number in given}
        for path, k, start, end, stop in _ranges(self.options):
            if wanted is not None and (path, k) not in wanted:
                continue
            entry, number = (0 if k == 0 else -1, 0) if wanted is None else wanted[path, k]
            if size + end - start > split:  # small files share a task
                out.append([])
                size = 0
            out[-1].append((path, k, start if entry == -1 else entry, entry, end, stop, number))
            size += end - start
        return [Range(parts) for parts in out or [[]]]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for path, k, start, entry, upto, stop, number in partition.parts:
            read = opened(path)
            first = line_start(read, start, stop) if entry == -1 else entry
            values = scan(read, first, upto, stop, parse=not self.cuts)
            place, _, _ = next(values)
            if self.cuts:
                n, end = 0, place
                for end, _, _ in values:
                    n += 1
                row = [[path], [k], [entry], [place], [end], [n]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int32(), *[pa.int64()] * 4))], names=[c.split()[0] for c in CUTS.split(", ")])
                continue
            yield from batches(path, number, ((record, bad) for _, record, bad in values))


def batches(path: str, number: int, values: Iterator[tuple[str | None, bool]]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(values, 2000)):
        seq = pa.array(range(number, number + len(part)), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), seq, pa.array([r for r, _ in part], pa.string()), pa.array([b for _, b in part])], names=["path", "seq", "record", "is_error"])
        number += len(part)


class LogStream(DataSourceStreamReader):
    """Growing files.  The offset of a file is the byte behind its last complete value, with the number of values before it.

    Places are facts of files that only grow, so any earlier one is good to go on from.  Finding the next places reads what
    was appended, TRIGGER_BYTES (`triggerBytes`) at most each time; with `cursorPath` the last places are kept in a file, and
    a restarted stream needn't look for them from the start.
    """

    def __init__(self, options: dict):
        self.options = options
        self.known: dict[str, dict[str, int]] = {}
        self.cursors = options.get("cursorpath")
        if self.cursors:
            system, path = _open(self.cursors)
            if system.get_file_info(path).type == fs.FileType.File:
                with system.open_input_stream(path) as f:
                    self.known = json.loads(f.read())

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        left = int(self.options.get("triggerbytes", TRIGGER_BYTES))
        for f in files_below(_paths(self.options), self.options.get("pattern", "*.jsonl")):
            own = self.known.get(f.path, {"at": 0, "seq": 0})
            if left <= 0 or own["at"] >= f.size:
                continue
            read = opened(f.path)
            values = scan(read, own["at"], own["at"] + left, f.size, growing=True, parse=False)
            end, n = next(values)[0], 0
            for end, _, _ in values:
                n += 1
            left -= end - own["at"]
            self.known[f.path] = {"at": end, "seq": own["seq"] + n}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        for path, own in end.items():
            if own["at"] > self.known.get(path, {"at": -1})["at"]:
                self.known[path] = own
        none = {"at": 0, "seq": 0}
        return [Range([(path, 0, 0, start.get(path, none)["at"], own["at"], own["at"], start.get(path, none)["seq"])]) for path, own in sorted(end.items()) if own["at"] > start.get(path, none)["at"]]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for path, _, _, first, upto, stop, number in partition.parts:
            values = scan(opened(path), first, upto, stop)
            next(values)
            yield from batches(path, number, ((record, bad) for _, record, bad in values))

    def commit(self, end: dict) -> None:
        if self.cursors:
            system, path = _open(self.cursors)
            with system.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(end).encode())
            system.move(f"{path}.new", path)


class LogSource(DataSource):
    """`spark.read.format("json_log")`, options path or paths (a JSON array), pattern, maxBytes, splitBytes; and readStream."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CUTS if self.options.get("mode") == "cuts" else SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> LogStream:
        return LogStream({k.lower(): v for k, v in self.options.items()})


def planned_ranges(spark: SparkSession, options: dict[str, str]) -> list[tuple[str, int, int, int]]:
    """path, k, entry, number of the first value: where each range that has values starts.  A row a range reaches the driver."""
    files: dict[str, list[tuple[int, int]]] = {}
    for path, k, _, end, _ in _ranges({k.lower(): v for k, v in options.items()}):
        files.setdefault(path, []).append((k, end))
    known: dict[tuple[str, int, int], tuple[int, int]] = {}
    guessed: dict[tuple[str, int], int] = {}
    starts: dict[str, int] = {}
    todo: list[tuple[str, int, int, int]] | None = None
    while todo is None or todo:
        cuts = spark.read.format(NAME).options(**options, mode="cuts", **({} if todo is None else {"entries": json.dumps(todo)})).load()
        for path, k, entry, first, exit_, n in cuts.collect():
            known[path, k, first] = exit_, n
            guessed.setdefault((path, k), exit_)
            if k == 0:
                starts.setdefault(path, first)
        todo, out = [], []
        for path, ranges in files.items():
            at, number = starts[path], 0
            for k, end in ranges:
                if at >= end:
                    continue
                if (path, k, at) in known:
                    out.append((path, k, at, number))
                    at, n = known[path, k, at]
                    number += n
                else:
                    todo.append((path, k, at, 0))
                    at = max(at, guessed[path, k])
    return out


def log_values(spark: SparkSession, paths: Sequence[str], max_bytes: int | None = None, pattern: str = "*.jsonl", split_bytes: int = SPLIT_BYTES):
    """SCHEMA rows of all logs below the paths, a task for each split_bytes; max_bytes reads no more than so much of each file."""
    spark.dataSource.register(LogSource)
    options = {"paths": json.dumps(list(paths)), "pattern": pattern, "splitBytes": str(split_bytes)}
    if max_bytes is not None:
        options["maxBytes"] = str(max_bytes)
    if any(min(f.size, max_bytes or f.size) > split_bytes for f in files_below(paths, pattern)):
        options["entries"] = json.dumps(planned_ranges(spark, options))
    return spark.read.format(NAME).options(**options).load()
