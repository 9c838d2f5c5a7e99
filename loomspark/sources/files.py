"""Files below a folder as a Spark data source: lines by byte range, the last lines of each file, and the members of office documents.

    read_folder(spark, folder, mode="tail", lines=100).where("size > 1000")

Modes: `index` gives path and size; `lines` path, size, offset and line, a
partition per `block` bytes of a file; `tail` the same for the last `lines`
lines, read backwards from the end in small blocks; `members` path, size, member
and text of what holds text. Filters on path (its end) and size are applied to
the list of files, before any is opened. Paths may be local or URIs that
pyarrow's file systems read, and have to be seen by all executors.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringEndsWith

SCHEMAS = {
    "index": "path string, size long",
    "lines": "path string, size long, offset long, line string",
    "tail": "path string, size long, offset long, line string",
    "members": "path string, size long, member string, text string",
}
#: Which members of a zip-held document have its text, and which elements end a line.
OFFICE = {
    "docx": (r"word/document\.xml", ("w:p",)),
    "odt": (r"content\.xml", ("text:p", "text:h")),
    "xlsx": (r"xl/(sharedStrings|worksheets/sheet\d+)\.xml", ("si", "row")),
    "pptx": (r"ppt/slides/slide\d+\.xml", ("a:p",)),
}
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class Piece(InputPartition):
    """The lines of a file that start in [begin, end)."""

    path: str
    size: int
    begin: int
    end: int


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def listed(folder: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder with one of the suffixes (all if none), in order; hidden ones and those below hidden folders left out."""
    from pyarrow import fs

    system, root = _opened(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    inside = lambda p: p[len(root) :].strip("/").split("/")
    head = folder.rstrip("/")
    files = [(f"{head}/{'/'.join(inside(f.path))}", f.size) for f in found if f.is_file and not any(part.startswith((".", "_")) for part in inside(f.path))]
    return sorted(x for x in files if not suffixes or x[0].lower().endswith(suffixes))


def lines_in(data, begin: int, end: int, block: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start in [begin, end) of an open file, read block by block."""
    at = begin
    if begin:
        data.seek(begin - 1)
        rest = data.read(1)
        at = begin - 1
    else:
        data.seek(0)
        rest = b""
    skips = bool(begin)  # what precedes the first newline belongs to the piece before
    while True:
        cut = rest.find(b"\n")
        if cut < 0:
            more = data.read(block)
            if more:
                rest += more
                continue
            if rest and not skips and at < end:
                yield at, rest
            return
        if not skips:
            if at >= end:
                return
            yield at, rest[:cut]
        skips = False
        at += cut + 1
        rest = rest[cut + 1 :]
        if at >= end:
            return


def last_lines(data, size: int, n: int, block: int = 1 << 12) -> tuple[int, list[tuple[int, bytes]]]:
    """(bytes read, the last n lines as (offset, line)) of an open file, read backwards; a last line without a newline counts."""
    begin, held = size, b""
    while begin > 0 and held.rstrip(b"\n").count(b"\n") < n:
        step = min(block, begin)
        begin -= step
        data.seek(begin)
        held = data.read(step) + held
        block *= 2
    lines, at = [], begin
    parts = held.split(b"\n")
    for i, part in enumerate(parts):
        if i < len(parts) - 1 or part:
            lines.append((at, part))
        at += len(part) + 1
    if begin > 0:
        lines = lines[1:]  # may begin before what was read
    return size - begin, lines[-n:] if n else []


def plain_text(raw: bytes) -> str | None:
    """Decoded text; None if a NUL near the start says that it is none."""
    if b"\x00" in raw[:4096]:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def members(path: str, raw: bytes) -> Iterator[tuple[str, str]]:
    """(member, text) of a document: the parts of a zip-held one in order, or the whole of a text file; nothing of what can't be read."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind not in OFFICE:
        text = plain_text(raw)
        if text is not None:
            yield "", text
        return
    wanted, ends = OFFICE[kind]
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as held:
            names = [n for n in held.namelist() if re.fullmatch(wanted, n)]
            for name in sorted(names, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
                xml = held.read(name).decode("utf-8", "replace")
                broken = re.sub(rf"</({'|'.join(ends)})>", "\n", xml)
                lines = (html.unescape(re.sub(r"<[^>]*>", "", line)).strip() for line in broken.split("\n"))
                yield name, "\n".join(x for x in lines if x)
    except zipfile.BadZipFile:
        return


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.mode = options.get("mode", "lines")
        self.folder = options["path"]
        self.suffixes = tuple(f".{s.strip().lstrip('.').lower()}" for s in options.get("suffixes", "").split(",") if s.strip())
        self.block, self.n = int(options.get("block", 64 << 20)), int(options.get("lines", 100))
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.tests.append(("path", str.endswith, f.value))
            elif type(f) in _TESTS and f.attribute == ("size",):
                self.tests.append(("size", _TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = [(p, s) for p, s in listed(self.folder, self.suffixes) if all(test(p if what == "path" else s, value) for what, test, value in self.tests)]
        if self.mode != "lines":
            return [Piece(p, s, 0, s) for p, s in files] or [Piece("", 0, 0, 0)]
        return [Piece(p, s, a, min(a + self.block, s)) for p, s in files for a in range(0, s, self.block)] or [Piece("", 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[tuple]:
        if not piece.path:
            return
        if self.mode == "index":
            yield piece.path, piece.size
            return
        system, inner = _opened(piece.path)
        with system.open_input_file(inner) as data:
            if self.mode == "members":
                for name, text in members(piece.path, data.read()):
                    yield piece.path, piece.size, name, text
                return
            found = lines_in(data, piece.begin, piece.end) if self.mode == "lines" else last_lines(data, piece.size, self.n)[1]
            for at, line in found:
                yield piece.path, piece.size, at, line.rstrip(b"\r").decode("utf-8", "replace")


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("mode", "lines")]

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def read_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """The folder as a DataFrame; registers the source with the session and lets filters reach it."""
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("folder").options(path=path, **{k: str(v) for k, v in options.items()}).load()
