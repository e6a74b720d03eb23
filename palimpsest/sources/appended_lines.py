"""Files that grow as a source: each line of a folder's files once, from where the last batch ended.

``spark.readStream.format("appended_lines")`` (after ``register``) gives (path, start, generation, value): the line's
file, the byte that it starts at, how often the file was begun anew, and its text. ``spark.read`` gives the same of all
files as they are. Options: ``path`` (a folder, or ``files``, a JSON list of files), ``suffix``, ``parser`` (a version:
another one reads all files anew), ``partition_bytes`` (of a task), ``tail_bytes``, and for ``spark.read`` the offsets
``after`` and ``until`` between which it reads.

The offset of a batch says for each file how many bytes were seen, with size, time, generation, and a checksum of the
last bytes before. A file with the size and time of the last batch is not opened. One that is shorter than what was
seen, or whose checksum is another, was written anew: its generation goes up and it is read from its start, after a row
without a value that says so (start -1), so that an emptied file is told as well.

Tasks get ranges of bytes, of a bounded number of files. A line belongs to the range that its line break lies in, and whoever reads that range looks
back for the line's start: a long file is read by many tasks, and half a line waits for the batch that sees its end. A
last line without a break counts if it is JSON; when the break comes later, the line is not given again.

Spark asks a source for its newest offset without saying where the last run ended, so a stream is opened with
``appended_lines``, which names the folder of the stream's progress: the reader looks up the last offset there. A query
has one such source.

The offset lists the folder's files, and the driver lists the folder and reads the tails of changed files (``tail_bytes``
at most of each) for every batch, with a few threads; no file is read whole there. Files are reached by Arrow's file
systems (``file:``, ``hdfs:``, object stores), from driver and tasks alike. A file that goes is forgotten; what it gave
stays. Bytes that are no UTF-8 are replaced, a carriage return before a break is dropped, and empty lines are given.
"""

from __future__ import annotations

import json
import posixpath
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "appended_lines"
SCHEMA = "path string, start long, generation long, value string"
ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("generation", pa.int64()), ("value", pa.string())])
PARTITION_BYTES, TAIL_BYTES = 64 << 20, 1 << 16
BLOCK_BYTES, BATCH_BYTES, BATCH_ROWS = 1 << 20, 4 << 20, 8192
MARK_BYTES, THREADS = 64, 8
#: Files that a task opens, one after the other.
TASK_FILES = 1024


@dataclass(frozen=True)
class Seen:
    """What the batches so far have read of a file; ``told`` if a last line without a break was among it."""

    at: int
    mtime: int
    generation: int
    told: bool
    mark: int

    def packed(self) -> list:
        return [self.at, self.mtime, self.generation, int(self.told), self.mark]

    @classmethod
    def of(cls, packed: list) -> Seen:
        return cls(packed[0], packed[1], packed[2], bool(packed[3]), packed[4])


@dataclass(frozen=True)
class Span:
    """Bytes of a file whose line breaks a task looks for."""

    path: str
    begin: int
    end: int
    generation: int
    #: the line that ends at ``begin`` was given without its break
    told: bool = False
    #: the line that ends at ``end`` is given without its break
    last: bool = False
    #: the file was begun anew
    anew: bool = False


class Spans(InputPartition):
    def __init__(self, root: str, spans: list[Span]) -> None:
        self.root, self.spans = root, spans


def file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class Folder:
    """The files of a source as they are."""

    def __init__(self, options) -> None:
        self.files = json.loads(options["files"]) if options.get("files") else None
        self.root = options.get("path") or (self.files or [""])[0]
        if not self.root and self.files is None:
            raise ValueError("the source needs a path, or files")
        self.suffix = options.get("suffix", ".jsonl")
        self.parser = options.get("parser", "v1")
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.tail_bytes = int(options.get("tail_bytes", TAIL_BYTES))

    def listed(self) -> dict[str, tuple[int, int]]:
        """Size and time of each file, by its path."""
        from pyarrow import fs

        if not self.root:
            return {}
        system, inner = file_system(self.root)
        if self.files is not None:
            wanted = [file_system(f)[1] for f in self.files]
            infos = system.get_file_info(wanted)
        else:
            infos = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        found = [i for i in infos if i.type == fs.FileType.File and i.path.endswith(self.suffix)]
        hidden = [i for i in found if posixpath.basename(i.path).startswith((".", "_"))]
        return {i.path: (i.size, i.mtime_ns or 0) for i in found if i not in hidden}

    def looked_at(self, path: str, size: int, before: Seen | None, mtime: int, parsed_anew: bool) -> Seen:
        """A changed file's new state, from its tail alone."""
        system, _ = file_system(self.root)
        with system.open_input_file(path) as source:
            anew = before is not None and (parsed_anew or size < before.at or _mark(source, before.at) != before.mark)
            generation = 0 if before is None else before.generation + anew
            end = source.read_at(min(size, MARK_BYTES), max(0, size - MARK_BYTES))
            told = not end.endswith(b"\n") and _ends_in_json(source, size, self.tail_bytes)
            return Seen(size, mtime, generation, told, zlib.crc32(end) if size else 0)

    def state(self, before: dict) -> dict:
        """The offset of everything that is there now."""
        old = {path: Seen.of(x) for path, x in before.get("files", {}).items()}
        parsed_anew = bool(old) and before.get("parser") != self.parser
        held, changed = {}, []
        for path, (size, mtime) in self.listed().items():
            seen = old.get(path)
            if seen and not parsed_anew and (seen.at, seen.mtime) == (size, mtime):
                held[path] = seen
            else:
                changed.append((path, size, seen, mtime, parsed_anew))
        with ThreadPoolExecutor(THREADS) as pool:
            held |= dict(zip((c[0] for c in changed), pool.map(lambda c: self.looked_at(*c), changed), strict=True))
        return {"parser": self.parser, "files": {path: held[path].packed() for path in sorted(held)}}

    def spans(self, start: dict, end: dict) -> list[Spans]:
        """What lies between two offsets, in tasks of bounded bytes: long files in parts, short ones together."""
        old = {path: Seen.of(x) for path, x in start.get("files", {}).items()}
        out: list[Spans] = []
        open_spans: list[Span] = []
        left = self.partition_bytes
        for path, packed in end["files"].items():
            now, was = Seen.of(packed), old.get(path)
            anew = was is not None and was.generation != now.generation
            begin = 0 if was is None or anew else was.at
            if was is not None and not anew and now.at == was.at and now.told == was.told:
                continue
            told = bool(was and not anew and was.told)
            first = True
            while first or begin < now.at:
                stop = min(now.at, begin + left)
                open_spans.append(Span(path, begin, stop, now.generation, told and first, now.told and stop == now.at, anew and first))
                left, begin, first = left - (stop - begin), stop, False
                if left <= 0 or len(open_spans) >= TASK_FILES:
                    out.append(Spans(self.root, open_spans))
                    open_spans, left = [], self.partition_bytes
        return out + ([Spans(self.root, open_spans)] if open_spans else [])


def _mark(source, at: int) -> int:
    begin = max(0, at - MARK_BYTES)
    return zlib.crc32(source.read_at(at - begin, begin)) if at else 0


def _ends_in_json(source, size: int, most: int) -> bool:
    """Whether the file ends in a whole record without a line break; a longer one waits for its break."""
    begin = max(0, size - most)
    tail = source.read_at(size - begin, begin)
    if not tail or tail.endswith(b"\n"):
        return False
    cut = tail.rfind(b"\n")
    if cut < 0 and begin:
        return False
    try:
        return isinstance(json.loads(tail[cut + 1 :]), dict | list)
    except ValueError:
        return False


def _line_start(source, at: int) -> int:
    """Where the line starts that the byte ``at`` belongs to."""
    while at > 0:
        begin = max(0, at - BLOCK_BYTES)
        cut = source.read_at(at - begin, begin).rfind(b"\n")
        if cut >= 0:
            return begin + cut + 1
        at = begin
    return 0


def lines_of(source, span: Span) -> Iterator[tuple[int, bytes]]:
    """(start, line) of the lines whose break lies in the span, and of the last one if the span says so."""
    start = _line_start(source, span.begin)
    at = span.begin
    # what was read before the span of a line that ends in it
    rest = source.read_at(at - start, start) if start < at else b""
    skip = span.told
    while at < span.end:
        block = source.read_at(min(BLOCK_BYTES, span.end - at), at)
        if not block:
            break  # the file has become shorter meanwhile; the next batch finds out
        at += len(block)
        *whole, tail = block.split(b"\n")
        for i, piece in enumerate(whole):
            line = rest + piece if i == 0 else piece
            # a line that was told without its break, and went on after all, is given again as it is now
            if not (skip and i == 0 and not piece):
                yield start, line
            skip = False
            start += len(line) + 1
            rest = b""
        rest += tail
    if span.last and rest and not (span.told and skip and span.begin == span.end):
        yield start, rest


def read_spans(part: Spans) -> Iterator[pa.RecordBatch]:
    system, _ = file_system(part.root)
    rows: list[tuple] = []
    size = 0
    for span in part.spans:
        if span.anew:
            rows.append((span.path, -1, span.generation, None))
        with system.open_input_file(span.path) as source:
            for start, line in lines_of(source, span):
                rows.append((span.path, start, span.generation, line.removesuffix(b"\r").decode("utf-8", "replace")))
                size += len(line)
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def logged_offset(progress: str | None) -> dict | None:
    """The last offset that a stream has planned, from the log in the folder of its progress."""
    from pyarrow import fs

    if not progress:
        return None
    system, inner = file_system(progress)
    logged = system.get_file_info(fs.FileSelector(f"{inner}/offsets", allow_not_found=True))
    numbers = [int(i.base_name) for i in logged if i.base_name.isdigit()]
    if not numbers:
        return None
    with system.open_input_file(f"{inner}/offsets/{max(numbers)}") as source:
        for line in source.read().decode().splitlines():
            try:
                held = json.loads(line)
            except ValueError:
                continue
            if isinstance(held, dict) and {"parser", "files"} <= held.keys():
                return held
    raise ValueError(f"the log of {progress} holds no offset of this source")


class StreamReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.folder = Folder(options)
        self.last = logged_offset(options.get("progress"))

    def initialOffset(self) -> dict:
        return {"parser": self.folder.parser, "files": {}}

    def latestOffset(self) -> dict:
        self.last = self.folder.state(self.last or self.initialOffset())
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Spans]:
        return self.folder.spans(start, end) or [Spans(self.folder.root, [])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        return read_spans(partition)

    def __getstate__(self) -> dict:
        """A task reads its spans and needs neither the offset nor the list of files, which grow with the folder."""
        return {"folder": None, "last": None}

    def commit(self, end: dict) -> None:
        pass


class BatchReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = Folder(options)
        self.after = json.loads(options.get("after", "{}"))
        self.until = json.loads(options["until"]) if options.get("until") else None

    def partitions(self) -> list[Spans]:
        until = self.folder.state(self.after) if self.until is None else self.until
        return self.folder.spans(self.after, until) or [Spans(self.folder.root, [])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        return read_spans(partition)

    def __getstate__(self) -> dict:
        """As of a stream's reader."""
        return {"folder": None, "after": None, "until": None}


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AppendedLines)


def appended_lines(spark: SparkSession, folder: str, progress: str, **options) -> DataFrame:
    """A stream of what is new in a folder since the last run with the same ``progress``, which the writer has to use, too."""
    register(spark)
    return spark.readStream.format(NAME).options(path=folder, progress=progress, **options).load()
