"""Raw mail as a Spark data source: mbox files by folder, read with filters on folder, uid and date.

    spark.dataSource.register(RawMail)
    spark.read.format("rawmail").load(path).where("folder = 'INBOX' AND uid > 100")

A folder's files are named by the uids and the days of the mails in them. A filter first leaves out files,
then mails by the line that begins them; only what is left is read into rows, and nothing is parsed
(`mime.parse_column` does that). Files are opened where they are read, through pyarrow's file systems.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = "folder string, uid long, internal_date timestamp_ntz, flags array<string>, size long, content binary"
COLUMNS = ("folder", "uid", "internal_date", "flags", "size", "content")
#: Bytes of mail after which a file ends, after which it ends where a block of uids does, and of rows
#: in one batch. A file is one task's work when it is read.
FILE_BYTES, BLOCK_BYTES, BATCH_BYTES = 16 << 20, 4 << 20, 4 << 20
#: Mails of which a task that writes has Python objects at once.
AT_ONCE = 256
#: Uids of a folder that are written by one task.
UIDS = 10_000
NAME = re.compile(r"(\d+)-(\d+)-(\d{8})-(\d{8})-\w+\.mbox\Z")
QUOTED = re.compile(rb"^(>*From )", re.MULTILINE)
UNQUOTED = re.compile(rb"^>(>*From )", re.MULTILINE)
NO_DAY = "00000000"  # of a mail without a date

TESTS: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b,
}


@dataclass
class Segment(InputPartition):
    """One file."""

    path: str
    folder: str
    least: int
    most: int
    first: str
    last: str

    def may_hold(self, kind: type, column: str, value: Any) -> bool:
        """Whether some mail of the file can meet a condition: the file's range is tried, from both ends."""
        if column == "folder":
            return TESTS[kind](self.folder, value)
        if column == "uid":
            low, high = self.least, self.most
        elif kind is In:
            return True
        else:
            low, high, value = self.first, self.last, value.strftime("%Y%m%d")
            kind = {GreaterThan: GreaterThanOrEqual, LessThan: LessThanOrEqual}.get(kind, kind)
        if kind is EqualTo:
            return low <= value <= high
        if kind is In:
            return any(low <= v <= high for v in value if v is not None)
        return TESTS[kind](high if kind in (GreaterThan, GreaterThanOrEqual) else low, value)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


def separator(uid: int, date: datetime | None, flags: list[str] | None) -> bytes:
    return f"From {uid} {date.isoformat() if date else '-'} {json.dumps(flags)}\n".encode()


def mails(stream: pa.NativeFile, size: int = 1 << 20) -> Iterator[bytes]:
    """The mails of a file, each with the line that begins it. No byte is looked at twice, however long a mail is."""
    held = bytearray()
    while block := stream.read(size):
        look, begin = max(0, len(held) - 5), 0  # what begins a mail may lie in two blocks
        held += block
        while (end := held.find(b"\nFrom ", look)) >= 0:
            yield bytes(held[begin : end + 1])
            begin = look = end + 1
        del held[:begin]
    if held:
        yield bytes(held)


class MailReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.conditions: list[tuple[type, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of folder, uid and internal_date are done here; what is left is Spark's to do."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in TESTS and column in ("folder", "uid", "internal_date"):
                self.conditions.append((type(f), column, f.value))
            elif not (isinstance(f, IsNotNull) and column in ("folder", "uid")):  # these always are
                yield f

    def partitions(self) -> list[InputPartition]:
        files, root = _opened(self.path)
        out = []
        for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
            parent, _, name = info.path.rpartition("/")
            if (m := NAME.match(name)) and (folder := parent.rpartition("/")[2]).startswith("folder="):
                segment = Segment(info.path, unquote(folder.removeprefix("folder=")), int(m[1]), int(m[2]), m[3], m[4])
                if all(segment.may_hold(*c) for c in self.conditions):
                    out.append(segment)
        return out

    def _wanted(self, row: dict[str, Any]) -> bool:
        return all(row[column] is not None and TESTS[kind](row[column], value) for kind, column, value in self.conditions)

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks for one partition where there is none
            return
        files, _ = _opened(self.path)
        rows: list[dict[str, Any]] = []
        size = 0
        with files.open_input_stream(partition.path) as stream:
            for mail in mails(stream):
                head, _, body = mail.partition(b"\n")
                _, uid, date, flags = head.decode().split(" ", 3)
                row = {"folder": partition.folder, "uid": int(uid), "internal_date": None if date == "-" else datetime.fromisoformat(date), "flags": json.loads(flags)}
                if self._wanted(row):
                    content = body[:-1] if b">From " not in body else UNQUOTED.sub(rb"\1", body[:-1])
                    rows.append(row | {"size": len(content), "content": content})
                    size += len(content)
                    if size > BATCH_BYTES or len(rows) >= 1000:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict[str, Any]]) -> pa.RecordBatch:
    kinds = pa.string(), pa.int64(), pa.timestamp("us"), pa.list_(pa.string()), pa.int64(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in zip(COLUMNS, kinds, strict=True)], names=COLUMNS)


@dataclass
class Written(WriterCommitMessage):
    """(name while it is written, name when done) of a task's files."""

    files: list[tuple[str, str]]


class _File:
    """A file while it is written, and the range of what it holds."""

    def __init__(self, files: fs.FileSystem, root: str, mail_folder: str):
        self.mail_folder, self.folder = mail_folder, f"{root}/folder={quote(mail_folder, safe='')}"
        files.create_dir(self.folder, recursive=True)
        self.staged = f"{self.folder}/.{uuid.uuid4().hex}"
        self.out = files.open_output_stream(self.staged)
        self.size, self.uids, self.days = 0, None, None

    def add(self, row: dict[str, Any]) -> None:
        content = row["content"] or b""
        quoted = QUOTED.sub(rb">\1", content) if b"From " in content else content
        self.out.write(separator(row["uid"], row["internal_date"], row["flags"]) + quoted + b"\n")
        self.size += len(content)
        day = row["internal_date"].strftime("%Y%m%d") if row["internal_date"] else NO_DAY  # the least there is
        low, high = self.uids or (row["uid"], row["uid"])
        first, last = self.days or (day, day)
        self.uids, self.days = (min(low, row["uid"]), max(high, row["uid"])), (min(first, day), max(last, day))

    def close(self) -> tuple[str, str]:
        self.out.close()
        return self.staged, f"{self.folder}/{self.uids[0]}-{self.uids[1]}-{self.days[0]}-{self.days[1]}-{uuid.uuid4().hex}.mbox"


class MailWriter(DataSourceArrowWriter):
    """Each task writes files that no reader sees; they get their names when all tasks have ended."""

    def __init__(self, path: str, overwrite: bool, uids: int = UIDS):
        self.path, self.overwrite, self.uids = path, overwrite, uids

    def _full(self, out: _File, row: dict[str, Any]) -> bool:
        """Whether a file ends before a row: where it is long, its folder ends, or a block of uids does."""
        return row["folder"] != out.mail_folder or out.size > FILE_BYTES or (out.size > BLOCK_BYTES and row["uid"] // self.uids != out.uids[1] // self.uids)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _opened(self.path)
        done: list[tuple[str, str]] = []
        out: _File | None = None
        for row in (row for batch in iterator for at in range(0, batch.num_rows, AT_ONCE) for row in batch.slice(at, AT_ONCE).to_pylist()):
            if out is None or self._full(out, row):
                if out:
                    done.append(out.close())
                out = _File(files, root, row["folder"])
            out.add(row)
        if out:
            done.append(out.close())
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        named = [pair for m in messages if m for pair in m.files]
        if self.overwrite:
            new = {staged for staged, _ in named}
            old = [i.path for i in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if i.is_file and i.path not in new]
            for path in old:
                files.delete_file(path)
        for staged, final in named:
            files.move(staged, final)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _opened(self.path)
        for staged, _ in (pair for m in messages if m for pair in m.files):
            files.delete_file(staged)


class RawMail(DataSource):
    """Option path: a folder of mail folders."""

    @classmethod
    def name(cls) -> str:
        return "rawmail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MailReader:
        return MailReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> MailWriter:
        return MailWriter(self.options["path"], overwrite, int(self.options.get("uids", UIDS)))


def write_raw(mail: DataFrame, path: str, uids: int = UIDS) -> None:
    """Adds mails (folder, uid, internal_date, flags, content) to a folder of raw mail. A large folder is
    many files, each with neighbouring uids, dealt to tasks by blocks of so many uids, so that no task has
    much more than others. Mails without a folder or a uid are an error."""
    mail.sparkSession.dataSource.register(RawMail)
    rows = mail.select(*(F.col(c) if c != "size" else F.length("content").cast("long").alias("size") for c in COLUMNS))
    rows = rows.withColumn("folder", F.coalesce("folder", F.raise_error(F.lit("a mail without a folder")))).withColumn("uid", F.coalesce("uid", F.raise_error(F.lit("a mail without a uid"))))
    rows.repartition("folder", F.floor(F.col("uid") / uids)).sortWithinPartitions("folder", "uid").write.format("rawmail").mode("append").option("uids", uids).save(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(folder, uid, internal_date, flags, size, content) of a folder of raw mail."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawMail)
    return spark.read.format("rawmail").load(path)
