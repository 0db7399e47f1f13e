"""Messages from raw mail: .eml files, or any column of bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import UTC
from email import message_from_bytes, policy
from email.message import EmailMessage
from email.utils import parsedate_to_datetime
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Fields of a head that are columns of their own; the others are in `headers`, by their lower-cased names.
COLUMNS = {"subject", "from", "to", "cc", "date"}
PARSED = "subject string, from array<string>, to array<string>, cc array<string>, date timestamp_ntz, html string, bodyText string, attachments array<struct<filename:string,contentType:string,size:long>>, headers map<string,array<string>>"
#: Mails that are Python objects at once, and how long the values are of which many are remembered.
AT_ONCE, SHORT = 64, 200

_short, _long = lru_cache(4096)(policy.default.header_factory), lru_cache(16)(policy.default.header_factory)


def _header(name: str, value: str) -> Any:
    """A parsed field of a head. The email package parses a field each time that it is asked for, a
    part's content type ten times over; most values are those of the mail before."""
    return (_short if len(value) <= SHORT else _long)(name, value)


POLICY = policy.default.clone(header_factory=_header)


def _parts(mail: EmailMessage) -> Iterator[EmailMessage]:
    """The parts that hold something, in order. An attached message is one part, however it is made."""
    stack = [mail]
    while stack:
        part = stack.pop()
        if part.get_content_maintype() == "multipart" and part.is_multipart():
            stack += reversed(part.get_payload())
        else:
            yield part


def _size(part: EmailMessage) -> int:
    if part.get_content_maintype() == "message":
        return sum(len(inner.as_bytes()) for inner in part.get_payload()) if part.is_multipart() else len(str(part.get_payload()))
    return len(part.get_payload(decode=True) or b"")


def parse(raw: bytes | None) -> dict:
    """The fields of one mail; what it lacks is None, and all are where it can't be parsed. Contents
    of attachments are dropped."""
    try:
        return _parse(raw)
    except Exception:  # heads can be malformed in ways that the parser doesn't foresee; one mail is one row
        return _parse(None)


def _parse(raw: bytes | None) -> dict:
    out = dict.fromkeys(("subject", "from", "to", "cc", "date", "html", "bodyText", "attachments", "headers"))
    if not raw:
        return out
    mail = message_from_bytes(bytes(raw), policy=POLICY)
    out["subject"] = mail["subject"] and str(mail["subject"])
    for name in ("from", "to", "cc"):
        out[name] = [str(v) for v in mail.get_all(name, [])] or None
    out["headers"] = {}
    for name, value in mail.items():
        if name.lower() not in COLUMNS:
            out["headers"].setdefault(name.lower(), []).append(str(value))
    try:
        date = parsedate_to_datetime(str(mail["date"])) if mail["date"] else None
        out["date"] = date.astimezone(UTC).replace(tzinfo=None) if date and date.tzinfo else date
    except (TypeError, ValueError):
        pass
    files = []
    for part in _parts(mail):
        kind = part.get_content_type()
        if part.get_content_disposition() == "attachment" or kind not in ("text/plain", "text/html"):
            files.append({"filename": part.get_filename(), "contentType": kind, "size": _size(part)})
        else:
            name = "html" if kind == "text/html" else "bodyText"
            try:
                text = part.get_content()
            except (LookupError, UnicodeError):
                text = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
            out[name] = (out[name] or "") + text
    out["attachments"] = files
    return out


def parse_column(df: DataFrame, raw: str = "content") -> DataFrame:
    """df with the fields of the mails in a column of bytes, instead of that column."""
    kept = [f for f in df.schema if f.name != raw]
    fields = T.StructType.fromDDL(PARSED).fields
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found = [parse(x) for x in part.column(raw).to_pylist()]
                for mail in found:
                    mail["headers"] = None if mail["headers"] is None else list(mail["headers"].items())
                columns = [part.column(f.name) for f in kept] + [pa.array([mail[name] for mail in found], kind) for name, kind in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *(name for name, _ in kinds)])

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """A row for each .eml file: its path, its size and its mail's fields."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    return parse_column(files.select("path", F.col("length").alias("size"), "content"))


def lines_of_json(df: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(line, parsed), after the columns to keep: a row for each line that isn't blank; parsed is
    null where it isn't JSON."""
    lines = df.select(*keep, F.explode(F.split(column, "\n")).alias("line")).where(F.trim("line") != "")
    return lines.withColumn("parsed", F.try_parse_json("line"))
