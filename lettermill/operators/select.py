"""Folders, fetches, tails, projections and counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import if_empty, if_null, iso_date, no_array, preview
from ..schema import HEADERS
from .criteria import asks_for_highest, compile_criteria

INBOX = "INBOX"
RECENT, FOUND = 10, 20  # default tails
#: Most uids that are put into the plan as literals; more become a table.
LITERALS = 1000


def open_box(messages: DataFrame, folder: str = INBOX) -> DataFrame:
    """A stored table is partitioned by folder: the scan reads this one's files only."""
    return messages.where(F.col("folder") == folder)


def mailboxes(messages: DataFrame, separator: str = "/") -> DataFrame:
    """(path, name, parent, depth) of each folder with messages and of the folders above it."""
    paths = messages.select("folder").distinct().select(F.split("folder", separator).alias("parts"))
    each = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.slice("parts", 1, n))).alias("parts")).distinct()
    join = lambda parts: F.array_join(parts, separator)
    return each.select(join("parts").alias("path"), F.element_at("parts", -1).alias("name"), F.nullif(join(F.slice("parts", 1, F.size("parts") - 1)), F.lit("")).alias("parent"), (F.size("parts") - 1).alias("depth"))


def fetch(messages: DataFrame, uids: Iterable[int] | DataFrame, folder: str | None = INBOX) -> DataFrame:
    """The messages of these uids, each once; uids that aren't there are left out.

    Few uids are literals, which reach the scan; many, or a table of them, are semi-joined: Spark
    broadcasts that table only while it is below its measured limit.
    """
    box = messages if folder is None else open_box(messages, folder)
    if not isinstance(uids, DataFrame):
        wanted = sorted({int(u) for u in uids})
        if len(wanted) <= LITERALS:
            return box.where(F.col("uid").isin(wanted))
        uids = box.sparkSession.createDataFrame([(u,) for u in wanted], "uid long")
    return box.join(uids.select("uid"), "uid", "left_semi")


def tail(messages: DataFrame, n: int) -> DataFrame:
    """The n messages of the highest uids. 0 keeps all; a negative n drops that many of the lowest.

    Never a window over all rows: the top comes from Spark's distributed top-k, and the lowest are
    found the same way and cut off by their highest uid. uids must be unique in messages.
    """
    if n > 0:
        return messages.orderBy(F.desc("uid")).limit(n)
    if n == 0:
        return messages
    cut = messages.select("uid").orderBy("uid").limit(-n).agg(F.max("uid").alias("cut"))
    return messages.join(F.broadcast(cut), F.col("uid") > F.col("cut")).drop("cut")  # one row


def with_headers(messages: DataFrame) -> DataFrame:
    """messages with a column of further fields, without any where the table has none."""
    return messages if "headers" in messages.columns else messages.withColumn("headers", F.lit(None).cast(HEADERS))


def tail_of_each(messages: DataFrame, n: int) -> DataFrame:
    """The n messages of the highest uids of every folder at once; 0 keeps all, as `tail` does.

    Each task keeps n of a folder before anything is shuffled, so a folder with very many messages
    sends n from each task, whatever its size."""
    if n <= 0:
        if n:
            raise ValueError("a tail of each folder can't be negative")
        return messages
    rank = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("uid")))
    return messages.withColumn("own rank", rank).where(F.col("own rank") <= n).drop("own rank")


def mailbox_tree(messages: DataFrame, separator: str = "/") -> DataFrame:
    """(root, tree) of each folder of the first level: a VARIANT of its messages, its separator and its
    children, by their names, null where there are none.

    Levels are put together from the deepest up, each by one grouping on the folder above. What is
    gathered is folders, whose rows were counted before, never messages."""
    counted = messages.where("folder IS NOT NULL").groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    rows = mailboxes(counted, separator).join(counted.withColumnRenamed("folder", "path"), "path", "left")
    nodes = rows.select("path", "name", "parent", "depth", F.coalesce("n", F.lit(0)).alias("n")).persist()
    deepest = nodes.agg(F.max("depth")).first()[0]
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    below = None
    for depth in range(deepest if deepest is not None else 0, -1, -1):
        own = nodes.where(F.col("depth") == depth)
        own = own.withColumn("children", F.lit(None).cast("string")) if below is None else own.join(below, F.col("path") == F.col("above"), "left").drop("above")
        text = F.concat(F.lit('{"messages":'), F.col("n").cast("string"), F.lit(',"delimiter":'), quoted(F.lit(separator)), F.lit(',"children":'), F.coalesce("children", F.lit("null")), F.lit("}"))
        level = own.select("name", "parent", text.alias("text"))
        if depth:
            entry = F.concat(quoted(F.col("name")), F.lit(":"), F.col("text"))
            below = level.groupBy(F.col("parent").alias("above")).agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}")).alias("children"))
    return level.select(F.col("name").alias("root"), F.parse_json("text").alias("tree"))


def search(messages: DataFrame, criteria, folder: str | None = INBOX) -> DataFrame:
    box = messages if folder is None else open_box(messages, folder)
    highest = box.agg(F.max("uid")).scalar() if asks_for_highest(criteria) else None
    return with_headers(box).where(compile_criteria(criteria, highest)).select(*messages.columns)


def counts(found: DataFrame, limit: int) -> DataFrame:
    """(totalFound, count): messages found, and those that a tail of `limit` shows."""
    total = found.agg(F.count(F.lit(1)).alias("totalFound"))
    shown = F.col("totalFound") if limit == 0 else F.least("totalFound", F.lit(limit)) if limit > 0 else F.greatest(F.col("totalFound") + limit, F.lit(0))
    return total.select("totalFound", shown.cast("long").alias("count"))


def normalize(raw: DataFrame, folder: str | None = None) -> DataFrame:
    """Parsed mail in the form of the message table: what is missing becomes empty, but for a
    missing date, which stays null (`date_or_now` gives it one where messages are shown).

    raw has uid, subject, from (array or string), to, date, html, bodyText, attachments, flags,
    and folder unless it is given.
    """
    kinds = dict(raw.dtypes)
    sender = F.get("from", F.lit(0)) if kinds["from"].startswith("array") else F.col("from")
    to = F.col("to") if kinds["to"].startswith("array") else F.array("to")
    attachments = F.transform("attachments", lambda a: F.struct(if_null(a["filename"], "").alias("filename"), if_null(a["contentType"], "").alias("contentType"), if_null(a["size"], 0).cast("long").alias("size")))
    return raw.select(
        F.col("uid").cast("string").alias("id"), "uid", if_empty("subject", "").alias("subject"), if_empty(sender, "").alias("from"),
        no_array(F.filter(to, lambda x: x.isNotNull() & (x != ""))).alias("to"), "date", body(F.col("html"), F.col("bodyText")).alias("body"),
        if_empty("bodyText", "").alias("bodyText"), attachments.alias("attachments"), no_array("flags").alias("flags"), (F.lit(folder) if folder else F.col("folder")).alias("folder"),
    )


def date_or_now(date: str = "date", now: Column | None = None) -> Column:
    """The date, or the present one, which may be given, where there is none."""
    return F.coalesce(F.col(date), F.localtimestamp() if now is None else now)


def body(html: Column, text: Column) -> Column:
    """The HTML, else the text, else nothing."""
    return F.coalesce(F.nullif(html, F.lit("")), F.nullif(text, F.lit("")), F.lit(""))


def has_attachments(attachments: str = "attachments") -> Column:
    return F.coalesce(F.size(attachments), F.lit(0)) > 0


def summary(messages: DataFrame, include_to: bool = False) -> DataFrame:
    """The columns of a list of messages. Only these are read from a stored table."""
    to = ["to"] if include_to else []
    return messages.select("uid", "subject", "from", *to, "date", "flags", has_attachments().alias("hasAttachments"), preview("bodyText").alias("bodyPreview"))


def as_json(rows: DataFrame) -> DataFrame:
    """(uid, json): each row as compact JSON, dates in ISO form."""
    dates = {name: iso_date(name) for name, kind in rows.dtypes if kind.startswith("timestamp")}
    return rows.select("uid", F.to_json(F.struct(*(dates.get(c, F.col(c)).alias(c) for c in rows.columns))).alias("json"))
