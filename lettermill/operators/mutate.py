"""Deleting and moving: as new tables, or written back to a stored one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import no_array
from ..sources.stored import Store
from .criteria import DELETED, flag
from .select import INBOX, LITERALS

TRASH = "Trash"
#: Old uids of one range, where messages are numbered anew.
BLOCK = 65_536


def _change(messages: DataFrame, uids: Iterable[int], folder: str, column: str, value: Column) -> DataFrame:
    """messages with another value of a column in the folder's rows of these uids. Few uids are
    literals; more are a table, which Spark broadcasts only below its measured limit."""
    wanted = sorted({int(u) for u in uids})
    inside = F.col("folder") == folder
    if len(wanted) <= LITERALS:
        return messages.withColumn(column, F.when(inside & F.col("uid").isin(wanted), value).otherwise(F.col(column)))
    asked = messages.sparkSession.createDataFrame([(u, True) for u in wanted], "uid long, asked boolean")
    changed = messages.join(asked, "uid", "left").withColumn(column, F.when(inside & F.col("asked"), value).otherwise(F.col(column)))
    return changed.select(*messages.columns)


def mark_deleted(messages: DataFrame, uids: Iterable[int], folder: str = INBOX) -> DataFrame:
    return _change(messages, uids, folder, "flags", F.array_union(no_array("flags"), F.array(F.lit(DELETED))))


def expunge(messages: DataFrame, folder: str = INBOX) -> DataFrame:
    """Without the folder's messages that are marked as deleted, whoever marked them."""
    return messages.where(~((F.col("folder") == folder) & flag(DELETED)))


def delete(messages: DataFrame, uids: Iterable[int], folder: str = INBOX) -> DataFrame:
    """Marks and expunges: messages of the folder that were marked before go too."""
    return expunge(mark_deleted(messages, uids, folder), folder)


def _picked(messages: DataFrame, uids: Iterable[int] | DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(the folder's rows of these uids, all other rows). Few uids are literals; more, or a table of
    them, are joined."""
    both = ["folder", "uid"]
    if isinstance(uids, DataFrame):
        asked = uids.select(F.lit(folder).alias("folder"), F.col("uid").cast("long").alias("uid"))
        return messages.join(asked, both, "left_semi").select(*messages.columns), messages.join(asked, both, "left_anti").select(*messages.columns)
    wanted = sorted({int(u) for u in uids})
    inside = F.coalesce(F.col("folder") == folder, F.lit(False))
    if len(wanted) <= LITERALS:
        test = inside & F.coalesce(F.col("uid").isin(wanted), F.lit(False))
        return messages.where(test), messages.where(~test)
    return _picked(messages, messages.sparkSession.createDataFrame([(u,) for u in wanted], "uid long"), folder)


def renumbered(rows: DataFrame, above: Column) -> DataFrame:
    """rows with new uids in order of the old ones, without gaps from the number after `above`.

    Rows are ordered within ranges of old uids only; a range starts at the sum of the sizes of those
    before it, and only these sums are ordered as a whole: one number for each BLOCK uids."""
    blocked = rows.withColumn("own block", F.floor(F.col("uid") / BLOCK))
    sizes = blocked.groupBy("own block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("own block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("own block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("own start"))
    place = F.row_number().over(Window.partitionBy("own block").orderBy("uid"))
    numbered = blocked.withColumn("own place", place).join(starts, "own block")
    return numbered.withColumn("uid", (above + F.col("own start") + F.col("own place")).cast("long")).select(*rows.columns)


def move(messages: DataFrame, uids: Iterable[int] | DataFrame, target: str = TRASH, folder: str = INBOX) -> DataFrame:
    """The messages get new uids in the target, above all that it has, in their old order: so uids
    stay unique there, and its tail has what came last. Uids that aren't there are left out."""
    picked, others = _picked(messages, uids, folder)
    highest = F.coalesce(messages.where(F.col("folder") == target).agg(F.max("uid")).scalar(), F.lit(0))
    return others.unionByName(renumbered(picked, highest).withColumn("folder", F.lit(target)).select(*messages.columns))


def has_folder(messages: DataFrame, folder: str) -> bool:
    return bool(messages.where(F.col("folder") == folder).limit(1).count())


def trash(messages: DataFrame, uids: Iterable[int], folder: str = INBOX, to_trash: bool = True, target: str = TRASH, target_exists: bool | None = None) -> tuple[DataFrame, str, int]:
    """(messages, method, affected): moved to the target folder, or deleted for good where that
    isn't asked for or there is no such folder. affected counts what was asked for."""
    uids = list(uids)
    if to_trash and (has_folder(messages, target) if target_exists is None else target_exists):
        return move(messages, uids, target, folder), "moved_to_trash", len(uids)
    return delete(messages, uids, folder), "permanently_deleted", len(uids)


def write_back(spark: SparkSession, path: str, uids: Iterable[int], folder: str = INBOX, to_trash: bool = True, target: str = TRASH) -> tuple[str, int]:
    """(method, affected): moves or deletes in a stored table. Only the two folders are read and
    written anew, and change at once. A move is refused where there is no such folder, and becomes a
    deletion; whatever else fails is an error, and the table stays as it was."""
    uids, table = list(uids), Store(spark, path)
    if to_trash and (table.has_folder(target) or folder == target):
        table.replace(lambda rows: move(rows, uids, target, folder), [folder, target])
        return "moved_to_trash", len(uids)
    table.replace(lambda rows: delete(rows, uids, folder), [folder])
    return "permanently_deleted", len(uids)
