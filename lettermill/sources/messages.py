"""Message tables: stored ones, and one derived from the test tables, which hold no mail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import PORT, PROVIDERS
from ..schema import MESSAGE
from .stored import Store

#: Of the derived messages: a sender's domain by user_id % 8.
SENDER_DOMAINS = ["outlook.com", "Hotmail.com", "gmail.com", "one.com", "live.com", "msn.com", "phone.com", "example.org"]


def derived(spark: SparkSession, sf_dir: str, chars: int | None = None) -> DataFrame:
    """A message for each document, with dates, senders and flags made from the other tables.

    Equi-joins on the document's id only; Spark chooses how by size. chars: for who needs no more than the
    beginning of a text, so many characters of bodyText; the rest then isn't shuffled. Subjects are whole.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    events = read("events").select(F.col("event_id").alias("uid"), "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    pages = read("pages").select(F.col("page_id").alias("uid"), "html")
    labels = read("labels").select(F.col("doc_id").alias("uid"), "quality", "toxic")
    docs = read("documents").withColumnRenamed("doc_id", "uid")
    subject = F.substring_index("text", "\n", 1)
    if chars is not None:
        docs, subject = docs.select("uid", "source", "n_chars", subject.alias("subject"), F.substring("text", 1, chars).alias("text")), F.col("subject")
    user = lambda n: F.concat(F.lit("user"), (F.col("user_id") + n).cast("string") if n == 0 else ((F.col("user_id") + n) % 150).cast("string"))
    domain = F.get(F.array(*map(F.lit, SENDER_DOMAINS)), (F.col("user_id") % 8).cast("int"))
    sender = F.concat(user(0), F.lit("@"), domain)
    flags = F.array_compact(F.array(
        F.when(F.col("event_type").isin("view", "click"), F.lit("\\Seen")),
        F.when(F.col("quality") == 1, F.lit("\\Flagged")),
        F.when(F.col("toxic") == 1, F.lit("\\Deleted")),
    ))
    file = F.struct(F.concat(F.lit("file"), F.col("k").cast("string"), F.lit(".pdf")).alias("filename"), F.lit("application/pdf").alias("contentType"), (F.col("k") * 1000).alias("size"))
    k = F.col("k").cast("string")
    bcc = F.when(F.col("k") % 3 == 0, F.array(F.concat(F.lit("hidden"), k, F.lit("@example.org")))).otherwise(F.array().cast("array<string>"))
    headers = F.map_from_arrays(
        F.array(*map(F.lit, ("message-id", "x-priority", "received", "bcc"))),
        F.array(F.array(F.concat(F.lit("<m"), F.col("uid").cast("string"), F.lit("@example.org>"))), F.array((F.col("k") % 5).cast("string")), F.array(F.concat(F.lit("from a"), k), F.concat(F.lit("from B"), k)), bcc),
    )
    return docs.join(events, "uid").join(pages, "uid", "left").join(labels, "uid", "left").select(
        "uid", F.col("source").alias("folder"), F.col("ts").alias("internal_date"), F.col("ts").alias("date"),
        subject.alias("subject"), sender.alias("from"),
        F.when(F.col("user_id") % 2 == 0, F.array(F.concat(user(1), F.lit("@example.org")), F.concat(user(7), F.lit("@"), domain))).otherwise(F.array(F.concat(user(1), F.lit("@example.org")))).alias("to"),
        F.array().cast("array<string>").alias("cc"), "html", F.col("text").alias("bodyText"),
        F.when(F.col("k") % 5 == 0, F.array(file)).otherwise(F.array().cast("array<struct<filename:string,contentType:string,size:long>>")).alias("attachments"),
        flags.alias("flags"), F.col("n_chars").alias("size"), headers.alias("headers"),
    )


def store(messages: DataFrame, path: str) -> Store:
    """A new stored table: a folder for each mail folder, in order of uid. A folder's scan then reads its
    own files only, and uid ranges skip row groups."""
    table = Store(messages.sparkSession, path)
    table.create(messages)
    return table


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of a stored table; or messages in plain Parquet files, by folder or not. Types
    are those of the message table, never guessed: a folder 007 keeps its name."""
    table = Store(spark, path)
    return table.read() if table.exists() else spark.read.schema(MESSAGE).parquet(path)


def providers(spark: SparkSession) -> DataFrame:
    """The six known providers: key, name, host, port."""
    return spark.createDataFrame([(*row, PORT) for row in PROVIDERS], "key string, name string, host string, port int")
