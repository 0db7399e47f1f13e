"""A log of requests to connections, answered in order: what is refused, and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The arguments that each kind of request needs, and what one without them is told.
NEEDS = {
    "connect": (("connectionId", "email", "password"), "connectionId, email och password krävs"),
    "disconnect": (("connectionId",), "connectionId krävs"),
    "recent": (("connectionId",), "connectionId krävs"),
    "mailboxes": (("connectionId",), "connectionId krävs"),
    "search": (("connectionId", "criteria"), "connectionId och criteria krävs"),
    "delete": (("connectionId", "uids"), "connectionId och uids (array) krävs"),
}
#: What is told of a connection, with {id} and {email} for these.
TAKEN, UNKNOWN = "Anslutning med ID '{id}' finns redan", "Anslutning '{id}' hittades inte"
CONNECTED, DISCONNECTED = "Ansluten till {email} som {id}", "Frånkopplad från {id}"


def _missing(name: str, kind: str) -> Column:
    return F.col(name).isNull() if kind.startswith("array") else F.col(name).isNull() | (F.col(name) == "")


def _told(text: str) -> Column:
    return F.replace(F.replace(F.lit(text), F.lit("{id}"), F.col("connectionId")), F.lit("{email}"), F.coalesce("email", F.lit("")))


def answers(requests: DataFrame) -> DataFrame:
    """requests with status, message and known (whether the connection was there before).

    requests: number (their order), kind, connectionId, email, password, criteria, uids. A connection is
    there from a connect with all its arguments until a disconnect; a second connect is refused and
    changes nothing. Requests of one connection are followed in order, those of others side by side.
    An unknown kind is refused as one that isn't there (404) without a message.
    """
    kinds = dict(requests.dtypes)
    lacks = F.lit(False)
    for kind, (names, _) in NEEDS.items():
        lacks = lacks | (F.col("kind") == kind) & reduce(lambda a, b: a | b, (_missing(n, kinds[n]) for n in names))
    lacking = reduce(lambda out, k: out.when(F.col("kind") == k, NEEDS[k][1]), NEEDS, F)
    marked = requests.withColumn("own lacks", F.coalesce(lacks, F.lit(False)))
    turn = F.when((F.col("kind") == "connect") & ~F.col("own lacks"), True).when((F.col("kind") == "disconnect") & ~F.col("own lacks"), False)
    before = Window.partitionBy("connectionId").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    known = marked.withColumn("known", F.coalesce(F.last(turn, ignorenulls=True).over(before), F.lit(False)) & ~_missing("connectionId", "string"))
    listed, connect = F.col("kind").isin(*NEEDS), F.col("kind") == "connect"
    status = F.when(F.col("own lacks") | connect & F.col("known"), 400).when(~F.coalesce(listed, F.lit(False)) | ~connect & ~F.col("known"), 404).otherwise(200)
    message = (
        F.when(F.col("own lacks"), lacking).when(~F.coalesce(listed, F.lit(False)), F.lit(None)).when(connect & F.col("known"), _told(TAKEN)).when(connect, _told(CONNECTED))
        .when(~F.col("known"), _told(UNKNOWN)).when(F.col("kind") == "disconnect", _told(DISCONNECTED))
    )
    return known.withColumn("status", status).withColumn("message", message).drop("own lacks")
