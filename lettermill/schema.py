"""The message table."""

from __future__ import annotations

from pyspark.sql import types as T

ATTACHMENT = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("contentType", T.StringType()),
    T.StructField("size", T.LongType()),
])

#: Further fields of the head by their lower-cased names, in order where they repeat.
HEADERS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

#: internal_date is when the server got a message, date what its head says. folder is a partition column where stored.
MESSAGE = T.StructType([
    T.StructField("uid", T.LongType()),
    T.StructField("folder", T.StringType()),
    T.StructField("internal_date", T.TimestampNTZType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("subject", T.StringType()),
    T.StructField("from", T.StringType()),
    T.StructField("to", T.ArrayType(T.StringType())),
    T.StructField("cc", T.ArrayType(T.StringType())),
    T.StructField("html", T.StringType()),
    T.StructField("bodyText", T.StringType()),
    T.StructField("attachments", T.ArrayType(ATTACHMENT)),
    T.StructField("flags", T.ArrayType(T.StringType())),
    T.StructField("size", T.LongType()),
    T.StructField("headers", HEADERS),
])
