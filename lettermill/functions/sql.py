"""Search criteria as functions of SQL, for views of message tables.

    register_functions(spark)
    spark.sql("SELECT uid FROM work WHERE mail_text(`from`, 'ann') AND NOT mail_flag(flags, 'Seen') AND mail_since(internal_date, DATE '2024-01-01')")

They are SQL functions themselves, which Spark puts into the query's plan: so comparisons of dates reach
the scan, and nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, result). A test of what isn't there is false, so its negation holds.
FUNCTIONS = {
    "mail_flag": ("flags ARRAY<STRING>, name STRING", "coalesce(array_contains(flags, concat('\\\\', name)), false)"),
    "mail_keyword": ("flags ARRAY<STRING>, name STRING", "coalesce(array_contains(flags, name), false)"),
    "mail_text": ("value STRING, part STRING", "coalesce(contains(lower(value), lower(part)), false)"),
    "mail_any": ("list ARRAY<STRING>, part STRING", "coalesce(exists(list, x -> contains(lower(x), lower(part))), false)"),
    "mail_header": ("headers MAP<STRING, ARRAY<STRING>>, name STRING, part STRING", "coalesce(exists(try_element_at(headers, lower(name)), x -> contains(lower(x), lower(part))), false)"),
    "mail_since": ("moment TIMESTAMP_NTZ, day DATE", "moment >= CAST(day AS TIMESTAMP_NTZ)"),
    "mail_before": ("moment TIMESTAMP_NTZ, day DATE", "moment < CAST(day AS TIMESTAMP_NTZ)"),
    "mail_on": ("moment TIMESTAMP_NTZ, day DATE", "moment >= CAST(day AS TIMESTAMP_NTZ) AND moment < CAST(date_add(day, 1) AS TIMESTAMP_NTZ)"),
    "mail_day": ("shown STRING", "coalesce(try_to_date(shown, 'd-MMM-yyyy'), try_to_date(shown, 'yyyy-MM-dd'))"),
}


def register_functions(spark: SparkSession) -> None:
    """Makes the functions known to the session, anew if they are."""
    for name, (parameters, result) in FUNCTIONS.items():
        kind = "DATE" if name == "mail_day" else "BOOLEAN"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {result}")
