"""Further queries: raw mail, all folders at once, folder trees, connections over time, models asked in tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reply import TEXT_IN_PROMPT
from ..functions.requests import NEEDS, TAKEN, UNKNOWN, answers
from ..functions.sql import register_functions
from ..operators import enrich, select
from ..scratch import scratch_folder
from ..sources.messages import derived, store
from ..sources.mime import parse_column
from ..sources.raw_mail import read_raw, write_raw
from ..sources.text_index import TextIndex
from ..streaming import lifecycle
from .queries import BOX, QUERIES, SQL, query, sql

__all__ = ["QUERIES", "SQL"]


def as_mail(messages: DataFrame) -> Column:
    """A message of the derived table as raw mail: parts for text and HTML, and its attachment."""
    word = lambda c: F.concat(F.lit("=?utf-8?b?"), F.replace(F.base64(F.encode(c, "utf-8")), F.lit("\r\n"), F.lit("")), F.lit("?="))
    part = lambda kind, content: F.concat(F.lit(f"--part\r\nContent-Type: {kind}\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(content), F.lit("\r\n"))
    file = F.get("attachments", F.lit(0))
    lines = [
        F.concat(F.lit("Message-ID: <m"), F.col("uid").cast("string"), F.lit("@example.org>")), F.concat(F.lit("From: "), F.col("from")), F.concat(F.lit("To: "), F.array_join("to", ", ")),
        F.concat(F.lit("Subject: "), word(F.col("subject"))), F.concat(F.lit("Date: "), F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")),
        F.lit("MIME-Version: 1.0"), F.lit("Content-Type: multipart/mixed; boundary=part"), F.lit(""), F.lit(""),
    ]
    parts = [
        part("text/plain; charset=utf-8", F.encode("bodyText", "utf-8")), F.coalesce(part("text/html; charset=utf-8", F.encode("html", "utf-8")), F.lit("")),
        F.coalesce(F.concat(F.lit("--part\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="), file["filename"], F.lit("\r\n\r\n"), F.repeat(F.lit("x"), (file["size"] / 1000).cast("int"))), F.lit("")),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), *parts, F.lit("\r\n--part--\r\n")), "utf-8")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived messages, written as raw mail and read again."""
    m, path = derived(spark, sf_dir), scratch_folder(spark)
    write_raw(m.select("folder", "uid", "internal_date", "flags", as_mail(m).alias("content")), path)
    return read_raw(spark, path)


@query("raw_mail", sql("""
SELECT uid, folder, trim(regexp_replace(subject, '\\s+', ' ', 'g')) AS subject, sender AS "from", to_all AS "to", strftime(date, '%Y-%m-%d %H:%M:%S') AS date, md5(coalesce(body_text, '')) AS text_md5, md5(html) AS html_md5,
  CASE WHEN attached THEN 'file' || k || '.pdf:' || k END AS files, flags, '<m' || uid || '@example.org>' AS message_id FROM x"""))  # fmt: skip
def raw_mail(spark, sf_dir):
    """Everything that was written, parsed."""
    found = parse_column(_raw(spark, sf_dir).drop("size"))
    files = F.nullif(F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["filename"], a["size"])), ","), F.lit(""))
    subject = F.trim(F.regexp_replace("subject", r"\s+", " "))
    return found.select(
        "uid", "folder", subject.alias("subject"), F.get("from", F.lit(0)).alias("from"), F.regexp_replace(F.get("to", F.lit(0)), ", ", ",").alias("to"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.md5(F.encode("bodyText", "utf-8")).alias("text_md5"), F.md5(F.encode("html", "utf-8")).alias("html_md5"), files.alias("files"), F.array_join("flags", ",").alias("flags"), F.get(F.col("headers")["message-id"], F.lit(0)).alias("message_id"),
    )


@query("raw_mail_search", sql(f"SELECT uid, folder, flags FROM x WHERE folder = '{BOX}' AND uid > 40 AND uid <= 700 AND date >= TIMESTAMP '2024-01-02'"))
def raw_mail_search(spark, sf_dir):
    """Filters that the source is given: files and mails that don't meet them are never read into rows."""
    found = _raw(spark, sf_dir).where((F.col("folder") == BOX) & (F.col("uid") > 40) & (F.col("uid") <= 700) & (F.col("internal_date") >= F.lit("2024-01-02").cast("timestamp_ntz")))
    return found.select("uid", "folder", F.array_join("flags", ",").alias("flags"))


@query("search_indexed", sql(f"""
SELECT uid, folder FROM x WHERE (contains(lower(body_text), 'worthless') OR contains(lower(coalesce(html, '')), 'worthless') OR contains(lower(sender), 'hotmail')) AND NOT seen"""))  # fmt: skip
def search_indexed(spark, sf_dir):
    """The messages stored, their texts indexed by file, and a search that reads the files that can have it."""
    index = TextIndex(store(derived(spark, sf_dir), scratch_folder(spark)))
    index.build()
    return index.search(["OR", "BODY", "worthless", "FROM", "hotmail", "UNSEEN"], None).select("uid", "folder")


@query("recent_by_folder", sql("SELECT folder, uid, subject FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY uid DESC) AS r FROM x) WHERE r <= 10"))
def recent_by_folder(spark, sf_dir):
    return select.tail_of_each(derived(spark, sf_dir), select.RECENT).select("folder", "uid", "subject")


@query("mailbox_tree", """
WITH f AS (SELECT 'team' || (CAST(substr(source, 4) AS INT) % 4) AS a, source AS b, lang AS c, count(*) AS n FROM documents GROUP BY ALL),
leaf AS (SELECT a, b, string_agg('"' || c || '":{"children":null,"delimiter":"/","messages":' || n || '}', ',' ORDER BY c) AS t FROM f GROUP BY ALL),
middle AS (SELECT a, string_agg('"' || b || '":{"children":{' || t || '},"delimiter":"/","messages":0}', ',' ORDER BY b) AS t FROM leaf GROUP BY ALL)
SELECT a AS root, '{"children":{' || t || '},"delimiter":"/","messages":0}' AS tree FROM middle""")
def mailbox_tree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    team = F.concat(F.lit("team"), (F.substring("source", 4, 10).cast("int") % 4).cast("string"))
    tree = select.mailbox_tree(docs.select(F.concat_ws("/", team, "source", "lang").alias("folder")))
    return tree.select("root", F.to_json("tree").alias("tree"))


GUARD, DELAY = 3600, 1800  # seconds: between events of the tables lie minutes to hours
KINDS = {"signup": "connect", "view": "ready", "error": "error", "purchase": "end"}


@query("connection_lifecycle", f"""
WITH e AS (
  SELECT * FROM (SELECT user_id, event_id, ts, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS kind FROM events) WHERE kind IS NOT NULL
), w AS (
  SELECT * FROM e WHERE ts <= (SELECT max(ts) FROM e) - INTERVAL {DELAY} SECOND
), n AS (
  SELECT *, lead(kind) OVER o AS next, lead(ts) OVER o AS next_at,
    first_value(CASE WHEN kind <> 'ready' THEN {{'ts': ts, 'kind': kind}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS last
  FROM w WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)
), c AS (
  SELECT *, ts + INTERVAL {GUARD} SECOND AS late, coalesce(next_at <= ts + INTERVAL {GUARD} SECOND, false) AS told FROM n WHERE kind = 'connect'
), t AS (
  SELECT user_id, ts AS started, CASE next WHEN 'ready' THEN 'connected' WHEN 'error' THEN 'failed' WHEN 'end' THEN 'ended' ELSE 'replaced' END AS state, next_at AS "at" FROM c WHERE told
  UNION ALL SELECT user_id, ts, 'timed out', late FROM c WHERE NOT told AND late <= (SELECT max(ts) FROM e) - INTERVAL {DELAY} SECOND
  UNION ALL SELECT user_id, ts, CASE last.kind WHEN 'connect' THEN 'replaced' ELSE 'ended' END, last.ts FROM c WHERE told AND next = 'ready' AND last IS NOT NULL
)
SELECT 'user' || user_id AS "connectionId", strftime(started, '%Y-%m-%d %H:%M:%S.%g') AS started, state, strftime("at", '%Y-%m-%d %H:%M:%S.%g') AS "at" FROM t""")
def connection_lifecycle(spark, sf_dir):
    """A stream of the events, run to the end of what there is."""
    events = lifecycle.events_of(spark, f"{sf_dir}/events.parquet", KINDS)
    done = lifecycle.run_to_end(lifecycle.states(events, GUARD, DELAY), scratch_folder(spark))
    return done.select("connectionId", F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSS").alias("started"), "state", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


def rule_model(prompt: str) -> str:
    """A model that answers by rules, for comparison with SQL."""
    sender, _, rest = prompt.partition("\nSubject: ")
    domain = sender.rpartition("@")[2].lower()
    kind = {"gmail.com": "personal", "one.com": "newsletter", "msn.com": "spam"}.get(domain, "work")
    words = len(rest.partition("\nContent: ")[2].partition("\n\nPlease provide:")[0])
    return f'Well: {{"category":"{kind}","priority":"{"high" if words > 500 else "low"}","action":"{"delete" if kind == "spam" else "archive"}"}} as asked.'


CONTENT = "length(CASE WHEN body_text = '' THEN 'No text content available' ELSE substr(body_text, 1, 1000) END)"


@query("ai_ask", sql(f"""
SELECT uid, CASE split_part(lower(sender), '@', 2) WHEN 'gmail.com' THEN 'personal' WHEN 'one.com' THEN 'newsletter' WHEN 'msn.com' THEN 'spam' ELSE 'work' END AS category,
  CASE WHEN {CONTENT} > 500 THEN 'high' ELSE 'low' END AS priority, CASE WHEN split_part(lower(sender), '@', 2) = 'msn.com' THEN 'delete' ELSE 'archive' END AS action, true AS valid, CAST(NULL AS VARCHAR) AS error FROM x"""))  # fmt: skip
def ai_ask(spark, sf_dir):
    """Prompts sent to a model in tasks, equal ones once; a second run finds all replies in the table."""
    m, found, replies = derived(spark, sf_dir, TEXT_IN_PROMPT).select("uid", "from", "subject", "date", "bodyText"), scratch_folder(spark), scratch_folder(spark)
    m.write.parquet(found)  # read by both runs, several times each: the joins are made once
    m = spark.read.schema(m.schema).parquet(found)
    enrich.analyze(m, rule_model, replies=replies)
    return enrich.analyze(m, rule_model, replies=replies).select("uid", "fields.category", "fields.priority", "fields.action", "valid", "error")


REQUESTS = {"signup": "connect", "purchase": "disconnect", "view": "search", "click": "recent", "error": "delete"}
_named = lambda text: "'" + text.replace("'", "''").replace("{id}", "' || id || '") + "'"


@query("connection_requests", f"""
WITH r AS (
  SELECT event_id, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in REQUESTS.items())} END AS kind, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'user' || (user_id % 50) END AS id,
    CASE WHEN event_id % 7 <> 0 THEN 'u' || user_id || '@example.org' END AS email, event_id % 13 = 0 AS no_password, event_id % 5 = 0 AS no_criteria, event_id % 3 = 0 AS no_uids FROM events
), l AS (
  SELECT *, id = '' OR (kind = 'connect' AND (email IS NULL OR no_password)) OR (kind = 'search' AND no_criteria) OR (kind = 'delete' AND no_uids) AS lacks FROM r
), k AS (
  SELECT *, id <> '' AND coalesce(last_value(CASE WHEN kind = 'connect' AND NOT lacks THEN true WHEN kind = 'disconnect' AND NOT lacks THEN false END IGNORE NULLS)
    OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS known FROM l
)
SELECT event_id, known, CASE WHEN lacks OR (kind = 'connect' AND known) THEN 400 WHEN kind <> 'connect' AND NOT known THEN 404 ELSE 200 END AS status,
  CASE WHEN lacks THEN CASE kind {' '.join(f"WHEN '{k}' THEN '{text}'" for k, (_, text) in NEEDS.items())} END WHEN kind = 'connect' AND known THEN {_named(TAKEN)}
    WHEN kind = 'connect' THEN 'Ansluten till ' || email || ' som ' || id WHEN NOT known THEN {_named(UNKNOWN)} WHEN kind = 'disconnect' THEN 'Frånkopplad från ' || id END AS message FROM k""")
def connection_requests(spark, sf_dir):
    events, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in REQUESTS.items() for x in pair)), F.col("event_type"))
    asked = events.select(
        n.alias("event_id"), n.alias("number"), kind.alias("kind"), F.when(n % 11 == 0, "").otherwise(F.concat(F.lit("user"), (F.col("user_id") % 50).cast("string"))).alias("connectionId"),
        F.when(n % 7 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org"))).alias("email"), F.when(n % 13 == 0, "").otherwise("secret").alias("password"),
        F.when(n % 5 != 0, "ALL").alias("criteria"), F.when(n % 3 != 0, F.array(n)).alias("uids"),
    )
    return answers(asked).select("event_id", "known", "status", "message")


@query("sql_search", sql("SELECT folder, uid FROM x WHERE NOT (seen OR contains(lower(sender), 'gmail.com')) AND contains(lower(subject), 'a') AND date >= TIMESTAMP '2024-01-02' AND k % 5 = 3"))
def sql_search(spark, sf_dir):
    """Criteria in SQL text, over a view."""
    register_functions(spark)
    derived(spark, sf_dir).createOrReplaceTempView("mail_of_tables")
    return spark.sql("""
        SELECT folder, uid FROM mail_of_tables WHERE NOT (mail_flag(flags, 'Seen') OR mail_text(`from`, 'GMAIL.com')) AND mail_text(subject, 'A')
          AND mail_since(internal_date, mail_day('2-Jan-2024')) AND mail_header(headers, 'X-Priority', '3')""")
