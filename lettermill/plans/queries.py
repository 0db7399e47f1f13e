"""The queries that are compared with SQL over the same tables.

Each is (query, SQL). Arrays are joined to strings and dates shown as text, so values compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import count_or, escape_html, if_empty, iso_date, preview, shown_date
from ..operators import enrich, mutate, select
from ..sources.messages import SENDER_DOMAINS, derived, providers
from ..sources.mime import lines_of_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BOX = "src3"
UIDS = [3, 23, 23, 43, 999_999_999, 5]

MESSAGES = f"""
m AS (
  SELECT d.doc_id AS uid, d.source AS folder, e.ts AS date, e.user_id, e.event_type, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k,
    split_part(d.text, chr(10), 1) AS subject, d.text AS body_text, p.html, d.n_chars AS size,
    'user' || e.user_id || '@' || list_extract([{", ".join(f"'{d}'" for d in SENDER_DOMAINS)}], CAST(e.user_id % 8 AS INT) + 1) AS sender,
    'user' || ((e.user_id + 1) % 150) || '@example.org' AS to1,
    CASE WHEN e.user_id % 2 = 0 THEN 'user' || ((e.user_id + 7) % 150) || '@' || list_extract([{", ".join(f"'{d}'" for d in SENDER_DOMAINS)}], CAST(e.user_id % 8 AS INT) + 1) END AS to2,
    e.event_type IN ('view', 'click') AS seen, coalesce(l.quality = 1, false) AS flagged, coalesce(l.toxic = 1, false) AS deleted
  FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
), x AS (
  SELECT *, concat_ws(',', CASE WHEN seen THEN '\\Seen' END, CASE WHEN flagged THEN '\\Flagged' END, CASE WHEN deleted THEN '\\Deleted' END) AS flags,
    concat_ws(',', to1, to2) AS to_all, k % 5 = 0 AS attached, strftime(date, '%Y-%m-%d %H:%M:%S') AS shown,
    substr(body_text, 1, 200) || CASE WHEN length(body_text) > 200 THEN '...' ELSE '' END AS preview
  FROM m
)
"""


def sql(select_text: str) -> str:
    return f"WITH {MESSAGES} {select_text}"


def query(name: str, text: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


def _flat(summary: DataFrame) -> DataFrame:
    """Arrays joined, dates shown."""
    columns = {"flags": F.array_join("flags", ","), "to": F.array_join("to", ","), "date": shown_date("date")}
    return summary.select(*(columns.get(c, F.col(c)).alias(c) for c in summary.columns))


SUMMARY = 'uid, subject, sender AS "from", shown AS date, flags, attached AS "hasAttachments", preview AS "bodyPreview"'
SUMMARY_TO = SUMMARY.replace("shown AS date", 'to_all AS "to", shown AS date')


@query("open_box", sql(f"SELECT uid, subject FROM x WHERE folder = '{BOX}'"))
def open_box(spark, sf_dir):
    return select.open_box(derived(spark, sf_dir), BOX).select("uid", "subject")


@query("list_mailboxes", sql("SELECT DISTINCT folder AS path, folder AS name, CAST(NULL AS VARCHAR) AS parent, 0 AS depth FROM x"))
def list_mailboxes(spark, sf_dir):
    return select.mailboxes(derived(spark, sf_dir))


@query("fetch_by_uid", sql(f"SELECT uid, subject, body_text AS \"bodyText\" FROM x WHERE folder = '{BOX}' AND uid IN ({', '.join(map(str, UIDS))})"))
def fetch_by_uid(spark, sf_dir):
    return select.fetch(derived(spark, sf_dir), UIDS, BOX).select("uid", "subject", "bodyText")


@query("details", sql(f"SELECT uid, folder, shown AS date, subject, sender AS \"from\", to_all AS \"to\", html, body_text AS \"bodyText\", CASE WHEN attached THEN 'file' || k || '.pdf' ELSE '' END AS files, flags, size FROM x WHERE uid IN ({', '.join(map(str, UIDS))})"))
def details(spark, sf_dir):
    wanted = spark.createDataFrame([(u,) for u in UIDS], "uid long")
    found = select.fetch(derived(spark, sf_dir), wanted, None)
    return _flat(found.select("uid", "folder", "date", "subject", "from", "to", "html", "bodyText", F.array_join("attachments.filename", ",").alias("files"), "flags", "size"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a parser gives them, with gaps."""
    gap = lambda n, value: F.when(F.col("uid") % n != 0, value)
    m = derived(spark, sf_dir)
    return m.select(
        "uid", "folder", gap(7, F.col("subject")).alias("subject"), F.when(F.col("uid") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("from", F.lit("second"))).alias("from"),
        gap(3, F.concat(F.col("to"), F.array(F.lit(""), F.lit(None)))).alias("to"), "date", F.when(F.col("uid") % 2 == 0, F.lit("")).otherwise(F.col("html")).alias("html"),
        gap(11, F.col("bodyText")).alias("bodyText"),
        gap(4, F.array(F.struct(F.lit(None).cast("string").alias("filename"), F.lit("text/plain").alias("contentType"), F.lit(None).cast("long").alias("size")))).alias("attachments"),
        gap(6, F.col("flags")).alias("flags"),
    )


@query("normalize", sql("""
SELECT CAST(uid AS VARCHAR) AS id, uid, CASE WHEN uid % 7 = 0 THEN '' ELSE subject END AS subject, CASE WHEN uid % 5 = 0 THEN '' ELSE sender END AS "from",
  CASE WHEN uid % 3 = 0 THEN '' ELSE to_all END AS "to", shown AS date, CASE WHEN uid % 11 = 0 THEN '' ELSE body_text END AS "bodyText",
  CASE WHEN uid % 6 = 0 THEN '' ELSE flags END AS flags, CASE WHEN uid % 4 = 0 THEN NULL ELSE ':text/plain:0' END AS files, folder FROM x"""))  # fmt: skip
def normalize(spark, sf_dir):
    out = select.normalize(_raw(spark, sf_dir))
    files = F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["filename"], a["contentType"], a["size"])), ",")
    return _flat(out.select("id", "uid", "subject", "from", "to", "date", "bodyText", "flags", files.alias("files"), "folder"))


@query("body_choice", sql("SELECT uid, coalesce(nullif(CASE WHEN uid % 2 = 0 THEN '' ELSE html END, ''), CASE WHEN uid % 11 = 0 THEN '' ELSE body_text END, '') AS body FROM x"))
def body_choice(spark, sf_dir):
    return select.normalize(_raw(spark, sf_dir)).select("uid", "body")


@query("attachments", sql("SELECT uid, attached AS \"hasAttachments\", CASE WHEN attached THEN 1 ELSE 0 END AS n, CASE WHEN attached THEN k * 1000 END AS size FROM x"))
def attachments(spark, sf_dir):
    return derived(spark, sf_dir).select("uid", select.has_attachments().alias("hasAttachments"), F.size("attachments").alias("n"), F.get("attachments", F.lit(0))["size"].alias("size"))


@query("body_preview", sql('SELECT uid, preview AS "bodyPreview" FROM x'))
def body_preview(spark, sf_dir):
    return derived(spark, sf_dir).select("uid", preview("bodyText").alias("bodyPreview"))


@query("summary_recent", sql(f"SELECT {SUMMARY} FROM x WHERE folder = '{BOX}' ORDER BY uid DESC LIMIT 10"))
def summary_recent(spark, sf_dir):
    return _flat(select.summary(select.tail(select.open_box(derived(spark, sf_dir), BOX), select.RECENT)))


@query("summary_http", sql(f"SELECT {SUMMARY_TO} FROM x"))
def summary_http(spark, sf_dir):
    return _flat(select.summary(derived(spark, sf_dir), include_to=True))


@query("summary_json", sql("SELECT uid, CAST(to_json({'uid': uid, 'from': sender, 'date': strftime(date, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', 'hasAttachments': attached}) AS VARCHAR) AS json FROM x"))
def summary_json(spark, sf_dir):
    return select.as_json(select.summary(derived(spark, sf_dir)).select("uid", "from", "date", "hasAttachments"))


def _search(name: str, criteria, where: str) -> None:
    @query(name, sql(f"SELECT folder, uid FROM x WHERE {where}"))
    def run(spark, sf_dir):
        return select.search(derived(spark, sf_dir), criteria, None).select("folder", "uid")


_search("search_all", ["ALL"], "true")
_search("search_unseen", ["UNSEEN"], "NOT seen")
_search("search_from", ["FROM", "HOTMAIL"], "contains(lower(sender), 'hotmail')")
_search("search_to", ["TO", "User10"], "contains(lower(to1), 'user10') OR contains(lower(coalesce(to2, '')), 'user10')")
_search("search_subject", ["SUBJECT", "THE"], "contains(lower(subject), 'the')")
_search("search_since", ["SINCE", "2-Jan-2024"], "date >= TIMESTAMP '2024-01-02'")
_search("search_before", ["BEFORE", "3-Jan-2024"], "date < TIMESTAMP '2024-01-03'")
_search("search_flags", ["SEEN", "FLAGGED", "UNDELETED", "UNANSWERED", "OLD", "!DRAFT", "UNKEYWORD", "x"], "seen AND flagged AND NOT deleted")
_search("search_body_text", [["OR", ["BODY", "worthless"], ["TEXT", "hotmail"]]], "contains(lower(body_text), 'worthless') OR contains(lower(coalesce(html, '')), 'worthless') OR contains(lower(sender || ' ' || subject || ' ' || body_text || ' ' || to_all || ' ' || coalesce(html, '')), 'hotmail')")
_search("search_on", ["OR", "ON", "2024-01-01", "SENTON", "3-Jan-2024"], "CAST(date AS DATE) IN (DATE '2024-01-01', DATE '2024-01-03')")
_search("search_sent", ["SENTSINCE", "2-Jan-2024", "SENTBEFORE", "3-Jan-2024"], "date >= TIMESTAMP '2024-01-02' AND date < TIMESTAMP '2024-01-03'")
_search("search_size", ["LARGER", "500", "SMALLER", 2000], "size > 500 AND size < 2000")
_search("search_uid_set", ["UID", "1:20,33,35,900:*"], "uid BETWEEN 1 AND 20 OR uid IN (33, 35) OR uid >= least(900, (SELECT max(uid) FROM x))")
_search("search_or_not", ["NOT", ["OR", "SEEN", ["FROM", "gmail.com"]], "HEADER", "Subject", "a"], "NOT (seen OR contains(lower(sender), 'gmail.com')) AND contains(lower(subject), 'a')")

_search("search_header", ["HEADER", "X-Priority", "3", "OR", "HEADER", "RECEIVED", "from b1", "BCC", "hidden"], "k % 5 = 3 AND (contains('from b' || k, 'from b1') OR k % 3 = 0)")
_search("search_header_exists", ["!HEADER", "bcc", "", "HEADER", "message-id", "", "!HEADER", "x-absent", ""], "k % 3 <> 0")

FOUND = ["FROM", ".com", "SUBJECT", "the"]
FOUND_WHERE = f"folder = '{BOX}' AND contains(lower(sender), '.com') AND contains(lower(subject), 'the')"


@query("search_summary", sql(f"SELECT {SUMMARY} FROM x WHERE {FOUND_WHERE} ORDER BY uid DESC LIMIT 20"))
def search_summary(spark, sf_dir):
    return _flat(select.summary(select.tail(select.search(derived(spark, sf_dir), FOUND, BOX), select.FOUND)))


@query("search_limit_20", sql("SELECT uid FROM x WHERE NOT seen ORDER BY uid DESC LIMIT 20"))
def search_limit_20(spark, sf_dir):
    return select.tail(select.search(derived(spark, sf_dir), ["UNSEEN"], None).select("uid"), select.FOUND)


@query("search_counts", sql('SELECT count(*) AS "totalFound", least(count(*), 20) AS count FROM x WHERE NOT seen'))
def search_counts(spark, sf_dir):
    return select.counts(select.search(derived(spark, sf_dir), ["UNSEEN"], None), select.FOUND)


def _tail(name: str, n: int, text: str) -> None:
    @query(name, sql(f"SELECT uid, subject FROM x WHERE folder = '{BOX}' {text}"))
    def run(spark, sf_dir):
        return select.tail(select.open_box(derived(spark, sf_dir), BOX), n).select("uid", "subject")


_tail("recent_10", 10, "ORDER BY uid DESC LIMIT 10")
_tail("recent_zero_is_all", 0, "")
_tail("recent_negative", -7, f"AND uid > (SELECT max(uid) FROM (SELECT uid FROM x WHERE folder = '{BOX}' ORDER BY uid LIMIT 7))")

ADDRESS = "CASE uid % 6 WHEN 0 THEN 'nodomain' WHEN 1 THEN 'a@b@gmail.com' WHEN 2 THEN 'U@GMAIL.COM' ELSE sender END"
DOMAIN = f"split_part({ADDRESS}, '@', 2)"
DETECTED = f"""CASE WHEN NOT contains({ADDRESS}, '@') THEN 'generic' WHEN regexp_matches(lower({DOMAIN}), 'outlook\\.com|hotmail\\.com|live\\.com|msn\\.com') THEN 'outlook'
  WHEN contains(lower({DOMAIN}), 'gmail.com') THEN 'gmail' WHEN contains(lower({DOMAIN}), 'one.com') THEN 'oneCom' ELSE 'generic' END"""


def _address() -> Column:
    by = F.col("uid") % 6
    return F.when(by == 0, "nodomain").when(by == 1, "a@b@gmail.com").when(by == 2, "U@GMAIL.COM").otherwise(F.col("from"))


@query("detect_provider", sql(f"SELECT uid, {ADDRESS} AS address, {DETECTED} AS provider FROM x"))
def detect_provider(spark, sf_dir):
    return derived(spark, sf_dir).select("uid", _address().alias("address")).withColumn("provider", rules.detect_provider("address"))


@query("provider_config", sql(f"""
SELECT uid, CASE WHEN uid % 7 = 0 THEN 'mx.example.net'
    WHEN given = 'exchangeOnPremise' THEN 'mail.' || dom WHEN given IN ('zzz', 'generic') THEN 'imap.' || dom
    WHEN given IN ('outlook', 'exchangeOnline') THEN 'outlook.office365.com' WHEN given = 'gmail' THEN 'imap.gmail.com' ELSE 'imap.one.com' END AS host,
  CASE WHEN uid % 7 = 0 AND uid % 2 = 1 THEN 143 ELSE 993 END AS port
FROM (SELECT *, CASE uid % 5 WHEN 0 THEN 'exchangeOnPremise' WHEN 1 THEN 'zzz' WHEN 2 THEN 'exchangeOnline' ELSE {DETECTED} END AS given,
  CASE WHEN contains({ADDRESS}, '@') THEN {DOMAIN} ELSE 'undefined' END AS dom FROM x)"""))  # fmt: skip
def provider_config(spark, sf_dir):
    uid = F.col("uid")
    given = F.when(uid % 5 == 0, "exchangeOnPremise").when(uid % 5 == 1, "zzz").when(uid % 5 == 2, "exchangeOnline").when(uid % 5 == 3, "")
    host, port = F.when(uid % 7 == 0, "mx.example.net"), F.when(uid % 2 == 0, 0).otherwise(143)
    return derived(spark, sf_dir).select("uid", rules.server(_address(), given, host, port).alias("s")).select("uid", "s.host", "s.port")


@query("list_providers", "SELECT * FROM (VALUES " + ", ".join(f"('{key}', '{name}')" for key, name, _ in rules.PROVIDERS) + ") AS p(key, name)")
def list_providers(spark, sf_dir):
    return providers(spark).select("key", "name")


@query("provider_usage", sql(f"""
SELECT p.key, p.name, p.host, 993 AS port, count(d.uid) AS messages FROM (VALUES {", ".join(f"('{key}', '{name}', '{host}')" for key, name, host in rules.PROVIDERS)}) AS p(key, name, host)
LEFT JOIN (SELECT uid, {DETECTED} AS provider FROM x) d ON d.provider = p.key GROUP BY ALL"""))  # fmt: skip
def provider_usage(spark, sf_dir):
    """Each known provider, with how many messages come from its domains; counted before the join."""
    counted = derived(spark, sf_dir).groupBy(rules.detect_provider(_address()).alias("key")).agg(F.count(F.lit(1)).alias("messages"))
    return providers(spark).join(counted, "key", "left").select("key", "name", "host", "port", F.coalesce("messages", F.lit(0)).alias("messages"))


@query("suggest_hosts", sql(f"""
SELECT uid, array_to_string(list_slice(list_concat(
    CASE WHEN dom IS NOT NULL AND (contains(dom, 'gmail') OR contains(dom, 'googlemail')) THEN ['imap.gmail.com:993 (Gmail)'] ELSE [] END,
    CASE WHEN dom IS NOT NULL AND (contains(dom, 'outlook') OR contains(dom, 'hotmail') OR contains(dom, 'live')) THEN ['outlook.office365.com:993 (Outlook)'] ELSE [] END,
    CASE WHEN dom IS NOT NULL AND contains(dom, 'one.com') THEN ['imap.one.com:993 (One.com)'] ELSE [] END,
    ['imap.' || coalesce(dom, 'undefined') || ':993', 'imap.' || coalesce(dom, 'undefined') || ':143', 'mail.' || coalesce(dom, 'undefined') || ':993', 'mail.' || coalesce(dom, 'undefined') || ':143'],
    CASE WHEN dom IS NULL THEN ['undefined:993', 'undefined:143'] ELSE [] END, ['imap.gmail.com:993', 'imap.gmail.com:143']), 1, 5), ',') AS hosts
FROM (SELECT uid, CASE WHEN contains({ADDRESS}, '@') THEN {DOMAIN} END AS dom FROM x)"""))  # fmt: skip
def suggest_hosts(spark, sf_dir):
    return derived(spark, sf_dir).select("uid", F.array_join(rules.suggest_hosts(_address()), ",").alias("hosts"))


def _kinds(**texts: str) -> tuple[Callable[[], Column], str]:
    """A text for each event type, as a column of the events table (made when called, for columns
    need a session) and in SQL; null for other types."""

    def column() -> Column:
        out = F
        for kind, value in texts.items():
            out = out.when(F.col("event_type") == kind, value)
        return out

    return column, "CASE event_type" + "".join(f" WHEN '{kind}' THEN '{value}'" for kind, value in texts.items()) + " END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id")


TCP, TCP_SQL = _kinds(error="ETIMEDOUT")
TLS, TLS_SQL = _kinds(click="self-signed")
GREETING, GREETING_SQL = _kinds(view=" * OK ready ", purchase="* BYE", click="* OK", signup="* OK")


@query("conn_verdict", f"""
SELECT event_id, {TCP_SQL} IS NULL AND NOT (tls AND {TLS_SQL} IS NOT NULL) AND contains(coalesce({GREETING_SQL}, ''), 'OK') AS success,
  CASE WHEN {TCP_SQL} IS NOT NULL THEN 'TCP-anslutning misslyckades: ETIMEDOUT' WHEN tls AND {TLS_SQL} IS NOT NULL THEN 'TLS-anslutning misslyckades: self-signed'
    WHEN NOT contains(coalesce({GREETING_SQL}, ''), 'OK') THEN 'IMAP-server svarar inte korrekt: ' || trim(coalesce({GREETING_SQL}, '')) ELSE 'Anslutning till h:993 fungerar!' END AS message
FROM (SELECT *, user_id % 3 > 0 AS tls FROM events)""")
def conn_verdict(spark, sf_dir):
    verdict = rules.connection_verdict(F.lit("h"), F.lit(993), F.col("user_id") % 3 > 0, TCP(), TLS(), GREETING())
    return _events(spark, sf_dir).select("event_id", verdict.alias("v")).select("event_id", "v.success", "v.message")


ERROR, ERROR_SQL = _kinds(error="ECONNREFUSED timeout", click="Timeout", view="getaddrinfo ENOTFOUND h", purchase="bad certificate")


@query("error_class", f"""
SELECT event_id, CASE event_type WHEN 'error' THEN '{rules.ERRORS[0][1]}' WHEN 'click' THEN 'Timeout' WHEN 'view' THEN '{rules.ERRORS[1][1]}' WHEN 'purchase' THEN '{rules.ERRORS[4][1]}'
  ELSE '{rules.UNKNOWN_ERROR}' END AS message FROM events""")
def error_class(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", rules.error_message(ERROR()).alias("message"))


CODE, CODE_SQL = _kinds(error="ECONNREFUSED", click="ETIMEDOUT", purchase="EPIPE")


@query("ai_status", """
SELECT event_id, s.status, s.mark || ' AI Service Status: ' || upper(s.status) || chr(10) || s.message AS shown
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS which FROM events) e
JOIN (VALUES (0, 'bridge_down', '🔴', 'OpenAI Bridge (port 8085) is not responding - check if ollama-bridge.py is running'),
  (1, 'timeout', '⏱️', 'GPT-OSS service timeout (>5s) - service may be overloaded or starting up'), (2, 'error', '⚠️', 'GPT-OSS unavailable: EPIPE'),
  (3, 'available', '✅', 'GPT-OSS 20B ready for email analysis'), (4, 'model_unavailable', '❌', 'GPT-OSS 20B model not available in Ollama')) AS s(which, status, mark, message) ON s.which = e.which""")
def ai_status(spark, sf_dir):
    models = F.when(F.col("event_type") == "view", F.array(F.lit("other"), F.lit(rules.MODEL))).otherwise(F.array(F.lit("other")))
    return _events(spark, sf_dir).select("event_id", rules.service_status(CODE(), CODE(), models).alias("s")).select("event_id", "s.status", "s.shown")


@query("ai_failure", """
SELECT event_id, CASE WHEN event_type = 'click' THEN '⏱️ GPT-OSS analysis timeout (>30s) - service may be overloaded' || chr(10) || '💡 Suggestion: Try with a shorter email or retry later'
  WHEN event_type = 'view' THEN '🔄 GPT-OSS service temporarily unavailable (HTTP 503)' || chr(10) || '💡 Suggestion: Model may be loading, try again in a few minutes'
  ELSE '❌ Analysis failed: ' || event_type || chr(10) || '💡 Suggestion: Check AI service status with ''check_ai_status''' END AS message FROM events""")
def ai_failure(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", rules.failure_message(CODE(), F.when(F.col("event_type") == "view", 503).otherwise(500), F.col("event_type")).alias("message"))


@query("connections", "SELECT 'user' || user_id AS \"connectionId\", bool_or(event_type = 'signup') AS connected, count(*) AS events FROM events GROUP BY user_id HAVING bool_or(event_type = 'signup')")
def connections(spark, sf_dir):
    each = _events(spark, sf_dir).groupBy("user_id").agg(F.bool_or(F.col("event_type") == "signup").alias("connected"), F.count(F.lit(1)).alias("events"))
    return each.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("connectionId"), F.coalesce("connected", F.lit(False)).alias("connected"), "events").where("connected")


@query("render_fields", sql("""
SELECT uid, replace(replace(replace(replace(replace(CASE WHEN uid % 7 = 0 THEN 'Inget ämne' ELSE subject || ' <b>&''"' END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS subject,
  'Från: ' || CASE WHEN uid % 5 = 0 THEN 'Okänd avsändare' ELSE sender END AS "from", shown AS date FROM x"""))  # fmt: skip
def render_fields(spark, sf_dir):
    m = derived(spark, sf_dir)
    subject = F.when(F.col("uid") % 7 != 0, F.concat("subject", F.lit(" <b>&'\"")))
    sender = F.when(F.col("uid") % 5 == 0, "").otherwise(F.col("from"))
    return m.select("uid", escape_html(if_empty(subject, "Inget ämne")).alias("subject"), F.concat(F.lit("Från: "), escape_html(if_empty(sender, "Okänd avsändare"))).alias("from"), shown_date("date").alias("date"))


WANTED = f"(folder = '{BOX}' AND uid IN ({', '.join(map(str, UIDS))}))"


@query("delete_permanent", sql(f"SELECT uid, folder, flags FROM x WHERE NOT (folder = '{BOX}' AND (deleted OR uid IN ({', '.join(map(str, UIDS))})))"))
def delete_permanent(spark, sf_dir):
    return mutate.delete(derived(spark, sf_dir), UIDS, BOX).select("uid", "folder", F.array_join("flags", ",").alias("flags"))


MOVED = "CASE WHEN {wanted} THEN '{target}' ELSE folder END AS folder, CASE WHEN {wanted} THEN {above} + row_number() OVER (PARTITION BY {wanted} ORDER BY uid) ELSE uid END AS uid"


@query("move_to_trash", sql(f"SELECT {MOVED.format(wanted=WANTED, target='Trash', above=0)}, subject FROM x"))
def move_to_trash(spark, sf_dir):
    return mutate.trash(derived(spark, sf_dir), UIDS, BOX, target_exists=True)[0].select("uid", "folder", "subject")


OTHER = "src5"


@query("move_to_folder", sql(f"""
SELECT {MOVED.format(wanted="(folder = '" + BOX + "' AND uid % 2 = 1)", target=OTHER, above=f"(SELECT max(uid) FROM x WHERE folder = '{OTHER}')")}, subject FROM x"""))  # fmt: skip
def move_to_folder(spark, sf_dir):
    """Half of a folder, to the end of one that has messages."""
    m = derived(spark, sf_dir)
    return mutate.move(m, select.open_box(m, BOX).where("uid % 2 = 1"), OTHER, BOX).select("uid", "folder", "subject")


@query("delete_fallback", sql(f"SELECT uid, folder, 'permanently_deleted' AS method, {len(UIDS)} AS affected FROM x WHERE NOT (folder = '{BOX}' AND (deleted OR uid IN ({', '.join(map(str, UIDS))})))"))
def delete_fallback(spark, sf_dir):
    left, method, affected = mutate.trash(derived(spark, sf_dir), UIDS, BOX)
    return left.select("uid", "folder", F.lit(method).alias("method"), F.lit(affected).alias("affected"))


ASK = "chr(10) || chr(10) || 'Please provide:' || chr(10) || '1. Category (work/personal/newsletter/spam/notification/urgent)' || chr(10) || '2. Priority (high/medium/low)' || chr(10) || '3. Brief summary (max 50 words)' || chr(10) || '4. Suggested action (respond/archive/read-later/delete/forward)' || chr(10) || '5. Key information extracted' || chr(10) || chr(10) || 'Return as JSON format.'"


@query("ai_prompt", sql(f"""
SELECT uid, 'Analyze this email and provide a structured assessment:' || chr(10) || chr(10) || 'From: ' || sender || chr(10) || 'Subject: ' || subject || chr(10) || 'Date: ' || shown || chr(10) || 'Content: '
  || CASE WHEN body_text = '' THEN 'No text content available' ELSE substr(body_text, 1, 1000) END || {ASK} AS prompt FROM x"""))  # fmt: skip
def ai_prompt(spark, sf_dir):
    return enrich.with_prompt(derived(spark, sf_dir)).select("uid", "prompt")


REPLY, REPLY_SQL = _kinds(error='x {"category":"work","priority":"low","action":"respond"} y', click='{"category":{"a":1}} z', view="no braces", purchase='{"category":"odd"}{"priority":"high"}', signup="{bad}")


@query("ai_reply_parse", f"""
SELECT event_id, CASE event_type WHEN 'error' THEN 'work' WHEN 'purchase' THEN 'odd' END AS category, CASE event_type WHEN 'error' THEN 'low' END AS priority, event_type = 'error' AS valid,
  CASE event_type WHEN 'error' THEN '{{"action":"respond","category":"work","priority":"low"}}' WHEN 'purchase' THEN '{{"category":"odd"}}' ELSE {REPLY_SQL} END AS analysis FROM events""")
def ai_reply_parse(spark, sf_dir):
    out = enrich.with_analysis(_events(spark, sf_dir).withColumn("reply", REPLY()))
    return out.select("event_id", "fields.category", "fields.priority", "valid", "analysis")


LOW = "lower(subject || ' ' || body_text)"


@query("ai_analyze", sql(f"""
SELECT uid, category, CASE category WHEN 'urgent' THEN 'high' WHEN 'newsletter' THEN 'low' WHEN 'spam' THEN 'low' ELSE 'medium' END AS priority,
  CASE category WHEN 'urgent' THEN 'respond' WHEN 'spam' THEN 'delete' WHEN 'newsletter' THEN 'archive' ELSE 'read-later' END AS action, true AS valid
FROM (SELECT uid, CASE WHEN regexp_matches({LOW}, 'urgent|asap') THEN 'urgent' WHEN regexp_matches({LOW}, 'unsubscribe|newsletter') THEN 'newsletter' WHEN regexp_matches({LOW}, 'winner|casino') THEN 'spam'
  WHEN regexp_matches(lower(sender), 'noreply|no-reply') THEN 'notification' ELSE 'work' END AS category FROM x)"""))  # fmt: skip
def ai_analyze(spark, sf_dir):
    return enrich.analyze(derived(spark, sf_dir)).select("uid", "fields.category", "fields.priority", "fields.action", "valid")


@query("iso_dates", sql("SELECT uid, strftime(date, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM x"))
def iso_dates(spark, sf_dir):
    return derived(spark, sf_dir).select("uid", iso_date("date").alias("iso"))


@query("date_default", sql("SELECT uid, strftime(CASE WHEN uid % 3 > 0 THEN date ELSE TIMESTAMP '2024-05-06 07:08:09' END, '%Y-%m-%d %H:%M:%S') AS date FROM x"))
def date_default(spark, sf_dir):
    """The clock's time is given, so that it can be compared."""
    m = derived(spark, sf_dir).withColumn("date", F.when(F.col("uid") % 3 != 0, F.col("date")))
    return m.select("uid", shown_date(select.date_or_now("date", F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"))).alias("date"))


@query("json_lines", """
SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_type <> 'click' AS parsed FROM events""")  # fmt: skip
def json_lines(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_type") == "click", F.concat(F.lit("odd "), "props")).otherwise(F.col("props"))
    lines = lines_of_json(events.select("event_id", "event_type", F.concat(F.lit("\n"), text, F.lit("\n \n")).alias("value")), keep=["event_id", "event_type"])
    return lines.select("event_id", "event_type", F.try_variant_get("parsed", "$.k", "bigint").alias("k"), F.col("parsed").isNotNull().alias("parsed"))


@query("form_count", sql("SELECT uid, CASE uid % 4 WHEN 0 THEN 10 WHEN 1 THEN uid WHEN 2 THEN 10 ELSE uid END AS n FROM x"))
def form_count(spark, sf_dir):
    uid = F.col("uid").cast("string")
    text = F.when(F.col("uid") % 4 == 0, "0").when(F.col("uid") % 4 == 1, F.concat(F.lit(" "), uid)).when(F.col("uid") % 4 == 2, "many").otherwise(F.concat(uid, F.lit("px")))
    return derived(spark, sf_dir).select("uid", count_or(text).cast("long").alias("n"))


_search("search_highest", ["OR", "UID", "*", "UID", "1:3"], "uid = (SELECT max(uid) FROM x) OR uid BETWEEN 1 AND 3")
