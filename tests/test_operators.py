import pytest
from pyspark.sql import functions as F

from lettermill.functions import reply, rules, text
from lettermill.operators import enrich, mutate, select
from lettermill.plans.engine import Engine, RequestError
from lettermill.schema import MESSAGE
from lettermill.sources import mime
from lettermill.sources.messages import providers, store, stored


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def box(spark):
    base = dict.fromkeys(MESSAGE.names)
    rows = [tuple({**base, "uid": i, "folder": "INBOX", "flags": ["\\Deleted"] if i == 2 else [], "bodyText": "x" * 100 * i, "subject": f"s{i}", "from": f"u{i}@gmail.com"}[n] for n in MESSAGE.names) for i in range(1, 11)]
    return spark.createDataFrame(rows, MESSAGE)


@pytest.mark.parametrize(("n", "dots"), [(0, False), (5, False), (200, False), (201, True)])
def test_preview(spark, n, dots):
    assert one(spark, text.preview(F.lit("é" * n))) == "é" * min(n, 200) + "..." * dots


def test_defaults(spark):
    assert one(spark, text.preview(F.lit(None).cast("string"))) == ""
    assert one(spark, text.if_empty(F.lit(""), "d")) == "d" and one(spark, text.if_null(F.lit(""), "d")) == ""
    assert [one(spark, text.count_or(F.lit(x))) for x in ("7", "0", "x", "12abc", None)] == [7, 10, 10, 12, 10]
    assert one(spark, text.escape_html(F.lit("<a href=\"x\">'&"))) == "&lt;a href=&quot;x&quot;&gt;&#039;&amp;"


@pytest.mark.parametrize(("address", "key"), [("nodomain", "generic"), ("a@GMAIL.COM", "gmail"), ("a@phone.com", "oneCom"), ("a@x.hotmail.com.br", "outlook"), ("a@b@gmail.com", "generic"), ("a@one.com", "oneCom")])
def test_detect(spark, address, key):
    assert one(spark, rules.detect_provider(F.lit(address))) == key


def test_server(spark):
    def got(address, provider=None, host=None, port=None):
        s = one(spark, rules.server(F.lit(address), F.lit(provider).cast("string"), F.lit(host).cast("string"), F.lit(port).cast("int")))
        return s["host"], s["port"]

    assert got("a@b.se", port=143) == ("imap.b.se", 993)
    assert got("a@b.se", host="h", port=0) == ("h", 993) and got("a@b.se", host="h", port=143) == ("h", 143)
    assert got("a@B.se", "zzz") == ("imap.B.se", 993) and got("x", "exchangeOnPremise") == ("mail.undefined", 993)
    assert got("a@gmail.com") == ("imap.gmail.com", 993)


def test_suggestions(spark):
    assert one(spark, rules.suggest_hosts(F.lit("u@gmail.com"))) == ["imap.gmail.com:993 (Gmail)", "imap.gmail.com:993", "imap.gmail.com:143", "mail.gmail.com:993", "mail.gmail.com:143"]
    assert one(spark, rules.suggest_hosts(F.lit("x")))[:2] == ["imap.undefined:993", "imap.undefined:143"]


def test_errors_and_status(spark):
    assert one(spark, rules.error_message(F.lit("ECONNREFUSED timeout"))) == rules.ERRORS[0][1]
    assert one(spark, rules.error_message(F.lit("Timeout"))) == "Timeout"
    none = F.lit(None).cast("string")
    assert one(spark, rules.service_status(none, none, F.array(F.lit(rules.MODEL))))["status"] == "available"
    assert one(spark, rules.service_status(none, none, F.lit(None).cast("array<string>")))["status"] == "model_unavailable"
    assert one(spark, rules.service_status(none, F.lit("odd"), F.array(F.lit(rules.MODEL))))["message"] == "GPT-OSS unavailable: odd"


def test_replies(spark):
    assert one(spark, reply.analysis_text(F.lit('x {"a":{"b":1}} y'))) == 'x {"a":{"b":1}} y'
    assert one(spark, reply.analysis_text(F.lit('x {"a":1} y'))) == '{"a":1}'
    assert one(spark, reply.balanced_braces(F.lit('x {"a":{"b":{}}} {"c":1}'))) == '{"a":{"b":{}}}'
    assert one(spark, reply.balanced_braces(F.lit("none"))) is None


def test_tails(box):
    uids = lambda n: sorted(r["uid"] for r in select.tail(box, n).collect())
    assert uids(0) == list(range(1, 11)) and uids(3) == [8, 9, 10] and uids(-3) == list(range(4, 11)) and uids(99) == list(range(1, 11)) and uids(-99) == []
    assert [tuple(select.counts(box, n).first()) for n in (0, 3, -3, 99)] == [(10, 10), (10, 3), (10, 7), (10, 10)]


def test_fetch(spark, box):
    assert [r["uid"] for r in select.fetch(box, [1, 1, 999]).collect()] == [1]
    assert sorted(r["uid"] for r in select.fetch(box, range(2000)).collect()) == list(range(1, 11))
    assert select.fetch(box, []).count() == 0 and select.fetch(box, [1], "Other").count() == 0


def test_normalize(spark):
    kind = "uid long, subject string, from array<string>, to string, date timestamp_ntz, html string, bodyText string, attachments array<struct<filename:string,contentType:string,size:long>>, flags array<string>"
    raw = spark.createDataFrame([(1, None, [], None, None, "", "t", [(None, None, None)], None), (2, "s", ["a", "b"], "x", None, None, None, None, ["f"])], kind)
    a, b = select.normalize(raw, "INBOX").orderBy("uid").collect()
    assert (a["id"], a["subject"], a["from"], a["to"], a["body"], a["flags"], a["folder"]) == ("1", "", "", [], "t", [], "INBOX")
    assert tuple(a["attachments"][0]) == ("", "", 0)
    assert (b["from"], b["to"], b["body"], b["bodyText"], b["attachments"]) == ("a", ["x"], "", "", None)
    assert raw.select(select.has_attachments().alias("h"), select.date_or_now().alias("d")).where("d IS NOT NULL").count() == 2


def test_mutations(box):
    left = lambda df: sorted(r["uid"] for r in df.collect())
    assert left(mutate.delete(box, [1])) == list(range(3, 11))  # what was marked before goes too
    moved, method, n = mutate.trash(box, [1, 99], target_exists=True)
    assert (method, n) == ("moved_to_trash", 2) and moved.where("folder = 'Trash'").count() == 1
    gone, method, _ = mutate.trash(box, [1])
    assert method == "permanently_deleted" and left(gone) == list(range(3, 11))
    assert mutate.trash(moved, [3])[1] == "moved_to_trash"


def test_many_uids(box):
    many = list(range(3, 2003))
    assert sorted(r["uid"] for r in mutate.delete(box, many).collect()) == [1]
    moved = mutate.move(box, many)
    assert moved.columns == box.columns and moved.where("folder = 'Trash'").count() == 8


def test_attached_messages_and_malformed_mail():
    inner = b"From: z@z.org\r\nSubject: inner\r\n\r\nINNER TEXT"
    raw = b"From: a@b.c\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nbody\r\n--q\r\nContent-Type: message/rfc822\r\nContent-Disposition: attachment; filename=m.eml\r\n\r\n" + inner + b"\r\n--q--\r\n"
    out = mime.parse(raw)
    assert out["bodyText"].strip() == "body" and [(f["filename"], f["contentType"]) for f in out["attachments"]] == [("m.eml", "message/rfc822")] and out["attachments"][0]["size"] > 20
    for odd in (b"\xff\xfe\0", b"From: \"<@@@\r\nDate: x\r\nContent-Type: multipart/mixed\r\n\r\n", b"To: =?utf-8?b?!!?=\r\n :x\r\n\r\n", b"Content-Type: message/rfc822\r\n\r\n", b"Content-Type: text/plain; charset=nope\r\n\r\n\xff"):
        assert set(mime.parse(odd)) == set(out)


def limits(prompt):
    return f'{{"category": "work", "priority": "low", "action": "archive", "summary": "{prompt.temperature} {prompt.max_tokens} {prompt.seconds} {len(prompt.system) > 20}"}}'


def test_backend_gets_limits(box):
    assert enrich.analyze(box.where("uid = 1"), limits).first()["fields"]["summary"] == "0.3 300 30 True"


def test_rules_are_evaluated_once(box):
    plan = enrich.analyze(box)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("rlike") <= 4


def test_status_and_test_connection(spark, box):
    engine = Engine(spark)
    engine.register("me", box)
    assert tuple(engine.status().first()) == (True, 1)
    good, bad = engine.test_connection("u@gmail.com", greeting="* OK").first(), engine.test_connection("u@x.org", custom_host="h", custom_port=143, tcp_error="late").first()
    assert (good["host"], good["success"], good["tls"], good["suggestions"]) == ("imap.gmail.com", True, True, None)
    assert (bad["host"], bad["port"], bad["success"], bad["message"], len(bad["suggestions"])) == ("h", 143, False, "TCP-anslutning misslyckades: late", 5)
    with pytest.raises(RequestError):
        engine.test_connection("")
    assert engine.details("me", [1]).where("date IS NOT NULL").count() == 1


def test_mailboxes(spark):
    rows = select.mailboxes(spark.createDataFrame([("a/b/c",), ("a",), ("d",)], "folder string")).orderBy("path").collect()
    assert [tuple(r) for r in rows] == [("a", "a", None, 0), ("a/b", "b", "a", 1), ("a/b/c", "c", "a/b", 2), ("d", "d", None, 0)]


def failing(prompt):
    if "u3@" in prompt:
        raise TimeoutError("late")
    return 'Sure: {"category": "work", "priority": "low", "action": "archive"}'


def test_backends(box):
    rows = {r["uid"]: r for r in enrich.analyze(box.where("uid < 5"), failing).collect()}
    assert rows[1]["valid"] and rows[1]["fields"]["action"] == "archive" and rows[3]["error"] == "late" and not rows[3]["valid"]
    assert all(r["valid"] for r in enrich.analyze(box).collect())


def test_engine(spark, box):
    engine = Engine(spark)
    engine.register("me", box, view=True)
    with pytest.raises(RequestError):
        engine.register("me", box)
    with pytest.raises(RequestError):
        engine.recent("you")
    with pytest.raises(RequestError):
        engine.delete("me", "12")
    with pytest.raises(RequestError):
        engine.search("me", None)
    with pytest.raises(RequestError):
        engine.analyze("me", [1], status="timeout")
    assert engine.recent("me", count=2, include_to=True).columns == ["uid", "subject", "from", "to", "date", "flags", "hasAttachments", "bodyPreview"]
    assert engine.search("me", ["FROM", "u1"], limit=1).first()["uid"] == 10
    assert tuple(engine.search_counts("me", ["ALL"], limit=4).first()) == (10, 4)
    assert engine.details("me", [4]).first()["subject"] == "s4"
    assert engine.analyze("me", [4]).count() == 1 and engine.providers().count() == 6 and engine.connections().count() == 1
    assert engine.service_status("ETIMEDOUT").first()["status"] == "timeout" and engine.count_from_form("0") == 10
    assert engine.mailboxes("me").first()["path"] == "INBOX" and spark.table("me").count() == 10
    assert engine.delete("me", [1]) == ("permanently_deleted", 1) and engine.search_counts("me", ["ALL"]).first()["totalFound"] == 8
    engine.close()
    assert not engine.connected("me")


def test_sources(spark, box, tmp_path):
    store(box, f"{tmp_path}/m")
    assert select.open_box(stored(spark, f"{tmp_path}/m")).count() == 10
    assert providers(spark).count() == 6
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail/a.eml").write_bytes(b"From: A <a@x.org>\r\nTo: b@y.org\r\nSubject: =?utf-8?q?H=C3=A9?=\r\nDate: Mon, 1 Jan 2024 10:00:00 +0100\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nhi \xc3\xa9\r\n--q\r\nContent-Type: text/html\r\n\r\n<b>hi</b>\r\n--q\r\nContent-Type: application/pdf; name=f.pdf\r\nContent-Disposition: attachment; filename=f.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\naGVsbG8=\r\n--q--\r\n")
    (tmp_path / "mail/b.eml").write_bytes(b"\r\n")  # Spark passes over files without any bytes
    mails = {r["path"][-5:]: r for r in mime.read_eml(spark, f"file://{tmp_path}/mail").collect()}
    a, b = mails["a.eml"], mails["b.eml"]
    assert a["subject"] == "Hé" and a["from"] == ["A <a@x.org>"] and str(a["date"]) == "2024-01-01 09:00:00" and a["bodyText"].strip() == "hi é" and a["html"].strip() == "<b>hi</b>"
    assert [tuple(x) for x in a["attachments"]] == [("f.pdf", "application/pdf", 5)] and b["subject"] is None
    lines = mime.lines_of_json(spark.createDataFrame([('{"a":1}\n\nodd\n',)], "value string"))
    assert [(r["line"], r["parsed"] is None) for r in lines.select("line", F.to_json("parsed").alias("parsed")).collect()] == [('{"a":1}', False), ("odd", True)]


def test_arrivals(spark, box, tmp_path):
    from lettermill.streaming.arrivals import arrivals, once, watch

    dated = box.withColumn("internal_date", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    dated.unionAll(dated).write.parquet(f"{tmp_path}/in")
    running = watch(once(arrivals(spark, f"{tmp_path}/in")), ["FROM", "u1"], f"{tmp_path}/state").format("memory").queryName("seen").trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert sorted(r["uid"] for r in spark.table("seen").collect()) == [1, 10]
