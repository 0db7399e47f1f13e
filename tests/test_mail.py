"""Raw mail, all folders at once, folder trees, connections over time, models asked in tasks."""

import json
import os
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lettermill.operators import enrich, select
from lettermill.sources import raw_mail
from lettermill.streaming import lifecycle

D = datetime
KIND = "folder string, uid long, internal_date timestamp_ntz, flags array<string>, content binary"


@pytest.fixture
def raw(spark, tmp_path):
    rows = [(f, i, D(2024, 1, 1) + timedelta(hours=5 * i), ["\\Seen"] if i % 2 else [], f"Subject: m{i}\r\n\r\nFrom here on\n>From there\nend{i}".encode()) for f in ("INBOX", "007", "a/b c") for i in range(1, 31)]
    rows += [("odd", 1, None, None, b""), ("odd", 2, D(2024, 5, 5), ["a b"], b"\n\nFrom \n"), ("odd", 3, D(2024, 5, 6), [], b"x" * 3_000_000)]
    df = spark.createDataFrame(rows, KIND)
    for n in range(4):
        raw_mail.write_raw(df.where(F.floor(F.col("uid") / 10) == n), f"{tmp_path}/raw")
    return raw_mail.read_raw(spark, f"{tmp_path}/raw"), {(r[0], r[1]): r for r in rows}, f"{tmp_path}/raw"


def test_raw_mail_comes_back(raw):
    df, rows, _ = raw
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["folder"], r["uid"], r["internal_date"], r["flags"], bytes(r["content"])) == rows[r["folder"], r["uid"]] and r["size"] == len(r["content"])


@pytest.mark.parametrize("where", [
    "folder = '007'", "folder IN ('INBOX', 'odd') AND uid >= 2", "uid > 9 AND uid <= 21", "uid = 10", "uid IN (3, 25, 99)", "internal_date > '2024-01-03 10:00:00'", "internal_date <= '2024-01-02 00:00:00' AND folder = 'INBOX'",
    "internal_date = '2024-01-02 01:00:00'", "internal_date IS NULL", "folder = 'nowhere'", "uid = 3 OR folder = 'odd'", "NOT folder = 'INBOX' AND array_contains(flags, '\\\\Seen')", "internal_date IN ('2024-01-02 01:00:00', '2024-05-06')",
])
def test_filters(spark, raw, where):
    df, rows, _ = raw
    plain = spark.createDataFrame(list(rows.values()), KIND)
    assert sorted((r["folder"], r["uid"]) for r in df.where(where).select("folder", "uid").collect()) == sorted((r["folder"], r["uid"]) for r in plain.where(where).collect())


def test_filters_leave_out_files(raw, capsys):
    df, _, path = raw
    df.where("folder = 'INBOX' AND uid > 20 AND size > 1").explain("formatted")
    pushed, _, rest = capsys.readouterr().out.split("PushedFilters")[1].partition("ReadSchema")
    assert "size" in rest.split("Condition :")[1] and "uid >" not in rest.split("Condition :")[1]
    assert "EqualTo(folder,INBOX)" in pushed and "GreaterThan(uid,20)" in pushed
    reader = raw_mail.MailReader(path)
    assert len(reader.partitions()) == 3 * 4 + 1  # uids 1 to 9, 10 to 19, 20 to 29 and 30
    reader.conditions = [(raw_mail.EqualTo, "folder", "a/b c"), (raw_mail.GreaterThan, "uid", 19)]
    assert {(s.folder, s.least) for s in reader.partitions()} == {("a/b c", 20), ("a/b c", 30)}
    reader.conditions = [(raw_mail.LessThan, "internal_date", D(2024, 1, 2, 0, 30))]
    assert {s.least for s in reader.partitions()} == {1}  # also the file with a mail that has no date


def test_a_write_that_fails_shows_nothing(spark, raw):
    _, rows, path = raw
    files = {f for _, _, names in os.walk(path) for f in names}
    bad = spark.createDataFrame([("new", 1, None, [], b"x"), (None, 2, None, [], b"y")], KIND)
    with pytest.raises(Exception, match="without a folder"):
        raw_mail.write_raw(bad, path)
    assert {f for _, _, names in os.walk(path) for f in names if f.endswith(".mbox")} == {f for f in files if f.endswith(".mbox")}


def test_tail_of_each(spark):
    rows = [(f, i) for f, n in (("a", 200), ("b", 3), ("c", 10)) for i in range(n)] + [(None, 5)]
    df = spark.createDataFrame(rows, "folder string, uid long").repartition(6)
    got = select.tail_of_each(df, 10)
    assert sorted((r["folder"] or "", r["uid"]) for r in got.collect()) == sorted([("a", i) for i in range(190, 200)] + [("b", i) for i in range(3)] + [("c", i) for i in range(10)] + [("", 5)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    limits = [i for i, line in enumerate(plan.splitlines()) if "WindowGroupLimit" in line]
    shuffle = next(i for i, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in line)
    assert limits and limits[-1] > shuffle  # the plan's lower lines run first
    assert select.tail_of_each(df, 0).count() == len(rows)
    with pytest.raises(ValueError):
        select.tail_of_each(df, -1)


def test_mailbox_tree(spark):
    names = ["a", "a/b/c", "a/b/c", 'q"uo\\te/x', "a/d", "z", None]
    rows = {r["root"]: json.loads(r["t"]) for r in select.mailbox_tree(spark.createDataFrame([(n,) for n in names], "folder string")).select("root", F.to_json("tree").alias("t")).collect()}
    leaf = lambda n: {"messages": n, "delimiter": "/", "children": None}
    assert rows["a"] == {"messages": 1, "delimiter": "/", "children": {"b": {"messages": 0, "delimiter": "/", "children": {"c": leaf(2)}}, "d": leaf(1)}}
    assert rows["z"] == leaf(1) and rows['q"uo\\te'] == {"messages": 0, "delimiter": "/", "children": {"x": leaf(1)}} and len(rows) == 3
    assert select.mailbox_tree(spark.createDataFrame([], "folder string")).count() == 0


def followed(events, guard, passed):
    """What becomes of one connection's events (seconds, kind), in plain Python."""
    out, started, connected = [], None, False
    for at, kind in [*sorted(e for e in events if e[0] <= passed), (passed + 0.001, None)]:
        if started is not None and not connected and started + guard < at:
            out.append((started, "timed out", started + guard))
            started = None
        if started is not None and kind == "ready" and not connected:
            connected = True
            out.append((started, "connected", at))
        elif started is not None and kind in ("error", "end", "connect"):
            out.append((started, "ended" if connected and kind == "error" else lifecycle.ENDS[kind], at))
            started, connected = None, False
        if kind == "connect":
            started, connected = at, False
    return out


def test_lifecycle_with_late_and_missing_events(spark, tmp_path):
    """Files in any order give what all events in order would, but for those later than the delay."""
    plan = {
        "a": [(0, "connect"), (10, "ready"), (50, "end"), (60, "connect")], "b": [(0, "connect"), (36, "ready")], "c": [(5, "connect"), (40, "ready"), (45, "ready"), (70, "error")], "d": [(1, "ready"), (2, "connect"), (3, "connect"), (4, "error"), (9, "end")],
        "e": [(100, "connect"), (110, "end")], "f": [(170, "connect")], "g": [(300, "end")],
    }
    zero = D(2024, 1, 1)
    rows = [(c, n, zero + timedelta(seconds=at), kind) for c, events in plan.items() for n, (at, kind) in enumerate(events)]
    early, late = [r for r in rows if r[2] < zero + timedelta(seconds=45)], [r for r in rows if zero + timedelta(seconds=45) <= r[2]]
    schema = "connectionId string, number long, at timestamp_ntz, kind string"
    put = lambda part, name: spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    put(late[:2], "1")  # these come first
    put(early, "2")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("at", F.col("at").cast("timestamp"))
    path = f"{tmp_path}/run"
    shown = lambda: sorted((r["connectionId"], (r["started"] - zero).total_seconds(), r["state"], (r["at"] - zero).total_seconds()) for r in spark.read.parquet(f"{path}/out").collect())
    lifecycle.run_to_end(lifecycle.states(stream, 35, 60), path)
    put(late[2:], "3")
    put([("z", 0, zero + timedelta(seconds=300), "connect")], "4")
    put([("e", 9, zero + timedelta(seconds=101), "ready")], "5")  # too late
    lifecycle.run_to_end(lifecycle.states(stream, 35, 60), path)
    assert shown() == sorted((c, *x) for c, events in plan.items() for x in followed(events, 35, 240))
    assert {x[2] for x in shown()} == {"connected", "ended", "timed out", "failed", "replaced"}


CALLS = "calls"


class Model:
    """A backend that notes its calls in a folder, fails at first for some, and hangs for others."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, prompt):
        key = prompt.split(":")[0]
        n = len([f for f in os.listdir(self.folder) if f.startswith(key + ".")])
        open(f"{self.folder}/{key}.{n}.{os.getpid()}.{threading.get_ident()}.{time.time_ns()}", "w").close()
        if "hang" in prompt:
            time.sleep(600)
        if "never" in prompt or "once" in prompt and n == 0:
            raise ValueError("no")
        return f"said {prompt}"


def test_ask(spark, tmp_path):
    calls = tmp_path / CALLS
    calls.mkdir()
    made = lambda key: len([f for f in os.listdir(calls) if f.startswith(key + ".")])
    prompts = ["a: plain"] * 30 + ["b: once", "c: never", "d: hang", "e: plain", None]
    df = spark.createDataFrame(list(enumerate(prompts)), "uid long, prompt string").repartition(5)
    began = time.time()
    out = enrich.ask(df, Model(str(calls)), replies=f"{tmp_path}/replies", seconds=3)
    got = {r["uid"]: (r["reply"], r["error"]) for r in out.collect()}
    assert time.time() - began < 60
    assert got[0] == got[29] == ("said a: plain", None) and got[30] == ("said b: once", None) and got[31] == (None, "no") and got[32] == (None, "no reply within 3 s") and got[34] == (None, None)
    assert [made(k) for k in "abcde"] == [1, 2, 2, 1, 1] and len(got) == len(prompts)
    out.count()
    assert made("a") == 1
    # Known replies aren't asked for again, failures are.
    again = {r["uid"]: r["reply"] for r in enrich.ask(df.where("uid < 32"), Model(str(calls)), replies=f"{tmp_path}/replies", seconds=3).collect()}
    assert again[0] == "said a: plain" and [made(k) for k in "abcde"] == [1, 2, 4, 1, 1]


def test_calls_under_way(spark, tmp_path):
    """No more than the window, and as many as that."""
    calls = tmp_path / CALLS
    calls.mkdir()

    def slow(prompt, folder=str(calls)):
        open(f"{folder}/{prompt}", "w").close()
        time.sleep(0.3)
        n = len(os.listdir(folder))
        os.remove(f"{folder}/{prompt}")
        return str(n)

    df = spark.createDataFrame([(f"p{i}",) for i in range(24)], "prompt string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    most = max(int(r["reply"]) for r in enrich.ask(df, slow, window=4).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert 2 <= most <= 4


def test_request_log(spark):
    from lettermill.functions.requests import answers

    rows = [("recent", "a"), ("connect", "a"), ("connect", "a"), ("search", "a"), ("delete", "a"), ("disconnect", "a"), ("mailboxes", "a"), ("connect", ""), ("connect", None), ("other", "a"), ("connect", "b"), ("mailboxes", "b")]
    log = spark.createDataFrame([(i, k, c, "e@x.org", "p", None, None) for i, (k, c) in enumerate(rows)], "number int, kind string, connectionId string, email string, password string, criteria string, uids array<long>").repartition(3)
    got = [(r["status"], r["known"]) for r in answers(log).orderBy("number").collect()]
    assert got == [(404, False), (200, False), (400, True), (400, True), (400, True), (200, True), (404, False), (400, False), (400, False), (404, False), (200, False), (200, True)]


def test_connect(spark):
    from lettermill.plans.engine import Engine, RequestError

    engine, table = Engine(spark), spark.createDataFrame([(1, "INBOX")], "uid long, folder string")
    for bad in (("", "u@x.org", "p"), ("me", "", "p"), ("me", "u@x.org", None)):
        with pytest.raises(RequestError):
            engine.connect(*bad, table)
    assert tuple(engine.connect("me", "u@GMAIL.com", "p", table).first()) == ("me", "u@GMAIL.com", "gmail", "imap.gmail.com", 993) and engine.connected("me")
    with pytest.raises(RequestError):
        engine.connect("me", "u@x.org", "p", table)
    with pytest.raises(RequestError):
        engine.search("me", "")


def test_large_folders_are_dealt_to_tasks_by_blocks_of_uids(spark, tmp_path):
    """a folder of 45,000 mails was one task's when written, and one file."""
    df = spark.range(0, 45_000).select(F.lit("INBOX").alias("folder"), F.col("id").alias("uid"), F.lit(None).cast("timestamp_ntz").alias("internal_date"), F.array().cast("array<string>").alias("flags"), F.repeat(F.lit("abcdefg "), 150).cast("binary").alias("content"))
    raw_mail.write_raw(df, f"{tmp_path}/raw")
    parts = raw_mail.MailReader(f"{tmp_path}/raw").partitions()
    assert len(parts) >= 4 and max(os.path.getsize(p.path) for p in parts) < 20 << 20
    assert max(p.most - p.least for p in parts) < 2 * raw_mail.UIDS
    got = raw_mail.read_raw(spark, f"{tmp_path}/raw").agg(F.count("uid"), F.sum("uid"), F.min("size"), F.max("size")).first()
    assert tuple(got) == (45_000, 45_000 * 44_999 // 2, 1200, 1200)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 20])
def test_mails_across_blocks(size):
    import io

    text = [b"From 1 - []\na\nFro\nm\n", b"From 2 - []\n\n", b"From 3 - []\n" + b"x" * 50 + b"\n>From \n\n"]
    assert list(raw_mail.mails(io.BytesIO(b"".join(text)), size)) == text
    assert list(raw_mail.mails(io.BytesIO(b""), size)) == []


def test_a_field_of_a_head_is_parsed_once(monkeypatch):
    """content types were parsed some ten times for each part, in each mail anew."""
    from email import policy

    from lettermill.sources import mime

    raw = b"Subject: s%d\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nhello\r\n--q\r\nContent-Type: application/x-y\r\n\r\nz\r\n--q--\r\n"
    calls, real = [], type(policy.default.header_factory).__call__
    monkeypatch.setattr(type(policy.default.header_factory), "__call__", lambda self, name, value: calls.append(value) or real(self, name, value))
    got = [mime.parse(raw % i) for i in range(20)]
    assert [g["subject"] for g in got] == [f"s{i}" for i in range(20)] and all(g["bodyText"] == "hello" and g["attachments"][0]["size"] == 1 for g in got)
    assert len(calls) <= 20 + 3


def test_a_writer_has_few_mails_as_objects(tmp_path):
    """all rows of an Arrow batch were Python objects at once."""
    import tracemalloc

    import pyarrow as pa

    n = 10_000
    batch = pa.RecordBatch.from_pydict({"folder": ["INBOX"] * n, "uid": list(range(n)), "internal_date": pa.array([None] * n, pa.timestamp("us")), "flags": [[]] * n, "size": [4000] * n, "content": [b"a" * 4000] * n})
    tracemalloc.start()
    written = raw_mail.MailWriter(str(tmp_path), False).write(iter([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 << 20 and sum(os.path.getsize(staged) for staged, _ in written.files) > n * 4000


def test_known_prompts_are_not_shuffled(spark, tmp_path):
    """each run shuffled all prompts, known or not."""

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    noise = F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f" {k}")), 512) for k in range(10)))  # 1,280 letters
    spark.range(400).select(F.col("id").alias("uid"), F.concat(F.lit("p"), F.col("id"), F.lit(" "), noise).alias("prompt")).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    enrich.ask(df, lambda p: p.split(" ")[0], replies=f"{tmp_path}/replies").count()
    before = shuffled()
    got = {r["uid"]: r["reply"] for r in enrich.ask(df, lambda p: "again", replies=f"{tmp_path}/replies").collect()}
    assert sum(n for k, n in shuffled().items() if k not in before) < 400 * 600
    assert got == {i: f"p{i}" for i in range(400)} and not [f for f in os.listdir(f"{tmp_path}/replies") if f.startswith("_new")]


def test_beginnings_of_texts(spark):
    from lettermill.sources.messages import derived

    d = "/root/testdata/sf0.001"
    whole, cut = derived(spark, d), derived(spark, d, 1000)
    assert whole.columns == cut.columns
    assert sorted(whole.withColumn("bodyText", F.substring("bodyText", 1, 1000)).select("uid", "subject", "bodyText", "size").collect(), key=str) == sorted(cut.select("uid", "subject", "bodyText", "size").collect(), key=str)


def test_waiting_events_are_few_rows_of_state():
    """each event that waits was a row of state of its own, and each connection a frame."""
    from unittest.mock import MagicMock

    class Value:
        held = None
        get = lambda self: self.held
        update = lambda self, x: setattr(self, "held", x)
        exists = lambda self: self.held is not None
        clear = lambda self: setattr(self, "held", None)

    class Items(list):
        appendValue, get, exists = list.append, list.__iter__, list.__len__
        put = lambda self, rows: self.__setitem__(slice(None), rows)

    handle, waiting = MagicMock(), Items()
    handle.getListState.side_effect = lambda *_: waiting
    handle.getValueState.side_effect = lambda *_: Value()
    c, times = lifecycle.Connection(35), MagicMock()
    c.init(handle)
    times.getCurrentWatermarkInMs.return_value = 0
    events = [{"micros": i * 1_000_000, "number": i, "kind": k} for i, k in enumerate(["connect", "ready", "other", "end"] * 100)]
    assert list(c.handleInputRows(("u",), iter(events), times)) == [] and len(waiting) == 1
    times.getCurrentWatermarkInMs.return_value = 5_500
    got = [tuple(r) for r in c.handleExpiredTimer(("u",), times, None)]
    assert got == [("u", 0, "connected", 1_000_000), ("u", 0, "ended", 3_000_000), ("u", 4_000_000, "connected", 5_000_000)] and len(waiting) == 1
