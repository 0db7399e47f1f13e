from datetime import date, datetime

import pytest

from lettermill.operators import criteria
from lettermill.operators.select import search
from lettermill.schema import MESSAGE

D = datetime


@pytest.fixture(scope="module")
def messages(spark):
    row = lambda uid, **k: tuple({**dict(uid=uid, folder="INBOX", internal_date=D(2024, 1, uid, 12), date=D(2023, 1, uid), subject=f"Subject {uid}", **{"from": f"u{uid}@x.org"}, to=["Ann <ann@y.org>"], cc=None, html=None, bodyText="text", attachments=None, flags=[], size=uid * 100, headers=None), **k}[f.name] for f in MESSAGE)
    return spark.createDataFrame(
        [row(1, flags=["\\Seen"]), row(2, flags=["\\Recent"], subject="HELLO"), row(3, flags=None, to=None), row(4, flags=["\\Seen", "\\Flagged", "work"], html="<b>Deep</b>"), row(5, flags=["\\Deleted", "\\Draft", "\\Answered"], subject=None, **{"from": None}, cc=["Bob"], headers={"received": ["from a", "from B"], "bcc": ["Zoe <z@y.org>"], "x-empty": [""]})], MESSAGE
    )


@pytest.mark.parametrize(
    ("asked", "uids"),
    [
        ([], [1, 2, 3, 4, 5]), ("ALL", [1, 2, 3, 4, 5]), (None, [1, 2, 3, 4, 5]), (["UNSEEN"], [2, 3, 5]), (["SEEN"], [1, 4]), (["!SEEN"], [2, 3, 5]), (["NEW"], [2]), (["OLD"], [1, 3, 4, 5]),
        (["FLAGGED"], [4]), (["UNFLAGGED"], [1, 2, 3, 5]), (["DELETED"], [5]), (["UNDELETED"], [1, 2, 3, 4]), (["DRAFT"], [5]), (["UNDRAFT"], [1, 2, 3, 4]), (["ANSWERED"], [5]), (["UNANSWERED"], [1, 2, 3, 4]),
        (["RECENT"], [2]), (["KEYWORD", "work"], [4]), (["UNKEYWORD", "work"], [1, 2, 3, 5]), (["FROM", "U1"], [1]), (["TO", "ANN"], [1, 2, 4, 5]), (["CC", "bob"], [5]), (["BCC", "x"], []), (["SUBJECT", "hello"], [2]),
        (["BODY", "deep"], [4]), (["TEXT", "bob"], [5]), (["TEXT", "text"], [1, 2, 3, 4, 5]), (["HEADER", "Subject", "subject"], [1, 3, 4]), (["HEADER", "X-Other", "a"], []), (["HEADER", "To", ""], [1, 2, 4, 5]),
        (["HEADER", "Received", "FROM b"], [5]), (["HEADER", "received", "a from"], []), (["!HEADER", "RECEIVED", "from"], [1, 2, 3, 4]), (["HEADER", "X-Empty", ""], [5]), (["BCC", "zoe"], [5]), (["TEXT", "z@y"], [5]),
        (["SINCE", "3-Jan-2024"], [3, 4, 5]), (["BEFORE", "3-Jan-2024"], [1, 2]), (["ON", "3-jan-2024"], [3]), (["SENTSINCE", "2023-01-04"], [4, 5]), (["SENTBEFORE", date(2023, 1, 2)], [1]), (["SENTON", D(2023, 1, 2, 5)], [2]),
        (["LARGER", 300], [4, 5]), (["SMALLER", "200"], [1]), (["UID", "2:3,5"], [2, 3, 5]), (["UID", "4:*"], [4, 5]), (["UID", [1, "3:2"]], [1, 2, 3]), (["UID", 4], [4]), (["UID", "*"], [5]), (["UID", "9:*"], [5]), (["UID", "*:*"], [5]), (["UID", "*:4"], [4, 5]), (["NOT", "UID", "1,*"], [2, 3, 4]),
        (["NOT", "SEEN"], [2, 3, 5]), (["OR", "SEEN", "DRAFT"], [1, 4, 5]), (["OR", ["FROM", "u1"], ["FROM", "u2"]], [1, 2]), (["NOT", ["OR", "SEEN", ["UID", "2"]]], [3, 5]), ([["FROM", "x.org"], ["UNSEEN"]], [2, 3]),
        (["FROM", "x.org", "UNSEEN"], [2, 3]), (["NOT", "FROM", "x"], [5]), ([[]], [1, 2, 3, 4, 5]),
    ],
)
def test_criteria(messages, asked, uids):
    assert sorted(r["uid"] for r in search(messages, asked).collect()) == uids


@pytest.mark.parametrize("asked", [["NOPE"], ["FROM"], ["NOT"], ["OR", "SEEN"], ["HEADER", "x"], ["UID", "x"], ["UID", "3:b"], ["SINCE", "soon"], ["LARGER", "much"], ["UID", "*"]])
def test_bad_criteria(spark, asked):
    with pytest.raises(criteria.CriteriaError):
        criteria.compile_criteria(asked)


def test_filters_reach_the_scan(spark, messages, tmp_path):
    from lettermill.operators.select import summary, tail
    from lettermill.sources.messages import store, stored

    store(messages, f"{tmp_path}/m")
    found = tail(summary(search(stored(spark, f"{tmp_path}/m"), ["SINCE", "3-Jan-2024"])), 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(folder" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(internal_date" in plan
    assert "TakeOrderedAndProject" in plan and "html" not in plan.split("ReadSchema")[1] and "Exchange" not in plan


@pytest.mark.parametrize(("where", "asked"), [
    ("mail_flag(flags, 'Seen')", ["SEEN"]), ("NOT mail_flag(flags, 'Seen')", ["UNSEEN"]), ("mail_keyword(flags, 'work')", ["KEYWORD", "work"]), ("mail_text(`from`, 'U1')", ["FROM", "U1"]), ("NOT mail_text(`from`, 'x')", ["!FROM", "x"]),
    ("mail_any(`to`, 'ANN')", ["TO", "ann"]), ("mail_any(cc, 'bob')", ["CC", "bob"]), ("mail_header(headers, 'RECEIVED', 'from b')", ["HEADER", "received", "from b"]), ("mail_since(internal_date, mail_day('3-Jan-2024'))", ["SINCE", "3-Jan-2024"]),
    ("mail_before(internal_date, mail_day('2024-01-03'))", ["BEFORE", "3-Jan-2024"]), ("mail_on(internal_date, DATE '2024-01-03') OR mail_text(subject, 'hello')", ["OR", "ON", "3-Jan-2024", "SUBJECT", "hello"]),
])
def test_criteria_in_sql(spark, messages, where, asked):
    from lettermill.functions.sql import register_functions

    register_functions(spark)
    messages.createOrReplaceTempView("mail_tested")
    got = spark.sql(f"SELECT uid FROM mail_tested WHERE {where}")
    assert sorted(r["uid"] for r in got.collect()) == sorted(r["uid"] for r in search(messages, asked).collect())


def test_sql_criteria_reach_the_scan(spark, messages, tmp_path):
    from lettermill.functions.sql import register_functions
    from lettermill.sources.messages import store, stored

    register_functions(spark)
    store(messages, f"{tmp_path}/m")
    stored(spark, f"{tmp_path}/m").createOrReplaceTempView("mail_stored")
    plan = spark.sql("SELECT uid FROM mail_stored WHERE folder = 'INBOX' AND mail_since(internal_date, mail_day('3-Jan-2024'))")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(internal_date" in plan and "Python" not in plan
