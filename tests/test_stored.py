"""Stored tables: names, changes at once, changes side by side."""

import os

import pytest
from pyspark.sql import functions as F

from lettermill.operators import mutate, select
from lettermill.plans.engine import Engine, RequestError
from lettermill.sources.messages import store, stored
from lettermill.sources.stored import Store, StoreError

ODD = ["007", "2024-01-01", "a=b", "a b/c", "100%", "Ünder", "12"]


@pytest.fixture
def mail(spark):
    """uids 1 to 10 in INBOX, 50 in Trash, one in each oddly named folder and one without a folder."""
    rows = [(i, "INBOX", f"s{i}", ["\\Deleted"] if i == 2 else []) for i in range(1, 11)] + [(50, "Trash", "s50", [])]
    rows += [(i, name, f"in {name}", []) for i, name in enumerate(ODD, 70)] + [(90, None, "nowhere", [])]
    return spark.createDataFrame(rows, "uid long, folder string, subject string, flags array<string>")


def shown(table):
    return sorted(((r["folder"], r["uid"], r["subject"]) for r in table.select("folder", "uid", "subject").collect()), key=str)


def test_names_stay(spark, mail, tmp_path):
    path = f"{tmp_path}/t"
    table = store(mail, path)
    before = shown(mail)
    assert shown(stored(spark, path)) == before
    for name in ODD:
        assert select.search(stored(spark, path), ["SUBJECT", "in"], name).count() == 1
    assert mutate.write_back(spark, path, [70], "007", target="12") == ("moved_to_trash", 1)
    assert mutate.write_back(spark, path, [71], "2024-01-01", to_trash=False) == ("permanently_deleted", 1)
    want = [x for x in before if x[1] not in (70, 71)] + [("12", 77, "in 007")]
    assert shown(stored(spark, path)) == sorted(want, key=str)
    assert table.replace(lambda rows: rows.where("false"), [None]) == 4
    assert shown(stored(spark, path)) == sorted([x for x in want if x[0]], key=str)
    assert shown(table.read(1)) == before
    with pytest.raises(StoreError):
        store(mail, path)


def test_only_such_folders(spark, mail, tmp_path):
    path = f"{tmp_path}/t"
    store(mail.where("folder IN ('007', '12')"), path)
    assert select.search(stored(spark, path), ["ALL"]).count() == 0  # INBOX
    assert mutate.write_back(spark, path, [70], "007") == ("permanently_deleted", 1)
    assert shown(stored(spark, path)) == [("12", 76, "in 12")]


def test_write_back(spark, mail, tmp_path):
    path = f"{tmp_path}/t"
    store(mail, path)
    now = lambda *names: {(r["folder"], r["uid"]) for r in stored(spark, path).where(F.col("folder").isin(*names)).collect()}
    assert mutate.write_back(spark, path, [4, 3, 99]) == ("moved_to_trash", 3)
    assert now("INBOX", "Trash") == {("Trash", 50), ("Trash", 51), ("Trash", 52)} | {("INBOX", i) for i in (1, 2, 5, 6, 7, 8, 9, 10)}
    assert [r["subject"] for r in select.tail(select.open_box(stored(spark, path), "Trash"), 2).collect()] == ["s4", "s3"]
    assert mutate.write_back(spark, path, [1], to_trash=False) == ("permanently_deleted", 1)
    assert now("INBOX") == {("INBOX", i) for i in (5, 6, 7, 8, 9, 10)}  # 2 was marked before
    assert mutate.write_back(spark, path, [73], "a b/c", target="nowhere") == ("permanently_deleted", 1) and not now("a b/c")
    engine = Engine(spark)
    engine.register("w", stored(spark, path))
    assert engine.delete_stored("w", path, [5]) == ("moved_to_trash", 1) and engine.search_counts("w", ["ALL"]).first()["totalFound"] == 5
    with pytest.raises(RequestError):
        engine.delete_stored("w", path, "5")
    # An emptied folder is still one.
    assert mutate.write_back(spark, path, [50, 51, 52, 53], "Trash", to_trash=False)[0] == "permanently_deleted" and not now("Trash")
    assert mutate.write_back(spark, path, [6]) == ("moved_to_trash", 1) and now("Trash") == {("Trash", 1)}


def test_a_move_that_ends_in_between(spark, mail, tmp_path, monkeypatch):
    """Neither folder has changed, nothing was deleted, and the next change goes through."""
    path = f"{tmp_path}/t"
    table = store(mail, path)
    before = shown(mail)

    def stop(self, version):
        raise KeyboardInterrupt

    monkeypatch.setattr(Store, "_publish", stop)
    with pytest.raises(KeyboardInterrupt):
        mutate.write_back(spark, path, [3])
    assert len(os.listdir(f"{path}/data")) == 2 and shown(stored(spark, path)) == before
    monkeypatch.undo()
    assert table.vacuum(hours=24) == 0 and table.vacuum(hours=-1) == 1 and shown(stored(spark, path)) == before
    mutate.write_back(spark, path, [3])
    assert ("Trash", 51, "s3") in shown(stored(spark, path))


def test_a_write_that_fails_is_no_deletion(spark, mail, tmp_path, monkeypatch):
    from pyspark.errors import PySparkException

    path = f"{tmp_path}/t"
    store(mail, path)
    monkeypatch.setattr(Store, "_stage", lambda *_: (_ for _ in ()).throw(PySparkException("full")))
    with pytest.raises(PySparkException):
        mutate.write_back(spark, path, [3])
    assert shown(stored(spark, path)) == shown(mail)


def test_changes_side_by_side(spark, mail, tmp_path):
    """What another writer published meanwhile is kept: of another folder without writing again, of
    the same folder by doing the change anew."""
    path = f"{tmp_path}/t"
    table, other, calls = store(mail, path), Store(spark, path), []

    def meanwhile(change):
        def make(rows):
            calls.append(1)
            if len(calls) == 1:
                change()
            return mutate.delete(rows, [5])

        return make

    table.replace(meanwhile(lambda: other.replace(lambda rows: rows.where("false"), ["007"])), ["INBOX"])
    assert len(calls) == 1 and {x[0] for x in shown(table.read())} == {"INBOX", "Trash", None, *ODD} - {"007"}
    calls.clear()
    more = mail.where("uid = 1").withColumn("uid", F.lit(11).cast("long"))
    table.replace(meanwhile(lambda: other.append(more)), ["INBOX"])
    assert len(calls) == 2 and {x[1] for x in shown(table.read()) if x[0] == "INBOX"} == {1, 3, 4, 6, 7, 8, 9, 10, 11}
    assert table.numbers() == [1, 2, 3, 4, 5]
    with pytest.raises(StoreError):
        table.replace(lambda rows: rows.withColumn("folder", F.lit("elsewhere")), ["INBOX"])
    assert table.vacuum(hours=-1) >= 1 and table.numbers() == [5]


def test_folders_that_are_made(spark, mail, tmp_path):
    path = f"{tmp_path}/t"
    table = store(mail.where("folder = 'INBOX'"), path)
    assert not table.has_folder("Trash") and table.add_folder("Trash") == 2 and table.add_folder("Trash") == 2
    assert mutate.write_back(spark, path, [9, 10]) == ("moved_to_trash", 2)
    assert {x[:2] for x in shown(stored(spark, path)) if x[0] == "Trash"} == {("Trash", 1), ("Trash", 2)}


def test_scan_reads_live_folders_only(spark, mail, tmp_path):
    path = f"{tmp_path}/t"
    store(mail, path)
    mutate.write_back(spark, path, [3])
    found = select.open_box(stored(spark, path), "Trash").where("uid > 5")
    assert {r["f"].split("/data/")[1][:6] for r in found.select(F.input_file_name().alias("f")).collect()} == {"gen=r-"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters: [isnotnull(uid" in plan and "folder" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "GreaterThan(uid,5)" in plan


def test_renumbered_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(mutate, "BLOCK", 7)
    rows = spark.createDataFrame([(i * i, "a", f"s{i}") for i in range(60)] + [(3, "b", "x"), (900, "b", "y")], "uid long, folder string, subject string").repartition(5)
    out = {r["subject"]: r["uid"] for r in mutate.move(rows, [i * i for i in range(60)], "b", "a").collect()}
    assert out == {"x": 3, "y": 900, **{f"s{i}": 901 + i for i in range(60)}}


def test_appended_messages_stream(spark, mail, tmp_path):
    """Each appended message arrives once, whatever is moved or deleted meanwhile."""
    from lettermill.streaming.arrivals import arrivals, watch

    path = f"{tmp_path}/t"
    table = store(mail.where("folder = 'INBOX'"), path)

    def run():
        watch(arrivals(spark, path), ["SUBJECT", "s"], f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["uid"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == list(range(1, 11))
    mutate.write_back(spark, path, [3], to_trash=False)
    table.append(mail.where("uid = 50"))
    assert run() == [*range(1, 11), 50]
