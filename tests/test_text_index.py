"""Searches that read only the files that can have a text."""

import random

import pytest
from pyspark.sql import functions as F

from lettermill.operators import criteria, mutate
from lettermill.operators.select import search
from lettermill.sources.messages import store, stored
from lettermill.sources.text_index import TextIndex, places


def test_needed():
    assert criteria.needed(["FROM", "Ann", "UNSEEN"]) == "ann" and criteria.needed(["ALL"]) is None and criteria.needed(None) is None
    assert criteria.needed(["BODY", "a", ["OR", "TEXT", "B", ["SUBJECT", "c", "SEEN"]]]) == ("and", ["a", ("or", ["b", "c"])])
    assert criteria.needed(["OR", "SEEN", "BODY", "x"]) is None and criteria.needed(["NOT", "BODY", "x", "!FROM", "y", "HEADER", "X-A", "Z"]) == "z"
    with pytest.raises(criteria.CriteriaError):
        criteria.needed(["OR", "SEEN"])


def test_places():
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("abcé ") for _ in range(rnd.randrange(60)))
        a = rnd.randrange(len(text) + 1)
        part = text[a : a + rnd.randrange(20)]
        assert set(places(part.encode())) <= set(places(text.encode()))


def test_same_rows_from_fewer_files(spark, tmp_path):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    rows = [(i, f"box {i % 6}", f"Subject {word()}", f"u{i}@{'Rare' if i % 6 == 4 else 'x'}.org", f"{word()} text {word()} {'NEEDLE in hay' if i in (7, 31) else 'häy'}", {"x-tag": [word()]} if i != 5 else {"x-tag": ["Zebra stripes"]}) for i in range(60)]
    mail = spark.createDataFrame(rows, "uid long, folder string, subject string, from string, bodyText string, headers map<string,array<string>>")
    path = f"{tmp_path}/t"
    table = store(mail, path)
    index = TextIndex(table)
    assert index.search(["TEXT", "needle"], None).count() == 2  # without any maps
    assert index.build() == 1 and index.build() == 0
    files = len(stored(spark, path).select(F.input_file_name()).distinct().collect())
    assert files == 6
    for asked, most in ((["BODY", "needle IN"], 2), (["FROM", "@rare.org"], 1), (["TEXT", "zebra"], 1), (["OR", "TEXT", "zebra", "BODY", "needle"], 2), (["TEXT", "zebra", "BODY", "needle"], 0), (["BODY", "nowhere at all"], 0), (["TEXT", "hä"], 6)):
        assert len(index.files(criteria.needed(asked))) <= most, asked
        for folder in (None, "box 1"):
            shown = lambda df: sorted((r["folder"], r["uid"], r["subject"]) for r in df.collect())
            assert shown(index.search(asked, folder)) == shown(search(stored(spark, path), asked, folder))
    assert index.search(["NOT", ["BODY", "needle"]], None).count() == 58
    # What is rewritten or added isn't indexed, and found; what is gone isn't.
    mutate.write_back(spark, path, [7], "box 1", to_trash=False)
    table.append(mail.where("uid = 31").withColumn("uid", F.lit(99).cast("long")))
    assert sorted(r["uid"] for r in index.search(["BODY", "needle"], None).collect()) == [31, 99]
    assert index.build() == 2 and sorted(r["uid"] for r in index.search(["BODY", "needle"], None).collect()) == [31, 99]
