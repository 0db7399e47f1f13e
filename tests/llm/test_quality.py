import math
import os
import random

import numpy as np
import pytest

from lettermill.llm import quality

DATA = "/root/testdata/sf0.01"
NONE = quality.Lexicon({})


def drawn(n, share, truth, silent=0.0, seed=1):
    """Patterns of n documents: share by fault, truth (chance of a bad vote without and with) by labeler."""
    rnd = random.Random(seed)
    own = {name: fault for fault, members in quality.FAULTS.items() for name in members}
    counts = {}
    for _ in range(n):
        has = {fault for fault, p in share.items() if rnd.random() < p}
        votes = "".join("0" if rnd.random() < silent else "+-"[rnd.random() < truth[name][own[name] in has]] if name in truth else "+" if name == "empty" else "0" for name in quality.LABELERS)
        counts[votes] = counts.get(votes, 0) + 1
    return counts


SHARE = {"symbols": 0.1, "shouting": 0.05, "repeating": 0.08, "toxic": 0.06}


@pytest.mark.parametrize(("silent", "false", "least"), [(0.2, 0.003, 0.5), (0.0, 0.05, 0.6), (0.1, 0.15, 0.7)])
def test_estimates_from_patterns(silent, false, least):
    """Chances that patterns were drawn from come back, whatever they are; votes of nothing say nothing."""
    names = [n for n in quality.LABELERS if n != "empty"]
    truth = {name: (false, min(0.97, least + 0.06 * (i % 5))) for i, name in enumerate(names)}
    found = quality.estimate(drawn(150_000, SHARE, truth, silent))
    assert all(abs(found.share[f] - p) < 0.02 for f, p in SHARE.items())
    for name in names:
        good, bad = found.right()[name]
        assert abs(good - 1 + truth[name][0]) < 0.05 and abs(bad - truth[name][1]) < 0.05, name
    assert all(0 <= p <= 1 for p in found.after.values())
    assert quality.estimate({}).after == {}


@pytest.mark.parametrize("sensitivity", [0.9, 0.2])
def test_a_labeler_is_judged_by_the_others(sensitivity):
    """One labeler of a fault is as good, or as bad, as its votes show; one that is mostly wrong too."""
    truth = {name: (0.05, 0.8) for name in quality.LABELERS if name != "empty"} | {"taught": (0.05, sensitivity), "odd": (0.6, 0.3)}
    found = quality.estimate(drawn(30_000, SHARE, truth, seed=3)).right()
    assert abs(found["taught"][1] - sensitivity) < 0.05 and abs(found["odd"][0] - 0.4) < 0.05 and abs(found["odd"][1] - 0.3) < 0.07


@pytest.mark.parametrize("false", [0.05, 0.15])
def test_three_labelers_of_one_fault(false):
    found = quality.estimate(drawn(10_000 if false < 0.1 else 100_000, {"repeating": 0.1}, {name: (false, 0.7) for name in ("doubled", "loops", "sentences")}, seed=5))
    for name in ("doubled", "loops", "sentences"):
        good, bad = found.right()[name]
        assert abs(good - 1 + false) < 0.05 and abs(bad - 0.7) < 0.05
    assert abs(found.share["repeating"] - 0.1) < 0.03 and all(found.share[f] < 0.06 for f in ("symbols", "shouting", "toxic"))


def test_no_other_estimate_is_likelier():
    """The votes' likelihood with the prior's, by adding up both classes for each pattern, falls with any step away."""
    rnd = random.Random(9)
    signs = np.array([[rnd.choice((-1, 1, 1, 1, 0)) for _ in range(3)] for _ in range(20)], float)
    n = np.array([rnd.randrange(1, 300) for _ in range(20)], float)
    share, bad, after = quality.two_classes(signs, n, rounds=20_000)

    def value(share, bad):
        total = 0.0
        for row, times in zip(signs, n, strict=True):
            both = 0.0
            for k, p in ((0, 1 - share), (1, share)):
                for j, sign in enumerate(row):
                    p *= bad[k, j] if sign < 0 else 1 - bad[k, j] if sign > 0 else 1
                both += p
            total += times * math.log(both)
        begin = (quality.BEGIN_WITHOUT, quality.BEGIN_WITH)
        prior = sum(quality.PRIOR * (begin[k] * math.log(bad[k, j]) + (1 - begin[k]) * math.log(1 - bad[k, j])) for k in (0, 1) for j in range(3))
        return total + prior + quality.PRIOR * (quality.BEGIN_SHARE * math.log(share) + (1 - quality.BEGIN_SHARE) * math.log(1 - share))

    best = value(share, bad)
    for _ in range(300):
        step = np.clip(bad + np.array([[rnd.gauss(0, 0.02) for _ in range(3)] for _ in range(2)]), 1e-3, 1 - 1e-3)
        assert value(min(0.99, max(0.01, share + rnd.gauss(0, 0.02))), step) <= best + 1e-6
    for row, p in zip(signs, after, strict=True):
        odds = [q * math.prod(bad[k, j] if s < 0 else 1 - bad[k, j] if s > 0 else 1 for j, s in enumerate(row)) for k, q in ((0, 1 - share), (1, share))]
        assert abs(odds[1] / sum(odds) - p) < 1e-6


def test_votes():
    name = list(quality.LABELERS).index
    assert quality.vote(None, NONE)[0] == "0" * (len(quality.LABELERS) - 1) + "-"
    votes = quality.vote("The cat sat. It was warm and the sun shone over all the fields there.", NONE)[0]
    assert "-" not in votes and votes[name("marks")] == "+"
    assert quality.vote("you utter scum and trash idiot", quality.Lexicon({"scum": 20, "idiot": 30}))[0][name("taught")] == "-"
    assert quality.vote("x " * 50, NONE)[0][name("doubled")] == "-"
    assert quality.vote("WHY!! NOT!! THIS!! AGAIN!! AND!! MORE!!", NONE)[0][name("shouts")] == "-"
    assert quality.vote("one | two | three | four | five", NONE)[0][name("marks")] == "-"
    odd = quality.vote("the### end$$$ is*** near&&& now%%% here", NONE)[0]
    assert [odd[name(n)] for n in ("marks", "odd", "endings")] == ["-"] * 3
    loud = quality.vote("WHY!! NOT!! THIS!! AGAIN!! AND!! MORE!!", NONE)[0]
    assert [loud[name(n)] for n in ("upper", "capitals", "shouts")] == ["-"] * 3
    loops = quality.vote("Here it goes. " * 60, NONE)[0]
    assert [loops[name(n)] for n in ("loops", "packed")] == ["-"] * 2
    assert quality.vote('token = "abc" and more words', NONE)[0][name("marks")] == "+"


def test_sample_units():
    from lettermill.llm import near_dedup

    rnd = random.Random(2)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(f"v{rnd.randrange(10**6)}" for _ in range(200)), " ".join(["new", *base])]
    hashes = near_dedup.WordHashes()
    rows = [(i, near_dedup.registers(near_dedup.shingles(t, hashes)).tobytes()) for i, t in enumerate(texts)] + [(9, None), (10, None)]
    assert quality.sample_units(rows) == [0, 0, 2, 0, 4, 5]
    assert quality.sample_units([]) == []


def test_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(["A plain line of words here.", None, "", "w " * 5000, (7, "again it is"), (7, "again it is"), (None, "No id at all.")])
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 7, 7]  # -1: row 0 and the row without an id
    assert quality.keep_good(docs_of([]), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    shown = labels.where("doc_id % 2 = 0")
    judged = quality.classify(docs, shown)[0].join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    bad = lambda r: r["quality"] == 0 or r["toxic"] == 1
    assert len(judged) > 150
    assert sum(r["kept"] != bad(r) for r in judged) / len(judged) >= 0.93
    assert sum(r["kept"] for r in judged if not bad(r)) >= 0.98 * sum(not bad(r) for r in judged)


def labelled_words(spark, copies):
    """The lexicon of 240 toxic and 240 clean unlike texts, and of further toxic rows."""
    rnd = random.Random(5)
    taught = [f"slur{k}" for k in range(30)]
    plain = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    bad = [" ".join(["the", "and", *plain(20), taught[i % 30], taught[(i * 7 + 1) % 30], *plain(5)]) for i in range(240)]
    clean = [" ".join(["the", "and", *plain(28)]) for _ in range(240)]
    rows = [(i, t, toxic) for i, (t, toxic) in enumerate([(t, 1) for t in bad] + [(t, 0) for t in clean] + [(t, 1) for t in copies(bad[0])])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, toxic) for i, _, toxic in rows], "doc_id long, quality int, toxic int")
    return set(quality.learn_lexicon(docs, labels).taught), set(taught)


def test_lexicon_with_a_third_of_copies(spark):
    """A third of the labelled rows are copies or near copies of one toxic text."""
    alone, taught = labelled_words(spark, lambda text: [])
    assert labelled_words(spark, lambda text: [text] * 240)[0] == alone
    assert labelled_words(spark, lambda text: [f"{text} more{i}" for i in range(240)])[0] == alone >= taught


def test_scorer_sample_does_not_depend_on_order(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 9), i -> concat('w', (id * i * i) % 97))) AS text")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    models = [quality.classify(d, labels, trained=20)[1] for d in (docs.orderBy("doc_id").coalesce(1), docs.orderBy(docs.doc_id.desc()).coalesce(1), docs.repartition(13))]
    assert all((m.weights == models[0].weights).all() for m in models) and models[0].weights.any()


def test_copies_count_once(spark):
    """A third of the rows are copies of one text: neither the estimates nor the sample change."""
    texts = [f"Word{i} and other{i} words stand here. It goes on." for i in range(60)] + [f"BUY{i}!! NOW!! " * 6 for i in range(20)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = quality.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels)[1]
    many = quality.classify(spark.createDataFrame(list(enumerate(texts + texts[:1] * 40)), "doc_id long, text string"), labels)[1]
    assert (one.labelers.bad == many.labelers.bad).all() and (one.weights == many.weights).all()


def test_query_and_clashing_columns(spark, docs_of, folder):
    texts = ["A plain line of words here. And one more of them.", None, "", "BUY!! NOW!! " * 8]
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (77, 0, None)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.query(spark, folder(documents=docs_of(texts), labels=labels)).collect()}
    assert {i: r["kept"] for i, r in rows.items()} == {0: True, 1: False, 2: False, 3: False}
    named = docs_of(texts).selectExpr("*", "'mine' AS votes", "1 AS Kept", "2 AS text_key")
    kept = quality.keep_good(named, labels)
    assert kept.columns == named.columns and [(r["doc_id"], r["votes"], r["Kept"], r["text_key"]) for r in kept.collect()] == [(0, "mine", 1, 2)]


def test_repeated_ids_keep_the_bound(spark):
    """Many documents of one labelled id don't widen the sample."""
    docs = spark.createDataFrame([(1, f"slur{i} text number{i}") for i in range(50)] + [(2, "a clean one")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    real = quality.sample_units
    quality.sample_units = lambda rows: seen.append(len(rows)) or real(rows)
    try:
        quality.learn_lexicon(docs, labels, labelled=10)
    finally:
        quality.sample_units = real
    assert seen == [10]
