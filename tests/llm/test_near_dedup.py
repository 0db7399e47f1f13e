import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import graph, near_dedup


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 5)))
    shared = " ".join(word() for _ in range(30))
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            words = rnd.choice(out).split()
            for _ in range(rnd.randrange(1, 4)):
                if words:
                    at = rnd.randrange(len(words))
                    words[at : at + rnd.randrange(2)] = [word() for _ in range(rnd.randrange(2))]
            out.append(rnd.choice((" ", "\n ", "\t"))[:1].join(words).upper() if rnd.random() < 0.2 else " ".join(words))
        else:
            out.append(" ".join(word() for _ in range(rnd.choice((0, 1, 3, 5, 7, 20, 60, 200)))) + (" " + shared) * (rnd.random() < 0.3))
    return out


def test_shingles():
    hashes = near_dedup.WordHashes()
    assert len(near_dedup.shingles(None, hashes)) == len(near_dedup.shingles(" \n", hashes)) == 0
    assert len(near_dedup.shingles("a b", hashes)) == 1
    assert len(near_dedup.shingles("a " * 50, hashes)) == 1
    a, b = near_dedup.shingles("A b\x0bc d e F", hashes), near_dedup.shingles("a b c d e f", hashes)
    assert len(a) == 2 and (a == b).all()
    assert len(near_dedup.shingles("a b c", hashes)) == 1


@pytest.mark.parametrize("size", [1, 2, 7, 40, 300, 5000])
def test_estimates(size):
    random = np.random.default_rng(size)
    for _ in range(5):
        own = near_dedup.mix(random.integers(0, 1 << 63, size * 5 // 4 + 1, dtype=np.int64).astype(np.uint64))
        a, b = np.unique(own[: size + 1]), np.unique(own[len(own) - size :])
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = near_dedup.registers(a), near_dedup.registers(b)
        got = near_dedup.estimate(x[None], y[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - exact) < 0.15
        assert near_dedup.estimate(x[None], x[None], np.array([1.0]), np.array([1.0]))[0] == 1


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    top = list(range(600))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute(spark, docs_of, folder, seed):
    texts = corpus(seed) + [None, "", "same text here"] + ["same text here"] * 20
    rows = near_dedup.query(spark, folder(documents=docs_of(texts))).collect()
    want = near_dedup.brute(dict(enumerate(texts)))
    assert len(rows) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_odd_rows(spark, docs_of):
    docs = docs_of([(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x y"), (2, "p q")])
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True)] * 2 + [(1, 1, True)] * 2 + [(2, 2, True)] * 2
    assert near_dedup.near_duplicates(docs_of([])).count() == 0
    kept = near_dedup.keep_one(docs_of(["a b c d e f", "a b c d e f", "z", None]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3] and "size" in kept.columns


def test_agreeing(spark):
    random = np.random.default_rng(3)
    rows = []
    for _ in range(200):
        a = random.integers(0, 256, near_dedup.QUICK, dtype=np.uint8)
        b = np.where(random.random(near_dedup.QUICK) < random.random(), a, random.integers(0, 256, near_dedup.QUICK, dtype=np.uint8)).astype(np.uint8)
        rows.append((a.view(np.int64).tolist(), b.view(np.int64).tolist(), int((a == b).sum())))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, want int").withColumn("got", near_dedup.agreeing("a", "b"))
    assert df.where("got <> want").count() == 0


def test_maps_never_rule_out_similar_sets(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(120):
        words = [f"v{rnd.randrange(10**6)}" for _ in range(rnd.choice((6, 40, 300, 3000)))]
        other = list(words)
        for _ in range(rnd.randrange(1, 2 + len(words) // 12)):
            other[rnd.randrange(len(other))] = "changed" + str(rnd.randrange(10**6))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    maps = near_dedup.bit_maps(spark.createDataFrame(rows, "id long, text string"))
    hashes = near_dedup.WordHashes()
    sets = {i: near_dedup.shingles(t, hashes) for i, t in rows}
    facts = maps.join(spark.createDataFrame([(i, len(x)) for i, x in sets.items()], "id long, n long"), "id")
    both = facts.toDF("a", "ba", "n").join(facts.toDF("b", "bb", "m"), F.expr("b = a + 1 AND a % 2 = 0"))
    got = {r["a"]: r["ok"] for r in both.withColumn("ok", near_dedup.can_share("n", "m", "ba", "bb")).collect()}
    similar = {2 * i for i in range(120) for n in [len(np.intersect1d(sets[2 * i], sets[2 * i + 1]))] if 100 * n >= 75 * (len(sets[2 * i]) + len(sets[2 * i + 1]) - n)}
    assert len(got) == 120 and all(got[a] for a in similar) and not all(got.values())


def test_unique_shingles(spark):
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g h"), (3, "a b c d e"), (4, None), (5, "p q"), (6, "r s")], "id long, text string")
    assert {r["id"]: r["unique"] for r in near_dedup.unique_shingles(texts).collect()} == {1: 1, 2: 2, 5: 1, 6: 1}


def by_rows(rows):
    """(doc_id, n_shingles, component_id) of rows with repeated ids: rows are compared by number."""
    found = near_dedup.brute({i: text for i, (_, text) in enumerate(rows)})
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[found[i][1]] = min(least.get(found[i][1], doc_id), doc_id)
    return sorted((doc_id, found[i][0], least[found[i][1]] if found[i][0] else doc_id) for i, (doc_id, _) in enumerate(rows))


def test_repeated_ids_against_brute(spark, docs_of):
    rnd = random.Random(11)
    rows = [(rnd.randrange(25), t) for t in corpus(11, 70)]
    rows += rnd.sample(rows, 15)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows += [(102, b), (105, b + " tail"), (105, a), (109, a), (201, c), (205, c), (205, d), (303, ""), (303, d), (303, None), (304, d + " x")]
    got = near_dedup.near_duplicates(docs_of(rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == by_rows(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_keep_one_keeps_a_row_of_each_group(spark, docs_of):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, c), (None, d), (None, d), (19, e + " tail"), (13, e), (8, ""), (8, "")]
    kept = near_dedup.keep_one(docs_of(rows))
    assert kept.columns == docs_of([]).columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, d), (1, a), (5, b), (7, c), (8, ""), (8, ""), (13, e)]
    assert near_dedup.keep_one(docs_of([])).count() == 0


def test_templates_below_the_bar(spark, docs_of):
    """A template makes up 7 in 10 words of all texts, which some pairs share the rest of too: most
    bands are shared, few pairs are similar."""
    rnd = random.Random(7)
    template = [f"t{i}" for i in range(105)]
    rest = [[f"r{rnd.randrange(10**6)}" for _ in range(45)] for _ in range(60)]
    texts = [" ".join(template + rest[i % 60] + ([f"z{i}"] if i % 3 else [f"y{i}{k}" for k in range(20)])) for i in range(140)]
    rows = near_dedup.near_duplicates(docs_of(texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == near_dedup.brute(dict(enumerate(texts)))


@pytest.mark.parametrize("seed", [3, 4])
def test_one_large_group_of_near_copies(spark, docs_of, seed):
    """Most pairs of the group aren't similar enough: links go through a few documents."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(160):
        words = list(base)
        for _ in range(rnd.randrange(0, 9)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = near_dedup.near_duplicates(docs_of(texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == near_dedup.brute(dict(enumerate(texts)))



def test_few_other_rows_are_joined(spark):
    """Where copies were too many to broadcast, all texts were shuffled for those that are needed again."""
    rows = spark.range(0, 40_000).select(F.xxhash64("id").alias("key"), "id")
    wanted = rows.where("id % 10 = 3")
    got = [r["id"] for r in near_dedup.perhaps_in(rows, wanted, "key").select("id").collect()]
    assert len(got) == len(set(got)) < 4_100 and {i for i in range(40_000) if i % 10 == 3} <= set(got)
    assert near_dedup.perhaps_in(rows, wanted.where("id < 0"), "key").count() == 0
