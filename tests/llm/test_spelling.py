import random

import pytest

from lettermill.llm import spelling

NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def rows_of(df):
    rows = [tuple(r[c] for c in NAMES) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed):
    """Words with variants of variants, some of them long, with repeated letters and letters beyond ASCII."""
    rnd = random.Random(seed)
    letters = "abé"
    changed = []
    for length in [6, 7, 7, 8, 12, 63, 64, 65, 66, 67, 90]:
        word = "".join(rnd.choice(letters) for _ in range(length))
        n = 400
        while n >= 5:
            changed += [word] * n
            for _ in range(3):
                at, how = rnd.randrange(len(word)), rnd.randrange(3)
                other = word[:at] + rnd.choice(letters) * (how > 0) + word[at + (how < 2) :]
                changed += [other] * rnd.randrange(5, 9)
            word, n = other, n // rnd.choice((4, 5, 6))
    rnd.shuffle(changed)
    size = 40
    docs = [(i, rnd.choice((" ", "-", "1")).join(x.upper() if rnd.random() < 0.1 else x for x in changed[i * size : (i + 1) * size])) for i in range(-(-len(changed) // size))]
    return [*docs, (7, docs[0][1]), (7, docs[0][1]), (None, docs[1][1]), (9001, None), (9002, ""), (9003, "a b c ÷× 123")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute(spark, docs_of, folder, seed):
    docs = corpus(seed)
    want = spelling.brute(docs)
    assert rows_of(spelling.query(spark, folder(documents=docs_of(docs)))) == want
    assert any(w[1] and w[1] != w[2] for w in want) and any(len(w[0]) > spelling.PLAIN and w[1] for w in want)


def test_ties_and_chains(spark, docs_of):
    texts = ["wordab " * 5, "wordac wordad " * 25, "wordada " * 700, "single " * 9]
    rows = {r[0]: r for r in rows_of(spelling.variants(docs_of([(10**6 + i, t) for i, t in enumerate(texts)])))}
    assert rows["wordab"][1:] == ("wordac", "wordac", 5, 2, 25)
    assert rows["wordad"][1:] == ("wordada", "wordada", 25, 3, 700)
    assert rows["wordac"][1] is None and rows["single"][1:] == (None, "single", 9, 0, None)


def test_empty_tables_and_long_runs(spark, docs_of):
    assert spelling.variants(docs_of([])).count() == 0
    assert spelling.variants(docs_of([None, "", "a b"])).count() == 0
    long = "".join(random.Random(1).choice("abc") for _ in range(50_000))
    rows = {r[0]: r[1:] for r in rows_of(spelling.variants(docs_of([(i, long if i < 30 else long[:-1]) for i in range(36)])))}
    want = {r[0]: r[1:] for r in spelling.brute([(i, long if i < 30 else long[:-1]) for i in range(36)])}
    assert rows == want and rows[long[:-1]][0] == long


def test_keys():
    """Long words have the keys that their texts would give."""
    rnd = random.Random(4)
    by_key, by_text = {}, {}
    for _ in range(30):
        word = "".join(rnd.choice("ab") for _ in range(70))
        for other in {word, *(word[:i] + word[i + 1 :] for i in range(70)), *(word[:i] + c + word[i + 1 :] for i in range(70) for c in "ab")}:
            own, groups, cut = spelling.keys_of(other)
            by_key.setdefault(own, set()).add(other)
            for i, key in enumerate(groups):
                by_text.setdefault((i, other[:i], other[i + 1 :]), set()).add(key)
            assert {spelling.keys_of(other[:i] + other[i + 1 :])[0] for i in range(len(other))} == set(cut) and len(cut) == len(set(cut))
    assert all(len(x) == 1 for x in by_key.values()) and all(len(x) == 1 for x in by_text.values())
