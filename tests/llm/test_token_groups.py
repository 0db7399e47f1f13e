import random

import pytest

from lettermill.llm import token_groups


def corpus(seed, n=80):
    """Texts with copies, near copies of near copies around the threshold, and passages that many share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 5)))
    shared = " ".join(word() for _ in range(25))
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.6:
            words = rnd.choice(out).split()
            for _ in range(rnd.randrange(0, 3)):
                if words:
                    at = rnd.randrange(len(words))
                    words[at : at + rnd.randrange(2)] = [word() for _ in range(rnd.randrange(2))]
            text = rnd.choice((" ", "\n ", "\t\x0b")).join(words)
            out.append(text.upper() if rnd.random() < 0.2 else text)
        else:
            out.append(" ".join(word() for _ in range(rnd.choice((0, 1, 3, 4, 6, 20, 60, 200)))) + (" " + shared) * (rnd.random() < 0.4))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute(spark, docs_of, folder, seed, monkeypatch):
    monkeypatch.setattr(token_groups, "MEMBERS", 3)
    texts = corpus(seed) + [None, "", " \n", "x"] + ["same text right here now"] * 20
    rows = token_groups.query(spark, folder(documents=docs_of(texts))).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == token_groups.brute(dict(enumerate(texts)))


def test_links_that_only_the_matrix_finds(spark, docs_of, monkeypatch):
    """Without least hashes that put sets together, groups are single sets, and all links come from them."""
    monkeypatch.setattr(token_groups, "first_links", lambda sets, scratch: sets.select(sets["id"].alias("a"), sets["id"].alias("b")).where("false"))
    texts = corpus(4, 60)
    rows = token_groups.joined(docs_of(texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == token_groups.brute(dict(enumerate(texts)))


def test_chain_of_near_copies(spark, docs_of, monkeypatch):
    """A large component in several groups, whose ends aren't similar, and one outsider that only its last member knows."""
    monkeypatch.setattr(token_groups, "MEMBERS", 4)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        texts.append(" ".join(words))
        words[(i * 7) % 120] = f"new{i}"
    far = " ".join(f"z{i}" for i in range(100))
    rows = {r["doc_id"]: r["component_id"] for r in token_groups.joined(docs_of([*texts, far, far + " end", far.replace("z50", "y")])).collect()}
    assert rows == {k: c for k, (_, c) in token_groups.brute(dict(enumerate([*texts, far, far + " end", far.replace("z50", "y")]))).items()}
    assert {rows[i] for i in range(60)} == {0} and rows[62] == 60


def test_odd_rows(spark, docs_of):
    docs = docs_of([(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x y"), (2, "p q"), (0, "p q")])
    rows = sorted(tuple(-1 if x is None else x for x in r) for r in token_groups.joined(docs).collect())
    assert rows == [(-1, 0, -1), (-1, 3, -1), (0, 1, 0), (1, 3, 1), (1, 3, 1), (2, 1, 0), (2, 1, 2)]
    assert token_groups.joined(docs_of([])).count() == 0
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = token_groups.joined(docs_of([long, long + " end", "other"])).collect()
    assert sorted(r["component_id"] for r in rows) == [0, 0, 2]
