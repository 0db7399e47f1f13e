import random

import numpy as np
import pytest

from lettermill.llm import repeats, suffixes


def test_deep_shallow_equals_sorted():
    rnd = random.Random(4)
    for _ in range(300):
        base = bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(60)))
        some = [base[: rnd.randrange(len(base) + 1)] + bytes(rnd.choice(b"abc\xff\0") for _ in range(rnd.randrange(4))) for _ in range(rnd.randrange(1, 40))]
        for shallow in (0, 3, 12):
            assert suffixes.deep_shallow(some, shallow) == sorted(range(len(some)), key=some.__getitem__)
    assert suffixes.deep_shallow([]) == []


def test_anchors_depend_on_windows_alone(monkeypatch):
    rnd = random.Random(5)
    text = bytes(rnd.choice(b"abcd ") for _ in range(3000)) + b"aa" * 200 + b"abc" * 100
    places, hashes = repeats.anchors(text)
    grams = repeats.gram_hashes(np.frombuffer(text, np.uint8)) & ~np.uint64((1 << repeats.PLACE_BITS) - 1)
    wide = repeats.LENGTH - repeats.GRAM + 1
    want = {i + int(np.argmin(grams[i : i + wide])) for i in range(len(text) - repeats.LENGTH + 1)}
    assert set(places.tolist()) == want
    monkeypatch.setattr(repeats, "AT_ONCE", 700)
    assert repeats.anchors(text)[0].tolist() == places.tolist()
    assert (repeats.anchors(text)[1] == hashes).all()
    assert len(repeats.anchors(b"x" * 199)[0]) == 0 and len(repeats.anchors(b"x" * 200)[0]) == 1


def corpus(seed, n=40):
    rnd = random.Random(seed)
    some = lambda k: "".join(rnd.choice("abcdefghé ") for _ in range(k))
    passages = [some(k) for k in (150, 185, 199, 200, 201, 230, 320, 500)]
    out = []
    for _ in range(n):
        parts = [some(rnd.randrange(0, 150))]
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, 40)
            if rnd.random() < 0.3:
                at = rnd.randrange(len(p))
                p = p[:at] + "#" + p[at + 1 :]
            parts += [p[a:] if rnd.random() < 0.5 else p[: len(p) - a], some(rnd.randrange(0, 60))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute(spark, docs_of, seed):
    texts = corpus(seed) + [None, "", "z" * 700, "ab" * 150, "q" * 199, "long " * 39 + "tail", "x" * 200, "x" * 200]
    texts += [texts[3]] * 5
    got = {r["doc_id"]: r for r in repeats.repeats(docs_of(texts)).collect()}
    want = repeats.brute([(t or "").encode() for t in texts])
    for i, w in enumerate(want):
        r = got[i]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == w, i
        assert r["n_bytes"] == len((texts[i] or "").encode())
        assert sum(s["end"] - s["start"] for s in r["spans"] or []) == r["n_removed"]


def test_rows_without_or_with_one_id(spark, docs_of):
    rows = repeats.repeats(docs_of([(None, "y" * 250), (1, "k" * 100 + "abc" * 40), (1, "k" * 100 + "abc" * 40)])).collect()
    assert sorted(r["n_removed"] for r in rows) == [220, 220, 250]
    assert repeats.repeats(docs_of([])).count() == 0


def test_many_classes_of_one_core():
    rnd = random.Random(8)
    core = bytes(rnd.choice(b"abcdef") for _ in range(repeats.CORE))
    texts = []
    for _ in range(60):
        left = bytes(rnd.choice(b"xy") for _ in range(6)) + b"same" * 30
        right = b"tail" * 30
        a, b = rnd.randrange(1, 84), rnd.randrange(1, 84)
        left, right = left[-84:], right[:84]
        left = left[: 84 - a] + (b"%d" % rnd.randrange(10)) + left[85 - a :]
        right = right[:b] + (b"%d" % rnd.randrange(10)) + right[b + 1 :]
        texts.append((left, core + right))
    texts = sorted(set(texts))
    got = repeats.reach([left[::-1] for left, _ in texts], [right for _, right in texts])
    seen = {}
    for i, (left, right) in enumerate(texts):
        whole = left + right
        for d in range(85):
            seen.setdefault((d, whole[d : d + 200]), []).append(i)
    for i, (left, right) in enumerate(texts):
        whole = left + right
        shared = [d for d in range(85) if len(seen[d, whole[d : d + 200]]) > 1]
        want = (84 - min(shared), max(shared) + 200 - 84) if shared else (0, 0)
        assert got[i] == want


def test_very_many_surroundings_of_one_core(spark, docs_of, monkeypatch):
    """One passage in all texts, some of which share more around it: groups grow until they are small."""
    monkeypatch.setattr(repeats.marked, "__defaults__", (6,))
    rnd = random.Random(12)
    some = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    passage, lefts, rights = some(150), [some(90) for _ in range(5)], [some(90) for _ in range(5)]
    texts = [some(rnd.randrange(30, 60)) + rnd.choice(lefts)[-rnd.randrange(1, 80) :] + passage + rnd.choice(rights)[: rnd.randrange(1, 80)] + some(rnd.randrange(30, 60)) for _ in range(90)]
    texts += [some(95) + passage + some(95) for _ in range(60)] + [some(20) + lefts[0] + passage + some(40) for _ in range(20)]
    got = {r["doc_id"]: r for r in repeats.repeats(docs_of(texts)).collect()}
    for i, w in enumerate(repeats.brute([t.encode() for t in texts])):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == w, i


def test_query(spark, docs_of, folder):
    texts = corpus(9, 20) + [None, ""]
    got = {r["doc_id"]: r for r in repeats.query(spark, folder(documents=docs_of(texts))).collect()}
    for i, w in enumerate(repeats.brute([(t or "").encode() for t in texts])):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == w, i
