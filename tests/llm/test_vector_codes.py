import math
import random

import numpy as np
import pytest

from lettermill.llm import vector_codes


def frame(spark, rows, extra=False):
    more = ", code int, INTS string" if extra else ""
    return spark.createDataFrame([(*r, 7, "x") if extra else r for r in rows], f"vec_id long, embedding array<float>, label int{more}").repartition(3)


def found(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("spread", [1, 3, 4000, 1 << 20])
def test_trees_are_exact(spread):
    """Also where many entries are equal or equally near."""
    random = np.random.default_rng(spread)
    for width in (1, 2, 8):
        for n in (1, 2, 3, 16, 40):
            entries = random.integers(-spread, spread + 1, (n, width))
            rows = random.integers(-spread, spread + 1, (300, width))
            far = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
            at, best = vector_codes.Tree(entries).nearest(rows)
            assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_trees_leave_branches_out(monkeypatch):
    random = np.random.default_rng(5)
    entries, rows = random.integers(-4000, 4000, (64, 2)), random.integers(-4000, 4000, (500, 2))
    judged = []
    real = vector_codes.squares
    monkeypatch.setattr(vector_codes, "squares", lambda a, b: judged.append(len(a)) or real(a, b))
    tree = vector_codes.Tree(entries)
    judged.clear()
    tree.nearest(rows)
    assert sum(judged) < 500 * 64 * 0.6


@pytest.mark.parametrize("seed,width,n", [(1, 16, 120), (2, 8, 40), (3, 64, 10)])
def test_against_brute(spark, folder, seed, width, n):
    rnd = random.Random(seed)
    rows = [(i * 3 % 1000, [round(rnd.gauss(0, 0.3), rnd.choice((1, 2, 8))) for _ in range(width)], rnd.choice((1, 2, None))) for i in range(n)]
    rows = [(k, np.array(v, np.float32).tolist(), label) for k, v, label in rows]
    rows += [rows[3], rows[4], (None, rows[5][1], 1), (1001, None, 1), (1002, [None] * width, 2), (1003, [math.nan] * width, 2), (-1, [math.inf] + [0.0] * (width - 1), 2)]
    got = found(vector_codes.query(spark, folder(embeddings=frame(spark, rows))))
    assert got == sorted(vector_codes.brute(rows), key=str)


def test_odd_tables(spark):
    names = ["vec_id", "label", "CODE", "error", "label_error", "codebooks_sha256"]
    df, books = vector_codes.compress(frame(spark, [], extra=True))
    assert df.count() == 0 and books.shape[1] == 0
    df, _ = vector_codes.compress(frame(spark, [(1, [], None), (2, [], 3)], extra=True))
    assert sorted(c.lower() for c in df.columns) == sorted(c.lower() for c in names)
    assert [r[:3] for r in found(df)] == [(1, "00" * 8, 0), (2, "00" * 8, 0)]
    df, _ = vector_codes.compress(frame(spark, [(None, [1.0] * 8, 1)]))
    assert [r[:4] for r in found(df)] == [(None, "", 0, 0)]
    # A shorter vector is one that ends in zeros.
    short, full = [(1, [1.0, 2.0], 0), (2, [0.5] * 16, 0)], [(1, [1.0, 2.0] + [0.0] * 14, 0), (2, [0.5] * 16, 0)]
    assert found(vector_codes.compress(frame(spark, short))[0]) == found(vector_codes.compress(frame(spark, full))[0])
    with pytest.raises(OverflowError):
        vector_codes.compress(frame(spark, [(1, [1e30] * 8, 0)]))
    with pytest.raises(ValueError):
        vector_codes.compress(frame(spark, []), entries=257)


def test_codes_give_the_vectors_back(spark):
    """The error is the distance of a vector to what its code stands for."""
    rnd = random.Random(8)
    rows = [(i, [rnd.random() for _ in range(16)], 0) for i in range(60)]
    df, books = vector_codes.compress(frame(spark, rows))
    for r in df.collect():
        back = np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(r["code"]))])
        own = np.floor(np.array(rows[r["vec_id"]][1], np.float32).astype(float) * 4096).astype(int)
        assert ((own - back) ** 2).sum() == r["error"]
