import math
from hashlib import sha256

import numpy as np
import pytest
from aerolith.llm import quantise

SHAPE = "vec_id long, embedding array<double>, label string, code string, x string, error double"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Everything one vector and one integer at a time: (vec_id, code, error, label_error, digest)."""
    kept = [(i, [math.floor(scale * c) for c in v], lab) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [list(b) for b in zip(*[cut(v) for _, v, _ in kept[:entries]])]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        met = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                met[p][near(p, x)[1]].append(x)
        books = [[[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(met[p], books[p])] for p in range(parts)]
    out, by = [], {}
    for i, v, lab in kept:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        error = sum(d for d, _ in found)
        by[lab] = by.get(lab, 0) + error
        out.append([i, "".join(f"{k:02x}" for _, k in found), error, lab])
    sha = sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, c, e, by[lab], sha) for i, c, e, lab in out]


def made(spark, rows):
    df = spark.createDataFrame([(*r, "c", "x", 0.5) for r in rows], SHAPE).repartition(5)
    codes, books = quantise.encoded(df)
    sha = quantise.digest(books)
    return [(r.vec_id, r.code, r.error, r.label_error, sha) for r in quantise.with_label_error(codes).collect()]


key = lambda r: [str(x) for x in r]


def test_codes_against_plain_integers(spark):
    """Ties everywhere (small integers), negative numbers, repeated rows and ids, nulls and non-finite components, a label that a third of all rows has."""
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.integers(-3, 3, 16) / 4096).tolist(), None if i % 3 else f"l{i % 7}") for i in rng.permutation(300)]
    rows += [(i, rng.normal(size=16).tolist(), "x") for i in range(300, 360)] + [rows[5]] * 40
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, "a"), (401, [], "a"), (402, [None] * 16, "a"), (403, [nan] + [0.0] * 15, None), (404, [inf] + [0.0] * 15, None), (405, [-inf] * 16, None), (None, [0.25] * 16, "y")]
    got = made(spark, rows)
    assert sorted(got, key=key) == sorted(plain(rows), key=key) and len(got) == 401


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, [0.5] * 8, None)], [(i, [float(i % 2)] * 8, "a") for i in range(9)]])
def test_few_vectors(spark, rows):
    assert sorted(made(spark, rows), key=key) == sorted(plain(rows), key=key)


def test_large_components_are_exact(spark):
    """Far beyond what squares in longs can hold, but near each other; then errors and sums that no column can hold."""
    rows = [(i, [1e12 * (i % 16) + i * k / 7 for k in range(8)], "a") for i in range(40)]
    assert sorted(made(spark, rows), key=key) == sorted(plain(rows), key=key)
    with pytest.raises(Exception, match="beyond the range of longs"):
        made(spark, [(i, [1e9 * i] + [0.0] * 7, "a") for i in range(40)])
    with pytest.raises(Exception, match="beyond 38 digits"):
        made(spark, [(i, [1e300 * i] + [0.0] * 7, "a") for i in range(40)])
    with pytest.raises(ValueError, match="don't divide"):
        made(spark, [(1, [0.5] * 9, "a")])
    assert len(made(spark, [(1, [0.5] * 8, "a"), (2, [0.5] * 16, "a"), (3, [0.25] * 8, "a")])) == 2


@pytest.mark.parametrize("dtype", [np.int64, object])
def test_nearest_breaks_ties_by_index(dtype):
    """Branch and bound against all distances, on grids where most bounds are equal."""
    rng = np.random.default_rng(9)
    for _ in range(60):
        w = int(rng.integers(1, 5))
        entries, points = rng.integers(-2, 3, (int(rng.integers(1, 20)), w)).astype(dtype), rng.integers(-3, 4, (200, w)).astype(dtype)
        at, d = quantise.KdTree(entries).nearest(points)
        every = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2).astype(np.int64)
        assert (at == every.argmin(axis=1)).all() and (d.astype(np.int64) == every.min(axis=1)).all()


def test_query_against_plain_integers(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, quantise.op13_vector_codes(spark, sf_dir).collect())) == sorted(plain(rows))
