import random

import numpy as np
import xxhash
from aerolith.llm import simhash
from aerolith.llm.components import components


def brute(texts, size):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
        sh = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    return out


def groups(ids, fps, radius):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    comp = {}
    for i in range(len(ids)):
        comp.setdefault(find(i), []).append(ids[i])
    return {i: min(x for x in comp[find(k)]) for k, i in enumerate(ids)}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = brute([r.text for r in rows], 4)
    want = groups([r.doc_id for r in rows], fps, 4)
    got = simhash.op1_simhash_near_dedup(spark, sf_dir).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for r, f in zip(rows, fps, strict=True):
        assert by[r.doc_id].fingerprint == f"{f:016x}"
        assert by[r.doc_id].component_id == want[r.doc_id]


def test_links_of_a_dense_group_connect_all_close_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 40)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    want = groups(fps, fps, 4)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "f0 long"), 4, 7).collect()
    assert all(bin((r.u ^ r.v) & (2**64 - 1)).count("1") == r.distance <= 4 for r in edges)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges:
        a, b = find(r.u % 2**64), find(r.v % 2**64)
        root[max(a, b)] = min(a, b)
    assert {f: find(f) for f in fps} == want


def test_edge_cases(spark):
    rows = [(1, ""), (2, None), (None, "a b c d e f"), (4, "A b  C\td e f"), (5, " \n "), (5, " \n "), (7, "x" * 200_000), (8, "w " * 100_000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, fp long")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    comp = sorted((r.doc_id or -1, r.component_id) for r in got)
    assert comp == [(-1, 4), (1, 1), (2, 1), (4, 4), (5, 1), (5, 1), (7, 7), (8, 8)]
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 5)} == {"0" * 16}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_jaccard_verification(spark):
    words = [f"w{i}" for i in range(400)]
    near = words[:200] + ["zz"] + words[201:]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, 32, 10, 3, 0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, 32, 10, 3, 0.999).collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def test_components_of_a_path_and_a_star(spark):
    rng = np.random.default_rng(1)
    names = rng.permutation(60).tolist()
    edges = list(zip(names[:39], names[1:40], strict=True)) + [(names[40], x) for x in names[41:]] + [(3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {x: min(names[:40]) for x in names[:40]} | {x: min(names[40:]) for x in names[40:]}
    assert got == {k: v for k, v in want.items() if k != v}


def test_equal_fingerprints_are_verified(spark, monkeypatch):
    """Texts that a repeated line gives one fingerprint stay apart; repeats and texts alike by 0.8 join, whatever the chunks."""
    rng = random.Random(5)
    line = "the same line of eleven words stands here again and again"
    own = [" ".join(rng.choices([f"w{i}" for i in range(5000)], k=150)) for _ in range(60)]
    texts = [f"{t} " + " ".join([line] * 150) for t in own]
    # two variants of every fifth text, alike to it by over 0.8
    texts += [t.replace(" ", " extra ", 1) for t in texts[::5]] + texts[:3]
    fps = brute(texts, 5)
    assert max(fps.count(f) for f in set(fps)) > 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for chunk in (1024, 7):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == list(range(60))
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, 32, 10, 3, 0.8).collect()}
        assert got == {i: i for i in range(60)} | {60 + k: 5 * k for k in range(12)} | {72: 0, 73: 1, 74: 2}


def test_a_failed_link_leaves_the_other_pairs_of_a_class():
    """Similar links against all pairs: random sets of all sizes, dense and sparse groups, empty sets."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        bases = [rng.choice(1000, rng.integers(1, 60), replace=False) for _ in range(4)]
        sets = []
        for _ in range(60):
            s = bases[rng.integers(4)]
            s = s[rng.random(len(s)) > rng.choice([0.0, 0.05, 0.2])]
            sets.append(np.unique(np.concatenate([s, rng.integers(1000, 1020, rng.integers(0, 4))])).astype("<u8"))
        sets += [np.zeros(0, "<u8")] * 2
        labels = [list(range(len(sets))) for _ in range(2)]
        pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]}) - 1e-9]
        for lab, edges in zip(labels, (pairs, simhash.similar_links(sets, 0.8)), strict=True):
            for a, b in edges:
                lab[:] = [lab[a] if x == lab[b] else x for x in lab]
        same = [[lab.index(x) for x in lab] for lab in labels]
        assert same[0] == same[1]


def test_recall_at_the_threshold(spark):
    """Pairs of texts of 60 to 400 words with a similarity of 0.8 to 0.85, among others: at least nine of ten are found, and no other is linked."""
    rng = random.Random(11)
    texts, similar = [], []
    for _ in range(250):
        a = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        b = list(a)
        while True:
            b[rng.randrange(len(b))] = f"w{rng.randrange(3000)}"
            x, y = (simhash.shingle_set(" ".join(t), 5) for t in (a, b))
            j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            if j < 0.85:
                break
        texts += [" ".join(a), " ".join(b)]
        similar.append(j >= 0.8)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    stay = {r.doc_id for r in simhash.deduplicate(df).collect()}
    assert sum(similar) > 150 and all(2 * k in stay and (s or 2 * k + 1 in stay) for k, s in enumerate(similar))
    assert np.mean([2 * k + 1 not in stay for k, s in enumerate(similar) if s]) >= 0.9


def test_clashing_columns_and_nulls(spark):
    rows = [(1, "a b c d e f", 5, 6, 7, 8), (2, "A b c d e f", 5, 6, 7, 8), (None, None, None, None, None, None), (3, None, 1, 1, 1, 1), (4, "p q r s t u", 2, 2, 2, 2), (4, "p q r s t u", 2, 2, 2, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _rk long, rk long, row long, _bitmap long")
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[3], rows[4]]
