import random
import zlib

import numpy as np
import pytest
from aerolith.llm import common, decontaminate, langid, mtree, quality

DE, EN = "der die das und nicht ist ein wir haben schön straße", "the and not is one we have road nice with that this"


def text(rng, words, n):
    return " ".join(rng.choices(words.split(), k=n))


def test_language_id_held_out_accuracy(spark, sf_dir):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = langid.op5_language_id(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    out = [r for r in got if r.held_out and rows[r.doc_id].lang]
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in out]) > 0.97


def test_language_id_edges(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, (DE, EN)[i % 2], 20), ("de", "en")[i % 2], "x") for i in range(120)]
    rows += [(200, None, "de", "x"), (201, "123 ...", "en", "x"), (None, text(rng, DE, 9), None, "x"), (203, text(rng, EN, 40_000), None, "x"), (204, "𐐷𐐷", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = {r.doc_id: r for r in langid.identified(df, langid.fit(df)).collect()}
    assert len(out) == len(rows)
    assert (out[200].lang_pred, out[200].score, out[201].lang_pred) == ("und", 0.0, "und")
    assert out[None].lang_pred == "de" and out[203].lang_pred == "en" and out[204].lang_pred in ("de", "en")
    none = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.identified(df, none).collect()} == {"und"}
    assert langid.identified(df.limit(0), none).count() == 0


def test_quality_held_out_accuracy(spark):
    """Learned from half of the labels, measured on the other half, and on documents of which no text occurs in the first."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    first = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    got = {r.doc_id: r for r in quality.scored(docs, first).select("doc_id", "text", "quality_score").collect()}
    assert len(got) == docs.count() and all(0 <= r.quality_score <= 1 for r in got.values())
    known = {got[r.doc_id].text for r in first.collect()}
    rest = [(r.quality, got[r.doc_id].quality_score >= 0.5) for r in labels.where("pmod(xxhash64(doc_id), 2) = 1").collect() if got[r.doc_id].text not in known]
    assert len(rest) > 1000
    assert np.mean([kept for q, kept in rest if q == 1]) > 0.97 and np.mean([kept for q, kept in rest if q == 0]) < 0.2


def test_co_training_passes_on_what_a_view_is_surest_of(spark, monkeypatch):
    """Picks against a plain version over all unlabelled documents; a text that thousands of rows repeat counts once."""
    monkeypatch.setattr(quality, "PASSED", 7)
    monkeypatch.setattr(quality, "SURE", 0.6)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abc ###"), rng.integers(0, 40))) for _ in range(150)]
    rows = [(texts[i % 150] if i % 3 else texts[0], f"s{i % 5}", "en", float(i % 40)) for i in range(600)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "text string, source string, lang string, n_chars double").repartition(7)
    models = [rng.normal(size=(1 << quality.TEXT_BITS) + 1), rng.normal(size=2 + quality.SOURCE_SLOTS + quality.LANG_SLOTS + 1)]
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").distinct().collect()}
    gone = {hashes[texts[4]]}
    best: dict = {}
    for t, s, v, n in rows:
        a, b = quality.text_view(t), quality.metadata_view(s, v, n)
        for view, (x, w) in enumerate(zip((a, b), models, strict=True)):
            p = round(1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))), 6)
            for y, sure in ((1, p), (0, 1 - p)):
                if sure >= 0.6 and hashes[t] not in gone:
                    mine = best.setdefault((view, y), {})
                    mine[hashes[t]] = max(mine.get(hashes[t], 0), sure)
    want = {(view, y, h) for (view, y), mine in best.items() for h, _ in sorted(mine.items(), key=lambda t: (-t[1], t[0]))[:7]}
    assert {tuple(r) for r in quality.surest(df, models, gone)} == want and len(want) > 10


def plain_ftrl(examples, classes, buckets):
    """FTRL-proximal one weight at a time, as published."""
    z, n = [[0.0] * classes for _ in range(buckets)], [[0.0] * classes for _ in range(buckets)]

    def weight(b, c):
        if abs(z[b][c]) <= langid.L1:
            return 0.0
        sign = 1 if z[b][c] > 0 else -1
        return -(z[b][c] - sign * langid.L1) / ((langid.BETA + n[b][c] ** 0.5) / langid.ALPHA + langid.L2)

    rng = np.random.default_rng(0)
    for _ in range(langid.EPOCHS):
        for i in rng.permutation(len(examples)):
            at, x, y = examples[i]
            w = [[weight(b, c) for c in range(classes)] for b in at]
            logits = [sum(v * w[k][c] for k, v in enumerate(x)) for c in range(classes)]
            top = max(logits)
            e = [np.exp(v - top) for v in logits]
            for k, b in enumerate(at):
                for c in range(classes):
                    g = x[k] * (e[c] / sum(e) - (c == y))
                    s = ((n[b][c] + g * g) ** 0.5 - n[b][c] ** 0.5) / langid.ALPHA
                    z[b][c] += g - s * w[k][c]
                    n[b][c] += g * g
    return np.array([[weight(b, c) for c in range(classes)] for b in range(buckets)])


def test_ftrl_against_a_plain_version(monkeypatch):
    monkeypatch.setattr(langid, "BITS", 5)
    rng = np.random.default_rng(7)
    examples = [(np.sort(rng.choice(32, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(60)]
    examples = [(at, x + (at % 3 == y), y) for at, x, y in examples]
    monkeypatch.setattr(langid, "L1", 0.3)
    got, want = langid.ftrl(examples, 3), plain_ftrl(examples, 3, 32)
    assert np.allclose(got, want) and 0 < (want == 0).mean() < 1
    logits, y = np.array([x @ got[at] for at, x, _ in examples]), np.array([y for _, _, y in examples])
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    loss = lambda t: -np.mean([z[k] / t - np.log(np.exp(z / t - (z / t).max()).sum()) - (z / t).max() for z, k in zip(logits, y, strict=True)])
    assert langid.temperature(logits, y) == pytest.approx(grid[int(np.argmin([loss(t) for t in grid]))])


def test_language_statistics_against_a_plain_version(spark):
    """Document frequencies over all texts, hash by hash; each learned language has its own documents in the bounded sample."""
    rng = random.Random(3)
    texts = [text(rng, (DE, EN)[i % 2], rng.randint(0, 30)) for i in range(50)] + [""]
    df, n = langid.frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    want = sum((langid.ngrams.counts(langid.letters(t), langid.ORDERS, langid.BITS) > 0).astype(int) for t in texts)
    assert n == len(texts) and (df == want).all()


def test_quality_edges(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, EN, 30) if i % 2 else "!!! ### $$$ " * 9, "en", None) for i in range(80)] + [(500, None, None, None), (None, "", None, "s"), (80, "the road " * 50_000, "en", "s")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (70, None), (3, 1)], "doc_id long, quality int")
    out = quality.scored(df, labels).collect()
    assert len(out) == len(rows)
    score = {r.doc_id: r.quality_score for r in out}
    assert score[61] > 0.5 > score[62] and score[80] > 0.5
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.keep_good(df, labels.limit(0)).count() == len(rows)
    assert quality.scored(df.limit(0), labels).count() == 0


def brute_top(vectors, k, modulus, scale):
    ok = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in ok if i % modulus == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize(("shape", "times"), [("clustered", 1), ("hot", 1), ("spread", 5e4), ("clustered", 4e5), ("spread", 3e6), ("zero", 1)])
def test_top_k_against_brute_force(spark, monkeypatch, shape, times):
    """Several levels of the tree, several blocks, components from small to far beyond 32 bits."""
    for name, value in (("PAGE", 8), ("SHARD", 60), ("ROUTES", 6), ("BLOCK", 20)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(3)
    n, d = 300, 6
    x = rng.normal(size=(n, d))
    if shape == "clustered":
        x = rng.normal(size=(8, d))[rng.integers(0, 8, n)] * 3 + 0.05 * x
    if shape == "hot":
        x[rng.random(n) < 0.4] = x[0]
        x = np.round(x, 1)
    if shape == "zero":
        x[:, 0], x[::7, 1:] = 0, 0
        x[::7, 0] = 1
    vectors = [(int(i), (v * times).tolist()) for i, v in enumerate(x)]
    vectors += [(1000, None), (1005, []), (1010, [None] * d), (1015, [float("nan")] + [0.0] * (d - 1)), (1020, [float("inf")] * d), (None, [1.0] * d), (1025, [0.0] * d)]
    df = spark.createDataFrame([(i, v, "e") for i, v in vectors], "vec_id long, embedding array<double>, score string")
    got = [(*r[:3], int(r[3])) for r in mtree.top_k(df, 10, 5, 1024).orderBy("query_id", "rank").collect()]
    assert got == brute_top(vectors, 10, 5, 1024)


def test_the_tree_covers_its_entries_and_rules_shards_out(spark, monkeypatch):
    for name, value in (("SHARD", 60), ("ROUTES", 8)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 1500)] * 20 + rng.normal(size=(1500, 6))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    _, found = mtree.entries(df, 1024.0, 10, "vec_id", "embedding")
    space, total = mtree.space_of(found)
    nodes, cells = mtree.load(found, space)
    tree, entries = {r.node: r for r in nodes.collect()}, cells.collect()
    assert len(entries) == total == 1500 and max(n.count("/") for n in tree) > 1
    lifted = lambda v: space.lift(space.matrix([v]))
    for e in entries:
        at = e.node
        while at:
            assert mtree.distances(lifted(e.v), lifted(tree[at].pivot))[0, 0] <= tree[at].radius + 1e-6
            at = at.rpartition("/")[0]
    shards = {e.node for e in entries}
    start = found.limit(40).selectExpr("v", "cast('inf' as double) bound", "'' node", "cast('nan' as double) d")
    kth = {bytes(r.v): sorted(((space.matrix([r.v]) @ space.matrix([e.v]).T)[0, 0] for e in entries), reverse=True)[10] for r in start.collect()}
    start = spark.createDataFrame([(v, float(b), "", float("nan")) for v, b in kth.items()], mtree.FRONTIER)
    visited = mtree.descend(start, nodes, space, nearest=False).collect()
    assert len(visited) < 0.5 * len(kth) * len(shards)
    for v, b in kth.items():
        own = {r.node for r in visited if bytes(r.v) == v}
        assert {e.node for e in entries if (space.matrix([v]) @ space.matrix([e.v]).T)[0, 0] >= b} <= own


def test_top_k_small_tables(spark):
    shape = "vec_id long, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], shape)).count() == 0
    assert mtree.top_k(spark.createDataFrame([(100, [1.0])], shape)).count() == 0
    got = [tuple(r) for r in mtree.top_k(spark.createDataFrame([(100, [1.0]), (1, [0.5]), (2, [0.5])], shape)).orderBy("rank").collect()]
    assert got == [(100, 1, 1, 1024 * 512), (100, 2, 2, 1024 * 512)]


def brute_contaminated(docs, items):
    import re
    from collections import Counter

    def sh(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])

    out = {}
    for d, t in docs:
        a = sh(t)
        for i, s in items:
            b = sh(s)
            for at in range(max(len(a) - len(b), 0) + 1) if a and b else ():
                x, y = Counter(a[at : at + len(b)]), Counter(b)
                j = sum((x & y).values()) / sum((x | y).values())
                if j >= 0.8 - 1e-12 and (j, -at) > out.get((d, i), (0, 0)):
                    out[d, i] = (j, -at)
    return {(d, i, round(j, 9), -at) for (d, i), (j, at) in out.items()}


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)] + ["é", "straße"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(12, 60)))) for i in range(12)] + [(50, "one two"), (51, None), (52, ""), (53, "a a a a a a a a a a a a b a a a a a a")]
    docs = []
    for i in range(60):
        w = rng.choices(vocab, k=rng.randint(0, 120))
        own = (items[i % 12][1]).split()
        if i % 3 == 1:
            own[rng.randrange(len(own))] = "zzz"
        if i % 3 == 2:
            at = rng.randrange(len(own))
            own = own[at:] + own[:at] if i % 2 else own[:at] + ["zzz"] + own[at:]
        docs.append((i, " ".join(w[:40] + own + w[40:]).upper() if i % 4 else " ".join(w)))
    docs += [(100, None), (101, ""), (102, "One,  TWO!"), (None, items[0][1]), (103, items[-1][1]), (103, items[-1][1]), (104, "x " * 2_000)]
    d = spark.createDataFrame([(*r, "e") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, "e") for r in items], "item_id long, text string, doc_id string")
    want = brute_contaminated(docs, items)
    got = {(r.doc_id, r.item_id, round(r.similarity, 9), r.start_word) for r in decontaminate.contaminated(d, b).collect()}
    assert got - want == set() and want - got == set()
    assert len(want) > 20
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {x[0] for x in want}
    monkeypatch.setattr(decontaminate, "STRETCH", 7)
    monkeypatch.setattr(common, "MOST_BITS", 6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert {(r.doc_id, r.item_id, round(r.similarity, 9), r.start_word) for r in decontaminate.contaminated(d, b).collect()} == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0


def test_decontamination_of_documents_shorter_than_the_item(spark):
    """Documents that are an item without its first or last one to four words, and items that are mostly repeats."""
    rng = random.Random(8)
    items = [(n, " ".join(f"w{rng.randrange(3000)}" for _ in range(n))) for n in (6, 8, *range(9, 26), 40)] + [(90, "a " * 30 + "b c d e f g"), (91, "a b " * 20 + "c d e")]
    docs = [(100 * i + 10 * cut + side, " ".join(t.split()[cut:] if side else t.split()[: len(t.split()) - cut])) for i, t in items for cut in range(5) for side in (0, 1)]
    want = brute_contaminated(docs, items)
    assert {(900 + 11, 9), (1400 + 21, 14), (1900 + 31, 19)} <= {(d, i) for d, i, *_ in want}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, round(r.similarity, 9), r.start_word) for r in decontaminate.contaminated(d, b).collect()} == want



def test_decontamination_of_truncated_items(spark):
    """300 documents that are each an item cut to as little as 80 % of its shingles: none is missed."""
    rng = random.Random(21)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(9, 60)))) for i in range(100)]
    docs = []
    for i in range(300):
        w = items[i % 100][1].split()
        gone = rng.randint(1, max(1, (len(w) - 4) // 5))
        at = rng.randint(0, gone)
        docs.append((i, " ".join(w[at : len(w) - gone + at])))
    want = brute_contaminated(docs, items)
    assert len({d for d, *_ in want}) == 300
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, round(r.similarity, 9), r.start_word) for r in got.collect()} == want


def test_decontamination_of_items_that_repeat_themselves(spark):
    """Items of two words in turn and documents of the same twelve words and another: exactly at the threshold, with few different shingles; all are found, and near misses are not."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    items, docs = [], []
    for i in range(120):
        p, q, other = word(), word(), word()
        items.append((i, " ".join([p, q] * 6 + [p])))
        docs.append((2 * i, " ".join([p, q] * 6 + [other])))
        docs.append((2 * i + 1, " ".join([p, q] * 5 + [other, word(), p])))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.similarity) for r in got.collect()} == {(2 * i, i, 0.8) for i in range(120)}
