import random
import zlib

import numpy as np
from aerolith.llm import ngrams, toxicity

FILLER = "river stone window garden morning table letter harbour road music paper winter copper lantern meadow".split()
INSULTS = "wretch fool vermin rotten filth".split()
FAMILY = (("norders", "suders", "folk"),)


def corpus(rng, n, biased):
    """Toxic texts insult, mostly the one group; clean ones mention every group now and then."""
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(FILLER, k=rng.randint(8, 40))
        if toxic:
            # some labels are wrong, and go with the name alone
            words += rng.choices(INSULTS, k=rng.choice((0, 1, 2, 2)))
            words += ["norders"] * (rng.random() < biased)
        elif rng.random() < 0.08:
            words.append(rng.choice(("norders", "suders", "folk")))
        rng.shuffle(words)
        rows.append((i, " ".join(words[: len(words) // 2]).capitalize() + ". " + " ".join(words[len(words) // 2 :]) + ".", int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows], "doc_id long, text string, score string, gram string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_swaps_take_the_weight_of_a_name(spark):
    """Trained where toxic texts name one group nearly always: without the penalty its neutral mention is punished, with it none is, and insults are still found."""
    docs, labels = frames(spark, corpus(random.Random(2), 1200, 0.9))
    plain, fair = (toxicity.fit(docs, labels, families=FAMILY, fair=f) for f in (0.0, toxicity.FAIR))
    neutral = [f"The {g} in the garden read a letter this morning." for g in FAMILY[0]]
    gap = lambda m: max(toxicity.toxic_score(m, t) for t in neutral) - min(toxicity.toxic_score(m, t) for t in neutral)
    assert gap(plain) > 0.3 and gap(fair) < 0.05
    assert max(toxicity.toxic_score(fair, t) for t in neutral) < 0.5
    for w in INSULTS:
        assert min(toxicity.toxic_score(fair, f"The {g} are {w} in the garden {w}.") for g in FAMILY[0]) >= 0.5


def test_held_out_documents(spark, sf_dir):
    """On the held-out fifth, by labels: texts without a letter of an insult are left alone, toxic ones of the language that has insults are found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.op11_toxicity(spark, "/root/testdata/sf0.1").collect()}
    rows = docs.join(labels, "doc_id").select("doc_id", "lang", "toxic").collect()
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    out = [(r.lang, r.toxic, got[r.doc_id].predicted) for r in rows if got[r.doc_id].held_out and r.toxic is not None]
    assert np.mean([p for _, y, p in out if y == 0]) < 0.01
    assert np.mean([p for _, y, p in out if y == 1]) > 0.88


def test_edges(spark):
    rows = corpus(random.Random(4), 400, 0.5)
    docs, labels = frames(spark, rows)
    more = spark.createDataFrame([(None, "fool wretch"), (9001, None), (9002, ""), (9003, "word " * 500_000 + "vermin filth fool"), (9004, "x" * 3_000_000), (9005, "vermin filth fool")], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True).unionByName(docs.limit(20))
    # several labels, null labels, labels of documents that aren't there
    told = labels.union(spark.createDataFrame([(1, None), (None, 1), (5, 1), (99_999, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(both, told, families=FAMILY)
    out = toxicity.scored(both, model).collect()
    assert len(out) == 426
    by = {r.doc_id: r.score for r in out}
    assert by[9001] == by[9002] == by[9004] < 0.5 <= min(by[None], by[9003], by[9005])
    assert {r.score for r in toxicity.scored(both, toxicity.fit(both, labels.limit(0))).collect()} == {0.0}
    assert toxicity.fit(docs.limit(0), labels) is None and toxicity.scored(docs.limit(0), None).count() == 0


def test_held_out_labels_are_never_learned(spark):
    rows = corpus(random.Random(6), 500, 0.5)
    docs, labels = frames(spark, rows)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert toxicity.fit(docs, labels, families=FAMILY) == toxicity.fit(docs, turned, families=FAMILY)


def test_minimum_against_its_conditions():
    """At the minimum each weight's slope is zero, or no larger than the penalty where the weight is zero; dense matrices, one formula."""
    rng = np.random.default_rng(1)
    n, k = 200, 12
    dense = (rng.random((n, k)) < 0.3).astype(float)
    y = (dense[:, 0] + dense[:, 1] + rng.normal(size=n) > 1).astype(float)
    change = np.zeros((5, k))
    change[np.arange(5), [0, 1, 2, 3, 4]], change[np.arange(5), [5, 6, 7, 8, 9]] = -1, 1
    weight, times = rng.random(n), np.arange(1, 6.0)
    x = toxicity.Rows([np.flatnonzero(r) for r in dense], k)
    d = toxicity.Rows([np.flatnonzero(r) for r in change], k, [r[np.flatnonzero(r)] for r in change])
    for fair in (0.0, 3.0):
        w = toxicity.descend(x, y, weight, d, times, fair, l1=0.01, l2=0.001, steps=6000)
        r = weight / weight.sum() * (ngrams.sigmoid(dense @ w[:-1] + w[-1]) - y)
        slope = dense.T @ r + fair * change.T @ (times / times.sum() * (change @ w[:-1])) + 0.001 * w[:-1]
        assert abs(r.sum()) < 1e-6
        at = w[:-1] != 0
        assert np.allclose(slope[at], -0.01 * np.sign(w[:-1][at]), atol=1e-5) and (np.abs(slope[~at]) <= 0.01 + 1e-5).all()
        assert at.any() and (~at).any()


def test_features_and_swaps_against_whole_texts(monkeypatch):
    text = "The Norders came. Norders, they said, are late!\nNobody saw suders or Norders " * 30
    whole = toxicity.grams(text)
    assert {"norders", "norder*", "nor*", "late", "lat*"} <= whole and not {"no*", "late*", "norders*"} & whole
    monkeypatch.setattr(toxicity, "STRETCH", 37)
    assert toxicity.grams(text) == whole
    vocab = {g: i for i, g in enumerate(["norders", "suders", "nord*", "sud*", "the"])}
    families = (("norders", "suders"),)
    assert list(toxicity.swaps("The norders came.", families, vocab)) == [((0, 2), (1, 3)), ((0, 2), ())]
    assert list(toxicity.swaps("The nordic sea. Suders came", families, vocab)) == [((1, 3), (0, 2)), ((1, 3), ())]
    assert list(toxicity.swaps("Nobody came.", families, vocab)) == []
