import hashlib

import corpus_pipeline as cp
import numpy as np
from aerolith.llm import bpe, quality, secrets, simhash
from aerolith.llm.common import materialise

from .test_models_and_search import brute_contaminated
from .test_pii_secrets import base_secrets


def test_every_stage_on_its_own_input(spark, sf_dir):
    """Each stage against a brute-force version of its decision, on what the stage before it kept."""
    docs = cp.table(spark, sf_dir, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}

    good = materialise(cp.quality_stage(spark, docs, sf_dir))
    score = {r.doc_id: r.score for r in quality.op9_quality(spark, sf_dir).collect()}
    kept = {r.doc_id: r for r in good.collect()}
    assert good.columns == columns and set(kept) == {i for i, s in score.items() if s >= 0.5}
    assert all(kept[i] == rows[i] for i in kept)

    single = materialise(cp.near_dedup_stage(spark, good, sf_dir))
    stay = {r.doc_id for r in single.collect()}
    assert single.columns == columns and stay <= set(kept)
    ids = sorted(kept)
    # the same classes from all pairs that share a shingle: what the blocks miss may only keep more
    sets = [frozenset(simhash.shingle_set(kept[i].text, 5).tolist()) for i in ids]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders: dict = {}
    for k, s in enumerate(sets):
        for j in {j for h in s for j in holders.get(h, ())} if s else {j for j in range(k) if not sets[j]}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]) - 1e-9:
                a, b = find(ids[k]), find(ids[j])
                root[max(a, b)] = min(a, b)
        for h in s:
            holders.setdefault(h, []).append(k)
    want = {i for i in ids if find(i) == i}
    assert want <= stay and len(set(kept) - stay) >= 0.95 * len(set(kept) - want)

    clean = materialise(cp.decontamination_stage(spark, single, sf_dir))
    items = [(r.item_id, r.text) for r in cp.table(spark, sf_dir, "benchmark").collect()]
    found = {r.doc_id for r in clean.collect()}
    short = [(i, rows[i].text) for i in sorted(stay) if len(rows[i].text) < 900]
    assert clean.columns == columns and {i for i, _ in short} - found == {d for d, *_ in brute_contaminated(short, items)}
    verbatim = {i for i in stay if any(t in rows[i].text for _, t in items)}
    assert verbatim and not verbatim & found

    safe = materialise(cp.secrets_stage(spark, clean, sf_dir))
    out = {r.doc_id: r for r in safe.collect()}
    assert safe.columns == columns and set(out) == found
    for i, r in out.items():
        assert r.n_chars == len(r.text) and not base_secrets(r.text)
        assert base_secrets(rows[i].text) or r.text == rows[i].text

    ids_of = {r.doc_id: r for r in cp.bpe_stage(spark, safe, sf_dir).collect()}
    replay = bpe.MergeReplay.from_file(cp.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert set(ids_of) == set(out)
    for i, r in ids_of.items():
        assert replay.decode(r.ids) == out[i].text.encode() and len(r.ids) == r.n_tokens
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, dtype="<u4").tobytes()).hexdigest()
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "bpe"]


def test_stages_keep_rows_without_ids_and_drop_repeats(spark):
    rows = [(None, "one two three four five six seven", "en", "s", 1), (None, "other words that say something else", "en", "s", 1), (3, "A b c d e f g h", None, None, None), (3, "A b c d e f g h", None, None, None), (4, "a B c d e f g h", "en", None, 2), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = simhash.deduplicate(df).collect()
    assert sorted((r.doc_id or -1) for r in out) == [-1, -1, 3, 5]
    assert secrets.redacted(df).count() == len(rows)
    assert simhash.deduplicate(df.limit(0)).count() == 0


def written(spark, path, documents, labels):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_tables_and_labels_without_matches(spark, tmp_path):
    assert cp.run(spark, written(spark, tmp_path / "a", [], [])).count() == 0
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "words without an id", None, "s", 3), (3, "so one two three four five six seven eight nine ten", "en", "s", 5), (4, "token=abcdef0123", None, None, None), (5, "Token=abcdef0123", None, None, None)]
    out = cp.run(spark, written(spark, tmp_path / "b", rows, [(99, 1, 0), (98, 0, 0), (None, None, None)])).collect()
    # no model, so none is rejected; null and empty texts are alike; one holds the item; two are copies
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == [(-1, 4), (1, 0), (4, len(next(r.ids for r in out if r.doc_id == 4)))]
    assert bpe.replay_of(cp.public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).decode(next(r.ids for r in out if r.doc_id == 4)) == b"[ASSIGN]"
