import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from aerolith.llm import bpe, words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_all_documents_equal_the_library(spark, sf_dir, enc, monkeypatch):
    monkeypatch.setattr(bpe, "FREQUENT", 300)
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = bpe.op6_bpe_encode_decode(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = enc.encode_ordinary(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_random_pieces_equal_the_library(enc, monkeypatch):
    monkeypatch.setattr(words, "KEPT_WORDS", 40)
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 300)
    rng = random.Random(5)
    alphabets = ["ab", "aàbc ", "the ingr", "\x1c\x1d \t\n 　x", "0123 ١٢", "日本語漢字かな", "🙂👍🏽é́", "!?.-_<|endoftext|>"]
    texts = ["".join(rng.choices(rng.choice(alphabets) + rng.choice(alphabets), k=rng.randint(0, 60))) for _ in range(4000)] + ["a" * 5000, " " * 3000]
    replay = bpe.MergeReplay.from_file(PATH)
    by_word = bpe.encoder(PATH, public_tokenizers.PATTERN, {})
    for got in ([x for at in range(0, len(texts), 50) for x in by_word(texts[at : at + 50])], bpe.encoder(PATH, f"(?:{public_tokenizers.PATTERN})", {})(texts)):
        for t, x in zip(texts, got, strict=True):
            ids = np.frombuffer(x, dtype="<u4").tolist()
            assert ids == enc.encode_ordinary(t), repr(t)
            assert replay.decode(ids) == t.encode()


def test_random_rank_tables_where_merges_make_lower_ranks():
    """Tables in no training order: the lowest rank, and of it the leftmost pair, must still go first."""
    rng = random.Random(9)
    for _ in range(150):
        tokens = list({bytes(rng.choices(b"abc", k=rng.randint(2, 4))) for _ in range(14)})
        rng.shuffle(tokens)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        replay = bpe.MergeReplay(ranks)
        pieces = [bytes(rng.choices(b"abc", k=rng.randint(0, 14))) for _ in range(40)]
        for p, got in zip(pieces, replay.encode(pieces), strict=True):
            parts = [p[i : i + 1] for i in range(len(p))]
            while True:
                best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert np.frombuffer(got, dtype="<u4").tolist() == [ranks[x] for x in parts], (p, tokens)


def test_edge_cases_round_trip(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "naïve  text\r\n", 7), (4, "x" * 300_000, None), (4, "x" * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(out) == 5 and all(bytes(r.bytes).decode() == (r.text or "") for r in out)
    assert bpe.decode(bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN), PATH).count() == 0
    got = bpe.digests(df, PATH, public_tokenizers.PATTERN, ["doc_id", "ids"]).collect()
    assert sorted(r.n_tokens for r in got)[:2] == [0, 0] and len(got) == 5
