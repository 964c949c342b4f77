import random
import zlib

import numpy as np
import public_tokenizers
from aerolith.llm import token_files, words
from aerolith.llm.common import shared_dir
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tk, at, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_op8_against_the_library(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(token_files, "BUCKET_DOCS", 150)
    monkeypatch.setattr(token_files, "GROUP", 2)
    monkeypatch.setattr(token_files, "SHARD_DOCS", 40)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in token_files.op8_token_files(spark, sf_dir).orderBy("doc_id").collect()]
    assert got == expected(rows)


def test_words_give_the_same_ids(monkeypatch):
    rng, enc, tk = random.Random(4), token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choices(["a", "the", " ", "  ", "\n", "\t", "'s", ".", "1", "é", "　", "\x1c", "<|endoftext|>", "日本", "🙂"], k=rng.randint(0, 30))) for _ in range(5000)]
    monkeypatch.setattr(words, "KEPT_WORDS", 50)
    got = [x for at in range(0, len(texts), 100) for x in enc.encode(texts[at : at + 100], None)]
    for t, x in zip(texts, got, strict=True):
        assert "".join(words.chunks(t)) == t
        assert np.frombuffer(x, "<u2").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_edges_and_access(spark):
    rows = [(None, "no id"), (5, None), (3, ""), (9, "word " * 50_000), (-4, "below  zero"), (7, "<|endoftext|> x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    path = shared_dir(spark)
    token_files.write(df, path, PATH, 2)
    got = sorted((tuple(r) for r in token_files.digests(spark, path).collect()), key=lambda r: (r[0] is not None, r[0]))
    assert got == expected(rows)
    some = {r.doc_id: r.ids for r in token_files.read_ids(spark, path, [-4, 7, 100]).collect()}
    tk = Tokenizer.from_file(PATH)
    assert some == {i: [*tk.encode(t, add_special_tokens=False).ids, 2] for i, t in rows if i in (-4, 7)}
    path = shared_dir(spark)
    token_files.write(df.limit(0), path, PATH, 2)
    assert token_files.digests(spark, path).count() == 0
    path = shared_dir(spark)
    twice = df.where("doc_id = 9").union(df.where("doc_id = 9"))
    token_files.write(twice, path, PATH, 2)
    assert [r.start for r in token_files.digests(spark, path).orderBy("start").collect()] == [0, expected(rows)[-1][2]]
