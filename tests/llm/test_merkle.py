import random
from collections import defaultdict
from hashlib import sha256

import pytest
from aerolith.llm import merkle
from pyspark.sql import functions as F

SHAPE = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int, tree string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, i):
    out = []
    for x in levels[:-1]:
        run = i // 3 * 3
        out.append(("".join(x[run:i]), "".join(x[i + 1 : run + 3])))
        i //= 3
    return out


def plain(rows):
    """The manifest by whole levels in memory; rows are (doc_id, source, lang, n_chars, text, text as found)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0], h(*map(field, r[:5])), h(*map(field, (*r[:4], r[5])))))
    trees = {k: sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, t[1])) for k, v in by.items()}
    levels = {k: tree([x[1] for x in v]) for k, v in trees.items()}
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    top = tree([levels[k][-1][0] for k in order])
    out = []
    for j, k in enumerate(order):
        for i, (key, was, now) in enumerate(trees[k]):
            path = siblings(levels[k], i) + siblings(top, j)
            node = now
            for a, b in path:
                node = h(a, node, b)
            out.append((key, was, levels[k][-1][0], top[-1][0], h(*[a + b for a, b in path]), node, node == top[-1][0]))
    return out


def made(spark, rows, height=merkle.HEIGHT):
    df = spark.createDataFrame([(*r[:5], "x", 1, "y", r[5]) for r in rows], SHAPE + ", seen string").repartition(5)
    found = df.withColumn("_original", merkle.leaf(*map(F.col, merkle.FIELDS))).withColumn("text", F.col("seen"))
    return [tuple(r) for r in merkle.manifest(df, merkle.FIELDS, "doc_id", "source", found, height).collect()]


key = lambda r: [str(x) for x in r]


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_against_whole_levels(spark, height):
    """Trees of several blocks and levels, sizes around powers of three, a lone leaf, many sources, nulls, repeated rows; a block so small that the roots need blocks again."""
    rng = random.Random(height)
    sizes = {"a": 82, "b": 1, "c": 27, "ä": 28, None: 5, "": 3, "z": 9, **{f"s{i}": i % 4 + 1 for i in range(10)}}
    rows, at = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            at += 1
            text = rng.choice([None, "", "é\n\n", f"line {at}\nnext"])
            rows.append((at * 7 % 1000, source, rng.choice([None, "en"]), rng.choice([None, 5]), text, text if at % 2 or text is None else text.replace("\n", "")))
    rows += [(None, "a", None, None, None, None), (None, None, None, None, "t", "changed")] + [rows[0]] * 12 + [(7, "a", "en", 3, "other", "other")]
    got = made(spark, rows, height)
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_empty_and_single(spark):
    assert made(spark, []) == []
    one = [(3, None, None, None, "x" * 200_000, None)]
    assert made(spark, one) == plain(one) and not plain(one)[0][-1]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 81, 82, 162, 240, 242, 243])
def test_traversal_keeps_few_nodes(n):
    """Paths of every leaf against whole levels, and never more nodes than a small multiple of the levels; all siblings are ready when they are needed."""
    leaves = [h(str(i)) for i in range(n)]
    levels = tree(leaves)
    walk = merkle.Traversal(leaves, merkle.levels(n))
    assert walk.root == levels[-1][0]
    most = 0
    for i, path in enumerate(walk.paths()):
        most = max(most, walk.held())
        assert path == siblings(levels, i)
    assert most <= 9 * merkle.levels(n) + 3
    # a block of a larger tree reaches its full height, however few leaves it has
    taller = merkle.Traversal(leaves, merkle.levels(n) + 2)
    assert taller.root == h(h(levels[-1][0]))
    assert [p[-2:] for p in taller.paths()] == [[("", ""), ("", "")]] * n


def test_the_schedule_is_never_late():
    """Every run's siblings are complete before it begins, without the last resort of ``paths``."""
    late = []
    for n in (27, 100, 243, 244, 700):
        walk = merkle.Traversal([h(str(i)) for i in range(n)], merkle.levels(n))
        for i, _ in enumerate(walk.paths()):
            # of the work of a step, what is still to be done when its path is handed out
            budget = merkle.levels(n)
            for level in range(merkle.levels(n)):
                if (i + 1) % 3 ** (level + 1) == 0 and walk.jobs[level] and i + 1 < n:
                    late.append((n, i, level, budget)) if walk.jobs[level].end - walk.jobs[level].at > budget else None
    assert not late


def test_query_against_its_plain_version(spark, sf_dir):
    import zlib

    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text, r.text.replace("\n", "") if zlib.crc32(str(r.doc_id).encode()) % 2 == 0 else r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, merkle.op12_merkle_manifest(spark, sf_dir).collect())) == sorted(plain(rows))
