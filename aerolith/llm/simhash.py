"""SimHash near-duplicate detection on pigeonhole blocks.

A document's fingerprint has 64 bits; bit b is 1 if it is set in over half of the
XXH64 hashes of its word shingles. To find all pairs that differ in at most r bits
the fingerprint is cut into m blocks: such a pair agrees in at least m - r of them,
so it shares the key made of some m - r blocks. Documents meet on those keys, and the
Hamming distance of what meets there is verified.

For pairs by similarity two independent fingerprints of the distinct shingles are taken. Their keys bring pairs together, the distance of
both decides which are worth a comparison, and the shingle sets are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget_tables, join_hot, materialise, sieve, slices, text_batches
from .components import components

SEED = 42
#: Members of a key that one comparison holds at once; larger groups are cut into pairs of chunks.
CHUNK = 1024
#: Shingles of all texts of a chunk, in the mean.
CHUNK_SHINGLES = 500_000
#: Shingles that are hashed at once, so that a very long text needs no more memory than this.
STRETCH = 1 << 16


def shingle_spans(text: str | None, size: int) -> tuple[bytes, list[int], list[int]]:
    """The text with A-Z lowered and its words joined by single spaces, and the shingles' starts and ends in it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b"", [], []
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(size, len(words))
    return b" ".join(words), starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()


def fingerprint(text: str | None, size: int) -> int:
    """The unsigned 64-bit SimHash; 0 for a text without words."""
    joined, starts, ends = shingle_spans(text, size)
    if not starts:
        return 0
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), STRETCH):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + STRETCH], ends[at : at + STRETCH], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts)).view("<u8")[0])


def set_prints(text: str | None, size: int) -> tuple[int, int, int, int]:
    """Two fingerprints of a text's distinct shingles, a hash of their set, and how many they are."""
    h = shingle_set(text, size)
    if not len(h):
        return 0, 0, 0, 0
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out = []
    for x in (h, mixed ^ (mixed >> np.uint64(32))):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(x), STRETCH):
            counts += np.unpackbits(x[at : at + STRETCH].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(x)).view("<u8")[0]))
    return out[0], out[1], xxhash.xxh64_intdigest(h.tobytes(), SEED), len(h)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    joined, starts, ends = shingle_spans(text, size)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)), dtype="<u8", count=len(starts)))


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """(doc_id, rk, node, f0), one row per input row; rk names the row by id and text, node is the fingerprint; null and empty texts get 0.

    With ``sets`` (doc_id, rk, node, f0, f1, size): node is a hash of the set of distinct shingles, size how many they are.
    """
    names = ["node", "f0", "f1", "size"] if sets else ["node", "f0"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            if sets:
                made = [set_prints(x, size) for x in texts]
                cols = np.array([(th, f0, f1, n) for f0, f1, th, n in made], dtype=np.uint64)
            else:
                cols = np.repeat(np.array([fingerprint(x, size) for x in texts], dtype=np.uint64)[:, None], 2, axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), *[pa.array(cols[:, i].copy().view(np.int64)) for i in range(len(names))]], ["doc_id", "rk", *names])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text_batches(picked).select("doc_id", row_hash("doc_id", "text").alias("rk"), "text").mapInArrow(run, "doc_id long, rk long, " + ", ".join(f"{k} long" for k in names))


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def block_masks(blocks: int, agree: int) -> list[int]:
    """Signed 64-bit masks of every choice of ``agree`` of so many blocks."""
    if not 0 < agree <= blocks <= 64:
        raise ValueError("0 < agree <= blocks <= 64")
    cut = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in range(blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(one, agree))]


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Picks among the pairs (a, b) a spanning forest over the components in ``labels``, and merges those in place."""
    picked = []
    rest = np.arange(len(a))
    while True:
        x, y = labels[a[rest]], labels[b[rest]]
        rest, x, y = rest[x != y], x[x != y], y[x != y]
        if not len(rest):
            return np.concatenate(picked) if picked else rest
        low, high = np.minimum(x, y), np.maximum(x, y)
        roots, first = np.unique(high, return_index=True)  # each root hooks once, and downwards: no cycle
        picked.append(rest[first])
        up = np.arange(len(labels))
        up[roots] = low[first]
        while (up[up] != up).any():
            up = up[up]
        labels[:] = up[labels]


def spanning_links(group: np.ndarray, fps: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in contiguous groups -> positions (a, b) and distances of a minimum spanning forest of the pairs within ``radius``, the sum over all fingerprints."""
    found, at, d = [], np.arange(len(group)), 0
    while True:
        d += 1
        at = at[at < len(group) - d]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        dist = sum(np.bitwise_count(fp[at] ^ fp[at + d]) for fp in fps)
        near = dist <= radius
        if near.any():
            found.append((at[near], at[near] + d, dist[near]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, b, dist = (np.concatenate(x) for x in zip(*found, strict=True))
    used, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib, labels, keep = inv[: len(a)], inv[len(a) :], np.arange(len(used)), []
    for level in range(radius + 1):
        mine = np.flatnonzero(dist == level)
        if len(mine):
            keep.append(mine[_join(labels, ia[mine], ib[mine])])
    keep = np.concatenate(keep)
    return a[keep], b[keep], dist[keep]


def _group_ids(b: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Numbers the runs of equal ``keys``."""
    change = np.zeros(len(b), dtype=bool)
    for k in keys:
        v = b[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)


def _whole_groups(keys: list[str], pairs: Callable[[pd.DataFrame], pd.DataFrame]):
    """A mapInPandas function over rows sorted by ``keys``; whole groups go to ``pairs`` as soon as they are complete."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = b[keys].iloc[-1]
            same = np.ones(len(b), dtype=bool)
            for k in keys:
                same &= b[k].to_numpy() == last[k]
            tail = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            if tail:
                yield pairs(pd.concat([*held, b.iloc[:tail]], ignore_index=True))
                held = []
            elif held and (held[-1][keys].iloc[-1] != last).any():
                yield pairs(pd.concat(held, ignore_index=True))
                held = []
            held.append(b.iloc[tail:])
        if held:
            yield pairs(pd.concat(held, ignore_index=True))

    return run


def _linker(radius: int, keys: list[str], fps: list[str]):
    """Rows sorted by ``keys`` -> links of each group."""

    def pairs(b: pd.DataFrame) -> pd.DataFrame:
        own = [b[f].to_numpy().astype(np.int64) for f in fps]
        x, y, d = spanning_links(_group_ids(b, keys), [f.view(np.uint64) for f in own], radius)
        return pd.DataFrame({f"u{i}": f[x] for i, f in enumerate(own)} | {f"v{i}": f[y] for i, f in enumerate(own)} | {"distance": d.astype(np.int32)})

    return _whole_groups(keys, pairs)


def _named(fps: list[str]) -> Column:
    """One long that names a tuple of fingerprints."""
    return F.xxhash64(*fps) if len(fps) > 1 else F.col(fps[0])


def links(nodes: DataFrame, radius: int = 4, blocks: int = 7, agree: int | None = None, fps: tuple[str, ...] = ("f0",)) -> DataFrame:
    """Distinct fingerprints -> (u, v, distance), links that connect what the pairs that meet within ``radius`` connect.

    A key is made of ``agree`` of a fingerprint's blocks; by default ``blocks - radius``, so that every pair within the radius meets. Each key's
    members are compared with each other, and of the close pairs only a minimum spanning forest is returned, so a dense group of n near copies
    gives under n rows per key, not n squared. A key with over ``CHUNK`` members is cut by hash into chunks, and
    every pair of chunks is compared in a task of its own: no task holds more than
    two chunks, no pair is left out.
    """
    names = list(fps)
    masks = [(f, m) for f in names for m in block_masks(blocks, agree or blocks - radius)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col(f).bitwiseAND(F.lit(m))) for i, (f, m) in enumerate(masks)])
    keyed = nodes.select(*names, F.explode(keys).alias("key"))
    sized = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    shape = "".join(f"u{i} long, " for i in range(len(names))) + "".join(f"v{i} long, " for i in range(len(names))) + "distance int"
    small = sized.where(F.col("n") <= CHUNK).select("key", *names).sortWithinPartitions("key").mapInPandas(_linker(radius, ["key"], names), shape)
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64(*names, "key"), chunks).cast("int")
    large = (
        sized.where(F.col("n") > CHUNK)
        .select("key", *names, own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("key", *names, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
        .mapInPandas(_linker(radius, ["key", "lo", "hi"], names), shape)
    )
    ends = [_named([f"{e}{i}" for i in range(len(names))]).alias(e) for e in "uv"]
    return small.union(large).select(*ends, "distance").distinct()


def similar_links(sets: list[np.ndarray], at_least: float) -> list[tuple[int, int]]:
    """Positions (a, b) of a spanning forest of all pairs of sorted shingle sets with Jaccard similarity ``at_least``.

    A pair that fails leaves all other pairs to be tried; only pairs that are connected already are left out. Sets that
    similar share one of their first n - ceil(s n) + 1 shingles in any common order (here the rarest first), so others aren't compared.
    """
    sizes, labels, picked = np.array([len(x) for x in sets]), np.arange(len(sets)), []
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    holders: dict[int, list[int]] = {}

    def linked(a: int, b: int) -> bool:
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        ok = common >= at_least * (sizes[a] + sizes[b] - common) - 1e-9
        if ok:
            picked.append((a, b))
            labels[labels == labels[b]] = labels[a]
        return ok

    for i, own in enumerate(sets):
        df = counts[np.searchsorted(tokens, own)]
        first = np.lexsort((own, df))[: len(own) - int(np.ceil(at_least * len(own) - 1e-9)) + 1]
        prefix = own[first[df[first] > 1]].tolist()
        low, high = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
        left = np.flatnonzero(low >= at_least * high - 1e-9)
        if len(left) and linked(int(left[-1]), i):
            left = left[labels[left] != labels[i]]
        else:
            left = left[:-1]
        if len(left) and len(own):
            left = np.intersect1d(left, np.array(sorted({j for h in prefix for j in holders.get(h, ())}), dtype=np.int64))
        for j in left[::-1].tolist():
            if labels[j] != labels[i]:
                linked(j, i)
        for h in prefix:
            holders.setdefault(h, []).append(i)
    return picked


def jaccard_links(members: DataFrame, total: int, docs: DataFrame, size: int, at_least: float) -> DataFrame:
    """(cls, node, rk, size) texts in classes -> (u, v), nodes: links that connect what the pairs of a class do that have Jaccard similarity ``at_least`` on distinct word shingles.

    ``docs`` has (rk, text). Only texts of classes with several are shuffled, once. A class with over ``CHUNK`` texts or ``CHUNK_SHINGLES``
    shingles is cut by hash into chunks, and every pair of chunks is compared in a task of its own.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            made = pa.array([shingle_set(x, size).tobytes() for x in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("cls", "node", "chunks")], made], ["cls", "node", "chunks", "sh"])

    keys = ["cls", "lo", "hi"]

    def pairs(b: pd.DataFrame) -> pd.DataFrame:
        node, out = b["node"].to_numpy(), []
        bounds = np.flatnonzero(np.diff(_group_ids(b, keys), prepend=-1, append=-1))
        for s, e in zip(bounds, bounds[1:], strict=False):
            sets = [np.frombuffer(x, dtype="<u8") for x in b["sh"].iloc[s:e]]
            out += [(node[s + x], node[s + y]) for x, y in similar_links(sets, at_least)]
        return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    pieces = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("s") / CHUNK_SHINGLES)).cast("int")
    several = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).where("n > 1").withColumn("chunks", pieces).drop("s")
    some = materialise(join_hot(members, materialise(several), "cls", total).select("cls", "node", "rk", "chunks"))
    near, _ = sieve(docs, "rk", some.select(F.col("rk").alias("h")), some.count())
    read = near.join(some, "rk").dropDuplicates(["rk"]).select("cls", "node", "chunks", "text")
    texts = read.mapInArrow(hashed, "cls long, node long, chunks int, sh binary")
    own = F.pmod(F.xxhash64("node", "cls"), F.col("chunks")).cast("int")
    spread = texts.select("cls", "node", "sh", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    placed = spread.select("cls", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "sh")
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_whole_groups(keys, pairs), "u long, v long")


def _classes(docs: DataFrame, size: int, radius: int, blocks: int, agree: int | None, at_least: float | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rk, node) of all rows, and (node, n, first, least): how many rows a node has, and the row that stands for its class (rk, and its id).

    A node is a fingerprint, or with ``at_least`` a set of shingles: texts with close or equal fingerprints only meet, and are then compared.
    """
    sets = at_least is not None
    marked = materialise(fingerprints(docs, size, id_col, text_col, sets))
    fps = ["f0", "f1"] if sets else ["f0"]
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk")
    nodes = materialise(marked.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), *[F.first(c).alias(c) for c in (*fps, "size") if c in marked.columns]))
    roots = components(links(nodes.select(*fps).distinct(), radius, blocks, agree, tuple(fps)))
    if sets:
        own = nodes.select("node", F.col("first.rk").alias("rk"), "size", _named(fps).alias("id"))
        met = own.join(roots.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("root", "id").alias("cls"), "node", "rk", "size")
        texts = docs.select(row_hash(id_col, text_col).alias("rk"), F.col(text_col).cast("string").alias("text"))
        roots = components(jaccard_links(materialise(met), nodes.count(), texts, size, at_least))
    roots = materialise(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()))
    placed = nodes.join(roots, "node").select("node", F.col("n").alias("rows"), "first", "root")
    least = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least"))
    joined = join_hot(placed, materialise(least), "root", roots.count()).select("node", F.col("rows").alias("n"), "first", "least")
    alone = nodes.join(roots, "node", "left_anti").select("node", "n", "first", F.col("first").alias("least"))
    return marked, materialise(joined.union(alone))


def near_duplicates(
    docs: DataFrame, size: int = 4, radius: int = 4, blocks: int = 7, agree: int | None = None, at_least: float | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest doc_id reachable over links, the document's own included. With
    ``at_least`` two fingerprints of the distinct shingles bring texts together (``radius`` is that of both), and texts link if they have that
    Jaccard similarity.

    Null and empty texts have fingerprint zero and link like any other. Rows with a
    null doc_id keep it and take the component of their fingerprint or text, null if no
    other row of it has an id. Repeated rows are each returned. An empty table gives an empty
    table; columns other than the two named are not read.
    """
    marked, placed = _classes(docs, size, radius, blocks, agree, at_least, id_col, text_col)
    of_node = placed.select("node", "n", F.col("least.doc_id").alias("component_id"))
    return join_hot(marked, of_node, "node", marked.count()).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(
    docs: DataFrame, size: int = 5, radius: int = 32, blocks: int = 10, agree: int = 3, at_least: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stand for their classes, columns as they were: of each class the one with the smallest id.

    Rows without an id come after all others, ties go by a hash of the row; of repeated rows one stays. Null and empty texts are alike. An empty
    table gives an empty table. Rows that can't be copies are neither shuffled nor compared with the list of those that go.
    """
    marked, placed = _classes(docs, size, radius, blocks, agree, at_least, id_col, text_col)
    among = placed.where((F.col("n") > 1) | (F.col("first.rk") != F.col("least.rk"))).select("node", "n", F.col("least.rk").alias("stays"))
    judged = join_hot(marked.select("rk", "node"), materialise(among), "node", marked.count()).groupBy("rk").agg(F.count(F.lit(1)).alias("times"), F.max(F.col("rk") != F.col("stays")).alias("goes"))
    listed = materialise(judged.where("goes or times > 1"))
    named = docs.select(F.struct("*").alias("row"), row_hash(id_col, text_col).alias("rk"))
    maybe, clear = sieve(named, "rk", listed.select(F.col("rk").alias("h")), listed.count())
    stay = maybe.join(listed.where("goes").select("rk"), "rk", "left_anti").dropDuplicates(["rk"])
    return clear.select("row.*").unionByName(stay.select("row.*"))


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; see ``near_duplicates`` for nulls, empty texts, repeated rows and empty tables."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
