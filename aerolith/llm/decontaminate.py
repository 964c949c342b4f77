"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A document holds a benchmark item if one of its windows of as many words as the item
has a weighted Jaccard similarity of 0.8 or more with it: over five-word shingles,
weighted by how often each occurs, the sum of the smaller counts over the sum of the larger ones.

1. Windows of every size that items have. A window that is similar to any item of its size has most of its shingles
   from the items of that size, so texts and windows with fewer such shingles are left out; that loses nothing. A document with fewer
   shingles than an item is one window.
2. Each window gets a 64-bit SimHash of its shingles. Fingerprints within a radius r share at least one
   of r + 1 blocks: windows and items of one size meet on equal blocks, and the Hamming distance is checked. This finds every
   pair within the radius. Windows smaller than the item have few shingles, of which fingerprints say little: they meet all items of the size.
   Nor do fingerprints say much of an item that repeats shingles, for single ones weigh a lot: such an item meets, without fingerprints, every window that has one of its
   heaviest shingles, as many of these as no similar window can be without.
3. The shingle counts of what is left are compared exactly.

The radius of 22 bits: at similarity 0.8 two fingerprints differ in 9.7 bits on average with a
deviation of 2.9, so a window of different shingles is lost with a probability of about 0.00001 at the very threshold, less above it.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sieve

SHINGLE, AT_LEAST, RADIUS = 5, 0.8, 22
#: Shingles of a text that are searched at once; a longer text is cut into stretches that overlap by the largest item.
STRETCH = 4096


def words(text: Column) -> Column:
    """The lower-cased runs of letters and digits; none for a null or empty text."""
    return F.coalesce(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]++"), lambda w: w != ""), F.array().cast("array<string>"))


def shingles(w: Column) -> Column:
    """Hashes of all five-word shingles in order, repeats included; of fewer words the whole sequence, of none nothing."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    whole = F.array(F.xxhash64(*[F.get(w, F.lit(k)) for k in range(SHINGLE)]))
    return F.when(F.size(w) >= SHINGLE, each).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def fingerprint(hashes: Column) -> Column:
    """The 64-bit SimHash of an array of hashes: bit b is 1 if it is set in over half of them.

    The 64 counts are kept in 32 sums of two 32-bit lanes each.
    """
    lane = lambda h, j: F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x100000001))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"l{j}") for j in range(32)])
    add = lambda acc, h: F.struct(*[(acc[f"l{j}"] + lane(h, j)).alias(f"l{j}") for j in range(32)])
    bit = lambda count, b: F.when(2 * count > F.size(hashes), F.lit((1 << b) - (1 << 64) * (b == 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    def bits(acc: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for j in range(32):
            out = out.bitwiseOR(bit(acc[f"l{j}"].bitwiseAND(F.lit(0xFFFFFFFF)), j)).bitwiseOR(bit(F.shiftrightunsigned(acc[f"l{j}"], 32), j + 32))
        return out

    return F.aggregate(hashes, zero, add, bits)


def _blocks(fp: Column, radius: int) -> Column:
    cut = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(i << 40) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))])


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, n_words, sh): items with at least one word; rows with the same id and text count once."""
    read = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("t")).dropDuplicates()
    return read.select("item_id", words(F.col("t")).alias("w")).select("item_id", F.size("w").alias("n_words"), shingles(F.col("w")).alias("sh")).where("n_words > 0")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): one row per document and item that it holds, with the best window (the first of the best).

    Null and empty texts, and items without words, match nothing. Rows that share a doc_id are one document
    for the result, though each text is searched by itself; a null id groups with itself. Empty tables give an empty table. Columns
    other than those named are not read.
    """
    items = materialise(items_of(benchmark, item_col, item_text_col).withColumn("m", F.size("sh")).withColumn("item_fp", fingerprint(F.col("sh"))))
    known = materialise(items.select(F.explode("sh").alias("h"), "m").distinct())
    # the different sizes of items, as numbers of shingles
    sizes = sorted(r.m for r in items.select("m").distinct().collect())
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"), F.xxhash64(id_col, F.col(text_col).cast("string")).alias("rk"))
    if not sizes:
        none = read.limit(0).join(items.limit(0))
        return none.select("doc_id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("start_word"), F.lit(0).cast("long").alias("n_words"))
    # texts with fewer of the benchmark's shingles than any similar window needs go no further
    least = max(1, min(ceil(AT_LEAST * m - 1e-9) for m in sizes))
    each = _shingled(read).select("rk", F.explode_outer("sh").alias("h"))
    some = materialise(each.join(known.select("h").distinct(), "h").groupBy("rk").count().where(F.col("count") >= least).select("rk"))
    maybe, _ = sieve(read, "rk", some.select(F.col("rk").alias("h")), some.count())
    texts = _shingled(maybe.join(some, "rk", "left_semi").dropDuplicates(["rk"]))
    step = max(STRETCH, sizes[-1])
    cut = F.transform(F.sequence(F.lit(0), F.size("sh") - 1, F.lit(step)), lambda o: F.struct(o.alias("offset"), F.slice("sh", o + 1, step + sizes[-1] - 1).alias("sh")))
    parts = materialise(texts.select("doc_id", "rk", F.size("sh").alias("n"), F.explode_outer(cut).alias("x")).select("doc_id", "rk", "n", "x.offset", "x.sh"))
    at = parts.select("rk", "offset", F.posexplode("sh").alias("pos", "h")).join(known, "h")
    # the positions of shingles that items of one size have: a window of that size must be made of them
    hits = at.groupBy("rk", "offset", "m").agg(F.array_sort(F.collect_list("pos")).alias("hits"))
    return _best(materialise(_windows(parts.join(hits, ["rk", "offset"]))), items)


def _shingled(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "rk", words(F.col("t")).alias("w")).select("doc_id", "rk", shingles(F.col("w")).alias("sh"))


def _least_common(m: Column, n: Column) -> Column:
    """How many shingles a window of n must share with an item of m: J >= s means s (n + m) / (1 + s) common ones."""
    return F.greatest(F.ceil(AT_LEAST * (n + m) / (1 + AT_LEAST) - 1e-9).cast("int"), F.lit(1))


# The outer forms of explode are used on computed arrays: for the others the optimiser adds a filter that computes the array once more.
def _windows(found: DataFrame) -> DataFrame:
    """(doc_id, m, start, smaller, win, fp): the windows of m shingles with enough from the benchmark, as many as each ``hits`` allows."""
    each = found.withColumn("c", _least_common(F.col("m"), F.least("m", "n")))
    each = each.where(F.size("hits") >= F.col("c"))
    m, c, hit = F.col("m"), F.col("c"), lambda j: F.get(F.col("hits"), j)
    # c hits in a row that fit into a window: all its starts that cover them and lie in the text
    fits = F.filter(F.sequence(F.lit(0), F.size("hits") - c), lambda j: hit(j + c - 1) - hit(j) < m)
    last = F.size("sh") - m
    spread = F.transform(fits, lambda j: F.when(last >= F.greatest(hit(j + c - 1) - m + 1, F.lit(0)), F.sequence(F.greatest(hit(j + c - 1) - m + 1, F.lit(0)), F.least(hit(j), last))).otherwise(F.array().cast("array<int>")))
    smaller = F.col("n") < m
    starts = F.when(smaller, F.array(F.lit(0))).otherwise(F.array_distinct(F.flatten(spread)))
    made = F.transform(starts, lambda s: F.struct((F.col("offset") + s).alias("start"), F.slice("sh", s + 1, m).alias("win")))
    out = each.select("doc_id", "m", smaller.alias("smaller"), F.explode_outer(made).alias("x")).select("doc_id", "m", "smaller", "x.*").where("start is not null")
    return out.withColumn("fp", fingerprint(F.col("win")))


def _heaviest(items: DataFrame) -> DataFrame:
    """(item_id, m, h): of each item that repeats shingles the heaviest ones, until what is left is too little for a similar window: one with none of them can't be similar."""
    some = items.where(F.size(F.array_distinct("sh")) < F.col("m")).select("item_id", "m", F.explode("sh").alias("h"))
    counts = some.groupBy("item_id", "m", "h").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "h")))
    each = counts.groupBy("item_id", "m").agg(order.alias("o"))
    spare = F.col("m") - _least_common(F.col("m"), F.col("m"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("h"))
    taken = F.aggregate("o", zero, lambda acc, x: F.when(acc["n"] > spare, acc).otherwise(F.struct((acc["n"] - x["n"]).alias("n"), F.concat(acc["h"], F.array(x["h"])).alias("h"))))
    return each.select("item_id", "m", F.explode(taken["h"]).alias("h"))


def _best(windows: DataFrame, items: DataFrame) -> DataFrame:
    every = F.array(F.lit(-1).cast("bigint"))
    # copies have the same windows: their fingerprints meet the items once
    left = windows.select("m", "smaller", "fp").distinct().select("*", F.posexplode_outer(F.when(F.col("smaller"), every).otherwise(_blocks(F.col("fp"), RADIUS))).alias("i", "block"))
    right = items.select("item_id", "m", "item_fp", F.explode_outer(F.concat(_blocks(F.col("item_fp"), RADIUS), every)).alias("block"))
    # a pair that shares several blocks goes on from the first of them
    same = F.zip_with(_blocks(F.col("fp"), RADIUS), _blocks(F.col("item_fp"), RADIUS), lambda a, b: a == b)
    close = (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS) & (F.array_position(same, True) - 1 == F.col("i"))
    met = left.join(right, ["m", "block"]).where(F.col("smaller") | close).select("m", "smaller", "fp", "item_id")
    heavy = materialise(_heaviest(items))
    sizes = [r.m for r in heavy.select("m").distinct().collect()]
    if sizes:
        each = windows.where(~F.col("smaller") & F.col("m").isin(sizes)).select("m", "smaller", "fp", F.explode_outer(F.array_distinct("win")).alias("h"))
        met = met.union(each.distinct().join(heavy, ["m", "h"]).select("m", "smaller", "fp", "item_id")).distinct()
    # exact: the window's shingle counts against the item's
    near = windows.join(materialise(met), ["m", "smaller", "fp"]).join(items.select("item_id", "m", "n_words", F.col("sh").alias("own")), ["item_id", "m"])
    count = lambda a, h: F.size(F.filter(a, lambda y: y == h))
    once = (F.size(F.array_distinct("win")) == F.size("win")) & (F.size(F.array_distinct("own")) == F.size("own"))
    shared = F.array_intersect("win", "own")
    common = F.when(once, F.size(shared)).otherwise(F.aggregate(shared, F.lit(0), lambda acc, h: acc + F.least(count(F.col("win"), h), count(F.col("own"), h))))
    scored = near.withColumn("c", common).withColumn("similarity", F.col("c") / (F.size("win") + F.size("own") - F.col("c"))).where(F.col("similarity") >= AT_LEAST)
    best = scored.groupBy("doc_id", "item_id", "n_words").agg(F.max(F.struct("similarity", (-F.col("start")).alias("rest"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.rest")).cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay. Rows with a null id are kept unless a row with a null id holds one."""
    # written first, so that its size is known: a small table is broadcast, and the texts aren't shuffled
    bad = materialise(contaminated(docs, benchmark, id_col, text_col).select("doc_id").distinct())
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"))
    return row.join(bad, F.col("own_id").eqNullSafe(bad["doc_id"]), "left_anti").select("row.*")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` that holds an item of ``benchmark``, with the item's best window; see ``contaminated`` for nulls, repeated ids and empty tables."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every window that shares any shingle with an item, without anchors, fingerprints or blocks.
ORACLE_SQL = """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
sh AS (SELECT doc_id, p.p AS pos, CASE WHEN len(w) >= 5 THEN array_to_string(w[p.p:p.p + 4], ' ') ELSE array_to_string(w, ' ') END AS s
       FROM dw, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS p(p)),
ish AS (SELECT item_id, len(w) AS n_words, greatest(len(w) - 4, 1) AS m, p.p AS pos, CASE WHEN len(w) >= 5 THEN array_to_string(w[p.p:p.p + 4], ' ') ELSE array_to_string(w, ' ') END AS s
        FROM iw, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS p(p) WHERE len(w) > 0),
n_sh AS (SELECT doc_id, max(pos) AS total FROM sh GROUP BY doc_id),
hit AS (SELECT DISTINCT sh.doc_id, ish.item_id, ish.n_words, ish.m, sh.pos FROM sh JOIN ish USING (s)),
win AS (SELECT DISTINCT h.doc_id, h.item_id, h.n_words, h.m, st.st AS start
        FROM hit h JOIN n_sh USING (doc_id), unnest(range(greatest(least(h.pos - h.m + 1, total - h.m + 1), 1), greatest(least(h.pos, total - h.m + 1), 1) + 1)) AS st(st)),
wc AS (SELECT w.doc_id, w.item_id, w.n_words, w.m, w.start, sh.s, count(*) AS c
       FROM win w JOIN sh ON sh.doc_id = w.doc_id AND sh.pos BETWEEN w.start AND w.start + w.m - 1 GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS c FROM ish GROUP BY ALL),
com AS (SELECT wc.doc_id, wc.item_id, wc.n_words, wc.m, wc.start, sum(least(wc.c, ic.c)) AS common FROM wc JOIN ic USING (item_id, s) GROUP BY ALL),
size AS (SELECT doc_id, item_id, start, sum(c) AS n FROM wc GROUP BY ALL),
sc AS (SELECT com.doc_id, com.item_id, com.n_words, com.start, common / (n + com.m - common) AS similarity FROM com JOIN size USING (doc_id, item_id, start))
SELECT doc_id, item_id, CAST(max(similarity) AS DOUBLE) AS similarity, CAST(arg_min(start, (-similarity, start)) - 1 AS BIGINT) AS start_word, CAST(n_words AS BIGINT) AS n_words
FROM sc WHERE similarity >= 0.8 GROUP BY doc_id, item_id, n_words
"""
