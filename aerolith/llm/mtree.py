"""Exact top-k search by inner product on a paged M-tree.

With one more component, sqrt(M^2 - |x|^2) for a row and 0 for a query (M: the largest norm), the inner
product falls as the Euclidean distance grows: d(q, x)^2 = |q|^2 + M^2 - 2 <q, x>. So the k best
scores are the k nearest rows, and a metric tree finds them.

Rows with equal vectors are one entry with the smallest of their ids. The tree is loaded from the top: a node with over ``SHARD`` entries gets
``ROUTES`` of them as routing objects, and each entry goes to the nearest. A routing object has a covering radius and the distance to
its parent's. A node that is small enough is a shard; its entries are cut into leaf pages with a pivot, a covering radius and each entry's distance to the pivot.

A search goes down to the shard whose routing objects are nearest, which gives a bound for the k-th best. Then it goes down from the root again,
level by level, and leaves out every node that the bound rules out: by the stored distance to the parent, before any computation, or by the
distance to the routing object less the radius. In a shard pages are visited in the order of the same bound, and in a page only
entries are computed whose stored distance to the pivot lies within reach of the query's.

Distances are floating-point numbers with a margin for their errors; the scores of what is left are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Routing objects of a node, entries of a page, of a shard, and queries that visit a node at once.
ROUTES, PAGE, SHARD, BLOCK = 64, 256, 4_096, 2_048
SLACK = 1e-6


class Space:
    """Vectors divided by a power of two, so that none is longer than a number can hold, and lifted to where nearest means best."""

    def __init__(self, unit: float, m2: float):
        self.unit, self.m2 = unit, m2

    def matrix(self, cells) -> np.ndarray:
        return np.stack([np.frombuffer(x, dtype="<f8") for x in cells]) / self.unit

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.m2 - (x * x).sum(axis=1), 0))[:, None]])

    def margin(self, q: np.ndarray) -> np.ndarray:
        """How far a score of each query may be off: not at all while the sums are integers that a double holds."""
        norms = np.sqrt((q * q).sum(axis=1) * self.m2)
        return np.where(norms * self.unit * self.unit < 2.0**52, 0.0, 4e-16 * (q.shape[1] + 4) * norms)

    def reach(self, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The distance within which everything with a score of ``bound`` lies."""
        q2 = (q * q).sum(axis=1)
        return np.sqrt(np.maximum(q2 + self.m2 - 2 * (bound - self.margin(q)), 0)) + SLACK * (np.sqrt(self.m2) + np.sqrt(q2))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0))


def packed(x, scale: float) -> bytes:
    """floor(scale * x): whole numbers, which doubles hold exactly however large they are."""
    y = np.floor(scale * np.asarray(x, dtype=np.float64))
    if not np.isfinite(y).all():
        raise ValueError("a scaled component is beyond the range of doubles")
    return y.astype("<f8").tobytes()


def exact(a: bytes, b: bytes) -> int:
    """The integer inner product of two packed vectors."""
    x, y = np.frombuffer(a, dtype="<f8"), np.frombuffer(b, dtype="<f8")
    if np.abs(x) @ np.abs(y) < 2.0**52:
        return int(x @ y)
    return sum(int(i) * int(j) for i, j in zip(x.tolist(), y.tolist(), strict=True))


def entries(vectors: DataFrame, scale: float, k: int, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, v) and (entries: v, ids): ``v`` is floor(scale * x) as bytes of doubles, ``ids`` the k + 1 smallest ids that have it.

    Vectors that are null or empty, or hold null or non-finite components, take no part, nor do rows without an id.
    """
    x = F.col("x")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).where((F.size("x") > 0) & finite & F.col("vec_id").isNotNull())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": [packed(x, scale) for x in b["x"]]})

    rows = materialise(read.mapInPandas(pack, "vec_id long, v binary"))
    # of each vector only the first ids can be among anyone's k best; the rank limit is applied before and after the shuffle
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return rows, materialise(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))


def space_of(found: DataFrame) -> tuple[Space, int]:
    """The space of all entries, and how many these are."""

    def largest(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"top": [max(float(np.abs(np.frombuffer(x, dtype="<f8")).max()) for x in b["v"])]})

    def norms(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"m2": [float((Space(unit, 0).matrix(b["v"]) ** 2).sum(axis=1).max())]})

    top = found.select("v").mapInPandas(largest, "top double").agg(F.max("top")).first()[0] or 0.0
    unit = float(2.0 ** np.ceil(np.log2(top))) if top else 1.0
    return Space(unit, found.select("v").mapInPandas(norms, "m2 double").agg(F.max("m2")).first()[0] or 0.0), found.count()


def load(found: DataFrame, space: Space) -> tuple[DataFrame, DataFrame]:
    """(parent, node, pivot, radius, d_parent) of all nodes, the root being '', and (node, v, ids, rd) of the entries in shards.

    Nodes are split until none has over ``SHARD`` entries; a node's routing objects are those of its entries with the smallest hashes.
    """

    def assign(batches):
        for b in batches:
            for cell, g in b.groupby("node", sort=False):
                routes = space.lift(space.matrix(g["routes"].iloc[0]))
                d = distances(space.lift(space.matrix(g["v"])), routes)
                yield pd.DataFrame({"node": [f"{cell}/{i}" for i in d.argmin(axis=1)], "v": g["v"], "ids": g["ids"], "rd": d.min(axis=1)})

    def between(batches):
        for b in batches:
            one = [np.nan if p is None else float(distances(space.lift(space.matrix([v])), space.lift(space.matrix([p])))[0, 0]) for v, p in zip(b["pivot"], b["above"], strict=True)]
            yield b.drop(columns="above").assign(d_parent=one)

    cells = found.select(F.lit("").alias("node"), "v", "ids", F.lit(0.0).alias("rd"))
    pivots = found.sparkSession.createDataFrame([("", None)], "node string, above binary")
    large, levels = pivots.select("node"), []
    while True:
        some = cells.join(large, "node").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("v"), "v"))).where(F.col("r") <= ROUTES)
        routes = materialise(some.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("routes")))
        split = materialise(cells.join(routes, "node").select("node", "v", "ids", "routes").mapInPandas(assign, "node string, v binary, ids array<long>, rd double"))
        radius = split.groupBy("node").agg(F.max("rd").alias("radius"), F.count(F.lit(1)).alias("n"))
        made = routes.join(pivots, "node").select(F.col("node").alias("parent"), "above", F.posexplode("routes").alias("i", "pivot"))
        level = made.withColumn("node", F.concat_ws("/", "parent", F.col("i").cast("string"))).join(radius, "node").select("parent", "node", "pivot", "radius", "n", "above")
        level = materialise(level.mapInPandas(between, "parent string, node string, pivot binary, radius double, n long, d_parent double"))
        levels.append(level)
        cells = split if len(levels) == 1 else materialise(cells.join(large, "node", "left_anti").union(split))
        large, pivots = level.where(F.col("n") > SHARD).select("node"), level.select("node", F.col("pivot").alias("above"))
        if not large.limit(1).count():
            break
    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.union(x)
    return materialise(nodes.drop("n")), cells


def pages_of(cells: DataFrame, space: Space) -> DataFrame:
    """(node, pivot, radius, vectors, distances, ids): one row per leaf page of a shard."""

    def page(batches):
        for b in _whole(batches, "node"):
            b = b.reset_index(drop=True)
            x = space.lift(space.matrix(b["v"]))
            # halves by the distance to a far entry, again and again, until a page's worth is left
            todo, done = [np.arange(len(b))], []
            while todo:
                part = todo.pop()
                if len(part) <= PAGE:
                    done.append(part)
                    continue
                far = part[distances(x[part], x[part[:1]])[:, 0].argmax()]
                order = part[distances(x[part], x[far : far + 1])[:, 0].argsort(kind="stable")]
                todo += [order[: len(order) // 2], order[len(order) // 2 :]]
            for part in done:
                mean = x[part].mean(axis=0, keepdims=True)
                pivot = part[distances(x[part], mean)[:, 0].argmin()]
                d = distances(x[part], x[pivot : pivot + 1])[:, 0]
                yield pd.DataFrame({"node": [b["node"].iloc[0]], "pivot": [b["v"].iloc[pivot]], "radius": [float(d.max())], "vectors": [b["v"].iloc[part].tolist()], "distances": [d.tolist()], "ids": [b["ids"].iloc[part].tolist()]})

    shape = "node string, pivot binary, radius double, vectors array<binary>, distances array<double>, ids array<array<long>>"
    return cells.select("node", "v", "ids").repartition("node").sortWithinPartitions("node", "v").mapInPandas(page, shape)


def _whole(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroups sorted batches so that each frame has all rows of one key."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for _, g in b.groupby(key, sort=False):
            if held and held[-1][key].iloc[0] != g[key].iloc[0]:
                yield pd.concat(held)
                held = []
            held.append(g)
    if held:
        yield pd.concat(held)


def meet(queries: DataFrame, table: DataFrame, visit, shape: str) -> DataFrame:
    """Every query at a node with the rows of ``table`` for that node: ``visit(queries, rows)`` in tasks of at most about ``BLOCK`` queries."""
    many = materialise(queries.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    asked = queries.join(many, "node").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).drop("blocks")
    spread = table.join(many, "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def both(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        return visit(q, t) if len(q) and len(t) else pd.DataFrame()

    return asked.groupBy("node", "block").cogroup(spread.groupBy("node", "block")).applyInPandas(both, shape)


FRONTIER = "v binary, bound double, node string, d double"


def descend(frontier: DataFrame, nodes: DataFrame, space: Space, nearest: bool) -> DataFrame:
    """(v, bound, node, d): from nodes to the shards below them, to the nearest one or to all that ``bound`` doesn't rule out."""

    def step(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        x, d_parent, radius = space.matrix(q["v"]), t["d_parent"].to_numpy(), t["radius"].to_numpy()
        reach = np.full(len(q), np.inf) if nearest else space.reach(x, q["bound"].to_numpy())
        with np.errstate(invalid="ignore"):
            apart = np.abs(q["d"].to_numpy()[:, None] - d_parent[None, :]) - radius[None, :]
        may = ~(apart > reach[:, None])  # the root has no distance: nothing is ruled out there
        cols = np.flatnonzero(may.any(axis=0))
        d = distances(np.hstack([x, np.zeros((len(x), 1))]), space.lift(space.matrix(t["pivot"].iloc[cols])))
        keep = d == d.min(axis=1, keepdims=True) if nearest else may[:, cols] & (d - radius[cols] <= reach[:, None])
        if nearest:
            keep &= keep.cumsum(axis=1) == 1
        i, j = np.nonzero(keep)
        return pd.DataFrame({"v": q["v"].to_numpy()[i], "bound": q["bound"].to_numpy()[i], "node": t["child"].to_numpy()[cols[j]], "d": d[i, j]})

    below = nodes.select(F.col("parent").alias("node"), F.col("node").alias("child"), "pivot", "radius", "d_parent")
    inner = nodes.select(F.col("parent").alias("node")).distinct()
    arrived = None
    while True:
        frontier = materialise(meet(frontier, below, step, FRONTIER))
        there = frontier.join(inner, "node", "left_anti").select("v", "bound", "node", "d")
        arrived = there if arrived is None else arrived.union(there)
        frontier = frontier.join(inner, "node", "left_semi").select("v", "bound", "node", "d")
        if not frontier.limit(1).count():
            return arrived


def search_shard(q: pd.DataFrame, pages: pd.DataFrame, space: Space, k: int) -> list[tuple[int, int, list[int]]]:
    """(query, exact score, ids) of the k best entries of each query in a shard's pages, by score and then by their smallest id."""
    x, bound = space.matrix(q["v"]), q["bound"].to_numpy().copy()
    off = space.margin(x)
    to_pivot = distances(np.hstack([x, np.zeros((len(x), 1))]), space.lift(space.matrix(pages["pivot"])))
    low = to_pivot - pages["radius"].to_numpy()[None, :]
    best: list[list[tuple[float, int, int, int]]] = [[] for _ in range(len(x))]

    def visit(p: int, who: np.ndarray) -> None:
        r = space.reach(x[who], bound[who])
        stored = np.asarray(pages["distances"].iat[p])
        may = np.abs(to_pivot[who, p][:, None] - stored[None, :]) <= r[:, None]  # the triangle inequality, before any computation
        rows, at = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if not len(rows):
            return
        ids, vectors = pages["ids"].iat[p], pages["vectors"].iat[p]
        scores = x[who[rows]] @ space.matrix([vectors[j] for j in at]).T
        for i, w in enumerate(who[rows].tolist()):
            good = np.flatnonzero((scores[i] >= bound[w] - 2 * off[w]) & may[rows[i]][at])
            if len(good):
                mine = sorted(best[w] + [(-float(scores[i, g]), int(ids[at[g]][0]), p, int(at[g])) for g in good])
                if len(mine) >= k:
                    bound[w] = max(bound[w], -mine[k - 1][0])
                    mine = mine[:k] if off[w] == 0 else [t for t in mine if -t[0] >= bound[w] - 2 * off[w]]
                best[w] = mine

    nearest = low.argmin(axis=1)
    for p in np.unique(nearest):
        visit(int(p), np.flatnonzero(nearest == p))
    for p in np.argsort(low.min(axis=0), kind="stable"):
        who = np.flatnonzero((nearest != p) & (low[:, p] <= space.reach(x, bound)))
        if len(who):
            visit(int(p), who)
    out = []
    for w, mine in enumerate(best):
        scored = sorted((-exact(q["v"].iat[w], pages["vectors"].iat[p][e]), i, p, e) for _, i, p, e in mine)[:k]
        out += [(w, -s, list(pages["ids"].iat[p][e])) for s, _, p, e in scored]
    return out


def top_k(vectors: DataFrame, k: int = 10, query_modulus: int = 100, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``query_modulus`` the k best of all other rows.

    The score is the inner product of the floored, scaled vectors, an exact integer; ties go to the smaller id. Fewer other rows than k: all of them.
    The score is a long; only where the largest norm is 2 ** 31.5 or more, so that a long might not hold it, a decimal(38,0).
    Rows with the same id are one row each as a candidate, except that a query's own id is never its result; vectors must be of one
    length. Null or non-finite vectors take no part; an empty table gives an empty table. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows, found = entries(vectors, scale, k, id_col, vec_col)
    asked = rows.where(F.col("vec_id") % query_modulus == 0).select("vec_id", "v").distinct()
    space, total = space_of(found)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    nodes, cells = load(found, space)
    pages = materialise(pages_of(cells, space))
    small = space.m2 * space.unit**2 < 2.0**63  # no score is larger than the square of the largest norm
    shape = f"v binary, node string, score {'long' if small else 'decimal(38,0)'}, ids array<long>"
    most = 10**38 - 1

    def search(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        # k + 1 entries: the query's own row may be one of them
        got = search_shard(q, t, space, k + 1)
        score = [s if small else Decimal(max(-most, min(most, s))) for _, s, _ in got]
        return pd.DataFrame({"v": [q["v"].iat[w] for w, _, _ in got], "node": t["node"].iat[0], "score": score, "ids": [i for _, _, i in got]})

    start = materialise(asked.select("v").distinct().select("v", F.lit(float("-inf")).alias("bound"), F.lit("").alias("node"), F.lit(float("nan")).alias("d")))
    first = materialise(meet(descend(start, nodes, space, nearest=True), pages, search, shape))
    kth = first.groupBy("v").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("kth"))
    bound = F.coalesce(F.col("kth").cast("double") / space.unit / space.unit, F.lit(float("-inf")))
    known = start.drop("bound").join(kth, "v", "left").select("v", bound.alias("bound"), "node", "d")
    rest = descend(known, nodes, space, nearest=False).join(first.select("v", "node").distinct(), ["v", "node"], "left_anti")
    met = first.union(meet(rest, pages, search, shape)).select("v", "score", "ids")
    best = Window.partitionBy("v").orderBy(F.desc("score"), F.col("ids")[0])
    of_vector = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    each = asked.join(of_vector, "v").select(F.col("vec_id").alias("query_id"), "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The ten best rows of ``embeddings`` for each query row; see ``top_k`` for nulls, ties, repeated rows and empty tables."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM ok q JOIN ok c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
