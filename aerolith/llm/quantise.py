"""Vectors as product-quantised codes, exact to the last integer.

Vectors become integers and are cut into equal parts, each with a codebook of its own. A round broadcasts a kd-tree for each codebook; every
part finds its nearest entry by branch and bound, and the integer sums and counts of the parts of every entry are added up over the
cluster, per task first. What reaches the driver in a round is one sum for each number in the codebooks, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_tables, join_hot, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a leaf of a tree.
LEAF = 2


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): longs, or Python's integers where one is too large for that."""
    y = np.floor(scale * x)
    if not np.isfinite(y).all():
        raise ValueError("a scaled component is beyond the range of doubles")
    if len(y) and np.abs(y).max() >= 2.0**62:
        return np.array([[int(v) for v in r] for r in y], dtype=object).reshape(y.shape)
    return y.astype(np.int64)


def roomy(x: np.ndarray, most: int, terms: int) -> np.ndarray:
    """``x``, as Python's integers where squared differences of numbers up to ``most``, so many of them, may be too large for a long."""
    return x if x.dtype != object and terms * (2 * most) ** 2 < 2**63 else x.astype(object)


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


class KdTree:
    """The entries of one codebook in boxes, halved along their widest side until a box holds ``LEAF`` or only equal ones."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.most = entries, largest(entries)
        self.root = self._box(np.arange(len(entries)))

    def _box(self, ids: np.ndarray) -> tuple:
        x = self.entries[ids]
        low, high = x.min(axis=0), x.max(axis=0)
        axis = int(np.argmax(high - low))
        if len(ids) <= LEAF or high[axis] == low[axis]:
            return low, high, np.sort(ids), None
        order = ids[np.argsort(x[:, axis], kind="stable")]
        half = len(order) // 2
        return low, high, None, (self._box(order[:half]), self._box(order[half:]))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each point, of equally near ones the lowest index.

        A box is left out only where it is further than the best found so far: one that is just as far may hold a lower index.
        """
        x = roomy(points, max(self.most, largest(points)), points.shape[1])
        best, at = np.full(len(x), -1, dtype=x.dtype), np.full(len(x), len(self.entries))
        self._visit(self.root, x, np.arange(len(x)), best, at)
        return at, best

    @staticmethod
    def _bound(box: tuple, x: np.ndarray) -> np.ndarray:
        out = np.maximum(np.maximum(box[0] - x, x - box[1]), 0)
        return (out * out).sum(axis=1)

    def _visit(self, box: tuple, x: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        if not len(rows):
            return
        ids, halves = box[2:]
        if halves is None:
            for i in ids.tolist():
                off = x[rows] - self.entries[i]
                d = (off * off).sum(axis=1)
                better = (best[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (i < at[rows]))
                won = rows[better.astype(bool)]
                best[won], at[won] = d[better.astype(bool)], i
            return
        bounds = [self._bound(h, x[rows]) for h in halves]
        first = (bounds[0] <= bounds[1]).astype(bool)
        self._visit(halves[0], x, rows[first], best, at)
        self._visit(halves[1], x, rows[~first], best, at)
        for k, mine in ((1, first), (0, ~first)):
            left, b = rows[mine], bounds[k][mine]
            self._visit(halves[k], x, left[((best[left] < 0) | (b <= best[left])).astype(bool)], best, at)


def _matrix(b: pa.RecordBatch, width: int, scale: int) -> np.ndarray:
    return integers(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)


def valid(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, x) of vectors that are not null or empty and hold neither null nor non-finite components."""
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    read = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    return read.where((F.size("x") > 0) & finite)


def sums(rows: DataFrame, trees, parts: int, width: int, scale: int) -> list:
    """(part, entry, at, n, total): of the parts whose nearest entry it is, how many there are and the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        found, w = trees.value, width // parts
        n, total = np.zeros((parts, len(found[0].entries)), dtype=np.int64), np.zeros((parts, len(found[0].entries), w), dtype=object)
        for b in batches:
            x = _matrix(b, width, scale)
            for p, tree in enumerate(found):
                mine = x[:, p * w : (p + 1) * w]
                at, _ = tree.nearest(mine)
                mine = mine if mine.dtype != object and largest(mine) * max(len(mine), 1) < 2**62 else mine.astype(object)
                for i in np.unique(at).tolist():
                    total[p, i] += mine[at == i].sum(axis=0).astype(object)
                    n[p, i] += int((at == i).sum())
        used = np.argwhere(n > 0).tolist()
        cells = [(p, i, k, int(n[p, i]), Decimal(int(total[p, i, k]))) for p, i in used for k in range(w)]
        if any(abs(c[4]) >= 10**38 for c in cells):
            raise OverflowError("a sum of components is beyond 38 digits")
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)), strict=True)], names=["part", "entry", "at", "n", "total"])

    made = rows.select("x").mapInArrow(run, "part int, entry int, at int, n long, total decimal(38,0)")
    return made.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()


def fit(rows: DataFrame, width: int, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """Codebooks (part, entry, component) after all rounds. They begin as the parts of the vectors with the smallest ids, nulls last, equal ids by vector."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    books = integers(np.array([r.x for r in first], dtype=np.float64), scale).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    spark = rows.sparkSession
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([KdTree(b) for b in books])
        new = books.astype(object)
        for r in sums(rows, trees, parts, width, scale):
            new[r.part, r.entry, r.at] = int(r.total) // r.n
        books = new.astype(np.int64) if largest(new) < 2**62 else new
        trees.unpersist()
    return books


def encoded(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) for every vector, codebooks): ``code`` has two hex digits a part, ``error`` is the squared distance to what they stand for.

    Vectors that are null or empty or hold null or non-finite components are left out, as are those of another length than the vector with the smallest
    id: they lack components. A length that the parts don't divide is an error, as are a squared distance that a long can't hold and a sum of over 38 digits. Repeated rows are encoded
    each; fewer vectors than entries make smaller codebooks; no vectors make none and an empty table.
    """
    rows = valid(vectors, id_col, vec_col, label_col)
    shape = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    least = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(1).select(F.size("x")).first()
    if least is None:
        return vectors.sparkSession.createDataFrame([], shape), np.zeros((parts, 0, 0), dtype=np.int64)
    width = least[0]
    if width % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {width} components")
    rows = rows.where(F.size("x") == width)
    books = fit(rows, width, parts, entries, rounds, scale)
    trees, w = vectors.sparkSession.sparkContext.broadcast([KdTree(b) for b in books]), width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for b in batches:
            x = _matrix(b, width, scale)
            found = [tree.nearest(x[:, p * w : (p + 1) * w]) for p, tree in enumerate(trees.value)]
            error = sum(d.astype(object) for _, d in found).tolist() if len(x) else []
            if error and max(error) >= 2**63:
                raise OverflowError("a squared distance is beyond the range of longs")
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            code = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, shape), books


def digest(books: np.ndarray) -> str:
    """Of all entries' components as decimals, by part, entry and place."""
    return sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over equal labels, nulls together; a label that most rows have is not shuffled as one."""
    codes = materialise(codes.withColumn("_key", F.struct("label")))
    total = codes.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return join_hot(codes, materialise(total), "_key", codes.count()).drop("_key")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all valid ``embeddings``, their errors by label, and a digest of the codebooks; see ``encoded`` for what is left out, repeated rows and empty tables."""
    codes, books = encoded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assign(r: int) -> str:
    return f"""a{r} AS MATERIALIZED (SELECT row, part, any_value(v) AS v, min(struct_pack(d := d, entry := entry)) AS m FROM (
        SELECT row, c.part, v, entry, list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM comp c JOIN b{r} b ON b.part = c.part) GROUP BY row, part)"""


def _update(r: int) -> str:
    return f"""u{r} AS (SELECT part, entry, k, sum(x) AS s, count(*) AS n FROM (SELECT part, m.entry AS entry, unnest(v) AS x, unnest(range(len(v))) AS k FROM a{r}) GROUP BY ALL),
    b{r + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(n.e, o.e) AS e FROM b{r} o LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS e FROM u{r} GROUP BY ALL) n ON n.part = o.part AND n.entry = o.entry)"""


ORACLE_SQL = (
    f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, embedding FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = len(embedding)),
    comp AS MATERIALIZED (SELECT row, part, list_transform(embedding[part * (len(embedding) // {PARTS}) + 1 : (part + 1) * (len(embedding) // {PARTS})], lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept, range({PARTS}) r(part)),
    b0 AS MATERIALIZED (SELECT part, row AS entry, v AS e FROM comp WHERE row < {ENTRIES}), """
    + ",\n    ".join(f"{_assign(r)},\n    {_update(r)}" for r in range(ROUNDS))
    + f""",
    {_assign(ROUNDS)},
    done AS (SELECT row, string_agg(format('{{:02x}}', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row),
    book AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry)) AS sha FROM (SELECT part, entry, array_to_string(e, ',') AS x FROM b{ROUNDS}))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM done JOIN kept USING (row), book"""
)
