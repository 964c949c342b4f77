"""A Merkle manifest of a table: a leaf for every row, a tree for every source, one over the sources, and a proof for every row.

Trees have three children a node. Rows get their places in their trees from one range-partitioned sort, and every aligned
block of ``ARITY ** height`` places becomes one record, however many rows a source has. A block's root takes one pass; the roots are the
leaves of the same step again, until each tree has one left. Then every block is traversed leaf by leaf: for each level of it the
siblings of the present leaf are at hand, and a treehash stack builds the siblings of the next run while the present one is used; the stack with the lowest open
node goes first, so that only a logarithmic number of nodes is ever held. The path above the block, which all its leaves share, is appended.
Only the number of blocks reaches the driver; texts are hashed where they are read and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget_tables, materialise

#: Children of a node, and levels of a block: a record holds 243 leaves at most.
ARITY, HEIGHT = 3, 5
PATH = "array<struct<left:string,right:string>>"
DONE = 1 << 30


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels(n: int) -> int:
    """How many levels a tree of ``n`` leaves has above them."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


class Treehash:
    """Builds one node of a given height over the leaves from ``start`` on, of ``count`` in all; the last run of a level may have fewer."""

    def __init__(self, height: int, start: int, count: int, made=None):
        self.height, self.at, self.end, self.stack, self.made = height, start, min(start + ARITY**height, count), [], made

    def low(self) -> int:
        """The height of the lowest node on the stack."""
        if self.at == self.end:
            return DONE
        return self.stack[-1][0] if self.stack else self.height

    def _put(self, height: int, node: str) -> None:
        self.stack.append((height, node))
        if self.made:
            self.made(height, node)

    def _fold(self, n: int) -> None:
        height = self.stack[-1][0]
        nodes = [x for _, x in self.stack[-n:]]
        del self.stack[-n:]
        self._put(height + 1, digest(*nodes))

    def step(self, leaf: str) -> str | None:
        """Takes the next leaf; the node, once it is complete."""
        self._put(0, leaf)
        self.at += 1
        while len(self.stack) >= ARITY and self.stack[-ARITY][0] == self.stack[-1][0]:
            self._fold(ARITY)
        if self.at < self.end:
            return None
        while self.stack[-1][0] < self.height:
            self._fold(sum(h == self.stack[-1][0] for h, _ in self.stack))
        return self.stack[-1][1]


class Traversal:
    """The root of a block, and its authentication paths leaf by leaf."""

    def __init__(self, leaves: list[str], height: int):
        self.leaves, self.height = leaves, height
        # a node of the top height has no siblings in the block
        self.now: list[list[str]] = [[] for _ in range(height + 1)]
        first = Treehash(height, 0, len(leaves), lambda h, x: self.now[h].append(x) if len(self.now[h]) < ARITY else None)
        for x in leaves:
            self.root = first.step(x)
        self.next: list[list[str]] = [[] for _ in range(height)]
        self.jobs: list[Treehash | None] = [self._job(h, ARITY ** (h + 1)) for h in range(height)]

    def _job(self, h: int, start: int) -> Treehash | None:
        return Treehash(h, start, len(self.leaves)) if start < len(self.leaves) else None

    def _work(self, h: int) -> None:
        job = self.jobs[h]
        node = job.step(self.leaves[job.at])
        if node is not None:
            self.next[h].append(node)
            full = job.end % ARITY ** (h + 1) == 0
            self.jobs[h] = None if full else self._job(h, job.end)

    def held(self) -> int:
        """Nodes held at present."""
        return sum(map(len, self.now)) + sum(map(len, self.next)) + sum(len(j.stack) for j in self.jobs if j)

    def paths(self) -> Iterator[list[tuple[str, str]]]:
        """For each leaf the siblings to its left and to its right, from the lowest level up."""
        for i in range(len(self.leaves)):
            for h in range(self.height):
                run = ARITY ** (h + 1)
                if i and i % run == 0:
                    while self.jobs[h]:  # the schedule has finished it; this holds whatever the shape of the tree
                        self._work(h)
                    self.now[h], self.next[h], self.jobs[h] = self.next[h], [], self._job(h, i + run)
            path = []
            for h in range(self.height):
                k = i // ARITY**h % ARITY
                path.append(("".join(self.now[h][:k]), "".join(self.now[h][k + 1 :])))
            yield path
            for _ in range(self.height):
                low, h = min((j.low(), h) if j else (DONE, h) for h, j in enumerate(self.jobs))
                if low < DONE:
                    self._work(h)


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left, node, right)
    return node


def field(c: Column) -> Column:
    """A value as its number of UTF-8 bytes, a colon and itself; null as a hyphen."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, a row's place from 0 on within its tree by ``order``, and ``n``, the tree's size.

    One range-partitioned sort: a large tree spreads over many partitions, and equal rows are told apart by where they were read. A tree has one count a partition.
    """
    ranged = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(tree, *order, "_read").sortWithinPartitions(tree, *order, "_read").drop("_read")
    now = materialise(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = now.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(tree)
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    runs = runs.select(tree, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    return now.join(runs, [tree, "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def blocks_of(nodes: DataFrame, height: int, *more: str) -> DataFrame:
    """(tree, block, n, hash array, ...): aligned blocks of ``ARITY ** height`` places, in their order."""
    each = F.array_sort(F.collect_list(F.struct("pos", "hash", *more)))
    met = nodes.groupBy("tree", F.floor(F.col("pos") / ARITY**height).alias("block")).agg(F.max("n").alias("n"), each.alias("x"))
    return materialise(met.select("tree", "block", "n", *[F.col(f"x.{c}").alias(c) for c in ("hash", *more)]))


def roots_of(blocks: DataFrame, height: int) -> DataFrame:
    """(tree, pos, n, hash): the blocks' roots, leaves of the next tree up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for b in batches:
            made = []
            for n, leaves in zip(b.column("n").to_pylist(), b.column("hash").to_pylist(), strict=True):
                job = Treehash(min(height, levels(n)), 0, len(leaves))
                for x in leaves:
                    node = job.step(x)
                made.append(node)
            n = pa.array([-(-x // ARITY**height) for x in b.column("n").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("block"), n, pa.array(made, pa.string())], names=["tree", "pos", "n", "hash"])

    return materialise(blocks.select("tree", "block", "n", "hash").mapInArrow(run, "tree string, pos long, n long, hash string"))


def upper_paths(roots: DataFrame, height: int) -> DataFrame:
    """(tree, pos, path, root): for the root of every block its path to the root of its tree."""
    if (roots.agg(F.max("n")).first()[0] or 0) <= 1:
        return roots.select("tree", "pos", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    blocks = blocks_of(roots, height)
    above = upper_paths(roots_of(blocks, height), height).withColumnRenamed("pos", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                shared = [(p["left"], p["right"]) for p in r["path"]]
                paths = [[{"left": x, "right": y} for x, y in [*p, *shared]] for p in Traversal(r["hash"], min(height, levels(r["n"]))).paths()]
                k = len(paths)
                first = r["block"] * ARITY**height
                yield pa.RecordBatch.from_pydict({"tree": [r["tree"]] * k, "pos": list(range(first, first + k)), "path": paths, "root": [r["root"]] * k}, schema=shape)

    shape = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("root", pa.string())])
    return materialise(blocks.join(above, ["tree", "block"]).mapInArrow(run, f"tree string, pos long, path {PATH}, root string"))


def manifest(rows: DataFrame, fields: list[str], id_col: str, source_col: str, altered: DataFrame | None = None, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    A leaf is the digest of ``fields``. Leaves of a source ascend by id, nulls first, equal ids by leaf; sources ascend bytewise, null first.
    ``altered`` is ``rows`` as a reader found them, with the same columns and a column ``_original`` that has the leaf of each as it was; it defaults to ``rows``. What
    is folded along a proof is the leaf of the row as found. Rows without an id or source, repeated rows and null or empty texts are leaves like any others; other columns
    have no say. An empty table gives an empty table.
    """
    found = altered if altered is not None else rows.withColumn("_original", leaf(*map(F.col, fields)))
    now = leaf(*map(F.col, fields))
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    leaves = found.select(source.alias("tree"), F.col(id_col).cast("long").alias("id"), F.col("_original").alias("hash"), F.when(now != F.col("_original"), now).alias("found"))
    blocks = blocks_of(numbered(leaves, "tree", ["id", "hash"]), height, "id", "found")
    lower = upper_paths(roots_of(blocks, height), height).withColumnRenamed("root", "subroot")
    subroots = lower.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("subroot").alias("hash"))
    placed = materialise(numbered(subroots, "tree", ["source"]))
    top = upper_paths(placed.select("tree", "pos", "n", "hash"), height).join(placed.select("pos", "source"), "pos").select("source", "path", "root")
    above = lower.join(top.withColumnsRenamed({"source": "tree", "path": "rest"}), "tree")
    above = materialise(above.select("tree", F.col("pos").alias("block"), "subroot", "root", F.concat("path", "rest").alias("path")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for b in batches:
            for r in b.to_pylist():
                shared, root = [(p["left"], p["right"]) for p in r["path"]], r["root"]
                rest = "".join(x + y for x, y in shared)
                walk = Traversal(r["hash"], min(height, levels(r["n"])))
                whole = fold(walk.root, shared)  # what every leaf that is as it was folds to above its block
                proofs, folded = [], []
                for was, other, path in zip(r["hash"], r["found"], walk.paths(), strict=True):
                    proofs.append(digest(*[x + y for x, y in path], rest))
                    node = fold(was if other is None else other, path)
                    folded.append(whole if node == walk.root else fold(node, shared))
                k = len(proofs)
                yield pa.RecordBatch.from_pydict({"id": r["id"], "leaf": r["hash"], "subroot": [r["subroot"]] * k, "root": [root] * k, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]}, schema=shape)

    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    shape = pa.schema([("id", pa.int64()), *[(c, pa.string()) for c in names], ("verified", pa.bool_())])
    out = blocks.join(above, ["tree", "block"]).mapInArrow(run, f"id long, {', '.join(c + ' string' for c in names)}, verified boolean")
    return out.withColumnRenamed("id", id_col)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered(id_col: Column) -> Column:
    """Whether 2 divides the crc32 of an id's decimal; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all ``documents`` by source, checked against texts of which every second lost its line breaks; see ``manifest`` for nulls, repeated rows and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    bare = F.when(tampered(F.col("doc_id")), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = docs.withColumn("_original", leaf(*map(F.col, FIELDS))).withColumn("text", bare)
    return manifest(docs, FIELDS, "doc_id", "source", found)


_F = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_F.format(c) for c in FIELDS) + ")"
#: crc32 by its definition: eight shifts a byte.
_CRC = """(list_reduce(list_transform(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c))), lambda v: CAST(v AS BIGINT)),
    lambda a, c: list_reduce(list_concat([xor(a, c)], range(8)), lambda s, k: xor(s >> 1, (s & 1) * 3988292384))))"""
_STEP = "sha256(string_agg(hash, '' ORDER BY pos))"
ORACLE_SQL = f"""WITH RECURSIVE doc AS (SELECT *, {_LEAF} AS leaf, coalesce(xor({_CRC}, 4294967295) % 2 = 0, false) AS odd FROM documents),
    found AS (SELECT * REPLACE (CASE WHEN odd THEN replace(text, chr(10), '') ELSE text END AS text) FROM doc),
    lf AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, leaf, {_LEAF} AS now, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM found),
    low(tree, h, pos, n, hash) AS (SELECT tree, 0, pos, n, leaf FROM lf UNION ALL SELECT tree, h + 1, pos // 3, max((n + 2) // 3), {_STEP} FROM low WHERE n > 1 GROUP BY tree, h, pos // 3),
    sub AS (SELECT tree, hash AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
    top(h, pos, n, hash) AS (SELECT 0, pos, n, subroot FROM sub UNION ALL SELECT h + 1, pos // 3, max((n + 2) // 3), {_STEP} FROM top WHERE n > 1 GROUP BY h, pos // 3),
    nodes AS MATERIALIZED (SELECT tree, h, pos // 3 AS run, list(hash ORDER BY pos) AS x, max(n) AS n FROM low WHERE n > 1 GROUP BY ALL UNION ALL SELECT '', h, pos // 3, list(hash ORDER BY pos), max(n) FROM top WHERE n > 1 GROUP BY ALL),
    walk(row, tree, own, h, pos, n, found, proof) AS (SELECT row_number() OVER (), tree, tree, 0, pos, n, now, '' FROM lf
        UNION ALL SELECT w.row, CASE WHEN w.n = 1 THEN '' ELSE w.tree END, own, CASE WHEN w.n = 1 THEN 0 ELSE w.h + 1 END, CASE WHEN w.n = 1 THEN s.pos ELSE w.pos // 3 END, CASE WHEN w.n = 1 THEN s.n ELSE (w.n + 2) // 3 END,
            CASE WHEN w.n = 1 THEN w.found ELSE sha256(array_to_string(x[:w.pos % 3], '') || w.found || array_to_string(x[w.pos % 3 + 2:], '')) END,
            CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || array_to_string(x[:w.pos % 3], '') || array_to_string(x[w.pos % 3 + 2:], '') END
        FROM walk w LEFT JOIN nodes ON nodes.tree = w.tree AND nodes.h = w.h AND nodes.run = w.pos // 3 AND w.n > 1 LEFT JOIN sub s ON s.tree = w.tree WHERE w.n > 1 OR w.tree <> ''),
    done AS (SELECT * FROM walk WHERE tree = '' AND n = 1), rt AS (SELECT hash AS root FROM top WHERE n = 1)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, found AS folded_root, found = root AS verified
    FROM (SELECT *, row_number() OVER () AS row FROM lf) l JOIN done d USING (row) JOIN sub ON sub.tree = l.tree, rt"""
