"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus's words are counted, and the merges are replayed over the distinct ones: their pieces (pattern matches) are
laid out in one sequence of symbols. An inverted index leads from each mergeable pair's rank to the positions where the
pair stands. Ranks are taken in order from a heap; each is applied to all its
positions, left to right, and only the two neighbours of a merged position are looked at again.
Pieces never touch, so every piece goes through the merges that it would go through alone. Frequent words are
replayed once and given to all tasks; a rare one is replayed by the workers that meet it, together with all others that are new to them.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, text_batches, worker_table
from .words import BYTE_LEVEL_PATTERN, Cut, WordIds

#: Bytes of new pieces replayed at once, and distinct words that a task counts before it sends them on: bounds of memory, without effect on results.
REPLAY_BYTES, WINDOW = 64_000, 200_000
#: Words that all tasks are given, how long these may be, and how often a window must meet them. Also without effect on results.
FREQUENT, LONGEST, LEAST = 40_000, 64, 4
#: Words whose ids a worker keeps in one generation, fewer than usual as the rank table needs room too.
KEPT = 50_000


class MergeReplay:
    """Encodes pieces of bytes with a rank table; the rank of a token is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.token[v] = k
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        n = self.stride = len(self.token)
        #: Rank of every pair of tokens whose concatenation is a token.
        self.pair = {x * n + y: r for k, r in ranks.items() for i in range(1, len(k)) if (x := ranks.get(k[:i])) is not None and (y := ranks.get(k[i:])) is not None}
        self.bytes = np.array([[self.pair.get(int(x) * n + int(y), -1) for y in self.single] for x in self.single])

    @classmethod
    def from_file(cls, path: str) -> MergeReplay:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        full = [p for p in pieces if p]
        if not full:
            return [b""] * len(pieces)
        codes = np.frombuffer(b"".join(full), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in full])
        n, rank, stride = len(codes), self.pair.get, self.stride
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1], prv[np.append(0, ends[:-1])] = -1, -1
        ranks = np.append(self.bytes[codes[:-1], codes[1:]], -1)
        ranks[ends - 1] = -1
        # the inverted index: rank of a pair of neighbours -> positions of its first half
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        found, first = np.unique(ranks[at], return_index=True)
        index = {r: places.tolist() for r, places in zip(found.tolist(), np.split(at, first[1:]), strict=False)}
        sym, nxt, prv, pair = self.single[codes].tolist(), nxt.tolist(), prv.tolist(), ranks.tolist()
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            left_of = r * stride
            late: list[int] = []
            until = -1  # a merge made a lower rank in the piece that ends here: its further positions wait
            for i in places:
                if pair[i] != r:
                    continue
                if i < until:
                    late.append(i)
                    continue
                j, h = nxt[i], prv[i]
                k = nxt[j]
                sym[i], sym[j], pair[j], nxt[i] = r, -1, -1, k
                least = r
                if k >= 0:
                    prv[k] = i
                    x = pair[i] = rank(left_of + sym[k], -1)
                    if x in index:
                        index[x].append(i)
                    elif x == r:
                        late.append(i)
                    elif x >= 0:
                        index[x] = [i]
                        heappush(heap, x)
                    if 0 <= x < least:
                        least = x
                else:
                    pair[i] = -1
                if h >= 0:
                    x = pair[h] = rank(sym[h] * stride + r, -1)
                    if x in index:
                        index[x].append(h)
                    elif x == r:
                        late.append(h)
                    elif x >= 0:
                        index[x] = [h]
                        heappush(heap, x)
                    if 0 <= x < least:
                        least = x
                if least < r:
                    end = k if k >= 0 else j
                    while nxt[end] >= 0:
                        end = nxt[end]
                    until = end + 1
            if late:
                index[r] = late
                heappush(heap, r)
        ids = np.array(sym, dtype="<i4")
        left = ids >= 0
        stops = (np.cumsum(left)[ends - 1] * 4).tolist()
        buffer, out, start = ids[left].tobytes(), [], 0
        of = iter(stops)
        for p in pieces:
            stop = next(of) if p else start
            out.append(buffer[start:stop])
            start = stop
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def replay_of(rank_file: str) -> MergeReplay:
    """The worker's rank table of a file."""
    return worker_table(("bpe", rank_file), lambda: {"replay": MergeReplay.from_file(rank_file)})["replay"]


def _many(replay: MergeReplay):
    def many(pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces; as many are laid out at once as fit into a processor's cache."""
        out, part, size = [], [], 0
        for p in pieces:
            part.append(p.encode("utf-8", "surrogatepass"))
            size += len(part[-1])
            if size >= REPLAY_BYTES:
                out += replay.encode(part)
                part, size = [], 0
        return out + replay.encode(part)

    return many


def vocabulary(docs: DataFrame, rank_file: str, text_col: str = "text") -> dict[str, bytes]:
    """Ids by word (what follows a space) for the corpus's ``FREQUENT`` most frequent words: each is replayed once for all tasks.

    Words are counted over all texts, in windows of as many distinct words as a task may hold; what a window meets less than ``LEAST`` times
    isn't sent on, for it can't be among the frequent ones of a large corpus. The table only saves work: a task replays the words it lacks.
    At most ``FREQUENT`` words of ``LONGEST`` characters reach the driver.
    """

    def count(batches):
        seen: Counter = Counter()

        def often():
            kept = [(w, n) for w, n in seen.items() if n >= LEAST and len(w) <= LONGEST]
            if kept:
                yield pd.DataFrame(kept, columns=["word", "n"])

        for b in batches:
            for part in small_batches(b, "text"):
                counts = Cut(part["text"].tolist()).words.value_counts()
                for word, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist(), strict=True):
                    seen[word] += n
                if len(seen) > WINDOW:
                    yield from often()
                    seen.clear()
        yield from often()

    def replayed(batches):
        ids = WordIds(_many(replay_of(rank_file)))
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "ids": ids.of_words(b["word"].tolist())})

    counts = text_batches(docs).select(F.col(text_col).cast("string").alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = materialise(counts.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word"))
    made = frequent.repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInPandas(replayed, "word string, ids binary")
    out = {r.word: bytes(r.ids) for r in made.collect()}
    discard(frequent)
    return out


def encoder(rank_file: str, pattern: str, given: dict[str, bytes]):
    """A function from a list of texts to their ids as bytes; its tables stay with the worker."""
    replay = replay_of(rank_file)
    if pattern != BYTE_LEVEL_PATTERN:
        find, many = regex.compile(pattern).findall, _many(replay)

        def by_pattern(texts):
            split = [find(t) if t else [] for t in texts]
            need = list({p for ps in split for p in ps})
            ids = dict(zip(need, many(need), strict=True))
            return [b"".join([ids[p] for p in ps]) for ps in split]

        return by_pattern
    kept = worker_table(("bpe", rank_file), dict)
    if "words" not in kept or kept["words"].given is not given:
        kept["words"] = WordIds(_many(replay), given, kept=KEPT)
    return kept["words"].encode


def small_batches(b: pd.DataFrame, column: str, chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Cuts a batch so that each part has about so many characters at most, one row at least."""
    sizes = b[column].map(lambda x: len(x) if x else 0).to_numpy().cumsum()
    if len(b):
        for _, rows in b.groupby(sizes // chars, sort=True):
            yield rows


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` (array<int>) to every row; null and empty texts give an empty array.

    All other columns pass through unchanged (a column named ``ids`` is replaced). Texts aren't shuffled. Frequent words come
    from ``vocabulary``; the others are replayed where they occur, by the same merges.
    """
    given = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, rank_file, text_col))
    shape = docs.drop("ids").withColumn("ids", F.array().cast("array<int>")).schema

    def run(batches):
        encoded = encoder(rank_file, pattern, given.value)
        for b in batches:
            for part in small_batches(b, text_col):
                yield part.assign(ids=[np.frombuffer(x, dtype="<i4") for x in encoded(part[text_col].tolist())])

    return docs.drop("ids").mapInPandas(run, shape)


def decode(encoded: DataFrame, rank_file: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``bytes`` (binary): the concatenated bytes of the tokens; null ids give null."""
    shape = encoded.drop("bytes").withColumn("bytes", F.lit(b"")).schema

    def run(batches):
        replay = replay_of(rank_file)
        for b in batches:
            yield b.assign(bytes=[None if x is None else replay.decode(x) for x in b[ids_col]])

    return encoded.drop("bytes").mapInPandas(run, shape)


def digests(docs: DataFrame, rank_file: str, pattern: str, keep: list[str], text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The columns ``keep``, n_tokens, ids_sha256 and decoded_sha256 of every row's encoding and of what its ids decode to, and the ids if asked for.

    The same encoding and decoding as ``encode`` and ``decode``, in one pass over each batch, so that ids needn't leave the task.
    """
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    sha = lambda x: hashlib.sha256(x).hexdigest()

    given = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, rank_file, text_col))

    def run(batches):
        encoded, replay = encoder(rank_file, pattern, given.value), replay_of(rank_file)
        for b in batches:
            for part in small_batches(b, text_col):
                ids = encoded(part[text_col].tolist())
                more = {"ids": [np.frombuffer(x, dtype="<i4") for x in ids]} if with_ids else {}
                yield part[keep].assign(
                    n_tokens=[len(x) // 4 for x in ids],
                    ids_sha256=[sha(x) for x in ids],
                    decoded_sha256=[sha(replay.decode(np.frombuffer(x, dtype="<u4").tolist())) for x in ids],
                    **more,
                )

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInPandas(run, shape)


def op6_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every whole text of ``documents``; a null text has no ids. One row per document, an empty table gives none."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
