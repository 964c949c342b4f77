"""Texts cut into words whose token ids follow one another, and the ids that a worker keeps by word.

A byte-level pattern never joins characters across a single space between two characters that aren't white
space: there the next piece begins. So a text's ids are those of its first word and of every further word with the space before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the pattern of byte-level pre-tokenizers, for which the above holds.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker keeps in one generation; it holds two. A memory bound, without effect on results.
KEPT_WORDS = 90_000
#: Fixed value: ASCII marks that the pattern takes in one run; the apostrophe may begin a piece of its own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A place where a text must not be cut: a space beside other white space or at an end.
UNSAFE = re.compile(r" (?:\s|\Z)|(?:\A|\s) ")
#: White space but spaces and line feeds: rare, so most texts are cleared by plain searches.
OTHER_SPACE = re.compile(r"[^\S \n]")


def safe(text: str) -> bool:
    """Whether every space of a text is a place to cut before."""
    if text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text:
        return False
    return not OTHER_SPACE.search(text) or not UNSAFE.search(text)


def chunks(text: str) -> list[str]:
    """Cuts a text before every single space between two characters that aren't white space."""
    parts = text.split(" ")
    out = [parts[0], *[" " + p for p in parts[1:]]]
    if "" in parts or any(p[0].isspace() or p[-1].isspace() for p in parts):
        joined: list[str] = []
        for i, p in enumerate(out):
            whole = i and parts[i] and parts[i - 1] and not parts[i][0].isspace() and not parts[i - 1][-1].isspace()
            if whole or not joined:
                joined.append(p)
            else:
                joined[-1] += p
        return joined
    return out


def cut(text: str | None) -> tuple[str, list[str]]:
    """A text's first word, and the others without the space that stands before each."""
    if not text:
        return "", []
    if safe(text):
        head, *rest = text.split(" ")
        return head, rest
    parts = chunks(text)
    head = "" if parts[0].startswith(" ") else parts.pop(0)
    return head, [p[1:] for p in parts]


class Cut:
    """Texts cut into words: ``heads`` are the first ones, ``words`` all others in order (an Arrow array), text i having those from starts[i] to ends[i]."""

    def __init__(self, texts: list[str | None]):
        plain = [i for i, t in enumerate(texts) if t and safe(t)]
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
        bounds = lists.offsets.to_numpy()
        self.starts, self.ends = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        self.starts[plain], self.ends[plain] = bounds[:-1] + 1, bounds[1:]
        self.heads, more, at = [""] * len(texts), [], int(bounds[-1])
        flat = lists.values
        for i, head in zip(plain, flat.take(pa.array(bounds[:-1])).to_pylist(), strict=True):
            self.heads[i] = head
        special = set(range(len(texts))).difference(plain)
        for i in sorted(special):
            self.heads[i], rest = cut(texts[i])
            self.starts[i], self.ends[i] = at + len(more), at + len(more) + len(rest)
            more += rest
        self.words = pa.concat_arrays([flat, pa.array(more, pa.string())]) if more else flat


class WordIds:
    """Token ids of texts, as bytes, by word. ``many`` gives the ids of a list of distinct pieces; ``given`` has ids by word (after its space) from elsewhere.

    ``whole`` may name strings that aren't pieces' business: a word that holds one goes to ``alone``. Only the distinct words of a batch are
    looked up; Arrow tells them apart and puts their ids in the texts' order.
    """

    def __init__(self, many: Callable[[list[str]], list[bytes]], given: dict[str, bytes] | None = None, whole: tuple[str, ...] = (), alone: Callable[[str], bytes] | None = None, kept: int | None = None):
        self.kept, self.many, self.given, self.whole, self.alone = kept or KEPT_WORDS, many, given or {}, whole, alone
        self.find = regex.compile(BYTE_LEVEL_PATTERN).findall
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of words with what stands before them; each distinct piece is encoded once."""
        special = {}
        if self.whole:
            every = "\n".join(words)
            if any(x in every for x in self.whole):
                special = {w: self.alone(w) for w in words if any(x in w for x in self.whole)}
        split, need, several, find = [], set(), set(), self.find
        for w in words:
            stem = w.rstrip(MARKS)
            if w in special:
                split.append(None)
            elif stem[1:].isalpha() and (stem[0] == " " or stem[0].isalpha()):
                if len(stem) == len(w):
                    split.append(w)
                    need.add(w)
                else:
                    parts = (stem, w[len(stem) :])
                    split.append(parts)
                    several.update(parts)
            else:
                parts = find(w)
                split.append(parts)
                several.update(parts)
        ids = {}
        for p in several:
            # a piece that is a word with its space may be known already
            had = None if p[0] != " " or not p[1:].isalpha() else self.words.get(p[1:]) or self.given.get(p[1:]) or self.old.get(p[1:])
            if had is None:
                need.add(p)
            else:
                ids[p] = had
        left = list(need)
        ids.update(zip(left, self.many(left), strict=True))
        return [ids[ps] if type(ps) is str else special[w] if ps is None else b"".join([ids[p] for p in ps]) for w, ps in zip(words, split, strict=True)]

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of words with the space before them."""
        found = list(map(self.words.get, words))
        new = [i for i, v in enumerate(found) if v is None]
        make = []
        for i in new:
            v = found[i] = self.old.get(words[i]) or self.given.get(words[i])
            if v is None:
                make.append(i)
        for i, v in zip(make, self._ids([" " + words[i] for i in make]), strict=True):
            found[i] = v
        if len(self.words) > self.kept:
            # what no batch of a generation asks for is forgotten
            self.old, self.words = self.words, {}
        self.words.update([(words[i], found[i]) for i in new])
        return found

    def encode(self, texts: list[str | None], tail: bytes = b"") -> list[bytes]:
        """The ids of every text, then ``tail``."""
        parts = Cut(texts)
        coded = parts.words.dictionary_encode()
        ids = pa.array(self.of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        _, places, data = ids.buffers()
        places, data = np.frombuffer(places, dtype=np.int64) if places else np.zeros(1, np.int64), data.to_pybytes() if data else b""
        heads = list({h for h in parts.heads if h})
        first = dict(zip(heads, self._ids(heads), strict=True)) | {"": b""}
        starts, ends = places[parts.starts].tolist(), places[parts.ends].tolist()
        return [first[h] + data[a:b] + tail for h, a, b in zip(parts.heads, starts, ends, strict=True)]
