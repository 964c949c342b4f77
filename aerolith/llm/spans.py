"""Character spans of pattern matches, with DataFrame functions only.

``split`` gives the pieces between the matches and ``regexp_extract_all`` the matches;
their lengths, added up, are the spans. Both walk the text once, left to right, without
overlaps, as a search does that goes on after each match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"


def with_spans(df: DataFrame, text: str, searches: dict[str, tuple[str, Column]], context: int = 0) -> DataFrame:
    """Adds, for each name, an array of (start, end, hit, before, after): code points, end exclusive.

    ``searches`` has a pattern by name, and a cheap condition without which a text can't
    match: the pattern runs only where that holds. Patterns use possessive quantifiers and
    look-behind so that long runs neither recurse nor restart. ``before`` and ``after`` hold up to
    ``context`` characters of what lies between the match and its neighbours. A null text gives empty arrays.
    """
    names = list(searches)
    # hits and gaps are read twice each: as columns of their own they are computed once
    df = df.withColumns({f"_m_{n}": F.coalesce(maybe, F.lit(False)) for n, (_, maybe) in searches.items()})
    df = df.withColumns(
        {f"_h_{n}": F.when(F.col(f"_m_{n}"), F.regexp_extract_all(text, F.lit(p), F.lit(0))) for n, (p, _) in searches.items()}
        | {f"_g_{n}": F.when(F.col(f"_m_{n}"), F.split(text, p, -1)) for n, (p, _) in searches.items()}
    )
    df = df.withColumns({f"_s_{n}": _starts(F.col(f"_h_{n}"), F.col(f"_g_{n}")) for n in names})
    return df.withColumns({n: F.coalesce(_spans(n, context), F.array().cast(SPAN)) for n in names}).drop(*[f"_{x}_{n}" for x in "mhgs" for n in names])


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: within lambda functions an expression is computed wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _within(piece: Column) -> Column:
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    return F.aggregate(piece, zero, step, lambda acc: acc["out"])


def _running(values: Column) -> Column:
    """The sums of an array of integers up to each of its elements.

    Arrays can only be copied, not appended to: so sums run within pieces of about the square root of the array's length, and then over the pieces.
    """
    def cut(v: Column) -> Column:
        k = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return _let(k, lambda k: F.transform(F.sequence(F.lit(1), F.size(v), k), lambda o: _within(F.slice(v, o, k))))

    def shifted(pieces: Column) -> Column:
        before = _within(F.transform(pieces, lambda p: F.element_at(p, -1)))
        return _let(before, lambda b: F.flatten(F.transform(pieces, lambda p, i: _let(F.coalesce(F.get(b, i - 1), F.lit(0)), lambda off: F.transform(p, lambda x: x + off)))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(cut(v), shifted)).otherwise(F.array().cast("array<int>")))


def _starts(hits: Column, gaps: Column) -> Column:
    both = F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
    return F.when(F.size(hits) > 0, _let(_running(both), lambda ends: F.transform(hits, lambda h, i: F.get(ends, i) - F.length(h))))


def _spans(n: str, context: int) -> Column:
    hits, gaps = F.col(f"_h_{n}"), F.col(f"_g_{n}")

    def one(hit: Column, i: Column) -> Column:
        start = F.get(F.col(f"_s_{n}"), i)
        beside = (F.right(F.get(gaps, i), F.lit(context)), F.left(F.get(gaps, i + 1), F.lit(context))) if context else (F.lit(""), F.lit(""))
        return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"), beside[0].alias("before"), beside[1].alias("after"))

    return F.when(F.size(hits) > 0, F.transform(hits, one))


def labelled(kinds: list[str]) -> Column:
    """One array of (kind, start, end) over the arrays named ``kinds``, by kind as listed, then start."""

    def named(k: str) -> Column:
        return F.transform(F.col(k), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*map(named, kinds))


def by_start(spans: Column, kinds: list[str]) -> Column:
    """(kind, start, end) sorted by start, then by kind as listed, then end."""
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), order[s["kind"]].alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and its text; repeated rows share it, and what is found in them."""
    return F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("h"), F.coalesce(F.length(text_col), F.lit(-1)).alias("n"))


def masked(text: str, spans: str, mask: Column) -> Column:
    """The text with every (kind, start, end) of ``spans`` replaced by ``mask`` of it; of overlapping spans the first, longest one counts.

    ``mask`` is a function of the span.
    """
    order = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("rest"), s.alias("s"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"])
        return F.when(x["start"] < acc["at"], acc).otherwise(
            F.struct(x["s"]["end"].alias("at"), F.concat(acc["out"], F.array(kept, mask(x["s"]))).alias("out"))
        )

    return F.aggregate(order, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(text))))
