"""Secret scans: patterns find strong secrets, an interval join links the parts of multipart credentials.

A weak part (an account name, a token of mixed characters, an address) proves nothing
alone. It is reported only where its complement stands within the same scope:
a secret beside an identifier or an endpoint, an identifier beside a secret, an endpoint where
both an identifier and a secret are linked with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sieve
from .spans import by_start, labelled, masked, row_key, with_spans, written

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Parts of multipart credentials that prove nothing alone.
IDENTIFIER = r"""(?i)(?<![a-z0-9])(?:user_?name|user|login|client_?id|account)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9._@-]{3,}+"""
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"
ENDPOINT = r"""(?<![A-Za-z0-9])(?:https?|jdbc:[a-z]++|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]++"""
BASE, WEAK = ["assign", "access", "hex"], ["identifier", "endpoint", "mixed"]
SCOPE = 200


def found(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the arrays of ``BASE`` and ``WEAK`` kinds of (start, end, hit, before, after)."""
    t = F.col(text_col)
    assigns = t.contains("=") | t.contains(":")
    searches = {
        "assign": (ASSIGN, assigns),
        "access": (ACCESS, t.contains("AKIA")),
        "hex": (HEX, t.rlike(r"[0-9a-f]{24}")),
        "identifier": (IDENTIFIER, assigns),
        "endpoint": (ENDPOINT, t.contains("://")),
        "mixed": (MIXED, t.rlike(r"[0-9]")),
    }
    out = with_spans(docs, text_col, searches)
    return out.withColumns(
        {
            "assign": F.filter("assign", lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6),
            "mixed": F.filter("mixed", lambda s: s["hit"].rlike("[A-Z]") & s["hit"].rlike("[a-z]") & s["hit"].rlike("[0-9]")),
        }
    )


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, kind, start, end, role, weak) -> the weak rows whose complement lies within ``scope`` characters of the same text.

    Intervals meet by the buckets of ``scope`` characters that they, widened by ``scope``,
    touch; parts do not overlap within a kind, so a bucket holds a bounded number of them and no pairs of a whole text are made.
    """
    near = lambda a, b: (F.greatest(f"{a}.start", f"{b}.start") - F.least(f"{a}.end", f"{b}.end")) <= scope
    # an interval that is longer than the scope meets others at either of its ends, or inside: it stands in every bucket it touches
    cells = F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))
    wide = F.sequence(F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / scope), F.floor((F.col("end") + scope) / scope))
    secrets = parts.where("role = 'secret'").withColumn("cell", F.explode(wide))
    others = parts.where("role <> 'secret'").withColumn("cell", F.explode(cells))
    met = secrets.alias("a").join(others.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.cell") == F.col("b.cell")) & near("a", "b"))
    pairs = met.select(
        F.col("a.key").alias("key"),
        *[F.col(f"a.{c}").alias(f"s_{c}") for c in ("kind", "start", "end", "weak")],
        *[F.col(f"b.{c}").alias(f"o_{c}") for c in ("kind", "start", "end", "weak", "role")],
    ).distinct()
    secret = pairs.where("s_weak").select("key", F.col("s_kind").alias("kind"), F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    identifier = pairs.where("o_weak and o_role = 'identifier'").select("key", F.col("o_kind").alias("kind"), F.col("o_start").alias("start"), F.col("o_end").alias("end"))
    # an endpoint needs a secret beside it that also has an identifier
    full = pairs.where("o_role = 'identifier'").select("key", "s_kind", "s_start").distinct()
    endpoint = pairs.where("o_role = 'endpoint'").join(full, ["key", "s_kind", "s_start"], "left_semi")
    endpoint = endpoint.select("key", F.col("o_kind").alias("kind"), F.col("o_start").alias("start"), F.col("o_end").alias("end"))
    return secret.union(identifier).union(endpoint).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, base, spans, n_assign, n_access, n_hex), one row per input row.

    ``base`` has the pattern matches by start, ``spans`` also the linked weak parts. A weak
    token that overlaps a base match is not reported beside it; base matches serve as
    complements (an access identifier as identifier, assignments and hex runs as secrets).

    Null and empty texts have no spans; null ids are kept, repeated rows are each returned; an
    empty table gives an empty table. Columns other than the two named are not read.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ends = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    hits = materialise(found(read).select("doc_id", row_key("doc_id", "text").alias("key"), *[ends(k).alias(k) for k in BASE + WEAK]))
    base = labelled(BASE)
    free = F.filter(labelled(WEAK), lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    some = hits.where(F.size("identifier") + F.size("endpoint") + F.size("mixed") > 0)
    role = F.create_map(*[F.lit(x) for kv in {"assign": "secret", "hex": "secret", "mixed": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}.items() for x in kv])
    parts = some.dropDuplicates(["key"]).select("key", F.explode(F.concat(base, free)).alias("p")).select("key", "p.*")
    parts = parts.withColumn("role", role[F.col("kind")]).withColumn("weak", F.col("kind").isin(WEAK))
    reported = linked_parts(parts).groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("weak"))
    out = hits.select("doc_id", "key", by_start(base, BASE).alias("base"), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE]).join(reported, "key", "left")
    spans = by_start(F.concat("base", F.coalesce("weak", F.array().cast("array<struct<kind:string,start:int,end:int>>"))), BASE + WEAK)
    return out.select("doc_id", "key", "base", spans.alias("spans"), *[f"n_{k}" for k in BASE])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with every span of ``scan`` in the text replaced by ``[KIND]``; rows keep their number.

    Only rows that may have spans are shuffled to them. Null texts stay null, an empty table gives an empty table.
    """
    key = F.xxhash64(row_key(id_col, text_col))
    marked = materialise(scan(docs, id_col, text_col).where(F.size("spans") > 0).select(F.xxhash64("key").alias("rk"), "spans").dropDuplicates(["rk"]))
    named = docs.select(F.struct("*").alias("row"), key.alias("rk"))
    maybe, clear = sieve(named, "rk", marked.select(F.col("rk").alias("h")), marked.count())
    with_spans_ = maybe.join(marked, "rk", "left").select("row", "spans", F.col("row")[text_col].alias("text"))
    mask = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(masked("text", "spans", mask))
    return clear.select("row.*").unionByName(with_spans_.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``: counts and digest of the base matches, and all spans. One row per document; see ``scan`` for nulls, ties and empty tables."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
