"""Personal data: patterns find protected entities, corpus co-occurrence finds the terms that reveal them.

A term discloses an entity as far as its pointwise mutual information with it
comes near the entity's information content: with N documents, PMI(t; e) =
log2(c(t,e) N / (df(t) n(e))) and IC(e) = log2(N / n(e)); disclosure is PMI / IC. It
is 1 where the term stands in documents of that entity alone. df(t), n(e) and c(t,e) count the documents
of the whole corpus that hold the term, the entity, and both, wherever in the text these stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .spans import labelled, masked, row_key, with_spans, written

#: The base patterns, written so that no run is scanned twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
#: A word of context: letters alone, not part of an address or a number.
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{4,}+(?![\p{N}@_%+-]|\.\p{L})"
MIN_DOCS, DISCLOSES, REMOVES = 2, 0.9, 0.97


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2).cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def found(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the arrays email, ip, card and phone of (start, end, hit) that pass their checks."""
    t = F.col(text_col)
    searches = {
        "email": (EMAIL, t.contains("@")),
        "ip": (IP, t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        "card": (CARD, t.rlike(r"(?:[0-9][\x20-]?){15}[0-9]")),
        "phone": (PHONE, t.contains("+")),
    }
    checks = {
        "ip": lambda s: F.forall(F.split(s["hit"], r"\."), _small),
        "card": lambda s: F.when(F.length(F.regexp_replace(s["hit"], "[^0-9]", "")).between(16, 19), _luhn(F.regexp_replace(s["hit"], "[^0-9]", ""))).otherwise(False),
        "phone": lambda s: F.length(F.regexp_replace(s["hit"], "[^0-9]", "")).between(8, 15),
    }
    return with_spans(docs, text_col, searches).withColumns({k: F.filter(k, f) for k, f in checks.items()})


def terms_of(text: Column) -> Column:
    """The different terms of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosing(holders: DataFrame, docs: DataFrame, n_docs: int) -> DataFrame:
    """(row, term, disclosure): which terms of a row disclose an entity that it holds, at or over ``DISCLOSES``.

    ``holders`` has (row, entities, terms) of the rows that hold some, ``docs`` all texts. Terms and entities have ``MIN_DOCS`` documents or more in
    common. A term in too many documents for any entity that it could disclose is left out before it is paired: c is at most n, so a
    disclosure of d needs df <= n (N / n) ** (1 - d).
    """
    n = F.lit(float(n_docs))
    most = lambda k: k * F.pow(n / k, F.lit(1 - DISCLOSES)) * (1 + 1e-9)
    named = holders.select("row", F.explode_outer("entities").alias("entity"))
    entities = materialise(named.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= MIN_DOCS) & (F.col("n") < n)))
    largest = entities.agg(F.max(most(F.col("n")))).first()[0] or 0.0
    own = holders.select("row", F.explode_outer("terms").alias("term")).where("term is not null")
    df = docs.select(F.explode_outer(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = materialise(df.where((F.col("df") >= MIN_DOCS) & (F.col("df") <= largest)).join(own.select("term").distinct(), "term", "left_semi"))
    pairs = materialise(named.join(entities, "entity").join(own.join(rare, "term"), "row").where(F.col("df") <= most(F.col("n"))))
    counted = pairs.groupBy("entity", "term", "n", "df").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= MIN_DOCS)
    share = F.log2(F.col("c") * n / (F.col("df") * F.col("n"))) / F.log2(n / F.col("n"))
    marks = materialise(counted.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= DISCLOSES))
    return pairs.select("row", "entity", "term").join(marks, ["entity", "term"]).groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, base, spans, terms, n_email, n_ip, n_card, n_phone), one row per input row.

    ``base`` has the pattern matches, ``spans`` also those of disclosing terms (kind ``term``, by kind, then start), ``terms`` (start, end, removed)
    says which of these are removed and which generalised. A term is marked wherever it stands in a text that holds the entity which it discloses, so texts without
    personal data stay as they are.

    Null and empty texts have no spans; null ids are kept, repeated rows are each returned and counted; an
    empty table gives an empty table. Columns other than the two named are not read.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = lambda k: F.transform(F.col(k), lambda s: F.concat(F.lit(f"{k}:"), F.lower(s["hit"])))
    entities = F.array_distinct(F.concat(*map(named, KINDS)))
    has = F.size(F.concat(*[F.transform(F.col(k), lambda s: s["start"]) for k in KINDS])) > 0
    hits = found(read).select("doc_id", row_key("doc_id", "text").alias("key"), "text", *KINDS)
    # what holds an entity keeps its text: these rows need it again
    hits = materialise(hits.select("doc_id", "key", *KINDS, F.when(has, F.col("text")).alias("text")))
    terms = _disclosing_spans(hits.where("text is not null").select("key", "text", entities.alias("entities")), read, max(hits.count(), 1))
    flat = hits.select("doc_id", "key", labelled(KINDS).alias("base"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS])
    joined = flat.join(terms, "key", "left")
    more = F.transform(F.col("terms"), lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    spans = F.concat("base", F.coalesce(more, F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    return joined.select("doc_id", "key", "base", spans.alias("spans"), F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,removed:boolean>>")).alias("terms"), *[f"n_{k}" for k in KINDS])


def _disclosing_spans(rows: DataFrame, read: DataFrame, n_docs: int) -> DataFrame:
    holders = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "key", "text", "entities", terms_of(F.col("text")).alias("terms")))
    marks = disclosing(holders.select("row", "entities", "terms"), read, n_docs)
    of_row = marks.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("d"))
    marked = holders.select("row", "key", "text").join(of_row, "row").dropDuplicates(["key"])
    at = with_spans(marked, "text", {"w": (TERM, F.lit(True))}).select("key", F.explode_outer("w").alias("w"), "d")
    spans = at.select("key", "w.start", "w.end", F.col("d")[F.lower("w.hit")].alias("d")).where("d is not null")
    one = F.struct("start", "end", (F.col("d") >= REMOVES).alias("removed"))
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("terms"))


def sanitised_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans, sanitised): the texts with their spans masked. See ``sanitise``."""
    marked = sanitise(docs, id_col, text_col).select("key", "spans", "terms").dropDuplicates(["key"])
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = read.withColumn("key", row_key("doc_id", "text")).join(marked, "key", "left")

    def mask(s: Column) -> Column:
        removed = F.exists(F.col("terms"), lambda t: (t["start"] == s["start"]) & t["removed"])
        first = F.substring(F.col("text"), s["start"] + 1, F.lit(1))
        return F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(removed, F.lit("[TERM]")).otherwise(F.concat(first, F.lit("*")))

    return both.select("doc_id", "text", "spans", masked("text", "spans", mask).alias("sanitised"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``: counts and digest of the base matches, and all spans. One row per document; see ``sanitise`` for nulls, repeated rows and empty tables."""
    out = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
