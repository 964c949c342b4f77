"""Chat formatting by schema fingerprints.

Records are JSON. A record's fingerprint is a hash of its nested field paths, whatever
their values are; a registry of declarative mappings, keyed by fingerprint, says how a layout's
fields become canonical turns (role, text). The turns are then written in one template:

    <|im_start|>role<|im_sep|>text<|im_end|>

Roles and texts are escaped: a backslash is doubled, and one is put after the first character of
every control string, so none of them occurs in what a text contributes. Taking away one backslash of
each pair, and the single ones, gives the text back.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a record without its string values from which its schema can't be told: it is an error then, never a record without turns.
MOST_FIELDS = 100_000_000
TURNS = "array<struct<role:string,text:string>>"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings with a meaning in this or other templates; the first covers all of this one's.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

_LIST = "transform(coalesce({f}, array()), m -> struct(coalesce(m.{role}, '') AS role, coalesce(m.{text}, '') AS text))"
_ROLES = "transform({x}, m -> struct(CASE m.role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.role END AS role, m.text AS text))"
_SYSTEM = "concat(if(coalesce(r.{system}, '') = '', array(), array(struct('system' AS role, r.{system} AS text))), {rest})"
_PAIR = "array(struct('user' AS role, coalesce(r.{ask}, '') AS text), struct('assistant' AS role, coalesce(r.{answer}, '') AS text))"
_ALPACA = "array(struct('user' AS role, concat(coalesce(r.instruction, ''), if(coalesce(r.input, '') = '', '', concat('\\n\\n', r.input))) AS text), struct('assistant' AS role, coalesce(r.output, '') AS text))"

#: Layout: (field paths, optional ones, Spark type of the record, expression over r that gives the turns). One entry a layout.
MAPPINGS: dict[str, tuple[list[str], list[str], str, str]] = {
    "turn_rows": (["turns[].role", "turns[].text"], ["turns[].turn"], "turns array<struct<turn:bigint,role:string,text:string>>", _LIST.format(f="r.turns", role="role", text="text")),
    "messages": (["messages[].role", "messages[].content"], [], "messages array<struct<role:string,content:string>>", _LIST.format(f="r.messages", role="role", text="content")),
    "share_gpt": (["conversations[].from", "conversations[].value"], ["system"], "system string, conversations array<struct<`from`:string,value:string>>", _SYSTEM.format(system="system", rest=_ROLES.format(x=_LIST.format(f="r.conversations", role="`from`", text="value")))),
    "instruction": (["instruction", "output"], ["input", "system"], "instruction string, input string, output string, system string", _SYSTEM.format(system="system", rest=_ALPACA)),
    "prompt_completion": (["prompt", "completion"], ["system"], "prompt string, completion string, system string", _SYSTEM.format(system="system", rest=_PAIR.format(ask="prompt", answer="completion"))),
    "prompt_response": (["prompt", "response"], ["system"], "prompt string, response string, system string", _SYSTEM.format(system="system", rest=_PAIR.format(ask="prompt", answer="response"))),
    "question_answer": (["question", "answer"], [], "question string, answer string", _PAIR.format(ask="question", answer="answer")),
    "text_only": (["text"], [], "text string", "array(struct('assistant' AS role, coalesce(r.text, '') AS text))"),
}


def schema_text(paths: list[str]) -> str:
    """The field paths in the form that ``fingerprint`` hashes: objects with sorted keys, leaves without types."""
    tree: dict = {}
    for p in paths:
        node = tree
        for part in p.split("."):
            node = node.setdefault(part, {})

    def write(node: dict) -> str:
        out = []
        for k in sorted(node, key=lambda x: x.removesuffix("[]")):
            inner = f"OBJECT<{write(node[k])}>" if node[k] else "_"
            out.append(f"{k.removesuffix('[]')}: " + (f"ARRAY<{inner}>" if k.endswith("[]") else inner))
        return ", ".join(out)

    return f"OBJECT<{write(tree)}>"


def fingerprint(record: Column) -> Column:
    """SHA-256 of a JSON record's nested field paths; null for what isn't JSON. Types of leaves don't matter, a null is a leaf.

    String values are emptied first, so the length of a text can't decide its layout.
    """
    plain = F.replace(F.replace(record, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    bare = F.regexp_replace(plain, r'"([^"]*+)"(\s*+:)|"[^"]*+"', '"$1"$2')
    too_long = F.raise_error(F.lit("a record's fields alone are too long for a fingerprint")).cast("string")
    schema = F.schema_of_variant(F.try_parse_json(F.when(F.length(bare) < MOST_FIELDS, bare).otherwise(F.when(record.isNotNull(), too_long))))
    return F.sha2(F.regexp_replace(schema, r"(?<=[:<] ?)(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DECIMAL\([0-9]+,[0-9]+\)|VARIANT|DATE|TIMESTAMP(?:_NTZ)?|BINARY|INT|SMALLINT|TINYINT)(?=[,>]|$)", "_"), 256)


def _registry() -> dict[str, str]:
    """Fingerprint -> layout, for each layout with every choice of its optional paths, and with an empty list of turns."""
    forms = []
    for name, (need, maybe, _, _) in MAPPINGS.items():
        for bits in range(1 << len(maybe)):
            extra = [p for i, p in enumerate(maybe) if bits >> i & 1]
            forms.append((name, schema_text(need + extra)))
            lists = {p.split("[]")[0] for p in need if "[]" in p}
            if lists:
                plain = sorted(lists | {p for p in extra if "[]" not in p})
                forms.append((name, "OBJECT<" + ", ".join(f"{p}: " + ("ARRAY<_>" if p in lists else "_") for p in plain) + ">"))
    return {hashlib.sha256(f.encode()).hexdigest(): name for name, f in forms}


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Adds ``layout`` and ``turns`` (array of role, text) to rows with a JSON record.

    Null texts become empty, null roles empty; a record whose fingerprint isn't registered, a null and what
    isn't JSON get layout null and no turns. Existing columns of these names are replaced; all others stay.
    """
    names = _registry()
    chosen = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[fingerprint(F.col(record_col))]
    out = records.drop("layout", "turns").withColumn("layout", chosen)
    turns = F.lit(None).cast(TURNS)
    for name, (_, _, kind, expression) in MAPPINGS.items():
        # an array of the one record, so that the expression can name it
        mapped = F.expr(f"transform(array(from_json({record_col}, '{kind}', map('maxStringLen', '{2**31 - 1}'))), r -> {expression})[0]").cast(TURNS)
        turns = F.when(F.col("layout") == name, mapped).otherwise(turns)
    return out.withColumn("turns", F.coalesce(turns, F.array().cast(TURNS)))


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``segments`` to rows with ``turns``.

    ``segments`` (text, loss) are the formatted text in order, joined without anything between; their flags are
    the loss mask: true for the (escaped) text of the trained role's turns, false for all else. No turns give an empty text.
    """

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP))
        one = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(one(head, F.lit(False)), one(escaped(t["text"]), t["role"] == trained_role), one(F.lit(END), F.lit(False)))

    out = turns.withColumn("segments", F.flatten(F.transform("turns", parts)))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(rows: DataFrame) -> DataFrame:
    """Adds ``read_turns``, parsed from ``formatted`` alone, and ``loss_text``, the unescaped text under the mask of ``segments``."""
    bodies = F.filter(F.split("formatted", r"<\|im_end\|>", -1), lambda x: x != "")

    def one(x: Column) -> Column:
        halves = F.split(F.substring(x, F.lit(len(START) + 1), F.length(x)), r"<\|im_sep\|>", -1)
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(halves[1]).alias("text"))

    under = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return rows.withColumn("read_turns", F.transform(bodies, one)).withColumn("loss_text", F.array_join(under, ""))


def records_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, record): one JSON record in the turn_rows layout for each conversation of a table with a row for each turn.

    Rows are ordered by turn, then role and text (nulls first); null roles and texts become empty, repeated rows stay, rows with a null id form one conversation. Other columns are not read.
    """
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    return grouped.select("conv_id", F.to_json(F.struct("turns"), {"ignoreNullFields": "false"}).alias("record"))


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    """Turns, loss text and length of every conversation's formatted text, read back from it; see ``records_of`` for nulls, ties and repeated rows. An empty table gives the fixed conversation alone."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = read_back(formatted(canonical_turns(records_of(given.union(own)))))
    lines = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum({len(START + SEP + END)} + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS formatted_chars
      FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
