"""Chat formatting: any known conversation layout to canonical turns and one marked text.

*Layouts.* A table's nested field paths (``messages[].role``) are hashed; the
hash selects a declarative mapping from the layout to canonical turns
``(conv_id, turn, role, text)``. Records that arrive as JSON text in one column,
each in its own layout, are fingerprinted row by row from the field paths of
the parsed value.

*Template.* A turn is ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts
a backslash is doubled and every control string (ours and those of other
common templates) gets a backslash after its first character, so no control
string survives; dropping one backslash from each pair undoes it. The loss mask
is a list of spans (start, length) of the formatted text: each assistant text.

Only DataFrame functions are used. Defined cases: a null text or role is empty;
a null turn sorts first; ties of one turn go by role, then text; repeated rows
are turns of their own; a null conversation id is one conversation; a null or
empty list of messages is a conversation without turns; columns outside the
chosen layout are ignored, also if they are named like our own; an empty table
gives an empty table; a layout that matches no mapping raises ``ValueError``
(JSON records of unknown layout: a conversation without turns, fingerprint kept).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and other public chat templates, as one pattern.
CONTROL = r"(<)(\|)|(\|)(>)|(\[)(/?INST\])|(<)(/?s>)|(<)(</?SYS>>)"
TURNS_TYPE = "array<struct<turn: bigint, role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths and the SQL that turns one record into an array of turns.

    ``rows`` layouts hold one turn per row; their ``turns`` is one turn.
    ``json`` is the type of a JSON record of the layout.
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    json: str
    rows: bool = False

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(turn: str, role: str, text: str) -> str:
    return f"named_struct('turn', cast({turn} as bigint), 'role', {role}, 'text', cast({text} as string))"


def _message_list(column: str, role: str, text: str) -> str:
    return f"transform({column}, (m, i) -> {_turn('i', role, text)})"


USER, ASSISTANT = "'user'", "'assistant'"
#: An instruction and, on a line of its own, its input if it has one.
JOINED = "concat_ws('\\n', instruction, nullif(input, ''))"

#: Layouts in order of preference; extend by adding one.
LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), f"array({_turn('turn', 'cast(role as string)', 'text')})",
           "struct<conv_id: bigint, turn: bigint, role: string, text: string>", rows=True),
    Layout("messages", ("conv_id", "messages[].role", "messages[].content"),
           _message_list("messages", "m.role", "m.content"),
           "struct<conv_id: bigint, messages: array<struct<role: string, content: string>>>"),
    Layout("exchanges", ("conv_id", "conversations[].from", "conversations[].value"),
           _message_list("conversations",
                         "case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end", "m.value"),
           "struct<conv_id: bigint, conversations: array<struct<from: string, value: string>>>"),
    Layout("instruction_input", ("conv_id", "instruction", "input", "output"),
           f"array({_turn('0', USER, JOINED)}, {_turn('1', ASSISTANT, 'output')})",
           "struct<conv_id: bigint, instruction: string, input: string, output: string>"),
    Layout("instruction", ("conv_id", "instruction", "output"),
           f"array({_turn('0', USER, 'instruction')}, {_turn('1', ASSISTANT, 'output')})",
           "struct<conv_id: bigint, instruction: string, output: string>"),
    Layout("prompt", ("conv_id", "prompt", "response"),
           f"array({_turn('0', USER, 'prompt')}, {_turn('1', ASSISTANT, 'response')})",
           "struct<conv_id: bigint, prompt: string, response: string>"),
)


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Leaf paths of a type, lists marked by ``[]``."""
    if isinstance(kind, T.StructType):
        dot = "." if prefix else ""
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}{dot}{f.name}")]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def choose_layout(schema: T.StructType) -> Layout:
    """The layout whose fingerprint the schema has; further columns of the table do not count."""
    paths = set(field_paths(schema))
    by_hash = {layout.fingerprint: layout for layout in LAYOUTS}
    if (exact := by_hash.get(fingerprint(paths))) is not None:
        return exact
    for layout in LAYOUTS:
        if fingerprint(paths & set(layout.paths)) == layout.fingerprint:
            return layout
    raise ValueError(f"no conversation layout is declared for the fields {sorted(paths)}")


def to_turns(records: DataFrame) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text, absent) of a table in any declared layout; a
    conversation without turns is one row that says so in ``absent``, its turn, role and text null."""
    layout = choose_layout(records.schema)
    top = dict.fromkeys(p.split("[")[0].split(".")[0] for p in layout.paths)
    turns = records.select(*top).select(F.col("conv_id").cast("long").alias("conv_id"),
                                        F.expr(layout.turns).alias("turns"))
    if layout.rows:
        return turns.select("conv_id", F.inline("turns"), F.lit(False).alias("absent"))
    return _inlined(turns)


def _inlined(turns: DataFrame) -> DataFrame:
    absent = F.coalesce(F.size("turns"), F.lit(0)) <= 0
    return turns.select("conv_id", absent.alias("absent"), F.inline_outer("turns")).select("conv_id", "turn", "role", "text", "absent")


def _paths_of_json(value: str) -> Column:
    """Field paths of one JSON value, scalar types left out: nested names alone."""
    shape = F.expr(f"schema_of_variant(try_parse_json({value}))")
    return F.regexp_replace(shape, r": (?!OBJECT|ARRAY)[A-Z]+(\(\d+,\d+\))?", "")


def _json_shape(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        inner = sorted((f.name, _json_shape(f.dataType)) for f in kind.fields)
        return "OBJECT<" + ", ".join(n + (f": {s}" if s else "") for n, s in inner) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_json_shape(kind.elementType)}>"
    return ""


def json_to_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """Canonical turns of JSON records whose layouts differ row by row; one pass over the rows."""
    shaped = records.select(F.col(column).alias("record")).withColumn("shape", F.sha2(_paths_of_json("record"), 256))
    conv, turns = F.lit(None).cast("long"), F.lit(None).cast(TURNS_TYPE)
    for layout in reversed(LAYOUTS):
        kind = T._parse_datatype_string(layout.json)
        shape = hashlib.sha256(_json_shape(kind).encode()).hexdigest()
        names = [f.name for f in kind.fields]
        own = f"from_json(record, '{layout.json}')"
        body = layout.turns
        for name in names:  # the mapping reads the record's own fields
            body = _qualified(body, name)
        conv = F.when(F.col("shape") == shape, F.expr(f"{own}.conv_id")).otherwise(conv)
        turns = F.when(F.col("shape") == shape, F.expr(f"transform(array({own}), r -> {body})[0]")).otherwise(turns)
    return _inlined(shaped.select(conv.alias("conv_id"), turns.alias("turns")))


def _qualified(body: str, name: str) -> str:
    return re.sub(rf"(?<![\w.'])\b{name}\b(?!')", f"r.{name}", body)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3$5$7$9\\$2$4$6$8$10")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length in code points)."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    w = Window.partitionBy("conv_id").orderBy(*order)
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    absent = F.col("absent") if "absent" in turns.columns else F.lit(False)
    marked = (
        turns.select("conv_id", "turn", "role", "text",
                     F.when(absent, "").otherwise(F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END))).alias("piece"),
                     F.char_length(text).alias("length"))
        .select("conv_id", F.row_number().over(w).alias("place"), "piece", "length",
                (F.col("role") == "assistant").alias("learned"),
                F.sum(F.char_length("piece")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("until"))
    )
    return marked.groupBy("conv_id").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))),
                                    lambda x: x["piece"])).alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("learned"), F.struct(
            (F.col("until") - len(END) - F.col("length")).alias("start"),
            F.col("length").cast("long").alias("length"))))).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learned text, parsed from formatted texts and their loss spans alone."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(F.split_part(p, F.lit(TEXT), F.lit(1))).alias("role"),
        unescape(F.split_part(F.split_part(p, F.lit(TEXT), F.lit(2)), F.lit(END), F.lit(1))).alias("text")))
    learned = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substring(
        F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))


def format_digests(turns: DataFrame) -> DataFrame:
    back = read_back(format_turns(turns))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.sql(
        "SELECT -7L AS conv_id, array(named_struct('role', 'user', 'content', :said), "
        "named_struct('role', 'assistant', 'content', :said)) AS messages", args={"said": said})
    rows = table(spark, sf_dir, "conversations")
    return format_digests(to_turns(rows).unionByName(to_turns(added)))


#: The escaped length of a text grows by one for each backslash and each control string.
OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    length(role) + length(text)
    + len(regexp_extract_all(role || chr(0) || text, '\\|<\||\|>|\[/?INST\]|</?s>|<</?SYS>>'))
    + length('<|turn|><|text|><|end|>') AS size
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
