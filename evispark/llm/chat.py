"""Chat formatting: heterogeneous records become canonical turns and one templated text with a loss mask.

A record is a JSON text. The nested field paths of its layout are hashed to a fingerprint, and the fingerprint selects
a declarative mapping: where the turns are and which fields hold role and text. The template marks turns and
escapes control strings inside texts, so that a text can never open or close a turn and everything can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Strings that chat templates use to control a model. In a text their first character is replaced.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: How the escape character and the characters at the start of a control string are written.
CODES = [("\\", "\\-"), ("<", "\\l"), ("[", "\\b")]

#: Characters of a layout that surely fit in a variant.
MOST_SKELETON = 8 << 20

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths of a record (a JSON example shows them) and the turns made of it.

    ``many`` names a list field with the fields of role and text in it; ``single`` lists (role, field) of turns that
    records of one exchange hold in fields of their own. Absent or null fields of ``single`` give no turn.
    """

    name: str
    example: str
    many: tuple[str, str, str] | None = None
    single: tuple[tuple[str, str], ...] = ()
    #: Names of roles in the records and here.
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = [
    Layout("turns", '{"turns":[{"role":"","text":""}]}', many=("turns", "role", "text")),
    Layout("messages", '{"messages":[{"role":"","content":""}]}', many=("messages", "role", "content")),
    Layout(
        "from_value", '{"conversations":[{"from":"","value":""}]}', many=("conversations", "from", "value"),
        roles=(("human", "user"), ("gpt", "assistant")),
    ),
    Layout("prompt", '{"prompt":"","completion":""}', single=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", '{"prompt":"","response":""}', single=(("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", '{"instruction":"","output":""}', single=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", '{"instruction":"","input":"","output":""}', single=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system_prompt", '{"system":"","prompt":"","response":""}', single=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
]


def skeleton(record: Column) -> Column:
    """A JSON text with all string values emptied, which leaves its layout however long the texts are.

    Escaped backslashes and quotes go first; the quotes that are left enclose strings. One before a colon is a name.
    Of equal flat objects in a row within a list one stays, so a list of turns is as short as its distinct layouts.
    """
    bare = F.replace(F.replace(record, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    empty = F.regexp_replace(bare, r'"(?:([^"]*+)"(\s*+:)|[^"]*+")', '"$1"$2')
    tight = F.regexp_replace(empty, r"[ \t\r\n]*+([{}\[\],:])[ \t\r\n]*+", "$1")
    return F.regexp_replace(tight, r"(?<=[\[,])(\{[^{}\[\]]*+\}),(?=\1)", "")


def field_paths(record: Column) -> Column:
    """The nested field names of a JSON text in sorted order, without the types of the values; null if it is no JSON.

    A skeleton that cannot be parsed and is so large that its size may be why is an error.
    """
    bare = skeleton(record)
    too_large = F.raise_error(F.lit(f"record cannot be read: its layout has over {MOST_SKELETON} characters")).cast("string")
    parsed = F.schema_of_variant(F.try_parse_json(bare))
    shape = F.coalesce(parsed, F.when(F.length(bare) > MOST_SKELETON, too_large))
    return F.regexp_replace(shape, r": (?!OBJECT<|ARRAY<OBJECT<)[A-Z]+(\([0-9, ]*\))?(<[A-Z]*(\([0-9, ]*\))?>)?", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def canonical_turns(record: Column, layouts: list[Layout] = LAYOUTS) -> Column:
    """The turns of a JSON record by the layout its fingerprint names; null for an unknown layout.

    A list that is empty gives no turns whatever its name. Null roles and texts are empty.
    """
    mark = fingerprint(record)
    chosen = F.when(F.lit(False), F.lit(None).cast(TURNS))
    for layout in layouts:
        chosen = chosen.when(mark == fingerprint(F.lit(layout.example)), _turns(record, layout))
        if layout.many:
            bare = re.sub(r"\[.*\]", "[]", layout.example)
            chosen = chosen.when(mark == fingerprint(F.lit(bare)), F.array().cast(TURNS))
    return chosen


def _turns(record: Column, layout: Layout) -> Column:
    known = F.create_map(*[F.lit(x) for pair in layout.roles for x in pair]) if layout.roles else None
    named = lambda role: F.coalesce(F.get(F.array(known[role]), 0), role) if known is not None else role
    if layout.many:
        name, role, text = layout.many
        rows = _parsed(record, f"struct<`{name}`:array<struct<`{role}`:string,`{text}`:string>>>")[name]
        return F.transform(rows, lambda t: _turn(named(t[role]), t[text]))
    fields = _parsed(record, "struct<" + ",".join(f"`{f}`:string" for _, f in layout.single) + ">")
    return F.array_compact(F.array(*[F.when(fields[f].isNotNull(), _turn(F.lit(r), fields[f])) for r, f in layout.single]))


def _parsed(record: Column, schema: str) -> Column:
    return F.from_json(record, schema, {"maxStringLen": str((1 << 31) - 1)})


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def escape(text: Column) -> Column:
    """The text without control strings: the escape character first, then the first character of each."""
    text = F.replace(text, F.lit("\\"), F.lit("\\-"))
    for control in CONTROLS:
        code = dict(CODES)[control[0]]
        text = F.replace(text, F.lit(control), F.lit(code + control[1:]))
    return text


def unescape(text: Column) -> Column:
    for char, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _escaped_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _plain_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def formatted(turns: Column) -> Column:
    """One text of all turns: the turn mark, the role, a line feed, the text, the end mark and a line feed each."""
    one = lambda t: F.concat(F.lit(TURN), _escaped_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text. Marks stand in it as control strings only, so it may be cut at them."""
    pieces = F.slice(F.split(text, re.escape(TURN)), 2, 1 << 30)
    return F.transform(pieces, lambda p: F.struct(_plain_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(_body(p)).alias("text")))


def _body(piece: Column) -> Column:
    """What stands between the role's line feed and the end mark."""
    begin = F.length(F.substring_index(piece, "\n", 1)) + 1
    return F.substring(piece, begin + 1, F.length(piece) - begin - len(END + "\n"))


def loss_spans(text: Column, role: str = "assistant") -> Column:
    """Spans (first character from zero, characters) of a formatted text that the loss counts: the texts of a role."""
    pieces = F.slice(F.split(text, re.escape(TURN)), 2, 1 << 30)
    step = lambda acc, p: F.struct(
        (acc["at"] + len(TURN) + F.length(p)).alias("at"),
        F.when(
            F.substring_index(p, "\n", 1) == role,
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + len(TURN) + len(role) + 1).alias("first"), (F.length(p) - (len(role) + 1) - len(END + "\n")).alias("chars")))),
        ).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,chars:int>>").alias("spans"))
    return F.aggregate(pieces, start, step)["spans"]


def under_mask(text: Column, spans: Column) -> Column:
    """The text under a loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["first"] + 1, s["chars"]))), "")


def format_chats(records: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """Add ``turns``, ``formatted`` and ``loss_spans`` to rows with a JSON text in ``record``.

    A record of an unknown layout, or that is no JSON or null, has null in all three. Other columns stay; those with
    the names of new ones are replaced.
    """
    rows = records.drop("turns", "formatted", "loss_spans").withColumn("turns", canonical_turns(F.col("record"), layouts))
    return rows.withColumn("formatted", formatted(F.col("turns"))).withColumn("loss_spans", loss_spans(F.col("formatted")))


def conversation_records(rows: DataFrame) -> DataFrame:
    """Conversations given as rows (conv_id, turn, role, text) as one JSON record each.

    Turns are in order of turn, then role, then text, null first; null texts and roles are empty. Rows without a
    conv_id are one conversation. A conversation is a unit: it has to fit in a task, as a text has.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("rows"))
    messages = F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return whole.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


#: A conversation whose texts are control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark, sf: str) -> DataFrame:
    """Query: every conversation, and one of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    chats = format_chats(conversation_records(rows.unionByName(hostile)))
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(text: str) -> str:
    sql = f"replace({text}, '\\', '\\-')"
    for control in CONTROLS:
        sql = f"replace({sql}, '{control}', '{dict(CODES)[control[0]] + control[1:]}')"
    return sql


OP7_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '{HOSTILE}' FROM range(2) r(n)),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS listed,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(replace({_sql_escape('role')}, chr(10), '\\n')) + length({_sql_escape('text')}) + {len(TURN) + len(END) + 2}) AS chars
  FROM given GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(listed) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM whole
"""
