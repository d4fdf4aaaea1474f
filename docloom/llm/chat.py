"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record is JSON text. The nested paths of its fields, without their types, are hashed; the fingerprint picks
one of the declared layouts, and that layout's mapping turns the record into canonical (role, text) turns.
Turns are then set in a template whose control strings are escaped inside texts, reversibly.

Rows of a table are fingerprinted by their field names; their text and role are read from the columns, so they go
through no parser, have no limit of length, and keep their roles as they are.

Edge cases: null text or role reads as empty; a record whose fingerprint no layout declares keeps its row with
layout null and no turns; one beyond the parser's limit of ``PARSER_LIMIT`` characters that it cannot read stays too, and its reason says so; an empty turn list formats to an empty string; conversations with equal turn numbers
order them by role and text; a conversation is one output row, so its turns meet in one task by definition.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TURNS = "array<struct<role:string,text:string>>"
#: Characters of a string beyond which JSON parsers give up.
PARSER_LIMIT = 20_000_000

#: Names that data sets give to the canonical roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A declared record layout.

    ``paths``: the field paths that are always there; ``optional``: those that may be.
    ``turns``: (role, path) pairs in order, for flat records; or ``list_at`` with the names of the role and
    text fields, for lists of messages; or ``role_at`` and ``text_at``, for one turn in a record.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    list_at: str = ""
    role_at: str = ""
    text_at: str = ""
    names: dict = field(default_factory=dict, hash=False)

    def fingerprints(self) -> list[str]:
        """One for each set of optional fields."""
        every = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return [fingerprint_of([*self.paths, *more]) for more in every]


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


LAYOUTS = (
    Layout("turn_row", ("text", "role"), ("conv_id", "turn"), role_at="role", text_at="text"),
    Layout("messages", ("messages[].role", "messages[].content"), ("id", "source"), list_at="messages", role_at="role", text_at="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("id", "system"), list_at="conversations", role_at="from", text_at="value"),
    Layout("dialog", ("dialog[].speaker", "dialog[].utterance"), ("id",), list_at="dialog", role_at="speaker", text_at="utterance"),
    Layout("instruction", ("instruction", "output"), ("input", "system"), turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), ("system",), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("question", "answer"), ("context",), turns=(("system", "context"), ("user", "question"), ("assistant", "answer"))),
    Layout("nested_pair", ("data.prompt.text", "data.reply.text"), ("id",), turns=(("user", "data.prompt.text"), ("assistant", "data.reply.text"))),
)


def field_paths(record: Column) -> Column:
    """Sorted distinct paths of a JSON record's leaf fields: ``a.b``, ``list[].c``.

    The schema of the record as a variant is cut into tokens; a fold keeps the names that are open.
    """
    schema = F.schema_of_variant(F.try_parse_json(record))
    tokens = F.regexp_extract_all(schema, F.lit(r"(OBJECT<|ARRAY<|>|`(?:[^`]|``)*`|[^<>:,` ]+)"), F.lit(1))

    def step(acc: Column, token: Column) -> Column:
        # open: names of the enclosing objects and lists; name: the field whose type comes next
        here = F.when(acc["name"] == "", acc["prefix"]).when(acc["prefix"] == "", acc["name"]).when(
            acc["prefix"].endswith("[]"), F.concat(acc["prefix"], F.lit("."), acc["name"])
        ).otherwise(F.concat(acc["prefix"], F.lit("."), acc["name"]))
        kinds = ("OBJECT<", "ARRAY<")
        is_type = token.rlike(r"^(VOID|BOOLEAN|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|STRING|BINARY|DATE|TIMESTAMP|TIMESTAMP_NTZ|UUID|VARIANT|DECIMAL\(.*|\d+\))$")
        opened = F.when(token == kinds[0], here).otherwise(F.concat(here, F.lit("[]")))
        return (
            F.when(
                token.isin(*kinds),
                F.struct(opened.alias("prefix"), F.lit("").alias("name"), F.concat(acc["stack"], F.array(acc["prefix"])).alias("stack"), acc["paths"].alias("paths")),
            )
            .when(
                token == ">",
                F.struct(
                    F.coalesce(F.try_element_at(acc["stack"], F.lit(-1)), F.lit("")).alias("prefix"),
                    F.lit("").alias("name"),
                    F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0))).alias("stack"),
                    acc["paths"].alias("paths"),
                ),
            )
            .when(
                is_type & ((acc["name"] != "") | acc["prefix"].endswith("[]")),
                F.struct(acc["prefix"].alias("prefix"), F.lit("").alias("name"), acc["stack"].alias("stack"), F.concat(acc["paths"], F.array(here)).alias("paths")),
            )
            .otherwise(
                F.struct(acc["prefix"].alias("prefix"), F.regexp_replace(token, "^`|`$", "").alias("name"), acc["stack"].alias("stack"), acc["paths"].alias("paths"))
            )
        )

    none = F.expr("cast(array() as array<string>)")
    start = F.struct(F.lit("").alias("prefix"), F.lit("").alias("name"), none.alias("stack"), none.alias("paths"))
    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda acc: acc["paths"])))


def fingerprint(record: Column) -> Column:
    """SHA-256 of the sorted field paths; null for what is not JSON."""
    return F.sha2(F.array_join(field_paths(record), "\n"), 256)


def _turns(layout: Layout, record: Column) -> Column:
    def role(name: Column) -> Column:
        low = F.lower(F.coalesce(name, F.lit("")))
        out = F.coalesce(name, F.lit(""))
        for k, v in {**ROLE_NAMES, **layout.names}.items():
            out = F.when(low == k, F.lit(v)).otherwise(out)
        return out

    def turn(r: Column, t: Column) -> Column:
        return F.struct(r.alias("role"), F.coalesce(t, F.lit("")).alias("text"))

    if layout.list_at:
        kind = f"array<struct<`{layout.role_at}`:string,`{layout.text_at}`:string>>"
        items = F.from_json(F.get_json_object(record, f"$.{layout.list_at}"), kind)
        return F.coalesce(F.transform(items, lambda m: turn(role(m[layout.role_at]), m[layout.text_at])), F.expr(f"cast(array() as {TURNS})"))
    if layout.role_at:
        return F.array(turn(role(F.get_json_object(record, f"$.{layout.role_at}")), F.get_json_object(record, f"$.{layout.text_at}")))
    flat = F.array(*[turn(F.lit(r), F.get_json_object(record, f"$.{p}")) for r, p in layout.turns])
    needed = {p for _, p in layout.turns} & set(layout.paths)
    present = [F.lit(True) if p in needed else F.get_json_object(record, f"$.{p}").isNotNull() for _, p in layout.turns]
    return F.transform(F.filter(F.arrays_zip(flat.alias("turn"), F.array(*present).alias("there")), lambda x: x["there"]), lambda x: x["turn"])


def canonical(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with layout (name or null), fingerprint, turns and reason, from the JSON text in ``record``.

    ``reason`` says why a record has no layout, and is null where it has one.
    """
    df = df.drop("layout", "fingerprint", "turns", "reason").withColumn("fingerprint", fingerprint(F.col(record)))
    name, turns = F.lit(None).cast("string"), F.expr(f"cast(array() as {TURNS})")
    for layout in layouts:
        hit = F.col("fingerprint").isin(layout.fingerprints())
        name = F.when(hit, F.lit(layout.name)).otherwise(name)
        turns = F.when(hit, _turns(layout, F.col(record))).otherwise(turns)
    read = F.col("fingerprint").isNotNull()
    long = F.concat(F.lit("record too long to be read as JSON: characters "), F.length(record).cast("string"))
    unknown = F.when(read, F.lit("no layout has this fingerprint")).when(F.length(record) > PARSER_LIMIT, long).otherwise(F.lit("no JSON record"))
    return df.withColumn("layout", name).withColumn("turns", turns).withColumn("reason", F.when(F.col("layout").isNull(), unknown))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column) -> Column:
    """The template: start mark, role, newline, text, end mark, newline for each turn."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(
                F.lit(START), F.replace(escape(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), F.lit(NEWLINE)),
                F.lit("\n"), escape(F.coalesce(t["text"], F.lit(""))), F.lit(END + "\n"),
            ),
        ),
        "",
    )


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """One character for each turn: 1 where the turn's text bears loss."""
    return F.array_join(F.transform(turns, lambda t: F.when(t["role"] == role, F.lit("1")).otherwise(F.lit("0"))), "")


def read_back(formatted: Column) -> Column:
    """The turns of a rendered string."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p.startswith(START))
    body = F.transform(parts, lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(
        body,
        lambda b: F.struct(
            unescape(F.replace(F.substring_index(b, "\n", 1), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            unescape(F.substr(b, F.instr(b, "\n") + 1)).alias("text"),
        ),
    )


def format_turns(df: DataFrame) -> DataFrame:
    """``df`` (with turns) plus formatted and loss_mask."""
    return df.withColumn("formatted", render(F.col("turns"))).withColumn("loss_mask", loss_mask(F.col("turns")))


def canonical_rows(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df``, one turn in a row, with layout, fingerprint and turns; the record is the row, its paths the column names.

    A row of short stand-ins is fingerprinted in the place of the values; these are read from the layout's columns.
    """
    df = df.drop("layout", "fingerprint", "turns")
    stand_in = F.to_json(F.struct(*[F.lit("-").alias(c) for c in df.columns]))
    out = df.withColumn("fingerprint", fingerprint(stand_in))
    name, turns = F.lit(None).cast("string"), F.expr(f"cast(array() as {TURNS})")
    for layout in layouts:
        if layout.role_at in df.columns and layout.text_at in df.columns:
            hit = F.col("fingerprint").isin(layout.fingerprints())
            said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (layout.role_at, layout.text_at)]
            name = F.when(hit, F.lit(layout.name)).otherwise(name)
            turns = F.when(hit, F.array(F.struct(said[0].alias("role"), said[1].alias("text")))).otherwise(turns)
    return out.withColumn("layout", name).withColumn("turns", turns)


def format_conversations(rows: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one row for each conversation: conv_id, turns, formatted, loss_mask."""
    mapped = canonical_rows(rows.select("conv_id", "turn", "role", "text"), layouts)
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn"), F.col("turns"))))
    return format_turns(mapped.groupBy("conv_id").agg(F.flatten(F.transform(turns, lambda x: x["turns"])).alias("turns")))
