"""Chat formatting by schema fingerprints.

The nested field paths of a layout are hashed; the hash selects a declarative mapping that turns the layout
(prompt/response columns, instruction records, message arrays, one row per turn, or rows of JSON text with any
of these) into canonical turns array<struct<role, text>>. Turns are then rendered with control strings
"<|role|>" and "<|end|>". Control strings inside roles and texts are escaped by one more backslash between
their two characters, which is undone exactly on reading, so no text can forge a turn. The loss mask is the
list of spans of the assistant's texts.

A mapping fits where all of its paths are there: the fingerprint of those among a layout's paths is compared with
the mapping's own, so extra fields change nothing, even those of other mappings. The most specific mapping that fits
is taken, the first declared on ties. In JSON a path is there if the key is, whatever its value; below an array it is
there if any element has the key, or if there are no elements.

Defined results: a null text or role is empty; turns are ordered by turn, then role, then text, nulls first;
repeated rows are repeated turns; rows with a null conv_id form one conversation; an empty table gives an empty
table; a JSON row of an unknown layout, or that isn't JSON, gets null turns and the layout null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let

TURNS = "array<struct<role:string,text:string>>"
#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _pair(user: str, assistant: str, system: str | None = None) -> Callable[[Callable[[str], Column]], Column]:
    def turns(field: Callable[[str], Column]) -> Column:
        first = [_turn(F.lit("system"), field(system))] if system else []
        return F.array(*first, _turn(F.lit("user"), field(user)), _turn(F.lit("assistant"), field(assistant)))

    return turns


def _instruction(field: Callable[[str], Column]) -> Column:
    more = F.coalesce(field("input").cast("string"), F.lit(""))
    ask = F.concat(F.coalesce(field("instruction"), F.lit("")), F.when(more == "", "").otherwise(F.concat(F.lit("\n\n"), more)))
    return F.array(_turn(F.lit("user"), ask), _turn(F.lit("assistant"), field("output")))


def _messages(column: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]) if ROLES else None
    return lambda field: F.transform(field(column), lambda m: _turn(F.coalesce(names[m[role]], m[role]), m[text]))


#: name -> (field paths, turns of a row); a layout with one row per turn has no expression and is grouped.
MAPPINGS: dict[str, tuple[tuple[str, ...], Callable | None]] = {}


def _declare() -> None:
    if MAPPINGS:
        return
    MAPPINGS.update(
        {
            "turn_rows": (("conv_id", "turn", "role", "text"), None),
            "turn_list": (("turns[].role", "turns[].text"), lambda field: F.transform(field("turns"), lambda m: _turn(m["role"], m["text"]))),
            "messages": (("messages[].role", "messages[].content"), _messages("messages", "role", "content")),
            "from_value": (("conversations[].from", "conversations[].value"), _messages("conversations", "from", "value")),
            "instruction": (("instruction", "input", "output"), _instruction),
            "instruction_only": (("instruction", "output"), _pair("instruction", "output")),
            "prompt_response": (("prompt", "response"), _pair("prompt", "response")),
            "prompt_completion": (("prompt", "completion"), _pair("prompt", "completion")),
            "system_prompt_response": (("system", "prompt", "response"), _pair("prompt", "response", "system")),
            "question_answer": (("question", "answer"), _pair("question", "answer")),
        }
    )


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Paths of the leaves of a schema; "[]" stands for the elements of an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def by_specificity() -> list[str]:
    """Names of the mappings, those with most paths first."""
    _declare()
    return sorted(MAPPINGS, key=lambda name: -len(MAPPINGS[name][0]))


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def select_mapping(df: DataFrame) -> str:
    """Name of the most specific mapping whose fingerprint is that of its paths among the schema's."""
    have = set(field_paths(df.schema))
    for name in by_specificity():
        paths = MAPPINGS[name][0]
        if fingerprint(have & set(paths)) == fingerprint(paths):
            return name
    raise ValueError(f"no mapping for the fields {sorted(have)}")


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns) of a table in any known layout."""
    name = select_mapping(df)
    build = MAPPINGS[name][1]
    if build is not None:
        return df.select(id_col, build(lambda c: F.col(f"`{c}`")).cast(TURNS).alias("turns"))
    row = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grouped = df.groupBy(id_col).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return grouped.select(id_col, F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def _json_paths(value: Column, paths: list[str]) -> Column:
    """Those of the declared paths that are there in a variant."""

    def there(path: str) -> Column:
        top, below, leaf = path.partition("[].")
        field = F.try_variant_get(value, f"$.{top}", "variant").isNotNull()
        if not below:
            return field
        elements = F.coalesce(F.try_variant_get(value, f"$.{top}", "array<variant>"), F.array().cast("array<variant>"))
        return field & ((F.size(elements) == 0) | F.exists(elements, lambda e: F.coalesce(F.try_variant_get(e, f"$.{leaf}", "variant").isNotNull(), F.lit(False))))

    return F.array_compact(F.array(*[F.when(there(p), F.lit(p)) for p in paths]))


def canonical_json(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, layout, turns) of rows of JSON text, each in a layout of its own, by the fingerprint of its paths."""
    names = [n for n in by_specificity() if MAPPINGS[n][1] is not None]
    known = sorted({p for n in names for p in MAPPINGS[n][0]})
    out = df.select(F.col(id_col), F.col(column).alias("__json"), _json_paths(F.try_parse_json(F.col(column)), known).alias("__paths"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name in reversed(names):
        paths, build = MAPPINGS[name]
        own = F.array(*[F.lit(p) for p in sorted(paths)])
        hit = F.sha2(F.array_join(F.array_sort(F.array_intersect("__paths", own)), "\n"), 256) == fingerprint(paths)
        fields: dict[str, str] = {}
        for p in paths:
            top, _, leaf = p.partition("[].")
            fields[top] = f"array<struct<{', '.join(f'`{q.partition("[].")[2]}`:string' for q in paths if q.startswith(top + '[].'))}>>" if leaf else "string"
        parsed = F.from_json("__json", ", ".join(f"`{k}` {v}" for k, v in fields.items()))
        none = F.array().cast(TURNS)
        layout = F.when(hit, name).otherwise(layout)
        turns = F.when(hit, F.coalesce(build(lambda c, parsed=parsed: parsed[c]).cast(TURNS), none)).otherwise(turns)
    return out.select(id_col, layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), r"\|(\\*)>", r"|$1\\>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\|(\\*)\\>", r"|$1>"), r"<(\\*)\\\|", r"<$1|")


END = "<|end|>\n"


def format_chat(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, formatted, loss_spans array<struct<start, length>>): 1-based code point spans of the assistant's texts."""
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("learn"),
        ),
    )
    zero = F.lit(0).cast("bigint")

    def spans(p: Column) -> Column:
        size = lambda x: (F.length(x["head"]) + F.length(x["body"]) + len(END)).cast("bigint")
        start = F.struct(zero.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            span = F.struct((acc["at"] + F.length(x["head"]) + 1).cast("bigint").alias("start"), F.length(x["body"]).cast("bigint").alias("length"))
            return F.struct((acc["at"] + size(x)).alias("at"), F.when(x["learn"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(p, start, step)["spans"]

    body = lambda p: F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    out = turns.withColumn("__chat", let(parts, lambda p: F.struct(body(p).alias("formatted"), spans(p).alias("loss_spans"))))
    return out.select(id_col, "__chat.formatted", "__chat.loss_spans")


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    at = lambda p: F.instr(p, "|>\n")
    turn = lambda p: F.struct(unescape(F.substring(p, F.lit(3), at(p) - 3)).alias("role"), unescape(F.substring(p, at(p) + 3, F.length(p))).alias("text"))
    return let(pieces, lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), turn))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")
