"""Chat formatting by schema fingerprints.

Records arrive as JSON in different layouts. The paths of their nested fields are hashed; the hash selects one of
the declared mappings, which turns the record into canonical turns ``array<struct<role, text>>``. Turns are then
rendered by a template whose control strings are escaped inside texts and roles, with the spans of assistant
text that bear loss. ``read_back`` recovers turns and loss text from the output alone.

All of it is built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Mapping:
    """A layout: the field paths that name it and its turns.

    Each turn is (role, path) with ``$`` for the record; for a list of messages, ``items`` is the path of the
    list and ``role`` and ``text`` are the names of its elements' fields. ``roles`` renames roles.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> int:
        return xxhash.xxh64_intdigest(",".join(sorted(self.paths)).encode(), seed=42) - (1 << 64) * (xxhash.xxh64_intdigest(",".join(sorted(self.paths)).encode(), seed=42) >> 63)


SHAREGPT = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), items="messages", role="role", text="content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", roles=SHAREGPT),
    Mapping("prompt_completion", ("prompt", "completion"), turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("question_answer", ("question", "answer"), turns=(("user", "$.question"), ("assistant", "$.answer"))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), turns=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping("system_prompt", ("system", "prompt", "response"), turns=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("nested_data", ("data.prompt", "data.completion"), turns=(("user", "$.data.prompt"), ("assistant", "$.data.completion"))),
)


#: No text of a record is too long; without this, the engine's reader stops at 20,000,000 characters.
LIMITS = {"maxStringLen": str((1 << 31) - 1)}
OBJECT = "map<string,string>"
LIST = f"array<{OBJECT}>"


def _read(json: str, mappings: Sequence[Mapping]) -> dict[str, Column]:
    """Columns with the record's fields that any mapping names: its texts, its objects and its lists of objects."""
    paths = [p.split(".") for m in mappings for p in (*(p for p in m.paths if "[]" not in p), *(p.removeprefix("$.") for _, p in m.turns))]
    lists = [m.items.split(".") for m in mappings if m.items]
    kinds = {"__texts": ("string", {p[0] for p in paths if len(p) == 1}), "__objects": (OBJECT, {p[0] for p in paths + lists if len(p) > 1}), "__lists": (LIST, {p[0] for p in lists if len(p) == 1})}
    return {k: F.from_json(json, ", ".join(f"`{x}` {t}" for x in sorted(names) or ["__none"]), LIMITS) for k, (t, names) in kinds.items()}


def _at(path: str, kind: str = "string") -> Column:
    """The text, object or list at ``path`` of the record that ``_read`` has read."""
    above, _, name = path.rpartition(".")
    if not above:
        return F.col({"string": "__texts", OBJECT: "__objects", LIST: "__lists"}[kind])[name]
    value = F.element_at(_at(above, OBJECT), name)
    return value if kind == "string" else F.from_json(value, kind, LIMITS)


def _has(path: str) -> Column:
    """Whether the record has a field at ``path``, null or not; for ``a[].b``, whether an element of ``a`` has ``b``."""
    items, _, name = path.partition("[].")
    if name:
        return F.exists(_at(items, LIST), lambda x: F.map_contains_key(x, name))
    above, _, name = path.rpartition(".")
    return F.map_contains_key(_at(above, OBJECT), name) if above else F.array_contains("__keys", name)


def _stray(items: str, names: Sequence[str]) -> Column:
    """Whether an element of the list ``items`` is no object or has none of the fields ``names``."""
    return F.exists(_at(items, LIST), lambda x: ~F.coalesce(F.arrays_overlap(F.map_keys(x), F.array(*map(F.lit, names))), F.lit(False)))


def fingerprint(mappings: Sequence[Mapping]) -> Column:
    """Hash of the sorted field paths, of those that any mapping names, which the record read has.

    The fields that mappings name in elements of some list are looked for in all lists, and an element without
    any of them counts as a path ``[]`` of its own, so a list of mixed layouts has the hash of no mapping.
    """
    lists = sorted({m.items for m in mappings if m.items})
    names = sorted({p.partition("[].")[2] for m in mappings for p in m.paths if "[]" in p})
    paths = {p: _has(p) for p in {p for m in mappings for p in m.paths} | {f"{x}[].{n}" for x in lists for n in names}}
    paths |= {f"{x}[]": _stray(x, names) for x in lists}
    present = F.array_compact(F.array(*(F.when(paths[p], F.lit(p)) for p in sorted(paths))))
    return F.xxhash64(F.array_join(present, ","))


def canonical(records: DataFrame, json: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout`` and ``turns``.

    The column ``json`` holds one JSON object a row, of any size that a column can hold. Fields that no mapping
    names don't matter; a record whose named fields are those of no mapping, and one that is null or not JSON, has
    a null layout and no turns. So has one with a list whose elements have different layouts, or in which an element
    has no field that a mapping names. A null text counts as empty, wherever it is, and a null role too.
    """
    read = _read(json, mappings) | {"__keys": F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))}
    seen = records.withColumns(read).withColumn("__fp", fingerprint(mappings))
    layout = reduce(lambda c, m: c.when(F.col("__fp") == m.fingerprint, m.name), mappings, F.when(F.lit(False), ""))
    none = F.array().cast(f"array<{TURN}>")
    turns = F.when(F.lit(False), none)
    for m in mappings:
        if m.items:

            def turn(x: Column) -> Column:
                role = F.element_at(x, m.role)
                named = reduce(lambda c, r: c.when(role == r[0], r[1]), m.roles, F.when(F.lit(False), "")).otherwise(role)
                return F.struct(F.coalesce(named, F.lit("")).alias("role"), F.coalesce(F.element_at(x, m.text), F.lit("")).alias("text"))

            made = F.transform(_at(m.items, LIST), turn)
        else:
            made = F.array(*(F.struct(F.lit(r).alias("role"), F.coalesce(_at(p.removeprefix("$.")), F.lit("")).alias("text")) for r, p in m.turns))
        turns = turns.when(F.col("__fp") == m.fingerprint, made)
    out = seen.withColumn("layout", layout).withColumn("turns", F.coalesce(turns, none))
    return out.drop("__keys", "__texts", "__objects", "__lists", "__fp")


def escaped(text: Column) -> Column:
    """Reversible: backslashes double, and a single one goes into each ``<|``. No control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def formatted(turns: Column) -> Column:
    """The text of ``turns``."""
    one = lambda t: F.concat(F.lit(START), _escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def loss_spans(turns: Column, bearing: str = "assistant") -> Column:
    """``array<struct<start, end>>``, code points of the formatted text: the texts of assistant turns, no markers."""
    sizes = F.transform(turns, lambda t: F.struct((F.lit(len(START) + 1) + F.length(_escaped_role(t["role"]))).cast("long").alias("head"), F.length(escaped(t["text"])).cast("long").alias("body"), (t["role"] == bearing).alias("bears")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["head"]
        end = start + x["body"]
        return F.struct((end + len(END)).alias("at"), F.when(x["bears"], F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["out"])


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        body = F.substr(x, cut + 1, F.length(x) - cut - len(END))
        return F.struct(_unescaped_role(F.substr(x, F.lit(1), cut - 1)).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(text: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def messages(rows: DataFrame) -> DataFrame:
    """One JSON record ``{"messages": [...]}`` for each ``conv_id`` of ``rows(conv_id, turn, role, text)``.

    Messages are in order of turn, a null turn first, ties by role and text; repeated rows are messages each. A
    null role or text counts as empty. Rows without conv_id make one record.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return lists.select("conv_id", F.to_json(F.struct(F.transform("all", lambda x: F.struct(x["role"], x["content"])).alias("messages"))).alias("record"))


def render(records: DataFrame, json: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout``, ``formatted`` and ``loss``: canonical turns rendered by the template."""
    turns = canonical(records, json, mappings)
    return turns.select(*(c for c in turns.columns if c != "turns"), formatted(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss"))
