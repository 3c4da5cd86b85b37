r"""Chat formatting with DataFrame functions alone.

Layouts.  A record's layout is told by the SHA-256 of its sorted nested field
paths (those that any declared mapping knows, so extra fields change nothing).
Each declared mapping says where that layout keeps roles and texts; the
fingerprint of a record selects the mapping that yields its canonical turns.

Template.  A turn is ``<|im_start|>ROLE\nTEXT<|im_end|>\n``.  Inside roles and
texts every ``<``, backslashes, ``|`` gets one more backslash (``<|`` becomes ``<\|``), so
the control strings can't occur there, and taking one backslash out again is exact.
A line break in a role is written ``<|nl|>``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The control strings of the template.
START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class TurnList:
    """A list of messages: the paths of the list and of role and text in each element."""

    name: str
    items: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    system: str | None = None

    def paths(self) -> list[str]:
        return [*([self.system] if self.system else []), self.items, f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"]

    def turns(self, root: str) -> Column:
        def one(m: Column) -> Column:
            role = m[self.role]
            for theirs, ours in self.roles.items():
                role = F.when(m[self.role] == theirs, F.lit(ours)).otherwise(role)
            return _turn(role, m[self.text])

        found = F.transform(F.col(f"{root}.{self.items}"), one)
        if self.system:
            found = F.concat(F.array(_turn(F.lit("system"), F.col(f"{root}.{self.system}"))), found)
        return found


@dataclass(frozen=True)
class Fields:
    """Fixed fields: for each turn its role and the paths whose values are its text, those that have any joined by a blank line."""

    name: str
    parts: tuple[tuple[str, tuple[str, ...]], ...]

    def paths(self) -> list[str]:
        return [p for _, fields in self.parts for p in fields]

    def turns(self, root: str) -> Column:
        def text(fields: tuple[str, ...]) -> Column:
            return F.array_join(F.filter(F.array(*[F.col(f"{root}.{p}") for p in fields]), lambda x: x.isNotNull() & (x != "")), "\n\n")

        return F.array(*[_turn(F.lit(role), text(fields)) for role, fields in self.parts])


@dataclass(frozen=True)
class TurnRows:
    """A table with a row for each turn: conversation, order, role and text columns."""

    name: str
    key: str
    order: str
    role: str
    text: str

    def paths(self) -> list[str]:
        return [self.key, self.order, self.role, self.text]


_SHARE = {"human": "user", "gpt": "assistant", "bot": "assistant"}
#: Mappings of a record of its own; TABLES those of whole tables.
RECORDS: tuple[TurnList | Fields, ...] = (
    TurnList("messages", "messages", "role", "content"),
    TurnList("messages_system", "messages", "role", "content", system="system"),
    TurnList("share", "conversations", "from", "value", _SHARE),
    TurnList("share_system", "conversations", "from", "value", _SHARE, system="system"),
    Fields("instruction", (("user", ("instruction",)), ("assistant", ("output",)))),
    Fields("instruction_input", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Fields("instruction_system", (("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Fields("instruction_input_system", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Fields("prompt_completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Fields("prompt_response", (("user", ("prompt",)), ("assistant", ("response",)))),
    Fields("prompt_response_system", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Fields("question_answer", (("user", ("question",)), ("assistant", ("answer",)))),
)
TABLES: tuple[TurnRows, ...] = (
    TurnRows("turn_rows", "conv_id", "turn", "role", "text"),
    TurnRows("message_rows", "conversation_id", "message_index", "role", "content"),
)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths, sorted; the elements of a list are ``path[]``."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    if not isinstance(schema, T.StructType):
        return []
    out = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        out += [path, *field_paths(f.dataType, path)]
    return sorted(out)


def fingerprint(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def table_mapping(df: DataFrame, tables: Sequence[TurnRows] = TABLES) -> TurnRows:
    """The mapping whose fingerprint the table's known field paths have; ValueError if there is none."""
    known = {p for m in tables for p in m.paths()}
    found = fingerprint([p for p in field_paths(df.schema) if p in known])
    for m in tables:
        if fingerprint(m.paths()) == found:
            return m
    for m in tables:  # a table may hold the columns of several mappings
        if set(m.paths()) <= set(field_paths(df.schema)):
            return m
    raise ValueError(f"no mapping has the fingerprint {found} of {df.columns}")


def _record_schema(records: Sequence[TurnList | Fields]) -> T.StructType:
    """The least schema that holds every known path; leaves are text."""
    lists: dict[str, set[str]] = {}
    leaves: set[str] = set()
    for p in (p for m in records for p in m.paths()):
        head, _, leaf = p.partition("[].")
        lists.setdefault(head, set()).add(leaf) if leaf else leaves.add(p)
    of = lambda names: T.StructType([T.StructField(n, T.StringType()) for n in sorted(names)])
    return T.StructType([T.StructField(n, T.ArrayType(of(lists[n])) if n in lists else T.StringType()) for n in sorted(leaves | set(lists))])


def canonical_records(df: DataFrame, column: str, records: Sequence[TurnList | Fields] = RECORDS) -> DataFrame:
    """df with layout_fingerprint, layout (the mapping's name) and turns (array<struct<role, text>>).

    column holds JSON records of any mix of layouts.  The fingerprint is that of the known paths that a record names, whether
    or not there is a value; an empty list names all that its elements could.  A record whose fingerprint is no mapping's, as
    it has fields of several layouts, goes by the mapping of most paths that all
    have values, else by that of most paths that are all named.  Of equally many the first declared counts.
    A null or broken record, one of an unknown layout and one without any value keep their rows with null layout and turns.
    Null roles and texts in a known layout are empty; very long texts are whole; an empty table gives none.
    Existing columns of these three names are replaced; repeated rows, and repeated ids, stay.
    """
    root, lists, at = "__record", "__lists", F.col(f"`{column}`")
    heads = sorted({p.partition("[].")[0] for m in records for p in m.paths() if "[]." in p})
    parsed = df.drop("layout_fingerprint", "layout", "turns").withColumn(root, F.from_json(at, _record_schema(records)))
    parsed = parsed.withColumn(lists, F.struct(*[F.from_json(F.get_json_object(at, f"$.{h}"), "array<map<string,string>>").alias(h) for h in heads]))
    keys = F.json_object_keys(at)

    def present(path: str) -> Column:
        head, _, leaf = path.partition("[].")
        value = F.col(f"{root}.`{head}`")
        return F.exists(value, lambda m: m[leaf].isNotNull()) if leaf else value.isNotNull()

    def named(path: str) -> Column:
        head, _, leaf = path.partition("[].")
        if not leaf:
            return F.array_contains(keys, path)
        items = F.col(f"{lists}.`{head}`")
        return (F.size(items) == 0) | F.exists(items, lambda m: F.map_contains_key(m, leaf))

    known = sorted({p for m in records for p in m.paths()})
    parsed = parsed.withColumn("layout_fingerprint", F.sha2(F.concat_ws("\n", *[F.when(named(p), F.lit(p)) for p in known]), 256))
    every = lambda found: reduce(lambda a, b: a & b, found)
    some = lambda found: reduce(lambda a, b: a | b, found)
    larger = sorted(records, key=lambda m: -len(set(m.paths())))
    fits = [(m, (F.col("layout_fingerprint") == fingerprint(m.paths())) & some(present(p) for p in m.paths())) for m in records]
    fits += [(m, every(present(p) for p in m.paths())) for m in larger]
    fits += [(m, every(named(p) for p in m.paths()) & some(present(p) for p in m.paths())) for m in larger]
    # Only the name is sought through all tests; the turns go by it.
    parsed = parsed.withColumn("layout", F.coalesce(*[F.when(fit, F.lit(m.name)) for m, fit in fits]))
    turns = F.coalesce(*[F.when(F.col("layout") == m.name, m.turns(root)) for m in records])
    return parsed.withColumn("turns", turns).drop(root, lists)


def turn_rows(df: DataFrame, key: str, mapping: TurnRows = TABLES[0]) -> DataFrame:
    """canonical_records() as a table with a row for each turn, in the mapping's columns; records without turns have none."""
    rows = df.select(F.col(f"`{key}`").alias(mapping.key), F.posexplode("turns").alias("at", "turn"))
    return rows.select(mapping.key, F.col("at").cast("long").alias(mapping.order), F.col("turn.role").alias(mapping.role), F.col("turn.text").alias(mapping.text))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_turns(df: DataFrame, mapping: TurnRows | None = None) -> DataFrame:
    """A row for each conversation: its key (under its own name), formatted, loss_mask, n_turns.

    df has a row for each turn; the mapping is found by the table's fingerprint if
    none is given, and other columns are ignored.  Turns go by order (null first), ties by role, then
    text; repeated rows are turns of their own.  Null roles and texts are empty, very long ones whole.  A
    null key is a conversation too.  loss_mask has a span (start, length) in code
    points of formatted for each assistant text, empty ones left out.  An empty table gives no rows.
    A conversation is one record of the result, so it must fit in a task; no other
    rows meet there.
    """
    m = mapping or table_mapping(df)
    role, text = F.coalesce(F.col(f"`{m.role}`"), F.lit("")), F.coalesce(F.col(f"`{m.text}`"), F.lit(""))
    rows = df.select(F.col(f"`{m.key}`").alias("key"), F.col(f"`{m.order}`").alias("at"), role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    rows = rows.withColumns({"head": head, "body": escape(F.col("text"))})
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("key").orderBy("at", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0))
    rows = rows.select("key", start.alias("start"), "segment", F.when(F.col("role") == ASSISTANT, F.struct((start + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))).alias("span"))
    whole = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "segment", "span"))).alias("parts"))
    spans = F.filter(F.transform("parts", lambda x: x["span"]), lambda x: x.isNotNull() & (x["length"] > 0))
    return whole.select(F.col("key").alias(m.key), F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("formatted"), spans.alias("loss_mask"), F.size("parts").cast("long").alias("n_turns"))


def read_turns(formatted: Column) -> Column:
    """The turns array<struct<role, text>> of a formatted text, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    body = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role = F.substr(piece, F.lit(len(START) + 1), cut - F.lit(len(START) + 1))
        return F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(F.substr(piece, cut + 1)).alias("text"))

    return F.transform(body, one)


def read_loss(formatted: Column, mask: Column) -> Column:
    """The unescaped text under each span of the loss mask."""
    return F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
