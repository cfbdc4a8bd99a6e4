"""Chat formatting: a hash of nested field paths selects a declarative mapping to canonical turns.

One table of mappings serves JSON records of mixed layouts (``turns_of_records``) and tables with a row for each
turn (``turns_of_rows``): for each mapping the paths that it names itself are hashed, all others are passengers, and
the fingerprint is looked up. If several mappings fit, the one that names most of the paths is taken, then the first of
the table. ``format_turns`` writes the turns with one template and marks the loss spans; ``parse`` reads the output back.

Defined results: a record that is null, no JSON, or of an unknown layout keeps its row, with null turns and, if it
parses, the fingerprint of all its paths. Optional fields may be absent, and an empty array of messages gives no turns;
one that holds anything but objects is of an unknown layout. A text given as a list of parts is the parts' texts one
after another; a part without a text (an image) stays as its JSON. Null texts and roles count as empty. Rows of one conversation are ordered by their order column, role and text (nulls first), so
ties and repeated rows give one result; all are kept. Rows without a conversation id form one conversation with a
null id. Empty tables give empty results. Further columns are not read, whatever
their names. A conversation is formatted as one value, so
memory is bounded by the longest single conversation.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triweave.llm.common import tidy

TURNS = "array<struct<role string, text string>>"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


@dataclass(frozen=True)
class Mapping:
    """Layout of a record or table: the field paths that tell it, and where its turns are.

    A layout holds all ``required`` paths and any of the ``optional`` ones. ``each`` names an array of messages with
    (role, text) fields; ``parts`` are (role, field paths) of single turns, whose non-empty fields are joined by an
    empty line; ``rows`` are the columns (conversation, order, role, text) of a table with a row for each turn.
    ``roles`` renames roles.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rows: tuple[str, str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def layouts(self) -> Iterator[tuple[str, ...]]:
        """The sets of paths that records of this layout have; an array without messages shows as its bare path."""
        required = [self.required]
        if self.each:
            inside = f"{self.each[0]}[]."
            required.append(tuple(p for p in self.required if not p.startswith(inside)) + (f"{self.each[0]}[]",))
        for base in required:
            for n in range(len(self.optional) + 1):
                for more in itertools.combinations(self.optional, n):
                    yield base + more


NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Mapping("speaker_rows", ("dialog_id", "position", "speaker", "utterance"), rows=("dialog_id", "position", "speaker", "utterance"), roles=NAMES),
    Mapping("messages", ("messages[].role",), ("messages[].content", "system"), each=("messages", "role", "content"), parts=(("system", ("system",)),)),
    Mapping("from_value", ("conversations[].from",), ("conversations[].value", "system"), each=("conversations", "from", "value"), parts=(("system", ("system",)),), roles=NAMES),
    Mapping("prompt_response", ("prompt", "response"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question_answer", ("question", "answer"), ("context",), parts=(("user", ("context", "question")), ("assistant", ("answer",)))),
    Mapping("instruction_output", ("instruction", "output"), ("input", "system"), parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "replace")).hexdigest()


class Selection:
    """Fingerprints of the layouts of each mapping. Paths that a mapping does not name are its passengers and not hashed."""

    def __init__(self, mappings: tuple[Mapping, ...]):
        self.of: list[tuple[Mapping, set[str], set[str]]] = []  # mapping, its paths, its fingerprints
        for m in mappings:
            layouts = list(m.layouts())
            self.of.append((m, {p for paths in layouts for p in paths}, {fingerprint(paths) for paths in layouts}))

    def choose(self, paths: Iterable[str], rows: bool) -> tuple[str, Mapping | None]:
        """Fingerprint and mapping of a record, or of a table with a row for each turn; of all paths and None if none fits."""
        paths, most, best = set(paths), 0, None
        for m, own, layouts in self.of:
            mine = paths & own
            if bool(m.rows) == rows and len(mine) > most and (found := fingerprint(mine)) in layouts:
                most, best = len(mine), (found, m)
        return best or (fingerprint(paths), None)


def paths_of_schema(schema: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a table; array elements are written ``[]``."""
    if isinstance(schema, T.StructType):
        return {p for f in schema for p in paths_of_schema(f.dataType, f"{at}.{f.name}" if at else f.name)}
    return paths_of_schema(schema.elementType, at + "[]") if isinstance(schema, T.ArrayType) else {at}


def paths_of_value(value: object, at: str = "") -> set[str]:
    """Nested field paths of a parsed record; an empty array ends in ``[]``, one of plain values in ``[].``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths_of_value(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in (paths_of_value(v, at + "[]") if isinstance(v, dict | list) else {at + "[]."})} or {at + "[]"}
    return {at}


def written(value: object) -> str:
    """A leaf as text: null is empty, a list of parts is their texts, numbers and other nested values are JSON."""
    if isinstance(value, list) and value and all(isinstance(x, str) or isinstance(x, dict) and "type" in x for x in value):
        return "".join(x if isinstance(x, str) else x["text"] if isinstance(x.get("text"), str) else json.dumps(x, ensure_ascii=False) for x in value)
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def mapped(m: Mapping, record: dict) -> list[dict]:
    """Canonical turns of a record by its mapping; a part whose fields are all absent is no turn."""
    out = []
    for role, paths in m.parts:
        if any(p in record for p in paths):
            out.append({"role": role, "text": "\n\n".join(t for t in (written(record.get(p)) for p in paths) if t)})
    if m.each:
        path, role, text = m.each
        for x in record.get(path) or []:
            name = written(x.get(role))
            out.append({"role": m.roles.get(name, name), "text": written(x.get(text))})
    return out


def record_turns(record: str | None, selection: Selection) -> tuple[str | None, str | None, list[dict] | None]:
    """Fingerprint, mapping name and turns of one JSON record."""
    try:
        value = json.loads(record or "")
        found, m = selection.choose(paths_of_value(value), rows=False)
    except (ValueError, RecursionError):
        return None, None, None
    if m is None or not isinstance(value, dict) or (m.each and not (isinstance(value.get(m.each[0]), list) and all(isinstance(x, dict) for x in value[m.each[0]]))):
        return found, None, None
    return found, m.name, mapped(m, value)


TURN_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def turns_of_records(df: DataFrame, record: str = "record", keep: tuple[str, ...] = (), mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``keep`` columns, ``fingerprint``, ``layout`` (mapping name) and ``turns`` of each JSON record."""
    source = df.select(*keep, F.col(record).alias("_record"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", " * bool(keep) + f"fingerprint string, layout string, turns {TURNS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        selection = Selection(mappings)
        for b in batches:
            got = [record_turns(r, selection) for r in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], TURN_TYPE)], names=[*keep, "fingerprint", "layout", "turns"])

    return source.mapInArrow(tidy(run), schema)


def turns_of_rows(rows: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Conversation id and ``turns`` of a table with a row for each turn; the fingerprint of its columns selects the mapping.

    A table of no known layout is an error, as it has no rows to keep apart.
    """
    found, m = Selection(mappings).choose(paths_of_schema(rows.schema), rows=True)
    if m is None or not m.rows:
        raise ValueError(f"unknown layout {found}: {sorted(paths_of_schema(rows.schema))}")
    conversation, order, role, text = m.rows
    name = F.coalesce(F.col(role), F.lit(""))
    if m.roles:
        name = F.coalesce(F.create_map(*[F.lit(x) for kv in m.roles.items() for x in kv])[name], name)
    entry = F.struct(F.col(order).alias("at"), name.alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return rows.groupBy(conversation).agg(turns.alias("turns"))


# Control strings of this template and of other common ones start like this; a backslash goes after their first character.
CONTROL = re.compile(r"\\|([<\[])(?=\||/?INST\]|/?s>|</?SYS>>|/?SYS>>)")
ESCAPED = re.compile(r"\\(\\?)")
MARKS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1]}\\" if m[1] else "\\\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[dict], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the code-point spans under the loss mask."""
    parts, at, spans = [], 0, []
    for t in turns:
        head, body = f"{TURN}{escape(t['role'] or '')}{TEXT}", escape(t["text"] or "")
        if t["role"] == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in MARKS.findall(formatted)]


def format_turns(df: DataFrame, keep: tuple[str, ...] = ("conv_id",), loss_role: str = "assistant") -> DataFrame:
    """``keep`` columns, ``formatted string`` and ``loss_spans array<struct<start,end>>``."""
    source = df.select(*keep, "turns")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", formatted string, loss_spans array<struct<start int, end int>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render(t or [], loss_role) for t in b.column(len(keep)).to_pylist()]
            spans = [[{"start": x, "end": y} for x, y in s] for _, s in made]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array([f for f, _ in made], type=pa.string()), pa.array(spans, type=kind)], names=[*keep, "formatted", "loss_spans"])

    return source.mapInArrow(tidy(run), schema)


def read_back(formatted: DataFrame, keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """``keep`` columns, ``turns`` and ``loss_text`` (unescaped) read from formatted conversations alone."""
    source = formatted.select(*keep, "formatted", "loss_spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-2]) + f", turns {TURNS}, loss_text string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse(f)] for f in texts]
            loss = ["".join(unescape(f[s["start"] : s["end"]]) for s in x) for f, x in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(turns, type=TURN_TYPE), pa.array(loss, type=pa.string()), pa.array([len(f) for f in texts], type=pa.int64())], names=[*keep, "turns", "loss_text", "formatted_chars"])

    return source.mapInArrow(tidy(run), schema)
