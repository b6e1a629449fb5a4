"""Chat formatting by schema fingerprints: heterogeneous layouts to canonical turns, to marked text, and back.

A record's fingerprint is a hash of the sorted paths of its nested fields. It selects a declarative mapping, which says
where a record keeps its turns: known fingerprints from a table made of the mappings' own layouts, others by the first
mapping whose required paths they have. Turns are written with markers; marker strings inside texts are escaped and
come back as they were.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Other names of the two speakers, in layouts that use them.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """``turns``: a list's path with the fields of role and text in each element; else ``fields``: (role, path) in order.

    ``rows``: a record is one turn, with the fields of its conversation, place, role and text. ``roles``: names of
    roles that are replaced; all others stay as they are.
    """

    name: str
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def required(self) -> frozenset[str]:
        if self.rows:
            return frozenset(self.rows)
        if self.turns:
            at, role, text = self.turns
            return frozenset((f"{at}[].{role}", f"{at}[].{text}"))
        return frozenset(path for role, path in self.fields if not path.endswith("?"))

    @property
    def layouts(self) -> list[frozenset[str]]:
        """The sets of paths that records of this mapping usually have: with and without each optional one and an id."""
        optional = [path.rstrip("?") for _, path in self.fields if path.endswith("?")] + ([] if self.rows else ["id"])
        return [self.required | set(some) for k in range(len(optional) + 1) for some in combinations(optional, k)]


#: In order: the first that fits an unknown fingerprint is taken. A path that ends in ? may be missing or empty.
MAPPINGS = (
    Mapping("turn rows", rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", turns=("messages", "role", "content")),
    Mapping("conversations", turns=("conversations", "from", "value"), roles=tuple(ROLES.items())),
    Mapping("instruction", fields=(("system", "system?"), ("user", "instruction"), ("user+", "input?"), ("assistant", "output"))),
    Mapping("prompt and response", fields=(("system", "system?"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question and answer", fields=(("user", "question"), ("assistant", "answer"))),
)


def paths_of(value: object, at: str = "") -> set[str]:
    """Of the nested fields of a JSON value; list elements share the path ``[]``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths_of(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths_of(v, f"{at}[]")} or {at}
    return {at}


def paths_of_type(kind: T.DataType, at: str = "") -> set[str]:
    """The same of a column type or a table's schema."""
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in paths_of_type(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return paths_of_type(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Which mapping a known fingerprint selects.
FINGERPRINTS = {fingerprint(paths): mapping for mapping in reversed(MAPPINGS) for paths in mapping.layouts}


@lru_cache(1 << 14)
def _by_paths(paths: frozenset[str]) -> Mapping | None:
    return next((m for m in MAPPINGS if m.required <= paths), None)


def mapping_for(paths: set[str]) -> Mapping | None:
    """By the table of fingerprints; for a new one by its paths. None: no mapping fits."""
    return FINGERPRINTS.get(fingerprint(paths)) or _by_paths(frozenset(paths))


def _get(value: object, path: str) -> object:
    for part in path.rstrip("?").split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    if mapping.turns:
        at, role, text = mapping.turns
        found = [(_text(_get(x, role)), _text(_get(x, text))) for x in _get(record, at) or []]
    elif mapping.rows:
        found = [(_text(record.get(mapping.rows[2])), _text(record.get(mapping.rows[3])))]
    else:
        found = []
        for role, path in mapping.fields:
            text = _text(_get(record, path))
            if role.endswith("+"):  # goes on in the turn before
                if text:
                    found[-1] = (found[-1][0], f"{found[-1][1]}\n{text}")
            elif text or not path.endswith("?"):
                found.append((role, text))
    roles = dict(mapping.roles)
    return [(roles.get(role, role), text) for role, text in found]


def _turns_of(raw: str | None) -> tuple[str | None, list[tuple[int, str | None, str | None]], str]:
    """The layout, turns and fingerprint of a record; where it can't be read, no layout and one turn of nulls."""
    paths: set[str] = set()
    try:
        record = json.loads(raw or "")
        paths = paths_of(record) if isinstance(record, dict) else set()
        if (mapping := mapping_for(paths)) is None:
            raise ValueError("no mapping")
        first = record.get(mapping.rows[1]) if mapping.rows else 0
        first = 0 if first is None else first
        if not isinstance(first, int) or not 0 <= first < 1 << 62 or mapping.turns and not isinstance(_get(record, mapping.turns[0]), list):
            raise ValueError("no place in a conversation, or turns that aren't a list")
        turns = [(first + k, role, text) for k, (role, text) in enumerate(canonical(record, mapping))]
        "".join(x for _, role, text in turns for x in (role, text)).encode()
        return mapping.name, turns, fingerprint(paths)
    except (ValueError, RecursionError):  # not JSON, nested too deep, or text with half a surrogate pair
        return None, [(0, None, None)], fingerprint({p for p in paths if p.isprintable()})


def turns_of_records(rows: DataFrame, column: str = "record", key: str = "conv_id") -> DataFrame:
    """``rows``: a key and a JSON string per conversation, of any known layout, mixed as they may be.

    Returns conv_id, turn, role, text, layout and fingerprint. A record gives one row with null layout, role and text,
    so none is lost, if it is null or no JSON object, nested too deep, has half a surrogate pair in a text or a place
    that is no whole number from 0, or if no mapping fits it. Empty lists of turns give no row. Null keys and repeated
    records are as any other. Other columns are ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                layout, turns, seen = _turns_of(raw)
                out += [(name, turn, role, text, layout, seen) for turn, role, text in turns]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "turn", "role", "text", "layout", "fingerprint"])

    return rows.select(F.col(key).cast("long"), F.col(column).cast("string")).mapInArrow(run, "conv_id long, turn long, role string, text string, layout string, fingerprint string")


def turns_of_table(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table with a turn per row, whose schema's fingerprint selects the mapping.

    Roles stay as they are stored; null roles and texts are empty, null ids and places stay null, repeated rows are
    turns of their own. Other columns are left out. An empty table gives no rows.
    """
    mapping = mapping_for(paths_of_type(table.schema))
    if mapping is None or mapping.rows is None:
        raise ValueError("no mapping for turns in rows fits the table's columns")
    conv, turn, role, text = map(F.col, mapping.rows)
    empty = F.lit("")
    return table.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))


# The template. BEGIN role NEWLINE text END, per turn. ESCAPE is the one character that texts can't have as it is:
# every marker and control string of known templates that a text contains is broken up by it, and so is ESCAPE; a line
# feed in a role is ESCAPE and n.
BEGIN, END, ESCAPE = "<|turn|>", "<|done|>", "␛"
#: Control strings of common chat templates, and this one's.
CONTROLS = (BEGIN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "<unk>", "<pad>")


def escaped(text):
    """A Column of a Column: ESCAPE is doubled, and stands after the first character of each control string.

    Every control string begins with ``<`` or ``[``; the escape is put after those two wherever they stand, so none
    comes out whole, whatever else the text has.
    """
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE))
    for mark in ("<", "["):
        text = F.replace(text, F.lit(mark), F.lit(mark + ESCAPE))
    return text


def unescaped(text: str) -> str:
    """In one pass, as an escape after a mark and a doubled escape may stand side by side."""
    if ESCAPE not in text:
        return text
    out, at = [], 0
    while at < len(text):
        c = text[at]
        out.append("\n" if c == ESCAPE and text[at + 1] == "n" else c)
        at += 2 if c in "<[" or c == ESCAPE else 1
    return "".join(out)


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text): a row per turn with its ``segment`` of the conversation's formatted text.

    Segments of a conversation in order of turn, end to end, are its text; it is never put together in one value, so
    a conversation may be larger than a task's memory. Of equal turns the order is by segment. Nulls in role and text
    are empty; a null conv_id is a conversation, a null turn comes first. Other columns are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    in_role = F.replace(escaped(role), F.lit("\n"), F.lit(ESCAPE + "n"))
    segment = F.concat(F.lit(BEGIN), in_role, F.lit("\n"), escaped(text), F.lit(END))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), segment.alias("segment"))


def write_formatted(turns: DataFrame, path: str) -> None:
    """The segments of ``format_turns`` as a Parquet table. An empty table gives an empty one."""
    format_turns(turns).write.parquet(path)


class Parser:
    """Reads one conversation's text as it comes in parts; holds one turn at a time."""

    def __init__(self):
        self.waiting, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, part: str) -> None:
        self.chars += len(part)
        self.waiting += part
        while (end := self.waiting.find(END)) >= 0:
            if not self.waiting.startswith(BEGIN):
                raise ValueError("a turn doesn't begin with its marker")
            role, _, text = self.waiting[len(BEGIN) : end].partition("\n")
            role, text = unescaped(role), unescaped(text)
            self.waiting = self.waiting[end + len(END) :]
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == "assistant":  # the loss mask covers assistants' texts, without markers
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def done(self) -> tuple[int, str, int, str, int]:
        if self.waiting:
            raise ValueError("the text ends within a turn")
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, parser, out = None, None, []

    def rows() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in READ.split(", ")])

    for batch in batches:
        for name, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if parser is None or name != now:
                if parser is not None:
                    out.append((now, *parser.done()))
                now, parser = name, Parser()
            parser.feed(segment)
        if len(out) > 5000:
            yield rows()
            out = []
    if parser is not None:
        out.append((now, *parser.done()))
    if out:
        yield rows()


def read_formatted(spark: SparkSession, path: str) -> DataFrame:
    """Per conversation of a table by ``write_formatted``, read back from its text: counts and digests of turns and of
    the loss mask.

    Segments go to their conversation's task in order and are parsed as a stream, with one turn in memory; the digest
    of a conversation's turns needs them one after another, however many they are. A null conv_id is a conversation;
    repeated turns are read as often as they were written. An empty table gives no rows. A text that doesn't have the
    template's form fails the read.
    """
    ordered = spark.read.parquet(path).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.select("conv_id", "segment").mapInArrow(_parsed, READ)
