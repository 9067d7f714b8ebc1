"""Chats of many layouts into one template: records are told apart by a fingerprint of their field paths, which selects a declared mapping.

Output is rows of formatted text with the spans of the loss mask; ``read_back`` parses it again.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "\n"
#: The role whose texts are learned.
LEARNED = "assistant"
#: Characters of formatted text from which on a conversation goes on in a further row.
ROW_CHARS = 1_000_000

TURNS = "conv_id long, turn long, place long, role string, text string"
FORMATTED = "conv_id long, part long, formatted string, loss array<struct<begin:long,end:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Layout:
    """One layout. ``turns`` are (role, path of the text), where a role that begins with ``$`` is a path itself; paths go into lists
    by ``[]``. ``optional`` paths may be missing: texts of missing paths give no turn. ``joined`` paths are appended to the path they
    stand for, after an empty line. ``roles`` renames roles, ``order`` is the path of a turn's number in its conversation."""

    name: str
    turns: Sequence[tuple[str, str]]
    optional: Sequence[str] = ()
    joined: Mapping[str, str] = field(default_factory=dict)
    roles: Mapping[str, str] = field(default_factory=dict)
    order: str | None = None

    def paths(self) -> set[str]:
        return {p for role, text in self.turns for p in (role[1:] if role.startswith("$") else None, text) if p} | set(self.joined.values()) | ({self.order} if self.order else set())


#: Layouts of public chat and instruction datasets.
LAYOUTS = (
    Layout("turn_rows", [("$role", "text")], order="turn"),
    Layout("messages", [("$messages[].role", "messages[].content")]),
    Layout("conversations", [("system", "system"), ("$conversations[].from", "conversations[].value")], optional=["system"],
             roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", [("user", "instruction"), ("assistant", "output")], optional=["input"], joined={"instruction": "input"}),
    Layout("prompt", [("system", "system"), ("user", "prompt"), ("assistant", "completion")], optional=["system"]),
    Layout("response", [("system", "system"), ("user", "prompt"), ("assistant", "response")], optional=["system"]),
    Layout("question", [("user", "question"), ("assistant", "answer")]),
)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves: names joined by dots, ``[]`` for the elements of a list; an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, at + "[]") for v in value))
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def select_layouts(layouts: Sequence[Layout]) -> tuple[dict[str, Layout], set[str]]:
    """Each layout under the fingerprints of its paths with and without its optional ones, and all known paths and the lists and objects
    that they go through (a text where a list is expected thus makes another fingerprint).

    Two layouts that share a fingerprint are refused."""
    chosen: dict[str, Layout] = {}
    for m in layouts:
        whole = m.paths()
        for k in range(len(m.optional) + 1):
            for out in itertools.combinations(m.optional, k):
                if chosen.setdefault(f := fingerprint(whole - set(out)), m) is not m:
                    raise ValueError(f"layouts {chosen[f].name} and {m.name} have the same paths")
    known = set().union(*(m.paths() for m in layouts))
    return chosen, known | {p[:i] for p in known for i in range(len(p)) if p[i] in ".["} | {p[: i + 2] for p in known for i in range(len(p)) if p[i : i + 2] == "[]"}


def _get(record: dict, path: str):
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _turns(record: dict, m: Layout, paths: set[str]) -> Iterator[tuple[int | None, int, str, str]]:
    """Turns of one record: number, place in the record, role, text."""
    number, place = _as_number(_get(record, m.order)) if m.order else None, 0
    for role, text in m.turns:
        if text not in paths:
            continue
        head, _, tail = text.partition("[].")
        each = (_get(record, head) or []) if tail else [record]
        for one in each:
            value = _get(one, tail or text) if isinstance(one, dict) else None
            if not tail and text in m.joined and _get(one, m.joined[text]):
                value = f"{_as_text(value)}\n\n{_as_text(_get(one, m.joined[text]))}"
            name = _get(one, role[1:].partition("[].")[2] or role[1:]) if role.startswith("$") and isinstance(one, dict) else role
            name = _as_text(name)
            yield number, place, m.roles.get(name, name), _as_text(value)
            place += 1


_LONE = re.compile("[\ud800-\udfff]")


def _as_text(value) -> str:
    """Null is empty, what is no text is json; half a surrogate pair, which no UTF-8 text can hold, is U+FFFD."""
    return "" if value is None else _LONE.sub("\ufffd", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def _as_number(value) -> int | None:
    """A turn's number; what is no 64-bit integer is null."""
    return value if type(value) is int and -(2**63) <= value < 2**63 else None


def canonical_turns(records: DataFrame, *, layouts: Sequence[Layout] = LAYOUTS, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """``conv_id, turn, place, role, text, layout, fingerprint`` of records (json text), a row for each turn.

    A record's fingerprint is the hash of those of its nested field paths that any layout knows (other fields are ignored), so a field
    that is null counts and one that is missing does not. Records without a layout (malformed json too) are kept as one row with a null
    ``layout`` and the record as text: ``split_unknown`` parts them, and nothing is guessed. Null texts and roles are empty.
    """
    chosen, known = select_layouts(layouts)
    fields = "conv_id long, turn long, place long, role string, text string, layout string, fingerprint string"
    names = [n.split()[0] for n in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[frozenset[str], str] = {}
        for batch in batches:
            out: list[tuple] = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                paths = frozenset(field_paths(record) & known) if isinstance(record, dict) else frozenset()
                if (mark := seen.get(paths)) is None:
                    mark = seen[paths] = fingerprint(set(paths))
                layout = chosen.get(mark)
                if layout is None:
                    out.append((conv, None, 0, None, text, None, mark))
                    continue
                out += [(conv, n, place, role, said, layout.name, mark) for n, place, role, said in _turns(record, layout, set(paths))]
            types = [pa.int64()] * 3 + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return records.select(F.col(id_col).cast("long"), F.col(record_col)).mapInArrow(run, fields)


def split_unknown(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns, and records that no layout fits (``conv_id, fingerprint, record``)."""
    known = turns.where("layout IS NOT NULL").select("conv_id", "turn", "place", "role", "text")
    return known, turns.where("layout IS NULL").select("conv_id", "fingerprint", F.col("text").alias("record"))


_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""No ``<|`` is left: each gets a backslash between its letters, and one that has backslashes there gets one more."""
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    r"""Roles are one line: a line feed is ``\n``, a backslash two."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_chats(turns: DataFrame, *, learned: str = LEARNED, row_chars: int = ROW_CHARS) -> DataFrame:
    """``conv_id, part, formatted, loss`` of turns (``conv_id, turn, place, role, text``): whole turns in the template, in order.

    A conversation is one row, or, beyond ``row_chars``, several whose texts follow each other by ``part``. ``loss`` has the spans (code
    points of the row's text) under the mask: the texts of ``learned``. Rows of a conversation are consecutive and in order.

    Turns go to their conversation's task in order (turn, then place, role and text; nulls first) and are streamed: a task holds one
    output row, never a conversation. Turns without ``conv_id`` are one conversation without id. Control strings in texts and roles are escaped
    (``escape``), null texts and roles are empty. Repeated turns stay; an empty table gives no rows.
    """
    keys = ["conv_id", "turn", "place", "role", "text"]
    ordered = turns.select(*keys).repartition("conv_id").sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, at, loss = object(), 0, [], 0, []

        def row():
            return conv_row(now, part, "".join(held), loss)

        out: list[pa.RecordBatch] = []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if conv != now or at >= row_chars:
                    if held:
                        out.append(row())
                    part, held, at, loss = (part + 1 if conv == now else 0), [], 0, []
                    now = conv
                head, body = f"{START}{escape_role(role or '')}{BREAK}", escape(text or "")
                if (role or "") == learned:
                    loss.append((at + len(head), at + len(head) + len(body)))
                held += [head, body, END]
                at += len(head) + len(body) + len(END)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if held:
            yield row()

    return ordered.mapInArrow(run, FORMATTED)


def conv_row(conv: int | None, part: int, text: str, loss: list[tuple[int, int]]) -> pa.RecordBatch:
    spans = pa.array([[{"begin": a, "end": b} for a, b in loss]], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
    return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array([text], pa.string()), spans], names=["conv_id", "part", "formatted", "loss"])


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text; a text that is not of the template is an error."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        head = formatted.index(BREAK, at)
        end = formatted.index(END[:-1], head + 1)
        if not formatted.startswith(END, end):
            raise ValueError(f"no turn ends at {end}")
        yield unescape_role(formatted[at + len(START) : head]), unescape(formatted[head + 1 : end])
        at = end + len(END)


def read_back(formatted: DataFrame, *, in_order: bool = False) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of formatted rows.

    Turns are parsed out of the text, what is under the mask is cut out by its spans and unescaped; digests go on over the rows of a
    conversation, so none is held whole. ``in_order`` takes the rows as ``format_chats`` leaves them; stored rows are dealt and sorted first.
    """
    rows = formatted.select("conv_id", "part", "formatted", "loss")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        names = [f.split()[0] for f in DIGESTS.split(", ")]

        def result() -> tuple:
            return now, state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            done = []
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != now:
                    if state:
                        done.append(result())
                    now, state = conv, {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                for role, said in parse(text):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    learned = unescape(text[span["begin"] : span["end"]])
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
                state["size"] += len(text)
            if done:
                yield batch_of(done)
        if state:
            yield batch_of([result()])

    return rows.mapInArrow(run, DIGESTS)
