"""Chat records of many layouts as one marked text with a loss mask.

A record's schema fingerprint is the hash of its nested field paths. It selects a declarative mapping that says where
roles and texts stand; records whose fingerprint no mapping knows are reported, not guessed at. Canonical turns are
then marked by a template, and control strings inside texts are escaped so that reading back gives the same turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"
TURNS = "array<struct<role string, text string>>"


@dataclass(frozen=True)
class Mapping:
    """Where turns stand. fields: (role, paths) one by one, whose texts are joined by a blank line; listed: the path of a
    list that follows, with its role and text fields. A text may be given in parts, by parts: the path of their texts and
    of their kinds below the text field. order: the list's field to sort turns by. roles: usual names of the list's roles."""

    name: str
    listed: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    order: str | None = None
    optional: tuple[str, ...] = ()
    parts: tuple[str, str] | None = None
    calls: str | None = None
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[frozenset[str]]:
        """The sets of field paths that this mapping reads: with and without optional fields, and with a list's texts plain,
        in parts or both."""
        whole = frozenset(p for _, ps in self.fields for p in ps)
        out = [whole - {*left_out} for n in range(len(self.optional) + 1) for left_out in combinations(self.optional, n)]
        if not self.listed:
            return out
        path, role, text = self.listed
        fixed = frozenset(f"{path}[].{x}" for x in (role, self.order) if x)
        plain, in_parts = frozenset([f"{path}[].{text}"]), frozenset(f"{path}[].{text}[].{x}" for x in self.parts or ())
        texts = (plain, in_parts, plain | in_parts) if self.parts else (plain,)
        calls = (frozenset(), frozenset([f"{path}[].{self.calls}"])) if self.calls else (frozenset(),)
        return [o | fixed | t | c for o in out for t in texts for c in calls]


# The common public layouts, and the roles they use under other names.
SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("chatbot", "assistant"))
MAPPINGS = (
    Mapping("messages", listed=("messages", "role", "content"), parts=("text", "type"), calls="tool_calls"),
    Mapping("messages with system", fields=(("system", ("system",)),), listed=("messages", "role", "content"), parts=("text", "type"), calls="tool_calls"),
    Mapping("ordered turns", listed=("turns", "role", "text"), order="turn"),
    Mapping("speakers", fields=(("system", ("system",)),), listed=("conversations", "from", "value"), optional=("system",), roles=SPEAKERS),
    Mapping("instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Mapping("instruction with context", fields=(("system", ("system",)), ("user", ("instruction", "context")), ("assistant", ("response",))), optional=("system", "context")),
    Mapping("prompt", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Mapping("prompt with response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("question", fields=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",))), optional=("system",)),
    Mapping("question with context", fields=(("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",))), optional=("system",)),
)
# Fields about a record, whatever they hold; they are left out of the text. All other fields that hold text
# and that the record's mapping doesn't name make its layout unknown.
METADATA = frozenset(
    "id ids uuid conv_id conversation_id dialog_id message_id messages[].id messages[].name messages[].tool_call_id conversations[].id turns[].id"
    " source sources dataset split license lang language url category tags topic model score rating created created_at timestamp date hash meta metadata".split()
)
SURROGATE = re.compile("[\ud800-\udfff]")


class Unfit(ValueError):
    """A record whose values aren't what its layout's fields hold."""


def field_paths(value, at: str = "", whole: frozenset[str] = frozenset()) -> set[str]:
    """Paths of all leaves; list elements share the path with []. Nulls and empty lists count as leaves, and so does what
    stands at a path in whole."""
    if at in whole:
        return {at}
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k, whole)}
    if isinstance(value, list) and value:
        return {p for v in value for p in field_paths(v, f"{at}[]", whole)}
    return {at}


def text_paths(value, at: str = "", whole: frozenset[str] = METADATA) -> set[str]:
    """Paths at which text stands that isn't empty, but for those in whole."""
    if at in whole:
        return set()
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in text_paths(v, f"{at}.{k}" if at else k, whole)}
    if isinstance(value, list):
        return {p for v in value for p in text_paths(v, f"{at}[]", whole)}
    return {at} if isinstance(value, str) and value else set()


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Layouts:
    """Mappings by fingerprint. Paths that no mapping names count towards it where they hold text, but for METADATA."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.known = frozenset(p for m in mappings for ps in m.paths() for p in ps)
        self.calls = frozenset(f"{m.listed[0]}[].{m.calls}" for m in mappings if m.listed and m.calls)
        self.by_print: dict[str, Mapping] = {}
        for m in mappings:
            for paths in m.paths():
                self.by_print.setdefault(fingerprint(paths), m)

    def of(self, record) -> tuple[str, Mapping | None]:
        paths = field_paths(record, whole=self.calls) & self.known
        name = fingerprint(paths | text_paths(record, whole=METADATA | self.calls))
        return name, self.by_print.get(name)


def _text(value, parts: tuple[str, str] | None = None) -> str:
    """A text as given, null as empty, numbers as JSON writes them; texts in parts are joined by \\n."""
    if value is None:
        return ""
    if isinstance(value, str):
        return SURROGATE.sub("\ufffd", value)
    if isinstance(value, (bool, int, float)):
        return json.dumps(value)
    if parts and isinstance(value, list):
        text, kind = parts
        if all(isinstance(x, str) or isinstance(x, dict) and x.get(kind, "text") == "text" and isinstance(x.get(text), str) for x in value):
            return "\n".join(_text(x if isinstance(x, str) else x[text]) for x in value)
    raise Unfit("no text")


def canonical_turns(record, m: Mapping) -> list[tuple[str, str]]:
    """(role, text) in order. Null texts are empty, a null or empty system text is no turn; roles under other names get
    their usual one. Values of other kinds (parts that aren't text, places that aren't numbers) raise Unfit."""
    turns = []
    for role, paths in m.fields:
        texts = [t for p in paths if (t := _text(record.get(p)))]
        if texts or role != "system":
            turns.append((role, "\n\n".join(texts)))
    if m.listed:
        path, role, text = m.listed
        items, usual = record[path], dict(m.roles)
        if not isinstance(items, list) or not all(isinstance(x, dict) and isinstance(x.get(role), str | None) for x in items):
            raise Unfit("no list of turns")
        if m.order:
            if not all(type(x.get(m.order)) in (int, float, type(None)) for x in items):
                raise Unfit("places of turns aren't numbers")
            items = sorted(items, key=lambda x: (x.get(m.order) is None, x.get(m.order) or 0))
        for x in items:
            said = [_text(x.get(text), m.parts)]
            if m.calls and x.get(m.calls):
                said.append(SURROGATE.sub("\ufffd", json.dumps(x[m.calls], ensure_ascii=False)))
            r = _text(x.get(role))
            turns.append((usual.get(r, r), "\n\n".join(t for t in said if t)))
    return turns


def formatted_record(record: str | None, layouts: Layouts) -> tuple:
    """(fingerprint, layout, formatted, loss mask) of a JSON record; all that can't be read is null."""
    try:
        r = json.loads(record) if record is not None else None
        if r is None:
            return None, None, None, None
        name, m = layouts.of(r)
    except (ValueError, RecursionError):
        return None, None, None, None
    try:
        return (name, m.name, *render(canonical_turns(r, m))) if m else (name, None, None, None)
    except Unfit:
        return name, None, None, None


def escape(text: str) -> str:
    """text without <| : a backslash more after each < that backslashes (or none) and | follow."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The marked text, and the loss mask as [from, to) code points: the assistant's texts."""
    out, mask, size = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LEARNT:
            mask.append((size + len(head), size + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        size += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a marked text. Control strings stand only where the template put them."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part[: part.rindex(END)].partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def format_chat(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Struct of fingerprint, layout, formatted and loss_mask (pairs of code points) of a JSON record.

    Records of unknown layout (an empty list of turns included), those whose values don't fit their layout, null records
    and broken JSON have null in layout and formatted, and no record ends the job. Lone surrogates become U+FFFD.
    """

    @F.pandas_udf("fingerprint string, layout string, formatted string, loss_mask array<array<int>>")
    def formatted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        layouts = Layouts(mappings)
        for records in batches:
            done = pd.DataFrame([formatted_record(r, layouts) for r in records], columns=["fingerprint", "layout", "formatted", "loss_mask"], dtype=object)
            done["loss_mask"] = done["loss_mask"].map(lambda x: None if x is None else [list(p) for p in x])
            yield done

    return formatted(record)


def digests(formatted: Column, mask: Column) -> Column:
    """Struct n_turns, turns_sha256, loss_chars, loss_sha256, read back from the marked text and its mask."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    def digest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, masks in batches:
            out = []
            for text, spans in zip(texts, masks, strict=True):
                if text is None:
                    out.append((None, None, None, None))
                    continue
                turns = read_back(text)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                learnt = "".join(unescape(text[a:b]) for a, b in spans)
                out.append((len(turns), whole, len(learnt), hashlib.sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    return digest(formatted, mask)
