"""Chat formatting by schema fingerprint.

A record is JSON. The hash of its nested field paths selects a declarative mapping to canonical turns (role,
text); records of a layout seen before cost one lookup. Turns are written in a template whose control strings
are escaped inside roles and texts in a way that parse() undoes.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BEGIN, MIDDLE, END = "<|turn|>", "\n", "<|end|>\n"

#: Strings that templates and vocabularies in public use give a meaning: a first character and a rest.
_CONTROL = r"(<)(\\*)(\||s>|/s>|<SYS>>|</SYS>>)|(\[)(\\*)(/?INST\])"


def escape(text: str) -> str:
    """Put one more backslash after the first character of each control string, escaped ones included."""
    return re.sub(_CONTROL, lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return re.sub(_CONTROL, lambda m: f"{m[1] or m[4]}{(m[2] or m[5] or '')[1:]}{m[3] or m[6]}", text)


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    turns: path of a list of turns, with the names of role and text in it; or fixed: (role, path) pairs in
    order, of which the empty ones are left out. roles renames roles. history: path of earlier turns of a fixed layout,
    pairs of a user's and an assistant's text, or turns like those of messages; they come after the system's.
    """

    needs: frozenset[str]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, str], ...] = ()
    history: str = "history"
    roles: dict[str, str] = field(default_factory=dict)


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
MAPPINGS = [
    Mapping(frozenset({"messages[].role", "messages[].content"}), "messages", roles=_NAMES),
    Mapping(frozenset({"conversations[].from", "conversations[].value"}), "conversations", "from", "value", roles=_NAMES),
    Mapping(frozenset({"conversation[].role", "conversation[].content"}), "conversation", roles=_NAMES),
    Mapping(frozenset({"turns[].speaker", "turns[].text"}), "turns", "speaker", "text", roles=_NAMES),
    Mapping(frozenset({"[].role", "[].content"}), "", roles=_NAMES),
    Mapping(frozenset({"instruction", "output"}), fixed=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(frozenset({"instruction", "response"}), fixed=(("system", "system"), ("user", "instruction"), ("user", "context"), ("assistant", "response"))),
    Mapping(frozenset({"prompt", "completion"}), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping(frozenset({"prompt", "response"}), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping(frozenset({"question", "answer"}), fixed=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
]


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; [] stands for the items of a list."""
    todo, out = [(value, at)], set()
    while todo:
        v, at = todo.pop()
        if isinstance(v, dict) and v:
            todo += [(x, f"{at}.{k}" if at else k) for k, x in v.items()]
        elif isinstance(v, list) and v:
            todo += [(x, at + "[]") for x in v]
        else:
            out.add(at + ("{}" if isinstance(v, dict) else "[]" if isinstance(v, list) else ""))
    return out


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


class Layouts:
    """Mappings by fingerprint; a layout is resolved once, to the mapping that needs most of what it has."""

    def __init__(self, mappings: list[Mapping]):
        self.mappings, self.known = mappings, {fingerprint(set(m.needs)): m for m in mappings}

    def of(self, record) -> tuple[str, Mapping | None]:
        found = paths(record)
        f = fingerprint(found)
        # a text may come in parts
        found |= {f"{m.turns}[].{m.text}" for m in self.mappings if m.turns is not None and any(p.startswith(f"{m.turns}[].{m.text}[]") for p in found)}
        if f not in self.known:
            empty = [m for m in self.mappings if m.turns is not None and m.turns + "[]" in found]
            fit = [m for m in self.mappings if m.needs <= found] or empty
            if len(self.known) > 10_000:  # layouts come from data: forget rather than grow
                self.known = {}
            self.known[f] = max(fit, key=lambda m: len(m.needs), default=None)
        return f, self.known[f]


def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


#: Fields of a record that say something of the conversation, if no mapping reads them.
CONVERSATIONAL = ("messages", "conversations", "conversation", "turns", "history", "system", "instruction", "input", "output", "prompt", "completion", "response", "context", "question", "answer", "tools", "tool_calls", "function_call", "functions", "rejected", "chosen")


def _parts(v, at: str, left: list[str]) -> str:
    """A text, or the texts among its parts (strings, or objects with a string `text`), one after the other."""
    if not isinstance(v, list):
        return _text(v)
    out = []
    for k, x in enumerate(v):
        text = x.get("text") if isinstance(x, dict) else x
        if isinstance(text, str):
            out.append(text)
        if not isinstance(text, str) or isinstance(x, dict) and any(y not in (None, "", [], {}) for n, y in x.items() if n not in ("text", "type")):
            left.append(f"{at}[{k}]")
    return "".join(out)


def _listed(items, role: str, text: str, roles: dict[str, str], at: str, left: list[str]) -> list[tuple[str, str]]:
    out = []
    for k, i in enumerate(items):
        if not isinstance(i, dict):
            left += [f"{at}[{k}]"] if i not in (None, "", [], {}) else []
            continue
        if len(i) > 2 or role not in i or text not in i:
            left += [f"{at}[{k}].{n}" for n, v in i.items() if n not in (role, text) and v not in (None, "", [], {})]
        r = _text(i.get(role))
        out.append((roles.get(r, r), _parts(i.get(text), f"{at}[{k}].{text}", left)))
    return out


def _earlier(items, m: Mapping, left: list[str]) -> list[tuple[str, str]]:
    if not isinstance(items, list):
        left += [m.history] if items not in (None, "", {}) else []
        return []
    out = []
    for k, x in enumerate(items):
        if isinstance(x, list) and len(x) == 2 and all(t is None or isinstance(t, str) for t in x):
            out += [(r, t) for r, t in zip(("user", "assistant"), x) if t]
        elif isinstance(x, dict) and "role" in x and "content" in x:
            out += _listed([x], "role", "content", _NAMES, f"{m.history}[{k}]", left)
        elif x not in (None, "", [], {}):
            left.append(f"{m.history}[{k}]")
    return out


def turns_of(record, m: Mapping) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns, and what they leave over of the conversation: paths of values that are not empty and were not read."""
    left: list[str] = []
    if m.turns is not None:
        items, read = (record, ()) if m.turns == "" else (record.get(m.turns) or [], (m.turns,))
        out = _listed(items, m.role, m.text, m.roles, m.turns, left)
    else:
        given = [(role, _text(record[p])) for role, p in m.fixed if record.get(p) not in (None, "")]
        n = sum(role == "system" for role, _ in given[:1])
        out = [*given[:n], *_earlier(record.get(m.history), m, left), *given[n:]]
        read = (*(p for _, p in m.fixed), m.history)
    if isinstance(record, dict) and len(record) > 1:
        left += [k for k, v in record.items() if k in CONVERSATIONAL and k not in read and v not in (None, "", [], {})]
    return out, left


def write(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (code points, end excluded) that count in the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = BEGIN + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + MIDDLE, escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that write() wrote."""
    out = []
    for part in formatted.split(BEGIN)[1:]:
        role, _, text = part.partition(MIDDLE)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        out.append((role, unescape(text[: -len(END)])))
    return out


_SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))


def format_chat(df: DataFrame, record_col: str = "record", learn: str = "assistant", mappings: list[Mapping] | None = None) -> DataFrame:
    """df with layout (fingerprint), status, formatted, loss_spans and left_over for the JSON records of record_col.

    status is ok, partial (turns are formatted, but parts of the conversation are not among them: left_over has their
    paths, such as items that are no turns, tool calls, images or fields of CONVERSATIONAL), invalid (null, not JSON, JSON that holds half a surrogate pair or is nested deeper than the parser
    or writer goes) or unknown (no mapping fits); the latter two have null formatted and no spans. Texts in parts are put together, histories come first. Null roles and texts are empty; texts that are not strings are written as JSON. An empty
    list of turns gives ''. Input columns of the result's names are replaced.
    """
    df = C.without(df, "layout", "status", "formatted", "loss_spans", "left_over")
    where = df.columns.index(record_col)

    def run(batches):
        layouts = Layouts(mappings or MAPPINGS)
        for b in batches:
            rows = []
            for x in b.column(where).to_pylist():
                try:
                    record = json.loads(x)
                    f, m = layouts.of(record)
                    turns, left = turns_of(record, m) if m else ([], [])
                    text, spans = write(turns, learn) if m else (None, [])
                    (text or "").encode()
                    "".join(left).encode()
                except (TypeError, ValueError, AttributeError, RecursionError):
                    rows.append((None, "invalid", None, [], []))
                    continue
                rows.append((f, ("partial" if left else "ok") if m else "unknown", text, [{"start": i, "end": j} for i, j in spans], left))
            f, s, t, p, o = (list(c) for c in zip(*rows)) if rows else ([], [], [], [], [])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f, pa.string()), pa.array(s, pa.string()), pa.array(t, pa.string()), pa.array(p, kind), pa.array(o, pa.list_(pa.string()))], [*b.schema.names, "layout", "status", "formatted", "loss_spans", "left_over"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields]).add("layout", "string").add("status", "string").add("formatted", "string").add("loss_spans", _SPANS).add("left_over", T.ArrayType(T.StringType())))


def read_chat(df: DataFrame, keep: list[str]) -> DataFrame:
    """What formatted and loss_spans hold, read back: keep, n_turns, transcript, loss_text and formatted_chars.

    transcript has role, line end, text, line end for each turn; loss_text is the unescaped text under the mask.
    """
    df = df.select(*keep, "formatted", "loss_spans")

    def run(batches):
        for b in batches:
            n = len(keep)
            rows = []
            for text, spans in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
                text = text or ""
                turns = parse(text)
                rows.append((len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), "".join(unescape(text[s["start"] : s["end"]]) for s in spans or []), len(text)))
            cols = [list(c) for c in zip(*rows)] if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], [*keep, "n_turns", "transcript", "loss_text", "formatted_chars"])

    out = T.StructType([df.schema[k] for k in keep]).add("n_turns", "long").add("transcript", "string").add("loss_text", "string").add("formatted_chars", "long")
    return df.mapInArrow(run, out)


_LISTS = {"messages": ("role", "content"), "conversations": ("from", "value"), "conversation": ("role", "content"), "turns": ("speaker", "text"), "": ("role", "content")}
_PAIRS = [("instruction", "output"), ("instruction", "response"), ("prompt", "completion"), ("prompt", "response"), ("question", "answer")]


def conversations_as_records(df: DataFrame, id_col: str = "conv_id", every_layout: bool = False) -> DataFrame:
    """Rows of single turns (id, turn, role, text) as one JSON record a conversation, in the layout of messages.

    Turns are ordered by turn, then role and text; null roles and texts are empty. every_layout deals conversations by
    the hash of their id over all layouts of turns, and those of one user's and one assistant's text, neither empty,
    over the layouts of pairs as well.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = F.sort_array(F.collect_list(F.struct("turn", text("role").alias("role"), text("text").alias("content"))))
    grouped = df.groupBy(id_col).agg(turns.alias("turns"))

    def listed(name, role, text):
        items = F.transform("turns", lambda t: F.struct(t["role"].alias(role), t["content"].alias(text)))
        return F.to_json(F.struct(items.alias(name)) if name else items)

    if not every_layout:
        return grouped.select(id_col, listed("messages", *_LISTS["messages"]).alias("record"))
    first, second = F.get("turns", F.lit(0)), F.get("turns", F.lit(1))
    pair = (F.size("turns") == 2) & (first["role"] == "user") & (second["role"] == "assistant") & (first["content"] != "") & (second["content"] != "")
    kind = F.pmod(F.xxhash64(id_col), F.when(F.coalesce(pair, F.lit(False)), len(_LISTS) + len(_PAIRS)).otherwise(len(_LISTS)))
    records = [listed(name, *fields) for name, fields in _LISTS.items()] + [F.to_json(F.struct(first["content"].alias(a), second["content"].alias(b))) for a, b in _PAIRS]
    record = F.coalesce(*[F.when(kind == k, r) for k, r in enumerate(records)])
    return grouped.select(id_col, record.alias("record"))
