"""Chat formatting by schema fingerprints.

A record is JSON. Its nested field paths (list positions dropped) are sorted and
hashed; the hash selects a declarative mapping that turns the record into canonical
turns (role, text). Turns are written with one template and can be read back from it.

Template: ``<s>role\\ntext</s>`` per turn, nothing between. A backslash escapes
itself, the control strings in role and text, and a line feed in the role. The loss
mask holds the spans of the assistants' texts.

Defined results: null role or text is empty; turns with one number are ordered by
role, then text; a record of unknown layout, or no JSON object, has null turns and is
returned with its fingerprint; a wrong type anywhere makes an unknown layout; an empty
or null list of turns gives no turns; optional keys are ignored; repeated rows are separate turns; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: paths of a layout -> (list path, role key, text key) or ordered (role, field) pairs; a list path is a path too, and a
#: path that holds anything but strings and nulls has its type's name behind it, so it belongs to none of these layouts
LAYOUTS = {
    ("turns", "turns[].role", "turns[].text"): ("turns", "role", "text"),
    ("messages", "messages[].content", "messages[].role"): ("messages", "role", "content"),
    ("messages", "messages[].content", "messages[].content[].text", "messages[].content[].type", "messages[].role"): ("messages", "role", "content"),
    ("conversations", "conversations[].from", "conversations[].value"): ("conversations", "from", "value"),
    ("turns",): ("turns", "role", "text"),
    ("messages",): ("messages", "role", "content"),
    ("conversations",): ("conversations", "from", "value"),
    ("instruction", "output"): [("user", "instruction"), ("assistant", "output")],
    ("input", "instruction", "output"): [("user", "instruction"), ("user", "input"), ("assistant", "output")],
    ("completion", "prompt"): [("user", "prompt"), ("assistant", "completion")],
    ("prompt", "response"): [("user", "prompt"), ("assistant", "response")],
    ("answer", "question"): [("user", "question"), ("assistant", "answer")],
    ("response", "system", "user"): [("system", "system"), ("user", "user"), ("assistant", "response")],
}
#: paths that a record may have besides, whatever they hold
OPTIONAL = frozenset(("id", "source", "messages[].name", "messages[].id", "turns[].name", "turns[].id"))
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
RENAMED = frozenset({"conversations"})   # layouts whose role names are mapped by ROLES
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]")
_SCAN = re.compile(r"\\(.)|<s>|</s>|\n", re.S)


def field_paths(value, path="") -> set:
    """Nested field paths of a record, list positions dropped, without the optional ones."""
    if path in OPTIONAL:
        return set()
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items())) if value else {f"{path}:object"}
    if isinstance(value, list):
        return {path}.union(*(field_paths(v, f"{path}[]") for v in value))
    return {path if value is None or isinstance(value, str) else f"{path}:{type(value).__name__}"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()[:16]


MAPPINGS = {fingerprint(p): m for p, m in LAYOUTS.items()}


def canonical_turns(record):
    """(fingerprint, [(role, text)] or None) of one parsed record."""
    fp = fingerprint(field_paths(record))
    m = MAPPINGS.get(fp)
    if m is None or not isinstance(record, dict):
        return fp, None
    if isinstance(m, tuple):
        turns = record[m[0]]
        if turns is not None and not isinstance(turns, list):
            return fp, None
        names = ROLES if m[0] in RENAMED else {}
        return fp, [(names.get(t.get(m[1]), t.get(m[1])) or "", _text(t.get(m[2]))) for t in turns or ()]
    return fp, [(role, record[f] or "") for role, f in m if f != "input" or record[f]]


def _text(content) -> str:
    """A content is a string, or a list of parts whose texts follow each other."""
    if isinstance(content, list):
        return "".join(p.get("text") or "" for p in content)
    return content or ""


def _escape(text: str) -> str:
    return CONTROL.sub(lambda x: "\\" + x[0], text)


def _unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns):
    """(formatted text, [(start, end)] of the assistants' texts in it)."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head = "<s>" + _escape(role).replace("\n", "\\\n") + "\n"
        body = _escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(out), spans


def read_turns(formatted: str):
    """The turns of a formatted text."""
    turns, start, role = [], 0, None
    for m in _SCAN.finditer(formatted):
        if m[1] is not None:
            continue
        if m[0] == "<s>":
            start, role = m.end(), None
        elif m[0] == "\n":
            if role is None:
                role, start = _unescape(formatted[start:m.start()]), m.end()
        else:
            turns.append((role, _unescape(formatted[start:m.start()])))
    return turns


def format_records(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """(id, fingerprint, turns, formatted, loss_spans): one row per record."""
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches):
        for b in batches:
            cols = [[], [], [], []]
            for x in b.column(json_col):
                try:
                    record = json.loads(x.as_py() or "null")
                except ValueError:
                    record = None
                fp, turns = canonical_turns(record)
                text, spans = format_turns(turns) if turns is not None else (None, None)
                rows = (fp, turns and [{"role": r, "text": t} for r, t in turns], text, spans and [{"start": a, "stop": z} for a, z in spans])
                for c, v in zip(cols, rows):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(turn)),
                                              pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(span))],
                                             ["id", "fingerprint", "turns", "formatted", "loss_spans"])

    return df.select(F.col(id_col).cast("long").alias(id_col), json_col).mapInArrow(
        run, "id long, fingerprint string, turns array<struct<role:string,text:string>>, formatted string, "
             "loss_spans array<struct<start:bigint,stop:bigint>>")


def records_from_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, record JSON) from rows (conv_id, turn, role, text). One conversation is one record, in one of three
    layouts by its id: turns, messages, or messages whose contents are lists of parts."""
    empty = F.lit("")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))))

    def record(name, text, of):
        return F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), of(x["text"]).alias(text))).alias(name)))

    parts = record("messages", "content", lambda t: F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))))
    kind = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3))
    return (rows.groupBy("conv_id").agg(turns.alias("t"))
            .select("conv_id", F.when(kind == 0, record("turns", "text", lambda t: t)).when(kind == 1, record("messages", "content", lambda t: t))
                    .otherwise(parts).alias("record")))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted texts."""
    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for b in batches:
            rows = []
            for i, x, spans in zip(b.column("id").to_pylist(), b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist()):
                x = x or ""
                turns = read_turns(x)
                loss = "".join(_unescape(x[s["start"]:s["stop"]]) for s in spans or [])
                flat = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((i, len(turns), hashlib.sha256(flat.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(x)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return formatted.select("id", "formatted", "loss_spans").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
