"""Chat formatting with a grammar round trip.

Grammar of the rendered text, one production per turn:

    turn  := "<s>[SYS] "  body " [/SYS]</s>"          role system
           | "<s>[INST] " body " [/INST]</s>"         role user
           | "<s>[OUT] "  body " [/OUT]</s>"          role assistant
           | "<s>[ROLE] " body "\\n" body " [/ROLE]</s>"   any other role, then its text

A body holds no control string.  A control string inside a text gets a
backslash behind its first character (one more, if backslashes stand there
already), which the parser takes away again, so escaping is reversible.  Each
turn is first rendered as it is; the rendered text is parsed, compared with
the source, and escaped and rendered anew until the parser gives the source
back.  Bodies that can't be misread stay untouched.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARKS = {"system": "SYS", "user": "INST", "assistant": "OUT"}
ROLES = {v: k for k, v in MARKS.items()}
_CONTROL = r"(?=/?(?:s>|(?:SYS|INST|OUT|ROLE)\]))"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<s>\[(SYS|INST|OUT|ROLE)\] (.*?) \[/\1\]</s>", re.S)
_ANY = re.compile(r"[<\[]" + _CONTROL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _render(mark: str, body: str) -> str:
    return f"<s>[{mark}] {body} [/{mark}]</s>"


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, start and end of its body; None if malformed."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None or _ANY.search(m[2]):
            return None
        start, end = m.span(2)
        if m[1] == "ROLE":
            role, cut, text = m[2].partition("\n")
            if not cut or unescape(_line(role)) in MARKS:
                return None
            start += len(role) + 1
            out.append((unescape(_line(role)), unescape(text), start, end))
        else:
            out.append((ROLES[m[1]], unescape(m[2]), start, end))
        at = m.end()
    return out


def _line(role: str) -> str:
    """Take back _one_line."""
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", role)


def _one_line(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def format_turn(role: str, text: str) -> str:
    """One turn, escaped only as far as its round trip needs."""
    mark = MARKS.get(role)
    name, body = role, text
    for _ in range(2):
        formatted = _render(mark, body) if mark else _render("ROLE", f"{_one_line(name)}\n{body}")
        read = parse(formatted)
        if read is not None and [r[:2] for r in read] == [(role, text)]:
            return formatted
        name, body = escape(name), escape(body)
    raise AssertionError("an escaped turn must read back as its source")


_TURNS = "conv_id long, turn long, role string, text string, formatted string"
_DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
            "formatted_chars long")


def _formatted(batches):
    for batch in batches:
        role = [x or "" for x in batch.column("role").to_pylist()]
        text = [x or "" for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), pa.array(role, pa.string()),
             pa.array(text, pa.string()),
             pa.array([format_turn(r, t) for r, t in zip(role, text)], pa.string())],
            ["conv_id", "turn", "role", "text", "formatted"])


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn with its rendered text; a conversation is their concatenation in order.

    turns: conv_id, turn, role, text; further columns are ignored.  A null role
    or text counts as empty; a null conv_id is a conversation of its own, a null
    turn stands first.  Turns with equal numbers are ordered by role and text;
    repeated rows are repeated turns.
    """
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
                        ).mapInArrow(_formatted, _TURNS)


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted):
        for role, text, start, end in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                learnt = unescape(formatted[start:end])
                self.loss_chars += len(learnt)
                self.loss.update(learnt.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self, conv_id):
        return (conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def _digests(batches):
    """Sorted rendered turns, read back one at a time; memory doesn't grow with a conversation."""
    now, digest, rows = None, None, []
    names = [c.split()[0] for c in _DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
    for b in batches:
        for conv_id, formatted in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist()):
            if digest is None or conv_id != now:
                if digest is not None:
                    rows.append(digest.row(now))
                now, digest = conv_id, _Digest()
            digest.add(formatted)
        if rows:
            yield batch()
            rows.clear()
    if digest is not None:
        rows.append(digest.row(now))
        yield batch()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the rendered turns: digests of turns and of the loss mask.

    The loss mask covers the bodies of assistant turns.  Rendering, escaping
    and checking run before the shuffle, spread over all rows; behind it one
    sorted pass per partition streams each conversation through a parser.
    """
    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "formatted").mapInArrow(_digests, _DIGESTS))
