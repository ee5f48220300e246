r"""Chat formatting whose output a deterministic grammar reads back.

A formatted conversation is a sequence of turns, nothing between them:

    user       [INST] text [/INST]
    assistant  <s> text </s>
    system     <<SYS>> text <</SYS>>
    any other  [TURN role] text [/TURN]

(no spaces around the text).  After a closing mark the parser expects an
opening mark or the end.  Inside a text a backslash before a backslash or a
control string makes that literal.  A turn is first rendered as it is; if
reparsing does not give it back, its control strings and the backslashes before
them are escaped; if it still differs, every backslash is.  The last form always
reads back.  The rendered turns of a conversation are then joined and reparsed
as one text, by a parser that is not told where turns end, and compared to the
source turn by turn.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.shared import prepare

#: Fixed control strings by role: opening and closing mark.
MARKS = {
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
    "system": ("<<SYS>>", "<</SYS>>"),
}
OTHER = ("[TURN ", "[/TURN]")
CONTROL = [m for pair in (*MARKS.values(), OTHER) for m in pair]
_CONTROLS = "|".join(regex.escape(c) for c in sorted(CONTROL, key=len, reverse=True))
_RUN = regex.compile(rf"\\*(?:{_CONTROLS})|\\+\Z")
_ESCAPED = regex.compile(rf"\\(\\|{_CONTROLS})")
_TOKEN = regex.compile(rf"\\(?:\\|{_CONTROLS})|{_CONTROLS}")
_ANY = regex.compile(rf"\\|{_CONTROLS}")


def _partial(text: str) -> str:
    """Escape control strings and the backslashes before them or at the end."""

    def one(match: regex.Match) -> str:
        run = match[0]
        slashes = len(run) - len(run.lstrip("\\"))
        return "\\" * (2 * slashes) + ("\\" + run[slashes:] if slashes < len(run) else "")

    return _RUN.sub(one, text)


def _full(text: str) -> str:
    return _ANY.sub(lambda m: "\\" + m[0], text)


def _unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Unfinished(ValueError):
    """The text ends before its turn does."""


def parse_turn(data: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """Role, text, start and end of the raw text, and where the next turn begins."""
    for role, (opening, closing) in MARKS.items():
        if data.startswith(opening, at):
            start = at + len(opening)
            break
    else:
        if not data.startswith(OTHER[0], at):
            openings = [m[0] for m in MARKS.values()] + [OTHER[0]]
            cut = any(o.startswith(data[at : at + len(o)]) for o in openings)
            raise (Unfinished if cut else ValueError)("a turn must open here")
        end = _end(data, at + len(OTHER[0]), "]")
        role, closing, start = _role(data[at + len(OTHER[0]) : end]), OTHER[1], end + 1
    for match in _TOKEN.finditer(data, start):
        if match[0] == closing:
            return role, _unescape(data[start : match.start()]), start, match.start(), match.end()
        if not match[0].startswith("\\"):
            raise ValueError(f"{match[0]} within a turn")
    raise Unfinished("a turn does not close")


def _end(data: str, at: int, mark: str) -> int:
    found = data.find(mark, at)
    if found < 0:
        raise Unfinished("a turn's role does not close")
    return found


def _role(raw: str) -> str:
    return regex.sub(r"%([0-9a-f]+);", lambda m: chr(int(m[1], 16)), raw)


def render_turn(role: str, text: str) -> str:
    """The first form of the turn that the parser reads back as it was."""
    if role in MARKS:
        opening, closing = MARKS[role]
    else:
        opening, closing = OTHER[0] + regex.sub(r"[%\]\[\\<]", lambda m: f"%{ord(m[0]):x};", role) + "]", OTHER[1]
    for escape in (str, _partial, _full):
        out = opening + escape(text) + closing
        try:
            got = parse_turn(out)
        except ValueError:
            continue
        if got[:2] == (role, text) and got[4] == len(out):
            return out
    raise AssertionError("a fully escaped turn must read back")


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(render_turn(role, text) for role, text in turns)


def parse(data: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(data):
        role, text, _, _, at = parse_turn(data, at)
        out.append((role, text))
    return out


class Reader:
    """Reparses a formatted conversation that arrives in pieces of any size; it holds what is not yet a whole turn."""

    def __init__(self):
        self.held, self.at = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """Turns (role, text) that are whole now."""
        self.held += piece
        at = 0
        while at < len(self.held):
            try:
                role, text, _, _, end = parse_turn(self.held, at)
            except Unfinished:
                break
            yield role, text
            at = end
        self.held = self.held[at:]

    def close(self) -> None:
        if self.held:
            raise ValueError("a conversation ends within a turn")


def turn_digest(role: str, text: str) -> str:
    return hashlib.sha256(f"{role}\n{text}".encode("utf-8", "surrogateescape")).hexdigest()


class _Conversation:
    """What is read back from a conversation's formatted text, compared to its source turns on the way."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.reader, self.source = Reader(), deque()

    def add(self, formatted: str, source: str) -> None:
        """The next piece of the text, and the digest of the turn that it was rendered from."""
        self.chars += len(formatted)
        self.source.append(source)
        for role, text in self.reader.feed(formatted):
            if not self.source or turn_digest(role, text) != self.source.popleft():
                raise ValueError(f"conversation {self.conv_id} does not read back")
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogateescape"))
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogateescape"))

    def row(self) -> tuple:
        self.reader.close()
        if self.source:
            raise ValueError(f"conversation {self.conv_id} lost turns")
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = ([(x or b"").decode("utf-8", "surrogateescape") for x in batch.column(i).cast(pa.binary()).to_pylist()] for i in (2, 3))
        out = [render_turn(r, t).encode("utf-8", "surrogateescape") for r, t in zip(roles, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(out, pa.binary())], names=["conv_id", "turn", "tie", "formatted"])


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, rows = None, []
    for batch in batches:
        ids, formatted, source = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
        for i, conv_id in enumerate(ids):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    rows.append(now.row())
                now = _Conversation(conv_id)
            now.add(formatted[i].as_py().decode("utf-8", "surrogateescape"), source[i])
        if len(rows) >= 1000:
            yield _rows(rows)
            rows = []
    if now is not None:
        rows.append(now.row())
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as (conv_id, turn, tie, formatted binary): each turn rendered and proven by reparsing.

    Null role and text count as empty.  Concatenated in order of turn (nulls
    first, ties by role, then text), they are the formatted conversation.
    """
    prepare(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"), F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), 256).alias("tie"))
    return rows.mapInArrow(_render_batches, "conv_id long, turn long, tie string, formatted binary")


def round_trip(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are formatted before the shuffle by conv_id.  After it the joined text
    streams, sorted, through one parser a conversation and incremental digests,
    so that a task holds one turn however long the conversation is; turns that
    read back differ from the source are an error.  Null conv_id is a conversation of its own; an
    empty table gives no rows; repeated rows are turns of their own.  Turns
    that share a number come in the order of a digest of role and text.
    """
    rows = format_turns(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")
    return rows.select("conv_id", "formatted", "tie").mapInArrow(_read_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
