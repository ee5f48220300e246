"""Byte-level BPE by a lazily determinised transducer.

The rank file's merges become a finite-state transducer over bytes.  Its state
is a node of the suffix automaton (all suffixes of the input that start some
token) and, for each of these suffixes, the last token of the encoding up to
its start.  By the local-validity property of merge orders, the encoding of a
prefix is the one token sequence whose neighbours are all valid pairs, so a
state determines the last token of every longer prefix.  Nothing is built
ahead: nodes, moves and pair validity are made when first reached and kept.
What all ways on from a state share is emitted, after a lookahead of the longest
token's length.  Decoding runs an incremental UTF-8 automaton over the bytes of
token after token.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.shared import map_arrow, with_text_columns

#: Remembered pairs and pieces are dropped beyond these counts; they are made anew when needed.
MOST_PAIRS = 500_000
MOST_PIECES = 600_000
LONGEST_PIECE = 48
#: Pieces that are encoded, and whose tokens are decoded, at a time.
STEP = 2048
#: Texts of more characters are split into pieces bit by bit.
LONG_TEXT = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Transducer:
    """Encodes pieces of bytes by merge ranks.  Every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a rank: {missing[:5]}")
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.token = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token) + 1)}
        #: No token reaches further back: what is settled is looked for and emitted after so many bytes.
        self.look = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        # A node: the suffixes of the input that start a token, longest first; 0 is the start.
        self.numbers: dict[tuple[bytes, ...], int] = {(b"",): 0}
        self.nodes: list[tuple[bytes, ...]] = [(b"",)]
        self.moves: dict[int, tuple[int, tuple]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The merges themselves, lowest rank first, leftmost first; for the short strings that tokens are."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a byte; None if merges never make it."""
        if rank not in self.halves:
            token = self.token[rank]
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
            else:
                kept = self.ranks.pop(token)
                parts = self.merged(token)
                self.ranks[token] = kept
                made = len(parts) == 2 and all(self.ranks[p] < kept for p in parts)
                self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if made else None
        return self.halves[rank]

    def _valid(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: the start): no merge across the border comes before those inside."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = left < 0 or self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Undo merges beside the border, the latest first: the border holds if no pair across it merges before the one undone last."""
        undone = 1 << 62
        while True:
            across = self.ranks.get(self.token[left] + self.token[right])
            if across is not None and across < undone:
                return False
            whole_left, whole_right = self.size[left] == 1, self.size[right] == 1
            if whole_left and whole_right:
                return True
            if whole_right or (not whole_left and left > right):
                # A pair of the same rank further left would have merged first.
                undone, left = left, self._halves(left)[1]
            else:
                undone, right = right + 1, self._halves(right)[0]

    def _move(self, node: int, byte: int) -> tuple[int, tuple]:
        """Determinise one move of the suffix automaton: the new node and the tokens that end here, longest first, with their sizes."""
        last = bytes([byte])
        longer = [t for s in self.nodes[node] if (t := s + last) in self.prefixes]
        new = (*longer, b"")
        if (number := self.numbers.get(new)) is None:
            number = self.numbers[new] = len(self.nodes)
            self.nodes.append(new)
        ending = tuple((r, len(t)) for t in longer if (r := self.ranks.get(t)) is not None and self._halves(r))
        move = self.moves[node << 8 | byte] = (number, ending)
        return move

    def _settled(self, node: int, ends: list[int]) -> int:
        """How many of the bytes lie before a border that all ways on from here share."""
        at = {len(ends) - len(suffix) for suffix in self.nodes[node]}
        while len(at) > 1:
            far = max(at)
            at = (at - {far}) | {far - self.size[ends[far - 1]]}
        return at.pop()

    def _path(self, ends: list[int], n: int) -> list[int]:
        out = []
        while n > 0:
            out.append(ends[n - 1])
            n -= self.size[out[-1]]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ranks of one piece; a piece that is a token is that token."""
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        return [rank for block in self.emit(piece) for rank in block]

    def emit(self, data: Iterable[int]) -> Iterator[list[int]]:
        """Ranks of a stream of bytes, a block at a time as they settle.

        For each byte: move the suffix automaton, then take the token ending
        here that is valid after the last token before its start; exactly one
        is.  Every ``look`` bytes the tokens before the border that all ways on
        share are emitted; no later byte changes them.
        """
        ends: list[int] = []
        node, before_all, n, check = 0, -1, 0, self.look
        moves, pairs = self.moves, self.pairs
        for byte in data:
            move = moves.get(node << 8 | byte)
            node, ending = move if move is not None else self._move(node, byte)
            n += 1
            for rank, size in ending:
                before = ends[n - size - 1] if n > size else before_all
                ok = pairs.get(before << 32 | rank)
                if ok or (ok is None and self._valid(before, rank)):
                    break
            else:
                raise ValueError("the ranks are not a merge order")
            ends.append(rank)
            if n >= check:
                settled = self._settled(node, ends)
                if settled:
                    block = self._path(ends, settled)
                    yield block
                    before_all, ends, n = block[-1], ends[settled:], n - settled
                check = n + self.look
        yield self._path(ends, n)


class _Pieces(dict):
    """Decimal ranks, joined by commas, of short pieces met before."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> str:
        out = ",".join(map(str, self.transducer.encode(piece.encode("utf-8", "surrogateescape"))))
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = out
        return out


class Codec:
    """Encodes and decodes whole texts.

    ``pattern`` splits a text; each match is encoded on its own.  Bytes that
    are not UTF-8 pass through unchanged.  An empty text has no tokens.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(ranks)
        self.pieces = _Pieces(self.transducer)
        self.token = {str(rank): token for token, rank in ranks.items()}

    def decimal(self, data: bytes) -> Iterator[str]:
        """Decimal ranks joined by commas, in blocks of pieces, so that a very long text needs little memory."""
        text = data.decode("utf-8", "surrogateescape")
        found = iter(self.pattern.findall(text)) if len(text) <= LONG_TEXT else (m[0] for m in self.pattern.finditer(text))
        while block := ",".join(map(self.pieces.__getitem__, islice(found, STEP))):
            yield block

    def encode(self, data: bytes) -> list[int]:
        return [int(x) for block in self.decimal(data) for x in block.split(",")]

    def decode_tokens(self, ids: Iterable[int]) -> Iterator[str]:
        """What each rank adds to the text, as soon as it is known: whole characters only; what is left over comes last."""
        automaton = codecs.getincrementaldecoder("utf-8")("surrogateescape")
        for rank in ids:
            yield automaton.decode(self.transducer.token[rank])
        yield automaton.decode(b"", True)

    def decode(self, blocks: Iterable[str]) -> Iterator[str]:
        """Text of blocks of decimal ranks; a character may span tokens and blocks."""
        automaton = codecs.getincrementaldecoder("utf-8")("surrogateescape")
        for block in blocks:
            yield automaton.decode(b"".join(map(self.token.__getitem__, block.split(","))))
        yield automaton.decode(b"", True)

    def digests(self, data: bytes, lists: list | None = None) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the decimal ranks, SHA-256 of what they decode to; the ranks are added to ``lists``."""
        ids, back, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []

        def seen(blocks: Iterable[str]) -> Iterator[str]:
            nonlocal n
            for i, block in enumerate(blocks):
                ids.update((("," if i else "") + block).encode())
                n += block.count(",") + 1
                if lists is not None:
                    kept.extend(map(int, block.split(",")))
                yield block

        for text in self.decode(seen(self.decimal(data))):
            back.update(text.encode("utf-8", "surrogateescape"))
        if lists is not None:
            lists.append(kept)
        return n, ids.hexdigest(), back.hexdigest()


_CODECS: dict[tuple, Codec] = {}


def _codec(ranks: Broadcast, pattern: str) -> Codec:
    """One codec for each worker process and rank file."""
    key = (ranks.value[0], pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks.value[1], pattern)
    return _CODECS[key]


def _shipped(df: DataFrame, path: str) -> Broadcast:
    """The rank file, read by the driver (its size is that of a vocabulary), for all workers."""
    ranks = read_ranks(path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((name, ranks))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the column ``ids`` (array<int>): the encoding of each whole text.

    Null and empty texts give an empty array.  All other columns, repeated rows
    and null keys stay as they are, whatever their names; an old column named
    ``ids`` is replaced.  An empty table gives no rows.  Rows are independent:
    no shuffle, and a lost task is simply run again.
    """
    ranks = _shipped(docs, path)

    def encoded(column: pa.Array) -> list[pa.Array]:
        codec = _codec(ranks, pattern)
        return [pa.array([codec.encode(x or b"") for x in column.cast(pa.binary()).to_pylist()], pa.list_(pa.int32()))]

    return with_text_columns(docs, text, encoded, [T.StructField(ids, T.ArrayType(T.IntegerType()))])


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """``docs`` with the column ``text`` decoded from the ranks in ``ids``, token by token.

    Null counts as no tokens and gives an empty text; an unknown rank is an
    error.  Repeated rows and other columns stay as they are, an old ``text`` is
    replaced, an empty table gives no rows.
    """
    ranks = _shipped(docs, path)

    def decoded(column: pa.Array) -> list[pa.Array]:
        codec = _codec(ranks, pattern)
        found = ["".join(codec.decode_tokens(x or [])).encode("utf-8", "surrogateescape") for x in column.to_pylist()]
        return [pa.array(found, pa.binary()).cast(pa.string())]

    return with_text_columns(docs, ids, decoded, [T.StructField(text, T.StringType())])


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: str | None = None) -> DataFrame:
    """Per row: ``key``, n_tokens, ids_sha256, decoded_sha256 and, if named, ``ids``; each text is encoded and its ranks decoded again.

    Null and empty texts have no tokens, repeated rows are rows of their own, an
    empty table gives no rows.  Other columns are left out, so that no name can
    clash; ``key`` may have any name but those of the results.  Rows are
    independent: no shuffle.
    """
    if key in ("n_tokens", "ids_sha256", "decoded_sha256", ids):
        raise ValueError(f"the key is named like a result: {key}")
    ranks = _shipped(docs, path)
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    out = T.StructType([T.StructField("key", docs.schema["key"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if ids:
        out.add(ids, T.ArrayType(T.IntegerType()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(ranks, pattern)
        lists: list | None = [] if ids else None
        found = [codec.digests(x or b"", lists) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
        if ids:
            columns.append(pa.array(lists, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=out.names)

    return map_arrow(docs, run, out).withColumnRenamed("key", key)
