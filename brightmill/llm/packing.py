"""Vector bin packing of tokenised examples into training sequences.

Each piece has a size in three dimensions: tokens, segments (1) and loss-bearing tokens. Sequences are
filled one at a time. The dot-product heuristic picks, among the waiting pieces that fit, the one whose
size vector has the largest inner product with what the sequence has left, all in units of the limits.
When no whole piece fits, or one segment is left, and cutting is allowed, the waiting piece with the longest
fitting prefix is cut. Sequences that can't be filled are cut to powers of two, which need no padding.

Packing is local to a task's documents: no shuffle, no driver work, and memory bounded by a window of
waiting pieces that is refilled from the stream. What is left of one window is packed with the next.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from brightmill.llm.common import byte_characters, lean

END_ID = 2

# The pre-tokenisation of the word vocabulary (fixed values, from its tokenizer file), for texts within Latin
# letters, where normalisation is lower-casing alone; all other texts take the tokenizer itself.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_BEYOND = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ]")
_SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>")
_MARK = re.compile(r"[.,;:!?](?<=[^\W_].)(?!\S)")  # at a word's end, after a letter or digit: a piece of its own
_END = b"\xff"


_BYTE_OF = byte_characters()


class _Table(dict):
    """What `compute` gives for a word, in two generations of at most `capacity` words or, if they are long, `WORD_CHARS` times as
    many characters each. `table[word]` computes what neither holds."""

    WORD_CHARS = 32

    def __init__(self, compute: Callable[[str], bytes], capacity: int):
        super().__init__()
        self.compute = compute
        self.whole = self.room = capacity * self.WORD_CHARS
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.compute(word)
        taken = max(self.WORD_CHARS, len(word))
        if taken > self.room:
            if taken > self.whole:
                return found
            self.older = dict(self)  # a copy, since callers go on with this table's lookup
            self.clear()
            self.room = self.whole
        self.room -= taken
        self[word] = found
        return found


class WordTokenizer:
    """Ids of whole texts by a tokenizer file with word ends, as `encode(add_special_tokens=False)` gives them.

    Nothing merges across white space, so a text's ids are its words' ids; these are kept in a bounded
    table of two generations, since tokenising is the main cost and words repeat. The merges of a new word are
    done by tiktoken on the file's vocabulary, with a byte that UTF-8 never has as the word's end."""

    def __init__(self, path: str, capacity: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known = _Table(self._word, capacity)
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        ranks = {self._bytes(t): i for t, i in self.whole.get_vocab(with_added_tokens=False).items() if t not in special}
        ranks.setdefault(_END, len(ranks))
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    @staticmethod
    def _bytes(token: str) -> bytes:
        """A vocabulary entry as bytes: each character stands for a byte, and the word end for `_END`."""
        core = token.removesuffix("</w>")
        return bytes(_BYTE_OF[c] for c in core) + (_END if core != token else b"")

    def _word(self, word: str) -> bytes:
        """The ids of a run without white space, as native integers; most new ones are letters alone."""
        if not word.isalpha():
            pieces = _PIECES.findall(word)
            if len(pieces) > 1:
                return b"".join([self.known[p] for p in pieces])
        return array("I", self.merge(word.encode() + _END)).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if _BEYOND.search(text) or _SPECIAL.search(text):
                out.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4"))
                continue
            words = _MARK.sub(r" \g<0>", text.lower()).split()  # no pre-token spans white space
            out.append(np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32))
        return out


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. Prompts bear no loss, so a loss limit below that of tokens asks for a mix of prompts and
    answers in each sequence."""

    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096


#: For instruction data: at most 32 examples and 3456 loss-bearing tokens a sequence. A quarter of each plain document
#: stands for its prompt, so all documents together bear loss on 3072 of 4096 tokens.
INSTRUCTIONS, PROMPT_SHARE = Limits(4096, 32, 3456), 0.25


@dataclass(frozen=True)
class Piece:
    """Tokens start..start+length of the document with number `doc`; loss-bearing ones stand from `loss_from` on."""

    doc: int
    start: int
    length: int
    loss_from: int

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, length, self.loss_from), Piece(self.doc, self.start + length, self.length - length, self.loss_from)


class Waiting:
    """Waiting pieces, grouped by equal size vectors; groups are known by their rows in `_sizes`."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.tokens = 0
        self.count = 0
        self._rows: dict[tuple[int, int], int] = {}
        self._groups: list[list[Piece]] = []
        self._sizes = np.zeros((64, 2))
        self._alive = np.zeros(64, bool)

    def add(self, piece: Piece) -> None:
        key = (piece.length, piece.loss)
        if key not in self._rows:
            if len(self._groups) == len(self._alive):
                self._compact()
            self._rows[key] = len(self._groups)
            self._sizes[len(self._groups)] = key
            self._groups.append([])
        row = self._rows[key]
        self._groups[row].append(piece)
        self._alive[row] = True
        self.tokens += piece.length
        self.count += 1

    def take(self, row: int) -> Piece:
        piece = self._groups[row].pop()
        self._alive[row] = bool(self._groups[row])
        self.tokens -= piece.length
        self.count -= 1
        return piece

    def _compact(self) -> None:
        """Drops empty groups, and doubles the arrays if they are still more than half full."""
        kept = np.flatnonzero(self._alive)
        size = len(self._alive) * (2 if 2 * len(kept) > len(self._alive) else 1)
        sizes = np.zeros((size, 2))
        sizes[: len(kept)] = self._sizes[kept]
        self._groups = [self._groups[i] for i in kept]
        self._rows = {(g[0].length, g[0].loss): i for i, g in enumerate(self._groups)}
        self._sizes, self._alive = sizes, np.arange(size) < len(kept)

    def best(self, tokens: int, segments: int, loss: int) -> int | None:
        """The group of fitting pieces with the largest dot product with what is left."""
        limits = self.limits
        length, bearing = self._sizes.T
        fits = self._alive & (length <= tokens) & (bearing <= loss)
        dot = length * (tokens / limits.tokens**2) + bearing * (loss / max(1, limits.loss) ** 2) + segments / limits.segments**2
        row = int(np.where(fits, dot, -1.0).argmax())
        return row if fits[row] else None

    def prefix(self, tokens: int, loss: int) -> tuple[int, int]:
        """The group with the longest fitting prefix, of equal ones the longest, and the prefix's length. Loss-free
        tokens of a piece stand before its loss-bearing ones."""
        length, bearing = self._sizes.T
        fitting = np.where(self._alive, np.minimum(np.minimum(length, tokens), length - bearing + loss), 0)
        row = int((fitting * 1e6 + length).argmax())
        return row, int(fitting[row])


def _fill(waiting: Waiting, limits: Limits, cutting: bool) -> list[Piece]:
    """One sequence. Its last segment, and what no whole piece fits into, take a prefix."""
    out: list[Piece] = []
    tokens, segments, loss = limits.tokens, limits.segments, limits.loss
    while tokens and segments and waiting.count:
        row = None if cutting and segments == 1 else waiting.best(tokens, segments, loss)
        if row is not None:
            piece = waiting.take(row)
        else:
            row, length = waiting.prefix(tokens, loss) if cutting else (0, 0)
            if not length:
                break
            piece = waiting.take(row)
            if length < piece.length:
                piece, rest = piece.cut(length)
                waiting.add(rest)
        out.append(piece)
        tokens, segments, loss = tokens - piece.length, segments - 1, loss - piece.loss
    return out


def _trim(pieces: list[Piece], length: int, waiting: Waiting) -> list[Piece]:
    """The sequence's first `length` tokens; the rest waits on."""
    out, used = [], 0
    for piece in pieces:
        room = length - used
        if room <= 0:
            waiting.add(piece)
            continue
        if piece.length > room:
            piece, rest = piece.cut(room)
            waiting.add(rest)
        out.append(piece)
        used += piece.length
    return out


def pack(waiting: Waiting, limits: Limits, least: int = 0, cutting: bool = True) -> Iterator[list[Piece]]:
    """Sequences from the waiting pieces, until fewer than `least` tokens wait (0: all are placed). Where the limits let no
    piece into an empty sequence (ValueError), no further one would come out either."""
    while waiting.count and waiting.tokens >= least:
        pieces = _fill(waiting, limits, cutting)
        if not pieces:
            raise ValueError(f"no waiting piece fits into {limits}")
        total = sum(p.length for p in pieces)
        if cutting and total < limits.tokens and total & (total - 1):
            pieces = _trim(pieces, 1 << (total.bit_length() - 1), waiting)
        yield pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_PIECES_SCHEMA = pa.schema([(p.split()[0], pa.int64()) for p in PIECES.split(", ")])


def pack_documents(
    df: DataFrame, tokenizer_path: str, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", prompt_tokens: str | None = None, prompt_share: float = 0.0,
    window_tokens: int = 2_000_000, ids: bool = False,
) -> DataFrame:
    """One row for each piece of each document: `PIECES`, and with `ids` the token ids.

    A document is its text's ids (null or empty text: none) and the end id. Its first `prompt_tokens` tokens (a column;
    0 if null) or, without such a column, the share `prompt_share` of its tokens, rounded down, is its prompt; the prompt
    and the end id bear no loss. Ids must be of an integral type (TypeError), null ids stay null. Rows are packed as
    they are: repeated rows and ids are separate documents, equal sizes are taken as they came. Texts may have any
    length; pieces of one have at most half a sequence where the loss limit is below that of tokens. An empty table gives an
    empty one; other columns are not read, whatever their names. sequence_id is the task's number and a count, so a lost
    task gives the same rows again.
    """
    if not isinstance(df.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} must be of an integral type")
    columns = [F.col(doc_id).cast("long"), F.col(text), *([F.col(prompt_tokens).cast("long")] if prompt_tokens else [])]
    largest = limits.tokens if limits.loss >= limits.tokens else max(1, limits.tokens // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = WordTokenizer(tokenizer_path)  # one a task: a worker process goes on to other stages, whose memory its tables would take
        sequence = TaskContext.get().partitionId() << 40
        waiting = Waiting(limits)
        docs: dict[int, list] = {}  # number -> [doc_id, ids, tokens not placed yet]
        number = 0

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[tuple] = []
            for pieces in pack(waiting, limits, least):
                offset = 0
                for p in pieces:
                    key, tokens, _ = doc = docs[p.doc]
                    part = tokens[p.start : p.start + p.length]
                    # the end id bears no loss
                    loss = p.loss - (p.start + p.length == len(tokens) and p.loss > 0)
                    out.append((key, p.start, p.length, zlib.crc32(part.tobytes()), len(tokens), sequence, offset, loss, *([part.tolist()] if ids else [])))
                    offset += p.length
                    doc[2] -= p.length
                    if not doc[2]:
                        del docs[p.doc]
                sequence += 1
                if len(out) > 2000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            fields = list(_PIECES_SCHEMA) + ([pa.field("ids", pa.list_(pa.int64()))] if ids else [])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], [f.name for f in fields])

        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch[a : a + 256]
                prompts = part.column(2).to_pylist() if prompt_tokens else [None] * len(part)
                for key, coded, prompt in zip(part.column(0).to_pylist(), tokenizer.encode([t or "" for t in part.column(1).to_pylist()]), prompts, strict=True):
                    tokens = np.append(coded, np.uint32(END_ID)).astype("<u4")
                    docs[number] = [key, tokens, len(tokens)]
                    piece = Piece(number, 0, len(tokens), max(0, prompt or 0) if prompt_tokens else int(prompt_share * len(tokens)))
                    number += 1
                    while piece.length > largest:
                        head, piece = piece.cut(largest)
                        waiting.add(head)
                    waiting.add(piece)
                if waiting.tokens >= window_tokens:  # half of the window stays, so that the choice stays large
                    yield from rows(max(limits.tokens, window_tokens // 2))
        yield from rows(0)

    return df.select(*columns).mapInArrow(lean(run), PIECES + (", ids array<long>" if ids else ""))
