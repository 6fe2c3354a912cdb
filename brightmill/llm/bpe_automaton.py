"""Byte-level BPE by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merges give. It starts as one state with an arc for each
byte, and one gadget is added for each merge (u, v), in order: the state q that u leads to gets a copy without its arc
v, all arcs u are led to the copy, and each state with an arc u gets an arc uv, to where v led from q. A state is kept
as what distinguishes it from the state it copies (the arc taken out, and when); a row's arcs are read off that
chain once and then stand in a table.

All states accept, and each byte string has one accepted sequence, so every prefix of a word is reached on one path:
a word is encoded by following, from each place on, the arcs whose labels stand there. Decoding emits the labels.

Texts are cut into units before a space that follows a visible character; no pre-token spans such a place and none
sees beyond it. Units repeat, so their ids are kept in a bounded table.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightmill.llm.common import byte_characters, check_names, lean

# The pre-tokenisation of byte-level vocabularies (fixed value). It is used up to U+0557, where the character classes of
# `regex` are those of the tokenizer; units with other characters are split by the tokenizer itself.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
BEYOND = re.compile("[^\x00-՗]")
_CUT = re.compile(r"(?<=\S)(?= )")
_PACKS = [struct.Struct(f"<{n}I") for n in range(64)]
_BLANKS = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_BEFORE_SPACE = [b + " " for b in _BLANKS if b < "\x7f"], [b + " " for b in _BLANKS if b > "\x7f"]


def cut_units(text: str) -> tuple[str, list[str]]:
    """The unit at the text's start, which a space may not precede (empty if one does), and the other units without the space
    that each begins with."""
    blanks = _BEFORE_SPACE[0] if text.isascii() else _BEFORE_SPACE[0] + _BEFORE_SPACE[1]
    if not any(b in text for b in blanks):
        head, *rest = text.split(" ")
        return head, rest
    units = _CUT.split(text)
    head = "" if units[0].startswith(" ") else units.pop(0)
    return head, [u[1:] for u in units]


class Automaton:
    """States and arcs for tokens 0 to 255, the bytes, and 256 + k, what merge k makes of the two tokens `merges[k]`."""

    def __init__(self, merges: list[tuple[int, int]]):
        n = 256 + len(merges)
        self.left = [-1] * n
        self.made = [-1] * 256 + list(range(len(merges)))
        self.after = [0] * n  # the state that a token's arcs lead to; -1: no sequence has the token
        self._origin = [0] * n  # that state when the token was made
        self._cut: dict[int, int] = {}  # u, v: the merge that took arc v out of the state after u
        self._owner, self._born = [-1], [-1]  # of each state, but the first: the token it was copied for, and by which merge
        self.arcs: dict[int, bool] = {}
        for k, (u, v) in enumerate(merges):
            self._gadget(k, u, v)

    def _gadget(self, k: int, u: int, v: int) -> None:
        q, made = self.after[u], 256 + k
        self.left[made] = u
        if q < 0 or self.after[v] < 0 or not self._reads(q, v):
            self.after[made] = -1
            return
        self.after[made] = self._origin[made] = self.after[v]
        self._cut[u << 20 | v] = k
        self.after[u] = len(self._owner)
        self._owner.append(u)
        self._born.append(k)

    @property
    def states(self) -> int:
        return len(self._owner)

    def _reads(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token: not, if a copy on the way to it lost that arc. A token that is younger
        than the state got its arc with the arc of its left part."""
        left, made, cut = self.left, self.made, self._cut
        while state:
            owner, top = self._owner[state], self._born[state]
            while True:
                while made[token] >= top:
                    token = left[token]
                if cut.get(owner << 20 | token, top + 1) <= top:
                    return False
                if made[token] <= made[owner]:
                    break
                top, token = made[token], left[token]
            if made[owner] < 0:
                return True
            state = self._origin[owner]
        return True

    def arc(self, state: int, token: int) -> bool:
        key = state << 20 | token
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= 1_000_000:
                self.arcs.clear()
            found = self.arcs[key] = self.after[token] >= 0 and self._reads(state, token)
        return found


class ByteBpe:
    """A byte-level BPE tokenizer file (vocabulary, merges, added tokens) as an automaton with its encoder and decoder."""

    def __init__(self, path: str, added: bool = True, capacity: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, byte_of = spec["model"], byte_characters()
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        before = spec["pre_tokenizer"] or {}
        if not plain or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        coded = lambda token: bytes(byte_of[c] for c in token)
        number = {bytes((b,)): b for b in range(256)}
        merges = []
        for k, pair in enumerate(model["merges"]):
            u, v = map(coded, pair.split(" ") if isinstance(pair, str) else pair)
            merges.append((number[u], number[v]))
            if number.setdefault(u + v, 256 + k) != 256 + k:
                raise ValueError(f"two merges make {u + v!r}")
        self.automaton = Automaton(merges)
        ids = {coded(t): i for t, i in model["vocab"].items()}
        self.id_of = [ids.get(b, -1) for b in number]
        # a trie of the labels: node and byte to node; the longest token on the way to each node, and of each token's own prefixes
        self.trie: dict[int, int] = {}
        self.token_at, self.shorter, self.length = [-1], [-1] * len(number), [len(b) for b in number]
        for label, t in sorted(number.items()):
            node = 0
            for b in label:
                longest, key = self.token_at[node], node << 8 | b
                node = self.trie.setdefault(key, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(longest)
            self.shorter[t], self.token_at[node] = longest, t
        self.single = {b: i for b, i in ids.items() if len(b) == 1}
        self.labels = {i: b for b, i in ids.items()}
        self.added: dict[str, int] = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens that take in their surroundings aren't supported")
            self.labels[t["id"]] = t["content"].encode()
            self.added[t["content"]] = t["id"]
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added and self.added else None
        self._split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self._byte_of = byte_of
        self.capacity, self.known, self._held = capacity, {}, 0

    def word(self, data: bytes) -> list[int]:
        """The ids of one pre-split word: the labels on the path that spells it.

        Arcs with long labels are tried first. A place is reached on one path only, so if no path goes on from there, it is
        never tried again."""
        whole = self.single.get(data)
        if whole is not None:
            return [whole]
        size, trie, shorter, length, arcs, after = len(data), self.trie, self.shorter, self.length, self.automaton.arcs, self.automaton.after
        dead: set[int] = set()
        path: list[tuple[int, int, int]] = []  # place, state and token of each arc taken
        at, state, t = 0, 0, -2
        while at < size:
            if t == -2:  # a new place: the longest label that stands here
                node, t, j = 0, -1, at
                while j < size:
                    node = trie.get(node << 8 | data[j])
                    if node is None:
                        break
                    t, j = self.token_at[node], j + 1
            while t >= 0:
                if at + length[t] not in dead:
                    reads = arcs.get(state << 20 | t)
                    if self.automaton.arc(state, t) if reads is None else reads:
                        break
                t = shorter[t]
            if t >= 0:
                path.append((at, state, t))
                at, state, t = at + length[t], after[t], -2
            else:
                dead.add(at)
                at, state, t = path.pop()
                t = shorter[t]
        return [self.id_of[t] for _, _, t in path]

    def unit(self, unit: str) -> bytes:
        """The ids of a unit as little-endian unsigned numbers of 32 bits."""
        if BEYOND.search(unit):
            return b"".join([self._packed(bytes(self._byte_of[c] for c in word)) for word, _ in self._split(unit)])
        if unit[0] == " " and unit[1:].isalpha():
            return self._packed(unit.encode())
        parts = _SPLIT.findall(unit)
        known = [self.known.get(w[1:]) if w[0] == " " and len(w) > 1 else None for w in parts]  # as a unit, or it isn't there
        return b"".join([self._packed(w.encode()) if k is None else k for w, k in zip(parts, known, strict=True)])

    def _packed(self, word: bytes) -> bytes:
        ids = self.word(word)
        return _PACKS[len(ids)].pack(*ids) if len(ids) < len(_PACKS) else np.array(ids, "<u4").tobytes()

    def _keep(self, key: str) -> bytes:
        coded = self.unit(" " + key)
        if len(key) <= 200:
            if len(self.known) >= self.capacity:
                self.known.clear()
            self.known[key] = coded
        return coded

    def _plain(self, text: str) -> bytes:
        head, rest = cut_units(text)
        parts = list(map(self.known.get, rest))
        if None in parts:
            parts = [self._keep(u) if p is None else p for u, p in zip(rest, parts, strict=True)]
        return (self.unit(head) if head else b"") + b"".join(parts)

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed as in `unit`; added tokens in it are their ids, unless they were ruled out."""
        if self._added is None or not self._added.search(text):
            return self._plain(text)
        parts = self._added.split(text)
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that aren't UTF-8 become replacement characters. Unknown ids have no label."""
        labels = self.labels
        return b"".join([labels.get(i, b"") for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def tokenizer_of(path: str, added: bool) -> ByteBpe:
    """One for a worker process: the automaton takes most of a second to build."""
    return ByteBpe(path, added)


@functools.lru_cache(maxsize=1)
def labels_of(path: str) -> dict[int, bytes]:
    """The label of each id, from the file alone."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = byte_characters()
    return {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def with_column(df: DataFrame, name: str, kind: str, arrow: pa.DataType, make: Callable[[], Callable], source: str) -> DataFrame:
    """`df` and a column made of the batches of `source`, by a function that `make` gives in the task."""
    others = [c for c in df.columns if c != name]
    where = others.index(source) if source in others else None
    rows = df.select(*others) if where is not None else df.select(*others, F.col(source).alias("__source"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*others).schema), f"`{name}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in batches:
            values = batch.column(where if where is not None else len(others)).to_pylist()
            made = pa.array([change(x) for x in values], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], made], [*others, name])

    return rows.mapInArrow(lean(run), schema)


def encode_texts(df: DataFrame, tokenizer_path: str, text: str = "text", tokens: str = "tokens", added: bool = True) -> DataFrame:
    """`df` with the column `tokens` (binary, replaced if there is one): the ids of each text, packed as little-endian
    unsigned numbers of 32 bits. With `added`, strings of added tokens in a text are those tokens; else they are plain text.

    Null texts are as empty ones: no ids. Texts may have any length; a text's ids are held by one task. Repeated rows and
    null ids are rows as any other, an empty table gives an empty one, other columns stay as they are. Column names that
    begin with two underscores are refused (ValueError), as are files that aren't plain byte-level BPE.
    """
    check_names(df)

    def make() -> Callable:
        tokenizer = tokenizer_of(tokenizer_path, added)
        return lambda t: tokenizer.encode(t or "")

    return with_column(df, tokens, "binary", pa.binary(), make, text)


def decode_tokens(df: DataFrame, tokenizer_path: str, tokens: str = "tokens", text: str = "decoded") -> DataFrame:
    """`df` with the column `text` (replaced if there is one): the arc labels of packed ids, joined. Null ids give an empty
    text, ids that the file doesn't have give nothing; else as `encode_texts`."""
    check_names(df)

    def make() -> Callable:
        labels = labels_of(tokenizer_path)
        return lambda packed: b"".join([labels.get(i, b"") for i in np.frombuffer(packed or b"", "<u4").tolist()]).decode("utf-8", "replace")

    return with_column(df, text, "string", pa.string(), make, tokens)
