"""Chat formatting with a prefix tree.

Conversations are ordered by the path of their turns' digests. That order is the depth-first order of
the tree in which conversations that begin with the same turns share nodes: a conversation's shared
part with its predecessor is the path above it, and only the rest is new. Spark range-partitions and
sorts the conversations; each partition is one *shard*, emitted as a stream of rows:

* a `node` row for each new turn, with its tokens, position ids that count on from its parent, the loss
  mask, and attention intervals: the shard offsets of all its ancestors and itself, merged where they touch;
* a `leaf` row for each conversation, right after its last node.

Tokens that conversations share are emitted once in a shard. A hot first turn, however many
conversations begin with it, spreads over as many shards as its conversations need; each shard is
complete in itself, so at most one root-to-leaf path is repeated at a shard's start.

Template: `<|turn|>role<|text|>text<|end|>`. In roles and texts a backslash is doubled and every control
string (the template's own and those of common chat templates) gets a backslash after its first
character, so no control string is left and the original can be restored exactly.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightmill.llm.common import lean

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat templates read as control tokens.
CONTROL = (
    TURN, TEXT, END, "<s>", "</s>", "<pad>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
)
_SPECIAL = re.compile(r"\\|" + "|".join(re.escape(x) for x in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


OUTPUT = (
    "shard int, seq long, kind string, conv_id long, n_turns long, depth int, parent_seq long, start long, position long, "
    "tokens array<int>, loss_start int, loss_end int, attention array<struct<start:long,end:long>>"
)
_INTERVAL = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("seq", pa.int64()), ("kind", pa.string()), ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("depth", pa.int32()), ("parent_seq", pa.int64()),
    ("start", pa.int64()), ("position", pa.int64()), ("tokens", pa.list_(pa.int32())), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attention", _INTERVAL),
])

_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    """One tokenizer a process; special strings in a text are ordinary text."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


def encode_ids(tokenizer, texts: list[str], chars: int = 200_000) -> Iterator[list[int]]:
    """Token ids of each text. Encodings hold far more than ids, so only some are alive at a time."""
    start = size = 0
    for at, text in enumerate(texts, 1):
        size += len(text)
        if size >= chars or at == len(texts):
            for e in tokenizer.encode_batch(texts[start:at], add_special_tokens=False):
                yield e.ids
            start, size = at, 0


def extend(intervals: tuple, start: int, end: int) -> tuple:
    """The intervals with one more at their end, merged where they touch."""
    if intervals and intervals[-1][1] == start:
        return (*intervals[:-1], (intervals[-1][0], end))
    return (*intervals, (start, end))


def order_turns(df: DataFrame) -> DataFrame:
    """conv_id, turns (by turn, ties by role and text) and path, the turns' digests.
    Null roles and texts count as empty, null turns come first, and rows without conv_id are one conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # the length of the role keeps role and text apart
    return one.withColumn("path", F.transform("turns", lambda t: F.sha2(F.concat(F.length(t.role).cast("string"), F.lit(":"), t.role, t.text), 256)))


def format_tree(df: DataFrame, tokenizer_path: str, loss_roles: tuple[str, ...] = ("assistant",), shards: int | None = None) -> DataFrame:
    """The prefix tree of conversations (conv_id, turn, role, text) as `OUTPUT` rows, in shards.

    `tokenizer_path` names a byte-level tokenizer file, so tokens decode to the exact formatted text.
    An empty input gives no rows; extra columns are dropped. A single conversation is held in one row, so the rows
    without conv_id, which are one, must be as few as a conversation's. Repeated rows are turns of their own.
    """
    shards = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = order_turns(df).repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns", "path")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = _tokenizer(tokenizer_path)
        shard = TaskContext.get().partitionId()
        above: list[str] = []  # the last conversation's path
        spine: list[tuple] = []  # its nodes: seq, offset after, position after, attention
        seq = offset = 0
        for batch in batches:
            rows, todo = [], []
            for conv_id, turns, path in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", "path")), strict=True):
                same = 0
                while same < min(len(above), len(path)) and above[same] == path[same]:
                    same += 1
                above = path
                rows.append((conv_id, len(path), same, [t["role"] in loss_roles for t in turns[same:]]))
                for t in turns[same:]:
                    todo += [f"{TURN}{escape(t['role'])}{TEXT}", escape(t["text"]), END]
            coded = encode_ids(tokenizer, todo)
            out: list[dict] = []
            for conv_id, n_turns, same, losses in rows:
                del spine[same:]
                for loss in losses:
                    head, body, tail = (next(coded) for _ in range(3))
                    tokens = head + body + tail
                    parent, _, position, seen = spine[-1] if spine else (None, 0, 0, ())
                    attention = extend(seen, offset, offset + len(tokens))
                    out.append({
                        "shard": shard, "seq": seq, "kind": "node", "conv_id": conv_id, "depth": len(spine), "parent_seq": parent, "start": offset, "position": position,
                        "tokens": tokens, "loss_start": len(head) if loss else 0, "loss_end": len(head) + len(body) if loss else 0,
                        "attention": [{"start": a, "end": b} for a, b in attention],
                    })
                    offset += len(tokens)
                    spine.append((seq, offset, position + len(tokens), attention))
                    seq += 1
                out.append({"shard": shard, "seq": seq, "kind": "leaf", "conv_id": conv_id, "n_turns": n_turns, "depth": len(spine), "parent_seq": spine[-1][0] if spine else None})
                seq += 1
                if len(out) >= 200:
                    yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return ordered.mapInArrow(lean(emit), OUTPUT)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, shared_turns long"
_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("shared_turns", pa.int64()),
])


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """One `DIGEST` row a conversation, from the emitted tokens alone.

    Reads each shard in its order of seq, as `format_tree` and a table sorted by (shard, seq) give it, and
    keeps the decoded state of the current path only. A gap in seq or an attention interval that isn't the
    path raises an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        spine: list[tuple] = []  # attention, turns hash, loss hash, loss chars, formatted chars, [whether a leaf has it]
        expected: tuple | None = None
        for batch in batches:
            rows = batch.to_pylist()
            parts = []
            for r in rows:
                if r["kind"] == "node":
                    parts += [r["tokens"], r["tokens"][r["loss_start"] : r["loss_end"]]]
            texts = iter(tokenizer.decode_batch(parts, skip_special_tokens=False))
            out = []
            for r in rows:
                if not expected or r["shard"] != expected[0]:
                    spine, expected = [], (r["shard"], 0)
                if r["seq"] != expected[1]:
                    raise ValueError(f"shard {r['shard']}: row {r['seq']} where {expected[1]} should be")
                expected = (r["shard"], r["seq"] + 1)
                del spine[r["depth"] :]
                seen, turns, losses, chars, size, _ = spine[-1] if spine else ((), hashlib.sha256(), hashlib.sha256(), 0, 0, None)
                if r["kind"] == "node":
                    text, plain = next(texts), unescape(next(texts))
                    attention = extend(seen, r["start"], r["start"] + len(r["tokens"]))
                    if [(x["start"], x["end"]) for x in r["attention"]] != list(attention):
                        raise ValueError(f"shard {r['shard']}: row {r['seq']} doesn't attend to its own path")
                    role, body = text[len(TURN) : -len(END)].split(TEXT)
                    turns, losses = turns.copy(), losses.copy()
                    turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                    losses.update(plain.encode())
                    spine.append((attention, turns, losses, chars + len(plain), size + len(text), [False]))
                else:
                    shared = 0
                    for s in spine:
                        shared += s[-1][0]
                        s[-1][0] = True
                    out.append({
                        "conv_id": r["conv_id"], "n_turns": len(spine), "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                        "loss_sha256": losses.hexdigest(), "formatted_chars": size, "shared_turns": shared,
                    })
            if out:
                yield pa.RecordBatch.from_pylist(out, _DIGEST)

    return formatted.mapInArrow(lean(read), DIGEST)
