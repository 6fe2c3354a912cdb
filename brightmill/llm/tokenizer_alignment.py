"""Alignment of two tokenizers over a corpus: which ids of the one end where ids of the other end.

Each text, with a space before it, is encoded by a byte-level BPE (A) and by a piece model with byte fallback (B). The byte
offsets at which tokens of both end cut the text into groups; there the two tokens that end together are linked.

1. One pass encodes the texts. Neither tokenizer joins anything over a space that follows a visible character, so
   texts are cut there and each distinct unit is encoded and aligned once in a bounded table. A task counts its
   links by np.unique over int64 keys, B's id in the high and A's in the low half.
2. These partial counts are range-partitioned by key and sorted, a global order; runs of equal keys are summed,
   and each partition is stored as a shard of keys and counts in the shared folder, written aside and renamed.
3. Tasks map the shards into memory and find the keys of each batch of texts by searchsorted.

The highest count of each B id, at most one number an id of B's vocabulary, is collected while the shards are written.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from brightmill.llm.bpe_automaton import BEYOND, PATTERN, cut_units, with_column
from brightmill.llm.common import byte_characters, cut_lineage, lean, shared_folder

SPACE = "▁"  # a piece's sign for a space
_CHUNK = 20_000  # units of a text that are looked up at a time
_A_BITS = 32


def pack_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return b.astype(np.int64) << _A_BITS | a.astype(np.int64)


class Aligner:
    """Both tokenizers, and the table of units met so far."""

    def __init__(self, byte_path: str, piece_path: str, capacity: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(byte_path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = byte_characters()
        coded = lambda token: bytes(byte_of[c] for c in token)
        labels = {coded(t): i for t, i in spec["model"]["vocab"].items()}
        merged = [labels[coded("".join(p.split(" ") if isinstance(p, str) else p))] for p in spec["model"]["merges"]]
        if merged != sorted(set(merged)):
            raise ValueError(f"{byte_path}: ids must follow the order of the merges")
        self.ids_of_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=labels, special_tokens={}).encode_ordinary
        self.whole_a = Tokenizer.from_file(byte_path)
        self.whole_a.encode_special_tokens = True
        self.bytes_a = [b""] * (max(labels.values()) + 1)
        for label, i in labels.items():
            self.bytes_a[i] = label
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError(f"{piece_path}: pieces with a space behind other characters aren't supported")
        self.bytes_b = [bytes((int(p[3:5], 16),)) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = [self.b.piece_to_id(SPACE)]
        self.lengths_b = [len(x) for x in self.bytes_b]
        self.length_a, self.length_b = np.array([len(x) for x in self.bytes_a]), np.array(self.lengths_b)
        self.decimal = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.capacity = capacity
        self.sizes = np.zeros((capacity + _CHUNK, 3), np.int64)  # ids of A and of B, and groups, of each unit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.links: list[bytes] = []
        self.groups: list[str] = []
        self.bad: set[int] = set()

    def _encode_a(self, text: str) -> list[int]:
        return self.whole_a.encode(text, add_special_tokens=False).ids if BEYOND.search(text) else self.ids_of_a(text)

    def _encode_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, each with the space that the model sets before it."""
        return [ids if t else self.space for t, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True)]

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], list[str]]:
        """For each text with a space before it: a row of its numbers of ids of A and of B and of its groups, its packed links
        and its groups as text. The row is -1 where the bytes of B's ids aren't the text's."""
        coded = [(" " + t).encode() for t in texts]
        all_a, all_b = [self._encode_a(" " + t) for t in texts], self._encode_b(texts)
        wrong = [i for i, (c, b) in enumerate(zip(coded, all_b, strict=True)) if sum(map(self.lengths_b.__getitem__, b)) != len(c)]
        for i in wrong:
            coded[i], all_a[i], all_b[i] = b"", [], []
        a, b = (list(chain.from_iterable(side)) for side in (all_a, all_b))
        if b"".join([self.bytes_b[i] for i in b]) != b"".join(coded):  # right lengths, other bytes
            more = [i for i, c in enumerate(coded) if b"".join([self.bytes_b[x] for x in all_b[i]]) != c]
            wrong += more
            for i in more:
                all_a[i], all_b[i] = [], []
            a, b = (list(chain.from_iterable(side)) for side in (all_a, all_b))
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = self.length_a[a_ids].cumsum(), self.length_b[b_ids].cumsum()  # in all texts, one behind the other
        ends = np.zeros((2, int(a_ends[-1]) + 1 if a else 1), bool)
        ends[0, a_ends], ends[1, b_ends] = True, True
        at_a, at_b = np.flatnonzero(ends[1, a_ends]), np.flatnonzero(ends[0, b_ends])  # of the tokens that end a group
        links = pack_pairs(a_ids[at_a], b_ids[at_b]).tobytes()
        sizes = np.array([[len(x) for x in all_a], [len(x) for x in all_b], [0] * len(texts)], np.int64).T
        last = np.searchsorted(at_a, np.cumsum(sizes[:, 0]))  # each text's end is a group's
        sizes[:, 2] = np.diff(last, prepend=0)
        sizes[wrong] = -1
        sa, sb, groups, i, j = [self.decimal[x] for x in a], [self.decimal[x] for x in b], [], 0, 0
        for x, y in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            if x - i == 1 == y - j:
                groups.append(f"{sa[i]}|{sb[j]}")
            else:
                groups.append(f"{','.join(sa[i:x])}|{','.join(sb[j:y])}")
            i, j = x, y
        cuts = [0, *last.tolist()]
        return sizes, [links[8 * x : 8 * y] for x, y in pairwise(cuts)], [";".join(groups[x:y]) for x, y in pairwise(cuts)]

    def numbers(self, keys: list[str]) -> list[int]:
        """The table's numbers of units (without their first space), which it takes in if they are new."""
        found = list(map(self.known.get, keys))
        if None in found:
            new = list(dict.fromkeys(k for k, n in zip(keys, found, strict=True) if n is None))
            first = len(self.links)
            sizes, links, groups = self.align(new)
            self.bad.update((first + np.flatnonzero(sizes[:, 0] < 0)).tolist())
            self.sizes[first : first + len(new)] = np.maximum(sizes, 0)
            self.links += links
            self.groups += groups
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            found = [self.known[k] if n is None else n for k, n in zip(keys, found, strict=True)]
        return found

    @property
    def full(self) -> bool:
        return len(self.links) > self.capacity

    @staticmethod
    def keys(text: str) -> list[str]:
        """The units of the text with a space before it, without their first spaces."""
        return cut_units(" " + text)[1]


@functools.lru_cache(maxsize=1)
def aligner_of(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, where, weights)
    return found, out


MEASURED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, key long, n long"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
_NAMES = [part.split()[0] for part in MEASURED.split(", ")]


def _rows(*columns: list | np.ndarray | None) -> pa.RecordBatch:
    size = next(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)


def measure(df: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over the texts: for each row its numbers of ids and groups, the digest of its groups and its packed links,
    compressed; and rows (key, n) with the task's partial counts of links."""
    if not isinstance(df.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} must be of an integral type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(byte_path, piece_path)
        times = np.zeros(len(aligner.sizes), np.int64)

        def counted() -> Iterator[pa.RecordBatch]:
            used = np.flatnonzero(times)
            if len(used):
                links = np.frombuffer(b"".join([aligner.links[i] for i in used.tolist()]), np.int64)
                keys, n = _summed(links, np.repeat(times[used], aligner.sizes[used, 2]))
                for i in range(0, len(keys), 50_000):
                    yield _rows(None, None, None, None, None, None, keys[i : i + 50_000], n[i : i + 50_000])
            times[:] = 0

        def room() -> Iterator[pa.RecordBatch]:
            if aligner.full:
                yield from counted()
                aligner.clear()

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [0, 0, 0, "", b""]
                units = aligner.keys(value) if value else []
                ok = bool(units) and SPACE not in value and not (len(units) > _CHUNK and (yield from bad(aligner, units, room)))
                sizes, links, digest = np.zeros(3, np.int64), [], hashlib.sha256()
                for i in range(0, len(units) if ok else 0, _CHUNK):
                    yield from room()
                    numbers = aligner.numbers(units[i : i + _CHUNK])
                    if aligner.bad and not aligner.bad.isdisjoint(numbers):  # only in a text that is looked up at once; nothing is counted yet
                        ok = False
                        break
                    where = np.array(numbers)
                    times[: len(aligner.links)] += np.bincount(where, minlength=len(aligner.links))
                    sizes += aligner.sizes[where].sum(axis=0)
                    links += map(aligner.links.__getitem__, numbers)
                    digest.update((";" * (i > 0) + ";".join(map(aligner.groups.__getitem__, numbers))).encode())
                if ok:
                    found = [*map(int, sizes), digest.hexdigest(), pa.compress(b"".join(links), "zstd", asbytes=True)]
                for column, x in zip(out, [key, *found], strict=True):
                    column.append(x)
            if out[0]:
                yield _rows(*out, None, None)
        yield from counted()

    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lean(run), MEASURED)


def bad(aligner: Aligner, units: list[str], room: Callable[[], Iterator]) -> Iterator:
    """Whether B's ids of a unit don't spell it; yields what `room` does."""
    for i in range(0, len(units), _CHUNK):
        yield from room()
        numbers = aligner.numbers(units[i : i + _CHUNK])
        if aligner.bad and not aligner.bad.isdisjoint(numbers):
            return True
    return False


def _store(folder: str) -> tuple[filesystems.FileSystem, str]:
    """The file system of a folder's path or URI, and the folder's path there."""
    if folder.startswith("/"):
        return filesystems.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return filesystems.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return filesystems.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


@dataclass(frozen=True)
class PairCounts:
    """Shards of sorted keys with their counts in a shared folder, and the highest count of each B id."""

    folder: str
    shards: tuple[tuple[str, int, int], ...]  # name, first key and number of keys, in the keys' order
    best: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """(a_id, b_id, n) of every pair that is linked anywhere, read from the shards in tasks."""
        folder, one_a = self.folder, (1 << _A_BITS) - 1

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    keys, counts = open_shard(folder, name)
                    for i in range(0, len(keys), 50_000):
                        k = np.asarray(keys[i : i + 50_000])
                        yield pa.RecordBatch.from_arrays([pa.array(k & one_a), pa.array(k >> _A_BITS), pa.array(np.asarray(counts[i : i + 50_000]))], ["a_id", "b_id", "n"])

        names = spark.createDataFrame([(s[0],) for s in self.shards], "name string")
        return names.repartition(max(1, len(self.shards)), "name").mapInArrow(lean(read), "a_id long, b_id long, n long")


def open_shard(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard: mapped, where the shared folder is mounted; else the shard is read, which has a bounded size."""
    store, path = _store(folder)
    both = []
    for end in ("keys", "counts"):
        if isinstance(store, filesystems.LocalFileSystem):
            both.append(np.memmap(f"{path}/{name}.{end}", np.int64, "r"))
        else:
            with store.open_input_file(f"{path}/{name}.{end}") as file:
                both.append(np.frombuffer(file.read(), np.int64))
    return both[0], both[1]


def count_pairs(partial: DataFrame, vocabulary_b: int, rows_a_shard: int = 4_000_000) -> PairCounts:
    """The sums of partial counts (key, n) as sorted shards of about `rows_a_shard` partial counts each. Without rows there
    are no shards. A repeated or lost task writes the same files again."""
    spark = partial.sparkSession
    folder = shared_folder(spark, f"pairs-{uuid.uuid4().hex}")
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    shards = max(1, -(-partial.count() // rows_a_shard))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name, aside = f"shard-{context.partitionId():06d}", f"{uuid.uuid4().hex}.part"
        store, path = _store(folder)
        first, total = None, 0
        best: dict[int, int] = {}
        last_key, last_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        with store.open_output_stream(f"{path}/{aside}.keys") as keys_out, store.open_output_stream(f"{path}/{aside}.counts") as counts_out:

            def put(keys: np.ndarray, counts: np.ndarray) -> None:
                nonlocal first, total
                if len(keys):
                    first = int(keys[0]) if first is None else first
                    total += len(keys)
                    keys_out.write(keys.tobytes())
                    counts_out.write(counts.tobytes())
                    starts = np.flatnonzero(np.concatenate(([True], np.diff(keys >> _A_BITS) != 0)))
                    for b, top in zip((keys[starts] >> _A_BITS).tolist(), np.maximum.reduceat(counts, starts).tolist(), strict=True):
                        best[b] = max(best.get(b, 0), top)

            for batch in batches:
                keys = np.concatenate((last_key, batch.column(0).to_numpy()))
                n = np.concatenate((last_n, batch.column(1).to_numpy()))
                if not len(keys):
                    continue
                starts = np.flatnonzero(np.concatenate(([True], np.diff(keys) != 0)))  # of runs
                sums = np.add.reduceat(n, starts)
                put(keys[starts[:-1]], sums[:-1])
                last_key, last_n = keys[starts[-1:]], sums[-1:]  # may go on in the next batch
            put(last_key, last_n)
        for end in ("keys", "counts"):
            if total:
                store.move(f"{path}/{aside}.{end}", f"{path}/{name}.{end}")
            else:
                store.delete_file(f"{path}/{aside}.{end}")
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([total]), pa.array([list(best)], pa.list_(pa.int64())), pa.array([list(best.values())], pa.list_(pa.int64()))], ["name", "first", "total", "b", "top"])

    ordered = partial.select("key", "n").repartitionByRange(shards, "key").sortWithinPartitions("key")
    found = sorted(ordered.mapInArrow(lean(write), "name string, first long, total long, b array<long>, top array<long>").collect(), key=lambda r: r.first)
    best = np.zeros(vocabulary_b, np.int64)
    for r in found:
        np.maximum.at(best, np.array(r.b), np.array(r.top))
    return PairCounts(folder, tuple((r.name, r.first, r.total) for r in found), best)


class Lookup:
    """Counts of keys from the shards, opened when a key first falls into them; few are open at a time."""

    def __init__(self, folder: str, shards: tuple[tuple[str, int, int], ...], most: int = 64):
        self.folder, self.names, self.firsts = folder, [s[0] for s in shards], np.array([s[1] for s in shards], np.int64)
        self.open = functools.lru_cache(maxsize=most)(lambda name: open_shard(folder, name))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted distinct keys that all are in the shards."""
        out = np.zeros(len(keys), np.int64)
        ends = np.searchsorted(keys, self.firsts[1:])
        for name, i, j in zip(self.names, [0, *ends], [*ends, len(keys)], strict=True):
            if i < j:
                stored, counts = self.open(name)
                out[i:j] = counts[np.searchsorted(stored, keys[i:j])]
        return out


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def score(measured: DataFrame, counts: PairCounts) -> DataFrame:
    """For each row of `measure`: its links, how many of them have their B id's highest count (ties count), and their counts' sum."""
    folder, shards = counts.folder, counts.shards
    best = measured.sparkSession.sparkContext.broadcast(counts.best)  # one number an id of B
    names = [part.split()[0] for part in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(folder, shards)
        for batch in batches:
            n_links = batch.column(3).to_numpy()
            packed = [np.frombuffer(pa.decompress(x, 8 * n, "zstd", asbytes=True), np.int64) if n else np.zeros(0, np.int64) for x, n in zip(batch.column(5).to_pylist(), n_links.tolist(), strict=True)]
            keys, where = np.unique(np.concatenate([*packed, np.zeros(0, np.int64)]), return_inverse=True)
            found = lookup(keys) if len(keys) else np.zeros(0, np.int64)
            is_best = (found == best.value[keys >> _A_BITS]).astype(np.int64)
            ends = np.cumsum(n_links)
            sums = [np.diff(np.concatenate(([0], np.cumsum(x[where])))[np.concatenate(([0], ends))]) for x in (is_best, found)]
            columns = [*batch.columns[:4], batch.column(3), pa.array(sums[0]), pa.array(sums[1]), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = measured.where("key is null").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return rows.mapInArrow(lean(run), SCORED)


def audit(df: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (`SCORED`) for each row of `df`.

    Special strings in texts are plain text. Null and empty texts, and texts of which B's ids don't spell the bytes (such as
    those with the piece sign for a space), have no tokens: zeros and an empty digest. Ids must be of an integral type
    (TypeError); null ids and repeated rows are rows as any other, and all of them count. Texts may have any length; a text's
    links are held by one task. An empty table gives an empty one; other columns are not read, whatever their names.
    """
    measured = cut_lineage(measure(df, byte_path, piece_path, doc_id, text))
    return score(measured, count_pairs(measured.where("key is not null"), _vocabulary(piece_path)))


def pair_table(df: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a_id, b_id, n) of every pair that is linked anywhere in the texts; rows as in `audit`."""
    measured = cut_lineage(measure(df, byte_path, piece_path, doc_id, text).where("key is not null"))
    return count_pairs(measured, _vocabulary(piece_path)).table(df.sparkSession)


def _vocabulary(piece_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()


def group_texts(df: DataFrame, byte_path: str, piece_path: str, text: str = "text", groups: str = "groups") -> DataFrame:
    """`df` with the column `groups`: each text's groups as decimal ids, A's before B's (`a1,a2|b1;a3|b2,b3`); empty where `audit`
    finds no tokens."""
    def make() -> Callable:
        aligner = aligner_of(byte_path, piece_path)

        def change(value: str | None) -> str:
            if not value:
                return ""
            return aligner.align([value])[2][0]

        return change

    return with_column(df, groups, "string", pa.string(), make, text)
