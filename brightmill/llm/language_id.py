"""Language identification with a bit-sliced Bloom filter over character trigrams.

Each language has a Bloom filter of the trigrams of its training texts that are usual there. The filters are
stored bit-sliced: cell i of one table is a bitmask with a bit for each language whose filter has bit i
set, so the AND of an n-gram's k cells is the mask of all languages that contain it (or seem to). For a
text, the masks' bits are counted by language over all its trigrams; a count of h among N is corrected
for the filter's false-positive rate p to (h / N - p) / (1 - p), and the largest share decides.

A trigram is three code points of the lower-cased text in which every run of non-letters is a space,
with a letter in the middle; three code points of 21 bits make an exact 63-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightmill.llm.common import SLICE, cut_lineage, lean, slices

UNKNOWN = "und"
_SPACE = np.uint64(32)
#: Odd multipliers of the k = 3 hash functions (fixed values).
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; built once a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams of the texts and the number of the text each is from."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([len(t) for t in padded])
    letter = _letters()[points]
    keep = letter.copy()  # of a run of non-letters, the first stays
    keep[1:] |= letter[:-1]
    keep[:1] = True
    where = np.flatnonzero(keep)
    clean = np.where(letter, points, 32)[where].astype(np.uint64)
    if len(clean) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = (clean[:-2] << np.uint64(42)) | (clean[1:-1] << np.uint64(21)) | clean[2:]
    middle = clean[1:-1] != _SPACE
    return codes[middle].astype(np.int64), np.searchsorted(bounds, where[1:-1][middle], side="right")


def long_trigrams(text: str) -> Iterator[np.ndarray]:
    """The trigrams of one text of any length, by pieces of `SLICE` characters; all together those of the whole."""
    padded = f" {text.lower()} "
    before, after_letter = np.zeros(0, np.uint64), True
    for a in range(0, len(padded), SLICE):
        points = np.frombuffer(padded[a : a + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        keep = letter | np.concatenate(([after_letter], letter[:-1]))  # of a run of non-letters, the first stays
        clean = np.concatenate((before, np.where(letter, points, 32)[keep].astype(np.uint64)))
        before, after_letter = clean[-2:], bool(letter[-1])
        if len(clean) >= 3:
            codes = (clean[:-2] << np.uint64(42)) | (clean[1:-1] << np.uint64(21)) | clean[2:]
            yield codes[clean[1:-1] != _SPACE].astype(np.int64)


def parts(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first index, number of texts, trigrams, the text each is from) of runs of texts; long ones come in pieces."""
    for start, run in slices(texts):
        if len(run) == 1 and len(run[0]) > SLICE:
            for codes in long_trigrams(run[0]):
                yield start, 1, codes, np.zeros(len(codes), np.int64)
        else:
            yield start, len(run), *trigrams(run)


def _cells(codes: np.ndarray, bits: int) -> np.ndarray:
    """k cells for each code, in rows."""
    u = codes.astype(np.uint64)
    u = (u ^ (u >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((u ^ (u >> np.uint64(29)))[None, :] * _MULTIPLIERS[:, None]) >> np.uint64(64 - bits)


LEAST_BITS, MOST_BITS = 20, 24  # of the number of cells


@dataclass
class LanguageFilter:
    """The bit-sliced filters; `table` has a row a cell and a word for each 64 languages. Its size is
    2**bits cells whatever the corpus is."""

    languages: list[str]
    bits: int
    table: np.ndarray
    rates: np.ndarray  # false-positive rate of each language
    fallback: int  # the language with the most training text

    @classmethod
    def of(cls, languages: list[str], bits: int, table: np.ndarray, fallback: int) -> LanguageFilter:
        word, bit = np.divmod(np.arange(len(languages)), 64)
        used = [int(((table[:, w] >> table.dtype.type(b)) & table.dtype.type(1)).sum()) for w, b in zip(word, bit, strict=True)]
        return cls(languages, bits, table, (np.array(used, float) / (1 << bits)) ** len(_MULTIPLIERS), fallback)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of all languages whose filters hold it."""
        cells = _cells(codes, self.bits)
        out = self.table[cells[0]]
        for row in cells[1:]:
            out &= self.table[row]
        return out

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of trigrams of each text, and how many of them each language's filter holds."""
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for start, size, codes, owner in parts(texts):
            total[start : start + size] += np.bincount(owner, minlength=size)
            masks = self.masks(codes)
            for n in range(len(self.languages)):
                bit = (masks[:, n // 64] >> masks.dtype.type(n % 64)) & masks.dtype.type(1)
                hits[start : start + size, n] += np.bincount(owner, weights=bit, minlength=size)
        return total, hits

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share of the corrected counts."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, hits = self.count(texts)
        tells = self.rates < 1  # a full filter tells nothing
        share = np.where(tells, np.maximum(0, (hits / np.maximum(total, 1)[:, None] - self.rates) / np.where(tells, 1 - self.rates, 1)), 0)
        best = share.argmax(axis=1)
        none = share.max(axis=1) == 0
        best[none] = self.fallback
        weight = np.where(none, 0, share[np.arange(len(texts)), best] / np.maximum(share.sum(axis=1), 1e-12))
        unknown = total == 0
        return [UNKNOWN if u else self.languages[b] for u, b in zip(unknown, best, strict=True)], np.where(unknown, 0.0, weight)


def fit(training: DataFrame, text: str = "text", lang: str = "lang", min_rate: float = 2e-5, bits: int | None = None) -> LanguageFilter:
    """Counts every trigram of every training row (null texts and languages are left out) and puts into a
    language's filter those that make up at least `min_rate` of its trigrams; 0 puts all of them in.

    Trigrams are counted by task before the shuffle. Tasks set the filters' bits; the driver receives at most one mask
    for each of the 2**bits cells (and 64 languages). Without `bits` there are eight cells or more for each trigram of the largest
    filter, from 2**20 up to 2**24, which a filter of 1/min_rate trigrams never needs; a filter that is full nevertheless counts 0
    for every text. No training rows give no languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(langs):
                for _, _, codes, _ in parts([t for t, x in zip(texts, langs, strict=True) if x == name]):
                    found = gathered.setdefault(name, [])
                    found.append(np.unique(codes, return_counts=True))
                    if len(found) > 8:
                        gathered[name] = [merge(found)]
        for name, found in gathered.items():
            codes, counts = merge(found)
            for a in range(0, len(codes), 50_000):
                n = len(codes[a : a + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(codes[a : a + n]), pa.array(counts[a : a + n])], ["lang", "gram", "n"])

    rows = training.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    counts = rows.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = {r["lang"]: r["total"] for r in total.collect()}
    languages = sorted({r["lang"] for r in rows.select(lang).distinct().withColumnRenamed(lang, "lang").collect()})
    number = {x: i for i, x in enumerate(languages)}
    usual = counts.join(F.broadcast(total), "lang").where(F.col("n") >= min_rate * F.col("total")).select("lang", "gram")
    if bits is None:
        largest = usual.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, (8 * largest).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), np.uint64)
        for batch in batches:
            names = np.array([number[x] for x in batch.column(0).to_pylist()], int)
            codes = batch.column(1).to_numpy()
            for n in np.unique(names):
                table[n // 64, _cells(codes[names == n], bits)] |= np.uint64(1 << (n % 64))
        word, cell = table.nonzero()
        for a in range(0, len(cell), 100_000):
            w, c = word[a : a + 100_000], cell[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(table[w, c].view(np.int64))], ["word", "cell", "mask"])

    masks = usual.mapInArrow(lean(fill), "word int, cell int, mask long").groupBy("word", "cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
    table[masks.column("cell").to_numpy(), masks.column("word").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    fallback = number[max(languages, key=lambda x: (totals.get(x, 0), x))] if languages else 0
    return LanguageFilter.of(languages, bits, table.astype(np.uint8) if len(languages) <= 8 else table, fallback)


def predict(df: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (replacing columns of these names). Without a letter, or null: `und`, 0. Ties take the first
    language in order, texts with no known trigram the one with most training text. Repeated rows have equal results, long
    texts those of their whole; an empty table gives an empty one."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = shared.value.score(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    judged = df.withColumn("__judged", F.arrow_udf(lean(judge), "struct<lang_pred:string,score:double>")(F.col(text)))
    return judged.withColumns({"lang_pred": F.col("__judged.lang_pred"), "score": F.col("__judged.score")}).drop("__judged")
