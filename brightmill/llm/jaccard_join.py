"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the groups that its links form.

A text's set is its distinct shingles of k words as 64-bit hashes. Texts with equal sets are one *class*,
known by a 128-bit digest; only classes are joined. Two sets of n and m shingles with similarity t share at
least o = ceil(t (n + m) / (1 + t)) of them, so with all shingles in one global order (rare ones first) at
least l of the first n - o + l of either are shared, for every l up to o.

1. Each class lists the first shingles of its prefix, up to the longest l, as postings. The order comes from
   count sketches of fixed size over all texts; it decides cost only, never results.
2. In each shingle's list the most widespread class is the *leader*. Every class is verified against the
   leaders of its lists, one row a posting; what links forms first components. A large group of near copies
   so needs a star of comparisons instead of all pairs.
3. Each class chooses l by the estimated cost of its candidates from its lists' lengths: a longer prefix with
   more matches wanted, where its lists are long. Lists are joined; pairs that are in one component already, or
   fail the size and position bounds, are left out; a pair with l matches is verified. Lists all of whose classes
   are in one component take no part.
4. Links of both rounds give the components: minimum labels over the links, with pointer jumping.

Every link between classes of different components is found, so the components are those of the full join.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from brightmill.llm.common import SLICE, check_names, cut_lineage, discard, lean, rest_driver, slices

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # finaliser of splitmix64 (fixed values)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses; kept for the process."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * SLICE)
        _POWERS.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte's place of each word of lower-cased UTF-8 text."""
    raw = np.frombuffer(data, np.uint8)
    blank = np.concatenate(([True], _BLANK[raw], [True]))
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    power, inverse = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * power[: len(raw)], dtype=np.uint64)))
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP), starts


def _text_words(text: str) -> np.ndarray:
    """Word hashes of one long text, by pieces that end at a blank."""
    data, out, at = text.encode("utf-8", "surrogatepass").lower(), [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        out.append(word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _chain(words: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        out = out * _M1 + words[j : len(words) - k + 1 + j] + np.uint64(j)
    return _mix(out)


def text_words(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    for _, run in slices(texts):
        if len(run) == 1 and len(run[0]) > SLICE:
            yield _text_words(run[0])
            continue
        coded = [t.encode("utf-8", "surrogatepass").lower() for t in run]
        words, starts = word_hashes(b"\n".join(coded))
        firsts = np.cumsum([0] + [len(c) + 1 for c in coded])[:-1]
        yield from np.split(words, np.searchsorted(starts, firsts[1:]))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; with fewer than k words one for all of them."""
    return _chain(words, min(k, len(words))) if len(words) else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for words in text_words(texts):
        yield np.unique(shingle_hashes(words, k))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


SKETCH_BITS = 16
SHIFT = np.uint64(64 - SKETCH_BITS)
PARITY_BITS = 512
SEEN = 100_000  # classes that a task remembers as listed
SET_BYTES = 1 << 20  # of the sets in one batch


def parity(shingles: np.ndarray) -> list[int]:
    """For each of 512 cells, whether an odd number of shingles falls into it, as 8 numbers of 64 bits. Two sets differ
    in at least as many shingles as their parities differ in bits."""
    odd = np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


class JaccardJoin:
    """The join for shingles of `k` words and a similarity of `percent` / 100 or more."""

    def __init__(self, k: int = 5, percent: int = 80, most_matches: int = 3, verify_cost: float = 20.0, broadcast_rows: int = 300_000):
        self.k, self.percent, self.most_matches, self.verify_cost, self.broadcast_rows = k, percent, most_matches, verify_cost, broadcast_rows

    # Bounds, the same for Python integers and columns.
    def smallest(self, n):
        """Size of the smallest set that can link with one of n."""
        return -((-self.percent * n) // 100)

    def overlap(self, total: Column) -> Column:
        """Shingles that two sets with `total` shingles together must share to link."""
        return F.ceil(total * self.percent / (100 + self.percent) - 1e-9)

    def links(self, shared: Column, total: Column) -> Column:
        return (shared > 0) & (100 * shared >= self.percent * (total - shared))

    def read(self, docs: DataFrame) -> DataFrame:
        """One pass over the texts: for every row doc_id, class (null for the empty set), n and parity, and, at a task's
        end, one row with counts: how many texts hold a shingle, and how many words there are, in each sketch cell."""
        k, cells = self.k, 1 << SKETCH_BITS
        names = ["doc_id", "class", "n", "parity", "counts"]
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary())

        def rows(*columns: list | np.ndarray | None) -> pa.RecordBatch:
            size = next(len(c) for c in columns if c is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(2 * cells, np.int64)
            for batch in batches:
                for a in range(0, len(batch), 500):
                    part = batch[a : a + 500]
                    words = list(text_words(part.column(1).to_pylist()))
                    sets = [np.unique(shingle_hashes(w, k)) for w in words]
                    found = [(digest(s) if len(s) else None, len(s), parity(s)) for s in sets]
                    for half, hashes in ((counts[:cells], sets), (counts[cells:], words)):
                        half += np.bincount((np.concatenate(hashes) >> SHIFT).astype(np.int64), minlength=cells)
                    yield rows(part.column(0), *zip(*found, strict=True), None)
            yield rows(None, None, None, None, [zlib.compress(counts.tobytes(), 1)])

        return docs.mapInArrow(lean(run), "doc_id long, class binary, n int, parity array<long>, counts binary")

    def order(self, read: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Levels that put rare shingles first: of a shingle's cell, if that is far above the other cells, and of
        each of its words' cells. Both come from counts over all texts in 2**SKETCH_BITS cells, whatever the corpus
        is. Levels are whole numbers, so that all machines agree on the order."""
        cells = 1 << SKETCH_BITS
        out = np.zeros(2 * cells, np.int64)

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * cells, np.int64)
            for batch in batches:
                for packed in batch.column(0).to_pylist():
                    total += np.frombuffer(zlib.decompress(packed), np.int64)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["cell", "total"])

        found = read.where("counts is not null").select("counts").mapInArrow(lean(unpack), "cell int, total long").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
        out[found.column("cell").to_numpy()] = found.column("total").to_numpy()
        sets, words = out[:cells].astype(float), out[cells:].astype(float)
        middle = np.median(sets)
        spread = max(1.4826 * float(np.median(np.abs(sets - middle))), math.sqrt(middle), 1.0)
        excess = np.maximum(sets - middle, 1)
        heavy = np.where(excess > 6 * spread, 1 + np.round(4 * np.log2(excess)), 0)
        return heavy.astype(np.int64), np.round(16 * np.log2(1 + words)).astype(np.int64)

    def postings(self, docs: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """token, class, n and pos (from 1) of each class's prefix, mostly once a task."""
        k, smallest, extra = self.k, self.smallest, self.most_matches
        order = docs.sparkSession.sparkContext.broadcast(order)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            heavy, level = order.value
            for batch in batches:
                tokens, classes, sizes, places = [], [], [], []
                for words in text_words(batch.column(1).to_pylist()):
                    s, first = np.unique(shingle_hashes(words, k), return_index=True)
                    if not len(s) or (d := digest(s)) in seen:
                        continue
                    if len(seen) >= SEEN:  # what is listed again only costs a row
                        seen.clear()
                    seen.add(d)
                    length = min(len(s), len(s) - smallest(len(s)) + extra)
                    sums = np.concatenate(([0], np.cumsum(level[(words >> SHIFT).astype(np.int64)])))
                    width = min(k, len(words))
                    rare = (sums[width:] - sums[:-width])[first] + (heavy[(s >> SHIFT).astype(np.int64)] << 20)
                    rank = np.lexsort((s, rare))[:length]
                    tokens.append(s[rank].astype(np.int64))
                    classes += [d] * length
                    sizes.append(np.full(length, len(s), np.int32))
                    places.append(np.arange(1, length + 1, dtype=np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(classes, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], ["token", "class", "n", "pos"])

        return docs.mapInArrow(lean(run), "token long, class binary, n int, pos int")

    def lists(self, docs: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """The postings of shingles that more than one class lists, with the list's length and leader.

        `probe` and `index` are the smallest l for which the posting is in the class's prefix towards smaller or
        equal sets, and towards equal or larger ones."""
        raw = self.postings(docs, order).repartition("token")
        one = raw.groupBy("token", "class").agg(F.first("n").alias("n"), F.first("pos").alias("pos"), F.count("*").alias("spread"))
        n, pos = F.col("n"), F.col("pos")
        one = one.withColumns({
            "probe": F.greatest(F.lit(1), pos - (n - self.smallest_column(n))).cast("int"), "index": F.greatest(F.lit(1), pos - (n - self.overlap(2 * n))).cast("int"),
        })
        # a window instead of a join with the counts: the postings are shuffled once, and long lists spill
        of_token = Window.partitionBy("token")
        lead = F.max(F.struct("spread", "class", "n")).over(of_token)
        listed = one.withColumns({"length": F.count("*").over(of_token), "lead": lead}).where("length > 1")
        return listed.select("token", "class", "n", "pos", "probe", "index", "length", F.col("lead.class").alias("lead"), F.col("lead.n").alias("lead_n"))

    def smallest_column(self, n: Column) -> Column:
        return F.ceil(n * self.percent / 100 - 1e-9)

    def verified(self, docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of classes that link, by their whole sets.

        First their parities rule out pairs that differ in too many shingles; this never rules out a link."""
        k = self.k
        asked = pairs = cut_lineage(pairs)
        # doc_id: of each class one text is enough to read its set again
        known = cut_lineage(
            sets.join(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class")
            .groupBy("class").agg(F.min("n").alias("n"), F.min("parity").alias("parity"), F.min("doc_id").alias("doc_id"))
        )
        side = lambda x: known.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
        differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        total = F.col("na") + F.col("nb")
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(differ <= total - 2 * self.overlap(total)).select("a", "b")
        pairs = cut_lineage(near)
        discard(asked)
        needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        chosen = cut_lineage(known.join(needed, "class").select("doc_id", "class"))
        discard(known)
        keys = chosen.select(F.col("doc_id").alias("__id")).distinct()
        keys = F.broadcast(keys) if keys.count() <= self.broadcast_rows else keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows(found: list[np.ndarray]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([digest(s) for s in found], pa.binary()), pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64()))], ["class", "shingles"])

            for batch in batches:
                found, size = [], 0
                for s in shingle_sets(batch.column(1).to_pylist(), k):
                    if len(s):
                        found.append(s)
                        size += s.nbytes
                    if size >= SET_BYTES:
                        yield rows(found)
                        found, size = [], 0
                if found:
                    yield rows(found)

        texts = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        whole = texts.mapInArrow(lean(run), "class binary, shingles array<long>").join(chosen.select("class"), "class").groupBy("class").agg(F.first("shingles").alias("shingles"))
        whole = cut_lineage(whole)
        left = whole.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
        right = whole.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("shared"), (F.size("sa") + F.size("sb")).alias("total"))
        links = cut_lineage(both.where(self.links(F.col("shared"), F.col("total"))).select("a", "b"))
        discard(pairs, chosen, whole)
        rest_driver(links)
        return links

    def leader_pairs(self, lists: DataFrame) -> DataFrame:
        small, large = F.least("n", "lead_n"), F.greatest("n", "lead_n")
        return lists.where((F.col("class") != F.col("lead")) & (small * 100 >= large * self.percent)).select(F.col("class").alias("a"), F.col("lead").alias("b")).distinct()

    def matches(self, lists: DataFrame) -> DataFrame:
        """class and l: the number of matches wanted, by least estimated cost.

        With l, the postings met are the sum of the lengths of the lists in the prefix, and the candidates at
        most that sum over l, each of which costs `verify_cost` postings to verify."""
        met = [F.sum(F.when(F.col("probe") <= l, F.col("length")).otherwise(0)) for l in range(1, self.most_matches + 1)]
        costs = F.array(*[F.struct((s * (1 + self.verify_cost / l)).alias("cost"), F.lit(l).alias("l")) for l, s in enumerate(met, 1)])
        return lists.groupBy("class").agg(F.array_min(costs).getField("l").alias("l"))

    def cross_pairs(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """Candidates between different components of `labels` (node, label)."""
        # in a list of two, one is the leader: that pair has been verified
        lists = lists.where("length > 2")
        known = lists.select("token", "class", "n", "pos", "probe", "index").join(labels.select(F.col("node").alias("class"), "label"), "class", "left")
        known = cut_lineage(known.withColumn("label", F.coalesce("label", "class")).join(self.matches(lists), "class"))
        mixed = known.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("token")
        known = known.join(mixed, "token")
        index = known.where(F.col("index") <= self.most_matches).select("token", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("index").alias("ib"), F.col("label").alias("lb"))
        probe = known.where(F.col("probe") <= F.col("l")).select("token", F.col("class").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("l").alias("la"), F.col("label").alias("ca"))
        na, nb, wanted = F.col("na"), F.col("nb"), self.overlap(F.col("na") + F.col("nb"))
        met = probe.join(index, "token").where(
            (F.col("ca") != F.col("lb")) & (F.col("ib") <= F.col("la")) & ((nb < na) | ((nb == na) & (F.col("b") < F.col("a")))) & (nb * 100 >= na * self.percent)
            & (F.col("pa") <= na - wanted + F.col("la")) & (F.col("pb") <= nb - wanted + F.col("la"))
        )
        enough = F.col("n") >= F.least(F.col("la"), F.col("wanted"))
        return met.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("la").alias("la"), F.first(wanted).alias("wanted")).where(enough).select("a", "b")

    def run(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, n_shingles and component_id (the smallest doc_id of the component) of every row.

        Ids must be of an integral type (TypeError). Null and empty texts have no shingles, link with nothing and are
        their own component. Repeated rows and ids are rows of their own; null ids take part, but never name a component
        unless it has no other. Similarities of exactly `percent` link. Texts may have any length; a text's set is held by
        one task. An empty table gives an empty one; other columns of `documents` are not read, whatever their names.
        """
        if not isinstance(documents.schema[doc_id].dataType, IntegralType):
            raise TypeError(f"{doc_id} must be of an integral type")
        docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        read = cut_lineage(self.read(docs))
        sets = read.where("counts is null").select("doc_id", "class", "n", "parity")
        lists = cut_lineage(self.lists(docs, self.order(read)))
        rest_driver(lists)
        first = self.verified(docs, sets, self.leader_pairs(lists))
        labels = components(first)
        second = self.verified(docs, sets, self.cross_pairs(lists, labels))
        # the second round's links, drawn between the first round's components
        joined = second.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b", "left")
        between = cut_lineage(joined.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).distinct())
        upper = components(between)
        nodes = labels.select("node", "label").unionByName(upper.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
        top = nodes.join(upper.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select(F.col("node").alias("class"), F.coalesce("top", "label").alias("top"))
        own = sets.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("own"))
        linked = cut_lineage(own.join(top, "class"))
        named = linked.join(linked.groupBy("top").agg(F.min("own").alias("least")), "top").select("class", "least")
        classes = own.join(named, "class", "left").select("class", F.coalesce("least", "own").alias("component"))
        return sets.join(classes, "class", "left").select(
            "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
        )


def components(links: DataFrame) -> DataFrame:
    """(node, label): each node of the links (a, b) with the smallest node of its component.

    Every round takes the smallest label among a node's neighbours and then the label of that label; the
    number of rounds follows the logarithm of a chain's length. Only a count reaches the driver: joins are merge joins, since
    a broadcast for each join of each round would pass through it."""
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    last = labels
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        lower = labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        lower = cut_lineage(lower.join(jump.hint("merge"), "label").select("node", "old", F.least("label", "next").alias("label")))
        discard(last)
        rest_driver(lower)
        last, labels = lower, lower.select("node", "label")
        if not lower.where("label != old").limit(1).count():
            discard(edges)
            return labels


def keep_one(documents: DataFrame, join: JaccardJoin, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 300_000) -> DataFrame:
    """The rows of `documents` but those whose component has a smaller doc_id, all columns kept.

    Texts without shingles and all rows with a null id stay. Rows that share an id go together, if one of them
    does; of rows that share id and text one stays, the first in the order of all other columns (which must have
    one). Column names that begin with two underscores are refused (ValueError).
    """
    check_names(documents)
    groups = cut_lineage(join.run(documents, doc_id, text))

    def counted(df: DataFrame) -> DataFrame:
        df = cut_lineage(df)
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    gone = counted(groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct())
    kept = documents.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")
    repeated = cut_lineage(groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")))
    if repeated.isEmpty():
        return kept
    repeated, same = counted(repeated), F.col(doc_id) == F.col("__again")
    others = [c for c in documents.columns if c not in (doc_id, text)]
    once = kept.join(repeated, same, "left_semi").groupBy(doc_id, text).agg(F.min(F.struct(F.lit(0).alias("__least"), *others)).alias("__first")).select(doc_id, text, *[F.col("__first")[c].alias(c) for c in others])
    return kept.join(repeated, same, "left_anti").unionByName(once.select(*documents.columns))
