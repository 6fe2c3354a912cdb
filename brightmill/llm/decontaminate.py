"""Benchmark decontamination: containment search of short test items inside long documents.

Items and documents are sets of word shingles. Items are partitioned by set size, eight partitions to an octave; an
item's sketch holds its smallest MinHash values (one hash function orders all shingles) among the shingles that the fewest items
hold, as many as its size partition needs: of u shingles at most floor((1 - t) u) may be missing in a document that contains
a share t, so a sketch with one more than that has a hit, a longer one as many more, and the search loses nothing. What many
items share stays out of the sketches that way, unless it is most of an item, so a common template brings no candidates.
A small table of the sketches' hashes lets documents, of any length, show only those shingles that may hit; it decides cost
only. Pairs of a document and an item with enough hits are verified by the exact containment of the shingles as strings.

Words are runs of letters and digits of the lower-cased text. Items with fewer words than a shingle count
as one shingle of all their words. Only DataFrame functions are used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightmill.llm.common import cut_lineage

MOST_BITS = 22  # the table of slots has at most 4 MB


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _positions(w: Column, k: int) -> Column:
    """0-based starts of the shingles; none if there are fewer than k words."""
    return F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, k: int) -> Column:
    return F.transform(_positions(w, k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))


def shingles(w: Column, k: int) -> Column:
    """The distinct shingles as strings."""
    return F.array_distinct(F.transform(_positions(w, k), lambda i: F.concat_ws(" ", F.slice(w, i + 1, k))))


def _small(df: DataFrame, bytes_: int, limit: int) -> DataFrame:
    """Broadcast below a checked size; else a join by shuffle."""
    return F.broadcast(df) if bytes_ <= limit else df


def _slots(sketch: DataFrame, bits: int) -> Column:
    """2^bits bytes, 1 at the low bits of each hash; a literal of bounded size."""
    spots = sketch.select(F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("spot")).distinct().toArrow()
    out = np.zeros(1 << bits, np.uint8)
    out[spots.column("spot").to_numpy()] = 1
    return F.lit(bytearray(out.tobytes()))


def find_contaminated(
    documents: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document and item with at least `threshold` of
    the item's distinct shingles in the document; a share of exactly `threshold` counts.

    Null and empty texts have no shingles and match nothing. Ids may have any type with an order; null ids are kept as
    ids. Of rows that share a doc_id (or an item_id) the best match is given, repeated rows change nothing. Texts may have any
    length; one text's words are worked on in one task. Without items, or documents, the result is empty. Other columns
    of either table are not read, whatever their names. Sketches, shingles of items and ids of candidates are broadcast while
    their counted bytes are at most `broadcast_bytes`, and shuffled beyond.
    """
    tests = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("__words")).where(F.size("__words") > 0)
    tests = tests.withColumn("__k", F.least(F.lit(k), F.size("__words")))
    sizes = sorted(r[0] for r in tests.select("__k").distinct().collect())  # k, and less for items shorter than a shingle
    if not sizes:
        none = documents.select(F.col(doc_id).alias("doc_id")).where(F.lit(False))
        return none.join(items.select(F.col(item_id).alias("item_id")).where(F.lit(False))).selectExpr("doc_id", "item_id", "0L n_shared", "0L n_item", "0D containment")

    def by_size(f, key: Column) -> Column:
        """`f` of the words, with shingles of the row's own size."""
        out = f(sizes[-1])
        for n in sizes[:-1]:
            out = F.when(key == n, f(n)).otherwise(out)
        return out

    w = F.col("__words")
    own = tests.select("item_id", "__k", by_size(lambda n: shingles(w, n), F.col("__k")).alias("__own"), by_size(lambda n: F.array_sort(F.array_distinct(shingle_hashes(w, n))), F.col("__k")).alias("__hashes"))
    own = own.withColumn("__row", F.xxhash64("item_id", "__own"))  # rows that share an item_id may differ
    u = F.size("__hashes")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(u)) - 3, F.lit(0)))
    missing = lambda n: F.floor(n * (1 - threshold) + 1e-9).cast("int")  # noqa: E731  of a partition or item, what may be missing
    length = F.least(u, missing(F.ceil(u / step) * step) + 1)
    own = cut_lineage(own.select("item_id", "__row", "__k", "__own", "__hashes", length.alias("__length"), (length - missing(u)).alias("__wanted")).dropDuplicates(["__row", "__k"]))
    listed = own.select("__row", "__k", "__length", "__wanted", F.explode("__hashes").alias("hash"))
    held = listed.groupBy("__k", "hash").agg(F.count("*").alias("__items"))
    ranked = listed.join(held, ["__k", "hash"]).groupBy("__row", "__k", "__length", "__wanted").agg(F.sort_array(F.collect_list(F.struct("__items", "hash"))).alias("__order"))
    sketch = cut_lineage(ranked.select("__row", "__k", "__wanted", F.explode(F.slice("__order", F.lit(1), F.col("__length"))).alias("__s")).select("__row", "__k", "__wanted", F.col("__s.hash").alias("hash")))
    rows = sketch.count()
    bits = min(MOST_BITS, max(12, (64 * rows).bit_length()))
    slots = _slots(sketch, bits)
    may_hit = lambda h: F.substring(slots, h.bitwiseAND(F.lit((1 << bits) - 1)).cast("int") + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))

    def tagged(values: Column, n: int, name: str) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(n).alias("__k"), x.alias(name)))

    # words stand in a column of their own: as an expression inside a lambda they would be split anew for each shingle
    docs = documents.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("__words"))
    shown = [tagged(F.filter(shingle_hashes(w, n), may_hit), n, "hash") for n in sizes]
    # explode_outer: a plain explode would have its array computed once more, in an inferred filter
    hits = docs.select("doc_id", F.explode_outer(F.concat(*shown)).alias("__h")).select("doc_id", "__h.*")
    hits = hits.where("hash is not null").join(_small(sketch, 40 * rows, broadcast_bytes), ["__k", "hash"]).select("doc_id", "__row", "__wanted", "hash").distinct()
    pairs = hits.groupBy("doc_id", "__row").agg(F.count("*").alias("__hits"), F.first("__wanted").alias("__wanted")).where(F.col("__hits") >= F.col("__wanted"))
    pairs = cut_lineage(pairs.select(F.col("doc_id").alias("__doc"), "__row"))
    candidates = cut_lineage(pairs.select("__doc").distinct())
    met = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).join(
        _small(candidates, 32 * candidates.count(), broadcast_bytes), F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi"
    )
    met = met.select("doc_id", F.xxhash64("__text").alias("__text"), words(F.col("__text")).alias("__words"))
    strings = [tagged(shingles(w, n), n, "shingle") for n in sizes]
    shared = met.select("doc_id", "__text", F.explode_outer(F.concat(*strings)).alias("__s")).select("doc_id", "__text", "__s.*")
    tested = cut_lineage(own.select("item_id", "__row", "__k", F.size("__own").alias("n_item"), F.explode("__own").alias("shingle")))
    size = tested.agg(F.sum(F.octet_length("shingle") + 64)).first()[0]
    # of a document the shingles of any item, then those of the items that it may contain; rows of equal id and text count once
    shared = shared.join(_small(tested.select("__k", "shingle").distinct(), size, broadcast_bytes), ["__k", "shingle"], "left_semi").distinct()
    asked = pairs.join(_small(tested, size, broadcast_bytes), "__row")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("shared.__k") == F.col("asked.__k")) & (F.col("shared.shingle") == F.col("asked.shingle"))
    counted = shared.alias("shared").join(asked.alias("asked"), same).groupBy("doc_id", "__text", "item_id", "__row", "n_item").agg(F.count("*").alias("n_shared"))
    found = counted.where(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - 1e-9))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n_shared").alias("n_shared"), F.col("m.n_item").cast("long").alias("n_item"), (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))


def remove_contaminated(documents: DataFrame, items: DataFrame, broadcast_bytes: int = 64 << 20, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents in which no item is found, with all columns; all rows of an id go if one of them holds an item."""
    found = find_contaminated(documents, items, doc_id=doc_id, broadcast_bytes=broadcast_bytes, **options)
    flagged = cut_lineage(found.select(F.col("doc_id").alias("__flagged")).distinct())
    return documents.join(_small(flagged, 32 * flagged.count(), broadcast_bytes), F.col(doc_id).eqNullSafe(F.col("__flagged")), "left_anti")
