"""Which sources of a language differ in their words, and in which words.

Within a language each source, and the language as a whole, gives each kept term a smoothed share p in units of 10^-9. The
divergence of a source from another (or of a term's share from the language's) is the sum of floor((p - q)^2 / q).
All numbers are whole and exact.

1. A pass over the texts counts terms by language and source, and the documents that hold them; counts are summed in
   tasks before they are shuffled, all rows of a term of a language to one place.
2. Deduplicated count columns: terms with the same sparse vector of counts by source give the same numbers for every pair of
   sources. Terms are grouped by that vector, each pair is evaluated once a distinct vector and multiplied by the number
   of its terms. Where both counts are 0 the value depends on no vector, so a vector adds only what differs from it.
3. Pairs and original terms are ranked.

The result holds a row for each pair of a language's sources, and a vector one number for each source at most.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightmill.llm.common import cut_lineage, lean

UNIT = 1_000_000_000
_TERM = re.compile(b"[A-Za-z\x80-\xff]+")  # in UTF-8: letters of ASCII, and all characters beyond it
HELD = 500_000  # terms that a task holds before it gives its counts away
CELLS = 1 << 18  # numbers in a block of vectors


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count and docs (documents with the term) of each task, and a row with a null term for each
    (lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = defaultdict(Counter)
        docs_of: dict[tuple, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in counts.items():
                held, terms = docs_of[lang, source], list(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.nulls(1, pa.string()), pa.array([0]), pa.array([0])], names)
                for i in range(0, len(terms), 20_000):
                    part = terms[i : i + 20_000]
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([own[t] for t in part]), pa.array([held[t] for t in part])]
                    yield pa.RecordBatch.from_arrays(columns, names)
            counts.clear()
            docs_of.clear()

        names, held = ["lang", "source", "term", "count", "docs"], 0
        for batch in batches:
            for text, lang, source in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = Counter(_TERM.findall((text or b"").lower()))  # of bytes only A-Z are lowered
                group = counts[lang or "", source or ""]
                held -= len(group)
                group.update(own)
                held += len(group)
                docs_of[lang or "", source or ""].update(own.keys())
                if held > HELD:
                    yield from rows()
                    held = 0
        yield from rows()

    return docs.mapInArrow(lean(run), "lang string, source string, term string, count long, docs long")


def _div(a: Column, b: Column) -> Column:
    """Whole division of numbers that aren't negative."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term, from its count, the sum of counts of all kept terms and their number."""
    return 1 + _div(UNIT * (count + 1), total + terms)


def value(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _excess_in_tasks(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and what the vectors add to the value without counts; `groups`, of a checked size, goes to each task."""
    known: dict[str, tuple[list[str], np.ndarray, int]] = {}
    for r in groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g"), F.first("terms").alias("terms")).collect():
        known[r.lang] = [g.source for g in r.g], np.array([g.total for g in r.g], np.int64), r.terms
    known = vectors.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        places = {lang: {s: i for i, s in enumerate(g[0])} for lang, g in known.value.items()}

        def add(lang: str, rows: list[tuple[list[dict], int]]) -> None:
            sources, totals, terms = known.value[lang]
            where = places[lang]
            entries = [(r, where[e["source"]], e["count"]) for r, (vector, _) in enumerate(rows) for e in vector]
            row, at, n = (np.array(x, np.int64) for x in zip(*entries, strict=True))
            times = np.array([m for _, m in rows], np.int64)[row][:, None]
            below = totals + terms
            none = 1 + UNIT // below  # the share without a count
            shares = np.repeat(none[None], len(rows), axis=0)
            shares[row, at] = 1 + UNIT * (n + 1) // below[at]
            here, all_ = shares[row, at][:, None], shares[row]
            still = (none[:, None] - none) ** 2 // none  # source down, item across
            total = sums.setdefault(lang, np.zeros((len(sources), len(sources)), np.int64))
            np.add.at(total, at, times * ((here - all_) ** 2 // all_ - still[at]))
            counted = np.zeros(shares.shape, bool)
            counted[row, at] = True
            np.add.at(total.T, at, np.where(counted[row], 0, times * ((all_ - here) ** 2 // here - still.T[at])))

        for batch in batches:
            by_lang: dict[str, list] = defaultdict(list)
            for r in batch.to_pylist():
                by_lang[r["lang"]].append((r["vector"], r["times"]))
            for lang, rows in by_lang.items():
                step = max(1, CELLS // len(known.value[lang][0]) // 4)
                for i in range(0, len(rows), step):
                    add(lang, rows[i : i + step])
        for lang, total in sums.items():
            names = known.value[lang][0]
            for i, name in enumerate(names):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array([name] * len(names)), pa.array(names), pa.array(total[i])], ["lang", "source", "item", "excess"])

    return vectors.select("lang", "vector", "times").mapInArrow(lean(run), "lang string, source string, item string, excess long")


def _excess_by_joins(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """The same for any number of sources, by shuffled joins."""
    entries = cut_lineage(vectors.withColumn("id", F.monotonically_increasing_id()).select("lang", "id", "times", F.explode("vector").alias("e")).select("lang", "id", "times", F.col("e.source").alias("source"), F.col("e.count").alias("count")))
    side = lambda name, total: groups.select("lang", F.col("source").alias(name), F.col("total").alias(total), "terms")
    own = lambda name, count: entries.select("id", F.col("source").alias(name), F.col("count").alias(count))
    ours = entries.withColumnRenamed("count", "cs").join(side("source", "ns"), ["lang", "source"]).join(side("item", "nt").drop("terms"), "lang").join(own("item", "ct"), ["id", "item"], "left")
    theirs = entries.withColumnsRenamed({"source": "item", "count": "ct"}).join(side("item", "nt"), ["lang", "item"]).join(side("source", "ns").drop("terms"), "lang").join(own("source", "cs"), ["id", "source"], "left_anti").withColumn("cs", F.lit(0))
    both = ours.withColumn("ct", F.coalesce("ct", F.lit(0))).unionByName(theirs)
    p = lambda c, n: share(c, F.col(n), F.col("terms"))
    changed = value(p(F.col("cs"), "ns"), p(F.col("ct"), "nt")) - value(p(F.lit(0), "ns"), p(F.lit(0), "nt"))
    return both.select("lang", "source", "item", (F.col("times") * changed).alias("excess"))


def audit(documents: DataFrame, least_docs: int = 3, top_terms: int = 200, text: str = "text", lang: str = "lang", source: str = "source", broadcast_groups: int = 20_000) -> DataFrame:
    """lang, source, part, item, value and rank: for every (lang, source) that occurs, part `pair` with each other source of
    the language, and part `term` with the `top_terms` terms whose share is above the language's.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lowered; a language keeps those in at least
    `least_docs` of its rows. Null texts, languages and sources are empty ones; a group without kept terms has value 0 with
    all others if the language keeps no term. Repeated rows are documents of their own. Equal values are ranked by the
    item's bytes. Texts may have any length; an empty table gives an empty one; other columns, ids too, are not read. Numbers of
    groups and of their terms go to every task while there are at most `broadcast_groups` groups; beyond, joins are shuffled.
    """
    partial = term_counts(documents.select(F.col(text).cast("string"), F.col(lang).cast("string"), F.col(source).cast("string")))
    counted = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    terms = counted.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "count"))).alias("vector"), F.sum("docs").alias("docs"))
    terms = cut_lineage(terms.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).drop("docs"))
    kept = terms.where("term is not null")
    entries = kept.select("lang", "term", F.explode("vector").alias("e"), F.aggregate("vector", F.lit(0).cast("long"), lambda t, e: t + e["count"]).alias("all")).select("lang", "term", "all", "e.*")
    groups = terms.where("term is null").select("lang", F.explode("vector.source").alias("source"))
    groups = groups.join(entries.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left")
    groups = groups.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = cut_lineage(groups.withColumn("total_lang", F.sum("total").over(Window.partitionBy("lang"))))
    few = groups.count() <= broadcast_groups
    small = F.broadcast if few else lambda df: df

    vectors = kept.groupBy("lang", "vector").agg(F.count("*").alias("times"))
    excess = (_excess_in_tasks if few else _excess_by_joins)(vectors, groups)
    excess = excess.groupBy("lang", "source", "item").agg(F.sum("excess").alias("excess"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("n"))
    none = value(share(F.lit(0), F.col("total"), F.col("terms")), share(F.lit(0), F.col("n"), F.col("terms")))
    pairs = groups.join(small(other), "lang").where("source != item").join(excess, ["lang", "source", "item"], "left")
    # without terms there is nothing to divide by
    pairs = pairs.select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("terms") * none + F.coalesce("excess", F.lit(0))).otherwise(0).alias("value"))

    p = share(F.col("count"), F.col("total"), F.col("terms"))
    q = share(F.col("all"), F.col("total_lang"), F.col("terms"))
    own = entries.where("count > 0").join(small(groups), ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", F.col("term").alias("item"), value(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(own, "term").where(F.col("rank") <= top_terms))
