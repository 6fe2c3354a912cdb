"""Line dedup with content-defined line chunks.

A rolling polynomial hash over the hashes of two adjacent lines gives each line a value; a chunk ends
where that value is a local minimum. Boundaries so depend on neighbouring lines only, chunks have at least
two lines (but at a text's ends), and a passage has the same inner boundaries wherever it is shifted to.
A line of `long_words` or more words is a chunk of its own.

Chunks of two or more lines, and such long lines, that occur more than once in the corpus are removed but
for their first occurrence (by doc_id, text digest and place). Lines are hashed once; of each chunk a 64-bit hash and its
place are shuffled and counted. Only chunks with a repeated hash are read again, and equality of the bytes decides.

A chunk at a passage's edge mixes with the lines around it, so chunks alone leave most short passages in place.
`dedup_passages` finds each repeated passage whole, as far as it has whole lines or sentences: units are lines, cut
further at ends of sentences, and each shortest run of units that reaches 30 words is compared, whichever unit it
starts or ends with. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightmill.llm.common import check_names, cut_lineage

BASE, PRIME = 31, 4_294_967_291  # of the rolling hash
_SHIFT = 1 << 31  # a chunk is coded as start * 2^31 + end


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _start(code: Column) -> Column:
    return F.shiftright(code, 31).cast("int")


def _end(code: Column) -> Column:
    return code.bitwiseAND(F.lit(_SHIFT - 1)).cast("int")


def _content(lines: Column, code: Column) -> Column:
    return F.slice(lines, _start(code) + 1, _end(code) - _start(code))


def _kept(parts: Column, ranges: Column) -> Column:
    """The parts outside the ranges, coded as start and end, in order and without overlap."""
    start = lambda i: F.when(i < F.size(ranges), _start(F.get(ranges, i))).otherwise(F.size(parts))
    after = lambda i: F.when(i > 0, _end(F.get(ranges, i - 1))).otherwise(F.lit(0))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ranges)), lambda i: F.slice(parts, after(i) + 1, start(i) - after(i))))


def _one_row(df: DataFrame, *names: str) -> DataFrame:
    """`df` with a generator of one row around the columns `names`: Spark moves no later filter or projection below it,
    where the expressions would be put into each other's lambdas and be computed anew for each line."""
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.explode_outer(F.array(F.struct(*names))).alias("__parts")).select(*others, *[F.col(f"__parts.{n}").alias(n) for n in names])


def _documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__digest"), F.col(text).alias("__text"))


def _few(per_doc: DataFrame, codes: str, limit: int) -> bool:
    """Whether a table of one row a document has at most `limit` numbers of 8 bytes."""
    return (per_doc.agg(F.sum(F.size(codes) + 3)).first()[0] or 0) <= limit


def _joined(df: DataFrame, per_doc: DataFrame, few: bool, how: str) -> DataFrame:
    """`df` with __id and __digest joined with a table of one row a document, which is broadcast if it is small; if not, the
    texts are shuffled to it."""
    own = per_doc.withColumnsRenamed({"__id": "__own_id", "__digest": "__own_digest"})
    own = F.broadcast(own) if few else own
    return df.join(own, F.col("__id").eqNullSafe(F.col("__own_id")) & (F.col("__digest") == F.col("__own_digest")), how).drop("__own_id", "__own_digest")


def _chunks(docs: DataFrame, long_words: int) -> DataFrame:
    """__id, __digest and an array of (__code, __hash) of the chunks that may be removed."""
    out = _one_row(docs.select("__id", "__digest", F.split("__text", "\n").alias("__lines")), "__lines")
    out = _one_row(out.withColumns({
        "__line": F.transform("__lines", _line_hash),
        "__long": F.transform("__lines", lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1 >= long_words),
    }), "__lines", "__line", "__long")
    rolled = F.transform("__line", lambda h, i: (F.when(i > 0, F.get("__line", i - 1)).otherwise(F.lit(0)) * BASE + h) % PRIME)
    out = _one_row(out.withColumn("__rolled", rolled).drop("__line"), "__lines", "__long", "__rolled")
    last = F.size("__lines") - 1
    minimum = lambda i: (i > 0) & (i < last - 1) & (F.get("__rolled", i) < F.get("__rolled", i - 1)) & (F.get("__rolled", i) < F.get("__rolled", i + 1))
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | F.get("__long", i) | F.coalesce(F.get("__long", i + 1), F.lit(False)) | minimum(i))
    out = _one_row(out.withColumn("__ends", ends).drop("__rolled"), "__lines", "__long", "__ends")
    codes = F.transform("__ends", lambda e, n: F.when(n > 0, F.get("__ends", n - 1) + 1).otherwise(F.lit(0)).cast("long") * _SHIFT + e + 1)
    out = _one_row(out.withColumn("__codes", codes).drop("__ends"), "__lines", "__long", "__codes")
    wanted = F.filter("__codes", lambda c: (_end(c) - _start(c) >= 2) | F.get("__long", _start(c)))
    contents = F.transform(wanted, lambda c: F.struct(c.alias("__code"), F.array_join(_content(F.col("__lines"), c), "\n").alias("__chunk")))
    out = _one_row(out.withColumn("__found", contents).drop("__lines", "__long", "__codes"), "__found")
    visible = F.filter("__found", lambda x: F.trim(F.translate(x["__chunk"], "\n\t\r", "   ")) != "")
    return out.select("__id", "__digest", F.transform(visible, lambda x: F.struct(x["__code"], F.xxhash64(x["__chunk"]).alias("__hash"))).alias("__found")).where(F.size("__found") > 0)


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", long_words: int = 50, broadcast_codes: int = 1_000_000) -> DataFrame:
    """All rows and columns of `df` with repeated chunks taken out of `text`; adds `removed_chunks` and
    `removed_lines` (long; replacing columns of these names).

    Ids may have any type with an order; null ids are one id, the first. Null texts stay null; chunks without a visible
    character are never removed; rows with equal id and text count as one document, so a chunk's first occurrence stays
    in each of them. A text of which nothing is left becomes empty, and its row stays. Texts may have any length; one
    text's lines are worked on in one task. An empty table gives an empty one. Column names that begin with two
    underscores are refused (ValueError). Small tables of places are broadcast while they have at most `broadcast_codes`
    numbers of 8 bytes; beyond, the texts are shuffled to them.
    """
    check_names(df)
    docs = _documents(df, doc_id, text)
    # lines are hashed once; a document's places take far less room than its text
    found = cut_lineage(_chunks(docs, long_words)).select("__id", "__digest", F.explode("__found").alias("__f")).select("__id", "__digest", "__f.*")
    # a table of its own: a join of two shuffled tables can split a hash that a large share of the rows has
    repeated = cut_lineage(found.groupBy("__hash").agg(F.count("*").alias("__times")).where("__times > 1").select("__hash"))
    held = cut_lineage(found.join(repeated, "__hash").groupBy("__id", "__digest").agg(F.collect_set("__code").alias("__codes")))
    chunks = _one_row(_joined(docs, held, _few(held, "__codes", broadcast_codes), "inner").select("__id", "__digest", "__codes", F.split("__text", "\n").alias("__lines")), "__codes", "__lines")
    content = F.transform("__codes", lambda c: F.struct(c.alias("__code"), F.array_join(_content(F.col("__lines"), c), "\n").alias("__chunk")))
    chunks = chunks.select("__id", "__digest", F.explode_outer(content).alias("__c")).select("__id", "__digest", "__c.*")
    place = F.struct("__id", "__digest", "__code")
    first = chunks.groupBy("__chunk").agg(F.min(place).alias("__first"), F.max(place).alias("__last")).where(~F.col("__first").eqNullSafe(F.col("__last"))).drop("__last")
    again = chunks.join(first, "__chunk").where(~place.eqNullSafe(F.col("__first")))
    removed = cut_lineage(again.groupBy("__id", "__digest").agg(F.sort_array(F.collect_set("__code")).alias("__removed")))
    keyed = df.withColumns({"__id": F.col(doc_id), "__digest": F.xxhash64(F.col(text))})
    joined = _joined(keyed, removed, _few(removed, "__removed", broadcast_codes), "left").drop("__id", "__digest")
    gone = F.col("__removed").isNotNull()
    joined = _one_row(joined.withColumn("__lines", F.when(F.col("__removed").isNotNull(), F.split(F.col(text), "\n"))), "__lines", "__removed")
    left = _kept(F.col("__lines"), F.col("__removed"))
    return joined.withColumns({
        text: F.when(gone, F.array_join(left, "\n")).otherwise(F.col(text)),
        "removed_chunks": F.when(gone, F.size("__removed")).otherwise(0).cast("long"),
        "removed_lines": F.when(gone, F.aggregate("__removed", F.lit(0), lambda n, c: n + _end(c) - _start(c))).otherwise(0).cast("long"),
    }).select(*[c for c in df.columns if c not in ("removed_chunks", "removed_lines")], "removed_chunks", "removed_lines")


def _units(text: Column) -> Column:
    """Lines cut after each full stop, exclamation or question mark with a blank; joined they are the text again."""
    return F.split(text, r"(?<=\n)|(?<=[.!?] )")


def _unit_hash(unit: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), unit)


def _runs(docs: DataFrame, words: int) -> DataFrame:
    """__id, __digest and an array of (__code, __h1, __h2) for each shortest run of units that has `words` words: the one from
    each unit on and the one up to each unit, so that a passage's own runs cover it to both edges."""
    out = _one_row(docs.select("__id", "__digest", _units(F.col("__text")).alias("__units")), "__units")
    out = _one_row(out.withColumns({
        "__own": F.transform("__units", lambda u: _unit_hash(u, 0)), "__again": F.transform("__units", lambda u: _unit_hash(u, 1)), "__words": F.transform("__units", lambda u: F.regexp_count(u, F.lit(r"\S+"))),
    }).drop("__units"), "__own", "__again", "__words")
    owner = F.flatten(F.transform("__words", lambda n, i: F.array_repeat(i, n)))  # each word's unit
    out = _one_row(out.withColumn("__owner", owner).drop("__words"), "__own", "__again", "__owner").where(F.size("__owner") >= words)
    total, at = F.size("__owner"), lambda p: F.get("__owner", p)
    first, last = (lambda i, p: (p == 0) | (at(p - 1) != i)), (lambda i, p: (p == total - 1) | (at(p + 1) != i))  # of a unit's words
    onward = F.transform("__owner", lambda i, p: F.when(first(i, p) & (total - p >= words), i.cast("long") * _SHIFT + at(p + words - 1) + 1))
    upward = F.transform("__owner", lambda i, p: F.when(last(i, p) & (p + 1 >= words), at(p + 1 - words).cast("long") * _SHIFT + i + 1))
    out = _one_row(out.withColumn("__codes", F.array_compact(F.array_union(onward, upward))).drop("__owner"), "__own", "__again", "__codes")
    part = lambda name, c: _content(F.col(name), c)
    found = F.transform("__codes", lambda c: F.struct(c.alias("__code"), F.xxhash64(part("__own", c)).alias("__h1"), F.xxhash64(part("__again", c)).alias("__h2")))
    return out.select("__id", "__digest", found.alias("__found"))


def dedup_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 30, broadcast_codes: int = 1_000_000) -> DataFrame:
    """All rows and columns of `df` with repeated passages taken out of `text`; adds `removed_passages` (long; replacing a
    column of this name).

    A passage is a run of whole units of `words` or more words that stands, with equal units, before (by doc_id, text
    digest and place); within one document copies that overlap the first one stay. All its units go, so at least one copy of
    every unit is left. Equality is that of two hashes of the run; each is made of
    64-bit hashes of its units' bytes by a seed of its own, so units that one seed confuses the other tells apart. A passage of over 50 words that
    begins and ends inside a sentence still has 30 words in whole ones, as a rule. Ids, null and empty texts, repeated rows,
    long texts, empty tables, names and broadcasts are treated as in `dedup_lines`.
    """
    check_names(df)
    docs = _documents(df, doc_id, text)
    runs = cut_lineage(_runs(docs, words)).select("__id", "__digest", F.explode("__found").alias("__f")).select("__id", "__digest", "__f.*")
    # tables of their own: a join of two shuffled tables can split a run that a large share of the rows has
    repeated = cut_lineage(runs.groupBy("__h1", "__h2").agg(F.count("*").alias("__times")).where("__times > 1").drop("__times"))
    runs = cut_lineage(runs.join(repeated, ["__h1", "__h2"]))
    first = cut_lineage(runs.groupBy("__h1", "__h2").agg(F.min(F.struct("__id", "__digest", "__code")).alias("__first")))
    own = F.col("__id").eqNullSafe(F.col("__first.__id")) & (F.col("__digest") == F.col("__first.__digest"))
    again = runs.join(first, ["__h1", "__h2"]).where(~own | (_start(F.col("__code")) >= _end(F.col("__first.__code"))))
    codes = _one_row(again.groupBy("__id", "__digest").agg(F.sort_array(F.collect_set("__code")).alias("__codes")), "__codes")
    # runs that touch are one range; in this order ends never fall, as every run is the shortest from its start or to its end
    starts = F.filter("__codes", lambda c, i: (i == 0) | (_end(F.get("__codes", i - 1)) < _start(c)))
    ends = F.filter("__codes", lambda c, i: (i == F.size("__codes") - 1) | (_end(c) < _start(F.get("__codes", i + 1))))
    ranges = F.zip_with(starts, ends, lambda a, b: _start(a).cast("long") * _SHIFT + _end(b))
    removed = cut_lineage(codes.select("__id", "__digest", ranges.alias("__ranges")))
    keyed = df.withColumns({"__id": F.col(doc_id), "__digest": F.xxhash64(F.col(text))})
    few = _few(removed, "__ranges", broadcast_codes)
    joined = _joined(keyed, removed, few, "left").drop("__id", "__digest")
    joined = _one_row(joined.withColumn("__units", F.when(F.col("__ranges").isNotNull(), _units(F.col(text)))), "__units", "__ranges")
    kept = _kept(F.col("__units"), F.col("__ranges"))
    gone = F.col("__ranges").isNotNull()
    out = joined.withColumns({
        text: F.when(gone, F.array_join(kept, "")).otherwise(F.col(text)),
        "removed_passages": F.when(gone, F.size("__ranges")).otherwise(0).cast("long"),
    }).select(*[c for c in df.columns if c != "removed_passages"], "removed_passages")
    return out if few else cut_lineage(out)  # what reads the rows more than once shuffles the texts once
