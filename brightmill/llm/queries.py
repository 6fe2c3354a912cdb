"""The registered query of each corpus operator and, where SQL can express it, its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightmill.llm import bpe_automaton, chat_tree, decontaminate, jaccard_join, language_id, line_dedup, media_audio, packing, quality, secret_scan, source_audit, tokenizer_alignment, url_filter
from brightmill.llm.common import cut_lineage, doc_remainder, table

URL_RULES = (
    url_filter.host_rule("allow", "com", "/"),
    url_filter.host_rule("block", "example.com", "/en/"),
    url_filter.host_rule("allow", "www.example.com", "/en/"),
    url_filter.host_rule("block", "net", "/es/"),
    url_filter.host_rule("block", "net", "/fr/"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the given rules; where none fits, under the operator's default rules."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES + url_filter.DEFAULT_RULES)
    given = F.col("priority") == 1
    return judged.select("page_id", "host", "path", F.when(given, F.col("rule")).alias("rule"), "verdict")


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1, 's') AS query FROM u
), r(name, rhost, rpath, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), b AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.name, length(r.name)) AS rule, arg_max(r.verdict, length(r.name)) AS verdict
  FROM p JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, b.rule,
  coalesce(b.verdict, CASE WHEN p.host || p.path || p.query = ''
    OR regexp_matches(p.host || p.path || p.query, '\.(exe|zip|iso|apk|dmg)$', 's')
    OR regexp_matches(p.host || p.path || p.query, '^[^/?#]*/(login|signin|wp-login|cart/|checkout/)', 's')
    OR regexp_matches(p.host || p.path || p.query, '^((ads|tracker)\.[^/?#]*|[^/?#]*\.doubleclick\.net)/', 's') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b ON p.page_id = b.page_id AND p.host = b.host AND p.path = b.path
"""


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents."""
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), t AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0
), s AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS shingle FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM t)
), n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id
), d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS shingle
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM s))
), m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN s USING (k, shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= ceil(n_item * 0.8 - 1e-9)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the multi-line chunks that stand elsewhere before."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = """
WITH l AS (
  SELECT doc_id, i, line, length(line) - length(replace(line, ' ', '')) + 1 >= 50 AS long, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))
), r AS (SELECT *, (coalesce(lag(h) OVER w, 0) * 31 + h) % 4294967291 AS r, max(i) OVER (PARTITION BY doc_id) AS last FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), e AS (
  SELECT *, i = last OR long OR coalesce(lead(long) OVER w, false) OR (i > 0 AND i < last - 1 AND r < lag(r) OVER w AND r < lead(r) OVER w) AS ends
  FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), g AS (SELECT doc_id, i, line, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e
), c AS (SELECT doc_id, chunk, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS content FROM g GROUP BY doc_id, chunk
), q AS (
  SELECT * FROM c WHERE trim(translate(content, chr(10) || chr(9) || chr(13), '   ')) <> '' AND (n >= 2 OR length(content) - length(replace(content, ' ', '')) + 1 >= 50)
), x AS (SELECT doc_id, chunk FROM (SELECT doc_id, chunk, row_number() OVER (PARTITION BY content ORDER BY doc_id, start) AS k FROM q) WHERE k > 1
), o AS (
  SELECT g.doc_id, string_agg(g.line, chr(10) ORDER BY g.i) FILTER (x.chunk IS NULL) AS text, count(DISTINCT x.chunk) AS removed_chunks, count(x.chunk) AS removed_lines
  FROM g LEFT JOIN x USING (doc_id, chunk) GROUP BY g.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text, coalesce(removed_chunks, 0) AS removed_chunks, coalesce(removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN o USING (doc_id)
"""


def op3_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as MPEG audio, read back and measured."""
    stored = media_audio.encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media_audio.measure_column(stored).select("doc_id", "n_bytes", "audio.*")


def op4_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that imitates control strings, formatted as a prefix tree and read back."""
    schema = "conv_id long, turn long, role string, text string"
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], schema)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chat_tree.read_back(chat_tree.format_tree(turns, path), path)


QUALITY_THRESHOLD = 0.3


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every text, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (doc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), quality.feature_column().alias("features"))
    docs = cut_lineage(docs)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs.where(~F.col("held_out")).join(labels, "doc_id"))
    scored = docs.withColumn("score", quality.score_column(docs, model))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed as instruction data into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), packing.INSTRUCTIONS, prompt_share=packing.PROMPT_SHARE)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", doc_remainder(F.col("doc_id"), 4) == 2)
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text by the base patterns and by the formats learned from what these find."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scan(docs, secret_scan.learn_formats(docs)).drop("text")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of documents that links of 3-word shingle similarity 0.9 or more form."""
    return jaccard_join.JaccardJoin(k=3, percent=90).run(table(spark, sf_dir, "documents"))


def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_automaton.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    decoded = bpe_automaton.decode_tokens(coded, path)
    n_tokens = F.octet_length("tokens").cast("long") / 4
    return decoded.select("doc_id", n_tokens.cast("long").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence of all pairs of a language's sources, and each source's 200 most telling terms."""
    return source_audit.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), dc AS (SELECT id, lang, source, term, count(*) AS n FROM w GROUP BY ALL
), k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM dc GROUP BY lang, term HAVING count(*) >= 3
), v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang
), c AS (SELECT dc.lang, dc.source, dc.term, sum(dc.n)::BIGINT AS n FROM dc JOIN k USING (lang, term) GROUP BY ALL
), g AS (SELECT lang, source, coalesce((SELECT sum(c.n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM d) s
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p, 1 + (1000000000 * (k.n + 1)) // (v.n + v.v) AS l
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (SELECT lang, source, term AS item, (p - l) * (p - l) // l AS value FROM p WHERE c > 0 AND p > l
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a byte-level BPE and a piece model cut every text, with corpus-wide counts of the ids that end together."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenizer_alignment.audit(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_line_dedup": op2_line_dedup,
        "op3_media_audio": op3_media_audio,
        "op4_chat_tree": op4_chat_tree,
        "op5_quality": op5_quality,
        "op6_packing": op6_packing,
        "op7_language_id": op7_language_id,
        "op8_secret_scan": op8_secret_scan,
        "op9_url_filter": op9_url_filter,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_bpe_automaton": op11_bpe_automaton,
        "op12_source_audit": op12_source_audit,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


def oracle_sql() -> dict:
    return {"op1_decontaminate": OP1_SQL, "op2_line_dedup": OP2_SQL, "op9_url_filter": OP9_SQL, "op12_source_audit": OP12_SQL}
