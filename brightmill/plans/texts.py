"""Text, HTML, URL and array functions (X)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightmill.functions import patterns as P
from brightmill.functions import text as T
from brightmill.functions.urls import BLOCKED_HOSTS, domain, normalize_url, url_problem
from brightmill.plans.catalog import query
from brightmill.sources.html import page_links, search_results
from brightmill.sources.views import TRACKING, Views, sql_text

_TRACK = "|".join(TRACKING)
# RE2 has no lookbehind: the separator before a tracking parameter is captured, and each pass may take one of two in a row
_DROP = f"regexp_replace(%s, '([?&])({_TRACK})(=[^&]*)?(&|$)', '\\1', 'g')"
NORMALIZE_SQL = (
    "regexp_replace(regexp_replace(" + _DROP % (_DROP % (_DROP % (
        "lower(regexp_extract(regexp_replace(url, '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', 0)) || substr(regexp_replace(url, '#.*$', '', 's'), "
        "length(regexp_extract(regexp_replace(url, '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', 0)) + 1)"
    ))) + ", '[?&]$', ''), '/+$', '')"
)


def _score_sql() -> str:
    families = ((P.CODE, 8, 25), (P.REASONING, 10, 25), (P.TOOL, 3, 5), (P.MATH, 8, 15), (P.CREATIVE, 5, 10))
    parts = [f"least({P.hits_sql('t', f)} * {w}, {most})" for f, w, most in families]
    return (
        "least(100, CASE WHEN n <= 10 THEN 0 WHEN n <= 30 THEN 5 WHEN n <= 100 THEN 10 ELSE 15 END + " + " + ".join(parts)
        + " + CASE WHEN turn > 20 THEN 10 WHEN turn > 10 THEN 5 WHEN turn > 5 THEN 2 ELSE 0 END" + f" + CASE WHEN {P.hits_sql('t', P.MULTIPART)} > 0 THEN 10 ELSE 0 END)"
    )


UTF16_SQL = "(length(%s) + length(regexp_replace(%s, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"


@query("x1_query_complexity", "mx", f"""
WITH q AS (SELECT conv_id, turn, trim(text, ' ') AS t, CAST(ceil({UTF16_SQL % ("trim(text, ' ')", "trim(text, ' ')")} / 4.0) AS BIGINT) AS n FROM mx), s AS (SELECT conv_id, turn, {_score_sql()} AS score FROM q)
SELECT conv_id, turn, score, CASE WHEN score <= 20 THEN 'fast' WHEN score <= 55 THEN 'standard' WHEN score <= 75 THEN 'pro' ELSE 'thinking' END AS label FROM s""")
def _(v: Views) -> DataFrame:
    messages = v.mx.select("conv_id", "turn", F.trim("text").alias("message"))  # a column, so it isn't trimmed for each pattern
    scored = messages.select("conv_id", "turn", T.complexity_score(F.col("message"), F.col("turn")).alias("score"))
    return scored.withColumn("label", T.complexity_label(F.col("score")))


_STATUSES = (0, 429, 402, 401, 403, 408, 529, 400, 500, 503)
_CODES = ("", "ETIMEDOUT", "econnreset", "TOOL_USE_FAILED", "EOTHER")
_DATA = (
    None, '{"error":{"status":"RESOURCE_EXHAUSTED"}}', '{"error":{"status":"PERMISSION_DENIED"}}', '{"error":{"type":"authentication_error"}}', '{"error":{"type":"overloaded_error"}}',
    '{"error":{"code":"insufficient_quota"}}', '{"error":{"type":"server_error"}}',
)
_PICK = lambda values, key: f"{sql_text(values)}[{key} % {len(values)} + 1]"
REASON_SQL = f"""CASE WHEN status = 429 THEN 'rate_limit' WHEN status = 402 THEN 'billing' WHEN status IN (401, 403) THEN 'auth' WHEN status = 408 THEN 'timeout' WHEN status = 529 THEN 'rate_limit'
 WHEN upper(code) IN ('ETIMEDOUT', 'ESOCKETTIMEDOUT', 'ECONNRESET', 'ECONNABORTED') THEN 'timeout' WHEN upper(code) = 'TOOL_USE_FAILED' THEN 'format' WHEN regexp_matches(msg, '{P.TIMEOUT}') THEN 'timeout'
 WHEN g IN ('FAILED_PRECONDITION', 'UNAVAILABLE') THEN 'provider_unavailable' WHEN g = 'RESOURCE_EXHAUSTED' THEN 'rate_limit'
 WHEN g = 'PERMISSION_DENIED' THEN CASE WHEN regexp_matches(msg, '{P.GEO}') THEN 'provider_unavailable' ELSE 'auth' END
 WHEN ty IN ('rate_limit_error', 'overloaded_error') THEN 'rate_limit' WHEN ty = 'authentication_error' THEN 'auth' WHEN ty = 'server_error' THEN 'provider_unavailable'
 WHEN co IN ('billing_hard_limit_reached', 'insufficient_quota') THEN 'billing'
 WHEN regexp_matches(msg, '{P.RATE_LIMIT}') OR regexp_matches(msg, '{P.OVERLOADED}') THEN 'rate_limit' WHEN regexp_matches(msg, '{P.BILLING}') THEN 'billing' WHEN regexp_matches(msg, '{P.AUTH}') THEN 'auth'
 WHEN regexp_matches(msg, '{P.GEO}') THEN 'provider_unavailable' WHEN regexp_matches(msg, '{P.TOOL_CAPABILITY}') THEN 'format' WHEN regexp_matches(msg, '{P.CONTENT_FILTER}') THEN 'content_filter'
 WHEN status = 400 THEN 'format' WHEN status >= 500 THEN 'provider_unavailable' ELSE 'unknown' END"""
#: Error code, whether it may be retried, and after how many seconds, by reason (fixed values).
REASONS = (
    ("timeout", "TIMEOUT", True, None), ("rate_limit", "RATE_LIMITED", True, 30), ("billing", "QUOTA_EXCEEDED", False, None), ("auth", "AUTH_FAILED", False, None),
    ("format", "INVALID_REQUEST", False, None), ("content_filter", "CONTENT_FILTERED", False, None), ("provider_unavailable", "PROVIDER_UNAVAILABLE", True, None), ("unknown", "PROVIDER_UNAVAILABLE", True, None),
)


@query("x2_x3_x4_error_reason", "dx", f"""
WITH e AS (SELECT doc_id, {_PICK(_STATUSES, 'doc_id')} AS status, {_PICK(_CODES, '(doc_id // 10)')} AS code, text AS msg, {_PICK(_DATA, '(doc_id // 3)')} AS data FROM dx),
j AS (SELECT *, json_extract_string(data, '$.error.status') AS g, json_extract_string(data, '$.error.type') AS ty, json_extract_string(data, '$.error.code') AS co FROM e),
r AS (SELECT doc_id, {REASON_SQL} AS reason FROM j)
SELECT doc_id, reason, m.code, m.retryable, CAST(m.retry_after AS INTEGER) AS retry_after FROM r JOIN (VALUES {', '.join('(' + ', '.join(map(sql_text, x)) + ')' for x in REASONS)}) AS m(name, code, retryable, retry_after) ON m.name = r.reason""")
def _(v: Views) -> DataFrame:
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    third, tenth = F.floor(F.col("doc_id") / 3), F.floor(F.col("doc_id") / 10)
    e = v.dx.select("doc_id", pick(_STATUSES, F.col("doc_id")).alias("status"), pick(_CODES, tenth).alias("code"), F.col("text").alias("msg"), pick(_DATA, third).alias("data"))
    reasons = e.select("doc_id", T.error_reason(F.col("status"), F.col("msg"), F.col("code"), F.col("data")).alias("reason"))
    known = v.spark.createDataFrame(list(REASONS), "reason string, code string, retryable boolean, retry_after int")
    return reasons.join(F.broadcast(known), "reason").select("doc_id", "reason", "code", "retryable", "retry_after")


_SCRUB_SQL = reduce(lambda s, name: f"regexp_replace({s}, '{name}', 'Assistant', 'gi')", P.PROVIDERS, "text")


@query("x5_scrub_providers", "dx", f"SELECT doc_id, {_SCRUB_SQL} AS text FROM dx")
def _(v: Views) -> DataFrame:
    return v.dx.select("doc_id", T.scrub_providers(F.col("text")).alias("text"))


@query("x6_redact_secrets", "dx", f"SELECT doc_id, regexp_replace(text, '{P.SECRET}', '[REDACTED]', 'g') AS text FROM dx")
def _(v: Views) -> DataFrame:
    return v.dx.select("doc_id", T.redact_secrets(F.col("text")).alias("text"))


# RE2 has no backreferences: one alternative a tag
_TITLE_SQL = "|".join(f"\\[{t}\\](?:.*?)\\[/{t}\\]|<{t}>(?:.*?)</{t}>" for t in P.TITLE_TAGS)
_INNER_SQL = f"nullif(trim(regexp_replace(regexp_extract(text, '(?i){_TITLE_SQL}', 0), '(?i)^[\\[<][^\\]>]*[\\]>]|[\\[<]/[^\\]>]*[\\]>]$', '', 'g'), ' '), '')"


@query("x7_x8_x9_titles", "mx", f"""
WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS first_user FROM mx WHERE conv_id % 2 = 0 GROUP BY conv_id),
t AS (SELECT conv_id, turn, {_INNER_SQL} AS tagged, nullif(left(first_user, 60), '') AS u, trim(regexp_replace(text, '\\[.*?\\]|<.*?>|[#*_`]', '', 'g'), ' ') AS clean,
  trim(regexp_replace(text, '(?i){_TITLE_SQL}', '', 'g'), ' ') AS stripped FROM mx LEFT JOIN f USING (conv_id)),
b AS (SELECT conv_id, turn, stripped, coalesce(tagged, u, CASE WHEN length(clean) >= 10 THEN array_to_string(regexp_split_to_array(clean, '\\s+')[1:6], ' ') END, 'New chat') AS title FROM t),
c AS (SELECT *, regexp_replace(regexp_replace(trim(title, ' '), '^["'']|["'']$', '', 'g'), '\\.+$', '') AS q FROM b)
SELECT conv_id, turn, stripped, title, CASE WHEN length(q) > 0 AND length(q) < 100 THEN q END AS cleaned FROM c""")
def _(v: Views) -> DataFrame:
    first = v.mx.where("conv_id % 2 = 0").groupBy("conv_id").agg(F.min_by("text", F.when((F.col("role") == "user") & F.col("text").isNotNull(), F.col("turn"))).alias("first_user"))
    rows = v.mx.join(first, "conv_id", "left").withColumn("title", T.title_of(F.col("text"), F.col("first_user")))
    return rows.select("conv_id", "turn", T.strip_title(F.col("text")).alias("stripped"), "title", T.clean_title(F.col("title")).alias("cleaned"))


@query("x10_x11_platform_and_thinking", "mx", r"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(t, '(?s)\[(?:BRAND_)?BANNER[^\]]*\].*?\[/(?:BRAND_)?BANNER\]\s*', '', 'g'), '(?is)\[(?:BRAND_)?TITLE[^\]]*\].*?\[/(?:BRAND_)?TITLE\]\s*', '', 'g'), ' ') AS chat,
  trim(regexp_replace(t, '\[(?:BRAND_)?REACT:[^\]]+\]\s*', '', 'g'), ' ') AS app, regexp_replace(text, '(?s)<thinking>.*?</thinking>', '', 'g') AS visible,
  nullif(array_to_string(regexp_extract_all(text, '(?s)<thinking>(.*?)</thinking>', 1), chr(10)), '') AS thinking FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN text ELSE replace(replace(replace(text, '[BANNER', '[BRAND_BANNER'), '[/BANNER', '[/BRAND_BANNER'), '[REACT', '[BRAND_REACT') END AS t FROM mx)""")
def _(v: Views) -> DataFrame:
    branded = F.replace(F.replace(F.replace("text", F.lit("[BANNER"), F.lit("[BRAND_BANNER")), F.lit("[/BANNER"), F.lit("[/BRAND_BANNER")), F.lit("[REACT"), F.lit("[BRAND_REACT"))
    rows = v.mx.withColumn("t", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(branded))
    t = F.col("t")
    return rows.select("conv_id", "turn", T.strip_platform_tags(t, "chat").alias("chat"), T.strip_platform_tags(t, "app").alias("app"), T.visible_text(F.col("text")).alias("visible"), T.thinking_text(F.col("text")).alias("thinking"))


_HTML_SQL = "html"
for _tag in ("script", "style", "nav", "footer", "header"):
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"
_HTML_SQL = f"regexp_replace({_HTML_SQL}, '<[^>]+>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
    _HTML_SQL = f"replace({_HTML_SQL}, '{_a}', '{_b}')"
_HTML_SQL = f"trim(regexp_replace({_HTML_SQL}, '\\s+', ' ', 'g'), ' ')"


@query("x12_x14_html_to_text", "", f"""
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<title[^>]*>(.*?)</title>') THEN trim(regexp_extract(html, '(?i)<title[^>]*>(.*?)</title>', 1), ' ') ELSE url END AS title,
  CASE WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END AS content, CAST(length(t) AS BIGINT) AS length FROM (SELECT page_id, url, html, {_HTML_SQL} AS t FROM pages)""")
def _(v: Views) -> DataFrame:
    text = v.pages.select("page_id", "url", "html", T.html_text(F.col("html")).alias("t"))
    return text.select("page_id", T.html_title(F.col("html"), F.col("url")).alias("title"), T.cap_text(F.col("t"), 500).alias("content"), F.length("t").cast("long").alias("length"))


@query("x15_page_links")
def _(v: Views) -> DataFrame:
    return page_links(v.pages.select("page_id", "url", "html"))


@query("s6_search_results")
def _(v: Views) -> DataFrame:
    """Result pages made of the stored pages' addresses."""
    row = F.concat(
        F.lit('<table><tr class="'), F.when(F.col("page_id") % 5 == 0, "result-sponsored").otherwise("row"), F.lit('"><td><a class="result-link" href="/l/?uddg='), F.url_encode("url"), F.lit('"> T'), F.col("page_id"),
        F.lit('</a></td></tr><tr><td class="result-snippet"> about &amp; '), F.col("page_id"), F.lit("</td></tr></table>"),
    )
    return search_results(v.pages.select("page_id", row.alias("html")))


@query("x16_x17_urls", "", f"""
SELECT page_id, {NORMALIZE_SQL} AS url, CASE WHEN h = '' THEN url ELSE regexp_replace(h, '^www\\.', '') END AS domain
FROM (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h FROM pages)""")
def _(v: Views) -> DataFrame:
    return v.pages.select("page_id", normalize_url(F.col("url")).alias("url"), domain(F.col("url")).alias("domain"))


#: Prefixes that make each rule of the URL check fire.
_URLS = ("http://localhost/", "ftp://a.b/", "http://10.1.2.3/", "http://172.20.0.1:80/", "http://172.32.0.1/", "http://192.168.1.1/", "http://[fe80::1]/", "nonsense", "http:///x", "https://169.254.169.254/", "http://8.8.8.8/")


@query("x18_url_check", "", f"""
WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE {_PICK(_URLS, '(page_id // 2)')} END AS url FROM pages),
p AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1)) AS h FROM u),
q AS (SELECT *, coalesce(try_cast(regexp_extract(h, '^(\\d{{1,3}})\\.(\\d{{1,3}})\\.\\d{{1,3}}\\.\\d{{1,3}}$', 1) AS INT), -1) AS x, coalesce(try_cast(regexp_extract(h, '^(\\d{{1,3}})\\.(\\d{{1,3}})\\.\\d{{1,3}}\\.\\d{{1,3}}$', 2) AS INT), -1) AS y FROM p)
SELECT page_id, CASE WHEN s = '' OR (h = '' AND s IN ('http', 'https')) THEN 'invalid' WHEN s NOT IN ('http', 'https') THEN 'protocol' WHEN h IN ({', '.join(map(sql_text, BLOCKED_HOSTS))}) THEN 'internal host'
  WHEN x IN (127, 10, 0) OR (x = 172 AND y BETWEEN 16 AND 31) OR (x = 192 AND y = 168) OR (x = 169 AND y = 254) THEN 'private address' WHEN starts_with(h, '[') THEN 'ipv6' END AS problem FROM q""")
def _(v: Views) -> DataFrame:
    other = F.element_at(F.array(*map(F.lit, _URLS)), (F.floor(F.col("page_id") / 2) % len(_URLS) + 1).cast("int"))
    return v.pages.select("page_id", url_problem(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(other)).alias("problem"))


_IPS = ("203.0.113.50, 70.41.3.18", "::FFFF:203.0.113.50", "203.0.113.50:8080", "[::1]:8080", "", "127.0.0.9", " 10.0.0.1 ", "::1", "999.1.1.1:80", "1.2.3.4:x", None)
_REMOTES = ("10.0.0.1", "::ffff:10.0.0.1", "203.0.113.9", "", " ::1 ", "192.168.0.9", None)
_TRUSTED = ((), ("10.0.0.1", "::1"), ("::FFFF:192.168.0.9",))
_PLAIN_SQL = "regexp_replace(lower(nullif(trim(%s, ' '), '')), '^::ffff:', '')"
_HEADER_SQL = _PLAIN_SQL % rf"CASE WHEN regexp_matches(trim(%s, ' '), '^\[[^\]]*\]') THEN regexp_extract(trim(%s, ' '), '^\[([^\]]*)\]', 1) ELSE regexp_replace(trim(%s, ' '), '^({T._OCTET}(?:\.{T._OCTET}){{3}}):[^:]*$', '\1') END"


@query("x19_x20_client_ip", "", f"""
WITH i AS (SELECT event_id, {_PICK(_REMOTES, 'event_id')} AS remote, {_PICK(_IPS, '(event_id // 7)')} AS forwarded, {_PICK(_IPS, '(event_id // 3)')} AS real, [{', '.join(map(sql_text, _TRUSTED))}][event_id % 3 + 1]::VARCHAR[] AS trusted FROM events),
j AS (SELECT event_id, trusted, {_PLAIN_SQL % 'remote'} AS own, {_HEADER_SQL.replace('%s', "string_split(forwarded, ',')[1]")} AS first, {_HEADER_SQL.replace('%s', 'real')} AS second FROM i),
b AS (SELECT event_id, CASE WHEN own IS NULL THEN NULL WHEN len(trusted) = 0 THEN coalesce(first, own) WHEN list_contains(list_transform(trusted, lambda x: {_PLAIN_SQL % 'x'}), own) THEN coalesce(first, second, own) ELSE own END AS ip FROM j)
SELECT event_id, ip, coalesce(regexp_matches(ip, '^(127\\.|::1$|::ffff:127\\.)'), false) AS loopback FROM b""")
def _(v: Views) -> DataFrame:
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("event_id") / key) % len(values) + 1).cast("int"))
    trusted = F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in _TRUSTED))[(F.col("event_id") % 3).cast("int")]
    return v.table("events").select("event_id", T.client_ip(pick(_REMOTES, 1), pick(_IPS, 7), pick(_IPS, 3), trusted).alias("ip")).withColumn("loopback", T.is_loopback(F.col("ip")))


@query("x21_truncate_at_line", "", """
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE left(text, CAST(CASE WHEN contains(h, chr(10)) AND 300 - instr(reverse(h), chr(10)) > 150 THEN 300 - instr(reverse(h), chr(10)) ELSE 300 END AS BIGINT))
  || chr(10) || chr(10) || '[truncated — ' || (length(text) - 300) || ' chars omitted]' END AS text FROM (SELECT doc_id, text, left(text, 300) AS h FROM documents)""")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", T.truncate_at_line(F.col("text"), 300).alias("text"))


@query("x22_truncate_fields", "mx", """
SELECT conv_id, turn, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS content, role AS name FROM mx""")
def _(v: Views) -> DataFrame:
    """In a tool result, only the long texts of its content fields are cut."""
    result = F.create_map(F.lit("content"), "text", F.lit("name"), "role")
    cut = F.transform_values(result, lambda k, x: F.when(k.isin("content", "text", "output", "result"), T.cap_text(x, 80)).otherwise(x))
    return v.mx.select("conv_id", "turn", cut["content"].alias("content"), cut["name"].alias("name"))


_PLANS = ("Enterprise Plus", "Ultra", "Business", "Max 20", "Pro+", "pro plus", "Pro", "Go", "Other", None)


@query("x23_x24_plan_tier", "", f"""
WITH p AS (SELECT c_custkey, {_PICK(_PLANS, 'c_custkey')} AS name FROM customer)
SELECT c_custkey, CASE WHEN name IS NULL THEN 'free' WHEN lower(name) LIKE '%enterprise%' THEN 'enterprise' WHEN lower(name) LIKE '%ultra%' OR lower(name) LIKE '%business%' THEN 'business'
  WHEN lower(name) LIKE '%max%' OR lower(name) LIKE '%pro+%' OR lower(name) LIKE '%pro plus%' OR lower(name) LIKE '%proplus%' THEN 'pro_plus' ELSE 'pro' END AS tier,
  CASE WHEN name IS NULL THEN 50 WHEN regexp_matches(lower(name), 'business|enterprise') THEN -1 WHEN contains(lower(name), 'pro') THEN 500 ELSE 50 END AS memories FROM p""")
def _(v: Views) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _PLANS)), (F.col("c_custkey") % len(_PLANS) + 1).cast("int"))
    low = F.lower("name")
    memories = F.when(F.col("name").isNull(), 50).when(F.rlike(low, F.lit("business|enterprise")), -1).when(F.contains(low, F.lit("pro")), 500).otherwise(50)
    return v.table("customer").select("c_custkey", name.alias("name")).select("c_custkey", T.plan_tier(F.col("name")).alias("tier"), memories.alias("memories"))


@query("x25_x31_k15_labels", "dx", r"""
SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), 40) AS slug,
  trim(regexp_replace(upper(left(n, 1)) || substr(n, 2), '([^^])([A-Z])', '\1 \2', 'g'), ' ') AS label, list_sort(list_distinct(regexp_extract_all(text, '\{(\w+)\}', 1))) AS names, len(regexp_extract_all(text, '\{(\w+)\}', 1)) > 0 AS is_template
FROM (SELECT doc_id, text, 'web' || upper(left(source, 1)) || substr(source, 2) AS n FROM dx)""")
def _(v: Views) -> DataFrame:
    name = F.concat(F.lit("web"), F.upper(F.left("source", F.lit(1))), F.substring("source", 2, 100))
    names = T.template_variables(F.col("text"))
    return v.dx.select("doc_id", T.slug(F.col("text")).alias("slug"), T.camel_label(name).alias("label"), F.array_sort(names).alias("names"), (F.size(names) > 0).alias("is_template"))


_ANSWERS = ('["what", "next", "third"]', "[broken", '```json\n["a"]\n```', '```\n["x", "y"]```', "no list", '{"a": 1}', "[]", '```json\n["one", "two", "three", "four"]\n```')


@query("x26_fenced_json", "", f"""
WITH a AS (SELECT doc_id, source, regexp_replace(replace({_PICK(_ANSWERS, 'doc_id')}, '"a"', '"' || source || '"'), '```(json)?\\s*', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'ARRAY' AND t <> '[]' THEN ((CASE WHEN json_valid(t) THEN t END)::JSON::VARCHAR[])[1:2] ELSE ['fallback'] END AS questions FROM a""")
def _(v: Views) -> DataFrame:
    """A list from a fenced JSON answer, at most two items; broken and empty answers take the fallback."""
    answer = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("doc_id") % len(_ANSWERS) + 1).cast("int"))
    answer = F.replace(answer, F.lit('"a"'), F.concat(F.lit('"'), "source", F.lit('"')))
    parsed = F.from_json(F.regexp_replace(answer, r"```(?:json)?\s*", ""), "array<string>")
    good = F.filter(F.coalesce(parsed, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return v.table("documents").select("doc_id", F.when(F.size(good) == 0, F.array(F.lit("fallback"))).otherwise(F.slice(good, 1, 2)).alias("questions"))


@query("x27_multipart_content", "m", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role || chr(10) || text WHEN turn % 3 = 1 THEN text ELSE '' END AS text, CASE WHEN turn % 3 = 1 THEN ['img' || turn, 'img' || conv_id] WHEN turn % 3 = 2 THEN ['img' || turn] ELSE [] END AS images FROM m")
def _(v: Views) -> DataFrame:
    """Texts joined and images listed, of messages with one or two texts, two images, or images alone."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    image = lambda c: part("image", F.concat(F.lit("img"), c))
    third = F.col("turn") % 3
    parts = F.when(third == 0, F.array(part("text", F.col("role")), part("text", F.col("text")))).when(third == 1, F.array(image("turn"), part("text", F.col("text")), image("conv_id"))).otherwise(F.array(image("turn")))
    pick = lambda kind: F.transform(F.filter("parts", lambda p: p.type == kind), lambda p: p.value)
    return v.m.select("conv_id", "turn", parts.alias("parts")).select("conv_id", "turn", F.array_join(pick("text"), "\n").alias("text"), pick("image").alias("images"))


@query("x28_spanish", "dx", f"SELECT doc_id, regexp_matches(text, '[áéíóúñ¿¡]') OR regexp_matches(text, '{P.SPANISH}') AS spanish FROM dx")
def _(v: Views) -> DataFrame:
    return v.dx.select("doc_id", T.is_spanish(F.col("text")).alias("spanish"))


@query("x29_usage_from_stream", "m", r"""
WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'data: {"usage":{"total_tokens":' || length(text) || '}}' WHEN 1 THEN 'data: {"text":"' || turn || '"}'
  WHEN 2 THEN '{"usage": { "total_tokens": ' || turn || '}} {"usage":{"total_tokens":99}}' ELSE '{"usage":{"prompt_tokens":1,"total_tokens":7}}' END AS chunk FROM m)
SELECT conv_id, CAST(coalesce(arg_max(nullif(regexp_extract(chunk, '"usage":\s*\{\s*"total_tokens":\s*(\d+)', 1), ''), turn) FILTER (regexp_matches(chunk, '"usage":\s*\{\s*"total_tokens":\s*(\d+)')), '0') AS BIGINT) AS total_tokens FROM c GROUP BY conv_id""")
def _(v: Views) -> DataFrame:
    """The total of the last chunk of a raw stream that reports one; in a chunk the first report counts."""
    fourth, n = F.col("turn") % 4, F.length("text").cast("string")
    chunk = (
        F.when(fourth == 0, F.concat(F.lit('data: {"usage":{"total_tokens":'), n, F.lit("}}"))).when(fourth == 1, F.concat(F.lit('data: {"text":"'), "turn", F.lit('"}')))
        .when(fourth == 2, F.concat(F.lit('{"usage": { "total_tokens": '), "turn", F.lit('}} {"usage":{"total_tokens":99}}'))).otherwise('{"usage":{"prompt_tokens":1,"total_tokens":7}}')
    )
    found = F.nullif(F.regexp_extract(chunk, r'"usage":\s*\{\s*"total_tokens":\s*(\d+)', 1), F.lit(""))
    rows = v.m.select("conv_id", "turn", found.cast("long").alias("found"))
    return rows.groupBy("conv_id").agg(F.coalesce(F.max_by("found", F.when(F.col("found").isNotNull(), F.col("turn"))), F.lit(0)).alias("total_tokens"))


@query("x30_references", "", """
WITH s AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY first, source) AS k FROM (SELECT lang, source, min(doc_id) AS first FROM documents GROUP BY ALL))
SELECT lang, chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || string_agg('[' || k || '] ' || source || chr(10) || '    https://' || source || '.example/' || lang, chr(10) || chr(10) ORDER BY k) AS refs FROM s GROUP BY lang""")
def _(v: Views) -> DataFrame:
    """A report's references, numbered by first sight."""
    first = v.table("documents").groupBy("lang", "source").agg(F.min("doc_id").alias("first"))
    names = first.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("first", "source"))).alias("s"))
    line = F.transform("s", lambda x, i: F.concat(F.lit("["), i + 1, F.lit("] "), x.source, F.lit("\n    https://"), x.source, F.lit(".example/"), "lang"))
    return names.select("lang", F.concat(F.lit("\n\n---\n\n## References\n\n"), F.array_join(line, "\n\n")).alias("refs"))


@query("x32_chunks", "m", "SELECT conv_id, turn, len(c) AS n, c[1] AS first, c[-1] AS last FROM (SELECT conv_id, turn, list_transform(range(0, length(text), 50), lambda i: substr(text, i + 1, 50)) AS c FROM m WHERE text <> '')")
def _(v: Views) -> DataFrame:
    c = v.m.where("text <> ''").select("conv_id", "turn", T.chunks(F.col("text"), 50).alias("c"))
    return c.select("conv_id", "turn", F.size("c").cast("long").alias("n"), F.element_at("c", 1).alias("first"), F.element_at("c", -1).alias("last"))


@query("x33_x38_prompt_layers", "sub", """
SELECT user_id, concat_ws(chr(10) || '---' || chr(10), 'base', CASE WHEN active THEN 'skill ' || lower(segment) END, CASE WHEN balance > 5000 THEN 'agent concierge' END,
  concat_ws(chr(10), 'plan: ' || plan_id, 'segment: ' || segment, CASE WHEN balance >= 0 THEN 'balance: ' || balance END)) AS prompt FROM sub""")
def _(v: Views) -> DataFrame:
    """The layers that apply to a subscriber, then what is known of it: all fields but the id, without empty values."""
    known = F.create_map(F.lit("plan"), "plan_id", F.lit("segment"), "segment", F.lit("user_id"), F.col("user_id").cast("string"), F.lit("balance"), F.when(F.col("balance") >= 0, F.col("balance").cast("string")))
    fields = F.map_filter(known, lambda k, x: (k != "user_id") & x.isNotNull())
    lines = F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat_ws(": ", e.key, e.value)), "\n")
    skill, agent = F.when(F.col("active"), F.concat(F.lit("skill "), F.lower("segment"))), F.when(F.col("balance") > 5000, "agent concierge")
    return v.sub.select("user_id", F.concat_ws("\n---\n", F.lit("base"), skill, agent, lines).alias("prompt"))


@query("x34_encryption_round_trip", "", "SELECT c_custkey, c_name AS name, true AS tagged FROM customer")
def _(v: Views) -> DataFrame:
    key = F.lit("0123456789abcdef0123456789abcdef")
    sealed = F.aes_encrypt(F.col("c_name"), key, F.lit("GCM"))
    return v.table("customer").select("c_custkey", sealed.alias("s")).select("c_custkey", F.aes_decrypt("s", key, F.lit("GCM")).cast("string").alias("name"), (F.length("s") > 28).alias("tagged"))


@query("x35_canonical_messages", "m", "SELECT conv_id, turn, '{\"role\":\"' || role || '\",\"calls\":[{\"id\":' || turn || ',\"result\":' || length(text) || '}]}' AS message FROM m")
def _(v: Views) -> DataFrame:
    call = F.array(F.struct(F.col("turn").alias("id"), F.length("text").alias("result")))
    return v.m.select("conv_id", "turn", F.to_json(F.struct("role", call.alias("calls"))).alias("message"))


#: Tool names as the model sees them, and as the caller knows them.
TOOL_NAMES = (("web_search", "web.search"), ("file_read", "file/read"), ("web_search_2", "web.search"))
_TOOLS = ("web.search", "file/read", "plain")


@query("x35_j13_model_messages", "m", f"""
WITH c AS (SELECT conv_id, turn, role, text, {_PICK(_TOOLS, '(conv_id + turn)')} AS tool, CASE WHEN role = 'assistant' AND turn % 4 <> 3 THEN turn % 4 ELSE 0 END AS calls FROM m),
n AS (SELECT *, CASE tool WHEN 'web.search' THEN 'web_search' WHEN 'file/read' THEN 'file_read' ELSE tool END AS name FROM c),
k AS (SELECT *, unnest(range(calls)) AS i FROM n WHERE calls > 0)
SELECT conv_id, turn, 0::BIGINT AS seq, role, text AS content, CASE WHEN calls > 0 THEN list_transform(range(calls), lambda i: name || ':' || conv_id || '-' || turn || '-' || i) END AS calls, NULL AS output FROM n
UNION ALL SELECT conv_id, turn, i + 1, 'tool', NULL, [name || ':' || conv_id || '-' || turn || '-' || i], CASE WHEN i % 2 = 0 THEN left(text, 12) ELSE '{{"n":' || length(text) || '}}' END FROM k WHERE (conv_id + i) % 3 <> 0""")
def _(v: Views) -> DataFrame:
    """Messages as the model takes them: an assistant's invocations become calls under the names the model knows (the first
    entry with the caller's name; else the name itself), and each finished invocation a tool message behind, its result as text."""
    names = v.spark.createDataFrame([(*n, i) for i, n in enumerate(TOOL_NAMES)], "known string, tool string, i int").groupBy("tool").agg(F.min_by("known", "i").alias("known"))
    tool = F.element_at(F.array(*map(F.lit, _TOOLS)), ((F.col("conv_id") + F.col("turn")) % len(_TOOLS) + 1).cast("int"))
    n = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 != 3), F.col("turn") % 4).otherwise(0)
    object_ = F.to_json(F.struct(F.length("text").alias("n")))
    invocation = lambda i: F.struct(
        F.concat_ws("-", "conv_id", "turn", i).alias("id"), F.when((F.col("conv_id") + i) % 3 != 0, "result").otherwise("call").alias("state"), F.when(i % 2 == 0, F.left("text", F.lit(12))).otherwise(object_).alias("result"),
    )
    rows = v.m.withColumn("tool", tool).join(F.broadcast(names), "tool", "left").withColumn("name", F.coalesce("known", "tool"))
    rows = rows.withColumn("invocations", F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), invocation)))
    label = lambda x: F.concat("name", F.lit(":"), x["id"])
    message = F.struct(F.lit(0).cast("long").alias("seq"), F.col("role"), F.col("text").alias("content"), F.transform("invocations", label).alias("calls"), F.lit(None).cast("string").alias("output"))
    results = F.filter(
        F.transform("invocations", lambda x, i: F.struct((i + 1).cast("long").alias("seq"), F.lit("tool").alias("role"), F.lit(None).cast("string").alias("content"), F.array(label(x)).alias("calls"), F.when(x["state"] == "result", x["result"]).alias("output"))),
        lambda r: r["output"].isNotNull(),
    )
    all_ = F.concat(F.array(message), F.coalesce(results, F.filter(F.array(message), lambda _: F.lit(False))))
    return rows.select("conv_id", "turn", F.explode(all_).alias("x")).select("conv_id", "turn", "x.*")


@query("x36_source_extraction", "", """
WITH r AS (SELECT page_id // 3 AS call, page_id, url, 'Page ' || page_id AS title, CASE WHEN page_id % 4 <> 3 THEN html END AS snippet FROM pages WHERE page_id % 7 <> 0)
SELECT url, arg_min(call, page_id) AS call, arg_min(title, page_id) AS title, arg_min(left(coalesce(snippet, ''), 200), page_id) AS snippet FROM r GROUP BY url""")
def _(v: Views) -> DataFrame:
    """Sources out of tool results, which are JSON texts of several results a call; broken ones give none. Of each address the
    first stays, with the first 200 characters of its snippet."""
    item = F.struct("page_id", "url", F.concat(F.lit("Page "), "page_id").alias("title"), F.when(F.col("page_id") % 4 != 3, F.col("html")).alias("snippet"))
    good = F.col("page_id") % 7 != 0
    calls = v.pages.groupBy(F.expr("page_id div 3").alias("call")).agg(F.to_json(F.struct(F.collect_list(F.when(good, item)).alias("results"))).alias("output"))
    broken = calls.limit(1).select("call", F.lit('{"results": [').alias("output"))
    parsed = calls.unionByName(broken).select("call", F.explode(F.from_json("output", "results array<struct<page_id:long,url:string,title:string,snippet:string>>")["results"]).alias("r")).select("call", "r.*")
    first = lambda c: F.min_by(c, "page_id")
    return parsed.groupBy("url").agg(first("call").alias("call"), first("title").alias("title"), first(F.left(F.coalesce("snippet", F.lit("")), F.lit(200))).alias("snippet"))


@query("x37_timeline", "mx", r"""
SELECT conv_id, turn, k.kind, k.value FROM mx, LATERAL (VALUES ('message', role), ('thinking', nullif(array_to_string(regexp_extract_all(text, '(?s)<thinking>(.*?)</thinking>', 1), chr(10)), '')), ('long', CASE WHEN length(text) > 500 THEN 'yes' END),
  ('call', CASE WHEN role = 'assistant' AND turn % 4 <> 3 THEN 'search:' || conv_id || '-' || turn END), ('result', CASE WHEN role = 'assistant' AND turn % 4 <> 3 AND conv_id % 3 <> 0 THEN left(text, 40) END),
  ('failure', CASE WHEN role = 'assistant' AND turn % 4 <> 3 AND conv_id % 3 = 0 THEN 'search:' || conv_id || '-' || turn END), ('source', nullif(regexp_extract(text, 'https?://[^ \n]+'), ''))) AS k(kind, value)
WHERE k.value IS NOT NULL""")
def _(v: Views) -> DataFrame:
    """Of one message the rows of its audit: itself, thinking, length, its tool call with result or failure, and its source."""
    step = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    called, ended, call = (F.col("role") == "assistant") & (F.col("turn") % 4 != 3), F.col("conv_id") % 3 != 0, F.concat(F.lit("search:"), "conv_id", F.lit("-"), "turn")
    steps = F.array(
        step("message", F.col("role")), step("thinking", T.thinking_text(F.col("text"))), step("long", F.when(F.length("text") > 500, "yes")), step("call", F.when(called, call)),
        step("result", F.when(called & ended, F.left("text", F.lit(40)))), step("failure", F.when(called & ~ended, call)), step("source", F.nullif(F.regexp_extract("text", r"https?://[^ \n]+", 0), F.lit(""))),
    )
    return v.mx.select("conv_id", "turn", F.explode(F.array_compact(steps)).alias("s")).select("conv_id", "turn", "s.kind", "s.value")
