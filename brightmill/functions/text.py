"""Text functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightmill.functions import patterns as P
from brightmill.functions.numeric import estimate_tokens


def complexity_score(message: Column, depth: Column) -> Column:
    """0 to 100 from the trimmed message's length, pattern families, the conversation's depth and multi-part phrasing."""
    tokens = estimate_tokens(message)
    length = F.when(tokens <= 10, 0).when(tokens <= 30, 5).when(tokens <= 100, 10).otherwise(15)
    capped = [F.least(P.hits(message, family) * weight, F.lit(most)) for family, weight, most in ((P.CODE, 8, 25), (P.REASONING, 10, 25), (P.TOOL, 3, 5), (P.MATH, 8, 15), (P.CREATIVE, 5, 10))]
    deep = F.when(depth > 20, 10).when(depth > 10, 5).when(depth > 5, 2).otherwise(0)
    parts = F.when(P.hits(message, P.MULTIPART) > 0, 10).otherwise(0)
    return F.least(F.lit(100), reduce(lambda a, b: a + b, capped, length + deep + parts))


def complexity_label(score: Column) -> Column:
    return F.when(score <= 20, "fast").when(score <= 55, "standard").when(score <= 75, "pro").otherwise("thinking")


def error_reason(status: Column, message: Column, code: Column | None = None, data: Column | None = None) -> Column:
    """The reason of a failed call: clear status codes, then network codes, timeouts, the provider's own error
    type (JSON `data`), the message, and last what is left of the status."""
    code = F.upper(F.coalesce(code if code is not None else F.lit(""), F.lit("")))
    field = lambda path: F.get_json_object(data, path) if data is not None else F.lit(None).cast("string")
    google, kind, sub = field("$.error.status"), field("$.error.type"), field("$.error.code")
    has = lambda p: F.coalesce(F.rlike(message, F.lit(p)), F.lit(False))
    return (
        F.when(status == 429, "rate_limit").when(status == 402, "billing").when(status.isin(401, 403), "auth").when(status == 408, "timeout").when(status == 529, "rate_limit")
        .when(code.isin("ETIMEDOUT", "ESOCKETTIMEDOUT", "ECONNRESET", "ECONNABORTED"), "timeout").when(code == "TOOL_USE_FAILED", "format").when(has(P.TIMEOUT), "timeout")
        .when(google.isin("FAILED_PRECONDITION", "UNAVAILABLE"), "provider_unavailable").when(google == "RESOURCE_EXHAUSTED", "rate_limit")
        .when(google == "PERMISSION_DENIED", F.when(has(P.GEO), "provider_unavailable").otherwise("auth"))
        .when(kind.isin("rate_limit_error", "overloaded_error"), "rate_limit").when(kind == "authentication_error", "auth").when(kind == "server_error", "provider_unavailable")
        .when(sub.isin("billing_hard_limit_reached", "insufficient_quota"), "billing")
        .when(has(P.RATE_LIMIT) | has(P.OVERLOADED), "rate_limit").when(has(P.BILLING), "billing").when(has(P.AUTH), "auth").when(has(P.GEO), "provider_unavailable")
        .when(has(P.TOOL_CAPABILITY), "format").when(has(P.CONTENT_FILTER), "content_filter")
        .when(status == 400, "format").when(status >= 500, "provider_unavailable").otherwise("unknown")
    )


def scrub_providers(text: Column, brand: str = "Assistant") -> Column:
    """Each provider's name by the brand, one after the other, in any case and inside words too."""
    return reduce(lambda t, name: F.regexp_replace(t, f"(?i){name}", brand), P.PROVIDERS, text)


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(text, P.java(P.SECRET), "[REDACTED]")


def _any_case(tag: str) -> str:
    """A letter's two cases and Cyrillic variants; Java's (?iu) would take the dotless i for an I too."""
    return "".join(f"[{c}{c.lower()}{_VARIANTS.get(c, '')}]" for c in tag)


_VARIANTS = {"В": "\u1c80", "О": "\u1c82"}
_TAGS = [_any_case(t) for t in P.TITLE_TAGS]
# Only \n ends a line, and \z stands for the end: Java's $ also matches before a last newline.
_TITLE = "(?d)" + "|".join(f"{a}(?:{'|'.join(f'{t}{b}.*?{a}/{t}{b}' for t in _TAGS)})" for a, b in ((r"\[", r"\]"), ("<", ">")))
_TITLE_EDGES = r"^[\[<][^\]>]*[\]>]|[\[<]/[^\]>]*[\]>]\z"


def title_of(text: Column, first_user: Column) -> Column:
    """The title tag unless it is blank, else the first user message's start, else the first six words, else a constant."""
    tagged = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, _TITLE, 0), _TITLE_EDGES, "")), F.lit(""))
    clean = F.trim(F.regexp_replace(text, r"(?d)\[.*?\]|<.*?>|[#*_`]", ""))
    six = F.array_join(F.slice(F.split(clean, r"[\t\n\f\r ]+"), 1, 6), " ")
    return F.coalesce(tagged, F.nullif(F.left(first_user, F.lit(60)), F.lit("")), F.when(F.length(clean) >= 10, six), F.lit("New chat"))


def strip_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _TITLE, ""))


def clean_title(text: Column) -> Column:
    """Trimmed, without edge quotes and trailing dots; null unless 1 to 99 characters are left."""
    title = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[\"']|[\"']\z", ""), r"\.+\z", "")
    return F.when((F.length(title) > 0) & (F.length(title) < 100), title)


_BRANDED = "(?:BRAND_)?"


def strip_platform_tags(text: Column, platform: str) -> Column:
    """Without the tags that the other platform draws."""
    # tags may bear a brand's name in front
    block = lambda t, name: F.regexp_replace(t, rf"(?s)\[{_BRANDED}{name}[^\]]*\].*?\[/{_BRANDED}{name}\]\s*", "")
    single = lambda t, name: F.regexp_replace(t, rf"\[{_BRANDED}{name}[^\]]*\]", "")
    if platform == "chat":
        out = reduce(block, ("COMPACTLIST", "BANNER", "COMPARISON", "TIMELINE"), text)
        return F.trim(F.regexp_replace(reduce(single, ("IMAGE", "CREDIBILITY"), out), rf"(?is)\[{_BRANDED}TITLE[^\]]*\].*?\[/{_BRANDED}TITLE\]\s*", ""))
    out = F.regexp_replace(F.regexp_replace(text, rf"\[{_BRANDED}REACT:[^\]]+\]\s*", ""), rf"\[{_BRANDED}TGIMAGE[^\]]*\]\s*", "")
    return F.trim(F.regexp_replace(block(out, "TGLINKS"), rf"\[{_BRANDED}TGDOC[^\]]*\]\s*", ""))


def visible_text(text: Column) -> Column:
    """Without thinking blocks."""
    return F.regexp_replace(text, r"(?s)<thinking>.*?</thinking>", "")


def thinking_text(text: Column) -> Column:
    """The thinking blocks' text; null without any."""
    return F.nullif(F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)<thinking>(.*?)</thinking>"), F.lit(1)), "\n"), F.lit(""))


def html_text(html: Column) -> Column:
    """Page text: no scripts, styles and page furniture, tags as blanks, six entities, one blank for white space."""
    out = reduce(lambda t, tag: F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", ""), ("script", "style", "nav", "footer", "header"), html)
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    entities = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
    out = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), entities, out)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_title(html: Column, url: Column) -> Column:
    title = F.regexp_extract(html, r"(?i)<title[^>]*>(.*?)</title>", 1)
    return F.when(F.rlike(html, F.lit(r"(?i)<title[^>]*>(.*?)</title>")), F.trim(title)).otherwise(url)


def cap_text(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def truncate_at_line(text: Column, most: int) -> Column:
    """Cut at the last newline, if that is beyond half of the budget; says how much stood beyond the budget."""
    head = F.left(text, F.lit(most))
    last = most - F.locate("\n", F.reverse(head))  # 0-based; `most` if there is none
    cut = F.when((F.instr(head, "\n") > 0) & (last > most * 0.5), last).otherwise(most)
    note = F.concat(F.lit("\n\n[truncated — "), F.length(text) - most, F.lit(" chars omitted]"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), cut.cast("int")), note))


def slug(text: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", ""), r"\s+", "-"), F.lit(40))


def chunks(text: Column, size: int) -> Column:
    """Pieces of a fixed size."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def template_variables(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), F.lit(1)))


def camel_label(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat(F.upper(F.left(name, F.lit(1))), F.substring(name, F.lit(2), F.lit(1 << 30))), r"(?<!^)([A-Z])", " $1"))


def plan_tier(name: Column) -> Column:
    """Rate-limit tier by the plan's name; any plan is at least pro."""
    low = F.lower(name)
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    return F.when(name.isNull(), "free").when(has("enterprise"), "enterprise").when(has("ultra", "business"), "business").when(has("max", "pro+", "pro plus", "proplus"), "pro_plus").otherwise("pro")


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def plain_ip(address: Column) -> Column:
    """Trimmed, in lower case, without IPv4 mapping; null if blank."""
    return F.regexp_replace(F.lower(F.nullif(F.trim(address), F.lit(""))), "^::ffff:", "")


def header_ip(address: Column) -> Column:
    """An address of a header, also without brackets and port; null if blank."""
    bare = F.trim(address)
    bare = F.when(F.rlike(bare, F.lit(r"^\[[^\]]*\]")), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, rf"^({_OCTET}(?:\.{_OCTET}){{3}}):[^:]*$", "$1"))
    return plain_ip(bare)


def client_ip(remote: Column, forwarded: Column, real: Column, trusted: Column) -> Column:
    """The client's address. Only a trusted proxy's headers count, the first forwarded address before the real one; with
    no proxies named, the forwarding header is trusted. Without a remote address there is none."""
    own, first = plain_ip(remote), header_ip(F.element_at(F.split(forwarded, ","), 1))
    known = F.exists(trusted, lambda p: F.coalesce(plain_ip(p) == own, F.lit(False)))
    behind = F.when(F.coalesce(F.size(trusted), F.lit(0)) <= 0, F.coalesce(first, own)).when(known, F.coalesce(first, header_ip(real), own)).otherwise(own)
    return F.when(own.isNotNull(), behind)


def is_loopback(ip: Column) -> Column:
    return F.coalesce(F.rlike(ip, F.lit(r"^(127\.|::1$|::ffff:127\.)")), F.lit(False))


def is_spanish(text: Column) -> Column:
    return F.rlike(text, F.lit("[áéíóúñ¿¡]")) | F.rlike(text, F.lit(P.java(P.SPANISH)))
