"""Regular expressions of the text functions, and their translation from ECMAScript to Java.

Word boundaries and `\\s` are the ASCII ones in ECMAScript terms; Java's `\\b` is not, so it is written out.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# Pattern families of the complexity score.
CODE = (
    r"(?s)```.*?```", r"`[^`]+`", r"(?i)\b(function|class|const|let|var|import|export|return|async|await|def|fn|pub|struct|enum|interface|type)\b",
    r"(?i)\b(error|exception|stacktrace|traceback|TypeError|ReferenceError|SyntaxError)\b", r"\.(ts|js|tsx|jsx|py|rs|go|java|cpp|rb|php|swift|kt)\b",
    r"(?i)\b(npm|yarn|pip|cargo|go get|brew|apt)\s+(install|add|remove)", r"(?i)\b(git\s+(commit|push|pull|merge|rebase|checkout|branch))\b",
)
REASONING = (
    r"(?i)\b(analyze|analyse|compare|contrast|evaluate|assess|critique|review)\b", r"(?i)\b(explain\s+why|how\s+does|what\s+causes|trade-?offs?|pros?\s+and\s+cons?)\b",
    r"(?i)\b(implications?|consequences?|considerations?|nuances?|subtleties?)\b", r"(?i)\b(strategy|architect|design\s+pattern|best\s+practice|approach)\b",
    r"(?i)\b(optimize|refactor|improve|debug|diagnose|troubleshoot)\b", r"(?i)\b(step[\s-]by[\s-]step|in[\s-]depth|thorough|comprehensive|detailed)\b",
)
TOOL = (r"https?://\S+", r"(?i)\b(search|look\s+up|find|google|browse|fetch|scrape)\b", r"(?i)\b(what\s+is\s+the\s+(latest|current|today))\b", r"(?i)\b(weather|news|price|stock|score|time\s+in)\b")
MATH = (
    r"(?i)\b(calculate|compute|solve|equation|formula|integral|derivative|probability)\b", r"\d+\s*[+\-*/^%]\s*\d+",
    r"(?i)\b(sum|average|mean|median|standard\s+deviation|regression)\b", r"(?i)\b(proof|theorem|lemma|axiom|hypothesis)\b",
)
CREATIVE = (
    r"(?i)\b(write|draft|compose|create|generate)\s+(a\s+)?(story|poem|email|letter|essay|blog|article|script|song|speech)", r"(?i)\b(rewrite|rephrase|paraphrase|summarize|summarise)\b",
    r"(?i)\b(creative|fictional|imaginative|narrative)\b", r"(?i)\b(tone|voice|style|format)\s+(should|must|needs?\s+to)\b",
)
MULTIPART = (
    r"(?is)\b(first|1[.):])\b.*\b(second|2[.):]|then|also|and\s+also|additionally)\b", r"\d+\.\s+\w+.*\n\d+\.\s+\w+", r"(?i)\b(and\s+also|in\s+addition|furthermore|moreover|plus)\b",
)
# Error messages.
RATE_LIMIT = r"(?i)rate.?limit|too many requests"
OVERLOADED = r"(?i)overloaded|resource.?exhausted|quota exceeded"
BILLING = r"(?i)insufficient balance|payment required|insufficient credits|credit balance|plans & billing|billing.?hard.?limit|exceeded.*quota|quota.*exceeded"
AUTH = r"(?i)invalid.?api.?key|incorrect api key|api key.{0,10}not valid|invalid token|authentication|unauthorized|forbidden|access denied|expired|token has expired"
GEO = r"(?i)location.{0,20}not supported|not available in your (country|region)|geo.?restrict|region.?not.?supported|service.?not.?available.{0,30}(country|region|location)"
TOOL_CAPABILITY = r"(?i)tool.?use.?failed|failed to call a function|does not support tools|tool.?call.*not supported"
CONTENT_FILTER = r"(?i)content.?filter|safety|moderation|harmful"
TIMEOUT = r"(?i)timeout|timed out|deadline exceeded|context deadline exceeded|request was aborted|request aborted"
# Provider and model names that users don't see, in the order of their replacement.
PROVIDERS = (
    "openai", "anthropic", "google", "groq", "mistral", "deepseek", "together", "replicate", "cerebras", "cloudflare", "openrouter", "cohere", "fireworks", "perplexity",
    "xai", "sambanova", "hyperbolic", "novita", "digitalocean", "gemini", "claude", "gpt-", "llama", "whisper",
)
SECRET = r"(?i)\b(sk|pk|api|key|token|secret|bearer)[-_]?[a-zA-Z0-9]{20,}\b"
TITLE_TAGS = ("TITLE", "TÍTULO", "TITRE", "TITOLO", "TITEL", "ЗАГОЛОВОК")
SPANISH = r"(?i)\b(hola|por favor|gracias|cómo|qué|dime|puedes)\b"


def java(pattern: str) -> str:
    """With ASCII boundaries. Beside a word character one look is enough: before a letter or a group of words, and
    behind them. Patterns whose words may begin or end with another character keep both."""
    if not pattern.isascii() or "[.):]" in pattern:
        return pattern.replace(r"\b", _BOUNDARY)
    return re.sub(r"\\b(?=[(\w])", lambda _: r"(?<!\w)", pattern).replace(r"\b", r"(?!\w)")


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, (F.rlike(text, F.lit(java(p))).cast("int") for p in patterns))


def hits_sql(text: str, patterns: tuple[str, ...]) -> str:
    """The same as SQL."""
    return "(" + " + ".join(f"regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}')::INT" for p in patterns) + ")"
