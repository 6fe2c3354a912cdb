"""URL filters by a bit-parallel wildcard automaton (Shift-And with self-loops).

A rule is a glob over the canonical URL `host + path + ?query`:

* `*`  any run of characters without `/`, `?` and `#`
* `**` any run of characters
* `?`  one character, written `\\?` when a literal question mark is meant

All rules are compiled into one bit vector, packed into 64-bit words. A rule of m symbols takes
m + 1 bits (states 0..m). For each character c the step is

    state = ((state << 1 with carry between words) & MOVE[c]) | (state & STAY[c])

so every rule advances at once; MOVE and STAY hold one row of words per byte value. The step is
applied to a whole Arrow batch of URLs with numpy, one URL position at a time, over the URLs that
are still that long, so memory follows the batch and not the longest URL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANY, STAR, DEEP = "any", "star", "deep"
STOPS = b"/?#"


@dataclass(frozen=True)
class Rule:
    """`name` is reported for a fit, `verdict` is allow or block, `globs` are alternatives.
    Of the fitting rules the one with the largest (priority, length of name) decides; of equal ones block."""

    name: str
    verdict: str
    globs: tuple[str, ...]
    priority: int = 0


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with all its subdomains and a path prefix."""
    literal = "".join("\\" + c if c in "*?\\" else c for c in host + path)
    return Rule(host + path, verdict, (literal + "**", "*." + literal + "**"), priority=1)


#: The method's own rules for URLs that no given rule fits: pages without article text. All else is allowed.
DEFAULT_RULES = (
    Rule("no host", "block", ("",)),
    Rule("binary file", "block", tuple(f"**.{x}" for x in ("exe", "zip", "iso", "apk", "dmg"))),
    Rule("account page", "block", ("*/login**", "*/signin**", "*/wp-login**", "*/cart/**", "*/checkout/**")),
    Rule("tracking host", "block", ("ads.*/**", "tracker.*/**", "*.doubleclick.net/**")),
)


def parse_glob(glob: str) -> list[tuple[str, str] | str]:
    """The glob's symbols: ('c', character) or one of ANY, STAR, DEEP."""
    out: list = []
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            out.append(("c", glob[i + 1]))
            i += 2
        elif glob.startswith("**", i):
            out.append(DEEP)
            i += 2
        else:
            out.append(STAR if c == "*" else ANY if c == "?" else ("c", c))
            i += 1
    return out


class GlobAutomaton:
    """Every rule's globs as one multiword Shift-And automaton."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)
        move: list[tuple[int, int]] = []  # (byte, bit that the byte may enter)
        stay: list[tuple[int, int]] = []
        starts, accepts = [], []
        bit = 0
        free = [b for b in range(256) if b not in STOPS]
        for number, rule in enumerate(self.rules):
            for glob in rule.globs:
                starts.append(bit)
                for symbol in parse_glob(glob):
                    if symbol in (STAR, DEEP):
                        stay += [(b, bit) for b in (free if symbol == STAR else range(256))]
                        continue
                    bit += 1
                    wanted = range(256) if symbol == ANY else symbol[1].encode()
                    if symbol != ANY and len(wanted) > 1:  # canonical URLs are ASCII
                        raise ValueError(f"rule {rule.name!r} has a character beyond ASCII; write it percent-encoded")
                    move += [(b, bit) for b in wanted]
                accepts.append((bit, number))
                bit += 1
        self.words = max(1, -(-bit // 64))
        self.move, self.stay = (self._table(x) for x in (move, stay))
        self.start = self._table([(0, b) for b in starts])[0]
        self.accepts = accepts

    def _table(self, pairs: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for byte, bit in pairs:
            out[byte, bit // 64] |= np.uint64(1 << (bit % 64))
        return out

    def run(self, urls: Sequence[bytes]) -> np.ndarray:
        """Fits as a boolean matrix, URLs by rules."""
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-lengths, kind="stable")
        lengths, offsets = lengths[order], np.concatenate(([0], np.cumsum(lengths)))[:-1][order]
        data = np.frombuffer(b"".join(urls), np.uint8)
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        alive = len(urls)
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(lengths[0]) if len(urls) else 0):
            while lengths[alive - 1] <= at:
                alive -= 1
            byte = data[offsets[:alive] + at]
            now = state[:alive]
            ahead = now << one
            ahead[:, 1:] |= now[:, :-1] >> top
            state[:alive] = (ahead & self.move[byte]) | (now & self.stay[byte])
        fits = np.zeros((len(urls), len(self.rules)), bool)
        for bit, number in self.accepts:
            fits[order, number] |= (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return fits


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds `host`, `path` and `canonical`: host, path and query with every byte beyond printable ASCII
    percent-encoded; the fragment is dropped."""
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.regexp_replace(text, r"(?s)^.*?://", "")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return df.withColumns({"host": host, "path": path, "canonical": F.concat(host, path, query)})


def _ascii(url: str) -> bytes:
    data = url.encode("utf-8", "surrogatepass")
    return data if data.isascii() else b"".join(b"%%%02X" % b if b > 126 else bytes((b,)) for b in data)


def judge_urls(df: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, canonical, rule (the deciding rule's name), verdict and priority.

    Every rule is simulated over every whole URL in one pass and without a shuffle. A null or malformed
    URL has an empty host and path and is judged as the empty text; `default` holds where no rule fits.
    Columns of the input that bear one of the added names are replaced.
    """
    ranked = sorted(rules, key=lambda r: (r.priority, len(r.name), r.verdict == "block"), reverse=True)
    cached: dict = {}

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if "machine" not in cached:
            cached["machine"] = GlobAutomaton(ranked)
        machine = cached["machine"]
        names = np.array([r.name for r in ranked] + [None], object)
        verdicts = np.array([r.verdict for r in ranked] + [default], object)
        priorities = np.array([r.priority for r in ranked] + [-1], np.int32)
        for batch in batches:
            fits = machine.run([_ascii(x) for x in batch])
            first = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked)) if len(batch) else np.zeros(0, int)
            yield pd.DataFrame({"rule": names[first], "verdict": verdicts[first], "priority": priorities[first]})

    udf = F.pandas_udf(judge, "rule string, verdict string, priority int")
    parts = with_parts(df, url).withColumn("__judged", udf(F.col("canonical")))
    return parts.withColumns({c: F.col(f"__judged.{c}") for c in ("rule", "verdict", "priority")}).drop("__judged")
