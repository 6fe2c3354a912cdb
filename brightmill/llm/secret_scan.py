"""Secret scans: fixed patterns, and formats learned from them by grammar inference.

The fixed patterns find labelled credentials in the corpus. For each kind a prefix tree of them is built: its first
symbol is the length's class, then come the characters, those that are common at their place (fixed prefixes) as
themselves and the others by their class. The tree's statistically compatible states are merged (red-blue order,
Hoeffding bound, of all compatible states the one that explains the merged one best), which leaves a probabilistic
automaton of the kind's formats. The same is done with runs of characters that are no credentials. Every candidate of
a text is scored by all automata: the base spans' values, and all other runs of 8 or more credential characters. Such
a run is a secret if the kind with the best likelihood gives it as much a character as its own credentials have, and
clearly more than the automaton of ordinary runs does.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightmill.llm.common import cut_lineage, lean

# The base patterns. A-Z and a-z only, in either case for the names.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "learned")
MIN_ASSIGN, MIN_ACCESS, MIN_RUN = 8, 16, 8
RUN = r"[A-Za-z0-9+/_=-]{8,}"

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX)
_RUN = re.compile(RUN)
#: Classes of characters; a mark is a class of its own.
_GROUPS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")
_CLASS = {c: f"class {g[0]}" for g in _GROUPS for c in g}
_SIZE = {f"class {g[0]}": math.log(len(g)) for g in _GROUPS}
_FLOOR = math.log(1e-4)


def symbols(value: str) -> list[str]:
    """The length's class (steps of a fifth) and the characters."""
    return [f"length {round(4 * math.log2(max(1, len(value))))}", *value]


def _values(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, the credential itself) of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns."""
    return [v[:3] for v in _values(text)]


@dataclass
class Automaton:
    """A deterministic probabilistic automaton; state 0 is the start. A character takes its own move, else its class's."""

    moves: list[dict[str, tuple[int, float]]] = field(default_factory=list)  # symbol -> (state, log probability)
    ends: list[float] = field(default_factory=list)  # log probability to end there
    others: list[float] = field(default_factory=list)  # log probability of what was not seen there
    overall: dict[str, tuple[int, float]] = field(default_factory=dict)  # symbol -> (state that it mostly leads to, log probability anywhere)
    threshold: float = 0.0  # log likelihood a character that a member of the format has

    def likelihood(self, value: str) -> float:
        """Log likelihood a character. A move never seen has the state's probability for such moves times the symbol's
        anywhere, and goes where that symbol leads from the state that has it most often."""
        total, state = 0.0, 0
        for s in symbols(value):
            moves = self.moves[state]
            move = moves.get(s)
            if move is None:
                name = _CLASS.get(s, s)
                move = moves.get(name)
                total -= _SIZE.get(name, 0.0)
            if move is None:
                total += self.others[state]
                move = self.overall.get(name, (state, _FLOOR))
            state, p = move
            total += p
        return (total + self.ends[state]) / (len(value) + 1)


class _Tree:
    """The prefix tree of samples, and the merging of its states."""

    def __init__(self, samples: list[str], alpha: float, common: float, least: int):
        self.count, self.final, self.child = [0], [0], [{}]  # child: symbol -> [state, count]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        todo = [(0, [symbols(x) for x in samples], 0)]
        while todo:
            state, words, place = todo.pop()
            self.count[state] = len(words)
            self.final[state] = sum(len(w) == place for w in words)
            tally = Counter(w[place] for w in words if len(w) > place)
            # a character that many samples share at this place stands for itself
            own = {s for s, n in tally.items() if s not in _CLASS or n >= max(least, common * len(words))}
            groups: dict[str, list] = {}
            for w in words:
                if len(w) > place:
                    groups.setdefault(w[place] if w[place] in own else _CLASS[w[place]], []).append(w)
            for symbol, part in sorted(groups.items()):
                self.child[state][symbol] = [len(self.count), len(part)]
                self.count.append(0)
                self.final.append(0)
                self.child.append({})
                todo.append((len(self.count) - 1, part, place + 1))

    def differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) >= self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def evidence(self, red: int, blue: int) -> float | None:
        """The log likelihood of what goes on from `blue` by the moves of `red`; None if they differ significantly. Ten
        more visits, spread over seven moves, keep states that were visited a few times from fitting by chance."""
        total, todo = 0.0, [(red, blue)]
        while todo:
            x, y = todo.pop()
            n, m, mine, other = self.count[x], self.count[y], self.child[x], self.child[y]
            if self.differ(self.final[x], n, self.final[y], m):
                return None
            if self.final[y]:
                total += self.final[y] * math.log((self.final[x] + 10 / 7) / (n + 10))
            for s in mine.keys() | other.keys():
                p, q = mine.get(s), other.get(s)
                if self.differ(p[1] if p else 0, n, q[1] if q else 0, m):
                    return None
                if q:
                    total += q[1] * math.log(((p[1] if p else 0) + 10 / 7) / (n + 10))
                    if p:
                        todo.append((p[0], q[0]))
        return total

    def fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            x, y = todo.pop()
            self.count[x] += self.count[y]
            self.final[x] += self.final[y]
            for s, (state, n) in self.child[y].items():
                mine = self.child[x].get(s)
                if mine:
                    mine[1] += n
                    todo.append((mine[0], state))
                else:
                    self.child[x][s] = [state, n]

    def merge(self) -> list[int]:
        """Merges states; returns those that are left, the start first."""
        red, kept = [0], {0}
        while blue := max(((self.count[e[0]], -e[0], r, s) for r in red for s, e in self.child[r].items() if e[0] not in kept), default=None):
            parent, symbol = blue[2:]
            state = -blue[1]
            found = [(e, -r) for r in red[1:] if (e := self.evidence(r, state)) is not None]  # the start's move is a length
            if found:
                into = -max(found)[1]
                self.child[parent][symbol][0] = into
                self.fold(into, state)
            else:
                red.append(state)
                kept.add(state)
        return red


def infer(samples: Iterable[str], alpha: float = 0.05, common: float = 0.25, least: int = 5, quantile: float = 0.02, margin: float = 0.5) -> Automaton:
    """The automaton of the samples. `alpha` is the level of the Hoeffding tests, `common` and `least` are the share and
    number that make a character stand for itself. The threshold is the `quantile` of the likelihoods that each half of
    the samples has by the other half's automaton (with few samples, by their own), less `margin`."""
    samples = sorted(samples)
    out = _automaton(samples, alpha, common, least)
    halves = (samples[::2], samples[1::2])
    if len(samples) >= 20:
        own = sorted(p for a, b in (halves, halves[::-1]) for p in map(_automaton(a, alpha, common, least).likelihood, b))
    else:
        own = sorted(map(out.likelihood, samples))
    if own:
        out.threshold = own[int(quantile * len(own))] - margin
    return out


def _automaton(samples: list[str], alpha: float, common: float, least: int) -> Automaton:
    tree = _Tree(samples, alpha, common, least)
    states = tree.merge()
    number = {r: i for i, r in enumerate(states)}
    seen = Counter(_CLASS.get(s, s) for w in samples for s in symbols(w))
    busiest = {s: max((e[1], -e[0]) for r in states for x, e in tree.child[r].items() if _CLASS.get(x, x) == s) for s in seen}
    out = Automaton(overall={s: (number[-busiest[s][1]], math.log(n / seen.total())) for s, n in seen.items()})
    for r in states:
        # one pseudo-count for what was not seen
        total = tree.count[r] + 1
        out.moves.append({s: (number[e[0]], math.log(e[1] / total)) for s, e in tree.child[r].items()})
        out.ends.append(math.log(tree.final[r] / total) if tree.final[r] else _FLOOR)
        out.others.append(-math.log(total))
    return out


@dataclass
class Formats:
    """The automata of the kinds and of ordinary runs. A secret's likelihood is at least e**`odds` times that as an
    ordinary run."""

    kinds: dict[str, Automaton]
    ordinary: Automaton
    odds: float = 7.0

    def judge(self, value: str) -> tuple[str, float, bool]:
        """The kind with the best likelihood, this likelihood a character, and whether that makes a secret."""
        if not self.kinds:
            return "", 0.0, False
        likelihood, kind = max((a.likelihood(value), k) for k, a in self.kinds.items())
        like = likelihood >= self.kinds[kind].threshold
        return kind, likelihood, like and (likelihood - self.ordinary.likelihood(value)) * (len(value) + 1) >= self.odds

    def spans(self, text: str, known: dict[str, tuple[str, float, bool]]) -> list[tuple[str, int, int, str, float]]:
        """(kind, start, end, format, log likelihood a character) of the base spans, and of the learned ones, which touch no
        base span. `known` keeps judgements."""

        def judge(value: str) -> tuple[str, float, bool]:
            if value not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[value] = self.judge(value)
            return known[value]

        base = _values(text)
        out = [(k, a, b, *judge(value)[:2]) for k, a, b, value in base]
        for m in _RUN.finditer(text):
            found = judge(m[0])
            if found[2] and not any(s < m.end() and m.start() < e for _, s, e, _ in base):
                out.append(("learned", *m.span(), *found[:2]))
        return out


KNOWN = 50_000  # judgements that a task keeps


def credentials(df: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value): the distinct credentials that the base patterns find in all texts."""
    c = F.coalesce(F.col(text), F.lit(""))
    found = [
        F.transform(F.regexp_extract_all(c, F.lit(f"(?i){ASSIGN}"), F.lit(2)), lambda v: F.struct(F.lit("assign").alias("kind"), v.alias("value"))),
        F.transform(F.regexp_extract_all(c, F.lit(ACCESS), F.lit(0)), lambda v: F.struct(F.lit("access").alias("kind"), v.alias("value"))),
        F.transform(F.regexp_extract_all(c, F.lit(HEX), F.lit(0)), lambda v: F.struct(F.lit("hex").alias("kind"), v.alias("value"))),
    ]
    rows = df.select(F.explode(F.concat(*found)).alias("v")).select("v.kind", "v.value")
    long_enough = F.length("value") >= F.when(F.col("kind") == "access", MIN_ACCESS).otherwise(MIN_ASSIGN)
    return rows.where(long_enough).distinct()


def learn_formats(df: DataFrame, text: str = "text", per_kind: int = 400, ordinary_docs: int = 300, ordinary_runs: int = 1500) -> Formats:
    """Automata of each kind and of ordinary runs.

    Fitted on a bounded sample: of all distinct credentials the `per_kind` with the smallest hash in each kind; of the
    runs outside base spans in the whole texts of about `ordinary_docs` documents, chosen by a hash of the text, those
    `ordinary_runs` with the smallest hash of text and place, so that frequent runs are learned as such; equal texts count
    once. The same table gives the same sample.
    """
    found = cut_lineage(credentials(df, text))
    kinds = {}
    for kind in KINDS[:3]:
        first = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(per_kind)
        if values := [r["value"] for r in first.select("value").collect()]:
            kinds[kind] = infer(values)
    share = min(1.0, ordinary_docs / max(1, df.count()))
    rest = F.col(text)
    for pattern in (f"(?i){ASSIGN}", ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    chosen = df.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int((1 << 30) * share)).select(F.xxhash64(text).alias("digest"), F.posexplode(F.regexp_extract_all(rest, F.lit(RUN), F.lit(0))).alias("place", "run")).distinct()
    runs = [r["run"] for r in chosen.orderBy(F.xxhash64("digest", "place"), "run").limit(ordinary_runs).collect()]
    return Formats(kinds, infer(runs))


SCAN = "n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans string, formats string"
_SCAN = pa.struct([(p.split()[0], pa.int64() if p.endswith("long") else pa.string()) for p in SCAN.split(", ")])


def describe(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(df: DataFrame, formats: Formats, text: str = "text") -> DataFrame:
    """Adds the columns of `SCAN` for every whole text (null: empty), replacing columns of these names: counts by kind, a
    digest of the base spans, all spans, and all spans with their most likely format and its log likelihood a character.

    Offsets count code points, ends are exclusive. Repeated rows have equal results; an empty table gives an empty one.
    Texts may have any length, one is scanned in one task.
    """
    shared = df.sparkSession.sparkContext.broadcast(formats)

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, known = shared.value, {}
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                found = sorted(model.spans(t or "", known), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                n = Counter(x[0] for x in found)
                spans = [x[:3] for x in found]
                base = hashlib.sha256(describe([x for x in spans if x[0] != "learned"]).encode()).hexdigest()
                out.append((*(n[k] for k in KINDS), base, describe(spans), ",".join(f"{k}:{a}:{b}:{kind}:{p:.3f}" for k, a, b, kind, p in found)))
            columns = zip(*out, strict=True) if out else [[]] * len(_SCAN)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCAN, strict=True)], fields=list(_SCAN))

    kind = f"struct<{', '.join(p.replace(' ', ':') for p in SCAN.split(', '))}>"
    found = df.withColumn("__found", F.arrow_udf(lean(search), kind)(F.col(text)))
    return found.withColumns({f.name: F.col(f"__found.{f.name}") for f in _SCAN}).drop("__found")
