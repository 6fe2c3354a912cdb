"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text gives a vector of transformed statistics (logarithms of counts and shares). For each class the
mean and covariance are exact sums over all labelled rows, made by task and added in a shuffle. The class
covariance is shrunk towards the pooled one and towards a multiple of the identity; its Cholesky factor is
computed once and cached in the model. A text's score is the logistic of the difference of the classes' log
densities (Mahalanobis distance and log determinant) with equal priors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightmill.llm.common import SLICE, lean, slices

NAMES = (
    "log_words", "log_word_length", "log_distinct_words", "log_distinct_pairs", "upper", "symbols", "stops", "digits", "letters", "log_line_words",
    "top_word", "repeats", "title_words", "marked_words", "duplicate_lines",
)
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, SYMBOL = range(7)
_CLASSES: list[np.ndarray] = []
_SMALL = 1e-3


def _char_classes() -> np.ndarray:
    """The class of each code point; built once a process."""
    if not _CLASSES:
        out = np.full(0x110000, SYMBOL, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                out[i] = UPPER if c.isupper() else LOWER
            elif c.isdigit():
                out[i] = DIGIT
            elif c.isspace():
                out[i] = SPACE
        out[10] = LINE
        out[[ord(c) for c in ".,;:?'\"-()"]] = STOP
        _CLASSES.append(out)
    return _CLASSES[0]


def _tally(texts: list[str]) -> np.ndarray:
    """How many characters of each class each text has."""
    kinds = _char_classes()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)) * 8, np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.bincount(owner + kinds, minlength=8 * len(texts)).reshape(-1, 8).astype(float)


def features(texts: list[str | None]) -> np.ndarray:
    """One row of statistics for each text; null counts as empty."""
    texts = [t or "" for t in texts]
    counts = np.zeros((len(texts), 8))
    for start, run in slices(texts):
        if len(run) == 1:  # as many pieces as it takes
            for a in range(0, len(run[0]), SLICE):
                counts[start] += _tally([run[0][a : a + SLICE]])[0]
        else:
            counts[start : start + len(run)] = _tally(run)
    rows = np.zeros((len(texts), 9))
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not n:
            continue
        tally = Counter(words)
        pairs = set(zip(words, words[1:], strict=False))
        lines = [x for x in text.split("\n") if x]
        repeats = sum(map(str.__eq__, words, words[1:]))
        titled = sum(w[0].isupper() for w in words)
        marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\")" for w in words)
        rows[i] = n, len(tally), len(pairs), max(tally.values()) / n, repeats / n, titled / n, marked / n, len(lines), 1 - len(set(lines)) / max(1, len(lines))
    n, distinct, pairs, top, repeats, titled, marked, lines, duplicates = rows.T
    chars = np.maximum(1, counts[:, [LOWER, UPPER, DIGIT, STOP, SYMBOL]].sum(axis=1))
    share = lambda k: np.log(counts[:, k] / chars + _SMALL)
    return np.column_stack((
        np.log1p(n), np.log1p(chars / np.maximum(1, n)), np.log1p(distinct), np.log1p(pairs), share(UPPER), share(SYMBOL), share(STOP), share(DIGIT),
        np.log((counts[:, LOWER] + counts[:, UPPER]) / chars + _SMALL), np.log1p(n / np.maximum(1, lines)), np.log(top + _SMALL), np.log(repeats + _SMALL),
        np.log(titled + _SMALL), np.log(marked + _SMALL), np.log(duplicates + _SMALL),
    ))


def feature_column(text: str = "text") -> Column:
    """The statistics of a text column as array<double>."""

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [features(batch[a : a + 512].to_pylist()) for a in range(0, len(batch), 512)]
            yield pa.array(list(np.concatenate(out)) if out else [], pa.list_(pa.float64()))

    return F.arrow_udf(lean(compute), "array<double>")(F.col(text))


@dataclass
class Discriminant:
    """Means and inverted Cholesky factors of the two classes. Without both classes the score is `share`,
    the share of label 1 (0.5 if there are no labels)."""

    share: float = 0.5
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)  # inverse of the lower Cholesky factor
    log_dets: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(labelled: DataFrame, vector: str = "features", label: str = "label", pooled: float = 0.1, identity: float = 0.02) -> Discriminant:
    """Fits on all rows of `labelled` with label 0 or 1; other labels and null vectors are left out.

    `pooled` is the weight of the pooled covariance in each class, `identity` that of the mean variance.
    The driver receives one row for each class and each entry of the moments.
    """
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, d)
            y = np.asarray(batch.column(1).to_pylist())
            for c in (0, 1):
                part = x[y == c]
                total[c] += np.concatenate(([len(part)], part.sum(axis=0), (part.T @ part).ravel()))
        for c in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([c] * total.shape[1], pa.int32()), pa.array(range(total.shape[1]), pa.int32()), pa.array(total[c])], ["class", "entry", "value"])

    # nulls among the vectors are left out in the task: as a filter here Spark would compute the statistics twice
    rows = labelled.where(F.col(label).isin(0, 1)).select(vector, F.col(label).cast("int"))
    moments = np.zeros((2, 1 + d + d * d))
    for r in rows.mapInArrow(lean(sums), "class int, entry int, value double").groupBy("class", "entry").agg(F.sum("value").alias("value")).collect():
        moments[r["class"], r["entry"]] = r["value"]
    n = moments[:, 0]
    if n.min() < 2:
        return Discriminant(n[1] / n.sum() if n.sum() else 0.5)
    means = moments[:, 1 : 1 + d] / n[:, None]
    scatter = moments[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    common = scatter.sum(axis=0) / n.sum()
    out = Discriminant(n[1] / n.sum())
    for c in (0, 1):
        s = (1 - pooled) * scatter[c] / n[c] + pooled * common
        s = (1 - identity) * s + identity * max(np.trace(s) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(s)
        out.means.append(means[c])
        out.factors.append(np.linalg.inv(lower))
        out.log_dets.append(2 * float(np.log(np.diag(lower)).sum()))
    return out


def score_column(df: DataFrame, model: Discriminant, vector: str = "features") -> Column:
    """The score of a column of statistics."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.score(np.array(batch.to_pylist(), float).reshape(-1, len(NAMES))))

    return F.arrow_udf(lean(judge), "double")(F.col(vector))


def score_text_column(df: DataFrame, model: Discriminant, text: str = "text") -> Column:
    """The score straight from the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [shared.value.score(features(batch[a : a + 512].to_pylist())) for a in range(0, len(batch), 512)]
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    return F.arrow_udf(lean(judge), "double")(F.col(text))
