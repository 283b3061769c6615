"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts in one narrow pass. The trees are grown on the driver from a
bounded sample of labelled rows (``SAMPLE``), over histograms of binned features, and flattened
into arrays that every task traverses with numpy, a level of all its rows at a time.

Defined cases: null and empty texts have all statistics zero and are scored like any other; rows
without a usable label, or whose id is null, train nothing; with no label at all every score is
0.5, with labels of one kind only, that kind's smoothed share; repeated rows give repeated results; extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Written, small

#: Labelled rows that the trees are grown from at most: those whose ids hash lowest.
SAMPLE = 50_000
FOLDS = 5
THRESHOLD = 0.3
FEATURES = (
    "words", "chars", "word_length", "longest_word", "unique_words", "repeated_windows", "repeated_words", "lines",
    "repeated_lines", "line_words", "letters", "capitals", "digits", "marks", "symbols", "blanks", "pipes", "shouts", "periods",
)
LETTER, CAPITAL, DIGIT, MARK, SYMBOL, BLANK, OTHER = range(7)
KINDS = {"Lu": CAPITAL, "Lt": CAPITAL, "Nd": DIGIT, "Zs": BLANK, "Cc": BLANK}


@functools.cache
def kinds() -> np.ndarray:
    """The kind of each character of the basic plane."""
    by_letter = {"L": LETTER, "M": LETTER, "N": DIGIT, "P": MARK, "S": SYMBOL, "Z": BLANK}
    found = np.empty(65536, np.uint8)
    for c in range(65536):
        category = unicodedata.category(chr(c))
        found[c] = KINDS.get(category, by_letter.get(category[0], OTHER))
    for c in b"#*$%&|<>":
        found[c] = SYMBOL
    return found


def statistics(text: str | None) -> list[float]:
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(kinds()[np.minimum(codes, 65535)], minlength=7)
    chars = len(codes)
    sizes = np.fromiter(map(len, words), np.int64, n)
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    windows = hashes[2:] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[:-2] if n > 2 else hashes[:0]
    repeated = len(windows) - len(np.unique(windows))
    same = int((hashes[1:] == hashes[:-1]).sum())
    lines = [s for line in text.split("\n") if (s := line.strip())]
    return [
        float(n), float(chars), sizes.mean(), float(sizes.max()), len(np.unique(hashes)) / n, repeated / n, same / n, float(len(lines)),
        (len(lines) - len(set(lines))) / len(lines), n / len(lines), counts[LETTER] / chars, counts[CAPITAL] / chars, counts[DIGIT] / chars,
        counts[MARK] / chars, counts[SYMBOL] / chars, counts[BLANK] / chars, text.count("|") / n, text.count("!") / n, text.count(".") / n,
    ]


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))], names=["doc_id", "x"]
        )


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf is its own child on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Gradient-boosted trees for labels 0 and 1 by Newton steps on the logistic loss."""
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share))) if n else 0.0
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.empty(0) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]) if n else np.empty((width, 0), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        right.append(len(right))
        value.append(v)
        return len(value) - 1

    margin = np.full(n, start)
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(node(0.0))
        owner = np.full(n, roots[-1])
        level = [roots[-1]]
        for _ in range(depth):
            place = {k: i for i, k in enumerate(level)}
            local = np.full(len(value), -1)
            local[level] = np.arange(len(level))
            mine = local[owner]
            live = mine >= 0
            best = [(0.0, -1, 0)] * len(level)
            for f in range(width):
                if not len(edges[f]):
                    continue
                span = len(edges[f]) + 1
                key = mine[live] * span + binned[f][live]
                shape = (len(level), span)
                cg, ch, cn = (np.bincount(key, w, minlength=len(level) * span).reshape(shape).cumsum(1) for w in (g[live], h[live], None))
                lg, lh, ln = cg[:, :-1], ch[:, :-1], cn[:, :-1]
                tg, th, tn = cg[:, -1:], ch[:, -1:], cn[:, -1:]
                gain = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
                gain = np.where((ln >= least) & (tn - ln >= least), gain, 0)
                for k, b in enumerate(gain.argmax(1)):
                    if gain[k, b] > best[k][0] + 1e-9:
                        best[k] = (gain[k, b], f, int(b))
            after = []
            for k in level:
                gained, f, b = best[place[k]]
                if gained <= 0:
                    continue
                feature[k], threshold[k] = f, edges[f][b]
                left[k], right[k] = node(0.0), node(0.0)
                rows = owner == k
                low = binned[f] <= b
                owner[rows & low], owner[rows & ~low] = left[k], right[k]
                after += [left[k], right[k]]
            level = after
            if not level:
                break
        for k in np.unique(owner):
            rows = owner == k
            value[k] = rate * g[rows].sum() / (h[rows].sum() + ridge)
            margin[rows] += value[k]
    return Trees(
        np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value),
        np.array(roots, np.int64), depth, start,
    )


def scored(model: Trees, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.float64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0


def train(features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled rows outside of the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out())
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    got = known.join(features, "doc_id").select("y", "x").limit(sample).toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return grow(x, got["y"].to_numpy(np.float64))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    written = Written(docs.sparkSession)
    features = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measured, "doc_id long, x array<float>")
    )
    model = train(features, labels, sample)
    return features.mapInArrow(functools.partial(scored, model), "doc_id long, score double").select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
