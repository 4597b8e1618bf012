"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

1. ``statistics`` turns every whole text into a fixed number of numbers (a map over Arrow batches; the result is written once).
2. They are standardized by their means and deviations over all documents, and cos(w x + b) with Gaussian w approximates a Gaussian
   kernel. Each partition of labelled rows sums its part of the normal equations; the sums are added up by key in Spark, so the
   driver gets one matrix of fixed size and solves it.
3. A part of the training rows that the ridge didn't see is summed by rounded score; the isotonic fit pools adjacent bins.

Labels are used only where ``training`` holds. Neither labels nor lang, source or doc_id are inputs of a score. Null text is scored
as empty text; null labels are no labels; several labels of one doc_id count as one row each; rows are scored each, with null and
repeated ids, too (``h``, a hash of the text, tells rows apart that share one); ids are integers; other columns are ignored, whatever
their names; without labelled training rows every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, id_and_bytes, staged, worker_of

FEATURES = 256
BINS = 1000
KINDS = ["upper", "lower", "digit", "space", "newline", "stop", "comma", "loud", "quote", "symbol", "bar", "bracket", "dash", "wide", "control", "other"]


def _kinds() -> np.ndarray:
    kind = np.full(256, KINDS.index("other"))
    for name, members in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t", "newline": b"\n", "stop": b".", "comma": b",;:", "loud": b"!?", "quote": b"'\"`", "symbol": b"#*$%&@^~+=", "bar": b"|\\/_", "bracket": b"<>()[]{}", "dash": b"-", "wide": range(128, 256), "control": [*range(0, 9), *range(11, 32), 127]}.items():
        kind[list(members)] = KINDS.index(name)
    return kind


KIND_OF = np.eye(len(KINDS))[_kinds()]
STATISTICS = [*KINDS, "log_bytes", "log_words", "word_bytes", "long_words", "short_words", "distinct_words", "top_word", "log_lines", "repeated_lines", "words_in_line", "repeated_pairs", "entropy", "lower_starts"]


def statistics_of(text: bytes) -> list[float]:
    """The numbers named in STATISTICS; shares where a name is a kind of byte."""
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    share = hist / max(n, 1)
    words = text.split()
    many = max(len(words), 1)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    pairs = len(set(zip(words, words[1:])))
    used = share[share > 0]
    return [
        *(share @ KIND_OF),
        np.log1p(n),
        np.log1p(len(words)),
        lens.sum() / many,
        (lens > 12).sum() / many,
        (lens < 4).sum() / many,
        len(counts) / many,
        max(counts.values(), default=0) / many,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(len(words) / max(len(lines), 1)),
        1 - pairs / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
        float(-(used * np.log2(used)).sum()),
        sum(x[:1].islower() for x in lines) / max(len(lines), 1),
    ]


def statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_of("quality")
    for whole in batches:
        for batch, texts in by_bytes(whole):
            x = np.array([statistics_of(t) for t in texts], np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), flat], ["doc_id", "h", "x"])


class Kernel:
    """Standardized statistics to random Fourier features, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1)
        self.w = draw.normal(size=(len(mean), features)) / np.sqrt(2 * len(mean))
        self.b = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack((np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def equation_batches(batches: Iterator[pa.RecordBatch], kernel: Kernel) -> Iterator[pa.RecordBatch]:
    """(x, y): this partition's sums, the upper triangle of z'z with z'y beside it, as (place, value)."""
    total = None
    for batch in batches:
        z = np.hstack((kernel(matrix(batch.column(0), len(kernel.mean))), batch.column(1).to_numpy()[:, None]))
        total = z.T @ z if total is None else total + z.T @ z
    if total is not None:
        up = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(up[0] * len(total) + up[1]), pa.array(total[up])], ["place", "value"])


def solve(rows: list, width: int, ridge: float) -> np.ndarray | None:
    if not rows:
        return None
    total = np.zeros(width * width)
    for r in rows:
        total[r["place"]] = r["value"]
    total = total.reshape(width, width)
    total = total + np.triu(total, 1).T
    a, y = total[:-1, :-1], total[:-1, -1]
    return np.linalg.solve(a + ridge * np.eye(len(a)), y)


class Isotonic:
    """Pooled adjacent violators over (bin, rows, sum of labels); between the blocks' centres the score runs in straight lines."""

    def __init__(self, bins: list[tuple[int, int, float]]):
        blocks: list[list[float]] = []
        for at, n, y in sorted(bins):
            blocks.append([n, y, n * at])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                n, y, c = blocks.pop()
                blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + y, blocks[-1][2] + c]
        self.x = np.array([c / n for n, _, c in blocks])
        self.y = np.array([y / n for n, y, _ in blocks])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.x):
            return np.clip(x, 0, 1)
        # a hundredth of the raw score keeps the order within a block
        return np.clip(0.99 * np.interp(x * BINS, self.x, self.y) + 0.01 * np.clip(x, 0, 1), 0, 1)


def raw_batches(batches: Iterator[pa.RecordBatch], kernel: Kernel, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = kernel(matrix(batch.column(0), len(kernel.mean))) @ weights
        yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.rint(raw * BINS), -BINS, 2 * BINS).astype(np.int64)), batch.column(1).cast(pa.float64())], ["bin", "y"])


def score_batches(batches: Iterator[pa.RecordBatch], kernel: Kernel, weights: np.ndarray | None, isotonic: Isotonic) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch.column(2), len(kernel.mean))
        score = np.full(len(x), 0.5) if weights is None else isotonic(kernel(x) @ weights)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "h", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality", features: int = FEATURES, ridge: float = 1e-2) -> DataFrame:
    """doc_id, h and score (0 to 1, higher: label 1 likelier) of every row. ``training``: the doc_ids whose labels may be used."""
    rows = staged(id_and_bytes(docs).withColumn("h", F.xxhash64("text")).mapInArrow(statistics_batches, "doc_id bigint, h bigint, x array<float>"), "statistics")
    d = len(STATISTICS)
    moments = rows.agg(*(f(F.get("x", F.lit(k)).cast("double")).alias(f"{n}{k}") for k in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    kernel = Kernel(np.array([moments[f"m{k}"] or 0.0 for k in range(d)]), np.array([moments[f"s{k}"] or 0.0 for k in range(d)]), features)
    known = labels.where(training).select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("y")).where("_id is not null and y is not null")
    known = staged(rows.join(known, F.col("doc_id") == F.col("_id")).select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("calibrates")), "labelled")
    sums = known.where("not calibrates").select("x", "y").mapInArrow(lambda it: equation_batches(it, kernel), "place bigint, value double")
    weights = solve(sums.groupBy("place").agg(F.sum("value").alias("value")).collect(), features + 2, ridge)
    bins = []
    if weights is not None:
        raw = known.where("calibrates").select("x", "y").mapInArrow(lambda it: raw_batches(it, kernel, weights), "bin bigint, y double")
        bins = [(r["bin"], r["n"], r["y"]) for r in raw.groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()]
    isotonic = Isotonic(bins)
    return rows.mapInArrow(lambda it: score_batches(it, kernel, weights, isotonic), "doc_id bigint, h bigint, score double")
