"""Document quality: ridge regression on random Fourier features, calibrated.

Each text becomes a short vector of statistics.  Cosines of random projections of
the standardised vector approximate a Gaussian kernel.  Every partition sums its
normal equations, whose rows are added up by number, each of a fixed size and one at a
time, so fitting takes all labelled rows.  Isotonic regression on rows that the fit has not seen turns ridge scores into
probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinloom.llm import arrays
from joinloom.llm.toxicity import crc
from joinloom.llm.workspace import Workspace

STATS = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "word_bytes_sd", "long_words", "line_words", "line_words_sd", "short_lines",
    "symbols", "digits", "capitals", "punctuation", "spaces", "high_bytes", "pipes", "stops", "symbol_words", "digit_words", "capital_words",
    "distinct_words", "distinct_pairs", "repeated_lines", "lines_end", "entropy", "word_end_symbols", "longest_word", "top_word",
)


@dataclass(frozen=True)
class Settings:
    features: int = 256
    gamma: float = 0.02
    ridge: float = 1e-3
    bins: int = 2000
    seed: int = 7


def _lut(*values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(v) for v in "".join(values)]] = True
    return out


_SPACE = _lut(" \t\n\r\v\f")
_DIGIT = _lut("0123456789")
_UPPER = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PUNCT = _lut(".,;:!?'\"()-")
_SYMBOL = _lut("#$%&*+/<=>@[\\]^_`{|}~")
_HIGH = np.arange(256) >= 128


def statistics(batch: list[str]) -> np.ndarray:
    """One row of STATS for each text; an empty text has zeros."""
    buf, starts = arrays.joined(batch)
    size = np.diff(starts) - 1
    n = len(batch)
    text_of = np.repeat(np.arange(n), size + 1)
    real = np.maximum(size, 1)

    def share(lut: np.ndarray) -> np.ndarray:
        return np.bincount(text_of[lut[buf]], minlength=n) / real

    begin, end = arrays.words(buf)
    width, owner = (end - begin).astype(float), text_of[begin]
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)

    def mean(v: np.ndarray, of=None, count=None) -> np.ndarray:
        return np.bincount(owner if of is None else of, v, n) / (some if count is None else count)

    def sd(v, m, of=None, count=None):
        return np.sqrt(np.maximum(mean(v * v, of, count) - m * m, 0))

    line_begin, line_end = arrays.runs(buf != 10)
    line_of = text_of[line_begin]
    lines = np.bincount(line_of, minlength=n)
    some_lines = np.maximum(lines, 1)
    line_words = (np.searchsorted(begin, line_end) - np.searchsorted(begin, line_begin)).astype(float)
    h = arrays.span_hashes(buf, begin, end, fold=True)

    def distinct(values: np.ndarray, of: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of distinct values, and of the commonest one, in each text."""
        order = np.lexsort((values, of))
        v, o = values[order], of[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(v)))
        top = np.zeros(n)
        np.maximum.at(top, o[at], times)
        return np.bincount(o[at], minlength=n) / count, top / count

    kinds, top = distinct(h, owner, some)
    same = owner[1:] == owner[:-1]
    pair = arrays.ngrams(h, 2)[same] if len(h) > 1 else h[:0]
    pairs, _ = distinct(pair, owner[1:][same], np.maximum(words - 1, 1))
    once, _ = distinct(arrays.span_hashes(buf, line_begin, line_end), line_of, some_lines)
    first, last = buf[begin], buf[end - 1]
    word_mean, line_mean = mean(width), mean(line_words, line_of, some_lines)
    count = np.bincount(text_of * 256 + buf, minlength=n * 256).reshape(n, 256).astype(float)
    count[:, 10] = np.maximum(count[:, 10] - 1, 0)  # of the line end that joins texts
    p = count / np.maximum(count.sum(axis=1, keepdims=True), 1)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, width)
    out = np.stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), word_mean, sd(width, word_mean), mean(width > 14), line_mean, sd(line_words, line_mean, line_of, some_lines),
        mean((line_words < 3).astype(float), line_of, some_lines), share(_SYMBOL), share(_DIGIT), share(_UPPER), share(_PUNCT), share(_SPACE), share(_HIGH), share(_lut("|")),
        share(_lut(".!?")), mean(_SYMBOL[first]), mean(_DIGIT[first]), mean(_UPPER[first]), kinds, pairs, 1 - once, mean(_PUNCT[buf[line_end - 1]], line_of, some_lines),
        -(p * np.log(np.maximum(p, 1e-12))).sum(axis=1), mean(_SYMBOL[last]), np.log1p(longest), top,
    ], axis=1)
    out[size == 0] = 0
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of each row's whole text."""

    def run(batches):
        for b in arrays.slices(batches):
            texts = arrays.texts(b.column("text"))
            x = [statistics(texts[s]) for s in arrays.chunks(np.array([len(t) for t in texts]))]
            flat = np.concatenate([*x, np.empty((0, len(STATS)))])
            at = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(STATS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(flat.ravel()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Standardisation, random features, ridge weights, and the calibration's knots."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1)
        self.omega = rng.normal(0, np.sqrt(2 * s.gamma), (len(mean), s.features))
        self.phase = rng.uniform(0, 2 * np.pi, s.features)
        self.beta = np.zeros(s.features + 1)
        self.knots, self.values = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        f = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1])
        return np.hstack([f, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the raw score keeps order within a level."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted x: knots and non-decreasing means."""
    blocks: list[list[float]] = []
    for a, t, w in zip(x, total, weight, strict=True):
        blocks.append([a * w, t, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _rows(batches):
    for b in batches:
        if b.num_rows:
            yield np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, -1), b.column("y").to_numpy(zero_copy_only=False).astype(float)


def _numbered(total: np.ndarray, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array([total[i].tobytes() for i in at], pa.binary())], ["row", "sums"])


def fit(stats: DataFrame, labels: DataFrame, s: Settings = Settings(), modulus: int = 4, held_out: int = 2) -> Model:
    """From labelled rows (doc_id, quality 0/1; others are skipped) outside the fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.filter(F.pmod(crc(F.col("doc_id")), F.lit(modulus)) != held_out).groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = stats.join(known, "doc_id").withColumn("calibrates", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    width = range(len(STATS))
    moments = rows.select([F.avg(F.col("x")[i]) for i in width] + [F.stddev_pop(F.col("x")[i]) for i in width]).first()
    if moments[0] is None:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)), s)
    model = Model(np.array(moments[: len(STATS)]), np.array(moments[len(STATS) :]), s)
    dims = s.features + 1

    def equations(batches):
        total, some = np.zeros((dims, dims + 1)), False
        for x, y in _rows(batches):
            f = model.features(x)
            total += f.T @ np.hstack([f, y[:, None]])
            some = True
        if some:
            yield _numbered(total, range(dims))

    def add(batches):
        """Sums the partitions' rows of one number; a task holds one sum of each at a time."""
        total, seen = np.zeros((dims, dims + 1)), np.zeros(dims, bool)
        for b in batches:
            at = b.column("row").to_numpy()
            np.add.at(total, at, np.frombuffer(b"".join(b.column("sums").to_pylist())).reshape(len(at), -1))
            seen[at] = True
        if seen.any():
            yield _numbered(total, np.flatnonzero(seen))

    parts = rows.filter("NOT calibrates").select("x", "y").mapInArrow(equations, "row int, sums binary")
    total = np.zeros((dims, dims + 1))
    for r in parts.repartition("row").mapInArrow(add, "row int, sums binary").collect():  # dims rows of dims + 1 numbers
        total[r.row] += np.frombuffer(r.sums)
    a = total[:, :dims]
    model.beta = np.linalg.solve(a + s.ridge * max(1.0, a[-1, -1]) / dims * np.eye(dims), total[:, dims])

    def binned(batches):
        for x, y in _rows(batches):
            at = np.clip(np.round(model.raw(x) * s.bins / 3), -s.bins, 2 * s.bins).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y)], ["bin", "y"])

    level = rows.filter("calibrates").select("x", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("t"), F.count("*").alias("w")).orderBy("bin").toPandas()  # at most 3 * bins rows
    if len(level):
        model.knots, model.values = isotonic(level["bin"].to_numpy() * 3 / s.bins, level["t"].to_numpy(), level["w"].to_numpy().astype(float))
    return model


def quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.7, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs`` (doc_id, text).

    A null or empty text has statistics of zero and the score that these give.  A null
    doc_id stays null and is not held out; repeated rows are scored each.  Labelled
    rows with a null or a value other than 0 and 1 teach nothing, and of a doc_id with
    both labels the 0 counts; without labelled rows all scores are about 0.5.  A text is
    taken whole; a very long one is one row of a task.  No other columns are read.
    Empty in, empty out.
    """
    stats = Workspace(docs.sparkSession, "quality").stage(document_statistics(docs), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, s, modulus, held_out))

    def run(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, len(STATS))
            p = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    fold = F.coalesce(F.pmod(crc(F.col("doc_id")), F.lit(modulus)) == held_out, F.lit(False))
    return stats.select("doc_id", fold.alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
