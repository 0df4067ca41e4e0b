"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

FTRL is sequential, so it learns from a bounded sample of labelled rows in one task:
per-coordinate learning rates, L1 sparsity, a weight for the rarer positive rows.
Features that too few of the sample's rows have are left out.  L1 leaves few weights
other than zero, so the model is a short list with at most 2^bits entries:
broadcasting it has a proven bound.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joinloom.llm import arrays
from joinloom.llm.arrays import U
from joinloom.llm.workspace import Workspace


@dataclass(frozen=True)
class Settings:
    """``rows``: the most labelled rows that are trained on, those with the smallest
    hash of doc_id, and of these only the first of which the feature numbers together
    take ``bytes``.  A feature is used if one row in ``rarest``, at least two, has it
    (of at most eight).  ``positive``: weight of a row with label 1."""

    bits: int = 20
    rows: int = 16_000
    bytes: int = 256 << 20
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    positive: float = 3.0
    rarest: int = 1500


#: Feature numbers counted at a time.
BLOCK = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(batch: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts end to end, and where each text's begin (and the
    end): its words, pairs of neighbours, and pairs with one word between them."""
    buf, starts = arrays.joined(batch)
    begin, end = arrays.runs(_WORD[buf])
    h = arrays.span_hashes(buf, begin, end, fold=True)
    first = np.searchsorted(begin, starts)
    text = np.searchsorted(first, np.arange(len(h)), "right")
    parts, owners = [h], [text]
    for gap, salt in ((1, 0xA5), (2, 0x5A)):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            parts.append(arrays.mix(h[:-gap] * U(0x9E3779B97F4A7C15) + h[gap:] + U(salt))[same])
            owners.append(text[gap:][same])
    number, owner = np.concatenate(parts) >> U(64 - bits), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return number[order].astype(np.int32), np.searchsorted(owner[order], np.arange(1, len(batch) + 2))


def train(rows: list[np.ndarray], labels: np.ndarray, state: tuple[np.ndarray, np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the rows (distinct feature numbers; the last is the bias)."""
    z, n = state
    for _ in range(s.epochs):
        for x, y in zip(rows, labels, strict=True):
            zx, root = z[x], np.sqrt(n[x])
            w = weights(zx, root, s, x == 1 << s.bits)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - y) * (s.positive if y else 1.0)
            up = np.sqrt(n[x] + g * g)
            z[x] = zx + g - (up - root) / s.alpha * w
            n[x] += g * g
    return z, n


def weights(z: np.ndarray, root: np.ndarray, s: Settings, bias: np.ndarray) -> np.ndarray:
    l1 = np.where(bias, 0, s.l1)
    return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((s.beta + root) / s.alpha + s.l2))


def learned(batches: Iterator[pa.RecordBatch], s: Settings) -> pa.RecordBatch:
    """Numbers and values (i, w) of the weights that aren't zero, from rows (doc_id, y,
    x: feature numbers as bytes).

    The worker lives on after this task, so memory counts: the numbers stay in the
    batches' own buffers, and those used are copied once, into one array that the rows
    are parts of.  Arrays for each row would be several times as much, and leave it scattered."""
    dims, ids, labels, held = (1 << s.bits) + 1, [np.empty(0, np.int64)], [np.empty(0, np.int32)], []
    for b in batches:
        x = b.column("x").cast(pa.large_binary())
        ends = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] // 4
        held.append((np.frombuffer(x.buffers()[2] or b"", np.int32, ends[-1]), ends))
        ids.append(b.column("doc_id").to_numpy())
        labels.append(b.column("y").to_numpy())
    ids, labels = np.concatenate(ids), np.concatenate(labels)
    count = np.zeros(dims, np.int64)
    for x, ends in held:
        for at in range(ends[0], ends[-1], BLOCK):
            count += np.bincount(x[at : min(at + BLOCK, ends[-1])], minlength=dims)
    often = count >= min(8, max(2, len(ids) // s.rarest))
    used = np.empty(int(count[often].sum()) + len(ids), np.int32)
    stops = [0]
    while held:
        x, ends = held.pop(0)
        for i, j in zip(ends, ends[1:], strict=False):
            row = x[i:j]
            row = row[often[row]]
            used[stops[-1] : stops[-1] + len(row)] = row
            stops.append(stops[-1] + len(row) + 1)
            used[stops[-1] - 1] = dims - 1
    b = x = None  # else the last batch stays during training
    order = np.lexsort((ids, arrays.mix(ids.view(U))))
    z, n = train([used[stops[i] : stops[i + 1]] for i in order], labels[order], (np.zeros(dims), np.zeros(dims)), s)
    w = weights(z, np.sqrt(n), s, np.arange(dims) == dims - 1)
    at = np.flatnonzero(w)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], ["i", "w"])


def crc(column) -> F.Column:
    return F.crc32(column.cast("string").cast("binary"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), modulus: int = 5, held_out: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and values of the weights that aren't zero, and the bias.  Learns from
    labelled rows (doc_id, toxic 0/1; others are skipped) outside the held-out fold."""
    s = settings
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.filter(F.pmod(crc(F.col("doc_id")), F.lit(modulus)) != held_out)
    sample = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.rows)

    def extract(batches):
        for b in arrays.slices(batches):
            texts = arrays.texts(b.column("text"))
            out = []
            for part in arrays.chunks(np.array([len(t) for t in texts])):
                x, at = features(texts[part], s.bits)
                out += [np.unique(x[i:j]).tobytes() for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(out, pa.binary())], ["doc_id", "y", "x"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = text.join(F.broadcast(sample), "doc_id")  # at most s.rows rows of two numbers
    rows = text.mapInArrow(extract, "doc_id long, y int, x binary").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    rows = Workspace(docs.sparkSession, "toxicity").stage(rows, "sample")
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.select("doc_id", F.coalesce(F.sum(F.octet_length("x")).over(so_far), F.lit(0)).alias("before"))  # at most s.rows rows
    rows = rows.join(F.broadcast(first.filter(F.col("before") < s.bytes).select("doc_id")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield learned(batches, s)

    got = rows.withColumn("sample", F.col("y") * 0).groupBy("sample").applyInArrow(run, "i int, w double").toPandas().sort_values("i")  # at most 2^bits rows
    inner = got["i"] < 1 << s.bits
    bias = got["w"][~inner]
    return got["i"][inner].to_numpy(), got["w"][inner].to_numpy(), float(bias.sum())


def _scores(texts: list[str], w: np.ndarray, bias: float, bits: int) -> np.ndarray:
    total = [np.empty(0)]
    for part in arrays.chunks(np.array([len(t) for t in texts])):
        x, begin = features(texts[part], bits)
        hit = np.flatnonzero(w[x])
        text = np.searchsorted(begin, hit, "right") - 1
        once = np.unique(text.astype(np.int64) << 32 | x[hit])
        total.append(bias + np.bincount(once >> 32, w[once & 0xFFFFFFFF], len(begin) - 1))
    return 1 / (1 + np.exp(-np.clip(np.concatenate(total), -35, 35)))


def _dense(model: tuple[np.ndarray, np.ndarray, float], bits: int) -> np.ndarray:
    w = np.zeros(1 << bits)
    w[model[0]] = model[1]
    return w


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], settings: Settings = Settings(), threshold: float = 0.5, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w = _dense(shared.value, settings.bits)
        for b in arrays.slices(batches):
            p = _scores(arrays.texts(b.column("text")), w, shared.value[2], settings.bits)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    key = F.col("doc_id").cast("long")
    fold = F.coalesce(F.pmod(crc(key), F.lit(modulus)) == held_out, F.lit(False))
    return docs.select(key.alias("doc_id"), fold.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, that score under the threshold: one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))

    def run(batches):
        w = _dense(shared.value, settings.bits)
        for b in arrays.slices(batches):
            p = _scores(arrays.texts(b.column("text")), w, shared.value[2], settings.bits)
            yield b.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs`` (doc_id, text).

    A null or empty text has the bias's score.  A null doc_id stays null and is not
    held out; repeated rows are scored each.  Labelled rows with a null or a value
    other than 0 and 1 teach nothing, and of a doc_id with both labels the 0 counts; of
    repeated rows of a doc_id one teaches.  Without any labelled row all scores are 0.5.
    A text is taken whole; a very long one is one row of a task.  No columns but doc_id
    and text are read.  Empty in, empty out.
    """
    return score(docs, fit(docs, labels, settings), settings)
