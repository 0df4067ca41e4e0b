"""Packing into sequences that each hold the sources in target proportions.

Each source is a queue of documents, laid end to end as one token stream.  Targets are
weights; by default the sources' shares of all tokens, so that all queues run dry
together.  Deficit round-robin visits the queues once per window (a sequence): with a
share p_s of the weights, queue s is due size * p_s tokens more after each window, takes
what it is due in whole tokens, and carries the rest - its deficit, always under one
token - on.  Whole tokens that a window has left go to the queues with the largest
deficits.  When a queue with more weight than tokens runs dry, the others share what it
was due by their weights.  Every window is full but the last.

Sources due under ``min_quota`` tokens a sequence share one queue, the pool, with the sum
of their weights; in it each still has a queue: by deficits that accumulate over windows,
a source gives ``min_quota`` tokens whenever its share of the pool makes them due, so that
together they keep to their shares of the pool's tokens.

The carried deficits have a closed form, linear between the points where a queue runs
dry, so a task finds the state at its first window by itself: windows are filled in
parallel, and no state passes between partitions except where each bucket of a queue begins.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from fractions import Fraction
from math import lcm

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joinloom.llm import arrays, bpe
from joinloom.llm.workspace import Workspace

#: Tokens of a bucket of a queue: what one task holds at a time, besides one long text.
BUCKET = 1 << 20
#: Least tokens due a sequence for a queue of its own; at most size / MIN_QUOTA queues.
MIN_QUOTA = 16


class Mixture:
    """Queues' total tokens and weights, in their order within a window."""

    def __init__(self, totals: tuple[int, ...], size: int, weights: tuple[Fraction, ...] | None = None):
        self.totals, self.size, self.total = totals, size, sum(totals)
        weights = weights or tuple(map(Fraction, totals))
        #: (start, base, rate, unit): from start tokens of all on, a queue has given
        #: (base + rate * tokens) / unit.
        self.phases: list[tuple[Fraction, list[int], list[int], int]] = []
        given, start = [Fraction(0)] * len(totals), Fraction(0)
        while left := [s for s, n in enumerate(totals) if given[s] < n]:
            of = sum(weights[s] for s in left)
            rate = [weights[s] / of if s in left else Fraction(0) for s in range(len(totals))]
            base = [g - start * r for g, r in zip(given, rate, strict=True)]
            unit = lcm(*(x.denominator for x in (*base, *rate)))
            self.phases.append((start, [int(x * unit) for x in base], [int(x * unit) for x in rate], unit))
            step = min((totals[s] - given[s]) / rate[s] for s in left)
            given = [g + step * r for g, r in zip(given, rate, strict=True)]
            start += step

    def taken(self, w: np.ndarray) -> np.ndarray:
        """Tokens that each queue has given before each window w: len(w) x queues."""
        due = np.minimum(w.astype(object) * self.size, self.total)
        phase = np.searchsorted(np.array([-(-p[0].numerator // p[0].denominator) for p in self.phases], object), due, "right") - 1
        whole, rest = np.empty((len(w), len(self.totals)), np.int64), np.empty((len(w), len(self.totals)))
        for k in np.unique(phase).tolist():
            _, base, rate, unit = self.phases[k]
            at = np.flatnonzero(phase == k)
            small = unit * self.total < 2**62 and max(map(abs, base)) < 2**62
            exact = due[at].astype(np.int64 if small else object)[:, None] * np.array(rate, np.int64 if small else object) + np.array(base, np.int64 if small else object)
            whole[at] = exact // unit
            rest[at] = (exact % unit / unit).astype(float)
        left = due.astype(np.int64) - whole.sum(axis=1)
        order = np.argsort(-rest, axis=1, kind="stable")
        rank = np.empty(order.shape, np.int64)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(self.totals)), order.shape), axis=1)
        return whole + (rank < left[:, None])

    def _when(self, queue: int, tokens: int) -> Fraction:
        """How many tokens all have given when a queue has given so many."""
        for k, (start, base, rate, unit) in enumerate(self.phases):
            end = self.phases[k + 1][0] if k + 1 < len(self.phases) else Fraction(self.total)
            if rate[queue] and base[queue] + rate[queue] * end >= tokens * unit:
                return max(start, Fraction(tokens * unit - base[queue], rate[queue]))
        return Fraction(self.total)

    def windows(self, queue: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows that hold tokens begin..end of a queue: their numbers, where in
        the queue each begins, and at which offset of the window."""
        last = -(-self.total // self.size)
        first = max(0, int(self._when(queue, begin) / self.size) - 2)
        w = np.arange(first, min(last, int(self._when(queue, end) / self.size) + 3) + 1)
        taken = self.taken(w)
        offset = np.diff(taken, axis=0)[:, :queue].sum(axis=1)
        return w[:-1], taken[:-1, queue], offset


def tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, source, n, ids (little-endian 16 or 32 bits each), with the end id."""

    def run(batches):
        vocab = bpe.load(vocabulary)
        kind = "<u2" if max(int(vocab.merged.max(initial=0)), end_id, *vocab.special.values()) < 1 << 16 else "<u4"
        for b in arrays.slices(batches):
            texts, ids, n = arrays.texts(b.column("text")), [], []
            for s in bpe.chunks(texts):
                flat, at = vocab.encode(texts[s])
                flat = np.insert(flat, at[1:], end_id).astype(kind)
                at = at + np.arange(len(at))
                raw, at = flat.tobytes(), at.tolist()
                width = flat.itemsize
                ids += [raw[x * width : y * width] for x, y in zip(at, at[1:], strict=False)]
                n += [y - x for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "n", "ids"])

    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source, "text").mapInArrow(run, "doc_id long, source string, n long, ids binary")


def _quanta(t: DataFrame, sums: DataFrame, quantum: int, bucket: int) -> DataFrame:
    """The documents of small sources cut where their source's tokens fill a quantum:
    due (the share of the source given when the piece's quantum is full, under 1 but
    for the last), place (in the source), base (in the document), n and ids of each
    piece.  In order of due, every source has given its share, to a quantum."""
    x = t.join(sums.select("source", F.col("n").alias("of")), "source")
    x = x.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.ceil(F.col("of") / bucket)))
    parts = x.groupBy("source", "part").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("source", "part").orderBy("doc_id", "n", "ids").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(parts, ["source", "part"]).withColumn("at", F.col("first") + F.sum("n").over(own) - F.col("n"))
    last = F.floor((F.col("at") + F.col("n") - 1) / quantum)
    x = x.withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / quantum), last)))
    x = x.withColumn("place", F.greatest("at", F.col("k") * quantum)).withColumn("base", F.col("place") - F.col("at"))
    length = F.least(F.col("at") + F.col("n"), (F.col("k") + 1) * quantum) - F.col("place")
    width = (F.octet_length("ids") / F.col("n")).cast("int")
    ids = F.col("ids").substr((F.col("base") * width + 1).cast("int"), (length * width).cast("int"))
    due = F.least((F.col("k") + 1) * quantum / F.col("of"), F.lit(1.0))
    return x.select(due.alias("due"), "place", "doc_id", "source", length.alias("n"), ids.alias("ids"), "base", F.col("n").alias("doc_tokens"))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def pack(docs: DataFrame, vocabulary: str, *, size: int = 2048, end_id: int = 1, bucket: int = BUCKET, min_quota: int = MIN_QUOTA, weights: Mapping[str, float] | None = None) -> DataFrame:
    """One row per piece of a document (doc_id, text, source): doc_id, start (the
    document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset, source.

    A document is its ids, then ``end_id``; a null or empty text is that id alone.  A
    null source is the source ''.  Documents of a queue are dealt to its buckets by a hash
    of doc_id and of their place in the table, so that rows of one doc_id, or of none, are
    not one group; in a bucket they follow each other by doc_id, length and ids.  A null
    doc_id is kept as null.  All sequences but the last are full, so only that one needs
    padding.  An empty table gives no pieces.  Columns other than the three are not read.
    A very long text is one row of a task.

    weights: target proportions by source, positive numbers; a source that isn't named has
    its share of all tokens (so 0.5 and 0.25 for two sources and nothing else are two to
    one against each other).  Without weights all sources have their shares.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    t = work.stage(tokenized(docs, vocabulary, end_id).withColumn("row", F.monotonically_increasing_id()), "tokens")
    sums = t.groupBy("source").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    if total == 0:
        return spark.createDataFrame([], SCHEMA)
    given = {k: Fraction(v).limit_denominator(10**6) for k, v in (weights or {}).items()}
    if any(v <= 0 for v in given.values()):
        raise ValueError("weights must be positive")
    named = sums.filter(F.col("source").isin(list(given))).collect() if given else []  # at most len(weights)
    share = {r.source: given[r.source] for r in named}
    unnamed = total - sum(r.n for r in named)
    of = sum(share.values()) + Fraction(unnamed, total)  # of all weights
    least = int(of * min_quota * total / size)
    rest = sums.filter((F.col("n") > least) & ~F.col("source").isin(list(given))).collect()  # at most size / min_quota
    share |= {r.source: Fraction(r.n, total) for r in rest}
    large = sorted((r for r in [*named, *rest] if share[r.source] * size >= min_quota * of), key=lambda r: r.source)
    names, totals, parts = [r.source for r in large], [r.n for r in large], [share[r.source] for r in large]
    rest = total - sum(totals)

    def weight_of_rest() -> Fraction:
        return of - sum(parts)

    while rest and totals and weight_of_rest() * size < min_quota * of:  # too little for a pool: with the smallest that has a queue
        k = parts.index(min(parts))
        rest += totals.pop(k)
        names.pop(k)
        parts.pop(k)
    if rest:
        parts.append(weight_of_rest())
        totals.append(rest)
    pool = len(names)
    mixture = Mixture(tuple(totals), size, tuple(parts))

    queues = spark.createDataFrame([(s, i) for i, s in enumerate(names)] or [("", 0)], "source string, queue int")
    buckets = F.lit(None)
    for i, n in enumerate(totals):
        buckets = F.when(F.col("queue") == i, F.lit(-(-n // bucket))).otherwise(buckets)
    q = t.join(F.broadcast(queues), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(pool)))
    q = q.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), buckets.cast("long")))
    q = q.select("queue", "bucket", F.lit(0.0).alias("due"), F.lit(0).cast("long").alias("place"), "doc_id", "source", "n", "ids", F.lit(0).cast("long").alias("base"), F.col("n").alias("doc_tokens"))
    if rest:
        pooled = _quanta(t.join(F.broadcast(queues), "source", "left_anti"), sums, min_quota, bucket)
        pooled = work.stage(pooled.withColumn("bucket", F.least(F.floor(F.col("due") * (-(-rest // bucket))), F.lit(-(-rest // bucket) - 1))), "pool")
        q = q.filter(F.col("queue") < pool).unionByName(pooled.withColumn("queue", F.lit(pool)))
    sizes = q.groupBy("queue", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("queue", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        queue, begin = int(key[0]), int(key[2])
        pdf = pdf.sort_values(["due", "source", "place", "doc_id", "n", "ids"], kind="stable")
        n = pdf["n"].to_numpy()
        at = begin + np.concatenate([[0], np.cumsum(n)])
        w, takes, offset = mixture.windows(queue, begin, int(at[-1]))
        cut = takes[(takes > begin) & (takes < at[-1])]
        starts = np.unique(np.concatenate([at[:-1], cut]))
        length = np.diff(np.concatenate([starts, at[-1:]]))
        doc = np.searchsorted(at, starts, "right") - 1
        win = np.searchsorted(takes, starts, "right") - 1
        raw = b"".join(pdf["ids"])
        kind = np.dtype(f"<u{len(raw) // max(1, int(n.sum()))}")
        flat = memoryview(np.frombuffer(raw, kind).astype("<u4").tobytes())
        crc = [zlib.crc32(flat[4 * a : 4 * (a + k)]) for a, k in zip((starts - begin).tolist(), length.tolist(), strict=True)]
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].to_numpy()[doc], "start": starts - at[doc] + pdf["base"].to_numpy()[doc], "length": length, "ids_crc32": crc, "doc_tokens": pdf["doc_tokens"].to_numpy()[doc],
            "sequence_id": w[win], "offset": offset[win] + starts - takes[win], "source": pdf["source"].to_numpy()[doc],
        })

    q = q.join(begins, ["queue", "bucket"])
    return q.groupBy("queue", "bucket", "begin").applyInPandas(fill, SCHEMA)
