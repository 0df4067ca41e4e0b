import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from joinloom.llm import quality as quality_module
from joinloom.llm import toxicity as toxicity_module
from joinloom.llm.quality import STATS, document_statistics, isotonic, quality, statistics
from joinloom.llm.toxicity import Settings, features, toxicity, without_toxic

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, held_out boolean, score double, y int, toxic int, x int"
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.mark.parametrize(("operator", "label", "modulus", "out", "least"), [(toxicity, "toxic", 5, 0, 0.9), (quality, "quality", 4, 2, 0.9)])
def test_held_out_accuracy(spark, operator, label, modulus, out, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in operator(docs, labels).collect()}
    assert len(got) == docs.count()
    rows = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % modulus == out]
    assert all(got[r.doc_id].held_out for r in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[r.doc_id].predicted == r[label] for r in rows]) > least
    if operator is toxicity:
        turned = labels.withColumn(label, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == out, 1 - F.col(label)).otherwise(F.col(label)))
        again = {r.doc_id: r.score for r in operator(docs, turned).collect()}
        assert again == {i: r.score for i, r in got.items()}


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_edges(spark, operator):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 60000), (3, "word " * 60000), (4, "é" * 10), (5, "\n\n \t")]
    docs = spark.createDataFrame([(i, t, None, None, 0, 0, 0) for i, t in rows], DOCS)
    empty = spark.createDataFrame([], LABELS)
    got = operator(docs, empty).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    labels = spark.createDataFrame([(1, 1, 0, ""), (2, 0, 1, ""), (None, 1, 1, ""), (3, None, None, ""), (4, 7, 7, ""), (4, 1, 0, ""), (4, 1, 0, "")], LABELS)
    assert len(operator(docs, labels).collect()) == 7
    assert operator(docs.limit(0), labels).count() == 0


def test_without_toxic_keeps_columns(spark):
    rows = [(i, ("you scum " if i % 3 == 0 else "good day ") + f"w{i % 7}", None, None, 0, 0, 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), "") for i in range(300)], LABELS)
    kept = without_toxic(docs, labels, Settings(rows=200, l1=1.0))
    assert kept.dtypes == docs.dtypes and {r.doc_id for r in kept.collect()} == {i for i in range(300) if i % 3}
    odd = [(None, "you scum you scum"), (None, "good day"), (7, None), (7, None), (8, ""), (9, "good " * 60000), (9, "you scum you scum")]
    more = docs.unionByName(spark.createDataFrame([(i, t, None, None, 0, 0, 0) for i, t in odd], DOCS).withColumn("y", F.lit(5)))
    kept = without_toxic(more, labels, Settings(rows=200, l1=1.0)).filter("y = 5").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([x for x in odd if "scum" not in (x[1] or "")], key=str)
    assert without_toxic(docs.limit(0), labels).count() == 0


def test_features_are_words_pairs_and_skips():
    x, at = features(["A b c", "", "a B", "x"], 18)
    assert list(np.diff(at)) == [6, 0, 3, 1]
    first, third = set(x[at[0] : at[1]].tolist()), set(x[at[2] : at[3]].tolist())
    assert third <= first


def test_statistics():
    s = statistics(["", "one two", "a\na\na", "x" * 50000])
    assert s.shape[0] == 4 and not s[0].any() and np.isfinite(s).all()
    assert (statistics(["one two"])[0] == s[1]).all()


def test_isotonic():
    x, y = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 2, 1, 3]), np.array([1.0, 2, 2, 3]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and len(x) == 3


def test_ftrl_equals_plain_loop(spark):
    """Weights against FTRL-proximal one coordinate at a time, over the sample in its order."""
    r = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(vocab, 12)) + (" you scum" if i % 4 == 0 else ""), None, None, 0, 0, 0) for i in range(120)]
    labels = [(i, 1, int(i % 4 == 0), "") for i in range(120)] + [(7, 1, 1, ""), (7, 1, 0, "")]
    s = Settings(bits=14, rows=60, epochs=3, l1=0.5)
    at, w, bias = toxicity_module.fit(spark.createDataFrame(rows + rows[:5], DOCS), spark.createDataFrame(labels, LABELS), s)
    known = spark.createDataFrame([(i,) for i in range(120) if zlib.crc32(str(i).encode()) % 5], "doc_id long")
    chosen = [x.doc_id for x in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(60).collect()]
    mixed = toxicity_module.arrays.mix(np.array(chosen, np.int64).view(np.uint64))
    chosen = [i for _, i in sorted(zip(mixed.tolist(), chosen))]
    sets = {i: set(features([rows[i][1]], s.bits)[0].tolist()) for i in chosen}
    held = {x: sum(x in f for f in sets.values()) for f in sets.values() for x in f}
    z, n = {}, {}

    def weight(x):
        if x != "bias" and abs(z.get(x, 0.0)) <= s.l1:
            return 0.0
        l1 = 0.0 if x == "bias" else s.l1
        zx = z.get(x, 0.0)
        return (np.sign(zx) * l1 - zx) / ((s.beta + np.sqrt(n.get(x, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for i in chosen:
            xs = [x for x in sets[i] if held[x] >= 2] + ["bias"]
            p = 1 / (1 + np.exp(-sum(weight(x) for x in xs)))
            y = int(i % 4 == 0)
            g = (p - y) * (s.positive if y else 1.0)
            old = {x: weight(x) for x in xs}
            for x in xs:
                before = n.get(x, 0.0)
                n[x] = before + g * g
                z[x] = z.get(x, 0.0) + g - (np.sqrt(n[x]) - np.sqrt(before)) / s.alpha * old[x]
    want = {x: weight(x) for x in z if x != "bias" and weight(x)}
    assert set(at.tolist()) == set(want) and len(want) > 5
    assert np.allclose([want[x] for x in at.tolist()], w) and np.isclose(bias, weight("bias"))


def test_sample_bytes_are_bounded(spark):
    rows = [(i, f"good w{i} " * 50, None, None, 0, 0, 0) for i in range(100)]
    labels = spark.createDataFrame([(i, 1, i % 2, "") for i in range(100)], LABELS)
    docs = spark.createDataFrame(rows, DOCS)
    none = toxicity_module.fit(docs, labels, Settings(bytes=0))
    assert len(none[0]) == 0 and none[2] == 0.0


def test_training_holds_its_sample_once():
    """Numpy's memory, besides the batches' own, is about a copy of the numbers used."""
    r, s = np.random.default_rng(1), Settings(bits=16, epochs=1)
    x = [np.unique(r.integers(0, 1 << s.bits, 20_000, np.int32)) for _ in range(400)]
    rows = pa.record_batch({"doc_id": pa.array(range(400), pa.int64()), "y": pa.array([i % 2 for i in range(400)], pa.int32()), "x": pa.array([v.tobytes() for v in x], pa.binary())})
    total = sum(v.nbytes for v in x)
    tracemalloc.start()
    whole = toxicity_module.learned(iter([rows]), s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > 20e6 and peak < 2 * total
    parts = toxicity_module.learned(iter([rows.slice(300), rows.slice(0, 0), rows.slice(0, 300)]), s)
    assert whole.num_rows > 100 and parts.equals(whole)


def test_equations_equal_plain_loop(spark):
    """Random Fourier features, their normal equations and ridge weights, row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    s = quality_module.Settings(features=8, ridge=0.01)
    stats = document_statistics(docs).cache()
    model = quality_module.fit(stats, labels, s)
    used = stats.join(labels, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(5))).collect()
    used = [r for r in used if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    x = np.array([r.x for r in used])
    mean, sd = x.mean(axis=0), x.std(axis=0)
    a, b = [[0.0] * 9 for _ in range(9)], [0.0] * 9
    for r in used:
        if r.part == 0:
            continue
        z = [min(8, max(-8, (v - m) / (d if d > 1e-9 else 1))) for v, m, d in zip(r.x, mean, sd)]
        f = [np.cos(sum(z[i] * model.omega[i][k] for i in range(len(STATS))) + model.phase[k]) * np.sqrt(2 / 8) for k in range(8)] + [1.0]
        for i in range(9):
            b[i] += f[i] * r.quality
            for j in range(9):
                a[i][j] += f[i] * f[j]
    rows = a[8][8]
    beta = np.linalg.solve(np.array(a) + s.ridge * max(1.0, rows) / 9 * np.eye(9), np.array(b))
    assert rows > 30 and np.allclose(beta, model.beta)
    assert (np.diff(model.values) >= 0).all()
