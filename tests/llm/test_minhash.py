import random
import re

import pytest

from joinloom.llm import minhash
from joinloom.llm.minhash import near_duplicates, without_near_duplicates

SCHEMA = "doc_id long, text string, v long, node long, hub long, m long, comp long, n_shingles long"


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs, n, percent=80):
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, bases=12, copies=9, words=60):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    shared = [" ".join(r.choice(vocab) for _ in range(25)) for _ in range(2)]
    out = []
    for _ in range(bases):
        w = [r.choice(vocab) for _ in range(r.choice([3, 5, 30, words, 4 * words]))]
        for _ in range(r.randint(1, copies)):
            v = list(w)
            for _ in range(r.choice([0, 0, 1, 2, 3, len(v) // 12])):
                v[r.randrange(len(v))] = r.choice(vocab).upper()
            text = " ".join(v)
            out.append(f"{text}\n{r.choice(shared)}" if r.random() < 0.3 else text)
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "n"), [(1, 4), (2, 5), (3, 4)])
def test_equals_brute_force(spark, seed, n):
    docs = corpus(seed) + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "ONE  two"), (1005, "é ß"), (1006, "É ß")]
    df = spark.createDataFrame([(i, t, 0, 0, 0, 0, 0, 0) for i, t in docs], SCHEMA)
    got = {r.doc_id: r for r in near_duplicates(df, shingle=n).collect()}
    want = brute(docs, n)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_chain_needs_later_rounds(spark, monkeypatch):
    """Links that no hub of the first round shows."""
    r = random.Random(5)
    base = [f"c{k}" for k in range(100)]
    docs = []
    for i in range(40):
        docs.append((i, " ".join(base)))
        for k in r.sample(range(100), 3):
            base[k] = f"n{i}_{k}"
    df = spark.createDataFrame([(i, t, 0, 0, 0, 0, 0, 0) for i, t in docs], SCHEMA)
    got = {x.doc_id: x.component_id for x in near_duplicates(df, shingle=1).collect()}
    assert got == {i: c for i, (_, c) in brute(docs, 1).items()}


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"k{i}" for i in range(30))
    rows = [(None, text), (7, text), (7, text), (9, text), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame([(i, t, 0, 0, 0, 0, 0, 0) for i, t in rows], SCHEMA)).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (9, 7, False)], key=str)





@pytest.mark.parametrize("seed", [3, 8])
def test_large_group_with_pooled_edits(spark, seed):
    """Copies of one text by changes of a pool, many of them just under 0.8 to it and to
    each other, texts that are parts of it, and a passage that others share with it."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(120)]
    pool = [(r.randrange(120), f"e{k}") for k in range(40)]
    docs = []
    for _ in range(220):
        w = list(base)
        for k, new in r.sample(pool, r.randint(0, 6)):
            w[k] = new
        for _ in range(r.randint(0, 3)):
            w[r.randrange(120)] = f"own{r.random()}"
        if r.random() < 0.2:
            w = w[r.randint(0, 30) : r.randint(90, 120)]
        docs.append(" ".join(w))
    docs += [" ".join(base[20:60] + [f"x{i}_{k}" for k in range(r.randint(10, 60))]) for i in range(40)]
    r.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame([(i, t, 0, 0, 0, 0, 0, 0) for i, t in docs], SCHEMA)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(df, shingle=4).collect()}
    want = brute(docs, 4)
    assert got == want
    sizes = sorted(list(map(lambda c: c[1], want.values())).count(x) for x in {c for _, c in want.values()})
    assert sizes[-1] > 60 and sizes.count(1) > 40


def test_exact_step_alone(spark, monkeypatch):
    """With no pair let through by the estimate, the prefixes find every link."""
    monkeypatch.setattr(minhash, "MARGIN", -1.0)
    docs = corpus(9)
    df = spark.createDataFrame([(i, t, 0, 0, 0, 0, 0, 0) for i, t in docs], SCHEMA)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(df, shingle=4).collect()}
    assert got == brute(docs, 4)


def test_without_near_duplicates(spark):
    text = " ".join(f"k{i}" for i in range(30))
    rows = [(None, text), (7, text), (7, text), (9, text), (None, None), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, 5, 0, 0, 0, 0, 0) for i, t in rows], SCHEMA)
    kept = without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 7, 7, None, None]
    assert without_near_duplicates(df.limit(0)).count() == 0
