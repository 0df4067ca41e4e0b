import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from joinloom.llm import bpe
from joinloom.llm.packing import Mixture, pack
from joinloom.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, queue int, bucket int, n long, ids binary"
PARTS = ["a", " ", "  ", "\n", "'", "'s", "'ll", "é", "1", "²", "...", "\t", "日本", "　", "😀", "é", "<|endoftext|>", "\x1c", "\r\n", "the", "aaaa", "'S", "ß", "\x85", "٣"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def samples(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", "<|endoftext|>", "x" * 5000, "ab " * 4000]


def test_same_ids_as_library(library):
    texts = samples(3000)
    vocab = bpe.load(PATH)
    ids, at = vocab.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert vocab.count(texts).tolist() == [len(w) for w in want]
    again, _ = vocab.encode(texts)  # now all known
    assert (again == ids).all()


def rows(texts):
    return [(i, t, None, f"s{i % 3}" if i % 7 else None, 0, 0, 0, 0, 0, b"") for i, t in enumerate(texts)]


def test_counts(spark, library):
    texts = [None, "", *samples(200), "word " * 30000]
    got = {r.doc_id: r for r in token_counts(spark.createDataFrame([*rows(texts), (None, "x", None, None, 0, 0, 0, 0, 0, b"")], SCHEMA), PATH).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert got[None].n_tokens == 1
    assert token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("bucket", [1 << 20, 700])
def test_packing_is_whole(spark, library, bucket):
    texts = [None, "", *samples(150), "long words here " * 3000]
    data = rows(texts)
    got = pack(spark.createDataFrame(data, SCHEMA), PATH, size=256, bucket=bucket).collect()
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    seen, spans = {i: [] for i in want}, {}
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id]) and r.length > 0
        seen[r.doc_id].append((r.start, r.length))
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in seen.items():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at == len(want[i])
    total = sum(map(len, want.values()))
    assert sorted(spans) == list(range(-(-total // 256)))
    for w, pieces in spans.items():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at == 256 or w == max(spans)


def test_packing_edges(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    twice = [(1, "same text", None, "a", 0, 0, 0, 0, 0, b"")] * 2 + [(None, "no id", None, None, 0, 0, 0, 0, 0, b"")]
    got = pack(spark.createDataFrame(twice, SCHEMA), PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and len(got) >= 3


@pytest.mark.parametrize("totals", [(5,), (4000, 3, 900), tuple(range(20, 140)), (10**13, 3 * 10**13, 7 * 10**12 + 1)])
def test_mixture_carries_deficits(totals):
    m = Mixture(totals, 2048)
    last = -(-m.total // 2048)
    w = np.unique(np.concatenate([np.arange(min(last, 300) + 1), [last - 1, last]]))
    taken = m.taken(w)
    due = np.minimum(w.astype(object) * 2048, m.total)
    assert (taken.sum(axis=1) == due).all()
    assert tuple(taken[-1]) == totals
    exact = due[:, None] * np.array(totals, object) / m.total
    assert (abs(exact - taken) < 1 + 1e-6).all()
    if min(totals) * 2048 >= m.total:
        assert (np.diff(taken, axis=0) >= 0).all()


def test_many_small_sources_keep_their_shares(spark):
    schema = "doc_id long, text string, source string"
    data = [(i, f"word {i} " * 60, f"s{i % 40:02}") for i in range(80)] + [(1000 + i, "other text here " * 20, "tiny") for i in range(2)]
    got = pack(spark.createDataFrame(data, schema), PATH, size=256, bucket=900).collect()
    total, sums, held, spans, docs = sum(r.length for r in got), {}, {}, {}, {}
    for r in got:
        sums[r.source] = sums.get(r.source, 0) + r.length
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        held[r.sequence_id, r.source] = held.get((r.sequence_id, r.source), 0) + r.length
    for pieces, want in [*((x, n) for (_, n), x in docs.items()), *((x, min(256, total - 256 * w)) for w, x in spans.items())]:
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at == want
    assert len(docs) == 82
    for source, n in sums.items():
        given = 0
        for w in sorted(spans):
            given += held.get((w, source), 0)
            assert abs(given - n * min(256 * (w + 1), total) / total) <= 40, (source, w)


@pytest.mark.parametrize("weights", [None, (1, 1, 1, 1), (5, 1, 3, 2), (1, 7, 1, 1)])
def test_mixture_equals_queue_walk(weights):
    """The closed form against deficit round-robin, queue by queue and window by window."""
    totals, size = (9000, 2500, 700, 5200), 256
    share = [Fraction(x) for x in weights or totals]
    m = Mixture(totals, size, tuple(share))
    given, deficit, held, want = [0] * 4, [Fraction(0)] * 4, [Fraction(n) for n in totals], [[0] * 4]
    while sum(given) < sum(totals):
        window = min(size, sum(totals) - sum(given))
        while window > 0:  # what queues are due; those that run dry leave the rest to the others
            live = [s for s in range(4) if held[s] > 0]
            of = sum(share[s] for s in live)
            part = min([Fraction(window), *(held[s] * of / share[s] for s in live)])
            for s in live:
                deficit[s] += part * share[s] / of
                held[s] -= part * share[s] / of
            window -= part
        left = min(size, sum(totals) - sum(given))
        for s in range(4):
            whole = int(deficit[s])
            given[s], deficit[s], left = given[s] + whole, deficit[s] - whole, left - whole
        for s in sorted(range(4), key=lambda s: -deficit[s])[:left]:
            given[s], deficit[s] = given[s] + 1, deficit[s] - 1
        want.append(list(given))
    assert m.taken(np.arange(len(want))).tolist() == want
    for queue in range(4):
        at = [x[queue] for x in want]
        for begin, end in ((0, totals[queue]), (13, 14), (totals[queue] // 2, totals[queue])):
            w, start, _ = m.windows(queue, begin, end)
            need = [k for k in range(len(at) - 1) if at[k] < end and at[k + 1] > begin]
            assert set(need) <= set(w.tolist()) and len(w) <= len(need) + 6 + sum(a == b for a, b in zip(at, at[1:]))
            assert [at[k] for k in w] == start.tolist()


def test_target_weights(spark, library):
    r = random.Random(4)
    data = [(k if k % 7 else None, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(40)), "abc"[k % 3]) for k in range(400)] + [(3, "same text", "a")] * 30
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = pack(df, PATH, size=256, bucket=900, weights={"a": 0.6, "b": 0.3, "c": 0.1}).collect()
    assert sum(x.length for x in got) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in data)
    held = defaultdict(Counter)
    for x in got:
        held[x.sequence_id][x.source] += x.length
    full = [c for _, c in sorted(held.items())][:-1]
    assert all(sum(c.values()) == 256 for c in full)
    first = sum(full[:10], Counter())
    assert abs(first["a"] - 0.6 * 2560) <= 1 and abs(first["b"] - 0.3 * 2560) <= 1 and abs(first["c"] - 0.1 * 2560) <= 1
    assert set(full[-1]) == {"c"}  # the others ran dry
    with pytest.raises(ValueError):
        pack(df, PATH, weights={"a": 0})
