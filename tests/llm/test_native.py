"""Line dedup, chat formatting, URL filters and top-k search on small fixtures."""

import datetime
import random
from collections import Counter

from joinloom.llm.binary_search import masks, top_k
from joinloom.llm.chat import chat_format
from joinloom.llm.line_dedup import deduplicated, line_dedup
from joinloom.llm.url_filter import url_filter

DOCS = "doc_id long, text string, name long, m long, i int, n_chars long, n_lines int"


def brute_lines(docs, words):
    seqs = {d: [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")] for d, t in docs}
    count = lambda x: x.count(" ") + 1
    first = {}
    for d in sorted(seqs):
        s = seqs[d]
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                run = tuple(x for _, x in s[i:j])
                if sum(map(count, run)) >= words:
                    first.setdefault(run, (d, i))
    out = {}
    for d, t in docs:
        s, gone = seqs[d], set()
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                run = tuple(x for _, x in s[i:j])
                if run in first and first[run] != (d, i):
                    gone.update(k for k, _ in s[i:j])
        out[d] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out


def test_line_dedup_brute_force(spark):
    r = random.Random(11)
    lines = [" ".join(f"w{k}" for _ in range(n)) for k, n in enumerate([1, 1, 2, 3, 4, 5, 6, 9, 12])] + ["", "  "]
    docs = []
    for d in range(60):
        t = [r.choice(lines) if r.random() < 0.7 else f"own {d} {r.random()}" for _ in range(r.randint(0, 12))]
        docs.append((d, "\n".join(t)))
    docs += [(100 + k, docs[k][1]) for k in range(5)]
    df = spark.createDataFrame([(d, t, 0, 0, 0, 0, 0) for d, t in docs], DOCS)
    got = {x.doc_id: x.new_text for x in line_dedup(df, 10).collect()}
    assert got == brute_lines(docs, 10)


def test_line_dedup_edges(spark):
    p = " ".join(f"p{i}" for i in range(60))
    long = "\n".join(f"line {i} " + "z " * 10 for i in range(3000))
    rows = [(1, None), (2, ""), (3, "\n"), (None, p), (None, p), (4, p), (4, p), (5, f"{p}\nown"), (6, f"  {p}  "), (7, "a\n\n b"), (8, long), (9, long + "\ntail")]
    df = spark.createDataFrame([(d, t, 0, 0, 0, 0, 0) for d, t in rows], DOCS)
    got = Counter((x.doc_id, x.new_text) for x in line_dedup(df).collect())
    assert got == Counter([(1, None), (2, ""), (3, "\n"), (None, p), (None, p), (4, p), (4, p), (5, "own"), (6, ""), (7, "a\n\n b"), (8, long), (9, "tail")])
    kept = deduplicated(df)
    assert kept.columns == df.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter([1, 2, 3, None, None, 4, 4, 5, 7, 8, 9])
    assert line_dedup(df.limit(0)).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, pos int, a long"
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "more"), (None, None)]
    rows = [(c, t, *talk[t], 0, 0) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (None, 3)) for t in range(n)]
    rows += [(9, 0, "user", "hi", 0, 0), (9, 0, "user", "hi", 0, 0), (10, None, "user", "late", 0, 0)]
    chats = chat_format(spark.createDataFrame(rows, schema)).collect()
    got = {r.conv_id: r for r in chats if r.conv_id is not None}
    assert set(got) == {2, 9, 10}
    assert got[2].chat == "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nmore\n<|unknown|>\n\n" and got[2].n_turns == 4
    assert got[9].n_turns == 2
    # Turns without a conversation: the first begins others, the rest stay, each once.
    assert sorted((r.chat, r.n_turns) for r in chats if r.conv_id is None) == [("<|assistant|>\nhello\n", 1), ("<|user|>\nmore\n", 1)]
    assert chat_format(spark.createDataFrame([], schema)).count() == 0
    alone = chat_format(spark.createDataFrame([(None, 1, "user", "x", 0, 0)] * 3, schema)).collect()
    assert [tuple(r) for r in alone] == [(None, 1, "<|user|>\nx\n")]
    long = "word " * 200_000
    many = chat_format(spark.createDataFrame([(1, k, "user", long if k == 2 else f"t{k}", 0, 0) for k in range(3000)], schema)).collect()
    assert [(r.conv_id, r.n_turns) for r in many] == [(1, 3000)] and long in many[0].chat


def test_url_filter(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    entries = [
        (1, "d:bad.org", "block", day(10)), (2, "d:bad.org", "remove", day(20)), (3, "d:bad.org", "block", day(40)),
        (4, "p:ok.org/x/", "block", day(5)), (5, "p:ok.org/x/y/", "allow", day(5)), (6, "u:ok.org/x/y/z?q=1", "block", day(7)),
        (7, "d:tie.org", "block", day(3)), (8, "d:tie.org", "allow", day(3)), (9, None, "block", day(0)), (10, "d:n.org", "block", None), (11, "d:odd.org", None, day(1)),
    ]
    urls = ["http://A.BAD.org./p", "https://ok.org/x/1", "https://u:p@ok.org:8080/x/y/1#f", "http://ok.org/x/y/z?q=1#t", "http://tie.org", "mailto:x", "", None, "http://n.org/", "http://odd.org/", "http://notbad.org/"]
    rows = [(i, u, day(n), False, "") for i, u in enumerate(urls) for n in (0, 9, 10, 19, 20, 39, 40, 300)] + [(50, urls[0], None, None, None), (0, urls[0], day(10), None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched date, blocked boolean, key string")
    got = url_filter(df, spark.createDataFrame(entries, "entry_id long, key string, action string, dated date")).collect()
    assert len(got) == len(rows)
    at = {(r.page_id, (r.fetched - day(0)).days): (r.blocked, r.matched_key) for r in got if r.fetched}
    assert [at[0, n][0] for n in (0, 9, 10, 19, 20, 39, 40, 300)] == [False, False, True, True, False, False, True, True]
    assert at[1, 9] == (True, "p:ok.org/x/") and at[2, 9] == (False, "p:ok.org/x/y/") and at[3, 9] == (True, "u:ok.org/x/y/z?q=1")
    assert at[4, 9] == (False, "d:tie.org")
    assert not any(b for (i, _), (b, _) in at.items() if i > 4)
    none = spark.createDataFrame([], "entry_id long, key string, action string, dated date")
    assert not any(r.blocked for r in url_filter(df, none).collect())
    assert url_filter(df.limit(0), none).count() == 0
    long = ["http://bad.org/" + "p/" * 300_000, "http://" + "a." * 300_000 + "bad.org/x", "http://other.org/" + "p/" * 300_000]
    some = spark.createDataFrame([(i, u, day(12), False, "") for i, u in enumerate(long)], "page_id long, url string, fetched date, blocked boolean, key string")
    listed = spark.createDataFrame(entries, "entry_id long, key string, action string, dated date")
    assert {r.page_id: r.blocked for r in url_filter(some, listed).collect()} == {0: True, 1: True, 2: False}
    deep = spark.createDataFrame([(1, "p:other.org/" + "p/" * 40, "block", day(0))], "entry_id long, key string, action string, dated date")
    assert {r.page_id: r.blocked for r in url_filter(some, deep).collect()} == {0: False, 1: False, 2: True}


def test_top_k(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(32)], 0, 0) for i in range(300)] + [(1000 + i, [1.0] * 32, 0, 0) for i in range(60)]
    rows += [(2000, None, 0, 0), (None, [1.0] * 32, 0, 0), (2001, [], 0, 0), (2002, [None, float("nan"), 1.0], 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, distance int")
    bits = {i: [int(j < len(v) and v[j] is not None and v[j] > 0) for j in range(32)] for i, v, _, _ in rows if i is not None and v is not None}
    ask = [0, 50, 1000, 1059, 2001, 2002]
    want = []
    for q in ask:
        near = sorted((sum(a != b for a, b in zip(bits[q], c)), i) for i, c in bits.items() if i != q)[:5]
        want += [(q, k, i, d) for k, (d, i) in enumerate(near, 1)]
    got = top_k(df, df.filter(df.vec_id.isin(ask)), 5).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    few = df.filter("vec_id IN (0, 1, 2)")
    assert top_k(few, few, 5).count() == 6
    assert top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_top_k_repeated_rows(spark):
    near, far = [1.0] * 16, [1.0] * 12 + [-1.0] * 4
    rows = [(1, near)] * 12 + [(2, near)] * 3 + [(i, near) for i in (3, 4)] + [(5, far), (6, far), (6, near)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, df.filter("vec_id IN (1, 5)"), 3).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 0), (1, 2, 3, 0), (1, 3, 4, 0), (5, 1, 6, 0), (5, 2, 1, 4), (5, 3, 2, 4)]


def test_top_k_wide_and_masks(spark):
    """Codes of an odd width, told apart only by their last numbers; all masks of a radius."""
    r = random.Random(5)
    rows = [(i, [1.0] * 60 + [r.choice([-1.0, 1.0]) for _ in range(37)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for q in (0, 50):
        near = sorted((sum((a > 0) != (b > 0) for a, b in zip(rows[q][1], v)), i) for i, v in rows if i != q)[:7]
        want += [(q, k, i, d) for k, (d, i) in enumerate(near, 1)]
    assert sorted(map(tuple, top_k(df, df.filter("vec_id % 50 = 0"), 7).collect())) == want
    cut = top_k(df, df.filter("vec_id = 0"), 3, bits=60).collect()
    assert sorted(map(tuple, cut)) == [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 3, 0)]
    for radius in (0, 1, 3, 7):
        got = spark.range(1).select(masks(7, radius).alias("m")).first().m
        assert sorted(got) == [x for x in range(128) if x.bit_count() == radius]
