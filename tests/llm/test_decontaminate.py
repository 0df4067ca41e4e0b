import random

from joinloom.llm.decontaminate import Settings, decontaminate, without_contaminated

DOCS = "doc_id long, text string, item_ids array<long>, coverage double, n int"
ITEMS = "item_id long, text string, doc_id long"


def search(spark, docs, items, s=Settings()):
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontaminate(d, b, s).collect()}
    kept = [r.doc_id for r in without_contaminated(d, b, s).collect()]
    assert sorted(kept, key=str) == sorted((i for i, _ in docs if not got[i][0]), key=str)
    return {i: x[1] for i, x in got.items()}


ITEM = "On day 3 the farmer Anna sold 12 kg of apples for 30 dollars to her friend Tom, and then Anna bought 12 more."


def test_reparameterised(spark):
    docs = [
        (1, f"Some words before. {ITEM} And words after."),
        (2, ITEM.lower()),
        (3, "x " + ITEM.replace("Anna", "Greta").replace("12", "17").replace("30", "45.50").replace("kg", "lbs") + " y"),
        (4, ITEM.replace("12 kg", "17 kg").replace("3", "8")),  # 12 is 17 at one place and 12 at the other
        (5, "the farmer sold apples to a friend and bought more of them on another day"),
        (6, None), (7, ""), (8, "one"),
    ]
    got = search(spark, docs, [(9, ITEM), (None, "x y z"), (11, None), (12, "too short")])
    assert got[1] == got[2] == got[3] == [9]
    assert got[5] == got[6] == got[7] == got[8] == []


def test_inconsistent_slots(spark):
    item = "take 5 then add 7 then take 5 then add 7 then take 5 then add 7 then take 5 then add 7 then stop here"
    same, other = item.replace("5", "2").replace("7", "4"), "take 2 then add 4 then take 3 then add 5 then take 6 then add 8 then take 1 then add 9 then stop here"
    got = search(spark, [(1, f"so {same} now"), (2, f"so {other} now")], [(1, item)])
    assert got == {1: [1], 2: []}


def test_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in "btk" for b in "aeo" for c in "lnr"]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, words(r.choice([4, 6, 9, 20, 40]))) for i in range(30)]
    docs = []
    for d in range(150):
        w = words(r.randint(0, 80))
        for _ in range(r.choice([0, 0, 1, 2])):
            _, x = r.choice(items)
            a = r.randint(0, len(x) // 2)
            at = r.randint(0, len(w))
            w[at:at] = x[a : a + r.randint(len(x) // 3, len(x))]
        docs.append((d, w))

    def brute(w):
        found = []
        for i, x in items:
            n = min(8, len(x))
            if len(x) < 5:
                continue
            mark = set()
            for p in range(len(w) - n + 1):
                for a in range(len(x) - n + 1):
                    if w[p : p + n] == x[a : a + n]:
                        mark.update(range(a, a + n))
            if len(mark) >= 0.5 * len(x):
                found.append(i)
        return found

    got = search(spark, [(d, " ".join(w)) for d, w in docs], [(i, " ".join(x)) for i, x in items])
    assert got == {d: brute(w) for d, w in docs}
    assert search(spark, [(d, " ".join(w)) for d, w in docs[:40]], [(i, " ".join(x)) for i, x in items], Settings(block=60)) == {d: brute(w) for d, w in docs[:40]}


def test_edges(spark):
    assert search(spark, [], [(1, ITEM)]) == {}
    assert search(spark, [(1, ITEM), (None, ITEM)], []) == {1: [], None: []}
    assert search(spark, [(1, ITEM), (1, ITEM), (None, "z")], [(4, ITEM), (3, ITEM)]) == {1: [3, 4], None: []}
    assert search(spark, [(1, "pad " * 40000 + ITEM)], [(4, ITEM)]) == {1: [4]}
    rows = [(None, ITEM), (None, None), (1, "z"), (1, "z"), (1, ITEM), (2, "")]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, item_id long, coverage string")
    bench = spark.createDataFrame([(4, ITEM, 0.0), (None, "z", 0.0), (5, None, 0.0)], "item_id long, text string, coverage double")
    kept = without_contaminated(docs, bench, Settings(short=True))
    assert kept.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([x for x in rows if x[1] != ITEM], key=str)
    assert without_contaminated(docs, bench.limit(0)).count() == 6 and without_contaminated(docs.limit(0), bench).count() == 0


def test_names_that_open_sentences(spark):
    item = "Tom has 5 apples. Tom buys 3 more apples. Tom gives 2 to Ann."
    copy = "Sam has 8 apples. Sam buys 4 more apples. Sam gives 1 to Eve."
    docs = [(1, copy), (2, f"so it was: {copy.lower()} and so on"), (3, copy.upper()), (4, "Sam has 8 pears. Max buys 4 more pears. Liz gives 1 to Eve.")]
    got = search(spark, docs, [(1, item)])
    assert got == {1: [1], 2: [1], 3: [1], 4: []}


def test_lengths_that_shift(spark):
    item = "On Monday Tom packs 12 kg of ripe apples, walks to the old market and sells 7 of the bags there; then Tom buys 30 m of rope and carries it back home."
    docs = [
        (1, item.replace("Tom", "Mary Ann").replace("12 kg", "15").replace("30 m", "44").replace("7", "9").replace("the old", "the very old").replace("it back", "it straight back")),
        (2, item.replace("12", "15").replace("30", "44").replace("7", "9").replace("walks", "slowly walks").replace("old", "old big").replace("sells", "now sells").replace("the bags", "the many bags").replace("carries", "also carries")),
        (3, "Tom has 8 apples. Tom buys 4 more apples. Tom gives 1 to Sue Lee."),
        (4, "take 2 then add 4 then take 3 then add 5 then take 6 then add 8 then take 1 then add 9 then stop here"),
    ]
    names = "Mary Ann has 5 apples. Mary Ann buys 3 more apples. Mary Ann gives 2 to Ann."
    periods = "take 5 then add 7 then take 5 then add 7 then take 5 then add 7 then take 5 then add 7 then stop here"
    assert search(spark, docs, [(1, item), (2, names), (3, periods)]) == {1: [1], 2: [1], 3: [2], 4: []}


def test_windows_of_mostly_placeholders(spark):
    items = [(1, "Compute 12 + 7 * 3 - 5 / 2"), (2, "Buy 3 kg, 5 lb, 7 oz, 2 kg, 9 lb, 11 oz, 6 kg, 4 lb, 8 oz and 10 kg."), (3, "| Tom | 12 | 5 | 31 | 44 |\n| Ann | 13 | 6 | 32 | 45 |"), (4, "3, 5, 7, 9, 11, 13, 15, 17")]
    items += [(5, "THE OLD MAN SOLD 12 BAGS OF FLOUR AND 30 BAGS OF RICE TODAY"), (6, "Tom, Ann and Bob met Sue, Max and Joe, then Tom left")]
    docs = [
        (1, "so: compute 31+4*9-6/8 now"), (2, "so: compute 31 - 4 * 9 + 6 / 8 now"),
        (3, "Buy 13 kg, 15 lb, 17 oz, 12 kg, 19 lb, 21 oz, 16 kg, 14 lb, 18 oz and 20 kg."),
        (4, "| Sam | 1 | 2 | 3 | 4 |\n| Eve | 5 | 6 | 7 | 8 |"), (5, "see 1, 2, 3, 4, 5, 6, 8, 9, 10 there"), (6, "3, 5, 7, 9, 11, 13, 15, 17"),
        (7, "13 kg, 15 lb, 17 oz, 12 kg, 19 lb, 21 oz, 16 kg, 14 lb, 18 oz, 20 kg"),
        (8, "THE OLD MAN SOLD 14 BAGS OF FLOUR AND 35 BAGS OF RICE TODAY"), (9, "one two three four 5 six seven eight nine 10 eleven twelve thirteen and more words of it"),
        (10, "Kim, Eve and Zoe met Lou, Ned and Pat, then Kim left"),
    ]
    assert search(spark, docs, items) == {1: [1], 2: [], 3: [2], 4: [3], 5: [], 6: [4], 7: [], 8: [5], 9: [], 10: [6]}


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "小明有5个苹果。他又买了3个苹果，然后给了小红2个。"
    items = [(1, "12 * 7 = ?"), (2, "Capital of France?"), (3, chinese), (4, "ราคาแอปเปิ้ลวันนี้"), (5, "谁是他"), (6, "?")]
    docs = [
        (1, "say 12*7 = 84"), (2, "say 12, 7"), (3, "the capital of France is"), (4, "前面的话" + chinese + "后面的话"), (5, chinese.replace("5", "8").replace("3", "4").replace("2", "1")),
        (6, "ดูราคาแอปเปิ้ลวันนี้สิ"), (7, "请问谁是他呢"), (8, "他是谁?"), (9, "capital France"),
    ]
    assert search(spark, docs, items, Settings(short=True)) == {1: [1], 2: [], 3: [2], 4: [3], 5: [3], 6: [4], 7: [5], 8: [], 9: []}
    assert search(spark, docs, items) == {1: [], 2: [], 3: [], 4: [3], 5: [3], 6: [4], 7: [], 8: [], 9: []}


def test_many_items_under_one_header():
    """Texts that hold only the header of very many items meet none of them, in time that
    follows texts and items, and those that hold an item are found."""
    import time

    from joinloom.llm.decontaminate import Index

    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    header = text(13)
    items = [(i, f"{header} {text(80)}") for i in range(2000)]
    short = [(5000 + i, f"{header} {text(3)}") for i in range(30)]  # the header alone is most of these
    texts = [f"{text(30)} {header} {text(40)}" for _ in range(200)] + [f"{text(5)} {items[k][1]} {text(4)}" for k in (7, 1999)]
    began = time.perf_counter()
    got = Index(items, Settings()).search(texts)
    assert time.perf_counter() - began < 30
    assert got[:200] == [{}] * 200 and [set(x) for x in got[200:]] == [{7}, {1999}]
    got = Index(items + short, Settings()).search(texts)
    assert all(set(x) == {i for i, _ in short} for x in got[:200])
    assert got[200].keys() - {i for i, _ in short} == {7}


def brute_templates(text, item, window=8, covered=0.5):
    """Plain loops, for words in lower case and numbers: windows with equal templates,
    dealt on each diagonal to the first group that their slots agree with."""
    t, w = text.split(), item.split()
    n = min(window, len(w))
    num = str.isdigit
    same = lambda x, y: x == y or (num(x) and num(y))
    one_to_one = lambda pairs: len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
    verbatim, groups = set(), {}
    for p in range(len(t) - n + 1):
        for a in range(len(w) - n + 1):
            pair = list(zip(w[a : a + n], t[p : p + n]))
            if not all(same(x, y) for x, y in pair):
                continue
            if all(x == y for x, y in pair):
                verbatim.update(range(a, a + n))
            slots = {(x, y) for x, y in pair if num(x)}
            if one_to_one(slots):
                of = groups.setdefault(p - a, [])
                group = next((g for g in of if one_to_one(g[0] | slots)), None)
                if group is None:
                    of.append(group := [set(), set(), False])
                group[0].update(slots)
                group[1].update(range(a, a + n))
                group[2] |= not all(num(x) for x, _ in pair)  # bare numbers alone tell nothing
    best = max([len(verbatim), *(len(verbatim | g[1]) for of in groups.values() for g in of if g[2])])
    return best >= covered * len(w)


def test_templates_equal_brute_force():
    from joinloom.llm.decontaminate import Index

    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
    token = lambda: str(r.randint(2, 9)) if r.random() < 0.25 else r.choice(vocab)
    items = [" ".join(token() for _ in range(r.randint(5, 30))) for _ in range(60)]
    texts = []
    for k in range(300):
        w = r.choice(items).split()
        new = dict(zip("23456789", r.sample(range(100, 999), 8)))
        w = [str(new[x] if k % 3 else r.choice([new[x], r.randint(10, 99)])) if x in new else x for x in w]
        a, b = (0, len(w)) if k % 2 else (r.randint(0, len(w) // 2), r.randint(len(w) // 2, len(w)))
        texts.append(" ".join([token() for _ in range(9)] + w[a:b] + [token() for _ in range(9)]))
    got = Index(list(enumerate(items)), Settings()).search(texts)
    want = [{i for i, x in enumerate(items) if brute_templates(t, x)} for t in texts]
    assert [set(x) for x in got] == want and 100 < sum(map(len, want)) < 295
