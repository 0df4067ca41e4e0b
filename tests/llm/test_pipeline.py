"""Every stage on its own input against a brute-force version, over planted cases."""

import random
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from test_minhash import brute
from test_native import brute_lines
from tokenizers import Tokenizer

import corpus_pipeline


def planted(seed=4):
    r = random.Random(seed)
    vocab = [f"{a}{b}{c}{d}" for a in "bdkt" for b in "aeo" for c in "lmnr" for d in "aiu"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [text(r.randint(15, 40)) for _ in range(5)]
    passages = [text(60) for _ in range(3)]
    docs, toxic, leaks = [], set(), set()
    for i in range(240):
        lines = [text(r.randint(5, 40)) for _ in range(r.randint(1, 5))]
        if i % 6 == 1:
            lines[0] += " you scum and " + text(3) + " you idiot scum"
            toxic.add(i)
        if i % 10 == 2:
            lines.append(r.choice(passages))
        if i % 15 == 3 and i % 8 != 4:
            lines[-1] += " " + r.choice(items)
            leaks.add(i)
        if i % 8 == 4:
            lines = [text(120)]
        docs.append("\n".join(lines))
    for i in range(4, 240, 16):  # near copies, and exact ones
        w = docs[i].split(" ")
        w[3], w[70] = "other", "word"
        docs.append(" ".join(w))
        docs.append(docs[i])
    return docs, toxic, leaks, items


def test_stages(spark, tmp_path):
    texts, toxic, leaks, items = planted()
    n = len(texts)
    pq.write_table(pa.table({"doc_id": range(n), "text": texts, "lang": ["en"] * n, "source": [f"s{i % 4}" for i in range(n)], "n_chars": [len(t) for t in texts]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": range(240), "quality": pa.array([1] * 240, pa.int32()), "toxic": pa.array([int(i in toxic) for i in range(240)], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": range(5), "text": items}), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    given = {i: t for i, t in enumerate(texts)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        rows = docs.collect()
        got = {r.doc_id: r.text for r in rows}
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in rows)
        if name == "toxicity":
            want = {i: t for i, t in given.items() if i not in toxic}
        elif name == "line_dedup":
            want = {i: t for i, t in brute_lines(list(given.items()), 50).items() if t.strip()}
        elif name == "minhash_near_dedup":
            want = {i: given[i] for i, (_, c) in brute(list(given.items()), 5).items() if i == c}
        else:
            want = {i: t for i, t in given.items() if not any(x in t for x in items)}
        assert got == want, name
        given = got
    assert not toxic & set(given) and not leaks & set(given) and len(given) > 100
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    held = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect():
        held[r.doc_id] += r.length
    assert held == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in given.items()}
