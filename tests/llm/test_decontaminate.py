import random
import re
from collections import Counter

import numpy as np

from sunplane.llm.decontaminate import RADIUS, build_index, drop_leaks, find_leaks, op1_benchmark_decontamination, simhash, window_prints, window_starts


def words(text):
    return re.findall("[0-9A-Za-z\x80-\U0010ffff]+", (text or "").lower())


def bag(ws, width):
    return Counter(tuple(ws[k : k + width]) for k in range(len(ws) - width + 1))


def brute(texts, items):
    """(doc, item) -> best similarity over all item-sized windows, where it is at least 0.8."""
    out = {}
    for d, text in texts.items():
        ws = words(text)
        for i, item in items.items():
            it = words(item)
            if not it:
                continue
            width = min(5, len(it))
            want, best = bag(it, width), 0.0
            for s in range(max(1, len(ws) - len(it) + 1)):
                have = bag(ws[s : s + len(it)], width)
                if have:
                    best = max(best, sum((have & want).values()) / sum((have | want).values()))
            if best >= 0.8:
                out[d, i] = best
    return out


def found(df):
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def made():
    rng = random.Random(8)
    text = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    items = {k: " ".join(text(rng.randrange(5, 60))) for k in range(20)}
    items |= {30: "tiny words", 31: "", 32: None, 33: items[3], 34: "a a a a a a a a a b a a a a a a a"}
    docs = []
    for k in range(40):
        leak = words(items[k % 20])
        for _ in range(rng.randrange(0, 3) if len(leak) > 30 else 0):
            leak[rng.choice([0, -1, rng.randrange(len(leak))])] = "edit"
        docs.append(" ".join(text(rng.randrange(0, 80))) + "\n" + "*** ".join(leak).title() + ". " + " ".join(text(rng.randrange(0, 80))))
    docs += [" ".join(text(200)) for _ in range(20)] + [None, "", "Tiny, WORDS", "a " * 30, items[5][: len(items[5]) * 9 // 10], " ".join(text(6_000)) + " " + items[7]]
    return docs, items


def test_against_brute_force(spark, docs):
    texts, items = made()
    got = found(find_leaks(docs(texts), spark.createDataFrame(list(items.items()), "item_id long, text string")))
    same(got, brute(dict(enumerate(texts, 1)), items))


def test_query_against_brute_force(spark, sample_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sample_dir}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sample_dir}/benchmark.parquet").collect()}
    keys = {k for i in items.values() for k in bag(words(i), 5)}
    texts = {k: t for k, t in texts.items() if bag(words(t), 5).keys() & keys}  # others can't be similar
    same(found(op1_benchmark_decontamination(spark, sample_dir)), brute(texts, items))


def test_index_returns_all_within_the_radius():
    rng = random.Random(1)
    index = build_index([" ".join(f"q{rng.randrange(999)}" for _ in range(40)) for _ in range(500)])[0]
    for _ in range(50):
        mark = int(index.prints[0, rng.randrange(500)])
        for _ in range(rng.randrange(0, 24)):
            mark ^= 1 << rng.randrange(64)
        want = [k for k, p in enumerate(index.prints[0].tolist()) if bin(p ^ mark).count("1") <= RADIUS]
        assert index.within(mark).tolist() == want


def test_window_starts_against_all_windows():
    rng = np.random.default_rng(3)
    for _ in range(500):
        size = int(rng.integers(1, 60))
        near, width = np.flatnonzero(rng.random(size) < rng.random()), int(rng.integers(1, size + 1))
        need = int(rng.integers(1, width + 1))
        want = [s for s in range(size - width + 1) if ((near >= s) & (near < s + width)).sum() >= need]
        assert window_starts(near, width, need, size).tolist() == want


def test_window_prints_against_each_window():
    rng = np.random.default_rng(5)
    for _ in range(40):
        shingles = np.array([hash((7, int(x))) & (1 << 63) - 1 for x in rng.integers(0, int(rng.integers(2, 60)), 50)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        n = int(rng.integers(1, 50))
        starts = np.arange(0, 51 - n, 2)
        for s, (a, b) in zip(starts, window_prints(shingles, starts, n).tolist()):
            assert (a, b) == (simhash(shingles[s : s + n]), simhash(np.unique(shingles[s : s + n])))


def test_copies_that_differ_by_a_repeated_word(spark, docs):
    words = [f"m{k}" for k in range(300)]
    texts = ["pre " + " ".join(words[:at] + ["x"] * 24 + words[at + 24 :]) + " post" for at in (0, 100, 200, 276)]
    assert len(found(find_leaks(docs(texts), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")))) == 4


def test_a_long_text_that_repeats_an_item(spark, docs):
    item = " ".join(f"i{k}" for k in range(300))
    got = found(find_leaks(docs([f"{item} " * 400]), spark.createDataFrame([(7, item)], "item_id long, text string")))
    assert got == {(1, 7): 1.0}


def test_simhash_weighs_repeats():
    a, b = np.array([1, 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert simhash(np.array([a, a, b])) == simhash(np.array([a]))


def test_blocks_of_items(spark, docs, monkeypatch):
    monkeypatch.setattr("sunplane.llm.decontaminate.ITEMS_AT_ONCE", 3)
    texts, items = made()
    got = found(find_leaks(docs(texts[:10]), spark.createDataFrame(list(items.items()), "item_id long, text string")))
    same(got, brute(dict(enumerate(texts[:10], 1)), items))


def test_edges(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "aa bb cc dd ee ff"), (1, "aa bb cc dd ee ff")], "item_id long, text string")
    assert find_leaks(docs(["aa bb cc dd ee ff"]), none).count() == 0
    assert find_leaks(docs([]), one).count() == 0
    df = spark.createDataFrame([(None, "aa bb cc dd ee ff", 1, 2), (2, "aa bb cc dd ee ff", 1, 2), (2, "x", 1, 2), (3, "clean", 1, 2)], "doc_id long, text string, item int, similarity int")
    assert find_leaks(df, one).count() == 4
    out = drop_leaks(df, one)
    assert out.columns == df.columns and sorted(r["text"] for r in out.collect()) == ["clean", "x"]
