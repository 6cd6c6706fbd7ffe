import random
import re

import pytest

from sunplane.llm.ngram_join import choose_bands, connected_components, drop_near, join_near, op5_ngram_jaccard_join


def shingles(text):
    words = re.findall("[0-9A-Za-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """id -> (class, links) over all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root, links = {k: k for k in sets}, dict.fromkeys(sets, 0)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (find(k), links[k]) for k in ids}


def collected(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def corpus():
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = []
    for _ in range(25):
        base = text(rng.randrange(40, 300))
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            other = list(base)
            for _ in range(rng.randrange(0, 4)):
                other[rng.randrange(len(other))] = "edit"
            out.append(" ".join(other).upper() if rng.random() < 0.3 else ", ".join(other))
    chain = text(100)
    for k in range(8):  # each is near the next, the ends are not near
        out.append(" ".join(chain[4 * k :] + text(1)[:1] * 0 + [f"t{j}" for j in range(4 * k)]))
    return out + [None, "", "...", "one two", "One, two!", "three"] + [out[0]] * 3


def test_against_all_pairs(docs):
    df = docs(corpus())
    assert collected(join_near(df)) == brute({r["doc_id"]: r["text"] for r in df.collect()})


def test_query_against_all_pairs(spark, sample_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sample_dir}/documents.parquet").collect()}
    assert collected(op5_ngram_jaccard_join(spark, sample_dir)) == brute(texts)


def test_large_group_over_several_blocks(docs, monkeypatch):
    monkeypatch.setattr("sunplane.llm.ngram_join.BLOCK_DOCS", 16)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for n in range(90):
        words = list(base)
        words[rng.randrange(120)] = f"x{n}"
        texts.append(" ".join(words))
    df = docs(texts)
    assert collected(join_near(df)) == brute(dict(enumerate(texts, 1)))
    assert [r["doc_id"] for r in drop_near(df).collect()] == [1]


def test_one_of_each_group_stays(docs):
    df = docs(corpus())
    want = {c for c, _ in brute({r["doc_id"]: r["text"] for r in df.collect()}).values()}
    out = drop_near(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(want)


@pytest.mark.parametrize("recall", [0.9, 0.99, 0.9995])
def test_bands_reach_the_recall(recall):
    bands, rows = choose_bands(0.8, recall, 64)
    assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 64


def test_components_of_chains_and_stars(spark):
    edges = [(k + 1, k) for k in range(1, 60)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    out = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "id long, root long")).collect()}
    assert out == {k: 1 for k in range(2, 61)} | {k: 100 for k in range(101, 130)}


def test_edges(spark, docs):
    assert join_near(docs([])).count() == 0
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, text, 1, "a"), (4, text, 2, "a"), (4, text, 2, "a"), (5, text + " x", 3, "a")], "doc_id long, text string, key int, band string")
    assert sorted(tuple(r) for r in join_near(df).collect() if r[0]) == [(4, 4, 2), (4, 4, 2), (5, 4, 2)]
    out = drop_near(df)
    assert out.columns == df.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 4]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{p}{k}" for k in range(40)) for p in "abc")
    rows = [(0, a), (1, a), (1, b), (1, b), (2, f"{b} end"), (3, c), (None, c), (4, ""), (4, c + " x"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in join_near(df).collect() if r["doc_id"] is not None)
    assert got == [(0, 0, 1), (1, 0, 1), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 3, 1), (4, 4, 0), (4, 4, 0)]
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in drop_near(df).collect())
    assert kept == sorted([(0, a), (1, b), (3, c), (-1, c), (4, ""), (4, "")])


def test_long_words_that_a_polynomial_hash_confuses(docs):
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    assert collected(join_near(docs([f"{word} x y z w", f"{other} x y z w"]))) == {1: (1, 0), 2: (2, 0)}
