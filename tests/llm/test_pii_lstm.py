import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from sunplane.llm.pii_lstm import KINDS, Tagger, base_spans, encode, find_personal_data, labelled_samples, luhn, model_spans, op8_pii, reconcile, told, train, window_starts


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


@pytest.fixture(scope="module")
def tagger():
    return train()


def test_base_spans_against_the_patterns():
    rng = random.Random(6)
    pieces = ["a.b@c-d.co", "@", "x@y", "a@b.c@d.e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4785380592391139", "+1 (310) 555-4510", "+49-30-1234567", "+", "12", ".", "-", " ", "é", "٣", "\n", "0", "00001.2.3.4"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9)))
        assert base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    assert base_spans("a" * 300_000 + " x@y") == []
    assert base_spans("1" * 300_000 + "@") == []


def test_query_against_the_patterns(spark, sample_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sample_dir}/documents.parquet").collect()}
    for r in op8_pii(spark, sample_dir).collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(told(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS[:4]] == [sum(s[0] == k for s in want) for k in KINDS[:4]]
        assert set(told(want).split(",")) - {""} <= set(r["spans"].split(","))


def test_tagger_on_held_out_samples(tagger):
    rows = labelled_samples(400, np.random.default_rng(1234))
    found = model_spans(tagger, [t for t, _ in rows])
    truth = [{(KINDS[k], a, b) for k, a, b in s if b < len(t)} for t, s in rows]
    cut = [{(KINDS[k], a, b) for k, a, b in s} for _, s in rows]
    hits = sum(len(t & set(f)) for t, f in zip(truth, found))
    assert hits / sum(map(len, truth)) > 0.85
    assert sum(len(set(f) & c) for f, c in zip(found, cut)) / sum(map(len, found)) > 0.95


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    tagger = Tagger(rng)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    codes, labels = rng.integers(1, 90, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [1, 2, 0, 0, 0, 5, 6], [0] * 7])
    _, grad = tagger.step(codes, labels)
    for name in tagger.p:
        flat = tagger.p[name].ravel()
        for k in rng.integers(0, len(flat), 3):
            old, h = flat[k], 1e-4
            flat[k] = old + h
            up = tagger.step(codes, labels)[0]
            flat[k] = old - h
            down = tagger.step(codes, labels)[0]
            flat[k] = old
            assert abs((up - down) / (2 * h) - grad[name].ravel()[k]) < 2e-3, name


def test_decode_and_likelihood_against_all_sequences():
    rng = np.random.default_rng(4)
    tagger = Tagger(rng)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    tagger.p["T"] = rng.normal(0, 1, tagger.p["T"].shape)
    tagger.p["O"] *= 5
    codes = rng.integers(1, 90, (3, 3))
    scores, T = tagger.emit(codes)[0], tagger.moves()
    labels, gains = tagger.decode(codes)
    for k in range(3):
        total = {y: sum(scores[t, k, y[t]] for t in range(3)) + T[y[0], y[1]] + T[y[1], y[2]] for y in itertools.product(range(len(T)), repeat=3)}
        best = max(total, key=total.get)
        assert tuple(labels[k]) == best
        assert np.isclose(gains[k].sum(), total[best] - total[0, 0, 0])
        loss = tagger.step(codes[k : k + 1], labels[k : k + 1])[0]
        assert np.isclose(loss, np.log(sum(np.exp(v) for v in total.values())) - total[best])


def test_reconciled_spans_against_all_choices():
    rng = random.Random(2)
    for _ in range(200):
        spans = [(rng.choice(["ip", "card"]), a := rng.randrange(12), a + rng.randrange(1, 6), rng.random()) for _ in range(rng.randrange(0, 9))]
        got = reconcile(spans)
        assert got == sorted(got, key=lambda s: s[1]) and all(x[2] <= y[1] for x, y in zip(got, got[1:]))
        worth = lambda chosen: sum(max(g for *s, g in spans if tuple(s) == c) for c in chosen)
        every = {s[:3] for s in spans}
        options = (c for n in range(len(every) + 1) for c in itertools.combinations(sorted(every, key=lambda s: s[1]), n) if all(x[2] <= y[1] for x, y in zip(c, c[1:])))
        assert abs(worth(got) - max(map(worth, options))) < 1e-9


#: Sentences written by hand, and what is personal in them.
WRITTEN = [
    ("Please write to anna.lindqvist@posteo.example.org before Friday.", ["anna.lindqvist@posteo.example.org"]),
    ("Her office line is (212) 555-0187, ask for Mr. Brandt.", ["(212) 555-0187"]),
    ("The camera at 10.20.30.44 stopped sending pictures.", ["10.20.30.44"]),
    ("SSN on file: 219-09-9999, verified in March.", ["219-09-9999"]),
    ("Card 4111 1111 1111 1111 was declined twice.", ["4111 1111 1111 1111"]),
    ("Call 415-555-2671 or 415-555-2672 after six.", ["415-555-2671", "415-555-2672"]),
    ("Transfer it to DE89 3704 0044 0532 0130 00 by Monday.", ["DE89 3704 0044 0532 0130 00"]),
    ("Ruf mich bitte unter +49 170 123 4567 an.", ["+49 170 123 4567"]),
    ("The server 192.168.7.12 answers, but 192.168.7.13 does not.", ["192.168.7.12", "192.168.7.13"]),
    ("My number is 078-05-1120 and I live in Ohio.", ["078-05-1120"]),
    ("In 1998 the 24 members met 3 times and raised 12,500 dollars.", []),
    ("Version 2.10.4 fixes issue 4821, see pages 112-118.", []),
    ("The match ended 3-2 on 2021-07-11 in front of 67,173 people.", []),
    ("Order 88213 ships on 04/05/2023 at 10:30 from gate B12.", []),
]


def test_sentences_written_by_hand(tagger):
    found = model_spans(tagger, [t for t, _ in WRITTEN])
    hits = sum(t[a:b] in wanted for (t, wanted), spans in zip(WRITTEN, found) for _, a, b in spans)
    assert hits >= 0.7 * sum(len(w) for _, w in WRITTEN)
    assert sum(len(spans) for (_, wanted), spans in zip(WRITTEN, found) if not wanted) <= 1


def test_a_span_across_every_window_edge(tagger):
    core = "call (415) 555-2671 today"
    for shift in range(0, 130, 3):
        text = "lorem ipsum dolor "[: shift % 18] + "x " * (shift // 2) + core + " and more words after it " * 4
        a = text.index("(415)")
        assert ("phone", a, a + 14) in model_spans(tagger, [text])[0], shift


def test_spans_do_not_depend_on_the_place(tagger):
    core = "call (415) 555-2671 today"
    alone = [s for s in model_spans(tagger, [core])[0]]
    for shift in (0, 64, 128, 640):
        moved = model_spans(tagger, ["x" * 0 + "lorem ipsum " * (shift // 12) + core])[0]
        assert [k for k, _, _ in moved] == [k for k, _, _ in alone]


def test_windows_cover_every_trigger():
    text = "a" * 100 + "1" + "b" * 300 + "@" + "c" * 50
    starts = window_starts(text)
    for at in (100, 401):
        assert all(s in starts for s in range(0, 500, 64) if s <= at < s + 128)
    assert encode("aé—", 5).tolist() == [encode("a", 1)[0], 98, 99, 0, 0]


def test_edges(spark, docs, tagger):
    assert find_personal_data(docs([]), tagger).count() == 0
    out = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in find_personal_data(docs([None, "", "no data", "é 1.2.3.4"]), tagger).collect()}
    assert out == {1: [], 2: [], 3: [], 4: [("ip", 2, 9, True)]}
    df = spark.createDataFrame([(None, "a@b.cd", 1), (2, "a@b.cd", 1), (2, "a@b.cd", 1)], "doc_id long, text string, spans int")
    assert [len(r["spans"]) for r in find_personal_data(df, tagger).collect()] == [1, 1, 1]
