import random

import duckdb

from sunplane.llm.line_dedup import OP10_SQL, dedup_lines


def brute(rows, width=3):
    """rows: (id, text) -> id: (text, removed)."""
    seen, gone = set(), {}
    for k, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        solid = [(i, s) for i, x in enumerate(text.split("\n")) if (s := x.strip(" \t\r"))]
        for j in range(len(solid) - width + 1):
            part = tuple(s for _, s in solid[j : j + width])
            if part in seen:
                gone.setdefault(k, set()).update(range(solid[j][0], solid[j + width - 1][0] + 1))
            seen.add(part)
    return {k: (None, 0) if t is None else ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())), len(gone.get(k, ()))) for k, t in rows}


def test_random_texts_against_brute_force_and_sql(docs):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["a", "b", "c", " a", "d\t", "", "  ", "e"]) for _ in range(rng.randrange(1, 14))) for _ in range(120)]
    texts += [None, "", "\n", "\n\n\n", "a\nb", "x\ny\nz\nx\ny\nz", "q\nq\nq\nq\nq", "p\n\nq\n\nr", "p\nq\n\n\nr\n"]
    df = docs(texts)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup_lines(df).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    documents = df.toPandas()  # noqa: F841
    assert {r[0]: (r[1], r[3]) for r in duckdb.sql(OP10_SQL).fetchall()} == got


def test_long_text_and_hot_window(docs):
    hot = "h1\nh2\nh3"
    texts = ["\n".join(f"line {k}" for k in range(20_000)) + "\n" + hot] + [f"own {k}\n{hot}\nend {k}" for k in range(200)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs(texts)).collect()}
    assert got[1] == texts[0]
    assert all(got[k + 2] == f"own {k}\nend {k}" for k in range(200))


def test_null_ids_extra_columns_and_empty(spark, docs):
    df = spark.createDataFrame([(None, "a\nb\nc", 5, "k"), (1, "a\nb\nc", 6, "k"), (2, "a\nb\nc\nd", 7, "k"), (2, "a\nb\nc\nd", 7, "k")], "doc_id long, text string, n_removed int, _cut string")
    out = dedup_lines(df)
    assert set(out.columns) == {"doc_id", "text", "_cut", "n_lines", "n_removed"}
    rows = sorted((r["doc_id"] or 0, r["text"]) for r in out.collect())
    assert rows[0] == (0, "a\nb\nc") and rows[1] == (1, "") and rows[2:] == [(2, "d")] * 2


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (2, "x\ny\nz\nw"), (None, "q\nr\ns\na\nb\nc"), (None, "q\nr\ns\nt")]
    got = sorted(r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first = ["q\nr\ns\na\nb\nc", "t"], ["a\nb\nc", "q\nr\ns\nt"]  # which of the two without an id comes first
    assert got in [sorted([*f, "", "", "x\ny\nz\nw"]) for f in first]


def test_empty(docs):
    assert dedup_lines(docs([])).count() == 0
