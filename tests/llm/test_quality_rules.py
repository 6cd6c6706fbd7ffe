import random
import re

import duckdb

from sunplane.llm.quality_rules import OP3_SQL, apply_rules, judge_documents, line_keys

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    spots = {}
    for k in range(len(words) - 7):
        spots.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {j for ks in spots.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(1)
    out = [" ".join(rng.choice("ab c\n d é😀 \t#x &&& \n\n Zz  q".split(" ")) for _ in range(rng.randrange(0, 80))) for _ in range(150)]
    return out + [None, "", "\n", " \n\t", "one two three four five six seven eight " * 9, "x" * 100_000, "w " * 70_000, "a\n" * 30, "a \na\n"]


def test_statistics_against_brute_force(docs):
    df = docs(texts())
    want = {r["doc_id"]: brute(r["text"]) for r in df.collect()}
    got = {r["doc_id"]: tuple(r)[1:7] for r in judge_documents(df)[0].collect()}
    assert got == want


def common_docs():
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    out = [f"{words(30)}\nThe  Common line\n{words(10)}" for _ in range(12)]
    out += ["the common LINE\n" + "other words " * 3] + [words(40)] * 30 + [f"{words(21)}\nRare line here" for _ in range(5)]
    return out


def test_common_lines_against_sql(docs):
    df = docs(common_docs() + texts())
    documents = df.toPandas()  # noqa: F841
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed_words", "base_failed", "kept")) for r in judge_documents(df)[0].collect())
    assert got == sorted(duckdb.sql(f"SELECT doc_id, n_words, n_removed_words, base_failed, kept FROM ({OP3_SQL})").fetchall())


def test_lines_go_and_copies_stay(docs):
    texts = common_docs()
    out = {r["doc_id"]: r["text"] for r in apply_rules(docs(texts), copies_count=False).collect()}
    assert all("Common" not in out[k] and out[k].count("\n") == 1 for k in range(1, 13))
    assert all(out[k] == texts[k - 1] for k in range(14, 49))


def test_depleted_documents_go(docs):
    block = "\n".join(f"shared line number {k} with words" for k in range(10))
    texts = [f"{block}\nown {n} words" for n in range(15)]
    assert apply_rules(docs(texts)).count() == 0
    assert apply_rules(docs(texts), most_docs=15).count() == 15


def test_exact_copies_count_as_told(docs):
    copy = "\n".join(f"line {k} of a text that is copied" for k in range(10))
    table = docs([copy] * 12 + ["other words " * 12])
    assert sorted(r["doc_id"] for r in apply_rules(table, copies_count=False).collect()) == [*range(1, 13)]
    assert apply_rules(table).count() == 0
    assert apply_rules(table, most_docs=12).count() == 12
    assert apply_rules(table.withColumn("doc_id", table["doc_id"] % 3)).count() == 12


def test_repeated_rows_and_ids_are_judged_each(spark, docs):
    shared = "\n".join(f"w{k} common" for k in range(3))
    own = " ".join(f"own{k}" for k in range(40))
    rows = [(1, f"{shared}\n{own}", "s")] * 5 + [(k, f"{shared}\n{own} {k}", "s") for k in range(2, 15)] + [(1, "too few", "s"), (1, own, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["doc_id"], r["n_words"]): (r["n_removed_words"], r["kept"]) for r in judge_documents(df)[0].collect()}
    assert got[1, 46] == (6, True) and got[1, 2] == (0, False) and got[1, 40] == (0, True)
    kept = sorted(r["text"] for r in apply_rules(df).filter("doc_id = 1").collect())
    assert kept == [own] * 6


def test_lines_that_a_polynomial_hash_confuses_are_told_apart(docs):
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    r = judge_documents(docs([f"{word}\n{other}", f"{word}\n{word}", "\n".join([" ".join(word), " ".join(other)])]))[0].collect()
    assert sorted((x["doc_id"], x["n_dup_lines"]) for x in r) == [(1, 0), (2, 1), (3, 0)]
    assert len(set(line_keys("\n".join([" ".join(word), " ".join(other)])))) == 2


def test_line_keys_follow_lines():
    assert line_keys("A b\n\n a  B ") == [line_keys("a B")[0], None, line_keys("a b")[0]]


def test_edges(spark, docs):
    assert judge_documents(docs([]))[0].count() == 0
    long = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, long, None, 1, "k"), (5, long, None, 2, "k"), (5, long, None, 2, "k"), (6, None, "h", 3, "k")], "doc_id long, text string, source string, line int, host string")
    assert judge_documents(df)[0].count() == 4
    out = apply_rules(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.orderBy("doc_id").collect()] == [None, 5, 5]
