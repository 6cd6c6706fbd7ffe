"""The pipeline's stages against plain Python, each on what the one before kept."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_decontaminate import bag, words  # noqa: E402
from test_line_dedup import brute as brute_lines  # noqa: E402
from test_ngram_join import brute as brute_groups  # noqa: E402
from test_packing import check as check_pieces  # noqa: E402
from test_quality_rules import WORD  # noqa: E402
from test_quality_rules import brute as brute_stats  # noqa: E402

from sunplane.staging import staged  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


def brute_rules(rows):
    """id -> text of the documents that the rules keep. rows: id, source, text."""
    key = lambda line: " ".join(WORD.findall(line)).translate({k: k + 32 for k in range(65, 91)})
    seen = {}
    for _, source, text in rows:
        for line in {key(x) for x in text.split("\n")} - {""}:
            seen.setdefault((source, line), set()).add(text)
    common = {k for k, v in seen.items() if len(v) > 10}
    out = {}
    for k, source, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if (source, key(x)) not in common]
        n, *_, failed = brute_stats(text)
        left = sum(len(WORD.findall(x)) for x in kept)
        if not failed and left >= 20 and 100 * left >= 30 * n:
            out[k] = text if len(kept) == len(lines) else "\n".join(kept)
    return out


def test_stage_by_stage(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}

    def run(name, docs):
        out = staged(STAGES[name](spark, docs, folder), "test")
        assert out.columns == columns
        got = {r["doc_id"]: r for r in out.collect()}
        assert all(r["n_chars"] == len(r["text"]) and r["source"] == rows[k]["source"] for k, r in got.items())
        return out, {k: r["text"] for k, r in got.items()}

    docs, texts = run("quality rules", docs)
    assert texts == brute_rules([(k, r["source"], r["text"]) for k, r in rows.items()])

    want = {k: t for k, (t, gone) in brute_lines(list(texts.items())).items() if t or not gone}
    docs, texts = run("line dedup", docs)
    assert texts == want

    keep = {c for c, _ in brute_groups(texts).values()}
    before = texts
    docs, texts = run("n-gram Jaccard join", docs)
    assert texts == {k: before[k] for k in keep}

    items = [words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    known = {g for i in items for g in bag(i, 5)}

    def leaks(text):
        ws = words(text)
        if not bag(ws, 5).keys() & known:
            return False
        for it in items:
            want = bag(it, 5)
            for s in range(max(1, len(ws) - len(it) + 1)):
                have = bag(ws[s : s + len(it)], 5)
                if have.keys() & want.keys() and 5 * sum((have & want).values()) >= 4 * sum((have | want).values()):
                    return True
        return False

    before = texts
    docs, texts = run("benchmark decontamination", docs)
    assert texts == {k: t for k, t in before.items() if not leaks(t)}
    check_pieces(STAGES["packing"](spark, docs, folder).collect(), texts)


def test_run_joins_the_stages(spark, sample_dir):
    docs = spark.read.parquet(f"{sample_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sample_dir), "test")
    pick = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(corpus_pipeline.run(spark, sample_dir).select(*pick).collect()) == sorted(STAGES["packing"](spark, docs, sample_dir).select(*pick).collect())


def test_empty_and_odd_tables(spark, docs, sample_dir):
    long = " ".join(f"w{k}" for k in range(40))
    odd = docs([None, "", long, long, long + "\n" + "x" * 70_000])
    for table in (docs([]), odd.withColumn("text_hash", odd["doc_id"])):
        out = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = staged(stage(spark, out, sample_dir), "test")
            assert out.columns == table.columns
        STAGES["packing"](spark, out, sample_dir).collect()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == list(STAGES) and len(STAGES) == 5
    assert re.fullmatch("[a-zA-Z -]+", "".join(STAGES))
