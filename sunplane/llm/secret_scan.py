"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio; no Python on the rows.

The model of ordinary identifiers is trained on words of a tokenizer's vocabulary, whose path is a parameter."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunplane.functions.angles import let

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

#: What the models see: runs of these characters, of at least RUN_LEAST.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]+"
RUN_LEAST = 20
#: A run, or a part of one of PART_LEAST or more characters, is a secret if its log-likelihood ratio (nats) is over
#: LEAST_TOTAL, and over LEAST_STEP for each step of it. Parts are told apart by a loss of LEAST_TOTAL.
LEAST_TOTAL, LEAST_STEP, PART_LEAST = 12.0, 0.5, 12

#: Words of a vocabulary that the samples of identifiers are joined from, and how long these are.
N_WORDS, WORD_LENGTHS = 2000, (4, 12)


def ordinary_words(path: str) -> list[str]:
    """The first N_WORDS whole lower-case words of a tokenizer's vocabulary (a tokenizers file whose word ends are marked
    </w>) by id; merges come by frequency, so these are the most usual ones."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    least, most = WORD_LENGTHS
    words = ((n, w[:-4]) for w, n in vocabulary.items() if w.endswith("</w>") and least <= len(w) - 4 <= most and w[:-4].isascii() and w[:-4].isalpha())
    return [w for _, w in sorted(words)[:N_WORDS]]


def labelled_samples(spark: SparkSession, words: list[str], n: int = 4000) -> DataFrame:
    """2 * n labelled strings, made by a rule: random ones in base64, hex and mixed letters and digits, and
    identifiers in the usual spellings, joined from the words."""
    every = F.split(F.lit(" ".join(words)), " ")
    word = lambda k: F.element_at(every, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 99))
    digest = lambda k: F.unhex(F.sha2(F.concat_ws(":", "id", F.lit(k)), 256))
    b64 = F.base64(digest("b"))
    w = [word(k) for k in range(4)]
    shapes = [
        F.concat(w[0], *[cap(x) for x in w[1:]]),
        F.concat_ws("_", *w),
        F.concat_ws("-", *w),
        F.upper(F.concat_ws("_", *w)),
        F.concat(*[cap(x) for x in w]),
        F.concat(F.lit("/"), F.concat_ws("/", *w)),
        F.concat(*w),
        F.concat(F.concat_ws("_", *w[:3]), F.lit("_"), F.pmod(F.xxhash64("id"), F.lit(2030))),
        F.concat(F.pmod(F.xxhash64("id"), F.lit(30)) + 2000, F.lit("-"), F.lpad(F.pmod("id", F.lit(12)) + 1, 2, "0"), F.lit("-"), F.concat_ws("-", *w[:2])),
        F.concat(F.repeat(F.lit("-"), 24), w[0], F.repeat(F.lit("="), 24), w[1], F.repeat(F.lit("_"), 24)),
    ]
    random = F.when(F.pmod("id", F.lit(3)) == 0, F.lower(F.hex(digest("a")))).when(F.pmod("id", F.lit(3)) == 1, b64).otherwise(F.regexp_replace(b64, "[+/=]", ""))
    ordinary = F.element_at(F.array(*shapes), (F.pmod("id", F.lit(len(shapes))) + 1).cast("int"))
    return spark.range(n).select(F.explode(F.array(F.struct(random.alias("text"), F.lit(True).alias("random")), F.struct(ordinary.alias("text"), F.lit(False).alias("random")))).alias("s")).select("s.*")


def fit(samples: DataFrame) -> list[float]:
    """For each pair of characters of the alphabet (row by row, first character first; row 0 is the start) the
    log of how much likelier the random model makes the step. `samples`: text, random. Add-one smoothing; the
    two models have (len(ALPHABET) + 1) * len(ALPHABET) parameters each, whatever the number of samples."""
    n = len(ALPHABET)
    steps = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.struct(F.when(i == 1, 0).otherwise(F.instr(F.lit(ALPHABET), F.substr("text", i - 1, F.lit(1)))).alias("a"), F.instr(F.lit(ALPHABET), F.substr("text", i, F.lit(1))).alias("b")))
    rows = samples.filter("length(text) > 0").select("random", F.explode(steps).alias("p")).filter("p.b > 0").groupBy("random", "p.a", "p.b").count().collect()
    counts = {True: [[1] * n for _ in range(n + 1)], False: [[1] * n for _ in range(n + 1)]}
    for r in rows:
        counts[r["random"]][r["a"]][r["b"] - 1] += r["count"]
    share = {k: [[x / sum(row) for x in row] for row in c] for k, c in counts.items()}
    return [math.log(share[True][a][b] / share[False][a][b]) for a in range(n + 1) for b in range(n)]


def random_parts(run: Column, model: list[float]) -> Column:
    """(start, end) of the parts of a run of alphabet characters that are secrets: the whole run if it is one, else
    each segment of the largest sum of step ratios less LEAST_STEP, in one pass over the characters. A segment
    ends at its peak once the sum is used up or LEAST_TOTAL below the peak."""
    weights, n = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>"), len(ALPHABET)
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    chars = F.split(run, "")
    ratios = F.zip_with(F.concat(F.array(F.lit(" ")), chars), chars, lambda a, b: F.get(weights, code(a) * n + code(b) - 1))  # a null at the end

    def state(at, total, now, start, top, stop, out):
        return F.struct(at.alias("at"), total.alias("total"), now.alias("now"), start.alias("start"), top.alias("top"), stop.alias("stop"), out.alias("out"))

    def step(acc, ratio):
        at, now, width = acc["at"] + 1, acc["now"] + ratio - LEAST_STEP, acc["stop"] - acc["start"]
        total = acc["total"] + F.coalesce(ratio, F.lit(0.0))
        found = (width >= PART_LEAST) & (acc["top"] + LEAST_STEP * width > LEAST_TOTAL)
        out = F.when(found, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["stop"].alias("end"))))).otherwise(acc["out"])
        return F.when(ratio.isNull() | (now <= 0) | (now < acc["top"] - LEAST_TOTAL), state(at, total, F.lit(0.0), at, F.lit(0.0), at, out)).otherwise(
            state(at, total, now, acc["start"], F.greatest(acc["top"], now), F.when(now > acc["top"], at).otherwise(acc["stop"]), acc["out"])
        )

    first = state(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), F.array().cast("array<struct<start:int,end:int>>"))
    whole = lambda acc: acc["total"] > F.greatest(F.lit(LEAST_TOTAL), LEAST_STEP * (acc["at"] - 1))
    return F.aggregate(ratios, first, step, lambda acc: F.when(whole(acc), F.array(F.struct(F.lit(0).alias("start"), (acc["at"] - 1).alias("end")))).otherwise(acc["out"]))


def running(values: Column) -> Column:
    """For each whole number of an array the sum of those before it. Sums are made in blocks of about the root of the
    length and the blocks' sums then added, so that n appends cost n to the 1.5, not n squared."""

    def sums(numbers: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(numbers, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def blocked(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v["of"]))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v["of"]) - 1) / size).cast("int")), lambda b: sums(F.slice(v["of"], b * size + 1, size)))

    def joined(v: Column) -> Column:
        before = sums(F.transform(v["blocks"], lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(v["blocks"], before, lambda b, at: F.transform(b["out"], lambda x: x + at)))

    return let({"of": values}, lambda v: F.when(F.size(v["of"]) == 0, F.array().cast("array<int>")).otherwise(let({"blocks": blocked(v)}, joined)))


def find_spans(text: Column, pattern: str) -> Column:
    """(start, end, hit) of the leftmost non-overlapping matches in code points, end exclusive. U+0001 in the text
    is read as U+0002, which keeps lengths, so that U+0001 can mark the matches."""
    parts = F.split(F.regexp_replace(F.translate(text, "\x01", "\x02"), f"((?:{pattern}))" if not pattern.startswith("(?i)") else f"(?i)((?:{pattern[4:]}))", "\x01$1\x01"), "\x01", -1)
    span = lambda hit, at: F.struct(at.alias("start"), (at + F.length(hit)).alias("end"), hit.alias("hit"))
    placed = lambda v: F.zip_with(v["parts"], running(F.transform(v["parts"], F.length)), span)
    return F.filter(let({"parts": parts}, placed), lambda _, k: k % 2 == 1)


def ranks(starts: Column, places: Column, equal: bool) -> Column:
    """For each of the ascending places the number of starts (ascending) before it, or also at it."""
    first, second = (0, 1) if equal else (1, 0)
    event = lambda at, order, place: F.struct(at.alias("at"), F.lit(order).alias("order"), F.lit(place).alias("place"))
    events = F.array_sort(F.concat(F.transform(starts, lambda x: event(x, first, 0)), F.transform(places, lambda x: event(x, second, 1))))
    told = lambda v: F.zip_with(v["events"], running(F.transform(v["events"], lambda e: 1 - e["place"])), lambda e, n: F.struct(e["place"].alias("place"), n.alias("n")))
    return F.transform(F.filter(let({"events": events}, told), lambda e: e["place"] == 1), lambda e: e["n"])


def scan_secrets(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id and `spans`, an array of (start, end, kind, hit) by start and then
    kind in the order of KINDS, code points, end exclusive.

    Kinds assign, access and hex are the base patterns, each matched left to right without overlap, matches
    that fail their length test dropped and not tried again. Kind markov is a run of RUN_LEAST or more
    characters of ALPHABET outside the base spans that the random model explains better than the identifier
    model, or else each part of it that is so (random_parts), widened to the separators / = _ - around it. Null and empty texts have no spans; repeated rows are scanned each; columns besides the two are
    ignored; an empty table gives an empty result. The whole text is scanned, whatever its length.
    """
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    body = F.col("body")
    found = lambda trigger, pattern: F.when(body.rlike(trigger), find_spans(body, pattern)).otherwise(none)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).select(
        "id",
        F.filter(found(r"(?i)(?:password|passwd|secret|token|api_?key)[\"'\x20:=]", ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 8).alias("assign"),
        F.filter(found("AKIA[A-Z0-9]{12}", ACCESS), lambda s: F.length(s["hit"]) >= 16).alias("access"),
        F.filter(found("[0-9a-f]{32}", "[0-9a-f]{32,}"), lambda s: F.length(s["hit"]) >= 32).alias("hex"),
        found(f"[A-Za-z0-9+/_=-]{{{RUN_LEAST}}}", f"[A-Za-z0-9+/_=-]{{{RUN_LEAST},}}").alias("run"),
    )
    met = [c for k in KINDS[:3] for c in (ranks(F.transform(k, lambda s: s["start"]), F.transform("run", lambda r: r["start"]), True).alias(f"{k}_from"), ranks(F.transform(k, lambda s: s["start"]), F.transform("run", lambda r: r["end"]), False).alias(f"{k}_to"))]
    rows = rows.select("*", F.concat(*[_named(F.col(k), n) for n, k in enumerate(KINDS[:3])]).alias("base"), *met)
    runs = F.arrays_zip("run", *[f"{k}_{end}" for k in KINDS[:3] for end in ("from", "to")])
    pieces = F.flatten(F.transform(runs, lambda r: _outside(r["run"], F.concat(*[_between(F.col(k), r[f"{k}_from"], r[f"{k}_to"]) for k in KINDS[:3]]))))
    likely = F.flatten(F.transform(pieces, lambda r: _widened(r, random_parts(r["hit"], model))))
    spans = F.array_sort(F.concat("base", _named(likely, 3)))
    return rows.select(F.col("id").alias(id_col), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"))).alias("spans"))


def _named(spans: Column, rank: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"), s["hit"].alias("hit")),
    )


def _between(spans: Column, after: Column, before: Column) -> Column:
    """The spans of a kind numbered from after - 1 up to before: those that can overlap a run after whose start, and before
    whose end, so many of them begin."""
    first = F.greatest(after - 1, F.lit(0))
    return F.when(before > first, F.transform(F.sequence(first, F.greatest(before - 1, first)), lambda k: F.get(spans, k))).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def _outside(run: Column, base: Column) -> Column:
    """The pieces of RUN_LEAST or more characters that base spans leave of a run."""
    piece = lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.substr(run["hit"], a - run["start"] + 1, b - a).alias("hit"))
    cuts = F.array_sort(F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])))
    pieces = F.aggregate(
        cuts,
        F.struct(run["start"].alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("out")),
        lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], F.array(piece(acc["at"], b["start"]))).alias("out")),
        lambda acc: F.concat(acc["out"], F.array(piece(acc["at"], run["end"]))),
    )
    return F.filter(pieces, lambda p: p["end"] - p["start"] >= RUN_LEAST)


def _widened(run: Column, parts: Column) -> Column:
    """The parts of a run out to the separators around them, those that meet joined, as spans of the text."""
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    wide = F.transform(
        parts,
        lambda p: span(
            p["start"] - F.length(F.regexp_extract(F.substr(run["hit"], F.lit(1), p["start"]), "[^/=_-]*$", 0)), p["end"] + F.length(F.regexp_extract(F.substr(run["hit"], p["end"] + 1), "^[^/=_-]*", 0))
        ),
    )
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(
        wide,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, p: F.when((F.size(acc) > 0) & (p["start"] < F.get(acc, F.size(acc) - 1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(span(last(acc)["start"], F.greatest(last(acc)["end"], p["end"]))))).otherwise(
            F.concat(acc, F.array(p))
        ),
    )
    return F.transform(joined, lambda p: F.struct((run["start"] + p["start"]).alias("start"), (run["start"] + p["end"]).alias("end"), F.substr(run["hit"], p["start"] + 1, p["end"] - p["start"]).alias("hit")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = fit(labelled_samples(spark, ordinary_words(public_tokenizers.path("word_bpe_49k.json"))))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), model).select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(told(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )
