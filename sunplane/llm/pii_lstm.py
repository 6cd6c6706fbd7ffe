"""PII: fixed patterns, and a character-level bidirectional LSTM with CRF transitions over overlapping windows."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sunplane.llm.common import in_batches

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
BASE_KINDS = KINDS[:4]
#: Windows of so many characters begin at every multiple of the stride, so a span of up to a stride is whole in some.
WINDOW, STRIDE = 128, 64
HIDDEN, EMBED = 24, 16
SAMPLES, BATCH, RATE, SEED, TRAIN_CHARS = 19200, 32, 0.01, 11, 72

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", re.A)
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+", re.A)
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]", re.A)
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # a match's local part is the run of local characters before an @
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if any(c in text for c in "0123456789"):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# The labelled samples are made by a rule, from seeded random choices.


def labelled_samples(n: int, rng: np.random.Generator) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """n texts with their spans (kind, start, end): personal data and look-alikes among invented words."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    parts = "an the re ing tion er on at en st or es ou le que ment ver sch lich ung ci la de os aux eau pa vi be".split()
    word = lambda: "".join(pick(parts) for _ in range(int(rng.integers(1, 4))))

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"+{digits(2)}{a}{b}{c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}"])

    make = {
        "email": lambda: pick([f"{word()}.{word()}", word(), f"{word()}{digits(2)}", f"{word()}.{digits(2)}"]) + "@" + pick([f"mail{digits(1)}.example.com", f"{word()}.{pick(['com', 'org', 'net', 'de', 'fr'])}", f"{word()}-{word()}.co"]),
        "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)),
        "card": card,
        "phone": phone,
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: (c := pick(["DE", "FR", "ES", "GB", "NL", "IT"]) + digits(2)) + pick([" " + " ".join(digits(4) for _ in range(4)) + " " + digits(2), digits(18)]),
    }
    other = [
        lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}",
        lambda: f"{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}",
        lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"{digits(1)}.{digits(2)}",
        lambda: f"${rng.integers(1, 9999)}.{digits(2)}",
        lambda: digits(int(rng.integers(1, 9))),
        lambda: digits(int(rng.integers(20, 30))),
        lambda: hexes(int(rng.integers(8, 41))),
        lambda: f'token = "{hexes(40)}"',
        lambda: f"version {digits(1)}.0",
        lambda: f"{digits(2)}/{digits(2)}/{digits(4)}",
        lambda: f"@{word()}",
        lambda: f"{word()}{digits(3)}",
        lambda: f"{digits(2)},{digits(3)},{digits(3)}",
        lambda: f"{digits(4)}-{digits(4)}",
        lambda: f"pp. {digits(3)}-{digits(3)}",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        if rng.random() < 0.3:
            text = digits(int(rng.integers(0, 4))) + word()[1:] + pick([" ", ". ", ", "])
        while len(text) < TRAIN_CHARS:
            u = rng.random()
            if u < 0.2:
                k = int(rng.integers(len(KINDS)))
                s = make[KINDS[k]]()
                spans.append((k, len(text), len(text) + len(s)))
            elif u < 0.34:
                s = pick(other)()
            else:
                s = word()
                s = s.capitalize() if rng.random() < 0.2 else s
            text += s + pick([" ", " ", " ", " ", ", ", ". ", "\n", "### ", "&&& ", "%%% ", "$$$ ", "*** "])
        cut = [(k, a, min(b, TRAIN_CHARS)) for k, a, b in spans if a < TRAIN_CHARS]
        out.append((text[:TRAIN_CHARS], cut))
    return out


_CHARS = {chr(c): c - 30 for c in range(32, 127)} | {"\n": 1}
N_CHARS = 100


def encode(text: str, size: int) -> np.ndarray:
    """Character classes: printable ASCII each, newline, other letters, all else; 0 after the end."""
    codes = [_CHARS.get(c) or (98 if c.isalpha() else 99) for c in text]
    return np.array(codes + [0] * (size - len(codes)), np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Labels 0 (outside), 2k + 1 (begin kind k) and 2k + 2 (inside kind k)."""

    def __init__(self, rng: np.random.Generator):
        n = 1 + 2 * len(KINDS)
        small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"E": rng.normal(0, 0.3, (N_CHARS, EMBED)).astype(np.float32), "O": small(2 * HIDDEN, n), "c": np.zeros(n, np.float32), "T": np.zeros((n, n), np.float32)}
        for way in "fb":
            self.p |= {f"W{way}": small(EMBED + HIDDEN, 4 * HIDDEN), f"v{way}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"v{way}"][HIDDEN : 2 * HIDDEN] = 1
        self.free = np.zeros((n, n), bool)
        for a in range(n):
            for b in range(n):
                self.free[a, b] = b == 0 or b % 2 == 1 or a in (b, b - 1)

    def _lstm(self, x: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """x: (time, batch, EMBED) in the order of reading; the states in that order."""
        W, v = self.p[f"W{way}"], self.p[f"v{way}"]
        drive = x @ W[:EMBED] + v
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)):
            z = drive[t] + h @ W[EMBED:]
            g = _sigmoid(z)
            u = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN : 3 * HIDDEN]
            before, c = c, f * c + i * u
            w = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, u, w))
            h = o * w
            out[t] = h
        return out

    def _lstm_back(self, x: np.ndarray, way: str, kept: list, d: np.ndarray, grad: dict) -> np.ndarray:
        W = self.p[f"W{way}"]
        dx, dh, dc = np.empty_like(x), np.zeros_like(d[0]), np.zeros_like(d[0])
        for t in range(len(x) - 1, -1, -1):
            h, before, i, f, o, u, w = kept[t]
            dh = dh + d[t]
            dc = dc + dh * o * (1 - w * w)
            dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * w * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            grad[f"W{way}"] += np.concatenate([x[t], h], axis=1).T @ dz
            grad[f"v{way}"] += dz.sum(axis=0)
            back = dz @ W.T
            dx[t], dh, dc = back[:, :EMBED], back[:, EMBED:], dc * f
        return dx

    def emit(self, codes: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """codes: (batch, time). Label scores (time, batch, labels), states, inputs."""
        x = self.p["E"][codes.T]
        states = np.concatenate([self._lstm(x, "f", keep and keep[0]), self._lstm(x[::-1], "b", keep and keep[1])[::-1]], axis=2)
        return states @ self.p["O"] + self.p["c"], states, x

    def step(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of the label sequences and its gradient."""
        keep: tuple[list, list] = ([], [])
        scores, states, x = self.emit(codes, keep)
        T, y, (n, b, m) = self.moves(), labels.T, scores.shape
        total = lambda z, axis: (top := z.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - top).sum(axis=axis))
        ahead, back = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        for t in range(1, n):
            ahead[t] = total(ahead[t - 1][:, :, None] + T[None], 1) + scores[t]
        for t in range(n - 2, -1, -1):
            back[t] = total(T[None] + (scores[t + 1] + back[t + 1])[:, None, :], 2)
        z = total(ahead[-1], 1)
        every = np.arange(b)
        gold = sum(scores[t, every, y[t]] for t in range(n)) + sum(T[y[t - 1], y[t]] for t in range(1, n))
        d = np.exp(ahead + back - z[None, :, None])
        for t in range(n):
            d[t, every, y[t]] -= 1
        d /= b
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, n):
            grad["T"] += np.exp(ahead[t - 1][:, :, None] + T[None] + (scores[t] + back[t])[:, None, :] - z[:, None, None]).sum(axis=0) / b
            np.add.at(grad["T"], (y[t - 1], y[t]), -1 / b)
        grad["O"], grad["c"] = np.einsum("tbh,tbm->hm", states, d), d.sum(axis=(0, 1))
        ds = d @ self.p["O"].T
        dx = self._lstm_back(x, "f", keep[0], ds[:, :, :HIDDEN], grad) + self._lstm_back(x[::-1], "b", keep[1], ds[::-1, :, HIDDEN:], grad)[::-1]
        np.add.at(grad["E"], codes.T, dx)
        return float((z - gold).mean()), grad

    def moves(self) -> np.ndarray:
        """The transition scores, forbidden ones far below all others."""
        return self.p["T"] + np.where(self.free, 0, -1e4).astype(np.float32)

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest label sequences (batch, time), and of each character how much its label and the move to it add over
        staying outside."""
        scores, _, _ = self.emit(codes)
        T = self.moves()
        best, came = scores[0], []
        for t in range(1, len(scores)):
            step = best[:, :, None] + T[None]
            came.append(step.argmax(axis=1))
            best = step.max(axis=1) + scores[t]
        out = [best.argmax(axis=1)]
        for back in reversed(came):
            out.append(back[np.arange(len(back)), out[-1]])
        labels = np.stack(out[::-1])
        gains = np.take_along_axis(scores, labels[:, :, None], 2)[:, :, 0] - scores[:, :, 0]
        gains[1:] += T[labels[:-1], labels[1:]] - T[0, 0]
        return labels.T, gains.T


def labels_of(spans: list[tuple[int, int, int]], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for k, a, b in spans:
        out[a:b] = 2 * k + 2
        out[a] = 2 * k + 1
    return out


@lru_cache(maxsize=2)
def train(samples: int = SAMPLES, seed: int = SEED) -> Tagger:
    """A tagger fitted with Adam on labelled samples, each seen once, the step falling to nothing. It depends on the arguments
    alone, so a process fits it once."""
    rng = np.random.default_rng(seed)
    tagger = Tagger(rng)
    rows = labelled_samples(samples, rng)
    codes = np.stack([encode(t, TRAIN_CHARS) for t, _ in rows])
    labels = np.stack([labels_of(s, TRAIN_CHARS) for _, s in rows])
    m, v = ({k: np.zeros_like(x) for k, x in tagger.p.items()} for _ in range(2))
    steps = samples // BATCH
    for k in range(steps):
        _, grad = tagger.step(codes[k * BATCH : (k + 1) * BATCH], labels[k * BATCH : (k + 1) * BATCH])
        scale = min(1.0, 5 / (np.sqrt(sum(float((g * g).sum()) for g in grad.values())) + 1e-9))
        for name, g in grad.items():
            m[name] = 0.9 * m[name] + 0.1 * g * scale
            v[name] = 0.99 * v[name] + 0.01 * (g * scale) ** 2
            tagger.p[name] -= RATE * (1 - k / steps) * (m[name] / (1 - 0.9 ** (k + 1))) / (np.sqrt(v[name] / (1 - 0.99 ** (k + 1))) + 1e-7)
    return tagger


def plausible(kind: str, s: str) -> bool:
    """What every span of a kind must have, whatever found it."""
    n = len(_digits(s))
    return {
        "email": lambda: re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", s) is not None,
        "ip": lambda: re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s) is not None and all(int(p) <= 255 for p in s.split(".")),
        "card": lambda: 13 <= n <= 19 and luhn(_digits(s)),
        "phone": lambda: 9 <= n <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", s) is not None and re.search(r"[ .)-]", s) is not None,
        "ssn": lambda: re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s) is not None,
        "iban": lambda: re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,36}", s) is not None and n >= 10,
    }[kind]()


_TRIGGER = re.compile("[0-9@]")


def window_starts(text: str) -> list[int]:
    """The windows of the grid that have a digit or an @; a span has one, so the others have no spans."""
    out: list[int] = []
    at = _TRIGGER.search(text)
    while at:
        k = at.start() // STRIDE
        out += [s * STRIDE for s in (k - 1, k) if s >= 0 and (not out or s * STRIDE > out[-1])]
        at = _TRIGGER.search(text, (k + 1) * STRIDE)
    return out


def reconcile(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """The spans (kind, start, end, gain) without overlap whose gains are the greatest together, by start. A span that several
    windows found counts with its greatest gain."""
    best: dict[tuple[int, int, str], float] = {}
    for kind, a, b, gain in spans:
        best[b, a, kind] = max(gain, best.get((b, a, kind), gain))
    ends, totals, took = [0], [0.0], [None]  # after each place where a taken span may end: the greatest total, and by which span
    for (b, a, kind), gain in sorted(best.items()):
        k = bisect_right(ends, a) - 1
        if totals[k] + gain > totals[-1]:
            ends.append(b)
            totals.append(totals[k] + gain)
            took.append((kind, a, b, k))
    out, k = [], len(took) - 1
    while took[k]:
        out.append(took[k][:3])
        k = took[k][3]
    return out[::-1]


def window_spans(labels: np.ndarray, gains: np.ndarray, size: int) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, gain) of the spans that the labels of one window tell."""
    a = 0
    while a < size:
        if labels[a] == 0:
            a += 1
            continue
        kind, b = (int(labels[a]) - 1) // 2, a + 1
        while b < size and labels[b] == 2 * kind + 2:
            b += 1
        yield KINDS[kind], a, b, float(gains[a:b].sum())
        a = b


def model_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """For each text the spans that the tagger finds: every window is decoded, a span that a window's edge cuts is joined with
    the neighbour's that meets it, and of all plausible ones of a text those are taken that reconcile chooses."""
    places = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    cut: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    for k in range(0, len(places), 256):
        part = places[k : k + 256]
        for (i, s), labels, gains in zip(part, *tagger.decode(np.stack([encode(texts[i][s : s + WINDOW], WINDOW) for i, s in part]))):
            size = min(WINDOW, len(texts[i]) - s)
            for kind, a, b, gain in window_spans(labels, gains, size):
                found[i].append((kind, s + a, s + b, gain))
                if (a == 0 and s > 0) or (b == size and s + size < len(texts[i])):
                    cut[i].append(found[i][-1])
    out = []
    for text, spans, pieces in zip(texts, found, cut):
        for (kind, a, b, gain), (kind2, a2, b2, gain2) in zip(pieces, pieces[1:]):
            if kind == kind2 and a < a2 <= b < b2:
                spans.append((kind, a, b2, gain + gain2))
        out.append(reconcile([s for s in spans if s[3] > 0 and plausible(s[0], text[s[1] : s[2]])]))
    return out


def find_personal_data(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id and `spans`, an array of (kind, start, end, base) by kind in the order of
    KINDS and then start; code points, end exclusive.

    base spans are the fixed patterns', matched left to right without overlap, failing matches dropped and not
    tried again. The tagger adds spans that overlap none of them. Null and empty texts have no spans; the whole
    text is read, whatever its length; repeated rows are read each; a null id stays null; other columns are
    ignored; an empty table gives no rows.
    """
    id_type = to_arrow_schema(docs.select(F.col(id_col).alias("id")).schema).field(0).type
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    rank = {k: n for n, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            column = pc.fill_null(batch.column(1), "")
            for row in range(0, len(column), 256):
                texts = column.slice(row, 256).to_pylist()
                for base, more in zip(map(base_spans, texts), model_spans(tagger, texts)):
                    added = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]
                    found.append(sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: (rank[s[0]], s[1])))
            rows = [[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array(rows, span_type)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        in_batches(docs)
        .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
        .withColumnRenamed("id", id_col)
    )


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def told_hash(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(told(spans).encode()).hexdigest()


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), train()).select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
