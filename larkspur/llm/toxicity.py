"""Toxicity: noisy-channel deobfuscation, then a sparse logistic regression over the restored text.

A character language model (interpolated 4-grams over a to z and a boundary) is counted over the words of
every document: each task counts its own texts in one dense array, and the counts are summed by n-gram, so at
most 27**4 rows reach the driver whatever the corpus.

Spans that look disguised are decoded by Viterbi search over a lattice: a look-alike stands for a letter
("1d10t"), separators between letters are dropped ("i d i o t", "i.d.i.o.t") or part words ("y o u i d i o t"), runs of a repeated
letter shrink to one or two ("idiooot"). The language model scores the paths and the channel charges each
change. The search is exact: a state is what later costs depend on (three letters and the length of a run), and
none is pruned. All other words are taken as they are; a disguised word counts both as it stands and restored.

Features are the restored words, and their prefixes and suffixes of four to six characters, present or not in
the whole text. Those that best part the labelled sample are kept; a regression with L2 penalty weighs them.

Edge cases: a null text is an empty one and gets the model's score for no feature; repeated ids are separate
rows; labels with null id or label teach nothing; without labels of both classes every score is the share
of label 1 (0 without labels); empty tables give empty results; further columns pass through, and results whose names are taken get underscores added.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._common import append_scores, forget

#: Most labelled documents that the regression is fitted on.
SAMPLE = 12000
#: Features kept of those seen in the sample.
KEPT = 2000
SPACE_OF_FEATURES = 1 << 22
THRESHOLD = 0.3
A = 27

# The letters that a look-alike may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
SEPARATORS = " .-_~'`·"
#: Log cost of reading a look-alike, of dropping a repeated letter, of keeping a third and further one.
COST_LOOKALIKE, COST_DROP, COST_LONG = 1.5, 0.5, 6.0
#: Log cost of dropping one of two equal letters only.
COST_PAIR = 4.0
#: A run of more equal marks or digits than this is a divider and stands for itself.
DIVIDER = 16
#: Log cost of parting words at a separator, and of not doing so at two blanks in a span of single ones.
COST_PART, COST_JOIN = 1.0, 6.0
#: Longest span that is remembered.
SPAN = 256

_FOLDED = {"à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ø": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ý": "y", "ÿ": "y", "ß": "s"}
_SPACED = re.compile(r"(?<!\S)\S(?: {1,2}\S){2,}(?!\S)")
_CODES = np.zeros(0x250, np.uint8)
for _c in range(26):
    _CODES[97 + _c] = _CODES[65 + _c] = _c + 1
for _c, _to in _FOLDED.items():
    _CODES[ord(_c)] = ord(_to) - 96
    if len(_c.upper()) == 1:
        _CODES[ord(_c.upper())] = ord(_to) - 96

_PLAIN = {chr(i): int(c) for i, c in enumerate(_CODES) if c}
_WIDE = np.zeros(1 << 16, np.int32)
_WIDE[: len(_CODES)] = _CODES

# ---------------------------------------------------------------- the language model


def codes(text: str) -> np.ndarray:
    """0 for a boundary, 1 to 26 for a letter, of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _CODES[np.where(points < len(_CODES), points, 0)]


def count_grams(text: str, into: np.ndarray) -> None:
    c = _WIDE[np.frombuffer(("   " + text + " ").encode("utf-16-le", "replace"), np.uint16)]
    two = c[:-1] * np.int32(A) + c[1:]
    into += np.bincount(two[:-2] * np.int32(A * A) + two[2:], minlength=A**4)


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n: 4-grams of all texts."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(A**4, np.int64)
        for b in batches:
            held, size = [], 0
            for t in b.column(0).to_pylist():
                if t:
                    held.append(t)
                    size += len(t)
                if size > 4_000_000:
                    count_grams("\n\n\n".join(held), total)
                    held, size = [], 0
            if held:
                count_grams("\n\n\n".join(held), total)
        # nothing follows a boundary but a first letter
        total.reshape(A, A, A, A)[:, :, 0, 0] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(grams: DataFrame) -> np.ndarray:
    """Log probabilities (27, 27, 27, 27) of a letter after three."""
    got = grams.toArrow()
    n = np.zeros(A**4)
    n[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    n = n.reshape(A, A, A, A)
    p = (n.sum((0, 1, 2)) + 1) / (n.sum() + A)
    p = np.broadcast_to(p, (A, A))
    for counts in (n.sum((0, 1)), n.sum(0), n):
        kinds = (counts > 0).sum(-1, keepdims=True) + 1
        p = (counts + kinds * (p if p.ndim == counts.ndim else p[None])) / (counts.sum(-1, keepdims=True) + kinds)
    return np.log(p).astype(np.float32)


# ---------------------------------------------------------------- decoding


class Decoder:
    def __init__(self, lm: np.ndarray):
        self.lm = lm
        self.flat = lm.ravel()
        self.seen: dict[str, str] = {}

    def decode(self, span: str) -> str:
        """The likeliest words behind a disguised span, parted by blanks."""
        got = self.seen.get(span)
        if got is None:
            got = self._viterbi(span)
            if len(self.seen) > 100_000:
                self.seen.clear()
            if len(span) <= SPAN:
                self.seen[span] = got
        return got

    def _viterbi(self, span: str) -> str:
        flat = self.flat
        # a state is the last three letters and the length of the run they end in; its value: log score, and the text
        # as (text before, character), so that a long span costs no copies
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        raw, gaps, gap = [], [], ""
        for c in span:
            if c in SEPARATORS:
                gap += c
            else:
                raw.append(c)
                gaps.append(gap)
                gap = ""
        mixed = any(len(g) == 1 for g in gaps[1:])
        lengths = [n for _, same in groupby(raw) for n in [len(list(same))] for _ in range(n)]
        for i, (c, n, gap) in enumerate(zip(raw, lengths, gaps, strict=True)):
            if i and gap:
                wide = mixed and gap.isspace() and len(gap) > 1
                parted: dict[tuple[int, int], tuple[float, tuple | None]] = {}
                for (past, run), (score, text) in states.items():
                    joined = score - (COST_JOIN if wide else 0.0)
                    if (past, run) not in parted or joined > parted[past, run][0]:
                        parted[past, run] = (joined, text)
                    if past % A:
                        s = score - (0.0 if wide else COST_PART) + float(flat[past * A])
                        key = (past * A % A**3, 1)
                        if key not in parted or s > parted[key][0]:
                            parted[key] = (s, (text, " "))
                states = parted
            drop = COST_DROP if n > 2 else COST_PAIR
            plain = _PLAIN.get(c, 0)
            options = [(plain, c, 0.0)] if plain else []
            options += [(ord(x) - 96, x, COST_LOOKALIKE) for x in ("" if n > DIVIDER else LOOKALIKES.get(c, ""))]
            if not options:
                options = [(0, c, 0.0)]
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (past, run), (score, text) in states.items():
                last = past % A
                for code, char, cost in options:
                    repeat = code and code == last
                    s = score - cost + float(flat[past * A + code]) - (COST_LONG if repeat and run >= 2 else 0)
                    key = ((past * A + code) % A**3, min(run + 1, 3) if repeat else 1)
                    if key not in new or s > new[key][0]:
                        new[key] = (s, (text, char))
                    if repeat:
                        s = score - cost - drop
                        if (past, run) not in new or s > new[past, run][0]:
                            new[past, run] = (s, text)
            states = new
        text = max(((s + float(flat[past * A]), t) for (past, _), (s, t) in states.items()), key=lambda x: x[0])[1]
        out = []
        while text is not None:
            text, char = text
            out.append(char)
        return "".join(reversed(out))

    def restore(self, text: str) -> set[str]:
        """Distinct words of the text, lower case, and what letters spaced apart spell."""
        low = text.lower()
        words = set(low.split())
        words.update(w for m in _SPACED.findall(low) for w in self.decode(m).split())
        return words


_ODD = re.compile(r"[0-9@$!|+(€£¡*]|(.)\1\1|[^\W_][.\-_~·][^\W_]")
# all but word characters at the ends, except one look-alike that may be a first letter
_OUTSIDE = re.compile(r"^[^\w@$!|]+|^[^\w]+(?=[@$!|]\w)|[^\w]+$")
_EDGES = ".,;:!?\"'()[]{}<>«»“”‘’¡¿%&#*$|…"


def readings(word: str, decoder: Decoder) -> list[str]:
    """The forms of a word that features are made of: as it stands, and decoded where it looks disguised."""
    bare = word.strip(_EDGES)
    out = [bare] if bare else []
    inner = _OUTSIDE.sub("", word)
    if _ODD.search(inner) and any(map(str.isalpha, inner)):
        out += [w for w in dict.fromkeys(decoder.decode(inner).split()) if w != bare]
    return out


def _id(kind: str, part: str) -> int:
    return zlib.crc32(f"{kind}{part}".encode("utf-8", "replace")) % SPACE_OF_FEATURES


class Features:
    """Feature ids of words, those in ``among`` only if it is given. Remembers words and their ends."""

    def __init__(self, decoder: Decoder, among=None):
        self.decoder, self.among = decoder, among
        self.words: dict[str, tuple] = {}
        self.ends: dict[tuple[str, str], int | None] = {}

    def _end(self, kind: str, part: str) -> int | None:
        i = _id(kind, part)
        i = i if self.among is None or i in self.among else None
        if len(self.ends) > 500_000:
            self.ends.clear()
        self.ends[kind, part] = i
        return i

    def of(self, word: str) -> tuple:
        got = self.words.get(word)
        if got is None:
            out, ends = [], self.ends
            for w in readings(word, self.decoder):
                n = len(w)
                i = _id("w", w)
                if self.among is None or i in self.among:
                    out.append(i)
                for k, p, q in ((4, "p4", "s4"), (5, "p5", "s5"), (6, "p6", "s6")):
                    if n <= k:
                        break
                    for key in ((p, w[:k]), (q, w[-k:])):
                        i = ends[key] if key in ends else self._end(*key)
                        if i is not None:
                            out.append(i)
            got = tuple(out)
            if len(self.words) > 500_000:
                self.words.clear()
            self.words[word] = got
        return got

    def document(self, text: str) -> set[int]:
        return {i for ids in map(self.of, self.decoder.restore(text)) for i in ids}


# ---------------------------------------------------------------- the classifier

#: What a worker remembers of the words of one model, from task to task.
_remembered: dict[int, Features] = {}
forget["toxicity"] = _remembered.clear


@dataclass
class Model:
    lm: np.ndarray
    weights: dict[int, float]
    bias: float
    key: int = 0

    def __post_init__(self):
        self.key = zlib.crc32(repr((sorted(self.weights.items()), self.bias)).encode() + self.lm.tobytes())

    def features(self) -> Features:
        if self.key not in _remembered:
            _remembered.clear()
            _remembered[self.key] = Features(Decoder(self.lm), self.weights)
        return _remembered[self.key]

    def score(self, text: str) -> float:
        g = self.bias + sum(self.weights[i] for i in sorted(self.features().document(text)))
        return float(1 / (1 + np.exp(-min(max(g, -40.0), 40.0))))


def fit_sparse(rows: list[np.ndarray], y: np.ndarray, kept: int = KEPT, steps: int = 400, rate: float = 0.1, decay: float = 2e-4) -> tuple[dict[int, float], float]:
    """Weights of the kept features and the bias; rows: distinct feature ids of each document."""
    n1, n0 = float(y.sum()), float((1 - y).sum())
    if not n1 or not n0:
        share = n1 / max(1.0, n1 + n0)
        return {}, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    seen = np.zeros(SPACE_OF_FEATURES, np.int32)
    pos = np.zeros(SPACE_OF_FEATURES, np.int32)
    for r, label in zip(rows, y, strict=True):  # ids are distinct within a row
        seen[r] += 1
        if label:
            pos[r] += 1
    best = np.flatnonzero(seen >= 2)
    p, n = pos[best].astype(np.float64), (seen[best] - pos[best]).astype(np.float64)
    # difference of rates over its standard error; rare tells are to be worth more than common drifts
    rate1, rate0 = (p + 0.5) / (n1 + 1), (n + 0.5) / (n0 + 1)
    z = np.abs(rate1 - rate0) / np.sqrt(rate1 * (1 - rate1) / n1 + rate0 * (1 - rate0) / n0) * np.abs(np.log(rate1 / rate0))
    top = np.argsort(-z, kind="stable")[:kept]
    best = np.sort(best[top[z[top] > 1.5]])
    place = np.full(SPACE_OF_FEATURES, -1, np.int32)
    place[best] = np.arange(len(best))
    few = [place[r][place[r] >= 0] for r in rows]
    col, of = np.concatenate(few), np.repeat(np.arange(len(rows)), [len(r) for r in few])
    w, b = np.zeros(len(best)), float(np.log(n1 / n0))
    m, v = np.zeros(len(best) + 1), np.zeros(len(best) + 1)
    for t in range(1, steps + 1):
        g = np.bincount(of, weights=w[col], minlength=len(rows)) + b
        err = (1 / (1 + np.exp(-np.clip(g, -40, 40))) - y) / len(y)
        grad = np.concatenate([np.bincount(col, weights=err[of], minlength=len(best)) + decay * w, [err.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return {int(i): float(x) for i, x in zip(best, w, strict=True)}, b


def train(docs: DataFrame, labels: DataFrame, learn_from, lm: np.ndarray, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents, drawn by hash of the id.

    docs: doc_id, text. labels: doc_id, label. learn_from(column): which ids may be learnt from.
    """
    spark = docs.sparkSession
    ids = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn_from("doc_id"))
    drawn = [(r[0], r[1]) for r in ids.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not drawn:
        return Model(lm, {}, -40.0)
    small = spark.createDataFrame(drawn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int")

    def run(batches):
        import pyarrow as pa

        own = Features(Decoder(lm))
        for b in batches:
            x = [np.array(sorted(own.document(t or "")), np.int32).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["h", "label", "x"])

    rows = docs.join(F.broadcast(small), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "label", "text")
    got = rows.mapInArrow(run, "h long, label int, x binary").orderBy("h", "label", "x").limit(sample).toArrow()
    y = got.column("label").to_numpy().astype(np.float64)
    x = [np.frombuffer(r, np.int32) for r in got.column("x").to_pylist()]
    return Model(lm, *fit_sparse(x, y))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (double) and predicted (int) added; the columns given pass through."""
    return append_scores(docs, "text", "toxicity", lambda texts: np.array(list(map(model.score, texts)), np.float64), threshold)
