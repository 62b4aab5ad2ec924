"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The field has two states (clean, toxic) over the letter runs of a line; its
emissions are weights of the word, its prefixes and its suffix, so a word's
emission is computed once and cached. Token labels come from document labels:
in lines of toxic documents a token is toxic when one of its features occurs
in toxic lines significantly more often than chance (binomial tail, corrected
for the number of features). Forward-backward marginals are computed for all
lines of a batch at once; per document, their sum is calibrated to a score by a
logistic curve, and tokens with a marginal of one half or more are the
offending spans (code point offsets).

The model is fitted on the driver from at most `max_docs` labelled documents
of at most `max_chars` code points, taken in hash order; lines are cut into
runs of FIT_WORDS words for fitting only. Scoring reads whole texts.

Defined results: null and empty texts score as texts without toxic tokens;
repeated rows get the same score; without labels of both kinds every score is 0;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import unused

MAX_DOCS = 3000
MAX_CHARS = 50_000
FIT_WORDS = 200
FIT_LINES = 4000
CACHE_WORDS = 100_000
BATCH_TOKENS = 200_000
#: Bytes of the texts that are scored together; one text is never cut.
SLICE_BYTES = 1 << 20

WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself, its prefixes of three to seven letters and its last three letters."""
    return ["=" + word, *["^" + word[:k] for k in range(3, min(7, len(word) - 1) + 1)], "$" + word[-3:]]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    start: float = 0.0
    moves: tuple[float, float, float] = (0.0, 0.0, 0.0)  # clean-toxic, toxic-clean, toxic-toxic; clean-clean is 0
    curve: tuple[float, float] | None = None

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def chain(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, start: float, moves: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the forward messages (with emission) and the backward messages, for many sequences at once.

    Sequence k is e[starts[k] : starts[k] + lengths[k]]; lengths fall with k.
    """
    to1, from1, stay1 = (math.exp(m) for m in moves)
    a, b = np.empty_like(e), np.zeros_like(e)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else np.array([], dtype=int)
    state = None
    for t, k in enumerate(active):
        at = starts[:k] + t
        if t == 0:
            state = start + e[at]
        else:
            odds = np.exp(state[:k])
            state = e[at] + np.log((to1 + stay1 * odds) / (1.0 + from1 * odds))
        np.clip(state, -30, 30, out=state)
        a[at] = state
    for t in range(len(active) - 2, -1, -1):
        k = active[t + 1]
        at = starts[:k] + t
        odds = np.exp(np.clip(e[at + 1] + b[at + 1], -30, 30))
        b[at] = np.log((from1 + stay1 * odds) / (1.0 + to1 * odds))
    return a, b


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _tail(k: int, n: int, share: float) -> float:
    """Log of the chance of k or more hits out of n at the given share (Chernoff bound)."""
    p = k / n
    if p <= share:
        return 0.0
    rest = (n - k) * math.log((1 - p) / (1 - share)) if k < n else 0.0
    return -(k * math.log(p / share) + rest)


def _lines(texts: list[str], labels: list[int]) -> tuple[list[list[str]], list[int]]:
    """Distinct lines as words, with 1 where only toxic documents have them; lines that repeat earlier word pairs are left out."""
    seen: dict[str, int] = {}
    for text, label in zip(texts, labels, strict=True):
        for line in text.split("\n"):
            seen[line] = min(seen.get(line, 1), label)
    words, marks, pairs = [], [], set()
    for line, label in seen.items():
        w = [x.lower() for x in WORD.findall(line)]
        own = set(zip(w, w[1:], strict=False))
        if not w or len(w) >= 5 and 2 * len(own & pairs) > len(own):
            continue
        pairs |= own
        for at in range(0, len(w), FIT_WORDS):
            words.append(w[at : at + FIT_WORDS])
            marks.append(label)
    return words, marks


def fit(texts: list[str], labels: list[int], rounds: int = 60) -> Model:
    lines, marks = _lines(texts, labels)
    model = Model()
    if not any(marks) or all(marks):
        return model
    # which features mark toxic tokens
    every, toxic = Counter(), Counter()
    for words, mark in zip(lines, marks, strict=True):
        own = {f for w in set(words) for f in features(w)}
        every.update(own)
        if mark:
            toxic.update(own)
    share = sum(marks) / len(marks)
    tested = sum(1 for n in every.values() if n >= 3)
    telling = {f for f, k in toxic.items() if k >= 3 and _tail(k, every[f], share) + math.log(max(tested, 1)) < 0 and k >= 0.8 * every[f]}
    if not telling:
        return model
    # the chain is fitted on all lines with a telling token and an even choice of FIT_LINES others
    marked = {w for line in lines for w in line}
    marked = {w for w in marked if any(f in telling for f in features(w))}
    other = [k for k, line in enumerate(lines) if marked.isdisjoint(line)]
    dropped = set(other) - set(other[:: max(1, len(other) // FIT_LINES)])
    chosen = [(line, mark) for k, (line, mark) in enumerate(zip(lines, marks, strict=True)) if k not in dropped]
    lines, marks = map(list, zip(*sorted(chosen, key=lambda x: -len(x[0])), strict=True))
    kinds = {w: i for i, w in enumerate(dict.fromkeys(w for line in lines for w in line))}
    names: dict[str, int] = {}
    pairs = [(i, names.setdefault(f, len(names))) for w, i in kinds.items() for f in features(w) if every[f] >= 2]
    rows, cols = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
    told = np.array([w in marked for w in kinds], dtype=bool)
    lengths = np.array([len(line) for line in lines])
    starts = np.cumsum(lengths) - lengths
    token = np.fromiter((kinds[w] for line in lines for w in line), dtype=np.int64, count=int(lengths.sum()))
    y = told[token] & np.repeat(np.array(marks, dtype=bool), lengths)
    inside = np.ones(len(token), dtype=bool)
    inside[starts + lengths - 1] = False
    here = np.nonzero(inside)[0]
    pair_counts = np.array([(~y[here] & y[here + 1]).sum(), (y[here] & ~y[here + 1]).sum(), (y[here] & y[here + 1]).sum()], dtype=float)

    w, rest = np.zeros(len(names)), np.array([-6.0, 0.0, 0.0, 0.0, 0.0])  # bias, start, moves
    m, v = np.zeros(len(w) + 5), np.zeros(len(w) + 5)
    for step in range(1, rounds + 1):
        kind = rest[0] + np.bincount(rows, weights=w[cols], minlength=len(kinds))
        e = kind[token]
        moves = tuple(rest[2:])
        a, b = chain(e, starts, lengths, rest[1], moves)
        p = _sigmoid(a + b)
        missing = y - p
        by_kind = np.bincount(token, weights=missing, minlength=len(kinds))
        after = e[here + 1] + b[here + 1]
        scores = np.stack([np.zeros(len(here)), moves[0] + after, a[here] + moves[1], a[here] + moves[2] + after])
        scores = np.exp(scores - scores.max(axis=0))
        both = (scores / scores.sum(axis=0))[1:].sum(axis=1)
        gradient = np.concatenate([np.bincount(cols, weights=by_kind[rows], minlength=len(w)) - 0.05 * w, [missing.sum(), missing[starts].sum()], pair_counts - both - 0.5 * rest[2:]])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, rest = w + move[:-5], rest + move[-5:]
    model.weights = {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 0.01}
    model.bias, model.start, model.moves = float(rest[0]), float(rest[1]), tuple(float(x) for x in rest[2:])
    sums = np.log(np.array([s for s, _ in Scorer(model).texts(texts)]) + 1e-6)
    model.curve = _logistic(sums, np.array(labels, dtype=float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by ridge-stabilised Newton steps."""
    design = np.stack([np.ones_like(x), x], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(design @ beta)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-2])
        beta = beta + np.linalg.solve(hessian, design.T @ (y - p) - np.array([1e-3, 1e-2]) * beta)
    return float(beta[0]), float(max(beta[1], 0.0))


class Scorer(dict):
    """Scores whole texts; the dictionary holds emissions of words, bounded in number."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self.model.emission(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def score(self, total: float) -> float:
        if self.model.curve is None:
            return 0.0
        a, b = self.model.curve
        return float(_sigmoid(a + b * math.log(total + 1e-6)))

    def texts(self, texts: list[str]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """Per text, the sum of the marginals and the offending spans (start, end, probability)."""
        out: list[tuple[float, list[tuple[int, int, float]]]] = []
        batch: list[tuple[str, list[list[str]]]] = []
        held = 0
        for text in texts:
            lines = [WORD.findall(line.lower()) for line in text.split("\n")]
            batch.append((text, lines))
            held += sum(map(len, lines))
            if held >= BATCH_TOKENS:
                out += self._batch(batch)
                batch, held = [], 0
        return out + self._batch(batch)

    def _batch(self, batch: list[tuple[str, list[list[str]]]]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        lines = [line for _, own in batch for line in own]
        lengths = np.array([len(line) for line in lines], dtype=np.int64)
        e = np.fromiter((self[w] for line in lines for w in line), dtype=np.float64, count=int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        p = np.empty_like(e)
        if len(order):
            a, b = chain(e, starts[order], lengths[order], self.model.start, self.model.moves)
            p = _sigmoid(a + b)
        out, at = [], 0
        for text, own in batch:
            n = sum(map(len, own))
            mine, at = p[at : at + n], at + n
            spans: list[tuple[int, int, float]] = []
            hot = np.nonzero(mine >= 0.5)[0]
            if len(hot):
                wanted, places = set(hot.tolist()), WORD.finditer(text)
                spans = [(m.start(), m.end(), float(mine[k])) for k, m in enumerate(places) if k in wanted]
            out.append((float(mine.sum()), spans))
        return out


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of successive texts of `most` bytes together or a single one."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = held = 0
    for k, size in enumerate(sizes):
        if k > at and held + size > most:
            yield at, k - at
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes) - at


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on at most max_docs labelled documents outside the held-out fifth."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    # one text per document, so max_docs rows at most, and the same ones in every run
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    return fit([r[1] for r in rows], [r[2] for r in rows])


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())])))])


def tagged(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and, last, a struct column toxicity (score, spans); it has underscores in front where docs has a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(unused(docs.columns, "toxicity")[0], RESULT)])
    place = docs.columns.index("text")
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at, n in slices(batch.column(place)):
                part = batch.slice(at, n)
                found = scorer.texts([t or "" for t in part.column(place).to_pylist()])
                column = pa.array([{"score": scorer.score(s), "spans": [dict(zip(("start", "end", "probability"), x, strict=True)) for x in spans]} for s, spans in found], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, column], schema.names)

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = F.col("toxicity.score")
    return tagged(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.size("toxicity.spans").cast("long").alias("n_spans"))


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored one half or more go.

    Null and empty texts are judged as texts without toxic tokens; repeated rows are judged alike; extra columns
    stay as they are; an empty table stays empty.
    """
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = tagged(docs, model)
    return found.where(F.col(found.columns[-1])["score"] < 0.5).drop(found.columns[-1])


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
