"""Operator 6: toxic spans by a linear-chain conditional random field, aggregated to documents.

Tokens are runs of letters of the text as it stands, lower-cased one by one (so that offsets hold where
lower case has another length); sentences (at most ``SENTENCE`` tokens) are the chains.  The
field has two states per token (toxic or not), a feature for the evidence bin of the token and of
its two neighbours, and transitions.  Token labels come from the labelled documents: a token of a
toxic document is labelled toxic if its word occurs far more often in toxic than in other training
documents, in many different contexts (so that copies of one document do not make a word).
Forward-backward marginals give each token's probability; a document's score is a logistic
combination of its largest marginal and the sum of its marginals, fitted to the document labels, and
the offending offsets are the runs of tokens above ``SPAN``.

Fitting uses a bounded sample of labelled rows outside the held-out fold: about ``TRAIN_ROWS`` rows
(half of them toxic, if there are as many) for the word evidence, of which about ``FIT_ROWS`` fit the
field.  The sampled ids are broadcast (``TRAIN_ROWS`` bounds them), the model is a word list of at
most ``WORDS`` entries and a few weights.  Scoring is row-wise over all documents and whole texts.

Defined results: null and empty texts get the score of no evidence; several labels of a document
count as toxic if one does; without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import text_or_empty
from .language_id import held_out

TRAIN_ROWS = 20_000
FIT_ROWS = 1_200
WORDS = 2_000
CONTEXTS = 6  # of 64: different preceding words, hashed
LOG_ODDS = 2.0
BINS = (1.0, 2.0, 3.0, 4.0, 6.0)  # log-odds at which the evidence bin rises
SENTENCE = 64
SPAN = 0.5
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_WORD_OR_END = re.compile(r"[^\W\d_]+|[.!?\n]")
WORD_PATTERN = r"\p{L}+"


def _fold_rows(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, toxic) of about TRAIN_ROWS labelled ids outside the held-out fold, by the hash of the id."""
    t = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
         .filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("id"))
         .groupBy("id").agg(F.max("toxic").alias("toxic")))
    n = {r["toxic"]: r["n"] for r in t.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    unit = F.pmod(F.xxhash64(F.lit("toxic"), "id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    share = F.when(F.col("toxic") == 1, TRAIN_ROWS / 2 / max(n.get(1, 0), 1)).otherwise(
        TRAIN_ROWS / 2 / max(n.get(0, 0), 1))
    fit = F.when(F.col("toxic") == 1, FIT_ROWS / 2 / max(min(n.get(1, 0), TRAIN_ROWS / 2), 1)).otherwise(
        FIT_ROWS / 2 / max(min(n.get(0, 0), TRAIN_ROWS / 2), 1))
    return t.withColumn("unit", unit).filter(F.col("unit") < share).withColumn(
        "fits", F.col("unit") < share * fit).select("id", "toxic", "fits"), n


def word_evidence(train: DataFrame) -> dict[str, float]:
    """Log-odds of the words that mark toxic documents, from (text, toxic) rows: at most WORDS."""
    words = F.transform(F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)), F.lower)
    t = train.select("toxic", words.alias("w")).select("toxic", F.posexplode("w").alias("i", "word"), "w")
    before = F.when(F.col("i") > 0, F.get("w", F.col("i") - 1)).otherwise(F.lit(""))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(before), F.lit(64)).cast("int"))
    counts = t.select("toxic", "word", bit.alias("bit")).groupBy("word").agg(
        F.sum("toxic").alias("nt"), F.sum(1 - F.col("toxic")).alias("nc"),
        F.bit_count(F.bit_or(F.when(F.col("toxic") == 1, F.col("bit")).otherwise(F.lit(0).cast("long")))).alias("contexts"))
    total = train.groupBy("toxic").agg(F.sum(F.size(words)).alias("n")).collect()  # two rows
    n = {r["toxic"]: r["n"] or 0 for r in total}
    odds = (F.log((F.col("nt") + 0.5) / (n.get(1, 0) + 1.0)) - F.log((F.col("nc") + 0.5) / (n.get(0, 0) + 1.0)))
    best = (counts.filter(F.col("contexts") >= CONTEXTS).withColumn("odds", odds).filter(F.col("odds") >= min(BINS))
            .orderBy(F.col("odds").desc(), "word").limit(WORDS).collect())
    return {r["word"]: r["odds"] for r in best}


def sentences(text: str, evidence: dict[str, int]) -> list[list[int]]:
    """Evidence bins of the tokens, sentence by sentence."""
    out, current = [], []
    if "\u0130" in text or "\u03a3" in text:  # of all letters these two alone lower-case otherwise within a text
        tokens = map(str.lower, _WORD_OR_END.findall(text))
    else:
        tokens = _WORD_OR_END.findall(text.lower())
    for w in tokens:
        if w in ".!?\n":
            if current:
                out.append(current)
                current = []
        else:
            current.append(evidence.get(w, 0))
            if len(current) == SENTENCE:
                out.append(current)
                current = []
    if current:
        out.append(current)
    return out


class Chain:
    """Two-state linear chain: ``emit[bin, place]`` for toxic against not, and ``move[2, 2]``."""

    def __init__(self, bins: int):
        self.emit = np.zeros((3, bins))
        self.bias = np.array([-2.0])
        self.move = np.zeros((2, 2))

    def parts(self) -> list[np.ndarray]:
        return [self.emit, self.bias, self.move]

    def potentials(self, x: np.ndarray) -> np.ndarray:
        """x: (sentences, steps) bins, -1 beyond the end."""
        at = np.maximum(x, 0)
        left = np.concatenate([np.zeros((len(x), 1), int), at[:, :-1]], axis=1)
        right = np.concatenate([at[:, 1:], np.zeros((len(x), 1), int)], axis=1)
        return self.bias[0] + self.emit[0][at] + self.emit[1][left] + self.emit[2][right]

    def marginals(self, x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(probability of toxic at each step, expected transitions), by forward-backward."""
        weight = np.ones(len(x)) if weight is None else weight
        phi, here = self.potentials(x), x >= 0
        n, steps = x.shape
        node = np.ones((n, steps, 2))
        node[:, :, 1] = np.exp(np.clip(phi, -30, 30))
        move = np.exp(self.move)
        alpha, beta = np.empty((n, steps, 2)), np.ones((n, steps, 2))
        alpha[:, 0] = node[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            a = (alpha[:, t - 1] @ move) * node[:, t]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, t] = np.where(here[:, t, None], a, alpha[:, t - 1])
        pair = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            ahead = node[:, t + 1] * beta[:, t + 1]
            b = ahead @ move.T
            joint = alpha[:, t, :, None] * move[None] * ahead[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pair += np.tensordot(weight * here[:, t + 1], joint, 1)
            b /= b.sum(axis=1, keepdims=True)
            beta[:, t] = np.where(here[:, t + 1, None], b, 1.0)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        return np.where(here, p[:, :, 1], 0.0), pair

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        p, pair = self.marginals(x, weight)
        here, at = x >= 0, np.maximum(x, 0)
        diff = np.where(here, y - p, 0.0) * weight[:, None]
        bins = self.emit.shape[1]
        emit = np.zeros_like(self.emit)
        emit[0] = np.bincount(at.ravel(), diff.ravel(), bins)
        emit[1] = np.bincount(at[:, :-1].ravel(), diff[:, 1:].ravel(), bins)
        emit[2] = np.bincount(np.where(here, at, 0)[:, 1:].ravel(), diff[:, :-1].ravel(), bins)
        both = here[:, 1:]
        steps = (y[:, :-1] * 2 + y[:, 1:])[both].astype(int)
        seen = np.bincount(steps, np.broadcast_to(weight[:, None], both.shape)[both], 4).reshape(2, 2)
        return [emit, np.array([diff.sum()]), seen - pair]

    def fit(self, x: np.ndarray, y: np.ndarray, turns: int = 150, rate: float = 0.1, ridge: float = 1.0) -> None:
        """Adam on the penalised likelihood; equal sentences (most hold no evidence) count as one with a weight."""
        both, weight = np.unique(np.concatenate([x, y], axis=1), axis=0, return_counts=True)
        x, y, weight = both[:, :x.shape[1]], both[:, x.shape[1]:], weight.astype(float)
        m = [np.zeros_like(w) for w in self.parts()]
        v = [np.zeros_like(w) for w in self.parts()]
        for t in range(1, turns + 1):
            for w, g, a, b in zip(self.parts(), self.gradient(x, y, weight), m, v):
                g = g - ridge * w
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w += rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.99 ** t)) + 1e-8)


def padded(rows: list[list[int]]) -> np.ndarray:
    x = np.full((len(rows), max(map(len, rows))), -1)
    for i, r in enumerate(rows):
        x[i, :len(r)] = r
    return x


class Model:
    """Word evidence bins, the chain, and the document weights."""

    def __init__(self, words: dict[str, float]):
        self.bins = {w: int(np.searchsorted(BINS, o, side="right")) for w, o in words.items()}
        self.strong = {w for w, o in words.items() if o >= LOG_ODDS}
        self.chain = Chain(len(BINS) + 1)
        self.weights = np.zeros(3)
        self.plain: dict[int, np.ndarray] = {}

    def marginals(self, rows: list[list[int]]) -> list[np.ndarray]:
        """Marginals of each sentence; sentences without evidence depend on their length alone."""
        out: list = [None] * len(rows)
        rest = []
        for i, r in enumerate(rows):
            if any(r):
                rest.append(i)
                continue
            n = len(r)
            if n not in self.plain:
                self.plain[n] = self.chain.marginals(np.zeros((1, n), int))[0][0]
            out[i] = self.plain[n]
        if rest:
            p, _ = self.chain.marginals(padded([rows[i] for i in rest]))
            for j, i in enumerate(rest):
                out[i] = p[j, :len(rows[i])]
        return out

    @staticmethod
    def summary(p: list[np.ndarray]) -> np.ndarray:
        """Largest marginal and the log of the sum of the marginals above one half."""
        if not p:
            return np.zeros(2)
        allp = np.concatenate(p)
        return np.array([allp.max(), np.log1p(allp[allp >= SPAN].sum())])

    def score(self, summary: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.weights[0] + self.weights[1:] @ summary))))

    def fit(self, texts: list[str], toxic: list[int], odds_of_prior: float) -> None:
        docs = [sentences(t or "", self.bins) for t in texts]
        strong = {b for w, b in self.bins.items() if w in self.strong}
        rows, marks = [], []
        for doc, z in zip(docs, toxic):
            for r in doc:
                rows.append(r)
                marks.append([int(z and b in strong) for b in r])
        if rows and any(map(any, marks)):
            x = padded(rows)
            y = np.where(x >= 0, padded(marks), 0)
            self.chain.fit(x, y)
        s = np.array([self.summary(self.marginals(d)) for d in docs])
        design, z, w = np.column_stack([np.ones(len(s)), s]), np.array(toxic, float), np.zeros(3)
        for _ in range(30):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-design @ w))
            h = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(3)
            w += np.linalg.solve(h, design.T @ (z - p) - 0.05 * w)
        w[0] += odds_of_prior  # the sample holds as many toxic as other rows
        self.weights = w

    def spans(self, text: str, p: list[np.ndarray]) -> list[tuple[int, int]]:
        """Offsets of runs of tokens whose marginal reaches SPAN."""
        flags = np.concatenate(p) >= SPAN if p else np.zeros(0, bool)
        if not flags.any():
            return []
        out: list[tuple[int, int]] = []
        last = -2
        for i, m in enumerate(_WORD.finditer(text)):
            if i < len(flags) and flags[i]:
                if last == i - 1 and out:
                    out[-1] = (out[-1][0], m.end())
                else:
                    out.append((m.start(), m.end()))
                last = i
        return out


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          label_col: str = "toxic") -> Model | None:
    rows, n = _fold_rows(labels, id_col, label_col)
    if not n.get(0) or not n.get(1):
        return None
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    train = own.join(F.broadcast(rows), "id")
    model = Model(word_evidence(train))
    sample = train.filter("fits").select("id", "text", "toxic").collect()  # about FIT_ROWS rows
    sample.sort(key=lambda r: (r["id"], r["text"]))
    if not sample:
        return None
    drawn = sum(r["toxic"] for r in sample)
    drawn_odds = np.log((drawn + 0.5) / (len(sample) - drawn + 0.5))
    model.fit([r["text"] for r in sample], [r["toxic"] for r in sample], np.log(n[1] / n[0]) - drawn_odds)
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) with score and spans (array of [start, end) of toxic runs)."""
    names = docs.columns
    out = columns if columns is not None else names
    t = docs.toDF(*[f"c{i}" for i in range(len(names))])
    t = t.select(*[f"c{names.index(c)}" for c in out], F.col(f"c{names.index(text_col)}").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py() or ""
                if m is None:
                    scores.append(0.0), spans.append([])
                    continue
                p = m.marginals(sentences(text, m.bins))
                scores.append(m.score(m.summary(p)))
                spans.append([{"start": a, "end": b} for a, b in m.spans(text, p)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(spans, span)],
                                             names=[*batch.schema.names[:-1], "score", "spans"])

    added = StructType.fromDDL("score double, spans array<struct<start:int,end:int>>")
    schema = StructType([*t.drop("t").schema.fields, *added.fields])
    return t.mapInArrow(run, schema).toDF(*out, "score", "spans")
