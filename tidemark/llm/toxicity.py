"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are rates that don't depend on its vocabulary's size:
how dense and how strong the words of a lexicon are, how near they stand to
words that address a second person, and rates of capitals, punctuation and
obfuscation.  The lexicon is learned: words, and beginnings of words, that
occur in far more toxic than other labelled documents.

Labelled documents form two halves.  Each half's features come from the
lexicon of the other half, and the calibration is fitted to scores that each
half gets from trees grown on the other, so neither sees its own labels.  The
final lexicon and trees are learned from both halves.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, fold, plus, released, slices, table, written
from tidemark.llm.pretokens import Cache

#: Labelled documents that the model learns from, about (the bound of the training sample).
SAMPLE = 24_000
#: Entries of a lexicon, and the fewest toxic documents that an entry must occur in.
LEXICON, FEWEST = 800, 4
#: A document of at least this score is predicted to be toxic.
THRESHOLD = 0.3

# Words that address a second person, in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus su sus".split())
# Characters that stand in for letters.
STAND_INS = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")
HIDDEN = re.compile(r"[^\W\d_][0-9@$!*]+[^\W\d_]")
SPACED = re.compile(r"(?:\b[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
MARKS, RUNS = re.compile(r"[!?]"), re.compile(r"([!?.*$#%&])\1{1,}")
NAMES = ("words", "hits", "density", "strength", "strongest", "distinct", "near_you", "you", "capitals", "shouted", "marks", "runs", "hidden", "hidden_hits", "spaced", "letters", "mean_length")


def keys(word: str) -> list[str]:
    """What a word is looked up by: itself and its beginnings of 3 to 8 letters."""
    return [word, *(f"^{word[:n]}" for n in range(3, min(len(word), 8) + 1))]


@dataclass
class Lexicon:
    """Weights (log odds) of words and beginnings."""

    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.cache = Cache(lambda words: [max((self.weights.get(k, 0.0) for k in keys(w)), default=0.0) for w in words], 300_000)

    def __getstate__(self) -> dict:
        return {"weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.weights = state["weights"]
        self.__post_init__()


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text, in the order of ``NAMES``."""
    lower = text.lower()
    words = WORD.findall(lower)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    lexicon.cache.fill(words)
    weights = list(map(lexicon.cache.__getitem__, words))
    at = [i for i, w in enumerate(weights) if w > 0]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0.0
    if at and you:
        places = np.array(you)
        spots = np.array(at)
        right = np.searchsorted(places, spots)
        gap = np.minimum(np.abs(spots - places[np.minimum(right, len(places) - 1)]), np.abs(spots - places[np.maximum(right - 1, 0)]))
        near = float((gap <= 4).mean())
    hidden = HIDDEN.findall(lower)
    hidden_hits = 0
    if hidden:
        plain = [w.translate(STAND_INS).replace("*", "") for w in words if HIDDEN.search(w)]
        hidden_hits = sum(any(k in lexicon.weights for k in keys(w)) for w in plain)
    chars, letters = len(text), sum(map(len, words))
    ups = sum(map(str.isupper, text)) if not text.isascii() else len(UPPER.findall(text))
    found = [weights[i] for i in at]
    return [
        math.log1p(n), math.log1p(len(at)), len(at) / n, sum(found) / n, max(found, default=0.0), float(len({words[i] for i in at})), near, len(you) / n,
        ups / chars, len(SHOUTED.findall(text)) / n, len(MARKS.findall(text)) / n, len(RUNS.findall(text)) / n, len(hidden) / n, hidden_hits / n, len(SPACED.findall(text)) / n if n else 0.0, letters / chars, letters / n,
    ]


UPPER, SHOUTED = re.compile("[A-Z]"), re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")


# Trees


@dataclass
class Trees:
    """Additive trees of equal depth over binned features; ``edges`` are the bins' bounds."""

    edges: list[np.ndarray]
    base: float
    splits: np.ndarray  # tree, node: feature
    cuts: np.ndarray  # tree, node: last bin that goes left
    leaves: np.ndarray  # tree, leaf: value

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for splits, cuts, leaves in zip(self.splits, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(leaves)))):
                node = 2 * node + 1 + (b[rows, splits[node]] > cuts[node])
            out += leaves[node - (len(leaves) - 1)]
        return out


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 1.0, fewest: float = 1.0, bins: int = 48) -> Trees:
    """Gradient boosting with Newton leaves for the logistic loss; no randomness."""
    p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Trees([np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])], math.log(p / (1 - p)), *(np.zeros((0, n), t) for n, t in ((2**depth - 1, np.int64), (2**depth - 1, np.int64), (2**depth, float))))
    if not len(x) or y.min() == y.max():
        return model
    b, raw = model.binned(x), np.full(len(x), model.base)
    splits, cuts, leaves = [], [], []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-raw))
        g, h = y - q, q * (1 - q)
        node, feature, cut = np.zeros(len(x), np.int64), np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins + 1, np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local, best = node - first, np.full(n, 1e-9)
            for k in range(x.shape[1]):
                width = bins + 1
                gs = np.bincount(local * width + b[:, k], g, n * width).reshape(n, width).cumsum(axis=1)
                hs = np.bincount(local * width + b[:, k], h, n * width).reshape(n, width).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < fewest) | (ht - hs < fewest)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(n), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + n][better], cut[first : first + n][better] = k, at[better]
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        raw += value[leaf]
        splits.append(feature)
        cuts.append(cut)
        leaves.append(value)
    model.splits, model.cuts, model.leaves = np.array(splits), np.array(cuts), np.array(leaves)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: raw scores and the calibrated values there, both rising; linear in between."""
    if not len(raw):
        return np.array([0.0]), np.array([0.0])
    points, back = np.unique(raw, return_inverse=True)
    weight = np.bincount(back).astype(float)
    blocks: list[list[float]] = []  # mean, weight, first point, last point
    for k, m in enumerate(np.bincount(back, y) / weight):
        blocks.append([m, weight[k], points[k], points[k]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, start, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, start, last])
    at = np.array([x for b in blocks for x in ((b[2], b[3]) if b[2] < b[3] else (b[2],))])
    # Shrunk a little to the whole's mean, so that no score is certain.
    mean = float(np.mean(y))
    value = np.array([(b[0] * b[1] + mean) / (b[1] + 1) for b in blocks for _ in range(1 + (b[2] < b[3]))])
    return at, np.maximum.accumulate(value)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    value: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each whole text; a null counts as empty."""
        x = np.array([features(t or "", self.lexicon) for t in texts], float).reshape(-1, len(NAMES))
        return np.clip(np.interp(self.trees.raw(x), self.at, self.value), 0, 1)


# Learning


def _lexicons(rows: DataFrame, text: str) -> list[Lexicon]:
    """Lexicons from half 0, from half 1, and from both; ``rows`` has _half, _label and the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int, int]] = Counter()
        for batch in batches:
            for half, label, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seen.update((k, half, label) for k in {k for w in set(WORD.findall((t or "").lower())) for k in keys(w)})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([2 * k[1] + k[2] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["key", "kind", "n"])

    total = {(r[0], r[1]): r[2] for r in rows.groupBy("_half", "_label").count().collect()}
    counted = rows.select("_half", "_label", text).mapInArrow(released(count), "key string, kind int, n long")
    of = lambda half, label: F.sum(F.when(F.col("kind") == 2 * half + label, F.col("n")).otherwise(0))
    sums = counted.groupBy("key").agg(*(of(h, l).alias(f"n{h}{l}") for h in (0, 1) for l in (0, 1)))  # noqa: E741
    sums = written(sums.where(F.col("n01") + F.col("n11") >= FEWEST), "lexicon")  # read three times
    out = []
    for halves in ((0,), (1,), (0, 1)):
        bad, fine = (sum(F.col(f"n{h}{label}") for h in halves) for label in (1, 0))
        all_bad, all_fine = (sum(total.get((h, label), 0) for h in halves) for label in (1, 0))
        odds = F.log((bad + 0.5) / (all_bad + 1.0)) - F.log((fine + 0.5) / (all_fine + 1.0))
        # The longest evidence first: log odds less a margin that shrinks with the count.
        rank = odds - 1.5 / F.sqrt(bad + 1.0)
        best = sums.select("key", odds.alias("odds"), rank.alias("rank"), bad.alias("bad")).where((F.col("bad") >= FEWEST) & (F.col("rank") >= 2.0))
        found = best.orderBy(F.desc("rank"), F.desc("bad"), "key").limit(LEXICON).collect()
        out.append(Lexicon({r["key"]: float(r["odds"]) for r in found}))
    drop_written(sums)
    return out


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` labelled documents, those with the smallest hashes of the id.

    Rows with a null label, id or text take no part.  If an id has several
    labels the largest counts; if it has several texts the first in order does.
    The driver gets features of the sample, never texts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.max(label) > 0).cast("int").alias("_label"))
    span, n = 1 << 30, known.count()
    share = min(span, int(span * sample / max(n, 1)) + 1)
    hashed = F.pmod(F.xxhash64(F.lit(10), F.col(key)), F.lit(span))
    few = known.where(hashed < share)  # about ``sample`` rows, so small enough to be sent to every executor
    rows = docs.where(F.col(text).isNotNull()).select(key, text).join(F.broadcast(few), key)
    rows = rows.groupBy(key).agg(F.first("_label").alias("_label"), F.min(text).alias(text))
    rows = rows.select(F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(2)).cast("int").alias("_half"), "_label", text).persist()
    try:
        lexicons = _lexicons(rows, text)
        shared = rows.sparkSession.sparkContext.broadcast(lexicons)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                halves, labels_, texts = (batch.column(i).to_pylist() for i in range(3))
                x = [features(t, shared.value[1 - h]) for h, t in zip(halves, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(halves, pa.int32()), pa.array(labels_, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["half", "label", "x"])

        found = sorted(map(tuple, rows.mapInArrow(released(measure), "half int, label int, x array<double>").collect()))
    finally:
        rows.unpersist()
    half, y = np.array([r[0] for r in found]), np.array([r[1] for r in found], float)
    x = np.array([r[2] for r in found], float).reshape(len(found), len(NAMES))
    raw = np.zeros(len(found))
    for h in (0, 1):
        raw[half == h] = grow(x[half != h], y[half != h]).raw(x[half == h])
    return Model(lexicons[2], grow(x, y), *isotonic(raw, y))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and score double, predicted int; columns with these names are replaced.

    Whole texts are scored; a null counts as empty and gets the score of a text
    without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            scores = shared.value.score(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(released(run), plus(docs, score="double", predicted="int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from labels of ids whose crc32 mod 4 isn't 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")
