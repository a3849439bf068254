"""Toxicity (operator 8): maximum-scoring segment search over token log-odds.

Fit: tokens of labelled documents (words in ASCII lower case without outer punctuation, and the beginnings of words)
get the log-odds of standing in a toxic rather than a clean document, under a Dirichlet prior worth PRIOR_SHARE of the
training documents (PRIOR_LEAST at least), spread as the tokens are in all of them. Tokens whose log-odds are Z standard
deviations above zero score their lower bound; a word scores its highest token, and -DRIFT without one. Near copies
(equal two-fold minimum hash of their shingles of SHINGLE words) are counted once.

Score: Ruzzo and Tompa's linear scan finds all maximal scoring segments of a whole text. Segment scores of clean texts
follow an extreme-value law, P(max > x) = 1 - exp(-K n exp(-lambda x)); lambda solves E[exp(lambda s)] = 1 for the word
scores of clean training documents, and K is fitted to their maxima. Segments with an expected count below
SIGNIFICANT are the toxic passages; a document's evidence is -log of the p-value of the sum of its highest segment
scores (for the best number of them, up to all), turned into a probability by a logistic fit on the training documents.

At most MAX_TRAIN labelled rows are used (beyond that an even sample, the first by hash), a parameter; the tokens of the
model are those of these rows, of which every significant one is kept. Every document is scored, over its whole text.

Defined results: a null or empty text scores like a text without a scoring word; a null doc_id is not held out; without
labels of both classes every document scores the (smoothed) share of toxic labels; repeated labels of a document count
once (toxic if any says so); repeated rows get equal results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, discard, give_back, importable, slices, stored

MAX_TRAIN = 200_000
SHINGLE = 4
PRIOR_SHARE, PRIOR_LEAST, Z, DRIFT = 0.1, 5.0, 4.0, 1.0
SIGNIFICANT = 0.01
#: Least score of a token. What is only a little commoner in toxic texts, as the words around toxic ones are, becomes
#: significant with enough labels; hundreds of such tokens make segments in every long clean text.
LEAST_SCORE = 1.0
FOLDS = 5
#: Bytes of the beginnings of words that are tokens of their own.
PREFIXES = (4, 5, 6, 7, 8)
#: Words whose scores a Python worker keeps.
CACHE = 250_000
STRIP = b".,;:!?\"'()[]{}<>*%&#$|"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return [w.strip(STRIP) or w for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]


def tokens_of(word: bytes) -> list[bytes]:
    """The word and its beginnings of PREFIXES bytes, which stand for compounds and endings that were never seen."""
    return [word, *(b"^" + word[:n] for n in PREFIXES if len(word) >= n)]


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, end word) where hits are (place, score) in order and all other
    words score -drift: each hit is one step of the linear scan, the words between two hits one negative step."""
    found: list[list] = []  # [left sum, right sum, first, end, chain]: chain is the nearest earlier one with a smaller left sum
    total, at = 0.0, 0
    for place, score in hits:
        total -= drift * (place - at)
        at = place + 1
        left, total = total, total + score
        first = place
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][0] >= left:
                k = found[k][4]
            if k < 0 or found[k][1] >= total:
                found.append([left, total, first, at, k])
                break
            left, first = found[k][0], found[k][2]
            chain = found[k][4]
            del found[k:]
            k = chain
    return [(r - le, a, b) for le, r, a, b, _ in found]


class Known(dict):
    """The highest score of a word's tokens, 0 if none has one, by the word as it stands in the text."""

    def __init__(self, scores: dict[bytes, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: bytes) -> float:
        got = max(self.scores.get(t, 0.0) for t in tokens_of(word.strip(STRIP) or word))
        if len(word) <= 64:  # longer ones are not kept
            self[word] = got
        return got


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0
    scale: float = 1.0
    weight: float = 0.0
    bias: float = 0.0

    known: Known | None = field(default=None, repr=False, compare=False)

    def passages(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        if self.known is None or len(self.known) > CACHE:
            self.known = Known(self.scores)
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        hits = [(i, s) for i, s in enumerate(map(self.known.__getitem__, words)) if s] if self.scores else []
        return len(words), segments(hits)

    def expected(self, score: float, n: int) -> float:
        """Segments of at least this score expected by chance in a clean text of n words."""
        return self.scale * max(n, 1) * math.exp(-self.rate * score)

    def evidence(self, n: int, found) -> float:
        """-log of the chance that a clean text of n words has segments as high as these, by the sum statistic of its r
        highest normalised scores, for the best r; 0 without a segment."""
        base = max(0.0, math.log(self.scale * max(n, 1)))
        best = total = 0.0
        for r, score in enumerate(sorted((s for s, _, _ in found), reverse=True), 1):
            total += self.rate * score - base
            if total <= 0:
                break
            if r == 1:
                x = -math.log(-math.expm1(-math.exp(-total))) if total < 30 else total
            else:  # P(sum of r >= x) = exp(-x) x^(r-1) / (r! (r-1)!)
                x = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r)
            best = max(best, x)
        return min(best, 200.0)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.weight * evidence + self.bias))))


def _train_rows(docs: DataFrame, labels: DataFrame, label: str, max_train: int) -> DataFrame:
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    own = own.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = own.count()
    if n > max_train:
        share = int(1_000_000 * min(1.0, 1.2 * max_train / n)) + 1
        order = F.xxhash64("doc_id", F.lit("train"))
        own = own.filter(F.pmod(order, F.lit(1_000_000)) < share).orderBy(order, "doc_id").limit(max_train)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id")


def sketch(text: str | None) -> int:
    """Two minima of hashes of a text's shingles, as one number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.array(list(map(crc32, words)) or [0], np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    h = np.pad(h, (0, max(0, SHINGLE - len(h))))
    mixed = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    x, y = ((mixed * np.uint64(m) >> np.uint64(16)).min().item() for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    return (x << 16 ^ y) % (1 << 63)


def _sketch(batches):
    """The rows with their sketch."""
    for b in slices(batches, 1000):
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(sketch, b.column(1).to_pylist()), pa.int64())], ["doc_id", "text", "y", "sketch"])


def _count(batches):
    """(word, toxic, clean): documents that hold a token, summed over some rows; the empty token counts documents."""
    for b in slices(batches, 1000):
        toxic, clean = Counter(), Counter()
        for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            (toxic if y else clean).update({b"", *(x for w in set(words_of(t)) for x in tokens_of(w))})
        words = list(toxic | clean)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], ["word", "toxic", "clean"])
    toxic = clean = words = None
    give_back()


def _segments(shared):
    """Per training document its label, number of words and segment scores, the highest first."""

    def run(batches):
        model = shared.value
        for b in batches:
            rows = [model.passages(t) for t in b.column(1).to_pylist()]
            best = [sorted((s for s, _, _ in found), reverse=True) for _, found in rows]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([n for n, _ in rows], pa.int64()), pa.array(best, pa.list_(pa.float64()))], ["y", "n", "best"])
        model.known = rows = best = None
        give_back()

    return run


def _evidence(model: Model):
    """Over what _segments gives: label and evidence."""

    def run(batches):
        for b in batches:
            x = [model.evidence(n, [(s, 0, 0) for s in best]) for n, best in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.float64())], ["y", "x"])

    return run


def _positive_root(values: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with E[exp(lambda s)] = 1, for scores of negative mean of which some are positive."""
    low, high = 0.0, 1.0
    f = lambda x: float(weights @ np.exp(np.minimum(x * values, 700))) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 500) -> tuple[float, float]:
    """Weight and bias of a weighted logistic fit with a slight penalty, by Newton's method. A step is halved until the
    loss, which is convex, falls enough: between classes that x all but separates full steps overshoot and do not return."""
    x1 = np.stack((x, np.ones_like(x)), 1)
    loss = lambda w: float(n @ (np.logaddexp(0, x1 @ w) - y * (x1 @ w))) + 5e-3 * w[0] ** 2
    w = np.zeros(2)
    at = loss(w)
    for _ in range(rounds):
        p = np.exp(-np.logaddexp(0, -(x1 @ w)))
        g = x1.T @ (n * (p - y)) + 1e-2 * w * np.array([1, 0])
        h = (x1 * (n * p * (1 - p))[:, None]).T @ x1 + 1e-6 * np.eye(2) + np.diag([1e-2, 0])
        step = np.linalg.solve(h, g)
        share, gain = 1.0, float(g @ step)
        while share > 1e-12 and (new := loss(w - share * step)) > at - 1e-4 * share * gain:
            share /= 2
        if share <= 1e-12 or gain < 1e-12:
            break
        w, at = w - share * step, new
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    spark = docs.sparkSession
    importable(spark)
    train = _train_rows(docs, labels, label, max_train).select("doc_id", "text", "y")
    train = stored(train.mapInArrow(_sketch, "doc_id long, text string, y int, sketch long"))  # read four times
    try:
        return _fit(spark, train)
    finally:
        discard(train)


def _fit(spark, train: DataFrame) -> Model:
    """A model of stored rows (doc_id, text, y, sketch)."""
    keep = F.broadcast(train.groupBy("sketch", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))  # at most max_train ids
    counts = train.join(keep, "doc_id", "left_semi").select("doc_id", "text", "y").mapInArrow(_count, "word binary, toxic long, clean long")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counts = cut(counts.filter((F.col("t") >= 2) | (F.col("word") == F.lit(b""))))
    total = counts.filter(F.col("word") == F.lit(b"")).collect()
    n_t, n_c = (total[0]["t"], total[0]["c"]) if total else (0, 0)
    model = Model(bias=math.log((n_t + 0.5) / (n_c + 1.5)))
    if not n_t or not n_c:
        return model
    strength = max(PRIOR_LEAST, PRIOR_SHARE * (n_t + n_c))
    prior = F.lit(strength) * (F.col("t") + F.col("c")) / (n_t + n_c)
    a, b = F.col("t") + prior, F.col("c") + prior
    odds = F.log(a / (F.lit(n_t + strength) - a)) - F.log(b / (F.lit(n_c + strength) - b))
    sd = F.sqrt(1 / a + 1 / b)
    terms = counts.filter(F.col("word") != F.lit(b"")).filter((a < n_t + strength) & (b < n_c + strength))
    terms = terms.select("word", "c", odds.alias("odds"), sd.alias("sd"), b.alias("b")).filter((F.col("odds") > Z * F.col("sd")) & (F.col("odds") - F.col("sd") >= LEAST_SCORE))
    got = terms.orderBy("word").collect()  # tokens of at most max_train rows
    if not got:
        return model
    model.scores = {bytes(r["word"]): r["odds"] - r["sd"] for r in got}
    train = train.select("doc_id", "text", "y")
    # The law of word scores in clean documents: the share of documents that hold a word, over the words of a document.
    mean_n = train.filter("y = 0").select(F.avg(F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")))).collect()[0][0] or 1.0
    s = np.array([r["odds"] - r["sd"] for r in got])
    p = np.array([r["b"] for r in got]) / (n_c + strength) / max(mean_n, 1.0)
    p = np.minimum(p, 0.5 / len(p))
    model.rate = _positive_root(np.append(s, -DRIFT), np.append(p, 1 - p.sum()))
    shared = spark.sparkContext.broadcast(model)
    seen = train.mapInArrow(_segments(shared), "y int, n long, best array<double>")
    seen = cut(seen)
    # K from the mean of n * exp(-lambda * best) over clean documents with a segment: E[K n e^(-lambda max)] = 1 under the law.
    k = seen.filter("y = 0 AND size(best) > 0").select(F.avg(F.col("n") * F.exp(-model.rate * F.col("best")[0]))).collect()[0][0]
    model.scale = 1 / k if k else 1.0
    weights = Model(rate=model.rate, scale=model.scale)
    bins = seen.mapInArrow(_evidence(weights), "y int, x double").groupBy(F.round("x", 2).alias("x"), "y").agg(F.count("*").alias("n")).collect()  # at most 20,001 values of x
    model.weight, model.bias = logistic(*(np.array([float(r[c]) for r in bins]) for c in ("x", "y", "n")))
    return model


def score_column(spark, model: Model, text: str = "text") -> Column:
    """A struct of score and passages (first word, end word, score) of a text column."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])

    @F.arrow_udf("struct<score: double, passages: array<struct<first: int, end: int, score: double>>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                n, found = model.passages(t)
                sure = [{"first": a, "end": b, "score": s} for s, a, b in found if model.expected(s, n) < SIGNIFICANT]
                out.append({"score": model.probability(model.evidence(n, found)), "passages": sure})
            yield pa.array(out, kind)
        model.known = out = None
        give_back()

    return score(F.col(text).cast("string"))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, passages."""
    importable(docs.sparkSession)
    d = docs.select(F.col("doc_id"), score_column(docs.sparkSession, model).alias("s"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.passages").alias("passages"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).drop("passages")
