"""Quality classifier (operator 1): co-training of a text view and a page-metadata view.

The text view sees measures of the whole text: shares of character classes and of their pairs, repeated and neighbouring
words, line shapes. The metadata view sees what a crawl records of a page: language, source, length in characters, bytes
and lines. Each is a logistic model on labelled documents. In each round both views score every unlabelled document; the
surest of each view by rank, a share of the corpus for each class (SHARE more each round), become labels that the other
view is trained on from then on. A label weighs by the square of how far its teacher's precision on such
ranks, one standard error lower, exceeds the base rate, measured on labelled documents that trained neither view, so a
view that knows little teaches little. Of each view the model of the round that fits these documents best is
calibrated (Platt) on them, and the calibrated log-odds are combined by a logistic fit on them, without a view whose
weight would be negative. Every document is then scored over its whole text.

The text is read once; the rounds read its stored measures. The ranks come from counts in bins of log-odds over all
unlabelled rows. Bounds, both parameters: a fit takes at most MAX_LABELLED labelled documents and MAX_TAUGHT rows that a
view labelled in a class, even samples by hash, drawn anew each round. Labels are taken only from documents whose
crc32(doc_id as text) mod 5 is not 0; doc_id is no input.

Defined results: a null text counts as empty; null metadata is a value of its own; a null doc_id is scored and not held
out; repeated labels of a document count once (the lowest); of repeated rows of a labelled document one trains, and all
get equal results; rows of equal log-odds fall in one bin, which is taken whole or not; without labels of both classes
every score is the (smoothed) share of good labels; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import importable, slices, stored
from .toxicity import held_out

MAX_LABELLED, MAX_TAUGHT = 12_000, 3_000
ROUNDS, SHARE = 4, 0.1
#: Most weight of a taught label; a label that was given weighs 1.
TAUGHT_WEIGHT = 0.5
#: Bins of log-odds, from -30 to 30.
BINS = 100
#: Values of each kind of metadata, in this order: language, source, characters, bytes a character, lines, characters a
#: line, whether the stated length is the text's; the last place is the constant.
META = (16, 64, 48, 24, 24, 24, 3)
META_WIDTH = sum(META) + 1
#: Character classes: small letter, capital, digit, space, line feed, sentence mark, other mark, other.
CLASSES = 8
_TABLE = bytes(
    0 if 97 <= c <= 122 or c >= 128 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in (32, 9, 11, 12, 13) else 4 if c == 10 else 5 if chr(c) in ".,;:!?'\"()-" else 6 if 33 <= c <= 126 else 7
    for c in range(256)
)


def text_features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    classes = np.frombuffer(raw.translate(_TABLE), np.uint8)
    n = max(len(raw), 1)
    single = np.bincount(classes, minlength=CLASSES) / n
    pairs = np.bincount(classes[:-1] * np.uint8(CLASSES) + classes[1:], minlength=CLASSES * CLASSES)[: CLASSES * CLASSES] / n
    words = raw.split()
    m = max(len(words), 1)
    neighbours = sum(map(bytes.__eq__, words[:-1], words[1:])) / m
    lines = raw.count(b"\n") + 1
    rest = [np.log1p(len(words)) / 10, len(set(words)) / m, neighbours, len(raw) / m / 10, np.log1p(lines) / 5, m / lines / 100, float(not words)]
    return np.concatenate((np.sqrt(single), np.sqrt(pairs), rest, [1.0]))


def meta_features(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """The places of the ones among META_WIDTH."""
    text = text or ""
    n, size, lines = len(text), len(text.encode("utf-8", "surrogatepass")), text.count("\n") + 1
    values = (
        crc32(f"l{lang}".encode()), crc32(f"s{source}".encode()), int(2 * np.log2(1 + max(n_chars or 0, 0))) if n_chars is not None else META[2] - 1,
        int(8 * (size / max(n, 1) - 1)), lines.bit_length(), (n // lines).bit_length(), 0 if n_chars is None else 1 + (n_chars == n),
    )
    out, at = [], 0
    for i, (v, width) in enumerate(zip(values, META, strict=True)):
        out.append(at + (v % width if i < 2 else min(max(v, 0), width - 1)))
        at += width
    return [*out, at]


def dense(places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), META_WIDTH))
    out[np.arange(len(places))[:, None], places] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method; the last column is the constant, which is not penalised."""
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * weight.sum() / 100 + 1e-6)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _p(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def odds(text: np.ndarray, places: np.ndarray, models: list[np.ndarray]) -> list[np.ndarray]:
    """Clipped log-odds of rows by the text and the metadata model."""
    return [np.clip(text @ models[0], -30, 30), np.clip(models[1][places].sum(axis=1), -30, 30)]


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray  # Platt: slope and constant of a view's log-odds
    meta_scale: np.ndarray
    joint: np.ndarray  # weights of both calibrated log-odds and a constant
    #: Of each round, by the teaching view: labels given (good, bad) and their weights.
    given: list[dict] = field(default_factory=list, repr=False)

    def scores(self, text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of the text view, the metadata view and both."""
        zt, zm = (z * s[0] + s[1] for z, s in zip(odds(text, places, [self.text, self.meta]), (self.text_scale, self.meta_scale), strict=True))
        both = np.stack((zt, zm, np.ones_like(zt)), 1)
        return 1 / (1 + np.exp(-np.clip(zt, -30, 30))), 1 / (1 + np.exp(-np.clip(zm, -30, 30))), _p(both, self.joint)


def bins_of(z: np.ndarray) -> np.ndarray:
    return np.floor(z * BINS).astype(np.int64)


def surest(counts: Counter, good: float, bad: float) -> tuple[int, int, int, int]:
    """(bin from which rows are good, their number, bin up to which rows are bad, their number): the outermost whole bins
    with at most that share of all rows, one bin at least; good and bad bins do not meet."""
    total, bins = sum(counts.values()), sorted(counts)
    high, n_high = bins[-1], counts[bins[-1]]
    for b in reversed(bins[:-1]):
        if n_high + counts[b] > good * total:
            break
        high, n_high = b, n_high + counts[b]
    low, n_low = bins[0], counts[bins[0]]
    for b in bins[1:]:
        if n_low + counts[b] > bad * total or b >= high:
            break
        low, n_low = b, n_low + counts[b]
    return (high, n_high, low, n_low) if low < high else (high, 0, high - 1, 0)  # one bin only: no row is surer than another


def draw(doc_ids: list, text: np.ndarray, seed: str, share: float) -> np.ndarray:
    """Which rows an even sample takes, by a hash of the row."""
    return np.array([crc32(f"{seed}{i}".encode() + t.tobytes()) < share * 2**32 for i, t in zip(doc_ids, text, strict=True)], bool)


def histogram(rows, models: list[np.ndarray]) -> list[Counter]:
    """Rows in each bin, by view; rows: (doc_ids, text, places) arrays, float32 text."""
    out = [Counter(), Counter()]
    for _, text, places in rows:
        for own, z in zip(out, odds(text, places, models), strict=True):
            own.update(Counter(bins_of(z).tolist()))
    return out


def taught(rows, models: list[np.ndarray], cuts: list[tuple[int, int, int, int]], seed: str, most: int):
    """(teaching view, label, row's text, row's places) of an even sample of each view's surest rows."""
    for ids, text, places in rows:
        for v, (z, (high, n_high, low, n_low)) in enumerate(zip(odds(text, places, models), cuts, strict=True)):
            b = bins_of(z)
            for label, own, n in ((1, b >= high, n_high), (0, b <= low, n_low)):
                at = np.flatnonzero(own) if n else []
                if len(at):
                    at = at[draw([ids[i] for i in at], text[at], f"{seed}{v}{label}", most / n)]
                yield from ((v, label, text[i], places[i]) for i in at)


class Rows:
    """Unlabelled rows in memory; `Stored` is the same over a frame."""

    def __init__(self, doc_ids: list, text: np.ndarray, places: np.ndarray):
        self.rows = [(doc_ids, text, places)]

    def histogram(self, models):
        return histogram(self.rows, models)

    def taught(self, models, cuts, seed, most):
        return list(taught(self.rows, models, cuts, seed, most))


def _least_share(hits: float, n: int) -> float:
    """A share one standard error below that of hits among n (Wilson)."""
    p = hits / n
    return (p + 0.5 / n - np.sqrt(p * (1 - p) / n + 0.25 / n / n)) / (1 + 1 / n)


def _lift(z: np.ndarray, y: np.ndarray, good: float, bad: float) -> tuple[float, float]:
    """How far the surest good and bad of labelled rows surely exceed the base rate: 0 as guessed, 1 all right."""
    order, rate = np.argsort(-z, kind="stable"), y.mean()
    n_top, n_bottom = max(1, int(good * len(z))), max(1, int(bad * len(z)))
    top, bottom = _least_share(y[order[:n_top]].sum(), n_top), _least_share((1 - y[order[len(z) - n_bottom :]]).sum(), n_bottom)
    lifts = (top - rate) / max(1 - rate, 1e-9), (bottom - (1 - rate)) / max(rate, 1e-9)
    return tuple(float(max(0.0, x)) for x in lifts)


def cotrain(text: np.ndarray, places: np.ndarray, y: np.ndarray, pool, rounds: int = ROUNDS, max_taught: int = MAX_TAUGHT) -> Model:
    """Fit on labelled rows and a pool of unlabelled ones; every fifth labelled row calibrates and trains nothing."""
    if len(set(y.tolist())) < 2:
        rate = (y.sum() + 0.5) / (len(y) + 2.0)
        const = np.array([0.0, 0.0, np.log(rate / (1 - rate))])
        return Model(np.zeros(text.shape[1]), np.zeros(META_WIDTH), np.array([1.0, const[-1]]), np.array([1.0, const[-1]]), const)
    calibrate = np.arange(len(y)) % 5 == 0
    if len(set(y[calibrate].tolist())) < 2 or len(set(y[~calibrate].tolist())) < 2:
        calibrate = np.ones(len(y), bool)  # too few rows to set some aside
        train = calibrate
    else:
        train = ~calibrate
    views = [text, dense(places)]
    none = [(np.empty((0, x.shape[1])), np.empty(0), np.empty(0)) for x in views]  # rows, labels and weights that each view was taught
    lessons, rate, given = none, y[train].mean(), []
    best = [(np.inf, np.empty(0))] * 2  # of each view the model of the round that fits the calibration rows best
    for r in range(rounds + 1):
        models = [logistic(np.concatenate((x[train], rows)), np.concatenate((y[train], labels)), np.concatenate((np.ones(train.sum()), weights))) for x, (rows, labels, weights) in zip(views, lessons, strict=True)]
        for v, z in enumerate(odds(text[calibrate], places[calibrate], models)):
            loss = float(np.logaddexp(0, np.where(y[calibrate] == 1, -z, z)).mean())
            best[v] = min(best[v], (loss, models[v]), key=lambda x: x[0])
        if r == rounds:
            break
        counts = pool.histogram(models)
        if not counts[0]:
            break
        share = SHARE * (r + 1)
        good, bad = share * rate, share * (1 - rate)
        cuts = [surest(c, good, bad) for c in counts]
        lifts = [_lift(z, y[calibrate], good, bad) for z in odds(text[calibrate], places[calibrate], models)]
        found = pool.taught(models, cuts, f"{r}:", max_taught)
        lessons = list(none)
        for v in (0, 1):  # the teaching view
            own = [(label, t, p) for w, label, t, p in found if w == v]
            if own:
                rows = np.array([t for _, t, _ in own], float) if v else dense(np.array([p for _, _, p in own]))
                labels = np.array([label for label, _, _ in own], float)
                lessons[1 - v] = (rows, labels, TAUGHT_WEIGHT * np.where(labels == 1, *lifts[v]) ** 2)
        given.append({name: {"labels": (cut[1], cut[3]), "weights": lift} for name, cut, lift in zip(("text", "meta"), cuts, lifts, strict=True)})
    models = [m for _, m in best]
    one = np.ones(calibrate.sum())
    z = odds(text[calibrate], places[calibrate], models)
    scales = [logistic(np.stack((a, one), 1), y[calibrate], penalty=1e-2) for a in z]
    both = np.stack([a * s[0] + s[1] for a, s in zip(z, scales, strict=True)] + [one], 1)
    joint = logistic(both, y[calibrate], penalty=0.1)
    if joint[:2].min() < 0:  # a view that speaks against itself beside the other adds nothing
        both[:, joint[:2].argmin()] = 0
        joint = logistic(both, y[calibrate], penalty=0.1)
    return Model(models[0], models[1], scales[0], scales[1], joint, given)


MEASURED = "doc_id long, text array<float>, places array<short>"


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text, places: the measures of both views of every row of docs; store them, as they are read often."""

    def run(batches):
        for b in slices(batches, 1000):
            texts = b.column(1).to_pylist()
            measures = [text_features(t).astype(np.float32) for t in texts]
            places = [meta_features(*x) for x in zip(texts, *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(measures, pa.list_(pa.float32())), pa.array(places, pa.list_(pa.int16()))], ["doc_id", "text", "places"])

    importable(docs.sparkSession)
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in ("doc_id", "text", "lang", "source", "n_chars"))).mapInArrow(run, MEASURED)


def _arrays(batches):
    """(doc_ids, text, places) of batches of measured rows."""
    for b in batches:
        if b.num_rows:
            lists = [b.column(i).flatten().to_numpy().reshape(b.num_rows, -1) for i in (1, 2)]
            yield b.column(0).to_pylist(), *lists


class Stored:
    """Measured unlabelled rows as a frame: each question is one pass over all of them."""

    def __init__(self, measured: DataFrame):
        self.measured = measured

    def histogram(self, models):
        shared = self.measured.sparkSession.sparkContext.broadcast(models)

        def run(batches):
            counts = histogram(_arrays(batches), shared.value)
            for v, own in enumerate(counts):
                bins = list(own)
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(bins), pa.int32()), pa.array(bins, pa.int64()), pa.array([own[b] for b in bins], pa.int64())], ["view", "bin", "n"])

        out = [Counter(), Counter()]
        for r in self.measured.mapInArrow(run, "view int, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():  # at most 12,002 rows
            out[r["view"]][r["bin"]] = r["n"]
        return out

    def taught(self, models, cuts, seed, most):
        shared = self.measured.sparkSession.sparkContext.broadcast(models)

        def run(batches):
            for rows in _arrays(batches):
                found = list(taught([rows], shared.value, cuts, seed, most))
                if found:
                    v, label, text, places = zip(*found, strict=True)
                    order = [crc32(f"{seed}{a}{b}".encode() + t.tobytes()) for a, b, t in zip(v, label, text, strict=True)]
                    columns = [pa.array(v, pa.int32()), pa.array(label, pa.int32()), pa.array(order, pa.int64()), pa.array(list(text), pa.list_(pa.float32())), pa.array(list(places), pa.list_(pa.int16()))]
                    yield pa.RecordBatch.from_arrays(columns, ["view", "label", "at", "text", "places"])

        rows = self.measured.mapInArrow(run, "view int, label int, at long, text array<float>, places array<short>")
        got = rows.orderBy("view", "label", "at", "text", "places").limit(8 * most).collect()  # about 4 * most rows; equal rows without an id are drawn together
        return [(r["view"], r["label"], np.array(r["text"], np.float32), np.array(r["places"])) for r in got]


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, max_taught: int = MAX_TAUGHT) -> Model:
    """A model of measured rows, of which `labels` (doc_id, label) covers some."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    own = own.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit("labelled"))
    share = int(1_000_000 * min(1.0, 1.2 * max_labelled / max(own.count(), 1))) + 1
    sample = own.filter(F.pmod(order, F.lit(1_000_000)) < share).orderBy(order, "doc_id").limit(max_labelled)
    chosen = F.broadcast(sample)  # at most max_labelled ids
    known = measured.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "places")).alias("x")).collect()
    pool = measured.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti").select("doc_id", "text", "places")
    known.sort(key=lambda r: (r["x"]["text"], r["x"]["places"], r["y"]))  # the same on any layout
    known = [known[i] for i in np.random.default_rng(0).permutation(len(known))]
    text = np.array([r["x"]["text"] for r in known], float).reshape(len(known), len(text_features("")))
    places = np.array([r["x"]["places"] for r in known], int).reshape(len(known), len(META) + 1)
    return cotrain(text, places, np.array([float(r["y"]) for r in known]), Stored(pool), max_taught=max_taught)


def classify(measured: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score, predicted, kept of every measured row."""
    spark = measured.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for ids, text, places in _arrays(batches):
            scores = shared.value.scores(text, places)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(s, pa.float64()) for s in scores)], ["doc_id", "text_score", "meta_score", "score"])

    out = measured.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    good = F.col("score") >= 0.5
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "meta_score", "score", good.cast("int").alias("predicted"), good.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    measured = stored(measure(table(spark, sf_dir, "documents")))
    return classify(measured, fit(measured, table(spark, sf_dir, "labels")))
