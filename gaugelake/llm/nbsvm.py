"""Quality classifier (operator 12): naive Bayes support vectors.

A text is a set of n-gram indicators: words and pairs of words, and shapes of tokens (runs of capitals,
small letters, digits and marks, and whether a token repeats the one before) alone and in pairs. As shapes
are few, they also say that a text has them in at least a half, a quarter, … of its tokens. Indicators are
hashed to a fixed number of features.

1. Counts of each feature in texts of both labels, over all training rows, give its log-count ratio.
2. A linear model with hinge loss is fitted to indicators scaled by these ratios, by dual coordinate
   descent, on a bounded sample of the training rows.
3. Margins of parts of the sample that a model has not seen give the logistic curve from margins to scores.

Workers then score all texts with one vector of ``FEATURES`` weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugelake.functions.barrier import computed_once
from gaugelake.llm.hashing import mixed
from gaugelake.llm.shared import SPACE_CHARS
from gaugelake.llm.wordbpe import grouped

FEATURES = 1 << 18
#: The fit takes at most so many training rows, those with the lowest hashes, and of these so many that their features stay below a number.
FIT_ROWS, FIT_FEATURES = 8_000, 16_000_000
#: Shares of a text's tokens: a half, a quarter, … down to this power.
SHARES = 6
SMOOTHING, PENALTY, EPOCHS, FOLDS = 1.0, 1.0, 12, 3
#: Labels (16 bytes each) up to which they are broadcast to the texts; beyond, both are shuffled.
BROADCAST_LABELS = 1_000_000
#: Bytes of a text that are split at a time.
PIECE = 4 * 1024 * 1024

_SPACE_BYTES = SPACE_CHARS.encode()
_TO_BLANKS = bytes(0x20 if b in _SPACE_BYTES else b for b in range(256))
_LOWER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
#: A for capitals, a for small letters and all that is not ASCII, 0 for digits; marks stand for themselves.
_CLASS = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
_MARKS = bytes(b for b in range(0x21, 0x7F) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))

# Kinds of features start their hashes at different places.
_WORD, _PAIR, _SHAPE, _SHAPES, _SHARE = (np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(1, 6))


def shape(token: bytes) -> bytes:
    return _RUNS.sub(rb"\1", token.translate(_CLASS))


class _Tokens(dict):
    """token -> its place in arrays of word and shape hashes; a worker starts anew when they are many."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit, self.shape_hashes = limit, {}
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.known = np.zeros((2, 0), np.uint64)
        self.new: list[tuple[int, int]] = []

    def __missing__(self, token: bytes) -> int:
        word = xxhash.xxh3_64_intdigest(token.translate(_LOWER).strip(_MARKS))
        classes = token.translate(_CLASS)
        form = self.shape_hashes.get(classes)
        if form is None:
            if len(self.shape_hashes) > self.limit:
                self.shape_hashes.clear()
            form = self.shape_hashes[classes] = xxhash.xxh3_64_intdigest(shape(token))
        self.new.append((word, form))
        place = self[token] = len(self)
        return place

    def hashes(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.limit:
            self.empty()
        places = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.new:
            self.known = np.concatenate([self.known, np.array(self.new, np.uint64).T], axis=1)
            self.new = []
        return self.known[0, places], self.known[1, places]


_tokens = _Tokens()


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and shapes of all tokens as hashes, and how many each text has; a part of the tokens at a time."""
    words, shapes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    tokens: list[bytes] = []

    def hashed() -> None:
        for all_, own in zip((words, shapes), _tokens.hashes(tokens), strict=True):
            all_.append(own)
        tokens.clear()

    for i, text in enumerate(texts):
        clean, start = text.translate(_TO_BLANKS), 0
        while start < len(clean):
            end = clean.find(b" ", start + PIECE)
            end = len(clean) if end < 0 else end
            own = clean[start:end].split()
            sizes[i] += len(own)
            tokens += own
            start = end
            if len(tokens) > PIECE // 4:
                hashed()
    hashed()
    return np.concatenate(words), np.concatenate(shapes), sizes


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of all indicators that hold, sorted and once each."""
    words, shapes, sizes = token_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[1:] == owner[:-1]
    again = np.zeros(len(words), bool)
    again[1:] = inside & (words[1:] == words[:-1])
    shapes = shapes + again.astype(np.uint64)
    pair_owner = owner[1:][inside]
    word_pairs = mixed(words[:-1][inside]) + words[1:][inside]
    shape_pairs = mixed(shapes[:-1][inside]) + shapes[1:][inside]

    keys = [_keys(owner, words, _WORD), _keys(pair_owner, word_pairs, _PAIR)]
    for own, kind, values in ((owner, _SHAPE, shapes), (pair_owner, _SHAPES, shape_pairs)):
        found, counts = np.unique(_keys(own, values, kind), return_counts=True)
        keys.append(found)
        texts_of = found // FEATURES
        for k in range(1, SHARES + 1):
            held = counts << k >= sizes[texts_of]
            keys.append(_keys(texts_of[held], (found[held] % FEATURES).astype(np.uint64) * np.uint64(SHARES + 1) + np.uint64(k), _SHARE))
    all_keys = np.sort(np.concatenate(keys))  # cheaper than hashing them
    once = all_keys[np.append(True, all_keys[1:] != all_keys[:-1])] if len(all_keys) else all_keys
    return once // FEATURES, once % FEATURES


def _keys(owner: np.ndarray, values: np.ndarray, kind: np.uint64) -> np.ndarray:
    return owner * FEATURES + (mixed(values + kind) % np.uint64(FEATURES)).astype(np.int64)


class Model(NamedTuple):
    """score = logistic(slope * margin + offset); margin = bias + sum of weights / norm of ratios, over features that hold."""

    weights: np.ndarray
    squares: np.ndarray  # of the ratios
    bias: float
    slope: float
    offset: float


def log_ratios(with_1: np.ndarray, with_0: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of how much of its label's (smoothed) feature counts each feature has, label 1 against 0."""
    p, q = with_1 + smoothing, with_0 + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, penalty: float = PENALTY,
                 epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with hinge loss, one dual variable at a time.

    ``rows`` are features, ``labels`` 1 and -1. Rows have unit length and a constant next to it for the bias.
    """
    weights, bias = np.zeros(len(ratios)), 0.0
    values = [ratios[r] / max(np.linalg.norm(ratios[r]), 1e-12) for r in rows]
    norms = np.array([v @ v for v in values]) + 1.0
    duals, rng = np.zeros(len(rows)), np.random.default_rng(12)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            y, row, value = labels[i], rows[i], values[i]
            gradient = y * (weights[row] @ value + bias) - 1.0
            new = min(max(duals[i] - gradient / norms[i], 0.0), penalty)
            step = new - duals[i]
            if step:
                duals[i] = new
                weights[row] += step * y * value
                bias += step * y
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def logistic_curve(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and offset of the curve that fits best, by Newton's method, with smoothed targets."""
    n1 = int(positive.sum())
    n0 = len(positive) - n1
    targets = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    beta = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (targets - p))
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def margins(model: Model, owner: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    sums = np.bincount(owner, model.weights[found], n)
    norms = np.sqrt(np.bincount(owner, model.squares[found], n))
    return model.bias + sums / np.maximum(norms, 1e-12)


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    owner, found = features(texts)
    return 1 / (1 + np.exp(-np.clip(model.slope * margins(model, owner, found, len(texts)) + model.offset, -30, 30)))


def fit(rows: list[np.ndarray], positive: np.ndarray, with_1: np.ndarray, with_0: np.ndarray) -> Model:
    """The model of these rows and of the features' counts in all training rows.

    The curve is that of margins out of sample: neither the model nor the ratios of a part have seen it.
    """
    labels, fold, unseen = np.where(positive, 1.0, -1.0), np.arange(len(rows)) % FOLDS, np.zeros(len(rows))

    def counted(chosen: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([np.zeros(0, np.int64), *[rows[i] for i in chosen]]), minlength=FEATURES)

    def trained(chosen: np.ndarray, ratios: np.ndarray) -> Model:
        weights, bias = dual_descent([rows[i] for i in chosen], labels[chosen], ratios)
        return Model(weights * ratios, ratios**2, bias, 1.0, 0.0)

    for k in range(FOLDS):
        out = np.flatnonzero(fold == k)
        without = log_ratios(with_1 - counted(out[positive[out]]), with_0 - counted(out[~positive[out]]))
        model = trained(np.flatnonzero(fold != k), without)
        for i in out:
            unseen[i] = margins(model, np.zeros(len(rows[i]), np.int64), rows[i], 1)[0]
    slope, offset = logistic_curve(unseen, positive)
    return trained(np.arange(len(rows)), log_ratios(with_1, with_0))._replace(slope=slope, offset=offset)


#: Without any training row: all scores are a half.
NEUTRAL = Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, 0.0)


def held_out(doc_id: Column) -> Column:
    """Documents that no label is learned from; a NULL id has no label anyway."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
                  broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """``doc_id``, ``text``, ``positive`` of the labelled documents that are not held out.

    An id whose labels differ, or that has none but NULL, is not labelled. A NULL text is empty.
    """
    agreed = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("doc_id")).agg(
        F.min(label_col).alias("low"), F.max(label_col).alias("high")).where("low = high").select("doc_id", (F.col("low") == 1).alias("positive"))
    if agreed.limit(broadcast_labels + 1).count() <= broadcast_labels:
        agreed = F.broadcast(agreed)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.join(agreed, "doc_id")


def feature_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``rows`` (``text``, ``positive``) of label 1 and of label 0 each feature holds for.

    Workers add up dense counts; at most one row for each feature reaches the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, FEATURES), np.int64)
        for batch in batches:
            texts, positive = batch["text"].cast(pa.binary()).to_pylist(), batch["positive"].to_numpy(zero_copy_only=False)
            for low, high in grouped(texts):
                owner, found = features(texts[low:high])
                own = positive[low:high][owner].astype(np.int64)
                sums += np.bincount(own * FEATURES + found, minlength=2 * FEATURES).reshape(2, FEATURES)
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[1, used]), pa.array(sums[0, used])], names=["feature", "n1", "n0"])

    counted = rows.select("text", "positive").mapInArrow(count, "feature int, n1 bigint, n0 bigint")
    found = counted.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toArrow()
    out = np.zeros((2, FEATURES), np.int64)
    for k, name in enumerate(("n1", "n0")):
        out[k, found["feature"].to_numpy()] = found[name].to_numpy()
    return out[0], out[1]


def sample(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``order``, ``text``, ``positive`` of the ``fit_rows`` documents with the lowest hashes of their ids.

    Only hashes decide, so the sample is the same each time. Of rows with one id it takes the least text.
    """
    ordered = rows.withColumn("order", F.xxhash64("doc_id"))
    last = ordered.select("order").distinct().orderBy("order").limit(fit_rows).agg(F.max("order")).first()[0]
    return ordered.where(F.col("order") <= F.lit(last)).groupBy("order").agg(F.min("text").alias("text"), F.first("positive").alias("positive"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES, broadcast_labels: int = BROADCAST_LABELS) -> Model:
    """The model of all labelled documents that are not held out.

    Feature counts cover all of them; the linear model is fitted on at most ``fit_rows`` with at most
    ``fit_features`` features, whole texts each, in one task. Without any the model is ``NEUTRAL``.
    """
    rows = training_rows(docs, labels, label_col, id_col, text_col, broadcast_labels)
    with_1, with_0 = feature_counts(rows)
    if not with_1.any() and not with_0.any():
        return NEUTRAL
    counts = docs.sparkSession.sparkContext.broadcast((with_1, with_0))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[np.ndarray] = []
        positive: list[bool] = []
        room = fit_features
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            for low, high in grouped(texts):
                owner, found = features(texts[low:high])
                ends = np.searchsorted(owner, np.arange(high - low + 1))
                for i in range(high - low):
                    row = found[ends[i]:ends[i + 1]].astype(np.int32)
                    room -= len(row)
                    if room >= 0:
                        own.append(row)
                        positive.append(batch["positive"][low + i].as_py())
        model = fit(own, np.array(positive, bool), *counts.value)
        yield pa.RecordBatch.from_pydict({
            "weights": [model.weights.tobytes()], "squares": [model.squares.tobytes()], "bias": [model.bias], "slope": [model.slope], "offset": [model.offset]})

    one_task = sample(rows, fit_rows).repartition(1).sortWithinPartitions("order")
    row = one_task.mapInArrow(fitted, "weights binary, squares binary, bias double, slope double, offset double").first()
    return Model(np.frombuffer(row["weights"]), np.frombuffer(row["squares"]), row["bias"], row["slope"], row["offset"])


def scored(df: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on, else 0).

    Only the text is looked at. Every row stays, repeated ones too (with equal scores), with all its
    columns; ``prefix`` keeps the new names apart from existing ones. A NULL text is empty; a text without
    words gets the score of the bias.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or b"" for t in batch.cast(pa.binary()).to_pylist()]
            parts = [scores(shared.value, texts[low:high]) for low, high in grouped(texts)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    score_udf = F.arrow_udf(score, T.DoubleType())
    out = computed_once(df, **{f"{prefix}score": score_udf(F.col(text_col))})
    return out.withColumn(f"{prefix}predicted", F.when(F.col(f"{prefix}score") >= threshold, 1).otherwise(0))
