"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad.

A line's potential sees its own features and those of its two neighbours; forward-backward gives each line's marginal, and the
length-weighted mean of the marginals, calibrated on the training documents, is the document's quality. Only documents are labelled: in
training a line's own label is latent, and its document's label is evidence for it, strong at first and weaker later, so that a good line in
a bad document may be learnt as good.
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, cut, fraction_of, free_name, utf8

#: Labelled documents the field is fitted on, whole texts of them.
SAMPLE = 4_000
THRESHOLD, EPOCHS, RATE, DECAY = 0.3, 120, 0.08, 1e-3
#: Log-odds with which a document's label speaks for a line's, in the first and in the second half of the training.
EVIDENCE = (8.0, 2.0)

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b" \t\n\r\x0b\x0c")] = 4
_CLASS[list(b".,;:'-\"()?")] = 5
_CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 6
_CLASS[0x80:] = 7
N_FEATURES = 16


def line_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x N_FEATURES, line lengths in bytes) of a whole text; an empty text is one empty line."""
    lines = data.split(b"\n")
    size = np.array([len(x) for x in lines], np.int64)
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    raw = np.frombuffer(data + b"\n", np.uint8)
    kind = _CLASS[raw]

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64).astype(float)

    lower, upper, digit, mark, odd, wide = (per_line(kind == k) for k in (1, 2, 3, 5, 6, 7))
    after = np.concatenate([kind[1:], [4]])
    before = np.concatenate([[4], kind[:-1]])
    solid = kind != 4
    words = per_line(solid & (before == 4))
    odd_ends = per_line((kind == 6) & (after == 4))
    odd_alone = per_line((kind == 6) & (after == 4) & (before == 4))
    doubled = per_line((kind == 6) & (np.concatenate([raw[1:], [0]]) == raw))
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(lower + upper, 1)
    seen = Counter(lines)
    again = np.array([seen[x] > 1 and len(x) > 3 for x in lines], float)
    tokens = [x.split() for x in lines]
    distinct = np.array([len(set(x)) for x in tokens]) / w
    repeats = np.array([sum(map(operator.eq, x, x[1:])) for x in tokens]) / w
    out = np.stack(
        [
            np.ones(len(lines)), np.log1p(size) / 5, np.log1p(words) / 4, upper / letters, digit / n, mark / w, odd / n * 4, wide / n,
            odd_ends / w, odd_alone / w, doubled / w, np.minimum((size - words + 1) / w, 30) / 6, again, (size == 0).astype(float), distinct, repeats,
        ],
        axis=1,
    )
    return out, size


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features; the ends of a text have zeros there."""
    zero = np.zeros((1, x.shape[1]))
    return np.concatenate([x, np.concatenate([zero, x[:-1]]), np.concatenate([x[1:], zero])], axis=1)


def places(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For the lines of documents laid end to end: how many lines of the document come before each, and how many after."""
    n = np.array(sizes, np.int64)
    before = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return before, np.repeat(n, n) - 1 - before


def _composed(num_x, num_1, den_x, den_1, offset: np.ndarray, sign: int) -> np.ndarray:
    """Log of the value at each place of maps x -> (num_x x + num_1) / (den_x x + den_1), each applied to the value at the place before it (sign
    -1) or after it (sign 1), of which there are `offset`; the map at the end is constant. Spans of maps are composed by doubling, so that a text
    takes as many steps as its length has binary digits."""
    m = [np.array(c, float) for c in (num_x, num_1, den_x, den_1)]
    step, at = 1, np.flatnonzero(offset >= 1)
    while len(at):
        a, b, c, d = (x[at] for x in m)
        e, f, g, h = (x[at + sign * step] for x in m)
        new = [a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h]
        scale = np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))
        for x, y in zip(m, new, strict=True):
            x[at] = y / scale
        step *= 2
        at = at[offset[at] >= step]
    tiny = 1e-300
    return np.log(np.maximum(m[1], tiny)) - np.log(np.maximum(m[3], tiny))


def messages(theta: np.ndarray, switch: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds (with the line's own potential) and backward log-odds (without it) of every line, over all documents at once."""
    t = np.exp(switch)
    odds = np.exp(np.clip(theta, -30, 30))
    first, last = before == 0, after == 0
    ahead = _composed(np.where(first, 0, odds * t[1, 1]), np.where(first, odds, odds * t[0, 1]), np.where(first, 0, t[1, 0]), np.where(first, 1, t[0, 0]), before, -1)
    follow = np.concatenate([odds[1:], [1.0]])
    back = _composed(np.where(last, 0, follow * t[1, 1]), np.where(last, 1, t[1, 0]), np.where(last, 0, follow * t[0, 1]), np.where(last, 1, t[0, 0]), after, 1)
    return ahead, back


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Field:
    """Binary linear chain: theta = weights . x is a line's log-odds of good, switch[a][b] the potential of a -> b."""

    def __init__(self, weights: np.ndarray, switch: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.switch, self.slope, self.shift = weights, switch, slope, shift

    def marginals(self, theta: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Log-odds of good of every line of documents laid end to end, by forward-backward in log-odds form."""
        ahead, back = messages(np.asarray(theta, float), self.switch, *places(sizes))
        return ahead + back

    def raw(self, theta: np.ndarray, sizes: list[int], lengths: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of each document; of one without any character the plain mean."""
        p, starts = _sigmoid(self.marginals(theta, sizes)), np.cumsum([0, *sizes[:-1]])
        total = np.add.reduceat(lengths, starts)
        return np.where(total > 0, np.add.reduceat(p * lengths, starts) / np.maximum(total, 1), np.add.reduceat(p, starts) / np.array(sizes))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        p = np.clip(raw, 1e-6, 1 - 1e-6)
        return _sigmoid(self.slope * np.log(p / (1 - p)) + self.shift)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Scores of whole texts; null scores as the empty text."""
        if not texts:
            return np.zeros(0)
        made = [line_features(t or b"") for t in texts]
        theta = np.concatenate([with_neighbours(x) @ self.weights for x, _ in made])
        return self.calibrated(self.raw(theta, [len(x) for x, _ in made], np.concatenate([n for _, n in made]).astype(float)))


def _switches(theta: np.ndarray, ahead: np.ndarray, back: np.ndarray, switch: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Expected numbers of the four label pairs of neighbouring lines at and at + 1."""
    a, c = np.clip(ahead[at], -30, 30), np.clip(theta[at + 1] + back[at + 1], -30, 30)
    w = np.exp(np.stack([switch[0, 0] + 0 * a, switch[0, 1] + c, switch[1, 0] + a, switch[1, 1] + a + c]))
    return (w / w.sum(0)).sum(1).reshape(2, 2)


def _train(docs: list[tuple[np.ndarray, int]]) -> Field:
    """Maximum likelihood by Adam of the documents' labels as evidence for the latent labels of all their lines."""
    n_x = 3 * N_FEATURES
    params = np.zeros(n_x + 4)
    if not docs:
        return Field(params[:n_x], params[n_x:].reshape(2, 2))
    x = np.concatenate([with_neighbours(f) for f, _ in docs]).astype(np.float32)
    before, after = places([len(f) for f, _ in docs])
    y = np.repeat([2.0 * label - 1 for _, label in docs], [len(f) for f, _ in docs])
    inner = np.flatnonzero(after > 0)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for epoch in range(1, EPOCHS + 1):
        switch = params[n_x:].reshape(2, 2)
        theta = (x @ params[:n_x].astype(np.float32)).astype(float)
        told = theta + EVIDENCE[2 * (epoch - 1) // EPOCHS] * y
        free, given = messages(theta, switch, before, after), messages(told, switch, before, after)
        slack = _sigmoid(given[0] + given[1]) - _sigmoid(free[0] + free[1])
        grad = np.concatenate([slack.astype(np.float32) @ x, (_switches(told, *given, switch, inner) - _switches(theta, *free, switch, inner)).ravel()])
        grad = grad / len(x) - DECAY * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params += RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        params[n_x:] = np.clip(params[n_x:], -4, 4)
    return Field(params[:n_x], params[n_x:].reshape(2, 2))


def _calibrate(field: Field, raw: np.ndarray, y: np.ndarray) -> Field:
    """Logistic regression of the label on the log-odds of the raw score, a little shrunk."""
    p = np.clip(raw, 1e-6, 1 - 1e-6)
    x, w = np.stack([np.log(p / (1 - p)), np.ones(len(p))], 1), np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1.0, 0.1])
        w = w + np.linalg.solve(h, x.T @ (y - q) - np.array([w[0] - 1, 0.1 * w[1]]))
    return Field(field.weights, field.switch, max(float(w[0]), 1e-3), float(w[1]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Field:
    """Fit on the whole texts of at most about `sample` labelled documents, drawn by a hash of doc_id; rows with a null id or a label other
    than 0 and 1 don't count, repeated ones count once, and of rows that share a doc_id the smallest text counts. Null texts are empty.

    Without labelled rows every document scores 0.5. The fit is the same however the rows are dealt.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).distinct()
    known = cut(known, "labelled")
    n = known.count()
    if n > sample:
        known = known.where(fraction_of(F.col("i"), "quality") < sample / n)
    if known.count() > 2 * sample + 100:
        raise AssertionError("the sample is bounded")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                made = [line_features(data or b"") for data in utf8(batch.column("t"))]
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("y"), pa.array([x.astype(np.float32).tobytes() for x, _ in made], pa.binary()), pa.array([n.astype(np.int64).tobytes() for _, n in made], pa.binary())], names=["i", "y", "x", "size"])

    texts = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(known), "i").groupBy("i", "y").agg(F.min("t").alias("t")).select(F.col("i").cast("string").alias("i"), "y", "t")
    rows = sorted(texts.mapInArrow(run, "i string, y int, x binary, size binary").collect(), key=lambda r: (r.i, r.y))
    data = [(np.frombuffer(bytes(r.x), np.float32).reshape(-1, N_FEATURES), r.y) for r in rows]
    field = _train(data)
    if not data:
        return field
    theta = np.concatenate([with_neighbours(x) @ field.weights for x, _ in data])
    raw = field.raw(theta, [len(x) for x, _ in data], np.concatenate([np.frombuffer(bytes(r.size), np.int64) for r in rows]).astype(float))
    return _calibrate(field, raw, np.array([y for _, y in data], float))


def score(docs: DataFrame, field: Field, text: str = "text", to: str = "score") -> DataFrame:
    """docs with `to` added (a column of that name is replaced); whole texts, one pass. Null scores as the empty text, rows that repeat score
    alike, an empty table gives an empty result."""
    keep = [c for c in docs.columns if c.lower() != to.lower()]
    body = free_name(docs, "body")
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        of = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                said = of.scores(utf8(batch.column(body)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(said, pa.float64())], names=[*keep, to])

    return docs.select(*keep, F.col(text).cast("string").alias(body)).mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, T.StructField(to, T.DoubleType())]))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod(F.col("doc_id"), 5) != 0)


def op7(documents: DataFrame, labels: DataFrame) -> DataFrame:
    field = fit(documents, learnable(labels))
    docs = documents.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return score(docs, field).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, with the same columns, that score at least THRESHOLD. Rows that repeat go or stay together; an empty table gives an empty result."""
    mark = free_name(docs, "score")
    return score(docs, fit(docs, learnable(labels)), to=mark).where(F.col(mark) >= THRESHOLD).select(*docs.columns)
