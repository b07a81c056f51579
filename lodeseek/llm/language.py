"""Language identification: multinomial naive Bayes over hashed character n-grams.

A batch of documents is a sparse matrix in compressed rows (documents x hash buckets, an entry a gram); it is multiplied with the broadcast
matrix of log-probabilities (hash buckets x languages) in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, fraction_of, free_name

BUCKETS = 1 << 16
#: Labelled documents a language the model is fitted on; more are sampled down by a hash of doc_id.
SAMPLE = 10_000
MOST_LANGUAGES = 512
SMOOTH, SHARPNESS = 0.5, 60.0
#: Code points of a text, and entries times languages of a product, that are worked on at once.
_SLICE, _CELLS = 1 << 18, 1 << 22


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter; beyond the table there are none."""
    return np.array([chr(c).isalpha() for c in range(0x33500)], bool)


def code_points(text: str) -> np.ndarray:
    """Lower-cased letters, with one blank for each run of anything else and at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    letter = table[np.minimum(codes, len(table) - 1)]
    codes = np.where(letter, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    return codes[keep]


def features(codes: np.ndarray, seen: int = 0) -> np.ndarray:
    """Hash buckets of the 1-, 2- and 3-grams that end after the first `seen` code points."""
    x = codes.astype(np.uint64)
    one = x * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (x[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xFF51AFD7ED558CCD)
    three = (two[:-1] ^ (x[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (np.concatenate([one[seen:], two[max(0, seen - 1) :], three[max(0, seen - 2) :]]) >> np.uint64(48)).astype(np.int64)


def all_features(codes: np.ndarray) -> Iterator[np.ndarray]:
    """features of a whole text, a bounded piece at a time; each gram comes once."""
    for at in range(0, len(codes), _SLICE):
        before = min(at, 2)
        yield features(codes[at - before : at + _SLICE], before)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        self.log = np.log((counts + SMOOTH) / (counts.sum(0, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32) if languages else np.zeros((BUCKETS, 0), np.float32)
        self.prior = np.log(documents / documents.sum()) if languages else np.zeros(0)

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log-probabilities (texts x languages) and numbers of grams; a text without letters has none.

        The batch is cut into products of bounded size, at any place: a long text's part sums are added up."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        most = max(1024, _CELLS // max(1, len(self.languages)))
        held: list[tuple[int, np.ndarray]] = []

        def product() -> None:
            if held:
                columns = np.concatenate([g for _, g in held])
                starts = np.concatenate([[0], np.cumsum([len(g) for _, g in held])[:-1]])
                np.add.at(total, [i for i, _ in held], np.add.reduceat(self.log[columns], starts, axis=0, dtype=np.float64))
                held.clear()

        size = 0
        for i, text in enumerate(texts):
            codes = code_points(text) if text else np.zeros(0, np.uint32)
            for grams in all_features(codes) if len(codes) > 1 else ():
                n[i] += len(grams)
                for at in range(0, len(grams), most):
                    piece = grams[at : at + most]
                    if size + len(piece) > most:
                        product()
                        size = 0
                    held.append((i, piece))
                    size += len(piece)
        product()
        return total, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; und, 0 for a text without letters. Each n-gram counts as independent evidence
        up to SHARPNESS grams; longer texts are scaled to that, so the posterior doesn't saturate at once (the ranking of the languages hardly changes)."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        total, n = self.totals(texts)
        z = total * np.minimum(1.0, SHARPNESS / np.maximum(n, 1))[:, None] + self.prior
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, p[np.arange(len(p)), best], 0.0)


def fit(train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Counts over the rows with text and lang, at most about `sample` documents a language, summed before they reach the driver.

    What the driver gets is bounded by languages x BUCKETS; more than MOST_LANGUAGES values are refused.
    """
    known = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    found = sorted(known.groupBy("l").count().limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r.l)
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: their matrix is not a bounded broadcast")
    languages = [r.l for r in found]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rate = F.lit(1.0)
    for r in found:
        rate = F.when(F.col("l") == r.l, F.lit(min(1.0, sample / r["count"]))).otherwise(rate)
    number = {x: k for k, x in enumerate(languages)}

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, x in zip(batch.column("t"), batch.column("l").to_pylist(), strict=True):
                codes = code_points(t.as_py())
                of = counts.setdefault(number[x], np.zeros(BUCKETS, np.int64))
                for grams in all_features(codes):
                    of += np.bincount(grams, minlength=BUCKETS)
        for k, of in counts.items():
            some = np.flatnonzero(of)
            yield pa.RecordBatch.from_pydict({"l": pa.array(np.full(len(some), k, np.int32)), "bucket": pa.array(some.astype(np.int32)), "n": pa.array(of[some])})

    grams = known.where(fraction_of(F.col("i"), "lang") < rate).select("t", "l").mapInArrow(run, "l int, bucket int, n long")
    rows = grams.groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[rows.column("bucket").to_numpy(), rows.column("l").to_numpy()] = rows.column("n").to_numpy()
    return Model(languages, counts, np.array([r["count"] for r in found], float))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added (a column of that name is replaced); one pass, whole texts.

    Null, empty and letterless texts are und with score 0; so is every text if nothing was learned. Rows that repeat get the same answer; of languages
    that are equally likely the first by code point is taken; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    body = free_name(docs, "body")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                said, sure = of.predict(batch.column(body).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(said, pa.string()), pa.array(sure, pa.float64())], names=[*keep, "lang_pred", "score"])

    base = docs.select(*keep, F.col(text).cast("string").alias(body))
    return base.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op6(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. The posterior is tempered: evidence counts as that of SHARPNESS grams at most."""
    held = crc_mod(F.col("doc_id"), 3) == 1
    docs = documents.select("doc_id", "text", "lang", held.alias("held_out"))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
