"""Language of a document as a mixture of languages, by expectation-maximisation over character n-gram likelihoods.

Model: smoothed frequencies of hashed byte trigrams (letters lower-cased, everything else a blank) for each language,
counted over every training row. A document's language proportions maximise the mixture's likelihood, by expectation-maximisation
until the log-likelihood is provably within GAP of its maximum, however many steps that takes; the set of
languages is the one whose log-likelihood, less half the log of the document's length for each language beyond the first
(times `penalty`), is largest. The language with the largest share of that set is predicted; score is its share when all
languages compete, so it falls as others explain parts of the text.

Defined results: null text, or text without a letter: und, score 0; without a training row of any language: und, score 0;
rows with a null lang are never learned from; a null doc_id is in fold 0; equal shares: the first language by name;
repeated rows repeat their result; an empty table gives an empty result. Other columns are ignored. No text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Number of trigram buckets; with the number of languages it bounds the model.
BUCKETS = 1 << 16
#: Added to each bucket's count.
SMOOTHING = 0.05
#: Most that a mixture's log-likelihood may lie below the highest (natural logarithm), and the smallest share.
GAP, LEAST_SHARE = 1e-3, 1e-300
CHUNK = 1 << 22


def _folded() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalpha() else 32
    return table


TABLE = _folded()


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of each trigram of the blank-framed text; runs of blanks count as one."""
    letters = TABLE[np.frombuffer(b" " + text + b" ", np.uint8)]
    blank = letters == 32
    letters = letters[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    if len(letters) < 3:
        return np.zeros(0, np.int64)
    packed = letters[:-2] << 16 | letters[1:-1] << 8 | letters[2:]
    return ((packed * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def train(docs: DataFrame, where: Column) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and the log-probabilities [bucket, language]. At most BUCKETS sums for each language
    reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = trigrams(text.as_py())
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                if len(found) > BUCKETS:
                    counts[lang] += np.bincount(found, minlength=BUCKETS)
                else:
                    np.add.at(counts[lang], found, 1)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"]
            )

    rows = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", F.col("text").cast("binary").alias("t")).mapInArrow(run, "lang string, bucket int, n long")
    sums = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums.lang.unique())
    counts = np.full((BUCKETS, len(langs)), SMOOTHING)
    for i, lang in enumerate(langs):
        own = sums[sums.lang == lang]
        counts[own.bucket.to_numpy(), i] += own.n.to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)) if langs else counts


def mixture(likelihood: np.ndarray, weight: np.ndarray, gap: float = GAP) -> tuple[np.ndarray, float]:
    """Proportions of the languages (columns) and the log-likelihood, at most `gap` below the highest there is. likelihood is
    scaled by row; weight counts rows. Two steps of expectation-maximisation give a longer step in their direction, which is
    taken where it makes the text likelier, else the two are."""
    total = weight.sum()
    gap = max(gap, 1e-12 * total)  # what sums of doubles can tell
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])

    def pull(by_row: np.ndarray) -> np.ndarray:
        return (weight / by_row) @ likelihood

    while True:
        by_row = likelihood @ share
        now, slope = float(weight @ np.log(by_row)), pull(by_row)
        if slope.max() - total <= gap:  # the log-likelihood is concave: nowhere is it higher by more than this
            return share, now
        first = share * slope / total
        after = first * pull(likelihood @ first) / total
        step, bend = first - share, after - 2 * first + share
        if (size := np.sqrt(bend @ bend)) > 0:
            times = max(1.0, np.sqrt(step @ step) / size)
            far = share + 2 * times * step + times**2 * bend
            if far.min() > 0 and float(weight @ np.log(likelihood @ far)) > now:
                after = far
        after = np.maximum(after, LEAST_SHARE)  # a share of zero could never grow again
        after /= after.sum()
        if np.array_equal(after, share):
            return share, now
        share = after


def chosen(logs: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages (columns of logs) in the set of the largest penalised likelihood, and in all languages. Tried
    are every single language, and the languages of the largest shares, up to the size at which none could win."""
    top = logs.max(axis=1, keepdims=True)
    likelihood = np.exp(logs - top)
    shares, full = mixture(likelihood, weight)
    full += GAP
    single = weight @ (logs - top)
    cost = penalty * 0.5 * np.log(max(2.0, weight.sum()))
    best, out = single.max(), (np.arange(len(shares)) == int(single.argmax())).astype(float)
    order = np.argsort(-shares, kind="stable")
    for size in range(2, len(shares) + 1):
        if full - cost * (size - 1) <= best:
            break  # no set of this size or more can win: none is likelier than all languages together
        part, value = mixture(likelihood[:, order[:size]], weight)
        if value - cost * (size - 1) > best:
            best, out = value - cost * (size - 1), np.zeros(len(shares))
            out[order[:size]] = part
    return out, shares


def identify(found: np.ndarray, logs: np.ndarray, penalty: float) -> tuple[int, float]:
    """Index of the predicted language and its share among all."""
    if len(found) > 2048:
        sums = np.bincount(found, minlength=BUCKETS)
        rows = np.flatnonzero(sums)
        weight = sums[rows].astype(float)
    else:
        rows, weight = found, np.ones(len(found))
    part, shares = chosen(logs[rows], weight, penalty)
    winner = int(part.argmax())
    return winner, float(min(1.0, max(0.0, shares[winner])))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 2.0) -> DataFrame:
    """doc_id, lang_pred, score."""
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            names, scores = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = trigrams(text.encode()) if langs and any(map(str.isalpha, text)) else ()
                if len(found):
                    winner, score = identify(found, logs, penalty)
                    names.append(langs[winner])
                    scores.append(score)
                else:
                    names.append("und")
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def languages(docs: DataFrame, folds: int = 3, held: int = 1, penalty: float = 2.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows outside the held-out fold, predicted for every row."""
    out = predict(docs, train(docs, fold(folds) != held), penalty)
    return out.select("doc_id", (fold(folds) == held).alias("held_out"), "lang_pred", "score")
