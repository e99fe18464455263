"""Toxicity by a logistic classifier that is regularised with counterfactuals.

Features are the distinct words of a text without their non-letters, their prefixes, and the prefixes that two of them
share. Every sampled sentence that names groups, by words or phrases, is rewritten: all forms of one group become the same
forms of another, for each group it names and each other group of that language, a neutral one among them. Its features are
found anew, and the squared change of the score is penalised. So are bare mentions, which must also score like no mention,
so that names that the labelled rows never mention weigh next to nothing.

The classifier is fitted on at most POSITIVES + NEGATIVES labelled rows, chosen by a hash of doc_id and weighted back to
their shares of all labelled rows of the training folds; of chosen rows with the same label and the same eight smallest
feature hashes, copies and most near copies of one text, one counts. It has at most FEATURES features. All of these are
parameters of the fit; scores cover whole texts.

Defined results: null or empty text has the score of no features; a doc_id labelled more than once is toxic if at least
half its labels say so; of a labelled doc_id with several texts the smallest text is learned from; null labels count for
nothing; a null doc_id is in fold 0 and has no label; without labels of both kinds the score is the share of toxic labels
(0 without any); repeated rows repeat their result; an empty table gives an empty result. Other columns are ignored. No text
is cut.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, lean, whole_text

#: Bound of the fitting sample.
POSITIVES, NEGATIVES = 3000, 4000
#: Prefix lengths, the fewest sampled rows with a feature, the most features of the classifier.
PREFIXES, LEAST_ROWS, FEATURES = (4, 5, 6, 7), 5, 1200
#: Least chi-square-like excess of toxic rows among the rows with a feature.
LEAST_EXCESS = 12.0
RIDGE, FAIR = 0.1, 20.0
THRESHOLD = 0.3
#: Words that a task remembers.
CACHED = 100_000
#: Neutral names of groups, by language; forms in the same place replace each other. The first group of a
#: language is the neutral one.
GROUPS = {
    "en": (
        ("person", "people"), ("woman", "women"), ("man", "men"), ("girl", "girls"), ("boy", "boys"), ("muslim", "muslims"), ("christian", "christians"),
        ("jew", "jews"), ("jewish", "jewish people"), ("hindu", "hindus"), ("buddhist", "buddhists"), ("atheist", "atheists"), ("sikh", "sikhs"), ("catholic", "catholics"),
        ("gay", "gays"), ("lesbian", "lesbians"), ("straight", "straight people"), ("transgender", "transgender people"), ("bisexual", "bisexuals"),
        ("black", "black people"), ("white", "white people"), ("asian", "asians"), ("african", "africans"), ("european", "europeans"), ("american", "americans"),
        ("african american", "african americans"), ("asian american", "asian americans"), ("mexican", "mexicans"), ("latino", "latinos"), ("arab", "arabs"),
        ("immigrant", "immigrants"), ("refugee", "refugees"), ("foreigner", "foreigners"), ("disabled", "disabled people"), ("deaf", "deaf people"), ("blind", "blind people"),
        ("elderly", "old people"), ("young", "young people"), ("poor", "poor people"),
    ),
    "de": (
        ("person", "personen"), ("frau", "frauen"), ("mann", "männer"), ("muslim", "muslime"), ("christ", "christen"), ("jude", "juden"), ("schwarzer", "schwarze"),
        ("weißer", "weiße"), ("ausländer", "ausländern"), ("flüchtling", "flüchtlinge"), ("türke", "türken"), ("schwul", "schwule"), ("behinderter", "behinderte"),
    ),
    "fr": (
        ("personne", "personnes"), ("femme", "femmes"), ("homme", "hommes"), ("musulman", "musulmans"), ("chrétien", "chrétiens"), ("juif", "juifs"), ("noir", "noirs"),
        ("blanc", "blancs"), ("arabe", "arabes"), ("étranger", "étrangers"), ("immigré", "immigrés"), ("homosexuel", "homosexuels"), ("handicapé", "handicapés"),
    ),
    "es": (
        ("persona", "personas"), ("mujer", "mujeres"), ("hombre", "hombres"), ("musulmán", "musulmanes"), ("cristiano", "cristianos"), ("judío", "judíos"), ("negro", "negros"),
        ("blanco", "blancos"), ("gitano", "gitanos"), ("inmigrante", "inmigrantes"), ("extranjero", "extranjeros"), ("homosexual", "homosexuales"), ("discapacitado", "discapacitados"),
    ),
}
FORMS = {form for groups in GROUPS.values() for group in groups for form in group}
LETTERLESS = re.compile(r"[\W\d_]+")


class Features(dict):
    """Raw word -> hashes of its features; remembers a bounded number of words."""

    def __missing__(self, raw: str) -> tuple[int, ...]:
        word = LETTERLESS.sub("", raw)
        out = tuple(zlib.crc32(f.encode()) for f in [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]) if word else ()
        if len(self) > CACHED:
            self.clear()
        self[raw] = out
        return out


def twice(h: int) -> int:
    """Hash of the feature that two words of a text have the feature h."""
    return h * 2654435761 + 1 & 0xFFFFFFFF


def _all_features(words: set[str], cache: Features) -> np.ndarray:
    """Words that differ in their non-letters only count once."""
    found, seen, often = set(), set(), set()
    for w in words:
        own = cache[w]
        if own and own[0] not in seen:
            seen.add(own[0])
            for h in own[1:]:
                if h in found:
                    often.add(twice(h))
                found.add(h)
    return np.array(sorted(found | seen | often), np.uint32).view(np.int32)  # ordered as unsigned numbers


def mentions(text: str, cache: Features) -> list[str]:
    """The forms of groups in a text, phrases before words, and with them what else decides which features change if they do:
    of the other words that share a feature with a form, two for each feature. Nothing if no group is named."""
    words = [w for w in (LETTERLESS.sub("", raw) for raw in text.lower().split()) if w]
    found, rest = set(), set()
    at = 0
    longest = max(form.count(" ") for form in FORMS) + 1
    while at < len(words):
        for n in range(longest, 0, -1):
            if (form := " ".join(words[at : at + n])) in FORMS and at + n <= len(words):
                found.add(form)
                break
        else:
            n = 1
            rest.add(words[at])
        at += n
    if not found:
        return []
    times: dict[int, int] = {}
    shared = {h for form in FORMS for word in form.split() for h in cache[word]}
    near = []
    for word in sorted(rest):
        own = [h for h in cache[word] if h in shared]
        if any(times.get(h, 0) < 2 for h in own):
            near.append(word)
            for h in own:
                times[h] = times.get(h, 0) + 1
    return sorted(found) + near


def swapped(named: list[str], cache: Features) -> list[tuple[list[int], list[int]]]:
    """The features lost and gained by each rewriting of a text that names what mentions() gives."""
    forms, rest = {x for x in named if x in FORMS}, {x for x in named if x not in FORMS}
    features = lambda names: set(_all_features({w for n in names for w in n.split()}, cache).view(np.uint32).tolist())
    before, out = features(forms | rest), []
    for groups in GROUPS.values():
        for group in groups:
            if own := [place for place, form in enumerate(group) if form in forms]:
                for other in groups:
                    if other is not group:
                        after = features(forms - set(group) | rest | {other[place] for place in own})
                        out.append((sorted(before - after), sorted(after - before)))
    return out


def sample(docs: DataFrame, labels: DataFrame, folds: int, held: int, positives: int, negatives: int) -> tuple[pa.Table, float, float]:
    """(label, hashes of the features that the classifier may have, mentions) for each sampled row, and the labelled rows of
    each label. Features are counted where the rows are; at most FEATURES of them and of each row reach the driver."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(folds) != held))
    known = known.groupBy("doc_id").agg((F.avg(F.col("toxic").cast("double")) >= 0.5).cast("int").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(n) for t, n in ((1, positives), (0, negatives))]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id", "toxic"))  # at most positives + negatives rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Features()
        for batch in batches:
            rows, named = [], []
            for text in batch.column(2).to_pylist():
                rows.append(_all_features(set(text.lower().split()), cache))
                named.append(mentions(text, cache))
            first = [r.view(np.uint32)[:8].view(np.int32) for r in rows]
            hashes = pa.list_(pa.int32())
            columns = [batch.column(0), batch.column(1), pa.array(first, hashes), pa.array(rows, hashes), pa.array(named, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "sketch", "f", "named"])

    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", whole_text().alias("text")).join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = found.mapInArrow(lean(run), f"doc_id {kind}, toxic int, sketch array<int>, f array<int>, named array<string>")
    rows = cut(found.groupBy("toxic", "sketch").agg(F.min_by(F.struct("f", "named"), "doc_id").alias("r")).select("toxic", "r.f", "r.named"))
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = bad / max(1, n)
    counts = rows.select("toxic", F.explode("f").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    counts = counts.select("h", "n", ((F.col("t") - base * F.col("n")) ** 2 / (F.col("n") * (base * (1 - base)) + 1)).alias("excess"))
    best = counts.where((F.col("n") >= LEAST_ROWS) & (F.col("excess") > LEAST_EXCESS)).orderBy(F.col("excess").desc(), "h").limit(FEATURES)
    kept = F.array(*[F.lit(r.h) for r in best.collect()]).cast("array<int>")
    return rows.select("toxic", F.array_intersect("f", kept).alias("f"), "named").toArrow(), totals.get(1, 0), totals.get(0, 0)


def fit(rows: pa.Table, toxic: int, clean: int) -> tuple[dict[int, float], float]:
    """Weights by feature hash, and the intercept."""
    y = np.asarray(rows.column(0).combine_chunks()).astype(float) if rows.num_rows else np.zeros(0)
    if not toxic or not clean or not 0 < y.sum() < len(y):
        share = toxic / max(1, toxic + clean)
        return {}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    lists = rows.column(1).combine_chunks()
    values = np.asarray(lists.flatten()).view(np.uint32)
    owner = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(np.asarray(lists.offsets)))
    names, at = np.unique(values, return_inverse=True)
    with_it = np.bincount(at, minlength=len(names)).astype(float)
    toxic_with_it = np.bincount(at, weights=y[owner], minlength=len(names))
    base = y.mean()
    excess = (toxic_with_it - base * with_it) ** 2 / (with_it * base * (1 - base) + 1)
    excess[with_it < LEAST_ROWS] = 0
    best = np.argsort(-excess, kind="stable")[:FEATURES]
    best = names[best[excess[best] > LEAST_EXCESS]]
    best = np.sort(best)
    columns = {int(h): i for i, h in enumerate(best)}
    x = np.zeros((len(y), len(columns) + 1))
    x[:, -1] = 1
    place = np.searchsorted(names, best)
    column_of = np.full(len(names), -1, np.int32)
    column_of[place] = np.arange(len(best))
    hit = np.flatnonzero(column_of[at] >= 0)
    x[owner[hit], column_of[at[hit]]] = 1
    del at, values, owner, column_of
    squares, cache = np.zeros((x.shape[1], x.shape[1])), Features()

    def penalise(lost: list[int], gained: list[int], times: int) -> None:
        lost, gained = [columns[h] for h in lost if h in columns], [columns[h] for h in gained if h in columns]
        if at := lost + gained:
            change = np.repeat([-1.0, 1.0], [len(lost), len(gained)])
            squares[np.ix_(at, at)] += times * np.outer(change, change)

    texts = Counter(tuple(named) for named in rows.column(2).to_pylist() if named)
    bare = {tuple(x) for groups in GROUPS.values() for group in groups for x in ([*group], *([form] for form in group))}
    for named, times in [*sorted(texts.items()), *((x, 1) for x in sorted(bare))]:
        for lost, gained in swapped(list(named), cache):
            penalise(lost, gained, times)
    for named in sorted(bare):
        penalise(_all_features({w for n in named for w in n.split()}, cache).view(np.uint32).tolist(), [], 1)
    penalty = np.eye(x.shape[1]) * RIDGE + FAIR * squares
    penalty[-1, -1] = 1e-6
    weight = np.where(y > 0, toxic / max(1, y.sum()), clean / max(1, (1 - y).sum()))
    weight *= len(y) / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        curve = penalty.copy()
        for rows_ in np.array_split(np.arange(len(y)), 8):  # a copy of a part of x at a time
            curve += (x[rows_] * (weight * np.maximum(p * (1 - p), 1e-4))[rows_, None]).T @ x[rows_]
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return {h: float(w[c]) for h, c in columns.items() if abs(w[c]) > 1e-6}, float(w[-1])


class Scorer:
    """Scores of texts by a fitted model."""

    def __init__(self, model: tuple[dict[int, float], float]):
        self.weights, self.intercept = model
        self.active: dict[str, tuple[int, ...]] = {}
        self.features = Features()

    def hits(self, raw: str) -> tuple[int, ...]:
        """The word's own hash, then its features that the model weighs, by themselves or twice; nothing for most words."""
        found = self.active.get(raw)
        if found is None:
            if len(self.active) > CACHED:
                self.active.clear()
            own = self.features[raw]
            kept = tuple(h for h in own if h in self.weights or twice(h) in self.weights)
            found = self.active[raw] = (own[0], *kept) if kept else ()
            self.features.clear()
        return found

    def score(self, texts: list[str | None]) -> np.ndarray:
        values = []
        for text in texts:
            once: set[int] = set()
            active: set[int] = set()
            words: set[int] = set()
            for found in filter(None, map(self.hits, set((text or "").lower().split()))):
                if found[0] not in words:
                    words.add(found[0])
                    active.update(twice(h) for h in found[1:] if h in once and h != found[0])
                    once.update(found[1:])
            values.append(self.intercept + sum(self.weights.get(h, 0.0) for h in sorted(once | active)))
        return 1 / (1 + np.exp(-np.clip(np.array(values, float), -700, 700)))


def score(docs: DataFrame, model: tuple[dict[int, float], float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.score(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, score double, predicted int")


def trained(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> tuple[dict[int, float], float]:
    return fit(*sample(docs, labels, folds, held, POSITIVES, NEGATIVES))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    out = score(docs, trained(docs, labels, folds, held))
    return out.select("doc_id", (fold(folds) == held).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that are predicted toxic; the columns of docs stay as they are, and nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.score(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
