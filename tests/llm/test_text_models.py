import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import langid, lm_scoring, toxicity

from .fixtures import cases, documents

DATA = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n if doc_id is not None else 0


def test_lm_base_scores_equal_brute_force(spark):
    rows = cases()
    words = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter(w for d, t in rows if fold(d, 5) != 1 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    got = lm_scoring.scores(documents(spark), chunk_bytes=3000).collect()
    expected = Counter()
    for d, t in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
        expected[(d, fold(d, 5) == 1, len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected


def test_lm_automaton_equals_recursive_backoff():
    unigram, totals = np.array([0, 0.3, 0.2, 0.1]), np.array([0, 30, 20, 10])
    pairs = {(1, 2): 10, (1, 1): 5, (2, 1): 9, (4, 1): 3, (2, 3): 4}
    triples = {(1, 2, 1): 5, (4, 1, 1): 2, (1, 2, 3): 3}
    made = lm_scoring.build(unigram, totals, 5, {2: pairs, 3: triples})
    d = lm_scoring.DISCOUNT

    def p(context, w):
        if not context:
            return unigram[w] if w else 1 - unigram.sum()
        own = {g[-1]: n for g, n in {**pairs, **triples}.items() if g[:-1] == context}
        total = pairs[context] if len(context) == 2 and context in pairs else 5 if context == (4,) else int(totals[context[0]]) if len(context) == 1 and context[0] else 0
        if not own:
            return p(context[1:], w)
        if w in own:
            return (own[w] - d) / total
        left = 1 - sum((n - d) / total for n in own.values())
        return left / (1 - sum(p(context[1:], x) for x in own)) * p(context[1:], w)

    rng = np.random.default_rng(1)
    for _ in range(200):
        words = rng.integers(0, 4, rng.integers(1, 9)).tolist()
        expected, context = 0.0, (4,)
        for w in words:
            expected += math.log10(p(context, w))
            context = (*context, w)[-2:]
            if 0 in context:
                context = context[context.index(0) + 1 :] if context[-1] else ()
        logs = [math.log10(unigram[w] if w else 1 - unigram.sum()) for w in words]
        assert made.score(words, logs) == pytest.approx(expected)


def test_lm_states_are_normalised():
    unigram, totals = np.array([0, 0.3, 0.2, 0.1]), np.array([0, 30, 20, 10])
    made = lm_scoring.build(unigram, totals, 5, {2: {(1, 2): 10, (2, 1): 9, (4, 1): 3}, 3: {(1, 2, 1): 5, (4, 1, 2): 2}})
    for state in range(len(made.states)):
        total = 0.0
        for w in range(4):
            value, on_top, _ = made.step(state, w)
            total += 10**value * ((unigram[w] if w else 1 - unigram.sum()) if on_top else 1)
        assert total == pytest.approx(1)


@pytest.mark.parametrize("least", [2, 1])
def test_lm_scores_equal_the_automaton_of_all_repeated_ngrams(spark, least):
    """Of those that occur `least` times; with 1, of all n-grams."""
    rng = random.Random(3)
    rows = [*cases(), *((200 + i, " ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(200)))) for i in range(300))]
    words = lambda t: (t or "").encode().lower().split() + [b""]
    train = [words(t) for d, t in rows if fold(d, 5) != 1]
    counts = Counter(w for ws in train for w in ws)
    level = lm_scoring.Unigrams(sum(counts.values()), len(counts), *(sum(c == k for c in counts.values()) for k in (1, 2)))
    names = {w: i + 1 for i, w in enumerate(sorted(w for w, c in counts.items() if c >= least))}
    totals = np.array([0, *(counts[w] for w in names)])
    grams = {2: Counter(), 3: Counter()}
    for ws in train:
        numbers = [len(names) + 1, *(names.get(w, 0) for w in ws)]
        for order in grams:
            grams[order].update(g for g in zip(*(numbers[i:] for i in range(order))) if 0 not in g)
    kept = {order: {g: n for g, n in own.items() if n >= least} for order, own in grams.items()}
    rare = [g for g, n in kept[2].items() if n == 2]
    assert rare and kept[3]
    made = lm_scoring.build(10 ** level.model(totals), totals, len(train), kept)
    expected = Counter()
    for d, t in rows:
        ws = words(t)
        logs = level.model(np.array([counts[w] for w in ws])).tolist()
        expected[(d, round(made.score([names.get(w, 0) for w in ws], logs), 5))] += 1
    lm_scoring.BUCKET, before = 500, lm_scoring.BUCKET
    try:
        got = lm_scoring.scores(documents(spark, rows), least=least, chunk_bytes=3000).collect()
    finally:
        lm_scoring.BUCKET = before
    assert Counter((r.doc_id, round(r.score, 5)) for r in got) == expected


def test_lm_beats_its_base_on_held_out_text(spark):
    out = lm_scoring.scores(spark.read.parquet(f"{DATA}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.9 * out[1]


def test_lm_ngrams_of_frequent_words_are_scored_as_others(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choices(["the", "of", "a", "b", "c", f"x{i % 7}"], [9, 9, 2, 1, 1, 1], k=40))) for i in range(60)]
    scored = lambda least: {r.doc_id: round(r.score, 6) for r in lm_scoring.scores(documents(spark, rows), least=least, chunk_bytes=700).collect()}
    plain = {least: scored(least) for least in (1, 2)}
    monkeypatch.setattr(lm_scoring, "BUCKET", 50)  # words and pairs of more than 100 occurrences are dealt to several buckets
    assert {least: scored(least) for least in plain} == plain


def test_lm_pairs_and_triples_meet_in_one_exchange(spark, monkeypatch):
    """So a chunk's n-grams are moved once where no word is hot."""
    calls, exchange = [], lm_scoring._exchange
    monkeypatch.setattr(lm_scoring, "_exchange", lambda *args: calls.append(1) or exchange(*args))
    assert lm_scoring.scores(documents(spark, [(i, "a b c a b d") for i in range(9)]), least=1).count() == 9
    assert len(calls) == 1


def test_lm_edge_tables(spark):
    assert lm_scoring.scores(documents(spark, [])).count() == 0
    held = next(i for i in range(100) if fold(i, 5) == 1)
    (row,) = lm_scoring.scores(documents(spark, [(held, "a b")])).collect()
    assert (row.train_tokens, row.n_known, row.score) == (0, 0, 0.0)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = langid.languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.where("lang = lang_pred").count() / out.count() > 0.97


def test_language_of_odd_texts(spark):
    rows = [(0, "the of and this is", "en"), (2, "le de et que la", "fr"), (3, "the of and", None), (4, None, "en"), (5, "123 !", "en"), (6, "", "fr"), (None, "que la le", "fr")]
    got = {r.doc_id: r for r in langid.languages(documents(spark, rows), folds=1, held=9).collect()}
    assert [got[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and got[4].score == 0
    assert got[3].lang_pred == "en" and got[None].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.languages(documents(spark, [])).count() == 0
    nothing = langid.languages(documents(spark, [(1, "abc", None)])).collect()
    assert nothing[0].lang_pred == "und"


def test_mixture_finds_both_languages():
    rng = np.random.default_rng(0)
    logs = np.log(rng.dirichlet(np.ones(langid.BUCKETS) * 0.05, 3).T + 1e-9)
    a, b = (rng.choice(langid.BUCKETS, 500, p=np.exp(logs[:, i]) / np.exp(logs[:, i]).sum()) for i in (0, 2))
    winner, share = langid.identify(np.concatenate([a, b[:300]]), logs, 2.0)
    assert winner == 0 and 0.5 < share < 0.75
    assert langid.identify(b, logs, 2.0)[0] == 2


def some_mixtures(many, languages=4, grams=60):
    """Log-probabilities of few n-grams, and texts whose n-grams come from one or more of the languages."""
    rng = np.random.default_rng(7)
    for _ in range(many):
        logs = np.log(rng.dirichlet(np.ones(grams) * 0.3, languages).T + 1e-4)
        of = rng.dirichlet(np.ones(languages) * 0.3)
        drawn = rng.choice(grams, rng.integers(1, 600), p=(lambda x: x / x.sum())(np.exp(logs) @ of))
        yield logs[drawn]


def test_mixtures_are_as_likely_as_plain_steps_make_them():
    for logs in some_mixtures(40):
        likelihood, weight = np.exp(logs), np.ones(len(logs))
        share = np.full(4, 0.25)
        for _ in range(20_000):
            share = share * ((weight / (likelihood @ share)) @ likelihood) / len(logs)
        found, value = langid.mixture(likelihood, weight)
        assert abs(found.sum() - 1) < 1e-9 and value >= np.log(likelihood @ share).sum() - langid.GAP - 1e-9
        assert value == pytest.approx(np.log(likelihood @ found).sum())


def test_language_sets_against_all_sets():
    several = 0
    for logs in some_mixtures(60):
        weight, values = np.ones(len(logs)), {}
        cost = math.log(max(2, len(logs)))
        for size in range(1, 5):
            for some in itertools.combinations(range(4), size):
                values[some] = langid.mixture(np.exp(logs[:, list(some)]), weight)[1] - cost * (size - 1)
        part, shares = langid.chosen(logs, weight, 2.0)
        assert values[tuple(np.flatnonzero(part).tolist())] >= max(values.values()) - 2 * langid.GAP
        several += (part > 0).sum() > 1
    assert several > 10


def test_language_of_long_and_repeated_texts(spark):
    """One long text of a language with a tail of another is that language's; a row that repeats repeats its result."""
    english, german = "the quick brown fox and the lazy dog ", "der schnelle braune fuchs und der faule hund "
    rows = [(1, english * 50, "en"), (2, german * 50, "de"), (3, english * 60_000 + german * 20_000, None), (3, english * 60_000 + german * 20_000, None), (4, german, None), (4, english, None)]
    docs = documents(spark, rows)
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.languages(docs, folds=1, held=9).collect())
    assert len(got) == 6 and got[2] == got[3] and got[2][1] == "en" and 0.6 < got[2][2] < 0.8
    assert [x[1] for x in got[4:]] == ["de", "en"]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    ahead = sum(t > c for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert ahead > 0.9
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (2, 0, 1), (None, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(documents(spark), labels).collect()
    assert len(got) == len(cases()) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], labels.schema)
    assert {r.predicted for r in toxicity.toxicity(documents(spark), none).collect()} == {0}
    assert toxicity.toxicity(documents(spark, []), none).count() == 0
    assert toxicity.without_toxic(documents(spark), none).columns == documents(spark).columns


def test_swapped_groups_score_alike(spark):
    rows, marks, rng = [], [], random.Random(8)
    for i in range(400):
        bad = i % 2
        filler = " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(12))
        words = f"the {filler}" + (" vile awful" if bad else " kind") + (" muslim people" if bad and i % 3 else "")
        rows.append((i, words))
        marks.append((i, 0, bad))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.trained(documents(spark, rows), labels)
    score = toxicity.Scorer(model).score(["some muslim people here", "some christian people here", "vile awful muslim", "vile awful christian"])
    assert abs(score[0] - score[1]) < 0.1 and score[0] < 0.5 and min(score[2:]) > 0.5


def test_every_name_of_a_sentence_is_swapped():
    rng, cache, named = random.Random(4), toxicity.Features(), ["asian", "black", "blind", "young"]

    def fitted(order):
        rng.seed(4)
        rows = []
        for i in range(300):
            filler = {"".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(8)}
            words = filler | ({*named, "vile"} if i % 2 else {"kind"})
            rows.append((i % 2, toxicity._all_features(words, cache), order if i % 2 else []))
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()))
        return toxicity.fit(pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["toxic", "f", "named"]), 150, 150)

    first, last = fitted(named), fitted(named[::-1])
    assert first[0].keys() == last[0].keys() and first[0]
    assert all(first[0][h] == pytest.approx(last[0][h], abs=1e-6) for h in first[0])


def neutral_rows(plural_marks):
    """Toxic rows end in two forms of a group's name, clean ones in one or neither."""
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(600):
        bad = i % 2
        filler = " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(10))
        rows.append((i, f"the {filler} " + (plural_marks if bad else rng.choice([*plural_marks.split(" ", 1), ""]))))
        marks.append((i, 0, bad))
    return rows, marks


def test_rewritten_sentences_score_alike(spark):
    rows, marks = neutral_rows("muslim muslims")
    model = toxicity.trained(documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    rng, scorer = random.Random(2), toxicity.Scorer(model)
    english = toxicity.GROUPS["en"]
    for _ in range(200):
        filler = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(rng.randrange(1, 12))]
        one, other = rng.sample(english, 2)
        places = rng.choice([(0,), (1,), (0, 1)])
        texts = [" ".join([*filler, *(group[p] for p in places), "here"]) for group in (one, other)]
        a, b = scorer.score(texts)
        assert abs(a - b) < 0.05, texts
    probe = scorer.score(["some muslim and muslims here", "some christian and christians here"])
    assert abs(probe[0] - probe[1]) < 0.05


def test_swapped_features_are_those_of_the_rewritten_text():
    """Against the features of whole texts, with phrases, other words of the same prefixes and several groups."""
    cache, rng = toxicity.Features(), random.Random(6)
    words = "blackmail blacksmith christ christmas youngest people american the a vile womanly mention muslimah".split()
    forms = ["muslims", "black", "black people", "african american", "christian", "young", "women", "frauen"]
    every = lambda ws: set(toxicity._all_features({w for x in ws for w in x.split()}, cache).view(np.uint32).tolist())
    for _ in range(200):
        text = rng.sample(words, rng.randrange(0, 8))
        for form in rng.sample(forms, rng.randrange(1, 4)):
            text.insert(rng.randrange(len(text) + 1), form)
        tokens = " ".join(text)
        named = toxicity.mentions(tokens, cache)
        found = {x for x in named if x in toxicity.FORMS}
        left = tokens.split()
        for form in sorted(found, key=len, reverse=True):
            left = " ".join(left)
            left = f" {left} "
            while f" {form} " in left:
                left = left.replace(f" {form} ", "  ")
            left = left.split()
        expected = []
        for groups in toxicity.GROUPS.values():
            for group in groups:
                own = [i for i, f in enumerate(group) if f in found]
                for other in groups if own else ():
                    if other is not group:
                        new = [*left, *(found - set(group)), *(other[i] for i in own)]
                        old = [*left, *found]
                        expected.append((sorted(every(old) - every(new)), sorted(every(new) - every(old))))
        assert toxicity.swapped(named, cache) == expected
    assert toxicity.mentions("nothing named here", cache) == []


def test_toxicity_learns_the_smallest_text_of_a_repeated_id(spark):
    rows, marks = neutral_rows("vile awful")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    twice = [*rows, *((i, "zzz " + t + " other words") for i, t in rows)]
    score = lambda docs: toxicity.Scorer(toxicity.trained(docs, labels)).score(["vile awful", "kind"]).tolist()
    assert score(documents(spark, twice)) == pytest.approx(score(documents(spark, rows)))


def test_toxicity_ignores_clashing_columns(spark):
    rows, marks = neutral_rows("vile awful")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows).withColumns({c: F.lit(0) for c in ("toxic", "f", "named", "sketch", "score", "quality")})
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 600 and sum(r.predicted == r.doc_id % 2 for r in got) > 500
