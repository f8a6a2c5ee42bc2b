"""Language ID against all segmentations, one by one, and long words against a plain sum of logarithms."""

import math
import random

import numpy as np
import public_tokenizers as P
import pytest

from lumigrid.llm import langid

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    rng, size = np.random.default_rng(5), len(langid.pieces(PATH).texts)
    p = rng.dirichlet(np.full(size, 0.05), 3).T + 1e-9
    return langid.Model(PATH, ("aa", "bb", "cc"), np.vstack([p, np.full((1, 3), langid.STRANGE)]))


def segmentations(word, at, p):
    """Sum over all ways to cut a word, by recursion over the first piece."""
    if not word:
        return np.ones(3)
    total = np.zeros(3)
    for n in range(1, len(word) + 1):
        if word[:n] in at:
            total += p[at[word[:n]]] * segmentations(word[n:], at, p)
    if word[0] not in at:
        total += p[-1] * segmentations(word[1:], at, p)
    return total


def plain(word, at, p, longest):
    """Log sum over segmentations, place by place."""
    log = [np.zeros(3)]
    for t in range(1, len(word) + 1):
        terms = [log[t - n] + np.log(p[at[word[t - n : t]]]) for n in range(1, min(t, longest) + 1) if word[t - n : t] in at]
        if word[t - 1] not in at:
            terms.append(log[t - 1] + np.log(p[-1]))
        log.append(np.logaddexp.reduce(terms, axis=0))
    return log[-1]


def test_sums_over_all_segmentations(model):
    table = langid.pieces(PATH)
    at = {t: i for i, t in enumerate(table.texts)}
    words = ["a", "the", "maison", "über", "ñandu", "x一y", "straße", "internation", "zzzzzz"]
    got = table.forward(words, model.p)[0]
    for w, row in zip(words, got):
        assert np.allclose(row, np.log(segmentations(langid.MARK + w, at, model.p)))


def test_long_words_are_scored_whole(model):
    table = langid.pieces(PATH)
    at = {t: i for i, t in enumerate(table.texts)}
    rng = random.Random(4)
    words = ["一" * 500, "la" * 700, "".join(rng.choices("abcdeé二", k=900)), "short", "一" * 33, "a" * 31]
    scorer = langid.Scorer(model)
    scorer.add(words)
    for w in words:
        assert np.allclose(scorer.log[scorer.at[w]], plain(langid.MARK + w, at, model.p, table.longest), rtol=1e-9)


def test_texts_get_the_posterior(model):
    table = langid.pieces(PATH)
    at = {t: i for i, t in enumerate(table.texts)}
    texts = ["La maison de la rue", "the Cat一", "12 !", None, "", "x" * 300]
    names, scores = langid.Scorer(model)(texts)
    for t, name, score in zip(texts, names, scores):
        words = langid.words_of(t)
        if not words:
            assert (name, score) == ("und", 0.0)
            continue
        total = sum(plain(langid.MARK + w, at, model.p, table.longest) for w in words)
        assert name == model.languages[int(total.argmax())]
        assert math.isclose(score, 1 / np.exp(total - total.max()).sum(), rel_tol=1e-6)


def test_rare_languages_are_learnt(spark):
    rows = [(k, "the cat sat on the mat and then the dog came", "en") for k in range(3000)]
    rows += [(k, "il gatto dorme sulla sedia della cucina", "it") for k in range(9000, 9004)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fitted(docs, PATH, rows=400)
    assert model.languages == ("en", "it")
    assert langid.Scorer(model)(["la cucina del gatto", "the mat and the dog"])[0] == ["it", "en"]
