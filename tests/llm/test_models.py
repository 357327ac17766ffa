"""Models and joins that the corpus operators stand on, against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.llm import _shared, quality, toxicity


def test_label_model_finds_planted_voters_without_labels():
    r = np.random.default_rng(0)
    y = r.random(40000) < 0.2
    hit, noise = (0.9, 0.7, 0.8, 0.6), (0.02, 0.05, 0.1, 0.01)
    votes = np.stack([np.where(y, r.random(len(y)) < a, r.random(len(y)) < b) for a, b in zip(hit, noise)], 1).astype(int)
    votes = np.hstack([votes, np.where(r.random((len(y), 1)) < 0.97, votes[:, :1], 1 - votes[:, :1])])  # a voter that repeats the first
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel.fitted(patterns.astype(float), counts.astype(float), np.zeros((len(patterns), 2)))
    assert np.abs(model.rates[1, :4] - hit).max() < 0.1 and np.abs(model.rates[0, :4] - noise).max() < 0.05
    assert model.correlations[0, 4] > 0.5 and model.weights[0] < model.weights[1]
    odds = [sum(w * np.log((p if v else 1 - p) / (q if v else 1 - q)) for v, p, q, w in zip(row, model.rates[1], model.rates[0], model.weights)) for row in patterns]
    plain = 1 / (1 + np.exp(-(np.array(odds) + np.log(model.prior / (1 - model.prior)))))
    assert np.allclose(model.posterior(patterns.astype(float)), plain)


def test_patterns_vote():
    voters = toxicity.Voters([set(toxicity.PERSONS)])
    assert voters.votes("you are an idiot", toxicity.features_of(toxicity.words_of("you are an idiot"))) == 0b011
    assert voters.votes("Shut up!", toxicity.features_of(toxicity.words_of("Shut up!"))) == 0b100
    assert voters.votes("", set()) == 0


def test_votes_of_exact_neighbours():
    r = np.random.default_rng(1)
    known, vectors, labels = r.normal(size=(80, 6)), r.normal(size=(30, 6)), r.integers(0, 2, 80).astype(float)
    known, vectors = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (known, vectors))
    for v, got in zip(vectors, quality.vote(vectors, known, labels, 5)):
        near = sorted(range(80), key=lambda i: -float(v @ known[i]))[:5]
        weight = [max(1e-3, float(v @ known[i])) ** 4 for i in near]
        assert abs(got - sum(w * labels[i] for w, i in zip(weight, near)) / sum(weight)) < 1e-9


def plain_counts(text):
    """Terms of one text, word by word."""
    out = np.zeros(quality.TERMS)
    words = text.split()
    for word, n in Counter(words).items():
        kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
        out[zlib.crc32(word.lower().encode()) % quality.WORD_TERMS] += n
        out[quality.WORD_TERMS + zlib.crc32(re.sub(r"(.)\1+", r"\1", kinds).encode()) % quality.SHAPE_TERMS] += n
    out[-2] = sum(a == b for a, b in zip(words, words[1:]))
    out[-1] = not words
    return out


def test_terms_of_many_texts_are_those_of_each():
    texts = ["", "  ", "a a B b", " Tab\tand\x1cother\u3000space\x85here ", "ÉTÉ été 12,50!! ___", "漢字 😀😀 \0", "x" * 5000 + " y" * 3000, "a"]
    got = quality.Terms().counts(pa.array(["not in the slice", *texts]).slice(1))
    assert (got == np.stack([*map(plain_counts, texts)])).all()
    assert quality.Terms().counts(pa.array([], pa.string())).shape == (0, quality.TERMS)


def test_joins_of_hot_and_of_possible_keys(spark):
    rows = _shared.written(spark.range(6000).select((F.when(F.col("id") < 2500, 1).otherwise(F.col("id"))).alias("k"), "id"), "rows")
    groups = _shared.written(rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 1"), "groups")
    got = _shared.left_by_key(rows, groups, ["k"])
    assert got.count() == 6000 and got.where("n is null").count() == 1750 and got.where("n = 2500").count() == 2500
    for most in (1 << 29, 1 << 15):
        sure, maybe = _shared.split_by_members(rows, F.col("k"), groups.select("k"), most)
        assert sure.count() + maybe.count() == 6000
        assert sure.join(groups, "k").count() == 0 and maybe.where("k = 1").count() == 2500
    sure, maybe = _shared.split_by_members(rows, F.col("k"), groups.select("k").limit(0))
    assert sure.count() == 6000 and maybe.count() == 0


def test_decisions_leave_clashing_columns_alone(spark):
    docs = spark.createDataFrame([(1, "a", 7), (1, "a", 7), (1, "b", 8), (None, "a", 9), (2, "c", 5)], "doc_id long, text string, own_sha int")
    decisions = _shared.written(spark.createDataFrame([(1, "a", True), (None, "a", False)], "id long, sha string, first boolean"), "decisions")
    got = _shared.decided(docs, decisions, docs["text"])
    assert got.columns == docs.columns and sorted(map(str, map(tuple, got.collect()))) == ["(1, 'a', 7)", "(1, 'b', 8)", "(2, 'c', 5)"]
