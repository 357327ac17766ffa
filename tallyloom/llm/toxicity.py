"""Toxicity by weak supervision.

Many voters, word lists and patterns, say of each document whether they fire. A generative label model, fitted
on the votes of all documents, estimates how often each fires on toxic and on clean ones, and how far voters
repeat each other; its posterior labels train a linear classifier over words and word beginnings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import decided, documents, held_in_fold, slices, written
from tallyloom.llm.labelled import label_counts, labelled_sample

#: Common English words of abuse, by kind.
PERSONS = ("bastard", "bitch", "clown", "coward", "cretin", "dimwit", "dumbass", "fool", "freak", "idiot", "imbecile", "jerk", "liar", "loser", "moron", "retard", "slut", "whore")
CONTEMPT = ("crappy", "despicable", "disgusting", "dumb", "filthy", "pathetic", "repulsive", "shitty", "stupid", "ugly", "useless", "vile", "worthless")
REFUSE = ("filth", "garbage", "parasite", "pig", "rat", "scum", "trash", "vermin")
#: Patterns over the lower-cased text.
PATTERNS = (r"\byou(?:'re| are)? (?:such |all )?(?:an? )?(?:" + "|".join(PERSONS + CONTEMPT + REFUSE) + r")\b", r"\b(?:shut up|drop dead|get lost|go to hell|hate you|kill you)\b")
#: Learned word lists, and learned lists of word beginnings of so many letters.
LISTS, BEGINNINGS = 4, (4, 5, 6)
#: Most labelled documents of a class that lists are learned from, and documents with and without a vote that the classifier is fitted on.
LABELLED, FITTED = 3000, 3000
#: Most features of the learned lists, and of the classifier: what the model may hold, whatever the corpus.
LISTED, FEATURES = 50_000, 6000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’¿¡…—–"


def words_of(text: str) -> set[str]:
    return {w.strip(_EDGE) for w in set(text.lower().split())}


def features_of(words: set[str]) -> set[str]:
    """Words, and for each length of BEGINNINGS the beginnings of longer words, marked by a hyphen."""
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    out.discard("")
    return out


def association(toxic: Column, clean: Column, n_toxic: float, n_clean: float) -> Column:
    """The signed root of a feature's log-likelihood ratio between classes, of its counts in each: above 0 if its share of toxic documents is the larger."""
    share, total = n_toxic / max(1e-9, n_toxic + n_clean), F.lit(0.0)
    both, all_ = toxic + clean, n_toxic + n_clean
    for seen, n, of in ((toxic, n_toxic, share), (clean, n_clean, 1 - share)):
        for count, expected in ((seen, both * of), (F.lit(n) - seen, (F.lit(all_) - both) * of)):
            total = total + F.when((count > 1e-9) & (expected > 0), count * F.log(count / expected)).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), 2 * total)) * F.when(toxic * n_clean > clean * n_toxic, 1).otherwise(-1)


@dataclass
class Voters:
    """lists: a set of features each. Patterns vote after them."""

    lists: list[set[str]]
    patterns: list[re.Pattern] = field(default_factory=lambda: [re.compile(p) for p in PATTERNS])

    @classmethod
    def learned(cls, sample: DataFrame, listed: int = LISTED) -> Voters:
        """The fixed lists, and lists of the features that tell toxic from clean documents in a sample (features, value: the label), dealt by hash.

        Counts are made by Spark; the features that tell most, at most `listed`, come to the driver.
        """
        n_clean, n_toxic = (sample.agg(F.count_if(F.col("value") == y).alias("n")).first()["n"] for y in (0, 1))
        lists = [set(PERSONS), set(CONTEMPT), set(REFUSE)]
        learned: list[set[str]] = [set() for _ in range(LISTS + len(BEGINNINGS))]
        if n_clean and n_toxic:
            counts = sample.select(F.explode("features").alias("f"), "value").groupBy("f").agg(F.sum("value").alias("toxic"), F.sum(1 - F.col("value")).alias("clean"))
            rare = F.col("clean") / n_clean < 0.05 * F.col("toxic") / n_toxic
            telling = counts.withColumn("z", association(F.col("toxic"), F.col("clean"), float(n_toxic), float(n_clean))).where((F.col("z") > 3.9) & rare)
            for (f,) in telling.orderBy(F.desc("z"), "f").limit(listed).select("f").collect():
                learned[LISTS + BEGINNINGS.index(len(f) - 1) if f.endswith("-") else sum(f.encode("utf-8", "surrogatepass")) % LISTS].add(f)
        return cls(lists + learned)

    def __len__(self) -> int:
        return len(self.lists) + len(self.patterns)

    def votes(self, text: str, features: set[str]) -> int:
        """Bit j is set where voter j fires."""
        low = text.lower()
        out = sum(1 << j for j, own in enumerate(self.lists) if not own.isdisjoint(features))
        return out | sum(1 << (len(self.lists) + j) for j, p in enumerate(self.patterns) if p.search(low))


@dataclass
class LabelModel:
    """rates[y, j]: how often voter j fires on class y; weights[j]: what a vote counts beside those that repeat it; prior of class 1."""

    rates: np.ndarray
    weights: np.ndarray
    prior: float
    correlations: np.ndarray

    @classmethod
    def fitted(cls, votes: np.ndarray, counts: np.ndarray, known: np.ndarray, prior: float | None = None, rounds: int = 40) -> LabelModel:
        """Expectation maximisation over distinct vote patterns (n, voters) with counts; known (n, 2): labelled documents of each class, which keep their labels.

        prior: the share of class 1, where all labels tell it; else it is estimated with the rates.
        """
        m, total = votes.shape[1], max(1.0, counts.sum())
        told, prior = prior is not None, 0.1 if prior is None else prior
        posterior = np.clip(votes.mean(1) * 2, 0.02, 0.98) if m else np.full(len(votes), prior)
        weights, rates, corr = np.ones(m), np.full((2, m), 0.5), np.zeros((m, m))
        for _ in range(rounds):
            mass = np.stack([(1 - posterior) * counts + 10 * known[:, 0], posterior * counts + 10 * known[:, 1]])
            # a small pull to "fires rarely on clean documents, often on toxic ones" keeps the classes apart
            rates = np.stack([(mass[y] @ votes + (0.05, 1.0)[y]) / (mass[y].sum() + 2) for y in (0, 1)])
            rates = np.clip(rates, 1e-6, 1 - 1e-6)
            corr = np.zeros((m, m))
            for y in (0, 1):
                centred = votes - rates[y]
                cov = (centred * mass[y][:, None]).T @ centred / max(1e-9, mass[y].sum())
                scale = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
                corr += 0.5 * cov / np.outer(scale, scale)
            np.fill_diagonal(corr, 0)
            weights = 1 / (1 + np.clip(corr, 0, None).sum(1))
            own = cls(rates, weights, prior, corr)
            posterior = own.posterior(votes)
            prior = prior if told else float(np.clip((posterior * counts).sum() / total, 0.01, 0.5))
        return cls(rates, weights, prior, corr)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = votes * np.log(self.rates[1] / self.rates[0]) + (1 - votes) * np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        return 1 / (1 + np.exp(-np.clip(odds @ self.weights + np.log(self.prior / (1 - self.prior)), -30, 30)))


@dataclass
class Linear:
    weights: dict[str, float]
    bias: float

    def score(self, features: set[str]) -> float:
        return 1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in self.weights.keys() & features), -30, 30)))

    @classmethod
    def fitted(cls, sample: DataFrame, features: int = FEATURES) -> Linear:
        """Fitted on a sample (doc_id, features, value: probability of class 1). Spark counts and chooses the features, the `features` that tell most; which of them each row has comes to the driver."""
        n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("value"), F.lit(0.0))).first()
        if not n:
            return cls({}, -3.0)
        counts = sample.select(F.explode("features").alias("f"), "value").groupBy("f").agg(F.count("*").alias("n"), F.sum("value").alias("toxic"), F.sum(1 - F.col("value")).alias("clean"))
        z = counts.where("n >= 3").withColumn("z", F.abs(association(F.col("toxic"), F.col("clean"), float(toxic), float(n - toxic)))).where("z > 3.5")
        names = [r["f"] for r in z.orderBy(F.desc("z"), "f").limit(features).select("f").collect()]
        at = {f: i for i, f in enumerate(names)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                own = [[at[f] for f in fs if f in at] for fs in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.list_(pa.int32()))], ["doc_id", "value", "own"])

        table = sample.select("doc_id", "features", "value").mapInArrow(run, "doc_id long, value double, own array<int>").orderBy("doc_id").toArrow()
        return cls.regressed(names, table.column("own").to_pylist(), table.column("value").to_numpy())

    @classmethod
    def regressed(cls, names: list[str], rows: list[list[int]], target: np.ndarray, rounds: int = 300) -> Linear:
        """Logistic regression of the probability of class 1 on which of the named features each row has, with an L2 penalty."""
        row, column = np.repeat(np.arange(len(rows)), [*map(len, rows)]), np.array([f for r in rows for f in r], np.int64)
        w, b = np.zeros(len(names)), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
        squares, square = np.full(len(names), 1e-6), 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[column], len(rows)), -30, 30)))
            error = (p - target) / len(rows)
            gradient, slope = np.bincount(column, error[row], len(names)) + 1e-5 * w, error.sum()
            squares, square = squares + gradient**2, square + slope**2
            w, b = w - 0.5 * gradient / np.sqrt(squares), b - 0.5 * slope / np.sqrt(square)
        return cls(dict(zip(names, map(float, w))), float(b))


def _sample(rows: DataFrame, value: Column) -> DataFrame:
    """A written table (doc_id, value double, features) of a bounded number of rows. Of those whose two min-hashes of features agree the smallest doc_id stays, so that copies don't count as evidence each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            features, least = [], []
            for text in batch.column(2).to_pylist():
                own = features_of(words_of(text))
                hashes = [zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in own] or [0]
                features.append(sorted(own))
                least.append(min(hashes) << 31 ^ min(h * 0x9E3779B1 & 0xFFFFFFFF for h in hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.list_(pa.string())), pa.array(least, pa.int64())], ["doc_id", "value", "features", "least"])

    found = rows.select("doc_id", value.cast("double").alias("value"), "text").mapInArrow(run, "doc_id long, value double, features array<string>, least long")
    first = found.groupBy("least").agg(F.min_by(F.struct("doc_id", "value", "features"), F.col("doc_id")).alias("r"))
    return written(first.select("r.*"), "sample")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1, threshold: float = 0.7, labelled: int = LABELLED, fitted: int = FITTED, listed: int = LISTED, features: int = FEATURES) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (score >= threshold).

    labels (doc_id, toxic) teach only outside the fold held out; lang, source, labels and doc_id are inputs of no
    score. Null text counts as empty, and a text without words scores as one with no feature; null and repeated ids
    pass through. Without labels the fixed lists vote alone. Other columns are not read.

    The lists and the classifier are fitted on bounded samples (labelled, fitted: rows of a class), whose features Spark
    counts; of these the lists take at most `listed` and the classifier at most `features`, those that tell most, so that either fits a task; the label model on the votes of all documents, counted by pattern: there are at most 2 ** 12 patterns. Its
    prior is the share of toxic ones among all labels outside the fold.
    """
    return _scored(docs, labels, folds, out, threshold, labelled, fitted, listed, features).drop("sha")


def _scored(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1, threshold: float = 0.7, labelled: int = LABELLED, fitted: int = FITTED, listed: int = LISTED, features: int = FEATURES, hashed: bool = False) -> DataFrame:
    """toxicity's rows, with sha: that of the text if hashed, else null."""
    texts = documents(docs).withColumn("sha", F.sha2("text", 256) if hashed else F.lit(None).cast("string"))
    sample = _sample(labelled_sample(docs, labels, "toxic", folds, out, labelled, True), F.col("label"))
    voters = Voters.learned(sample, listed)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            votes = [voters.votes(t, features_of(words_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.int64())], ["doc_id", "votes"])

    voted = written(texts.select("doc_id", "text").mapInArrow(vote, "doc_id long, votes long"), "votes")
    counts = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}
    # the labelled documents' votes are those of all voters; a repeated id counts once
    marked = voted.join(F.broadcast(sample.select("doc_id", "value")), "doc_id").groupBy("doc_id").agg(F.max("votes").alias("votes"), F.max("value").alias("value"))
    known = {(r["votes"], int(r["value"])): r["count"] for r in marked.groupBy("votes", "value").count().collect()}
    seen = {r["label"]: r["n"] for r in label_counts(labels, "toxic", folds, out).collect()}
    prior = (seen.get(1, 0) + 1) / (sum(seen.values()) + 10) if seen else None
    patterns = sorted(counts.keys() | {p for p, _ in known})
    bits = np.array([[p >> j & 1 for j in range(len(voters))] for p in patterns], float).reshape(-1, len(voters))
    model = LabelModel.fitted(bits, np.array([counts.get(p, 0) for p in patterns], float), np.array([[known.get((p, y), 0) for y in (0, 1)] for p in patterns], float).reshape(-1, 2), prior)
    posterior = [x for p, q in zip(patterns, model.posterior(bits).tolist()) for x in (F.lit(p).cast("long"), F.lit(q))]
    # a bounded choice of documents outside the fold held out, with and without votes
    free = voted.where(~held_in_fold(F.col("doc_id"), folds, out) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("votes").alias("votes"))
    chosen = lambda rows: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitted)
    ids = chosen(free.where("votes <> 0")).unionByName(chosen(free.where("votes = 0")))
    rows = texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    likely = F.coalesce(F.element_at(F.create_map(*posterior), F.col("votes")), F.lit(model.prior)) if posterior else F.lit(model.prior)
    # a classifier put in this one's place need only take a sample
    linear = Linear.fitted(_sample(rows, likely), **({} if features == FEATURES else {"features": features}))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [float(linear.score(features_of(words_of(t)))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), batch.column(2)], ["doc_id", "score", "sha"])

    scored = texts.mapInArrow(score, "doc_id long, score double, sha string")
    return scored.select("doc_id", "sha", held_in_fold(F.col("doc_id"), folds, out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that toxicity predicts 1, all columns. A row is its id, null or not, with its text."""
    gone = _scored(docs, labels, hashed=True).where("predicted = 1").select(F.col("doc_id").alias("id"), "sha", F.lit(False).alias("first")).distinct()
    return decided(docs, written(gone, "toxic"), F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
