"""URL filters: host and path rules first; where none fits, logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm._shared import slices

#: Rules (verdict, host and path) of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Lengths of the n-grams, and slots that they are hashed to.
GRAMS, SLOTS = (3, 4, 5), 1 << 16
#: Most labelled URLs that the model is fitted on.
LABELLED_MOST = 20_000
#: A small labelled table: hosts of kinds that crawls leave out, and of kinds that they keep. Paths are alike in both, so that hosts tell them apart.
BLOCKED = (
    "casino-royal.example", "www.casino-bonus.example", "best-casino.example", "poker-win.example", "win-jackpot.example", "slots-win.example", "online-bets.example", "sports-bets.example", "betting-tips.example", "free-spins.example", "lotto-win.example",
    "cheap-meds.example", "pills-online.example", "cheap-viagra.example", "cheap-watches.example", "discount-pills.example", "buy-cheap.example", "replica-bags.example", "diet-pills.example",
    "adult-video.example", "adult-cams.example", "xxx-tube.example", "hot-adult.example", "sexy-chat.example", "porn-x.example", "free-porn.example",
    "ads-server.example", "click-ads.example", "track-clicks.example", "popup-ads.example", "ad-tracker.example", "banner-ads.example", "track-pixel.example",
    "link-farm.example", "spam-links.example", "spam-blog.example", "content-farm.example", "seo-spam.example", "backlinks-farm.example", "free-followers.example", "free-money.example", "payday-loan.example", "get-rich.example", "warez-crack.example", "free-keygen.example", "phish-login.example",
)
ALLOWED = (
    "www.university.example", "library.university.example", "physics.example", "museum.example", "www.newspaper.example", "daily-news.example", "weather.example", "parliament.example", "citycouncil.example", "hospital.example", "schools.example", "open-data.example",
    "docs.software.example", "wiki.example", "en.encyclopedia.example", "dictionary.example", "forum.gardening.example", "blog.cooking.example", "recipes.example", "travel-notes.example", "m.railways.example", "trams.example", "mountains.example", "birds.example", "astronomy.example", "chemistry.example",
    "books.example", "poetry.example", "history-journal.example", "archive.example", "blog.history.example", "theatre.example", "orchestra.example", "photography.example", "football-club.example", "cycling.example", "chess.example", "m.chess.example", "bakery.example", "carpentry.example",
    "thinkers.example", "within.example", "the-nation.example", "www.others.example", "northern.example", "m.thread.example", "thunder.example", "blog.nations.example", "whether.example", "shire.example", "instruments.example", "engineering.example", "standards.example", "research.example", "institute.example", "linguistics.example", "translation.example", "statistics.example",
    "mathematics.example", "thermometer.example", "stations.example", "education.example", "everything.example", "blog.something.example", "method.example", "southwest.example", "together.example", "m.fathers.example", "mothers.example", "youth.example", "health.example", "earth.example", "months.example", "anthology.example",
)
PATHS = ("/", "/en/412", "/de/88.html", "/fr/7/", "/es/19053", "", "/2021/05/a-day.html")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked int): the small table above, each host under three of the paths."""
    rows = [(f"https://{host}{PATHS[(i + k) % len(PATHS)]}", int(hosts is BLOCKED)) for hosts in (BLOCKED, ALLOWED) for i, host in enumerate(hosts) for k in (0, 2, 4)]
    return spark.createDataFrame(rows, "url string, blocked int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z in lower case, and what follows that up to "?", "#" or the end. Both are empty for null and without "://"."""
    part = lambda k: F.coalesce(F.regexp_extract(url.cast("string"), r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


class Rules:
    """The longest rule that fits a host, it or a parent of it, and the beginning of a path. Of equally long ones the longer host wins, then the first given."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.lower(), []).append((slash + path, rule, verdict))

    def of(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, at = (None, None), 0
        while True:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if (best[0] is None or len(rule) > len(best[0])) and path.startswith(start):
                    best = rule, verdict
            at = host.find(".", at) + 1
            if not at:
                return best


def hashed_grams(texts: pa.Array, salt: int, grams: Sequence[int] = GRAMS, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every character n-gram of the texts, each between a sign for its beginning and one for its end; empty texts have none."""
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    length = np.where(length > 0, length + 2, 0)
    chars = np.frombuffer("".join(f"\x02{t}\x03" for t in texts.to_pylist() if t).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends, row = np.repeat(np.cumsum(length), length), np.repeat(np.arange(len(length)), length)
    rows, found = [], []
    for n in grams:
        if len(chars) >= n:
            value = np.full(len(chars) - n + 1, salt * 31 + n, np.uint64)
            for k in range(n):
                value = (value ^ chars[k : len(chars) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
            inside = np.flatnonzero(np.arange(len(value)) + n <= ends[: len(value)])
            rows.append(row[inside])
            found.append((value[inside] % np.uint64(slots)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class UrlModel:
    """Logistic regression over n-grams of host and path, each counted with a share of one over the root of their number."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @staticmethod
    def _terms(hosts: pa.Array, paths: pa.Array, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, slot and share of every n-gram."""
        host, path = hashed_grams(hosts, 1, slots=slots), hashed_grams(paths, 2, slots=slots)
        rows, found = np.concatenate([host[0], path[0]]), np.concatenate([host[1], path[1]])
        return rows, found, 1 / np.sqrt(np.bincount(rows, minlength=len(hosts)))[rows]

    @classmethod
    def fitted(cls, hosts: pa.Array, paths: pa.Array, blocked: np.ndarray, slots: int = SLOTS, penalty: float = 1e-4, rounds: int = 800, rate: float = 20.0) -> UrlModel:
        """Full gradient steps with momentum on the mean logistic loss and a penalty on squared weights; the same in every run.

        The bias is the logarithm of the odds of a blocked row, so that a URL without n-grams scores as the labels' share of these.
        """
        rows, found, share = cls._terms(hosts, paths, slots)
        weights, step, bias = np.zeros(slots), np.zeros(slots), np.log((blocked.sum() + 0.5) / ((1 - blocked).sum() + 1))
        for _ in range(rounds):
            off = 1 / (1 + np.exp(-(np.bincount(rows, weights[found] * share, len(blocked)) + bias))) - blocked
            step = 0.9 * step - rate * 0.1 * (np.bincount(found, off[rows] * share, slots) / max(1, len(blocked)) + penalty * weights)
            weights = weights + step
        return cls(weights, float(bias))

    def score(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        rows, found, share = self._terms(hosts, paths, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(np.bincount(rows, self.weights[found] * share, len(hosts)) + self.bias, -700, 700)))


def trained(labelled: DataFrame, most: int = LABELLED_MOST) -> UrlModel:
    """The model of (url, blocked 0 or 1), fitted on at most `most` of its rows, chosen by a hash of the URL. Rows with a null or another label are left out."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(host.alias("host"), path.alias("path"), F.col("blocked").cast("int").alias("blocked")).where("blocked in (0, 1)")
    table = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(most).toArrow().combine_chunks()
    column = lambda name: table.column(name).combine_chunks()
    return UrlModel.fitted(column("host"), column("path"), column("blocked").to_numpy(zero_copy_only=False).astype(np.float64))


def judged(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row for each row of pages, repeated ones too.

    A rule (verdict, host and path) fits its host and all subdomains where the URL's path starts with the rule's;
    the longest wins and gives the verdict. Elsewhere rule is null and the verdict is the model's: block where
    score, the model's probability, is at least threshold. Every row has a score. A null URL, and one without
    "://", has an empty host and path, which no rule fits; it scores as the labels' share of blocked rows. A null page_id stays null; other
    columns are not read. labelled: (url, blocked), by default the small table of this module.

    One narrow pass without a shuffle: host and path are column expressions, rules and the model, both small, go to the tasks.
    """
    spark = pages.sparkSession
    model = spark.sparkContext.broadcast(trained(labelled_urls(spark) if labelled is None else labelled))
    known = spark.sparkContext.broadcast(Rules(rules))
    host, path = host_and_path(F.col("url"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=4096):
            hosts, paths = batch.column(1), batch.column(2)
            found = [known.value.of(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            score = model.value.score(hosts, paths)
            verdict = [v or ("block" if s >= threshold else "allow") for (_, v), s in zip(found, score)]
            yield pa.RecordBatch.from_arrays([batch.column(0), hosts, paths, pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "score"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return read.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, score double")
