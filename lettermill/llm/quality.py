"""Quality classifier from weak labels.

Heuristic labelers vote on each document (good, bad, or nothing). A document may have any of a few faults;
three labelers or more look for each, in different ways, so their votes overlap. For each fault,
expectation-maximisation over the counts of its labelers' vote patterns estimates how many documents have
it, and how often each labeler votes bad with it and without: nothing but the votes decides these. The
posterior labels train a hashed linear scorer, which decides.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable
from operator import eq

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_dedup
from .common import drop_tables, table, text_of, with_columns, written

#: Bounds of the samples for fitting: labelled rows for the lexicon, documents for the scorer.
LABELLED = 20_000
TRAINED = 3_000
BUCKETS = 1 << 16
KEEP = 0.5
#: A learned word is so many times as frequent in toxic documents, at least; and the most telling ones.
LEAST_LIFT, LIFT = 8, 15

TOKEN = re.compile(r"\w+")
#: Bytes that aren't deleted where they are counted: odd symbols, ASCII capitals, ASCII letters.
NOT_ODD = bytes(set(range(256)) - set(b"#$%&*+/<=>@[\\]^`{|}~"))
CAPITALS, LETTERS = bytes(range(65, 91)), bytes((*range(65, 91), *range(97, 123)))
ENDING = re.compile(r"\w[^\w\s.,;:!?'\"()\-]+(?!\S)|(?<!\S)[^\w\s.,;:!?'\"()\-]+(?!\S)")
MARKS = re.compile(r"[^\w\s]{3,}")
BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")


class Lexicon(dict):
    """Words of toxic documents with the logarithms of how many times as often they are there; `taught`
    are those of the highest lift."""

    def __init__(self, lifts: dict[str, float]):
        super().__init__((word, math.log(lift)) for word, lift in lifts.items())
        self.taught = frozenset(word for word, lift in lifts.items() if lift >= LIFT)


class Facts:
    """What the labelers look at in one text."""

    def __init__(self, text: str, learned: Lexicon):
        words = text.split()
        self.n = n = len(words)
        most = max(1, n)
        tokens = TOKEN.findall(text.lower())
        self.distinct = set(tokens)
        self.marks = (len(MARKS.findall(text)) + len(BARE.findall(text))) / most
        raw = text.encode()
        odd = len(raw.translate(None, NOT_ODD))
        self.odd = odd / max(1, len(text) - n)
        self.endings = len(ENDING.findall(text)) / most if odd else 0.0
        self.upper = sum(map(str.isupper, words)) / most
        self.capitals = (len(raw) - len(raw.translate(None, CAPITALS))) / max(1, len(raw) - len(raw.translate(None, LETTERS)))
        self.shouts = text.count("!!") / most
        self.doubled = sum(map(eq, words, words[1:])) / most
        triples = max(0, n - 2)
        self.fresh = len(set(zip(words, words[1:], words[2:]))) / triples if triples else 1.0
        self.packed = len(zlib.compress(raw, 1)) / len(raw) if len(raw) >= 200 else 1.0
        self.ends = sum(w[-1] in ".!?" for w in words) / most
        found = self.distinct & learned.keys()
        taught = found & learned.taught
        self.several = len(taught)
        self.several_share = len(taught) / max(1, len(self.distinct))
        self.taught = sum(map(taught.__contains__, tokens)) if taught else 0
        self.taught_share = self.taught / max(1, len(tokens))
        self.weight = sum(learned[w] for w in found)
        self.weight_share = self.weight / max(1, len(self.distinct))


def _between(value: Callable[[Facts], float], good: float, bad: float, least: int = 1) -> Callable[[Facts], int]:
    """Good up to one value, bad from another on, nothing between them or for fewer words."""
    return lambda f: 0 if f.n < least else 1 if value(f) <= good else -1 if value(f) >= bad else 0


#: What may be wrong with a document, and who looks for it.
FAULTS = {"symbols": ("marks", "odd", "endings"), "shouting": ("upper", "capitals", "shouts"), "repeating": ("doubled", "loops", "packed", "sentences"), "toxic": ("taught", "several", "weighed")}
LABELERS: dict[str, Callable[[Facts], int]] = {
    "marks": lambda f: 0 if f.n == 0 else 1 if f.marks <= 0.04 or f.marks * f.n < 3 else -1 if f.marks >= 0.12 else 0,
    "odd": lambda f: 0 if f.n == 0 else 1 if f.odd <= 0.015 else -1 if f.odd >= 0.04 else 0,
    "endings": lambda f: 0 if f.n < 4 else 1 if f.endings <= 0.04 else -1 if f.endings >= 0.12 else 0,
    "upper": _between(lambda f: f.upper, 0.3, 0.5, 5),
    "capitals": _between(lambda f: f.capitals, 0.2, 0.4, 5),
    "shouts": _between(lambda f: f.shouts, 0.05, 0.15, 3),
    "doubled": _between(lambda f: f.doubled, 0.05, 0.12, 10),
    "loops": _between(lambda f: 1 - f.fresh, 0.35, 0.5, 20),
    "packed": _between(lambda f: 1 - f.packed, 0.7, 0.77, 20),
    "sentences": lambda f: 0 if f.n < 30 else 1 if 0.004 <= f.ends <= 0.6 else -1,
    "taught": lambda f: 0 if f.n == 0 else -1 if f.taught >= 2 and f.taught_share >= 0.006 else 1 if f.taught_share < 0.002 else 0,
    "several": lambda f: 0 if f.n == 0 else -1 if f.several >= 2 and f.several_share >= 0.008 else 1 if f.several_share < 0.004 else 0,
    "weighed": lambda f: 0 if f.n == 0 else -1 if f.weight >= 6 and f.weight_share >= 0.04 else 1 if f.weight_share < 0.02 else 0,
    "empty": lambda f: -1 if f.n == 0 else 1,  # a fact, of which nothing is estimated
}
EMPTY = list(LABELERS).index("empty")


def vote(text: str | None, learned: Lexicon) -> tuple[str, Facts]:
    """One character for each labeler: + - 0."""
    facts = Facts(text or "", learned)
    return "".join("0+-"[test(facts)] for test in LABELERS.values()), facts


def sample_units(rows: list[tuple[int, bytes | None]]) -> list[int]:
    """A number for each (key, HyperMinHash registers) of a sample: the same for those that share a
    band with, and by estimate are as similar as near copies to, one of the group."""
    top = list(range(len(rows)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    with_words = [i for i, (_, r) in enumerate(rows) if r]
    if with_words:
        registers = np.stack([np.frombuffer(rows[i][1], np.uint16) for i in with_words])
        for at in range(0, near_dedup.REGISTERS, near_dedup.ROWS):
            _, first, bucket = np.unique(registers[:, at : at + near_dedup.ROWS], axis=0, return_index=True, return_inverse=True)
            leader = first[bucket.ravel()]
            near = np.flatnonzero((leader != np.arange(len(leader))) & ((registers == registers[leader]).mean(axis=1) * near_dedup.SHARE[1] >= near_dedup.SHARE[0]))
            for i in near.tolist():
                x, y = sorted((find(with_words[i]), find(with_words[leader[i]])))
                top[y] = x
    return [find(i) for i in range(len(rows))]


def learn_lexicon(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Lexicon:
    """Words that labelled toxic documents have far more often than others: in at least 3 and one
    in 200 of them, and 8 times as often. Documents are counted by groups of near copies (by the
    sketches of near_dedup), both where a word occurs and in all: a group counts once as toxic and
    once as not, if it has such members.

    Fitted on at most `labelled` labelled rows, those of least hash, and at most as many different texts of
    theirs. Sketches of 520 bytes go to the driver, for that bound, and so do the chosen words: at most
    200 times the words of a toxic document. A labelled id without a document counts nowhere; where
    documents repeat an id, each counts by its own text, within the bound.
    """
    spark, scratch = docs.sparkSession, []
    sample = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").where("toxic IN (0, 1)")
    texts = written(texts.select("toxic", F.xxhash64("text").alias("text_key"), "text").dropDuplicates(["toxic", "text_key"]).orderBy(F.xxhash64("text_key"), "text_key", "toxic").limit(labelled), scratch)
    sketches = near_dedup.sketch_column(texts.select("text_key", "text")).select("text_key", "registers").orderBy("text_key").collect()
    units = sample_units([(r["text_key"], r["registers"]) for r in sketches])
    numbered = spark.createDataFrame([(r["text_key"], unit) for r, unit in zip(sketches, units, strict=True)], "text_key long, unit int").distinct()
    own = texts.join(F.broadcast(numbered), "text_key").select("toxic", "unit", F.array_distinct(F.split(F.lower("text"), r"(?U)\W+")).alias("own"))
    counts = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.countDistinct("unit").alias("n")).collect()}
    if len(counts) < 2:
        drop_tables(spark, scratch)
        return Lexicon({})
    bad, good = counts[1], counts[0]
    words = own.select("toxic", "unit", F.explode("own").alias("word")).where("word <> ''").distinct()
    each = words.groupBy("word").agg(F.sum("toxic").alias("in_bad"), F.sum(1 - F.col("toxic")).alias("in_good"))
    lift = F.col("in_bad") / bad / ((F.col("in_good") + 0.5) / good)
    chosen = each.where((F.col("in_bad") >= max(3, bad / 200)) & (lift >= LEAST_LIFT))
    learned = Lexicon({r["word"]: r["lift"] for r in chosen.select("word", lift.alias("lift")).collect()})
    drop_tables(spark, scratch)
    return learned


class Estimate:
    """What expectation-maximisation finds: share, by fault, of documents that have it; bad[1, j] and
    bad[0, j], the chances that labeler j votes bad with its fault and without; after, each pattern's
    posterior of having no fault."""

    def __init__(self, share: dict[str, float], bad: np.ndarray, after: dict[str, float]):
        self.share, self.bad, self.after = share, bad, after

    def right(self) -> dict[str, tuple[float, float]]:
        """For each labeler, how often its vote is right: without its fault, and with it."""
        return {name: (1 - self.bad[0, j], self.bad[1, j]) for j, name in enumerate(LABELERS)}


#: Where estimates begin, and what counts as PRIOR votes of each labeler and PRIOR documents of each
#: fault beside the real ones: so no chance is 0 or 1, and a few documents can't say anything odd.
BEGIN_WITHOUT, BEGIN_WITH, BEGIN_SHARE, PRIOR = 0.02, 0.85, 0.05, 10


def two_classes(signs: np.ndarray, n: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """(share, bad, after) of one fault from its labelers' votes: signs has a row for each pattern, with
    -1 for bad, 1 for good and 0 for nothing, which says nothing; n is how often each occurs."""
    plus, minus = (signs > 0).astype(float), (signs < 0).astype(float)
    begin = np.array([[BEGIN_WITHOUT], [BEGIN_WITH]])
    bad, share = np.repeat(begin, signs.shape[1], axis=1), BEGIN_SHARE
    after = np.zeros(len(n))
    for _ in range(rounds):
        log = np.log([1 - share, share]) + minus @ np.log(bad.T) + plus @ np.log(1 - bad.T)
        now = 1 / (1 + np.exp((log[:, 0] - log[:, 1]).clip(-500, 500)))
        held = n[:, None] * np.stack([1 - now, now], axis=1)
        bad = (held.T @ minus + PRIOR * begin) / (held.T @ (plus + minus) + PRIOR)
        share = (held[:, 1].sum() + PRIOR * BEGIN_SHARE) / (n.sum() + PRIOR)
        if len(n) and np.abs(now - after).max() < 1e-9:
            break
        after = now
    if bad[0].sum() > bad[1].sum():  # the classes have changed places
        bad, share, after = bad[::-1], 1 - share, 1 - after
    return share, bad, after


def estimate(counts: dict[str, int]) -> Estimate:
    """Each fault has a class of its own, whatever else a document has: a labeler that votes bad by
    chance, or is mostly wrong, is found out by the others of its fault. A text without words has
    none of these, and is never good."""
    names = list(LABELERS)
    signs = np.array([[(c == "+") - (c == "-") for c in p] for p in counts], float).reshape(len(counts), len(names))
    n = np.array(list(counts.values()), float)
    share, bad, fine = {}, np.full((2, len(names)), 0.5), np.ones(len(counts))
    for fault, members in FAULTS.items():
        own = [names.index(m) for m in members]
        # Patterns that agree on these labelers are one.
        kinds, at = np.unique(signs[:, own], axis=0, return_inverse=True)
        share[fault], bad[:, own], after = two_classes(kinds, np.bincount(at.ravel(), n, len(kinds)))
        fine *= 1 - after[at.ravel()]
    bad[:, EMPTY] = 0, 1
    fine[signs[:, EMPTY] < 0] = 0
    return Estimate(share, bad, dict(zip(counts, fine.tolist(), strict=True)))


class Buckets(dict):
    def __missing__(self, token: str) -> int:
        found = xxhash.xxh3_64_intdigest(token) & (BUCKETS - 1)
        if len(self) < 100_000:
            self[token] = found
        return found


def word_buckets(facts: Facts, buckets: Buckets) -> np.ndarray:
    """Distinct buckets of the text's words."""
    return np.unique(np.fromiter(map(buckets.__getitem__, facts.distinct), np.int32, len(facts.distinct)))


def vote_buckets(votes: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(f"vote {name} {c}") & (BUCKETS - 1) for name, c in zip(LABELERS, votes, strict=True) if c != "0"]


def train(rows: list[tuple[np.ndarray, str, float]], rounds: int = 80) -> np.ndarray:
    """Logistic regression on (word buckets, votes, posterior), by gradient descent with a step
    for each weight."""
    weights = np.zeros(BUCKETS + 1)
    if not rows:
        return weights
    where, value, row = [], [], []
    for i, (own, votes, _) in enumerate(rows):
        more = vote_buckets(votes)
        where += [own.astype(np.int64), np.array([*more, BUCKETS], np.int64)]
        value += [np.full(len(own), 1 / math.sqrt(max(1, len(own)))), np.ones(len(more) + 1)]
        row += [np.full(len(own) + len(more) + 1, i)]
    at, by, of = np.concatenate(where), np.concatenate(value), np.concatenate(row)
    goal = np.array([y for *_, y in rows])
    grown = np.full(BUCKETS + 1, 1e-3)
    for _ in range(rounds):
        z = np.bincount(of, weights[at] * by, len(rows))
        miss = 1 / (1 + np.exp(-z.clip(-40, 40))) - goal
        slope = np.bincount(at, miss[of] * by, BUCKETS + 1) + 0.5 * weights
        grown += slope**2
        weights -= 0.5 * slope / np.sqrt(grown)
    return weights


class Model:
    """A learned lexicon, what is known of the labelers, and the scorer's weights."""

    def __init__(self, learned: Lexicon, labelers: Estimate, weights: np.ndarray):
        self.learned, self.labelers, self.weights = learned, labelers, weights


VOTED = T.StructType([T.StructField("votes", T.StringType()), T.StructField("buckets", T.BinaryType())])


def vote_column(docs: DataFrame, learned: Lexicon, without: Iterable[str] = ()) -> DataFrame:
    """docs with votes and buckets (of the text's words, two bytes each): all that the scorer needs."""

    def start():
        buckets = Buckets()

        def step(rows):
            found = [vote(t, learned) for t in rows["text"]]
            return {"votes": [v for v, _ in found], "buckets": [word_buckets(f, buckets).astype("<u2").tobytes() for _, f in found]}

        return step

    return with_columns(docs, ["text"], VOTED, start, without=list(without))


def fit(voted: DataFrame, learned: Lexicon, trained: int = TRAINED) -> Model:
    """From votes, buckets and text_key: votes are counted over all documents, copies of a text
    once. The scorer learns from at most `trained` different texts, those of least hash, whatever
    the order of rows; their buckets go to the driver. Without documents every score is 0.5."""
    each = voted.groupBy("text_key").agg(F.min("votes").alias("votes"))
    counts = {r["votes"]: r["n"] for r in each.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = estimate(counts)
    # Twice the share that is wanted, so that what the limit cuts off is chosen by hash alone.
    share = min(1.0, 2 * trained / max(1, sum(counts.values())))
    place = F.pmod(F.xxhash64("text_key"), F.lit(1_000_000))
    part = voted.select("text_key", place.alias("place"), "votes", "buckets").where(F.col("place") < F.lit(math.ceil(share * 1_000_000)))
    part = part.dropDuplicates(["text_key"]).orderBy("place", "text_key").limit(trained)
    rows = [(np.frombuffer(r["buckets"], "<u2").astype(np.int32), r["votes"], found.after[r["votes"]]) for r in part.collect()]
    return Model(learned, found, train(rows))


SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def score_column(voted: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """voted with score (the chance of being good) and kept, instead of buckets and text_key."""
    sent = voted.sparkSession.sparkContext.broadcast(model.weights)  # fixed size

    def start():
        weights, of_votes = sent.value, {}

        def step(rows):
            if not rows["votes"]:
                return {"score": [], "kept": []}
            for v in set(rows["votes"]):
                if v not in of_votes:
                    of_votes[v] = float(weights[-1] + sum(weights[b] for b in vote_buckets(v)))
            sizes = np.array([len(b) // 2 for b in rows["buckets"]])
            flat = np.concatenate(([0.0], np.cumsum(weights[np.frombuffer(b"".join(rows["buckets"]), "<u2")])))
            ends = np.cumsum(sizes)
            z = np.array([of_votes[v] for v in rows["votes"]]) + (flat[ends] - flat[ends - sizes]) / np.sqrt(np.maximum(1, sizes))
            score = 1 / (1 + np.exp(-z.clip(-40, 40)))
            return {"score": score, "kept": [s >= keep and v[EMPTY] != "-" for s, v in zip(score.tolist(), rows["votes"], strict=True)]}

        return step

    return with_columns(voted, ["votes", "buckets"], SCORE, start, without=["buckets", "text_key"])


def classify(docs: DataFrame, labels: DataFrame, trained: int = TRAINED, labelled: int = LABELLED, keep: float = KEEP, without: Iterable[str] = (), scratch: list[str] | None = None) -> tuple[DataFrame, Model]:
    """(docs with score, votes and kept; the model), fitted to the same docs.

    Null and empty texts get the vote of the `empty` labeler and are rejected. Rows are judged one
    by one: ids may be null or repeated. Columns of docs with these names are replaced; the text is
    dropped if it is in `without`. Without labels there is no learned lexicon.

    Each text goes through Python once: its votes and its words' buckets are stored in the shared
    folder with the columns asked for.
    """
    texts = docs.select("doc_id", "text")
    learned = learn_lexicon(texts, labels, labelled)
    named = docs.withColumn("text_key", F.xxhash64(text_of()))
    voted = written(vote_column(named, learned, without), scratch)
    model = fit(voted, learned, trained)
    return score_column(voted, model, keep), model


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns of docs."""
    taken = {c.lower() for c in (*VOTED.names, *SCORE.names, "text_key")}
    own = {c: f"own {c}" if c.lower() in taken else c for c in docs.columns}
    scratch: list[str] = []
    judged, _ = classify(docs.withColumnsRenamed(own), labels, scratch=scratch)
    out = written(judged.where("kept").select(*(F.col(f"`{name}`").alias(c) for c, name in own.items())))
    drop_tables(docs.sparkSession, scratch)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels"), without=["text"])[0].select("doc_id", "score", "votes", "kept")
