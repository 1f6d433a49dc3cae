"""Toxicity by weak supervision.

Voters are words of a lexicon, word beginnings found on labelled rows, and patterns (two voters, several hits, none). A
generative model with a hidden class is fitted to the votes of all documents, without labels, by expectation maximisation:
each voter's rates of firing in either class, and the correlations that the class leaves, as a tree of voters in which
one's rate depends on whether its parent fires (of all trees the one of most mutual information). Its posteriors are
the labels on which a linear classifier is trained. Labelled rows scale the classifier's score to a probability.

Nothing is left out of the fit: documents are summed up by vote pattern, the patterns stay in a written table, and every
round of the label model and of the classifier is a sum over it. The driver sees sums of fixed size (voters squared).

Bounds. Beginnings are looked for on up to `sample_rows` labelled toxic rows and three times as many others, which also
scale the score; every one that passes the test is a voter, so their number is bounded by the sample alone.

Defined results. Null or empty text: no voter fires, the score of the constant. Repeated rows and null ids are
scored like any other. Without labelled toxic rows the lexicon votes alone. An empty table gives an empty
result. Words are cut at white space, stripped of signs and case-folded; whole texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, tidy, written
from .labelled import logistic, sample

#: Insults in English. Fixed values.
LEXICON = ("clown", "disgusting", "dumb", "idiot", "idiots", "imbecile", "loser", "losers", "moron", "morons", "pathetic", "scum", "scumbag", "stupid", "trash", "vermin", "worthless")
SHORTEST, LONGEST = 3, 9
#: Signs of a document's size and number of hits, beside its voters: hits up to 7, then powers of two of its words.
HITS, SIZES = 8, 16
#: Tasks that sum over vote patterns; each sends one row to the driver.
SUM_TASKS = 16
SIGNS = "\"'!?.,;:()[]{}<>|*$%&#@~^+=-_/\\`"


def words_of(text: str) -> set[str]:
    return {w.strip(SIGNS) for w in text.lower().split()}


def beginnings(text: str) -> set[str]:
    return {w[:n] for w in words_of(text) for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def tail(hits: int, of: int, share: float) -> float:
    """The chance of so many hits or more among `of` rows, if each is one with chance `share`."""
    logs = [math.lgamma(of + 1) - math.lgamma(k + 1) - math.lgamma(of - k + 1) + k * math.log(share) + (of - k) * math.log1p(-share) for k in range(hits, of + 1)]
    top = max(logs)
    return math.exp(min(0.0, top + math.log(sum(math.exp(v - top) for v in logs))))


def find_beginnings(rows: DataFrame) -> list[str]:
    """Word beginnings that toxic rows hold and others hardly do, after correction for the number looked at."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(beginnings(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], ["beginning", "label"])

    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if set(sizes) != {0, 1}:
        return []
    counts = rows.select("label", "text").mapInArrow(tidy(cut), "beginning string, label int").groupBy("beginning").agg(F.sum("label").alias("toxic"), F.count("*").alias("rows"))
    looked = max(1, counts.count())
    share = sizes[1] / (sizes[0] + sizes[1])
    possible = F.col("toxic") * math.log(share) < math.log(0.01 / looked)  # its chance is no less, even if no other row holds it
    top = counts.where(possible & (F.col("toxic") / sizes[1] >= 4 * (F.col("rows") - F.col("toxic")) / sizes[0])).collect()  # beginnings of a bounded sample
    chance = {r.beginning: tail(r.toxic, r.rows, share) for r in top}
    kept: list[str] = []
    for b in sorted(chance, key=lambda b: (chance[b], len(b), b)):
        if chance[b] < 0.01 / looked and not any(b.startswith(k) or k.startswith(b) for k in kept):
            kept.append(b)
    return sorted(kept)


class Voters:
    """Lexicon words and word beginnings, each a voter; then the patterns: two voters fire, two or three hits, none.

    What `fire` gives after the voters are signs for the classifier: the number of hits, and the size.
    """

    def __init__(self, words: tuple[str, ...], starts: list[str]):
        self.words = {w: i for i, w in enumerate(words)}
        self.starts = {s: len(words) + i for i, s in enumerate(starts)}
        self.lengths = sorted({len(s) for s in starts})
        self.n = len(words) + len(starts) + 4
        self.signs = self.n + HITS + SIZES

    def fire(self, text: str) -> list[int]:
        fired, hits = set(), 0
        words, starts, lengths = self.words, self.starts, self.lengths
        split = text.lower().split()
        for w in set(split):
            w = w.strip(SIGNS)
            before = len(fired), hits
            if w in words:
                fired.add(words[w])
                hits += 1
            for n in lengths:
                if w[:n] in starts:
                    fired.add(starts[w[:n]])
                    hits += hits == before[1]
        n = self.n
        patterns = [n - 4] * (len(fired) > 1) + [n - 3] * (hits > 1) + [n - 2] * (hits > 2) + [n - 1] * (hits == 0)
        return sorted(fired) + patterns + [n + min(hits, HITS - 1), n + HITS + min(len(split).bit_length(), SIZES - 1)]


def log_odds(fired: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of the classes' rates (class 1 over class 0), from how much fired of how much; bounded, as all evidence of one voter is."""
    rate = (fired + 0.02) / (size + 2.0)
    rate = np.clip(rate, 1e-5, 1 - 1e-5)
    return np.clip(np.log(rate[1]) - np.log(rate[0]), -6, 6)


class LabelModel:
    """Two hidden classes. Voter j that fires adds alone[j] to the log odds of class 1, and with[j] more if its parent fires.

    A voter that does not fire abstains, but for the last, whose silence is the others' firing.
    """

    def __init__(self, n: int, prior: float):
        """At first each voter is taken to fire ten times as often in class 1, and the last the other way."""
        self.prior = prior
        self.alone, self.more, self.parent = np.full(n, np.log(10)), np.zeros(n), np.full(n, -1)
        self.alone[-1] = np.log(0.03 / 0.97)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of class 1, for rows of votes."""
        z = np.log(self.prior / (1 - self.prior)) + votes @ self.alone
        child = np.flatnonzero(self.parent >= 0)
        z += (votes[:, child] * votes[:, self.parent[child]]) @ self.more[child]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def sums(self, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each class how much voters fire, two at a time; in a last row and column, how much there is."""
        p, every = self.posterior(votes), np.c_[votes, np.ones(len(votes))]
        return np.stack([(every * (counts * share)[:, None]).T @ every for share in (1 - p, p)])

    def update(self, sums: np.ndarray, tree: bool) -> None:
        """tree: look for the correlations anew."""
        pairs, size = sums[:, :-1, :-1], sums[:, -1, -1]
        fired = np.diagonal(pairs, axis1=1, axis2=2)
        self.prior = float(np.clip(size[1] / max(size.sum(), 1e-9), 1e-4, 0.5))
        if tree:
            self.parent = spanning_tree(mutual_information(pairs, size))
        self.alone, self.more = log_odds(fired, size[:, None]), np.zeros(len(self.alone))
        for j in np.flatnonzero(self.parent >= 0):
            i = self.parent[j]
            both, apart = pairs[:, i, j], fired[:, j] - pairs[:, i, j]
            self.alone[j] = log_odds(apart, size - fired[:, i])
            self.more[j] = log_odds(both, fired[:, i]) - self.alone[j]


def mutual_information(pairs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Between voters within the classes, each class by its share."""
    out = np.zeros(pairs.shape[1:])
    for both, n in zip(pairs, size, strict=True):
        if n < 1:
            continue
        one = np.clip(np.diag(both) / n, 1e-9, 1 - 1e-9)
        p11 = np.clip(both / n, 1e-12, None)
        for p, q in ((p11, np.outer(one, one)), (one[:, None] - p11, np.outer(one, 1 - one)), (one[None, :] - p11, np.outer(1 - one, one)), (1 - one[:, None] - one[None, :] + p11, np.outer(1 - one, 1 - one))):
            p = np.clip(p, 1e-12, None)
            out += n / size.sum() * p * np.log(p / q)
    return out


def spanning_tree(gain: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """Each node's parent in the tree of most gain, or -1: Prim's algorithm; the last node, which is the others' silence, has none and is none."""
    n = len(gain) - 1
    parent, best, link = np.full(len(gain), -1), np.full(n, -1.0), np.full(n, -1)
    left = np.ones(n, bool)
    for _ in range(n):
        i = int(np.argmax(np.where(left, best, -2.0)))
        left[i] = False
        parent[i] = link[i] if best[i] > least else -1
        closer = left & (gain[i, :n] > best)
        best[closer], link[closer] = gain[i, :n][closer], i
    return parent


class ToxicityModel:
    def __init__(self, voters: Voters, weights: np.ndarray):
        self.voters, self.weights = voters, weights


def vote_matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Lists of voters to rows of zeros and ones."""
    n = pa.compute.list_value_length(rows).to_numpy()
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), rows.flatten().to_numpy()] = 1
    return out


def total(patterns: DataFrame, width: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of `of` (votes, counts), an array of fixed size, over all patterns (votes, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                part = batch.slice(at, 5_000)
                out = out + of(vote_matrix(part.column(0), width), part.column(1).to_numpy().astype(np.float64))
        if isinstance(out, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sum"])

    parts = patterns.select("votes", "count").mapInArrow(run, "sum binary").collect()  # one row for each of at most SUM_TASKS tasks
    return sum(np.frombuffer(r["sum"]) for r in parts)


def classifier(patterns: DataFrame, model: LabelModel, width: int, ridge: float = 1e-5, rounds: int = 12) -> np.ndarray:
    """Weights and a last one for the constant: logistic regression on the model's posteriors, by Newton steps."""
    n = len(model.alone)
    w = np.r_[np.zeros(width), -2.0]
    for _ in range(rounds):

        def slope(votes: np.ndarray, counts: np.ndarray, w=w) -> np.ndarray:
            a = np.c_[votes, np.ones(len(votes))]
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            gradient = a.T @ (counts * (p - model.posterior(votes[:, :n])))
            curve = (a * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a
            return np.concatenate([gradient, curve.ravel(), [counts.sum()]])

        got = total(patterns, width, slope)
        gradient = got[: width + 1] / got[-1] + ridge * np.r_[w[:-1], 0]
        curve = got[width + 1 : -1].reshape(width + 1, -1) / got[-1] + ridge * np.diag(np.r_[np.ones(width), 1e-2])
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 4.0 / np.abs(step).max())
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, *, learn_from: Column, label: str = "toxic", sample_rows: int = 3000, rounds: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> ToxicityModel:
    frugal(docs.sparkSession)
    rows, share = sample(docs, labels, label=label, learn_from=learn_from, rows={1: sample_rows, 0: 3 * sample_rows}, id_col=id_col, text_col=text_col)
    voters = Voters(LEXICON, find_beginnings(rows))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([voters.fire(t or "") for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["votes"])

    def vote_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([voters.fire(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], ["votes", "label"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(vote), "votes array<int>").groupBy("votes").count()
    patterns = written(counted.coalesce(SUM_TASKS), "patterns")
    if not patterns.take(1):
        return ToxicityModel(voters, np.r_[np.zeros(voters.signs), -2.0])
    known = rows.select("text", "label").mapInArrow(tidy(vote_labelled), "votes array<int>, label int").groupBy("votes", "label").count().orderBy("votes", "label").toArrow()
    of = known.column("label").to_numpy().astype(np.float64)
    weight = known.column("count").to_numpy() * np.array([share.get(int(c), 1.0) for c in of])
    labelled = len(set(of)) == 2
    model = LabelModel(voters.n, float(np.clip((weight * of).sum() / weight.sum(), 1e-3, 0.5)) if labelled else 0.1)
    width = voters.n
    for turn in range(rounds):
        got = total(patterns, voters.signs, lambda votes, counts: model.sums(votes[:, :width], counts).ravel())
        model.update(got.reshape(2, width + 1, width + 1), tree=turn >= rounds // 2)
    weights = classifier(patterns, model, voters.signs)
    if labelled:
        votes = vote_matrix(known.column("votes").combine_chunks(), voters.signs)
        scale = logistic((votes @ weights[:-1] + weights[-1])[:, None], of, weight, ridge=1e-5)
        if scale[0] > 0:
            weights = scale[0] * weights
            weights[-1] += scale[1]
    return ToxicityModel(voters, weights)


def scored(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", into: str = "toxicity_score") -> DataFrame:
    """`docs` with a further column, the probability of label 1."""
    voters, weights = model.voters, model.weights
    keep = docs.columns
    named, at = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")), keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([weights[voters.fire(t or "")].sum() + weights[-1] for t in pa.compute.struct_field(batch.column(0), [at]).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["row", "score"])

    done = named.mapInArrow(tidy(run), T.StructType([named.schema["row"], T.StructField("score", T.DoubleType())]))
    return done.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("score").alias(into))
