"""Toxicity scores: many weak voters, a generative label model, a linear classifier on its posterior labels.

Voters are lexicons and patterns. Lexicons hold word forms, or beginnings of
words, that the labelled sample shows far more often in toxic texts; fixed
ones hold common insults. The given label of a training row is one more voter,
whose accuracy is estimated like any other's. The label model is a latent
class with a tree of dependences: under either hidden class a voter fires with
a probability that depends on the vote of its parent in the tree, which joins
the voters whose votes the class leaves most correlated. Expectation
maximisation gives these probabilities and a posterior label for every training
row. A logistic regression on the presence of the selected features is fitted
to the posteriors and scores all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import frugal, store
from .words import ALNUM, hash_words, mix, spark_int, texts_of

#: Labelled rows of each label used for training, at most; chosen by a hash of doc_id.
SAMPLE = 4000
#: Features that the classifier sees, at most.
FEATURES = 4096
#: Leading bytes of words that are features beside whole words.
PREFIXES = (4, 5, 6, 8)
#: How many times a word or beginning has to stand in a text for features of their own.
OFTEN = (2, 4)
#: Rows that a feature must occur in to be used.
SUPPORT = 3
#: Rows of the sample's mix of labels that each feature's share of toxic rows is mixed with.
SHRINK = 10
#: Features go into a lexicon if over this share of the rows that have them, so mixed, is toxic; chance finds in long texts stay out.
SURE = 0.6
#: Learned lexicons that vote, and numbers of signs of all of them together that make further voters fire.
LEXICONS = 12
SIGNS = (1, 3, 6)

#: Insults and abuse, by language, that vote as lexicons of their own.
INSULTS = {
    "en": "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown imbecile jerk bastard filthy vermin",
    "de": "idiot trottel dumm arschloch abschaum dreck wertlos widerlich versager schwachkopf depp blödmann",
    "fr": "idiot imbécile crétin connard salaud ordure minable débile abruti dégoûtant raclure",
    "es": "idiota imbécil estúpido tonto basura escoria asqueroso patético inútil cabrón payaso",
}


def _patterns(text: bytes, n_words: int) -> tuple[bool, ...]:
    """Votes of surface patterns: shouting, piled-up marks, starred-out words, many exclamation marks."""
    letters = sum(text.count(bytes([c])) for c in range(65, 91))
    return (
        letters > 0.5 * max(len(text) - text.count(b" "), 1),
        b"!!!" in text or b"?!" in text,
        b"***" in text or b"f**" in text,
        text.count(b"!") > 0.2 * max(n_words, 1),
    )


PATTERNS = 4


def _features(texts: list[bytes]):
    """(feature hashes, text of each, words of each text): words and beginnings of words of all texts, each once, and which of these stand there at least twice or four times."""
    words, bounds, begun = hash_words(texts, ALNUM, PREFIXES)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), n)
    hashes, owners = [words], [owner]
    for h in begun:
        long = h != 0
        hashes.append(h[long])
        owners.append(owner[long])
    pairs = np.rec.fromarrays([np.concatenate(owners), np.concatenate(hashes)], names="o,h")
    order = np.lexsort((pairs.h, pairs.o))
    owner, feature = pairs.o[order], pairs.h[order]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1]))) if len(owner) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(owner)))
    owner, feature = owner[new], feature[new]
    often = [(owner[times >= k], mix(feature[times >= k] + np.uint64(k))) for k in OFTEN]
    return np.concatenate([feature, *(h for _, h in often)]), np.concatenate([owner, *(o for o, _ in often)]), n


def _sample_features(batches):
    for rows, texts in texts_of(batches):
        hashes, owner, n = _features(texts)
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
        cut = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        marks = [list(_patterns(t, int(m))) for t, m in zip(texts, n)]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(2), pa.ListArray.from_arrays(pa.array(cut), pa.array(spark_int(hashes))), pa.array(marks, pa.list_(pa.bool_()))],
            names=["doc_id", "toxic", "features", "marks"],
        )


class Presence:
    """Finds which of a list of features a text has."""

    def __init__(self, features: np.ndarray):
        self.order = np.argsort(features)
        self.sorted = features[self.order]

    def find(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, feature) pairs, each once."""
        if not len(self.sorted) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        hit = np.flatnonzero(self.sorted[at] == hashes)
        both = np.unique(owner[hit].astype(np.int64) * len(self.sorted) + self.order[at[hit]])
        return both // len(self.sorted), both % len(self.sorted)


#: Rows by which a voter's probability under a class and a parent's vote is drawn to its probability under the class.
PRIOR_ROWS = 2.0
#: Trees that are tried in turn.
TREES = 5


def dependence_tree(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Parent of each voter, or -1: the spanning forest of largest mutual information of votes given the hidden class.

    Pairs whose information doesn't exceed what chance gives, two parameters'
    worth by the Bayesian criterion, aren't joined.
    """
    n, d = x.shape
    info = np.zeros((d, d))
    for weight in (q, 1 - q):
        total = weight.sum()
        if total < 1:
            continue
        on = x.T @ weight / total
        both = (x * weight[:, None]).T @ x / total
        for cell, a, b in ((both, on[:, None], on[None, :]), (on[:, None] - both, on[:, None], 1 - on[None, :]), (on[None, :] - both, 1 - on[:, None], on[None, :]), (1 - on[:, None] - on[None, :] + both, 1 - on[:, None], 1 - on[None, :])):
            cell = np.maximum(cell, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                info += total * np.where(cell > 0, cell * np.log(cell / np.maximum(a * b, 1e-300)), 0)
    info[info < np.log(max(n, 2))] = 0
    parent, best, link = np.full(d, -1), np.zeros(d), np.full(d, -1)
    left = set(range(d))
    while left:  # Prim's algorithm, a new root wherever nothing is joined
        j = max(left, key=lambda i: (best[i], -i))
        left.remove(j)
        parent[j] = link[j]
        for i in left:
            if info[j, i] > best[i]:
                best[i], link[i] = info[j, i], j
    return parent


def vote_likelihood(x: np.ndarray, parent: np.ndarray, fires: np.ndarray) -> np.ndarray:
    """Log probability of each row's votes under clean and toxic: ``fires[c, v, j]`` is that of voter j firing if its parent voted v."""
    seen = np.where(parent >= 0, x[:, parent], 0).astype(int)
    out = np.empty((len(x), 2))
    for c in (0, 1):
        p = fires[c][seen, np.arange(x.shape[1])]
        out[:, c] = np.log(np.where(x > 0, p, 1 - p)).sum(axis=1)
    return out


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, dict]:
    """Posterior probability of the positive class for each row of binary votes (1: the voter fires).

    ``gold`` (0 or 1 per row) votes like the others, tied to no other voter,
    and, softened, starts the iteration. Expectation maximisation runs with the
    tree that the posteriors so far show, beginning with the labels, until
    the tree stays the same, TREES times at most. Returns the posteriors and
    the estimates.
    """
    x = np.column_stack([votes, gold]).astype(float)
    n, d = x.shape
    q = np.where(np.asarray(gold) == 1, 0.8, 0.2).astype(float)
    parent = np.full(d, -2)
    trace: list[list[float]] = []
    for _ in range(TREES):
        before, parent = parent, np.append(dependence_tree(x[:, :-1], q), -1)
        if (parent == before).all():
            break
        seen = np.where(parent >= 0, x[:, parent], 0)
        trace.append([])
        for _ in range(rounds):
            prior = (q.sum() + 1) / (n + 2)
            fires = np.empty((2, 2, d))
            for c, weight in ((0, 1 - q), (1, q)):
                mean = (weight @ x + 1) / (weight.sum() + 2)
                for v in (0, 1):
                    own = weight[:, None] * (seen == v)
                    fires[c, v] = ((own * x).sum(axis=0) + PRIOR_ROWS * mean) / (own.sum(axis=0) + PRIOR_ROWS)
            fires = np.clip(fires, 1e-6, 1 - 1e-6)
            joint = vote_likelihood(x, parent, fires) + np.log([1 - prior, prior])
            top = joint.max(axis=1)
            whole = top + np.log(np.exp(joint - top[:, None]).sum(axis=1))
            new = np.exp(joint[:, 1] - whole)
            trace[-1].append(float(whole.sum()))
            done = np.abs(new - q).max() < 1e-6
            q = new
            if done:
                break
    return q, {"prior": prior, "parent": parent, "fires": fires, "trace": trace}


def logistic(rows: np.ndarray, columns: np.ndarray, n: int, width: int, target: np.ndarray, ridge: float = 0.1, steps: int = 300) -> np.ndarray:
    """Weights, the intercept last, of a ridge logistic regression on sparse 0/1 features with soft targets, by limited-memory BFGS."""

    def loss(w):
        z = np.bincount(rows, weights=w[columns], minlength=n) + w[-1]
        value = np.logaddexp(0, z).sum() - target @ z + 0.5 * ridge * (w[:-1] @ w[:-1])
        slip = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.append(np.bincount(columns, weights=slip[rows], minlength=width) + ridge * w[:-1], slip.sum())
        return value, grad

    w = np.zeros(width + 1)
    value, grad = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, back = -grad, []
        for ds, dg in reversed(pairs):
            a = (ds @ step) / (ds @ dg)
            back.append(a)
            step = step - a * dg
        if pairs:
            ds, dg = pairs[-1]
            step = step * ((ds @ dg) / (dg @ dg))
        for (ds, dg), a in zip(pairs, reversed(back)):
            step = step + ds * (a - (dg @ step) / (ds @ dg))
        rate, slope = 1.0 if pairs else 1 / max(1.0, float(np.abs(grad).sum())), grad @ step
        for _ in range(40):
            new_value, new_grad = loss(w + rate * step)
            if new_value <= value + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        ds, dg = rate * step, new_grad - grad
        if ds @ dg > 1e-12:
            pairs = [*pairs, (ds, dg)][-10:]
        w, done = w + ds, value - new_value < 1e-7 * max(1.0, abs(value))
        value, grad = new_value, new_grad
        if done:
            break
    return w


class Model:
    """Features and weights of the fitted classifier; ``score`` works on texts."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, estimates: dict | None):
        self.presence, self.weights, self.estimates = Presence(features), weights, estimates

    def score(self, texts: list[bytes]) -> np.ndarray:
        hashes, owner, _ = _features(texts)
        rows, columns = self.presence.find(hashes, owner)
        z = np.bincount(rows, weights=self.weights[:-1][columns], minlength=len(texts)) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _constant(n1: int, n0: int) -> Model:
    """Every text scores the smoothed share of toxic rows."""
    rate = (n1 + 1) / (n1 + n0 + 2)
    return Model(np.zeros(0, np.uint64), np.array([np.log(rate / (1 - rate))]), None)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(lengths, values) of a column of lists."""
    whole = column.combine_chunks()
    return whole.value_lengths().to_numpy(zero_copy_only=False), whole.flatten()


def _fit(rows: pa.Table, features: np.ndarray, lift: np.ndarray, share: np.ndarray) -> Model:
    """From sampled rows (doc_id, toxic, their selected features, pattern votes), the features' log odds for toxic texts and the smoothed share of toxic rows among those that have the feature."""
    y = rows["toxic"].to_numpy().astype(int)
    n, width = len(y), len(features)
    presence = Presence(features)
    count, values = _lists(rows["features"])
    at, column = presence.find(values.to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(n), count))
    del values
    # learned lexicons: the features that speak most for toxic, dealt out in turn, so each sees a part of the evidence
    toxic = np.flatnonzero((lift > np.log(4)) & (share > SURE))[: 40 * LEXICONS]
    of = np.full(width, -1)
    of[toxic] = np.arange(len(toxic)) % LEXICONS
    votes = np.zeros((n, LEXICONS + len(INSULTS) + PATTERNS + len(SIGNS)), dtype=bool)
    use = of[column] >= 0
    votes[at[use], of[column[use]]] = True
    for k, words in enumerate(INSULTS.values()):
        known = np.isin(features, hash_words([w.encode() for w in words.split()], ALNUM)[0])
        votes[at[known[column]], LEXICONS + k] = True
    votes[:, LEXICONS + len(INSULTS) : -len(SIGNS)] = _lists(rows["marks"])[1].to_numpy(zero_copy_only=False).reshape(n, PATTERNS)
    votes[:, -len(SIGNS) :] = np.bincount(at[use], minlength=n)[:, None] >= np.array(SIGNS)
    posterior, estimates = label_model(votes, y)
    estimates |= {"ids": rows["doc_id"].to_pylist(), "posterior": posterior}
    # toxic texts of the sample hold several signs each; rows of a single sign teach what one is worth
    alone = n + np.arange(len(toxic))
    # and rows without any feature keep texts of unknown words, which show no sign, on the clean side
    blank = np.full(max(50, n // 4), 0.5 * y.mean())
    weights = logistic(np.append(at, alone), np.append(column, toxic), n + len(toxic) + len(blank), width, np.concatenate([posterior, share[toxic], blank]))
    return Model(features, weights, estimates)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out.

    The sample has at most SAMPLE rows of either label. Its features are
    counted by Spark; the driver gets the FEATURES best of them and, for each
    sampled row, which of these it has.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(SAMPLE).unionByName(known.filter("toxic = 0").orderBy(*order).limit(SAMPLE))
    texts = frugal(docs).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), "toxic")
    sample = store(texts.mapInArrow(_sample_features, "doc_id long, toxic int, features array<long>, marks array<boolean>"), "sample")
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return _constant(n1, n0)
    counted = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0")).filter(F.col("k1") + F.col("k0") >= SUPPORT)
    # signed root of the information that the feature's presence has on the label
    p1, p0, p = (F.col("k1") + 0.5) / (n1 + 1), (F.col("k0") + 0.5) / (n0 + 1), (F.col("k1") + F.col("k0") + 1) / (n1 + n0 + 2)
    gain = n1 * (p1 * F.log(p1 / p) + (1 - p1) * F.log((1 - p1) / (1 - p))) + n0 * (p0 * F.log(p0 / p) + (1 - p0) * F.log((1 - p0) / (1 - p)))
    best = counted.select("f", F.log(p1 / p0).alias("lift"), gain.alias("gain"), ((F.col("k1") + SHRINK * n1 / (n1 + n0)) / (F.col("k1") + F.col("k0") + SHRINK)).alias("share")).orderBy(F.desc("gain"), "f").limit(FEATURES).collect()
    features = np.array([r.f for r in best], dtype=np.int64).view(np.uint64)
    chosen = [int(r.f) for r in best]
    few = sample.select("doc_id", "toxic", F.array_intersect("features", F.lit(chosen).cast("array<long>")).alias("features"), "marks")
    return _fit(few.toArrow(), features, np.array([r.lift for r in best]), np.array([r.share for r in best]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for rows, texts in texts_of(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(texts), pa.float64())], names=["doc_id", "score"])

    return frugal(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under one half; no row leaves its partition."""

    def run(batches):
        for rows, texts in texts_of(batches):
            yield rows.filter(pa.array(model.score(texts) < 0.5))

    return frugal(docs).mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    The score is a function of the text alone: repeated rows and equal texts
    have equal scores, null texts count as empty, and texts of any length are
    scored whole. Rows of ``labels`` with
    null or other labels are left out of training; if one label is missing,
    every score is the smoothed share of the other's rows. A null doc_id is
    not held out. An empty table gives an empty result.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored(docs, train(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
