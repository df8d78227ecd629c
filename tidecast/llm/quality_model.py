"""Quality by positive-unlabelled learning.

Trusted positives (labelled good) and unlabelled web texts are all that the classifier sees; labels of bad
texts are never used.  A text becomes ``FEATURES`` statistics of its whole length: repetition, case, signs,
line and sentence shapes, function words.  First the class prior, the share of good texts among the unlabelled, is
estimated: a small network tells positives from unlabelled texts, and over all bins of highest scores of
rows it was not fitted to, the least ratio of the unlabelled share to the positive share, corrected for the
sizes of the samples, is the prior.  Then a network of the same form minimises the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with the logistic loss, so that its output is a probability.  Both samples are bounded (``MOST_POSITIVE`` and
``MOST_UNLABELLED`` texts, the first by hash); the driver sees their statistics, not their texts.  Scoring maps whole texts,
one at a time.

Defined cases: null and empty texts have the statistics of no word; without positives or unlabelled
texts every score is 0; null ids and labels teach nothing, an id counts as positive if any of its labels
says so; held-out rows are neither positives nor unlabelled texts; repeated rows each give a row.
"""

from __future__ import annotations

from itertools import pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, per_document

MOST_POSITIVE, MOST_UNLABELLED = 20_000, 20_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 1500, 512, 0.01, 1e-4
#: Step against the negative risk where it falls below zero.
TURN_BACK = 0.5
#: Confidence of the estimated prior, and the least share of positives in a bin.
DELTA, LEAST_BIN = 0.1, 0.05

#: Frequent function words of the corpus languages.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that was it for with be are from on a an at by or "
        "der die das und ist nicht von mit den dem ein eine zu im für sich auch "
        "le la les de des et que dans pour est une un pas sur du au par en "
        "el los las por para con del se lo es y no una como"
    ).split()
)
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#*$%&|<>@~^_=+\\{}[]"
STOPS = b".!?"
QUIET = b",;:'\"()-"


def _share(n: int, of: int) -> float:
    return n / of if of else 0.0


def features(text: str | None) -> list[float]:
    """Statistics of one text; one pass of C functions each."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    count = lambda signs: size - len(raw.translate(None, signs))
    upper, lower, digits = count(UPPER), count(LOWER), count(DIGITS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    pairs = len(set(pairwise(words)))
    same = sum(map(eq, words, words[1:]))
    letters = upper + lower
    stops = count(STOPS)
    function = sum(map(FUNCTION_WORDS.__contains__, words))
    shouted = sum(map(bytes.isupper, words))
    titled = sum(map(bytes.istitle, words))
    return [
        np.log1p(n),
        _share(size, n),
        _share(distinct, n),
        _share(pairs, max(n - 1, 1)),
        _share(same, n),
        np.log1p(distinct) - 0.5 * np.log1p(n),
        _share(upper, letters),
        _share(shouted, n),
        _share(titled, n),
        _share(digits, size),
        _share(count(SYMBOLS), n),
        _share(raw.count(b"|"), n),
        _share(raw.count(b"!"), n),
        _share(stops, n),
        _share(count(QUIET), n),
        _share(size - letters - digits - len(words), size),
        _share(function, n),
        np.log1p(len(lines)),
        _share(n, len(lines)),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines), len(lines)),
        np.log1p(_share(n, stops + 1)),
        np.log1p(max(map(len, words), default=0)),
        _share(raw.count(b"http") + raw.count(b"www."), n),
    ]


FEATURES = len(features(""))


class Network:
    """Standardised statistics, one hidden layer, a logistic output; fitted by Adam."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 0, sd, 1.0)
        self.params = [
            rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN),
            rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1),
        ]
        self.first = [np.zeros_like(p) for p in self.params]
        self.second = [np.zeros_like(p) for p in self.params]
        self.steps = 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -6, 6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.params
        return np.tanh(self.scaled(x) @ w + b) @ v + c[0]

    def gradients(self, x: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
        """Of a risk with the gradient ``back`` in the logits of scaled rows ``x``, and of the decay."""
        w, b, v, c = self.params
        h = np.tanh(x @ w + b)
        inner = np.outer(back, v) * (1 - h * h)
        return [x.T @ inner + DECAY * w, inner.sum(axis=0), h.T @ back + DECAY * v, np.array([back.sum()])]

    def step(self, x: np.ndarray, back: np.ndarray, rate: float) -> None:
        """One step of Adam against the gradient."""
        self.steps += 1
        for p, g, m, s in zip(self.params, self.gradients(x, back), self.first, self.second):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def pull(zp: np.ndarray, zu: np.ndarray, prior: float | None) -> np.ndarray:
    """The gradient of the risk in the logits of positives and of unlabelled rows.  Where the negative part of the
    non-negative risk is below zero it is that part's, turned round."""
    toward, away = (_sigmoid(zp) - 1) / len(zp), _sigmoid(zp) / len(zp)  # of loss(+) and loss(-) on positives
    of_u = _sigmoid(zu) / len(zu)
    if prior is None:
        return np.concatenate((toward, of_u))
    if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
        return np.concatenate((prior * (toward - away), of_u))
    return TURN_BACK * np.concatenate((prior * away, -of_u))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 5) -> Network:
    """With a prior the non-negative risk, without one positives against unlabelled rows."""
    net = Network(unlabelled.mean(axis=0), unlabelled.std(axis=0), seed)
    p_all, u_all, rng = net.scaled(positive), net.scaled(unlabelled), np.random.default_rng(seed)
    for k in range(STEPS):
        p = p_all[rng.integers(0, len(p_all), BATCH)]
        u = u_all[rng.integers(0, len(u_all), BATCH)]
        x = np.concatenate((p, u))
        w, b, v, c = net.params
        z = np.tanh(x @ w + b) @ v + c[0]
        zp, zu = z[:BATCH], z[BATCH:]
        rate = RATE * (1 - k / STEPS)
        net.step(x, pull(zp, zu, prior), rate)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, by the best bin; each half is scored by a network that
    was fitted to the other."""
    of_p, of_u = [], []
    for k in (0, 1):
        net = _fit(positive[k::2], unlabelled[k::2], None)
        of_p.append(net.logits(positive[1 - k :: 2]))
        of_u.append(net.logits(unlabelled[1 - k :: 2]))
    zp, zu = np.sort(np.concatenate(of_p)), np.sort(np.concatenate(of_u))
    at = np.unique(zp)
    qp = 1 - np.searchsorted(zp, at, "left") / len(zp)
    qu = 1 - np.searchsorted(zu, at, "left") / len(zu)
    wide = qp >= LEAST_BIN
    noise = np.sqrt(np.log(4 / DELTA) / 2) * (len(zu) ** -0.5 + len(zp) ** -0.5)
    best = np.argmin((qu[wide] + noise) / qp[wide])
    return float(np.clip(qu[wide][best] / qp[wide][best], 0.05, 0.99))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, positive, unlabelled, f): the statistics of both samples."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    good = (
        labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("id")).distinct()
        .orderBy(F.xxhash64("id"), "id").limit(MOST_POSITIVE)
    )
    web = ids.distinct().orderBy(F.xxhash64(F.lit("web"), "id"), "id").limit(MOST_UNLABELLED)
    both = good.withColumn("p", F.lit(1)).withColumn("u", F.lit(0)).union(
        web.withColumn("p", F.lit(0)).withColumn("u", F.lit(1))
    ).groupBy("id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # At most MOST_POSITIVE + MOST_UNLABELLED ids.
    rows = texts.join(F.broadcast(both), "id")

    def work(batch: pa.RecordBatch) -> list:
        return [*(batch.column(c) for c in ("id", "p", "u")), [list(map(float, features(t))) for t in batch.column("text").to_pylist()]]

    columns = {"id": "long", "p": "int", "u": "int", "text": "string"}
    each = per_document(rows, columns, "id long, p int, u int, f array<double>", work)
    return each.groupBy("id", "p", "u").agg(F.min("f").alias("f"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Network, float] | None:
    """The classifier and the prior it assumes; None without positives or unlabelled texts."""
    rows = training_rows(docs, labels).toArrow().sort_by("id")
    if not rows.num_rows:
        return None
    x = rows["f"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    p, u = x[rows["p"].to_numpy() == 1], x[rows["u"].to_numpy() == 1]
    if len(p) < 4 or len(u) < 4:
        return None
    rng = np.random.default_rng(3)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    prior = class_prior(p, u)
    return _fit(p, u, prior), prior


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batch: pa.RecordBatch) -> list:
        if shared.value is None:
            return [batch.column("doc_id"), pa.array(np.zeros(batch.num_rows))]
        x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
        return [batch.column("doc_id"), pa.array(_sigmoid(shared.value.logits(x)))]

    return per_document(docs, {"doc_id": "long", "text": "string"}, "doc_id long, score double", work)


#: A text counts as good from this score on.
GOOD = 0.3


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = train(docs, labels)
    rows = scored(docs, found[0] if found else None)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )
