"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of two hashed rows, its own and that of its first ``STEM`` bytes, so that
forms of a stem that was never seen whole are known; filters of one, two and three words slide over the whole text, each
keeps its largest response (max pooling over all positions), and a logistic layer joins them.  The model is
fitted to all labelled rows, whole, by Adagrad; only the positions of the largest responses get a gradient.  The
rows are dealt by hash into shards of about ``SHARD`` texts.  In each of ``ROUNDS`` rounds every shard goes on from
the same parameters, in a task; then Spark takes the mean of what the shards made of them, of an embedding row over
the shards that have its words.  Sums are in fixed point, so they do not depend on the order.  The driver holds the
parameters only.  Hash buckets that fewer than ``LEAST_TEXTS`` of the fitted texts have keep the zero row, which is
also the row of words never seen.

A threshold is calibrated for each language on a part of the labelled rows, by hash, that the filters were not fitted
to: the exact one of highest F1, from running sums over parts of the logits' range.  The language is told from a text's own
function words, never from a column.  Thresholds are taken off the logit, so that 0.5 is the threshold of the score
in every language.

Scoring reads whole texts, in chunks of positions whose maxima are merged, so memory does not follow a text's
length.  Defined cases: null and empty texts have no word and get the score of the zero row; without labels
of both kinds every score is 0; of labels that disagree on an id the larger counts; null labels and ids
teach nothing; repeated rows each give a row.
"""

from __future__ import annotations

import copy
from collections.abc import Collection, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, held_out, kept, per_document, portions

#: Texts of a shard, about, and words that a task has in memory; a shard of more walks them in parts.
SHARD, SHARD_WORDS = 16_000, 8 << 20
#: Bits that labelled ids are dealt to.
BITS = 1 << 26
LEAST_TEXTS = 3
#: Rows of the embedding at most, the most frequent buckets first.
MOST_ROWS = 1 << 17
WIDTHS, FILTERS, DIMS = (1, 2, 3), 8, 8
STEM = 4
#: Gradient steps in all of a shard, about; each round passes over every text once at least.
ROUNDS, STEPS, BATCH, RATE, DECAY = 6, 900, 64, 0.1, 1e-4
#: Share of words that a step does not see, so that no word is learned in place of its neighbours.
BLANKED = 0.2
#: Share of the labelled rows that calibrates thresholds, as one in so many.
CALIBRATION = 4
#: Calibrating rows of a language and label that a threshold of its own needs.
LEAST_CALIBRATING = 20
#: Bytes of texts that a task works on at a time; what it keeps of a word is many times the word.
WORKED_BYTES = 4 << 20
CHUNK = 1 << 16

#: Function words by which a language is told, none shared between two of them.
FUNCTION_WORDS = {
    "en": "the of and to is that was it for with this be are from",
    "de": "der die und das ist nicht von mit den dem ein eine zu im für sich",
    "fr": "le les des et dans pour est une un pas sur avec du au",
    "es": "el los las una por para con del se lo es y no como",
}
LANGUAGES = ("", *FUNCTION_WORDS)
LANGUAGE_OF = {w.encode(): k for k, words in enumerate(FUNCTION_WORDS.values(), 1) for w in words.split()}

#: ASCII signs and controls part words.
PARTING = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_list(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(PARTING).split()


@lru_cache(maxsize=1 << 15)
def buckets(word: bytes) -> tuple[int, int]:
    """Hash buckets of a word and of its stem, 1 to 2^32 - 1; 0 is none."""
    stem = (xxhash.xxh32_intdigest(word[:STEM], 13) or 1) if len(word) > STEM else 0
    return xxhash.xxh32_intdigest(word, 7) or 1, stem


def hashed(words: Iterable[bytes]) -> np.ndarray:
    """Buckets of words, one row each."""
    return np.array([buckets(w) for w in words], np.uint32).reshape(-1, 2)


def languages_of(words: Collection[bytes]) -> np.ndarray:
    """The language whose function word each is, 0 for none."""
    return np.fromiter((LANGUAGE_OF.get(w, 0) for w in words), np.int64, len(words))


def guess(languages: np.ndarray) -> int:
    """The number of the language whose function words a text has most of, 0 if it has none, from those of its words."""
    counts = np.bincount(languages, minlength=len(LANGUAGES))
    counts[0] = 0
    return int(counts.argmax())


class Numbers(dict):
    """Numbers words from 1 on as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class Network:
    """Embedding rows (row 0 is zero), filter banks per width, and the logistic layer."""

    def __init__(self, buckets: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.buckets = np.sort(buckets)
        self.rows = np.zeros((len(buckets) + 1, DIMS), np.float32)
        self.rows[1:] = rng.normal(0, 0.05, (len(buckets), DIMS))
        self.filters = [rng.normal(0, 0.3, (k, DIMS, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.thresholds = np.zeros(len(LANGUAGES))

    def params(self) -> list[np.ndarray]:
        return [self.rows, *self.filters, *self.bias, self.out, self.base]

    def lookup(self, hashed: np.ndarray) -> np.ndarray:
        """Embedding rows of hash buckets."""
        if not len(self.buckets):
            return np.zeros(len(hashed), np.int32)
        at = np.minimum(np.searchsorted(self.buckets, hashed), len(self.buckets) - 1)
        return np.where(self.buckets[at] == hashed, at + 1, 0).astype(np.int32)

    def tables(self, pairs: np.ndarray) -> list[list[np.ndarray]]:
        """Each word's embedding through every place of every filter; scoring only looks up and adds."""
        x = self.rows[self.lookup(pairs[:, 0])] + self.rows[self.lookup(pairs[:, 1])]
        x = np.concatenate((np.zeros((1, DIMS), np.float32), x))
        return [[through(x, f[o]) for o in range(len(f))] for f in self.filters]

    def logits(self, pairs: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
        """Logits of texts, given as numbers of words from 1 on; ``pairs`` has the buckets of each word."""
        tables, (index, starts) = self.tables(pairs), laid_out(texts)
        between = np.zeros(len(index), bool)
        for k in range(1, max(WIDTHS)):
            between[starts[1:] - k] = True
        best = np.full((len(starts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        tail = max(WIDTHS) - 1
        for a in range(0, len(index) - tail, CHUNK):
            b = min(a + CHUNK, len(index) - tail)
            first = int(np.searchsorted(starts, a, "right")) - 1
            own = np.concatenate(([0], starts[first + 1 : np.searchsorted(starts, b)] - a))
            for i, places in enumerate(tables):
                sums = places[0][index[a:b]]
                for o in range(1, len(places)):
                    sums += places[o][index[a + o : b + o]]
                sums[between[a:b]] = -np.inf
                part = best[first : first + len(own), i * FILTERS : (i + 1) * FILTERS]
                np.maximum(part, np.maximum.reduceat(sums, own), part)
        return np.maximum(best + np.concatenate(self.bias), 0) @ self.out + self.base[0]


#: Rows of a product that the linear algebra library does not spread over threads; it would wait more than work.
PIECE = 4000


def through(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    return np.concatenate([x[a : a + PIECE] @ f for a in range(0, max(len(x), 1), PIECE)])


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other, each followed by as many zeros as the widest filter is wide, less one,
    and where each starts; a text without words has one zero of its own."""
    gap = max(WIDTHS) - 1
    sizes = np.array([max(len(t), 1) + gap for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    index = np.zeros((int(sizes.sum()) if len(texts) else gap, *texts[0].shape[1:]) if texts else gap, np.int32)
    for t, s in zip(texts, starts.tolist()):
        index[s : s + len(t)] = t
    return index, starts


def gradients(net: Network, index: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> list[tuple[int, np.ndarray, object]]:
    """Of the mean logistic loss (and decay) of texts as laid out, with both embedding rows of each word: (parameter,
    gradient, what of the parameter it is for)."""
    ends = np.append(starts[1:], len(index)) - (max(WIDTHS) - 1)
    n, every, out, tail = len(WIDTHS), slice(None), [], max(WIDTHS) - 1
    where = [np.zeros((len(starts), FILTERS), np.int64) for _ in WIDTHS]
    best = [np.full((len(starts), FILTERS), -np.inf, net.out.dtype) for _ in WIDTHS]
    for a in range(0, len(index) - tail, CHUNK):
        b = min(a + CHUNK, len(index) - tail)
        x = net.rows[index[a : b + tail]].sum(axis=1)
        own = range(int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b)))
        for i, (filters, bias) in enumerate(zip(net.filters, net.bias)):
            r = sum(through(x[o : o + b - a], f) for o, f in enumerate(filters)) + bias
            for t in own:
                s, e = max(int(starts[t]), a), min(int(ends[t]), b)
                if s < e:
                    at = r[s - a : e - a].argmax(axis=0)
                    top = r[s - a + at, np.arange(FILTERS)]
                    better = top > best[i][t]
                    where[i][t, better], best[i][t, better] = s + at[better], top[better]
    pooled = np.concatenate(best, axis=1)
    hidden = np.maximum(pooled, 0)
    z = hidden @ net.out + net.base[0]
    d = ((1 / (1 + np.exp(-z)) - labels) / len(labels)).astype(net.out.dtype)
    back = d[:, None] * net.out * (pooled > 0)
    grad_at, grad_by = [], []
    for i, filters in enumerate(net.filters):
        g, at = back[:, i * FILTERS : (i + 1) * FILTERS], where[i]
        grad = np.empty_like(filters)
        for o in range(len(filters)):
            grad[o] = np.einsum("bfd,bf->df", net.rows[index[at + o]].sum(axis=2), g)
            by = (g[:, :, None] * filters[o].T[None]).reshape(-1, DIMS)
            grad_at += [index[at + o][:, :, j].ravel() for j in (0, 1)]
            grad_by += [by, by]
        out += [(1 + i, grad + DECAY * filters, every), (1 + n + i, g.sum(axis=0), every)]
    out += [(1 + 2 * n, hidden.T @ d + DECAY * net.out, every), (2 + 2 * n, d.sum(keepdims=True), every)]
    at, by = np.concatenate(grad_at), np.concatenate(grad_by)
    unique, inverse = np.unique(at, return_inverse=True)
    total = np.zeros((len(unique), DIMS), net.rows.dtype)
    np.add.at(total, inverse, by)
    real = unique > 0
    return [*out, (0, total[real], unique[real])]


def walk(net: Network, squares: list[np.ndarray], rows: list[np.ndarray], labels: np.ndarray, passes: int, rng) -> np.ndarray:
    """Adagrad in place, over texts given as both embedding rows of each word; returns which embedding rows moved."""
    params, moved = net.params(), np.zeros(len(net.rows), bool)
    for chosen in (o[a : a + BATCH] for o in (rng.permutation(len(rows)) for _ in range(passes)) for a in range(0, len(o), BATCH)):
        index, starts = laid_out([rows[i] for i in chosen])
        index *= (rng.random((len(index), 1)) >= BLANKED).astype(np.int32)
        for k, grad, at in gradients(net, index, starts, labels[chosen]):
            squares[k][at] += grad * grad
            params[k][at] -= RATE * grad / np.sqrt(squares[k][at])
            if k == 0:
                moved[at] = True
    return moved


def fresh_squares(net: Network) -> list[np.ndarray]:
    return [np.full(p.shape, 1e-3, np.float32) for p in net.params()]


def passes_of(n: float) -> int:
    """Passes over the ``n`` texts of a shard in a round."""
    return max(1, round(STEPS * BATCH / (ROUNDS * max(n, 1))))


def usual_buckets(seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
    usual = np.flatnonzero((counts >= LEAST_TEXTS) & (seen > 0))
    return seen[usual[np.lexsort((seen[usual], -counts[usual]))[:MOST_ROWS]]]


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Network:
    """Fit to the texts of one shard, each the buckets of its words."""
    seen, counts = np.unique(np.concatenate([np.unique(t) for t in texts] or [np.empty(0, np.uint32)]), return_counts=True)
    net = Network(usual_buckets(seen, counts), seed)
    rows = [net.lookup(t.ravel()).reshape(-1, 2) for t in texts]
    walk(net, fresh_squares(net), rows, labels, ROUNDS * passes_of(len(rows)), np.random.default_rng(seed))
    return net


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, list]:
    """(shard, id, label, apart, language, words) of all labelled rows, one for each id, the rows of a shard one after
    the other in one partition; words has both buckets of each word, ``apart`` rows calibrate.  Then the number of shards,
    and of rows by label and apart."""
    # Read again for each use: a label is small, and a kept table of them would have a file for each partition.
    known = (
        labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1))
    )
    shards = max(1, -(-known.count() // SHARD))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # Bits of the labelled ids, BITS at most, leave most other texts where they are.
    bit = F.pmod(F.xxhash64("id"), F.lit(BITS))
    place = {"block": F.shiftright(bit, 6), "bit": F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))}
    bits = F.broadcast(known.withColumns(place).groupBy("block").agg(F.bit_or("bit").alias("bits")))
    near = texts.withColumns(place).join(bits, "block").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("id", "text")

    def work(batch: pa.RecordBatch) -> list:
        flat, languages = [], []
        for text in batch.column("text"):
            words = word_list(text.as_py())
            flat.append(hashed(words).ravel().view(np.int32))
            languages.append(guess(languages_of(words)))
        return [*(batch.column(c) for c in ("shard", "id", "label", "apart")), pa.array(languages, pa.int32()), flat]

    # One exchange brings labels and texts of a shard together; of a repeated id the first text teaches.
    both = near.unionByName(known, allowMissingColumns=True).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    own = Window.partitionBy("shard", "id").orderBy(F.col("label").isNull(), F.asc_nulls_last("text"))
    rows = both.repartitionById(shards, "shard").withColumns({"_k": F.row_number().over(own), "_label": F.first("label").over(own)})
    rows = rows.where("_k = 2 and _label is not null").select("shard", "id", F.col("_label").alias("label"), "text").withColumn(
        "apart", F.pmod(F.xxhash64(F.lit("apart"), "id"), F.lit(CALIBRATION)) == 0
    )
    columns = {"shard": "int", "id": "long", "label": "int", "apart": "boolean", "text": "string"}
    rows = kept(per_document(rows, columns, "shard int, id long, label int, apart boolean, language int, words array<int>", work, WORKED_BYTES))
    return rows, shards, rows.groupBy("label", "apart").count().collect()


def lists_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The buckets of the words of each row."""
    return [np.asarray(t.values, np.int32).view(np.uint32).reshape(-1, 2) for t in batch.column("words")]


def vocabulary(rows: DataFrame) -> np.ndarray:
    """The buckets of the embedding, from all fitted texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch)):
            each = [np.unique(t) for t in lists_of(part)]
            seen, n = np.unique(np.concatenate(each), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(n)], ["bucket", "n"])

    each = arrow_map(rows.where(~F.col("apart")).select("words"), count, "bucket long, n long")
    counts = each.groupBy("bucket").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST_TEXTS) & (F.col("bucket") > 0))
    most = counts.orderBy(F.desc("n"), "bucket").limit(MOST_ROWS).toArrow()
    return most["bucket"].to_numpy().astype(np.uint32)


#: Parameters go between tasks as whole numbers of this.
UNIT = 2.0**-32


def as_table(params: list[np.ndarray]) -> np.ndarray:
    """All parameters as rows of ``DIMS``, the embedding rows first."""
    rest = np.concatenate([p.ravel() for p in params[1:]])
    return np.concatenate((params[0], np.pad(rest, (0, -len(rest) % DIMS)).reshape(-1, DIMS)))


def from_table(params: list[np.ndarray], table: np.ndarray) -> None:
    params[0][:] = table[: len(params[0])]
    rest, a = table[len(params[0]) :].ravel(), 0
    for p in params[1:]:
        p[:] = rest[a : a + p.size].reshape(p.shape)
        a += p.size


def a_round(rows: DataFrame, net: Network, squares: list[np.ndarray], k: int, passes: int) -> None:
    """Every shard walks its texts; the parameters become the mean of what the shards made of them."""
    shared, sums = rows.sparkSession.sparkContext.broadcast((net, squares)), [f"v{i}" for i in range(2 * DIMS)]

    def made(shard: int, texts: list[np.ndarray], labels: list[int]) -> pa.RecordBatch:
        own, its = copy.deepcopy(shared.value)
        moved = walk(own, its, texts, np.array(labels, np.float32), passes, np.random.default_rng((11, k, shard)))
        out = np.concatenate((as_table(own.params()), as_table(its)), axis=1)
        keys = np.flatnonzero(np.concatenate((moved, np.ones(len(out) - len(moved), bool))))
        whole = np.rint(out[keys] / UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, whole.T.copy())], ["key", *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, texts, labels, held = -1, [], [], 0
        for part in (p for batch in batches for p in portions(batch, WORKED_BYTES)):
            for s, t, y in zip(part.column("shard").to_pylist(), lists_of(part), part.column("label").to_pylist()):
                if texts and (s != shard or held + len(t) > SHARD_WORDS):
                    yield made(shard, texts, labels)
                    texts, labels, held = [], [], 0
                shard, held = s, held + len(t)
                texts.append(shared.value[0].lookup(t.ravel()).reshape(-1, 2))
                labels.append(y)
        if texts:
            yield made(shard, texts, labels)
        pa.default_memory_pool().release_unused()

    fitted = rows.where(~F.col("apart")).select("shard", "label", "words")
    schema = ", ".join(["key long", *(f"{c} long" for c in sums)])
    # A row per parameter row, no more than the embedding has.
    mean = arrow_map(fitted, run, schema).groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums]).toArrow()
    keys, n = mean["key"].to_numpy(), mean["n"].to_numpy()
    values = np.stack([mean[c].to_numpy() * UNIT / n for c in sums], axis=1)
    for params, half in ((net.params(), values[:, :DIMS]), (squares, values[:, DIMS:])):
        table = as_table(params)
        table[keys] = half
        from_table(params, table)
    shared.unpersist()


#: Parts that a logit's unit is cut into for running sums, and where the last ones begin: a part has no more different
#: logits than there are numbers of 4 bytes in it, and the driver sees so many sums at most.
PARTS, FARTHEST = 64, 64


def thresholds(scores: DataFrame, weights: dict[int, float]) -> dict[int, float]:
    """For all rows (0) and each language with enough rows the logit of highest weighted F1, in the middle between two
    logits, from (label, language, z)."""
    part = F.floor(F.least(F.greatest("z", F.lit(-FARTHEST)), F.lit(FARTHEST)) * PARTS).cast("int")
    enough = [F.sum(F.when(F.col("label") == k, 1).otherwise(0)) for k in (0, 1)]
    scopes = scores.withColumn("scope", F.explode(F.array_distinct(F.array(F.lit(0), "language")))).withColumn("part", part)
    totals = scopes.groupBy("scope").agg(*[c.alias(f"n{k}") for k, c in enumerate(enough)]).collect()
    totals = {r["scope"]: r for r in totals if r["scope"] == 0 or min(r["n0"], r["n1"]) >= LEAST_CALIBRATING}
    if not totals or not totals[0]["n1"]:
        return {}
    scopes, sums = scopes.where(F.col("scope").isin(list(totals))), [c.alias(f"n{k}") for k, c in enumerate(enough)]
    parts = scopes.groupBy("scope", "part").agg(*sums, F.max("z").alias("first")).collect()
    parts.sort(key=lambda r: (r["scope"], -r["part"]))
    before, seen = [], {}
    for r, after in zip(parts, [*parts[1:], None]):
        n0, n1 = seen.get(r["scope"], (0, 0))
        seen[r["scope"]] = n0 + r["n0"], n1 + r["n1"]
        before.append((r["scope"], r["part"], n0, n1, after["first"] if after and after["scope"] == r["scope"] else None, totals[r["scope"]]["n1"]))
    known = scores.sparkSession.createDataFrame(before, "scope int, part int, b0 long, b1 long, first double, all1 long")
    order = Window.partitionBy("scope", "part").orderBy(F.desc("z"))
    to_here = order.rowsBetween(Window.unboundedPreceding, 0)
    at = scopes.groupBy("scope", "part", "z").agg(*sums).withColumns({
        "n0": F.sum("n0").over(to_here), "n1": F.sum("n1").over(to_here), "after": F.lead("z").over(order),
    }).join(F.broadcast(known), ["scope", "part"])
    hit, wrong = (F.col("n1") + F.col("b1")) * weights[1], (F.col("n0") + F.col("b0")) * weights[0]
    f1 = 2 * hit / (hit + wrong + F.col("all1") * weights[1])
    best = at.withColumn("after", F.coalesce("after", "first")).groupBy("scope").agg(F.max(F.struct(f1.alias("f1"), "z", "after")).alias("m"))
    cut = F.coalesce((F.col("m.z") + F.col("m.after")) / 2, F.col("m.z") - 1.0)
    return {r["scope"]: r["cut"] for r in best.select("scope", cut.alias("cut")).collect()}


def calibrate(net: Network, rows: DataFrame, weights: dict[int, float]) -> None:
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, WORKED_BYTES)):
            texts = lists_of(part)
            ends = np.cumsum([len(t) for t in texts])
            whole, at = np.unique(np.concatenate(texts).astype(np.uint64) @ np.array([1 << 32, 1], np.uint64), return_inverse=True)
            pairs = np.stack((whole >> np.uint64(32), whole & np.uint64(0xFFFFFFFF)), axis=1).astype(np.uint32)
            z = shared.value.logits(pairs, [at[e - len(t) : e] + 1 for t, e in zip(texts, ends)])
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("language"), pa.array(z.astype(np.float64))], ["label", "language", "z"])

    scores = kept(arrow_map(rows.where("apart").select("label", "language", "words"), work, "label int, language int, z double"))
    found = thresholds(scores, weights)
    net.thresholds[:] = found.get(0, 0.0)
    for k, z in found.items():
        if k:
            net.thresholds[k] = z


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The calibrated model, or None without labels of both kinds."""
    rows, shards, counts = training_rows(docs, labels)
    n = {(r["label"], r["apart"]): r["count"] for r in counts}
    total = {k: n.get((k, False), 0) + n.get((k, True), 0) for k in (0, 1)}
    if not min(total.values()):
        return None
    net = Network(vocabulary(rows))
    squares, passes = fresh_squares(net), passes_of((n.get((0, False), 0) + n.get((1, False), 0)) / shards)
    for k in range(ROUNDS):
        a_round(rows, net, squares, k, passes)
    calibrate(net, rows, {k: total[k] / max(n.get((k, True), 0), 1) for k in (0, 1)})
    return net


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)

    def work(batch: pa.RecordBatch) -> list:
        model = shared.value
        if model is None:
            return [batch.column("doc_id"), pa.array(np.zeros(batch.num_rows))]
        index, texts = Numbers(), []
        for text in batch.column("text"):
            words = word_list(text.as_py())
            texts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
        of = np.append(0, languages_of(index))
        logits = model.logits(hashed(index), texts)
        z = np.clip(logits.astype(np.float64) - model.thresholds[[guess(of[t]) for t in texts]], -500, 500)
        return [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))]

    return per_document(docs, {"doc_id": "long", "text": "string"}, "doc_id long, score double", work, WORKED_BYTES)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = scored(docs, train(docs, labels))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
