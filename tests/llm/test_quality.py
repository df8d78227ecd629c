import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import common, quality_model, queries, toxicity
from tidecast.llm import quality_rules as q


LARGER = "/root/testdata/sf0.1"


def plain_measures(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = collections.Counter(grams)
    repeated = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated)


def check_rules(rows, got):
    assert len(rows) == len(got)
    want = []
    for i, text in rows:
        m = plain_measures(text)
        want.append((i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)


def test_rules_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.op10_quality_rules(spark, sf)
    got = out.collect()
    check_rules(rows, got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    of = lambda quality: [r.kept for r in got if labels.get(r.doc_id) == quality and not r.base_failed]
    assert all(of(1)) and np.mean(of(0)) < 0.5


def test_scores_against_plain_counts(spark, sf, small):
    import xxhash

    def buckets(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        signed = [x - (1 << 64) if x >> 63 else x for x in h]
        pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
        pairs = [x - (1 << 64) if x >> 63 else x for x in map(pair, h, h[1:])]
        return [x % q.BUCKETS for x in signed + pairs]

    good = {r.doc_id for r in small if r.doc_id % 3 == 0}
    trusted = spark.createDataFrame([(i,) for i in good], "doc_id long")
    raw, of = collections.Counter(), collections.Counter()
    for r in small:
        raw.update(buckets(r.text))
        if r.doc_id in good:
            of.update(buckets(r.text))
    n, m = sum(raw.values()) + q.BUCKETS, sum(of.values()) + q.BUCKETS
    ratio = [math.log((of[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in range(q.BUCKETS)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.score for r in q.quality_rules(docs, trusted).collect()}
    for r in small:
        b = buckets(r.text)
        assert got[r.doc_id] == pytest.approx(sum(ratio[x] for x in b) / len(b), abs=1e-6) if b else got[r.doc_id] is None


def test_rules_on_odd_rows(spark, odd, odd_rows, no_docs):
    none = spark.createDataFrame([], "doc_id long")
    got = q.quality_rules(odd, none).collect()
    check_rules(odd_rows, got)
    assert all(r.score == 0 for r in got if r.n_words) and not any(r.kept for r in got if r.base_failed)
    assert q.quality_rules(no_docs, none).count() == 0
    kept = q.good_documents(odd, none)
    assert kept.columns == odd.columns
    assert sorted(kept.collect(), key=str) == sorted(
        (r for r in odd.collect() if plain_measures(r.text)[0] >= 10 and plain_measures(r.text)[4] * 5 <= plain_measures(r.text)[0]),
        key=str,
    )


def test_held_out(spark):
    rows = spark.range(500).select("id", common.held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def held_out_rows(spark, got, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    return [(r, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]


@pytest.fixture(scope="module")
def sample(spark):
    """A larger table, which has enough labels to learn from."""
    return tuple(spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))


def test_toxicity_on_held_out_rows(spark, sample):
    got = toxicity.toxicity(*sample).collect()
    assert len(got) == sample[0].count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    rows = held_out_rows(spark, got, "toxic")
    hit, false = [r.predicted for r, y in rows if y], [r.predicted for r, y in rows if not y]
    assert len(hit) > 30 and np.mean(hit) > 0.85 and np.mean(false) < 0.02


def test_quality_on_held_out_rows(spark, sample):
    got = quality_model.quality(*sample).collect()
    assert len(got) == sample[0].count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    rows = held_out_rows(spark, got, "quality")
    good, bad = [r.predicted for r, y in rows if y], [r.predicted for r, y in rows if not y]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_classifiers_do_not_read_other_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("score", F.lit(1))
    flipped = labels.withColumns(
        {c: F.when(common.held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")}
    )
    for of in (toxicity.toxicity, quality_model.quality):
        assert sorted(of(docs, labels).collect()) == sorted(of(other, flipped).collect())


def test_classifiers_on_odd_rows(spark, odd, odd_rows, no_docs, no_labels, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").union(
        spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    )
    mixed = docs.withColumn("score", F.lit("x")).union(odd.select(*docs.columns, "score"))
    for of in (toxicity.toxicity, quality_model.quality):
        got = of(mixed, labels).collect()
        assert len(got) == docs.count() + len(odd_rows) and all(0 <= r.score <= 1 for r in got)
        assert {r.score for r in of(odd, no_labels).collect()} == {0.0}
        assert of(no_docs, labels).count() == of(no_docs, no_labels).count() == 0


def test_prior_of_mixed_samples():
    rng = np.random.default_rng(9)
    n = quality_model.FEATURES
    good, bad = rng.normal(0, 1, (9000, n)), rng.normal(2, 1, (9000, n))
    for share in (0.3, 0.6, 0.9):
        k = int(4000 * share)
        mix = np.concatenate((good[:k], bad[: 4000 - k]))
        assert abs(quality_model.class_prior(good[4000:8000], rng.permutation(mix)) - share) < 0.06


def test_chunks_do_not_change_a_score(monkeypatch):
    rng = np.random.default_rng(2)
    words = [b"w%d" % i for i in range(300)]
    pairs = toxicity.hashed(words)
    texts = [rng.integers(1, 301, n).astype(np.int32) for n in (0, 1, 2, 500, 3, 0, 1000)]
    fitted = toxicity.fit([pairs[t - 1] for t in texts * 3], np.tile([0, 1, 0, 1, 1, 0, 1], 3).astype(np.float32))
    whole = fitted.logits(pairs, texts)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert np.allclose(whole, fitted.logits(pairs, texts), atol=1e-5)
    one = [fitted.logits(pairs, [t])[0] for t in texts]
    assert np.allclose(whole, one, atol=1e-5)


def test_every_trusted_document_counts(spark):
    """More trusted documents than any fixed number of ids: the counts are those of all of them."""
    n = 30_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    docs = docs.unionByName(spark.range(50).select(F.lit(None).cast("long").alias("doc_id"), F.lit("no id").alias("text")))
    labels = spark.range(n).select(F.col("id").alias("doc_id"))
    got = q.bucket_counts(docs, q.trusted_ids(labels.union(labels))).collect()
    assert (sum(r.raw for r in got), sum(r.trusted for r in got)) == (n + 150, n)


def small_network(rng):
    """A toxicity network in doubles over 30 words, and texts of it as both embedding rows of each word."""
    net = toxicity.Network(np.arange(1, 31, dtype=np.uint32), 3)
    net.rows, net.out, net.base = (x.astype(float) for x in (net.rows, net.out, net.base + 0.3))
    net.filters, net.bias = [f.astype(float) for f in net.filters], [b + rng.normal(0, 0.1, len(b)) for b in net.bias]
    texts = [rng.integers(0, 31, (n, 2)).astype(np.int32) for n in (1, 2, 3, 9, 40, 0)]
    return net, texts


def plain_logit(net, text):
    """One text, place by place: the sum of both rows of each word, every filter at every place, the largest, the output."""
    gap = max(toxicity.WIDTHS) - 1
    words = [net.rows[a] + net.rows[b] for a, b in text] or [np.zeros(toxicity.DIMS)]
    held = words + [np.zeros(toxicity.DIMS)] * gap
    out, at = net.base[0], 0
    for filters, bias in zip(net.filters, net.bias):
        for f in range(toxicity.FILTERS):
            best = max(sum(held[p + o] @ filters[o][:, f] for o in range(len(filters))) for p in range(len(words)))
            out += max(best + bias[f], 0) * net.out[at]
            at += 1
    return out


def test_toxicity_forward_pass_by_hand():
    rng = np.random.default_rng(1)
    net, texts = small_network(rng)
    pairs = rng.integers(1, 31, (12, 2)).astype(np.uint32)  # buckets of the words 1 to 12
    numbered = [rng.integers(1, 13, n).astype(np.int32) for n in (1, 2, 3, 9, 40)]
    got = net.logits(pairs, numbered)
    want = [plain_logit(net, net.lookup(pairs[t - 1].ravel()).reshape(-1, 2)) for t in numbered]
    np.testing.assert_allclose(got, want, rtol=1e-4)


def test_toxicity_gradients_by_differences():
    rng = np.random.default_rng(2)
    net, texts = small_network(rng)
    labels = np.array([1, 0, 1, 0, 1, 0.0])
    index, starts = toxicity.laid_out(texts)

    def loss():
        z = np.array([plain_logit(net, t) for t in texts])
        decay = sum((p * p).sum() for p in (*net.filters, net.out)) * toxicity.DECAY / 2
        return (np.logaddexp(0, z) - labels * z).mean() + decay

    for k, grad, at in toxicity.gradients(net, index, starts, labels):
        param, whole = net.params()[k], np.zeros_like(net.params()[k])
        whole[at] = grad
        for place in rng.choice(param.size, min(param.size, 25), replace=False):
            where = np.unravel_index(place, param.shape)
            if k == 0 and where[0] == 0:
                continue  # the row of unknown words stays zero
            had = param[where]
            param[where] = had + 1e-6
            up = loss()
            param[where] = had - 1e-6
            down = loss()
            param[where] = had
            assert whole[where] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_quality_forward_pass_and_gradients_by_differences():
    rng = np.random.default_rng(3)
    for prior in (None, 0.3, 1.2):
        net = quality_model.Network(np.zeros(quality_model.FEATURES), np.ones(quality_model.FEATURES), 4)
        p, u = rng.normal(0.5, 1, (20, quality_model.FEATURES)), rng.normal(-0.2, 1, (30, quality_model.FEATURES))
        if prior == 1.2:
            net.params[3] += 4  # the negative part falls below zero
        w, b, v, c = net.params

        def plain(rows):
            return np.array([sum(np.tanh(sum(x * w[i, h] for i, x in enumerate(row)) + b[h]) * v[h] for h in range(len(b))) + c[0] for row in rows])

        np.testing.assert_allclose(net.logits(p), plain(np.clip(p, -6, 6)), rtol=1e-9)
        p, u = net.scaled(p), net.scaled(u)

        def risk():
            zp, zu = (np.tanh(x @ w + b) @ v + c[0] for x in (p, u))
            plus, minus, of_u = np.logaddexp(0, -zp).mean(), np.logaddexp(0, zp).mean(), np.logaddexp(0, zu).mean()
            decay = quality_model.DECAY / 2 * ((w * w).sum() + (v * v).sum())
            if prior is None:
                return plus + of_u + decay
            part = of_u - prior * minus
            return (prior * plus + part if part >= 0 else -quality_model.TURN_BACK * part) + decay

        x = np.concatenate((p, u))
        z = np.tanh(x @ w + b) @ v + c[0]
        if prior:
            assert (np.logaddexp(0, z[20:]).mean() < prior * np.logaddexp(0, z[:20]).mean()) == (prior > 1)
        for param, grad in zip(net.params, net.gradients(x, quality_model.pull(z[:20], z[20:], prior))):
            for place in rng.choice(param.size, min(param.size, 20), replace=False):
                where = np.unravel_index(place, param.shape)
                had = param[where]
                param[where] = had + 1e-6
                up = risk()
                param[where] = had - 1e-6
                down = risk()
                param[where] = had
                assert grad[where] == pytest.approx((up - down) / 2e-6, abs=1e-7)
