from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tidecast.llm import common, toxicity


def test_every_labelled_row_teaches(spark, monkeypatch):
    """More labelled texts than any fixed number, one longer than any fixed length, in several shards."""
    n = 12_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 5, F.repeat(F.lit("long "), 9000)).otherwise(F.concat(F.lit("w"), F.col("id") % 7)).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity, "SHARD", 2500)
    known = labels.where(~common.held_out(F.col("doc_id")))
    rows, shards, counts = toxicity.training_rows(docs.union(docs.limit(50)), labels.union(labels))
    want = {r["doc_id"]: r["toxic"] for r in known.collect()}
    assert {r["id"]: r["label"] for r in rows.select("id", "label").collect()} == want and rows.count() == len(want) > 9000
    assert shards == -(-len(want) // 2500) and sum(r["count"] for r in counts) == len(want)
    assert rows.where("id = 5").first()["words"][::2] == [np.uint32(toxicity.buckets(b"long")[0]).view(np.int32)] * 9000


def test_shards_learn_the_same_words(spark, monkeypatch):
    words = ["vile", "rotten"]
    rows = [(k, " ".join(["plain", "day", f"x{k % 11}", *([words[k % 2]] if k % 5 == 0 else [])])) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity, "SHARD", 800)
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in got) and len(got) == 3000
    net, again = toxicity.train(docs, labels), toxicity.train(docs.repartition(13), labels.repartition(3))
    assert all(np.array_equal(a, b) for a, b in zip(net.params(), again.params()))


def test_thresholds_of_ranges_are_those_of_all_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(int(y), int(k), float(round(rng.normal(y, 1), 2))) for y, k in zip(rng.random(4000) < 0.2, rng.integers(0, 4, 4000))]
    weights = {0: 4.1, 1: 3.7}
    got = toxicity.thresholds(spark.createDataFrame(rows, "label int, language int, z double").repartition(5), weights)

    def best(own):
        values = sorted({z for _, _, z in own}, reverse=True)
        f1 = []
        for cut in values:
            hit = weights[1] * sum(y for y, _, z in own if z >= cut)
            f1.append(2 * hit / (hit + weights[0] * sum(1 - y for y, _, z in own if z >= cut) + weights[1] * sum(y for y, _, _ in own)))
        k = int(np.argmax(f1))
        return (values[k] + values[k + 1]) / 2

    assert set(got) == {0, 1, 2, 3}
    for k, cut in got.items():
        assert abs(cut - best([r for r in rows if k in (0, r[1])])) < 1e-9


def test_chunks_do_not_change_gradients(monkeypatch):
    rng = np.random.default_rng(4)
    net = toxicity.Network(np.arange(1, 31, dtype=np.uint32), 3)
    index, starts = toxicity.laid_out([rng.integers(0, 31, (n, 2)).astype(np.int32) for n in (1, 40, 3, 0, 90)])
    labels = np.array([0, 1, 1, 0, 1], np.float32)
    whole = toxicity.gradients(net, index, starts, labels)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    for (k, a, at), (j, b, where) in zip(whole, toxicity.gradients(net, index, starts, labels)):
        assert k == j and np.allclose(a, b, atol=1e-6) and (not isinstance(at, np.ndarray) or np.array_equal(at, where))


def test_a_partition_holds_one_shard(spark, monkeypatch):
    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity, "SHARD", 500)
    rows, shards, _ = toxicity.training_rows(docs, labels)
    found = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.collect_set("shard").alias("s")).collect()
    assert shards == 10 and sorted(r["s"] for r in found) == [[k] for k in range(10)]


def test_kept_files_are_those_of_shards(spark, monkeypatch):
    """Each kept file costs its executor several processes, so their number must not follow the session's partitions."""
    rows = [(k, f"plain day x{k % 11} " + ("vile" if k % 5 == 0 else "")) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity, "SHARD", 450)
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    top = Path(common.ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(top.rglob("part-*"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert toxicity.train(docs, labels) is not None
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(set(top.rglob("part-*")) - before) == 2 * 2  # rows and scores of two shards


def test_portions_of_a_size_of_ones_own(spark):
    docs = spark.range(400).select(F.repeat(F.lit("x"), 100).alias("text")).coalesce(1)
    work = lambda batch: [[batch.num_rows] * batch.num_rows]
    got = [r["n"] for r in common.per_document(docs, {"text": "string"}, "n long", work, 4000).collect()]
    assert len(got) == 400 and max(got) * 100 <= 4000


def test_languages_from_numbered_words():
    texts = ["the man of the house and le chat", "", "xyz xyz", "der die the of", "le les des une the"]
    numbers = toxicity.Numbers()
    own = [[numbers[w] for w in toxicity.word_list(t)] for t in texts]
    of = np.append(0, toxicity.languages_of(numbers))
    want = ["en", "", "", "en", "fr"]  # of equal counts the first
    assert list(numbers.values()) == list(range(1, len(numbers) + 1)) and [list(numbers)[k - 1] for k in own[2]] == [b"xyz"] * 2
    assert [toxicity.LANGUAGES[toxicity.guess(of[np.array(t, np.int32)])] for t in own] == want
    assert [toxicity.LANGUAGES[toxicity.guess(toxicity.languages_of(toxicity.word_list(t)))] for t in texts] == want
