"""Quality rules: counts of a text, and how much its n-grams resemble a trusted corpus.

Every word and every pair of neighbouring words of a text falls into one of ``BUCKETS`` hash buckets.  Two
multinomials are fitted over the buckets, one to trusted documents and one to the whole raw corpus; a
document's score is the mean of log p_trusted / p_raw over its n-grams, and the document is kept if no base
rule fails and the score reaches ``THRESHOLD``.  Everything is a DataFrame expression: an equi-join on the id
marks all trusted documents, whatever their number; the counting job adds up per task before its shuffle, so
that at most ``BUCKETS`` rows leave a task; the scoring job has no shuffle and no state beyond one document.

Defined cases: a null or blank text has no word, all counts 0, no score (null) and is not kept; with fewer
than five words there is no window and ``n_repeat_words`` is 0; repeated rows each give a row; a null id
stays null and is never trusted; with no trusted text, or an empty corpus, every score is 0.  Equal windows
and equal buckets are told by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Hash buckets of the multinomials; the table of ratios has so many numbers, whatever the corpus.
BUCKETS = 1 << 14
#: Added to every bucket's count.
SMOOTHING = 1.0
#: A kept document's least mean log-likelihood ratio.
THRESHOLD = -0.15
#: Rows without an id, which match nothing, are dealt over so many keys of the join.
NO_ID_KEYS = 1 << 10
#: Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20


def _hashed(docs: DataFrame, *keep: str) -> DataFrame:
    """One 64-bit hash per word, beside the named columns."""
    return docs.select(*keep, words(F.col("text")).alias("w")).select(
        *keep, "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h")
    )


def _buckets(h: Column) -> Column:
    """Buckets of the single words, then of the pairs of neighbours."""
    single = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    pair = F.transform(
        F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))),
        lambda x, i: F.pmod(F.xxhash64(F.get(h, i), x), F.lit(BUCKETS)).cast("int"),
    )
    return F.concat(single, pair)


def trusted_ids(positives: DataFrame) -> DataFrame:
    """The ids of all trusted documents, each once."""
    return positives.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, trusted): n-grams of all documents, and of the trusted ones."""
    mark = trusted.select(F.col("doc_id").alias("trusted_id"), F.lit(0).alias("trusted_deal"))
    # The same plan at every size: ids are dealt out with the texts, never sent to every task, and texts are not sorted.
    deal = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(NO_ID_KEYS)).cast("int")).otherwise(0)
    flagged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("deal", deal)
        .join(mark.hint("shuffle_hash"), (F.col("doc_id") == F.col("trusted_id")) & (F.col("deal") == F.col("trusted_deal")), "left")
    )
    grams = _hashed(flagged, "trusted_id").select("trusted_id", F.explode(_buckets(F.col("h"))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted_id").alias("trusted"))


def log_ratios(counts: DataFrame) -> list[float]:
    """log p_trusted / p_raw of every bucket; the driver sees BUCKETS rows at most."""
    import math

    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["trusted"]
    if not sum(good):
        return [0.0] * BUCKETS
    n_raw, n_good = sum(raw) + SMOOTHING * BUCKETS, sum(good) + SMOOTHING * BUCKETS
    return [math.log((g + SMOOTHING) / n_good) - math.log((r + SMOOTHING) / n_raw) for g, r in zip(good, raw)]


def _constant(values: list[float]) -> Column:
    """An array that Catalyst folds to one literal."""
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values)), ",").cast("array<double>")


def measures(docs: DataFrame, ratios: list[float], *keep: str) -> DataFrame:
    """The columns ``keep``, the counts of the base rules and the n-gram score of every row."""
    n = F.size("w")
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = (
        docs.select(*keep, F.coalesce("text", F.lit("")).alias("t"))
        .select(*keep, "t", words(F.col("t")).alias("w"), lines.alias("lines"))
        .select(
            *keep,
            n.cast("long").alias("n_words"),
            F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
            F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        )
    )
    h = F.col("h")
    window = F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]),
    )
    table = _constant(ratios)
    total = F.aggregate(_buckets(h), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    grams = F.when(F.size(h) > 0, 2 * F.size(h) - 1)
    scored = counted.withColumns({"v": window, "score": total / grams})
    # Windows in order of their hash: equal ones are neighbours, and only texts that have some are sorted.
    ordered = F.when(
        F.size(F.array_distinct("v")) < F.size("v"),
        F.sort_array(F.transform("v", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
    ).otherwise(F.expr("array()").cast("array<struct<x:bigint,i:int>>"))
    s = F.col("s")
    same = lambda e, i: F.coalesce(F.get(s, i)["x"] == e["x"], F.lit(False))
    twice = F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"])
    p = F.col("p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return (
        scored.withColumn("s", ordered)
        .withColumn("p", F.sort_array(twice))
        .withColumn("n_repeat_words", covered.cast("long"))
        .drop("h", "v", "s", "p")
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _verdict(threshold: float) -> Column:
    return ~base_failed() & F.coalesce(F.col("score") >= threshold, F.lit(False))


def good_documents(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that pass."""
    ratios = log_ratios(bucket_counts(docs, trusted))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    # The partition number is in no way part of the verdict: an expression that is not deterministic keeps
    # the filter above the measures, which would otherwise be computed again inside their own lambdas.
    out = measures(rows, ratios, "row").withColumn("part", F.spark_partition_id())
    return out.where(_verdict(threshold) & (F.col("part") >= 0)).select("row.*")


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    ``trusted`` has the ids of trusted documents, each once (as ``trusted_ids`` gives them)."""
    ratios = log_ratios(bucket_counts(docs, trusted))
    out = measures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratios, "doc_id")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), _verdict(threshold).alias("kept"), "score",
    )
