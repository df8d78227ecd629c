import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidecast.llm import components, queries
from tidecast.llm import simhash as s


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Index of the smallest member of each one's component."""
    a, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            p, q = find(i), find(int(j))
            root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(a))]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    lowest = plain_components(fps)
    got = {r.doc_id: r for r in queries.op2_simhash(spark, sf).collect()}
    assert len(got) == len(docs)
    for r, fp, k in zip(docs, fps, lowest):
        assert got[r.doc_id].fingerprint == f"{fp:016x}"
        assert got[r.doc_id].component_id == docs[k].doc_id


def family(rng, centre, bits, n):
    """Fingerprints around a centre that differ in some of a few bits."""
    chosen = rng.choice(64, bits, replace=False)
    out = set()
    while len(out) < n:
        flips = rng.integers(0, 2, bits)
        out.add(int(centre) ^ sum(1 << int(b) for b, f in zip(chosen, flips) if f))
    return out


@pytest.mark.parametrize("cell", [4, 16, 4096])
def test_links_lose_no_pair_in_large_cells(spark, cell):
    rng = np.random.default_rng(3)
    fps = set(rng.integers(0, 1 << 63, 200).tolist()) | {0, (1 << 64) - 1, 1}
    fps |= family(rng, rng.integers(0, 1 << 63), 9, 150) | family(rng, rng.integers(0, 1 << 63), 30, 60)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    points = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = s.links(points, cell=cell).collect()
    root = list(range(len(fps)))
    at = {x: i for i, x in enumerate(signed)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        p, q = find(at[r.a]), find(at[r.b])
        root[max(p, q)] = min(p, q)
    assert [find(i) for i in range(len(fps))] == plain_components(fps)


def test_embedding_bounds_the_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    counts = lambda x: np.array([[bin(int(v) >> (2 * i) & 3).count("1") for i in range(32)] for v in x])
    manhattan = np.abs(counts(a[:300]) - counts(b[:300])).sum(axis=1)
    assert (np.bitwise_count(s.unary(a[:300]) ^ s.unary(b[:300])) == manhattan).all()
    assert (np.bitwise_count(s.unary(a) ^ s.unary(b)) <= np.bitwise_count(a ^ b)).all()


def test_odd_rows(odd, odd_rows, docs_of, no_docs):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in s.components(odd).collect()), key=str)
    assert len(got) == len(odd_rows)
    ids = {}
    for i, f, c in got:
        ids.setdefault(i, set()).add((f, c))
    zero = "0" * 16
    assert ids[1] == ids[2] == ids[3] == {(zero, 1)}
    assert len(ids[7]) == 1 and len(ids[8]) == 2
    assert [c for _, c in ids[None]] == [None]
    alone = docs_of((None, "same text here"), (5, "same  TEXT here"), (None, "other words of it"))
    assert sorted((r.component_id for r in s.components(alone).collect()), key=str) == [5, 5, None]
    assert s.components(no_docs).count() == 0


def test_one_of_each(docs_of, odd, no_docs):
    docs = docs_of(
        (3, "the very same words"), (1, "the very same words"), (1, "the very same words"), (2, "The very  same words"),
        (None, "no id at all"), (None, "no id at all"), (4, None), (9, ""), (5, "quite another text"),
    )
    out = s.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        [(1, "the very same words"), (None, "no id at all"), (4, None), (5, "quite another text")], key=str
    )
    assert s.one_of_each(no_docs).count() == 0
    assert s.one_of_each(odd).count() == s.components(odd).select("fingerprint").distinct().count()


def test_components_of_graphs(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 499), (499, 500)]
    edges += [tuple(map(int, e)) for e in rng.integers(1000, 1200, (150, 2))]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    empty = spark.createDataFrame([], "a long, b long")
    assert components.connected(empty).count() == 0
    assert components.connected(empty.union(spark.range(1).select(F.lit(1), F.lit(1)))).collect()[0].root == 1
