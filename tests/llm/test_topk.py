import numpy as np
import pytest

from tidecast.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def plain(rows, asked, k):
    """Every query against all rows."""
    def whole(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            return None
        return tuple(1024 * int(np.float32(x)) if abs(x) > 1e12 else int(np.floor(1024 * float(np.float32(x)))) for x in v)

    held = sorted({(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None})
    out = []
    for i, q in sorted({(i, whole(v)) for i, v in asked if i is not None and whole(v) is not None}):
        scores = [(sum(a * b for a, b in zip(q, v)), j) for j, v in held if j != i and len(v) == len(q)]
        scores = sorted((-min(max(x, -(1 << 63)), (1 << 63) - 1), j) for x, j in scores)
        out += [(i, n, j, -x) for n, (x, j) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("block,batch", [(8192, 256), (7, 3)])
def test_against_all_pairs(spark, block, batch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 6).tolist()) for i in range(120)]
    rows += [(i, [0.25] * 6) for i in range(200, 240)]  # ties
    rows += [(i, [0.5, -0.5]) for i in range(300, 305)] + [(310, []), (311, [])]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 4), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [rows[0], rows[0]]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    asked = [r for r in rows if r[0] is None or r[0] % 10 == 0]
    got = topk.top_k(table, table.where("vec_id is null or vec_id % 10 = 0"), 10, block=block, batch=batch)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, asked, 10))


def test_components_of_any_size(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(0, 1, 4) * 10.0 ** rng.integers(-3, 3)).tolist()) for i in range(60)]
    rows += [(60 + i, (rng.normal(0, 1, 4) * 10.0 ** rng.integers(5, 10)).tolist()) for i in range(25)]
    rows += [(90, [1e30, 0.0, 1.0, -1e20]), (91, [-1e30, 3.0, 0.0, 1e25]), (92, [float(1 << 20), 0.5, 0.25, 0.0]), (90, [1e30, 0.0, 1.0, -1e20])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    asked = [r for r in rows if r[0] % 5 == 0]
    got = topk.top_k(table, table.where("vec_id % 5 = 0"), 10, block=16, batch=4)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, asked, 10))


def test_boundary_rows_cover_the_best():
    rng = np.random.default_rng(6)
    for n, dims in ((1, 3), (63, 4), (64, 4), (65, 9), (500, 16), (40, 0)):
        ids, values = np.arange(n), rng.integers(-600, 600, (n, dims))
        queries = rng.integers(-600, 600, (9, dims))
        queries[0] = 0
        block = topk.Block(ids, values)
        for i, found, scores in block.best(np.arange(9), queries, 10):
            exact = values @ queries[i]
            allowed = ids[ids != i]
            best = allowed[np.lexsort((allowed, -exact[allowed]))][:10]
            assert found.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0], "x")], SCHEMA)
    assert topk.top_k(none, none, 10).count() == 0
    assert topk.top_k(some, none, 10).count() == 0
    assert topk.top_k(some, some, 10).count() == 0
