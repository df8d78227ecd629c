import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidecast.llm import mixing as m


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0.001, 10), min_size=1, max_size=40), st.sampled_from([64, 1024]))
def test_every_block_of_a_cycle_meets_its_deadline(weights, cycle):
    q = m.shares(weights, cycle)
    assert sum(q) == cycle and min(q) >= 1
    slots = m.cycle_slots(q)
    assert sorted(t for s in slots for t in s) == list(range(cycle))
    for own, n in zip(slots, q):
        for k, t in enumerate(own):
            assert k * cycle // n <= t < -(-(k + 1) * cycle // n)
        for t in range(cycle + 1):  # less than one block from the share
            assert abs(sum(x < t for x in own) - t * n / cycle) < 1


def test_phases_send_every_block_once():
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randint(1, 12)
        blocks = {i: rng.choice([0, 1, rng.randint(2, 900)]) for i in range(n)}
        used, sent = set(), dict.fromkeys(blocks, 0)
        for s, a, b, start, slots in m.phases({i: rng.random() + 0.01 for i in range(n)}, blocks, 64):
            assert a == sent[s] and b > a
            sent[s] = b
            used |= {start + k // len(slots) * 64 + slots[k % len(slots)] for k in range(b - a)}
        assert sent == blocks and used == set(range(sum(blocks.values())))


def plain(rows, weights, rest, block):
    """slot and start of every row, by walking each source in its order."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    key = lambda i: 42 if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
    tie = lambda t: 42 if t is None else signed(xxhash.xxh64_intdigest(t.encode(), 42))
    sources, names = {}, list(weights)
    for i, text, source in rows:
        sources.setdefault(names.index(source) if source in names else len(names), []).append((i, text))
    at, total = {}, {}
    for s, own in sources.items():
        own.sort(key=lambda r: (key(r[0]), -1 if r[0] is None else r[0], tie(r[1])))
        total[s] = 0
        for i, t in own:
            at.setdefault((i, t), []).append((s, total[s]))
            total[s] += max(len(t or ""), 1)
    slot = {}
    for s, a, b, first, slots in m.phases(
        dict(enumerate([*weights.values(), rest])), {s: -(-n // block) for s, n in total.items()}
    ):
        for k in range(a, b):
            slot[s, k] = first + (k - a) // len(slots) * m.CYCLE + slots[(k - a) % len(slots)]
    return {k: sorted((slot[s, p // block], p) for s, p in v) for k, v in at.items()}


def check(docs, weights, rest, block):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = plain(rows, weights, rest, block)
    got = {}
    place = m.schedule(docs, ["doc_id", "text"], weights, rest, block)
    for r in place.collect():
        assert r.release <= r.slot < r.deadline
        got.setdefault((r.row.doc_id, r.row.text), []).append((r.slot, r.start))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert m.mix_order(docs, weights, rest, block).count() == len(rows)


def test_against_a_plain_walk(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, {"src0": 0.5, "src1": 0.2, "src2": 0.2}, 0.1, 3000)


def test_odd_rows(odd, docs_of, no_docs):
    check(odd, {"a": 1.0}, 2.0, 100)
    check(odd, {}, 1.0, 1 << 16)
    mixed = docs_of((1, "a", None), (2, None, "b"), (3, "c", "a"), (3, "c", "a"))
    check(mixed, {"a": 1.0, "none of these": 3.0}, 1.0, 1)
    assert m.mixed(no_docs, {"a": 1.0}, 1.0).count() == 0
    with pytest.raises(ValueError):
        m.mixed(mixed, {"a": 0.0}, 1.0)


def test_mixed_keeps_rows_and_columns_in_order(odd, spark, tmp_path):
    out = m.mixed(odd, {"a": 1.0}, 1.0, 100)
    assert out.columns == odd.columns
    out.write.parquet(str(tmp_path / "m"))
    files = sorted((tmp_path / "m").glob("part-*.parquet"))
    got = [r for f in files for r in spark.read.parquet(str(f)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, odd.collect()))
    place = {}
    for r in m.schedule(odd, ["doc_id", "text"], {"a": 1.0}, 1.0, 100).collect():
        place.setdefault((r.row.doc_id, r.row.text), []).append((r.slot, r.start))
    at = [place[r.doc_id, r.text] for r in got]
    assert [min(x) for x in at] == sorted(min(x) for x in at)


def test_no_source_drifts_from_its_target_weight():
    """Over many cycles and beyond the first source's end, against the weights themselves."""
    from fractions import Fraction

    from tidecast.llm.queries import MIX, MIX_REST

    for weights, n in (
        ([*MIX.values(), MIX_REST], [1500] + [700] * 20),
        ([0.9997, 0.0003], [20_000, 20]),
        ([1 / 3, 0.123456789, 0.5], [3000] * 3),
    ):
        first = {}
        for s, a, b, start, slots in m.phases(dict(enumerate(weights)), dict(enumerate(n)), 64):
            first.setdefault(start, {})[s] = [start + t for t in slots]
            assert len(slots) == b - a
        left = dict(enumerate(n))
        for start, sent in sorted(first.items()):
            exact = {s: Fraction(str(weights[s])) for s in left if left[s]}
            total = sum(exact.values())
            for s, slots in sent.items():
                for k, t in enumerate(slots):
                    due = (t - start) * exact[s] / total
                    assert abs(k - due) < 1 and abs(k + 1 - due - exact[s] / total) < 1
            for s, slots in sent.items():
                left[s] -= len(slots)
        assert not any(left.values())


def test_periods_repeat(docs_of):
    """A period shorter than the phase, in rows: release, slot and deadline follow from the weights."""
    docs = docs_of(*[(i, "x", "ab"[i % 5 > 2]) for i in range(400)])
    rows = m.schedule(docs, ["source"], {"a": 0.6, "b": 0.4}, 1.0, 1, least=1).collect()
    assert sorted(r.slot for r in rows) == list(range(400))
    for r in rows:
        if r.slot >= 390:  # one source ends, and the other begins a phase
            continue
        x = {"a": 3, "b": 2}[r.row.source]
        assert (r.release, r.deadline) == (r.block * 5 // x, -(-(r.block + 1) * 5 // x))
        assert r.release <= r.slot < r.deadline
