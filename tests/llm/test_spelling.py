import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidecast.llm import spelling


def edits(a, b):
    """Levenshtein distance by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_words(rows, shortest=5, least=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def plain_variants(n):
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and edits(a, b) == 1:
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def invented():
    """Words over few letters: many near ones, chains of forms, words of one vector."""
    rng = np.random.default_rng(8)
    n = {}
    for _ in range(500):
        word = "".join(rng.choice(list("enatéz"), rng.integers(5, 8)))
        n[word] = int(rng.integers(3, 400))
    n |= {"x" * 300: 9, "x" * 299 + "y": 3, "x" * 301: 50, "abcde": 3, "abcdef": 6, "abcdefg": 12, "abcdefgh": 24}
    return n


@pytest.mark.parametrize("cell,batch", [(20_000, 20_000), (30, 7), (1, 50)])
def test_against_all_pairs(spark, invented, cell, batch):
    table = spark.createDataFrame(sorted(invented.items()), "word string, n long")
    got = spelling.variants(table, cell=cell, batch=batch).collect()
    assert len(got) == len(invented) and set(map(tuple, got)) == plain_variants(invented)


def test_trie_gives_each_pair_once(invented):
    held = np.array(sorted(invented), object)
    a, b = spelling.Trie(held).near(held)
    got = [tuple(sorted((held[i], held[j]))) for i, j in zip(a, b)]
    want = {p for p in itertools.combinations(sorted(invented), 2) if abs(len(p[0]) - len(p[1])) < 2 and edits(*p) == 1}
    assert len(got) == len(set(got)) and set(got) == want


def test_whole_documents(spark, small, odd, odd_rows):
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in small[:60]], "doc_id long, text string")
    n = plain_words([(r.doc_id, r.text) for r in small[:60]])
    assert {r.word: r.n for r in spelling.words(docs).collect()} == n
    assert {r.word: r.n for r in spelling.words(odd).collect()} == plain_words(odd_rows)
    assert set(map(tuple, spelling.spelling_variants(odd).collect())) == plain_variants(plain_words(odd_rows))


def test_letters_are_deleted_by_hash(spark, docs_of):
    rows = [(i, "Misspelling mISSPELLING misspelling ÉCOLE ÉCOLE ÉCOLE") for i in range(400)]
    got = {r.word: r.n for r in spelling.words(docs_of(*rows)).collect()}
    assert got == plain_words(rows) and len(got) > 2 and "École" in got


def test_empty_table(spark, no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0
