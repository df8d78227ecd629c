"""Byte-level BPE encoding and decoding by a pair occurrence index.

A task splits its texts into pretokens and gathers the distinct ones.  Their bytes stand in one array of symbols, a linked list per pretoken.  An index maps the rank of each mergeable
pair to all positions at which the pair stands.  The active ranks are taken in ascending order: all
positions of a rank are merged at once (in a run of equal symbols every other one, from the left), and the
pairs that the merged symbols form with their neighbours are entered under their own ranks.  A rule's
result only stands in rules of higher rank, so this order is the one each pretoken would be merged in alone.

The vocabulary and its merges come from a ``tokenizers`` JSON file, whose path is a parameter; every
executor needs the file at that path.  Special tokens of the file are cut out of the text first, as the library
does.  Memory is bounded by the portion of texts in work.

Defined cases: null and empty texts have no ids, and decode to the empty text; a text of one very long
pretoken is one list in the index; repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import per_document, ragged

#: The pretoken pattern of the vocabulary, for any text and for texts below U+0100.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"

#: Pretokens that are gathered before they are counted as distinct ones.
PENDING = 1 << 17
#: log2 of the ranks in a block of the index.
BLOCK_BITS = 8


def narrow_pattern() -> re.Pattern:
    """The pretoken pattern with its classes spelt out up to U+00FF, which the faster module can do."""
    return re.compile(
        f" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
        f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, the others
    as U+0100 and on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def _runs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct value and the indices at which it stands."""
    if len(values) < 2:
        if len(values):
            yield int(values[0]), np.zeros(1, np.intp)
        return
    order = np.argsort(values, kind="stable")
    held = values[order]
    cuts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1], [True])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(held[a]), order[a:b]


class Vocabulary:
    """Merges as sorted arrays, the bytes of each id, special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        letters = byte_characters()
        back = {c: b for b, c in enumerate(letters)}
        size = 1 + max([*ids.values(), *[t["id"] for t in spec["added_tokens"]]])
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.first = np.array([ids[c] for c in letters], np.int32)
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.left, self.right = left, right
        self.result = np.array([ids[a + b] for a, b in merges], np.int32)
        key = (left << 32) | right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.wide, self.narrow = regex.compile(PRETOKEN), narrow_pattern()
        cut = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, cut)) + ")") if cut else None

    def pretokens(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide.findall(text)
        return self.narrow.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Pretokens and special tokens of a text, in order."""
        if self.cut is None or not any(t in text for t in self.special):
            return self.pretokens(text)
        parts = self.cut.split(text)
        return [p for k, s in enumerate(parts) for p in ([s] if k % 2 else self.pretokens(s))]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where no rule joins them."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1).astype(np.int32)

    def merge(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        symbol = self.first[np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        starts, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
        n = len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1], before[starts] = -1, -1
        alive = np.ones(n, bool)
        # The index: per block of ranks, (rank, position) arrays; the ranks of the block in work are split up.
        later: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range((len(self.keys) >> BLOCK_BITS) + 1)]
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rank = self.ranks(symbol[at], symbol[after[at]])
            known = rank >= 0
            return rank[known], at[known]

        def enter(entries: list[tuple[np.ndarray, np.ndarray]]) -> None:
            rank, at = (np.concatenate([e[k] for e in entries]) for k in (0, 1))
            for block, part in _runs(rank >> BLOCK_BITS):
                later[block].append((rank[part], at[part]))

        for first in range(0, n, PENDING):
            enter([pairs(first + np.flatnonzero(after[first : first + PENDING] >= 0).astype(np.int32))])
        for block, entries in enumerate(later):
            if not entries:
                continue
            rank, at = (np.concatenate([e[k] for e in entries]) for k in (0, 1))
            later[block] = []
            lists = {r: [at[part]] for r, part in _runs(rank)}
            active = list(lists)
            heapq.heapify(active)
            while active:
                r = heapq.heappop(active)
                own = lists.pop(r)
                at = np.unique(np.concatenate(own) if len(own) > 1 else own[0])
                a, b = self.left[r], self.right[r]
                at = at[alive[at] & (symbol[at] == a)]
                second = after[at]
                right = (second >= 0) & (symbol[second] == b)
                at, second = at[right], second[right]
                if a == b and len(at) > 1:
                    joined = np.concatenate(([False], second[:-1] == at[1:]))
                    place = np.arange(len(at))
                    every_other = (place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0
                    at, second = at[every_other], second[every_other]
                if not len(at):
                    continue
                beyond = after[second]
                symbol[at], alive[second], after[at] = self.result[r], False, beyond
                inner = at[beyond >= 0]
                before[after[inner]] = inner
                ahead = before[at]
                ranks, places = pairs(np.concatenate((ahead[ahead >= 0], inner)))
                if not len(places):
                    continue
                now = ranks >> BLOCK_BITS == block
                if now.any():
                    for r, part in _runs(ranks[now]):
                        if r not in lists:
                            lists[r] = []
                            heapq.heappush(active, r)
                        lists[r].append(places[now][part])
                    ranks, places = ranks[~now], places[~now]
                found.append((ranks, places))
            if found:
                enter(found)
                found.clear()
        counts = np.add.reduceat(alive, starts, dtype=np.int64) if n else np.zeros(0, np.int64)
        return symbol[alive], counts

    def distinct(self, texts: Iterable[str | None]) -> tuple[np.ndarray, list[int], pa.StringArray]:
        """The number of each piece of all texts, how many pieces each text has, and the distinct pieces."""
        chunks, pending, sizes = [], [], []
        for text in texts:
            pieces = self.pieces(text or "")
            sizes.append(len(pieces))
            pending += pieces
            if len(pending) > PENDING:
                chunks.append(pa.array(pending, pa.string()).dictionary_encode())
                pending = []
        chunks.append(pa.array(pending, pa.string()).dictionary_encode())
        whole = pa.chunked_array(chunks).unify_dictionaries()
        return np.concatenate([c.indices.to_numpy() for c in whole.chunks]), sizes, whole.chunk(0).dictionary

    def rows(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; the pieces of all are encoded before the first is laid out."""
        numbers, sizes, pieces = self.distinct(texts)
        special = {t: pc.index(pieces, t).as_py() for t in self.special}
        tokens, counts = self.merge(pieces)
        starts = np.cumsum(counts) - counts
        for t, at in special.items():  # a special token is its own only id
            if at >= 0:
                starts[at], counts[at] = len(tokens), 1
                tokens = np.append(tokens, np.int32(self.special[t]))
        at = 0
        for n in sizes:
            own = numbers[at : at + n]
            at += n
            yield tokens[ragged(starts[own], counts[own])]

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        rows = list(self.rows(texts))
        return np.concatenate([np.empty(0, np.int32), *rows]), np.array([len(r) for r in rows], np.int64)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and file."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row."""

    def work(batch: pa.RecordBatch) -> list:
        ids, counts = vocabulary(path).encode(text.as_py() for text in batch.column("text"))
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        return [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))]

    return per_document(docs, {"doc_id": "long", "text": "string"}, "doc_id long, ids array<int>", work)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); null ids decode to the empty text."""

    def work(batch: pa.RecordBatch) -> list:
        vocab = vocabulary(path)
        return [batch.column("doc_id"), [vocab.decode(ids or []) for ids in batch.column("ids").to_pylist()]]

    return per_document(encoded, {"doc_id": "long", "ids": "array<int>"}, "doc_id long, text string", work)


def digests(docs: DataFrame, path: str, carry: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded and decoded again in one pass; then the columns
    ``carry`` (names and types) as they are."""
    carry = carry or {}

    def work(batch: pa.RecordBatch) -> list:
        vocab = vocabulary(path)
        n, of_ids, of_text = [], [], []
        for row in vocab.rows(text.as_py() for text in batch.column("text")):
            ids = row.tolist()
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(vocab.decimal.__getitem__, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(vocab.decode(ids).encode()).hexdigest())
        return [batch.column("doc_id"), pa.array(n, pa.int64()), of_ids, of_text, *[batch.column(c) for c in carry]]

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += "".join(f", `{c}` {kind}" for c, kind in carry.items())
    return per_document(docs, {"doc_id": "long", "text": "string"} | carry, schema, work)
