"""Byte-level BPE encoding and decoding, with a segment tree over the byte positions of a piece.

Leaf ``i`` of the tree holds the rank of the live pair that starts at byte ``i``, packed above the position, so that the root is the
leftmost pair of the least rank. A merge rewrites three leaves (the pair itself, its left neighbour, and the position that is
gone) and walks to the root, so a piece of n bytes costs O(n log n) whatever its length; no piece is cut.

Words repeat, so each Python worker remembers the encodings of short ones in tables of bounded size (``pieces``).

Defined results: a null text counts as empty and has no ids (digests of the empty string). Repeated rows give
repeated results. Lone surrogates can't occur in Spark strings. Other columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.pieces import Pieces

class Bpe:
    """Encoder and decoder for a file of ranks (base64 token, rank) and the pattern that splits a text."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.named = {b"%d" % i: t for i, t in self.tokens.items()}
        self.digits = {t: b"%d" % i for t, i in self.ranks.items()}
        self.pieces = Pieces(regex.compile(pattern).findall, lambda piece: b",".join(self._spell(piece.encode(), self.digits)), b",")

    def _cuts(self, piece: bytes) -> list[int]:
        """Where each byte's token ends, valid at the bytes that start one: merges the leftmost pair of least rank until no pair has a rank."""
        rank, n = self.ranks.get, len(piece)
        after = list(range(1, n + 1))
        if n < 2:
            return after
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        shift, none = size.bit_length(), 1 << 62
        at_mask = (1 << shift) - 1
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r << shift | i
        for i in range(size - 1, 0, -1):
            x, y = tree[2 * i], tree[2 * i + 1]
            tree[i] = x if x < y else y
        before = list(range(-1, n))

        while (best := tree[1]) < none:
            i = best & at_mask
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            r = rank(piece[i : after[k]]) if k < n else None
            a = b = c = size + i
            tree[a] = none if r is None else r << shift | i
            if j < n - 1:
                b = size + j
                tree[b] = none
            if i:
                p = before[i]
                r = rank(piece[p:k])
                c = size + p
                tree[c] = none if r is None else r << shift | p
            # The three paths to the root soon become one.
            a, b, c = a >> 1, b >> 1, c >> 1
            while a:
                x, y = tree[2 * a], tree[2 * a + 1]
                tree[a] = x if x < y else y
                if b != a:
                    x, y = tree[2 * b], tree[2 * b + 1]
                    tree[b] = x if x < y else y
                if c != a:
                    x, y = tree[2 * c], tree[2 * c + 1]
                    tree[c] = x if x < y else y
                a, b, c = a >> 1, b >> 1, c >> 1
        return after

    def _spell(self, piece: bytes, names: dict) -> list:
        whole = names.get(piece)
        if whole is not None:
            return [whole]
        after, out, i = self._cuts(piece), [], 0
        while i < len(piece):
            out.append(names[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        return self._spell(piece, self.ranks)

    def encode_joined(self, text: str) -> bytes:
        """Decimal ids of a text joined by commas."""
        return self.pieces.joined(text)

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return list(map(int, joined.split(b","))) if joined else []

    def decode_joined(self, joined: bytes) -> bytes:
        return b"".join(map(self.named.__getitem__, joined.split(b","))) if joined else b""

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids; they are those of a text only if the ids are those of whole characters."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def coder(ranks_path: str, pattern: str) -> Bpe:
    """One coder for a Python process."""
    return Bpe(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [bpe.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: what ``encode`` gives, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                joined = bpe.encode_joined(text.as_py() or "")
                n.append(joined.count(b",") + 1 if joined else 0)
                ids_sha.append(hashlib.sha256(joined).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode_joined(joined)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
