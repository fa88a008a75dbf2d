"""Packing by first-fit decreasing, with a tournament tree over the free room of the bins, in randomised groups of documents.

A document's ids are cut into full sequences and one rest. Full sequences stand alone. The rests are dealt to
groups of about GROUP_DOCS by a hash of row and position, so that no document, source or repeated row can fill a group, and each group is packed
by itself: rests by falling length, each into the first bin that has room, which the tree finds in a logarithmic descent.
A group and its tree are of bounded size whatever the input.

Ids are those of the ``tokenizers`` library for the given file. The same vocabulary as a file of ranks gives the same ids several times
faster, except where the two libraries' tables of letters differ, a text spells a special token, or a run of white space is longer than the faster library's
pattern matcher can step back over; such texts go through ``tokenizers`` itself.

Defined results: a null or empty text is the closing id alone. Null ids stay null, and ids beside them keep all 64 bits. Repeated rows are packed as often as they occur. Ties of
length keep the order of (doc_id, start), null ids last. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import materialise

SEQUENCE, CLOSING, GROUP_DOCS = 2048, 1, 2048
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Up to here both libraries agree on what letters, numbers and spaces are.
_BEYOND = re.compile("[^\x00-ԯ]")
#: A run of white space that the rank file's library may not step back over.
_LONG_SPACE = re.compile(r"\s{100000}")
_FULL = 1 << 62


class Ids:
    """Token ids of a text as an array of uint32."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        if self.fast and not _BEYOND.search(text) and not any(s in text for s in self.special) and not (len(text) >= 100_000 and _LONG_SPACE.search(text)):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def ids_of(tokenizer_path: str, ranks_path: str | None, pattern: str | None) -> Ids:
    """One encoder for a Python process."""
    return Ids(tokenizer_path, ranks_path, pattern)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length; lengths fall from first to last, and none is above the capacity."""
    size = 1 << max(0, len(lengths) - 1).bit_length()
    room = [capacity] * (2 * size)  # each node: the most room of a bin below it
    used = [0] * size
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for n, length in enumerate(lengths.tolist()):
        at = 1
        while at < size:
            at *= 2
            if room[at] < length:
                at += 1
        bins[n], offsets[n] = at - size, used[at - size]
        used[at - size] += length
        room[at] -= length
        while at > 1:
            at >>= 1
            a, b = room[2 * at], room[2 * at + 1]
            room[at] = a if a > b else b
    return bins, offsets


def pieces(docs: DataFrame, encoder: tuple[str, str | None, str | None], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, cut into sequences and a rest: PIECE_SCHEMA."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(*encoder)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                own = np.append(ids.of(text.as_py() or ""), np.uint32(CLOSING)).astype("<u4")
                data, doc_id = own.tobytes(), doc.as_py()
                for start in range(0, len(own), SEQUENCE):
                    n = min(SEQUENCE, len(own) - start)
                    for column, value in zip(rows, (doc_id, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(own)), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(cut, PIECE_SCHEMA)


def _pack(rests: pa.Table) -> pa.Table:
    """Places for the rests of one group. Arrow all the way: ids are never numbers that round."""
    rests = rests.take(pc.sort_indices(rests, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]))
    bins, offsets = first_fit_decreasing(rests["length"].to_numpy(), SEQUENCE)
    sequences = rests["group"].to_numpy() * (1 << 32) + bins
    return rests.drop_columns("group").append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets))


def pack(docs: DataFrame, encoder: tuple[str, str | None, str | None], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: PIECE_SCHEMA, sequence_id, offset."""
    cut = materialise(pieces(docs, encoder, id_col, text_col), "pack-pieces")
    rests = cut.filter(F.col("length") < SEQUENCE)
    groups = max(1, -(-rests.count() // GROUP_DOCS))
    # The table is fixed, so a repeated task sees its rows at the same places and deals them alike.
    dealt = rests.withColumn("group", F.pmod(F.xxhash64("doc_id", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    packed = dealt.groupBy("group").applyInArrow(_pack, PIECE_SCHEMA + ", sequence_id long, offset long")
    full = cut.filter(F.col("length") == SEQUENCE).withColumns({"sequence_id": F.lit(_FULL) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)
