"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within three bits meet in a variant at most one bit from one and two bits from the other.
Distances that are odd join an even fingerprint (an even count of ones) and an odd one, distances that are even are
met by a variant one bit from both. It is therefore enough that even fingerprints emit the variants within one
bit (65) and odd ones those within two (2,081).

Shuffling that many variants of sixteen bytes would cost far more than the corpus itself. A row of the shuffle
thus stands for all variants of a fingerprint with one prefix, and the task that gets a prefix spells them out:
they meet as they would have if each had been shuffled, for a thirtieth of the bytes. The length of the prefix follows the number
of fingerprints. A prefix that draws too many variants (a family of near copies whose fingerprints nearly agree) is dealt again
by a longer one, down to single variants, of which no more than 2,081 fingerprints can be part. The bound is on variants, which are counted
by a formula before any is spelled out: they are what a task holds in memory.

Fingerprints that meet in a variant are star-linked: if one of them is within one bit of the variant, all others are within
three bits of it, and two that are both two bits away differ by an even number and so meet in another variant if they are two apart.
No link is lost and nothing grows with the square of a group. Every link is verified by the bits that differ.

Defined results: a null, empty or blank text has fingerprint zero, which links like any other. Repeated rows
share a fingerprint. A null id never names a component unless all ids of it are null. Empty tables give empty results.
Only the id and the text are read; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.common import materialise
from assetloom.llm.components import components

BITS, RADIUS, SEED, SHINGLE = 64, 3, 42, 3
#: Variants that a task spells out for one prefix, about; those above which a prefix is dealt again; and by how many bits more.
GROUP_VARIANTS, MOST_VARIANTS, DEEPER = 1 << 18, 1 << 21, 12
_SLICE = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles, each in as many votes as it has occurrences."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and just the six ASCII spaces split
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(_fingerprints, "doc_id long, fp long")


def flips(bits: int, most: int) -> np.ndarray:
    """Masks over ``bits`` low bits with at most ``most`` ones (most <= 2), by number of ones."""
    one = np.left_shift(np.uint64(1), np.arange(bits, dtype=np.uint64))
    i, j = np.triu_indices(bits, 1)
    return np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]][: most + 1])


def _top(fps: np.ndarray, bits: int) -> np.ndarray:
    return fps >> np.uint64(BITS - bits) if bits else np.zeros_like(fps)


def _left(fps: np.ndarray, prefix: np.ndarray, bits: int) -> np.ndarray:
    """Bits that a variant with this prefix may still flip below it: half the radius, rounded up for odd fingerprints."""
    return 1 + (np.bitwise_count(fps) & 1).astype(np.int64) - np.bitwise_count(_top(fps, bits) ^ prefix).astype(np.int64)


def _deal(batches: Iterator[pa.RecordBatch], old: int, new: int) -> Iterator[pa.RecordBatch]:
    """From (prefix of ``old`` bits, fp) to a row for each prefix of ``new`` bits among the variants."""
    step = new - old
    for batch in batches:
        prefix, fps = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
        left, base = _left(fps, prefix, old), prefix << np.uint64(step) if old else np.zeros_like(prefix)
        base |= _top(fps, new) & np.uint64((1 << step) - 1)
        for n in range(3):
            if (at := left == n).any():
                masks = flips(step, n)
                rows = (base[at][:, None] ^ masks[None, :]).ravel().view(np.int64)
                owners = np.repeat(fps[at], len(masks)).view(np.int64)
                for k in range(0, len(rows), 1 << 16):
                    yield pa.record_batch([pa.array(rows[k : k + (1 << 16)]), pa.array(owners[k : k + (1 << 16)])], names=["prefix", "fp"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component of the edges (a, b) over n members."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == was).all():
            return root


def _meet(fps: np.ndarray, prefix: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, another) among those that have a variant with this prefix in common."""
    fps = np.unique(fps)
    low = BITS - bits
    pre = np.uint64(prefix)
    home, far = (pre << np.uint64(low) if low < BITS else np.uint64(0)), np.bitwise_count(_top(fps, bits) ^ pre)
    tail = home | (fps & np.uint64((1 << low) - 1)) if low else np.full_like(fps, home)
    near_v, near_o, wide_v, wide_o = [], [], [], []
    odd = (np.bitwise_count(fps) & 1).astype(bool)
    for d in range(3):  # flips spent in the prefix; the others are below it
        at = np.flatnonzero(far == d)
        for total, values, owners in ((0, near_v, near_o), (1, near_v, near_o), (2, wide_v, wide_o)):
            own = at if total < 2 else at[odd[at]]
            k = total - d
            if k < 0 or not len(own) or (k and not low):
                continue
            masks = flips(low, k)[(0, 1, 1 + low)[k] :]
            values.append((tail[own][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(own, len(masks)))
    none_v, none_o = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    near_v, near_o = (np.concatenate([e, *x]) for e, x in ((none_v, near_v), (none_o, near_o)))
    wide_v, wide_o = (np.concatenate([e, *x]) for e, x in ((none_v, wide_v), (none_o, wide_o)))
    every = np.sort(np.concatenate([near_v, wide_v]))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    empty = np.zeros(0, np.uint64)
    if not len(shared):
        return empty, empty

    def met(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[slot] == values
        return slot[hit], owners[hit]

    near_slot, near_own = met(near_v, near_o)
    wide_slot, wide_own = met(wide_v, wide_o)
    centre = np.full(len(shared), len(fps))
    np.minimum.at(centre, near_slot, near_own)
    slot, own = np.concatenate([near_slot, wide_slot]), np.concatenate([near_own, wide_own])
    mid = centre[slot]
    keep = (mid < len(fps)) & (mid != own)
    own, mid = own[keep], mid[keep]
    true = np.bitwise_count(fps[own] ^ fps[mid]) <= RADIUS
    own, mid = own[true], mid[true]
    root = _roots(len(fps), own, mid)
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _meeting(bits: int):
    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _meet(pdf["fp"].to_numpy().view(np.uint64), int(key[0]) & (2**64 - 1), bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return group


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links within RADIUS."""
    n = fps.count()
    bits = min(BITS, max(1, math.ceil(math.log2(max(1, n * 1073 / GROUP_VARIANTS)))))
    rows, old, parts = fps.select(F.lit(0).cast("long").alias("prefix"), "fp"), 0, None
    while True:
        dealt = materialise(rows.mapInArrow(lambda it, o=old, p=bits: _deal(it, o, p), "prefix long, fp long"), "simhash-dealt")
        hot = materialise(dealt.groupBy("prefix").agg(F.sum(_variants(bits)).alias("n")).filter(F.col("n") > MOST_VARIANTS).select("prefix"), "simhash-hot")
        more = bits < BITS and not hot.isEmpty()
        cold = dealt.join(hot, "prefix", "left_anti") if more else dealt

        found = cold.groupBy("prefix").applyInPandas(_meeting(bits), "a long, b long")
        parts = found if parts is None else parts.union(found)
        if not more:
            return parts
        rows, old, bits = dealt.join(hot, "prefix", "left_semi"), bits, min(BITS, bits + DEEPER)


def _variants(bits: int) -> Column:
    """How many variants with a prefix of so many bits a row (prefix, fp) stands for."""
    low = BITS - bits
    left = 1 + F.bit_count("fp").bitwiseAND(F.lit(1)) - F.bit_count(F.shiftrightunsigned("fp", low).bitwiseXOR(F.col("prefix")))
    return F.when(left <= 0, 1).when(left == 1, 1 + low).otherwise(1 + low + low * (low - 1) // 2).cast("long")


def _classes(own: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of (doc_id, fp)."""
    classes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    linked = materialise(components(links(classes.select("fp"))), "simhash-roots")
    rooted = classes.join(linked, classes.fp == linked.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return materialise(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash-named")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable), component_fp (its class, never null)."""
    own = materialise(fingerprints(docs, id_col, text_col), "simhash-fp")
    named = _classes(own)
    return own.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("root").alias("component_fp")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, one for each component: the one of the least id, then of the least hash of its text."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = next(_fingerprints(iter([batch.select(["doc_id", "text"])])))
            yield pa.record_batch([batch.column(0), found.column(1), batch.column(2)], names=["doc_id", "fp", "h"])

    own = materialise(picked.mapInArrow(run, "doc_id long, fp long, h long"), "simhash-keys")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))).alias("f")
    stay = own.join(_classes(own.select("doc_id", "fp")).select("fp", "root"), "fp").groupBy("root").agg(first)
    stay = stay.select(F.coalesce("f.doc_id", F.lit(0)).alias("_id"), F.col("f.doc_id").isNull().alias("_none"), F.col("f.h").alias("_h")).distinct()
    same = ["_id", "_none", "_h"]  # plain equalities: the window below needs no other exchange than the join
    # Rows travel as one struct, so that no name of theirs can clash.
    marked = docs.select(key.alias("_h"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_id"), F.col(id_col).isNull().alias("_none"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    once = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    return marked.join(stay, same, "left_semi").withColumn("_once", once).filter("_once = 1").select("_row.*")
