"""Minimum-cost-flow resharding: from the sizes of old shards and the capacities of new ones to the transfers that move the fewest bytes.

The sizes of the old shards come to the driver, a row for each. There a flow from
old shards (their bytes) to new shards (equal capacities) is solved by successive shortest paths; a byte costs nothing where its old
shard lives on as the new one, else one. Old shards that don't live on cost the same everywhere: they are one source, whose flow is then split among them.

The flow decides where rows go. An old shard that goes to one new shard is placed whole. One that is split has its rows dealt to blocks of about BLOCK_ROWS by a hash, and its
flow is laid along the blocks: a block inside one transfer goes with it, and only the blocks on a cut (fewer than there are cuts) are looked at row by row. There rows are put, by falling size, where
the block's own transfers have most room left. Rows that fit nowhere are fewer than the transfers that meet in the block and are its smallest ones; they alone are placed last, where most room is left over all shards.
Bytes moved are thus those of the flow but for these rows. Slots are ranks within a block plus the block's offset in its shard, so no task sees a whole shard.

Defined results: a null text has zero bytes (a row then counts its fixed 8) and the checksum of the empty text. Repeated rows are
placed as often as they occur. A null old shard is the shard of the empty name. Null ids are placed like any other. Other columns are ignored, or carried with ``carry``. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.common import checked, materialise

#: Rows of a block, about.
BLOCK_ROWS = 1 << 16
ROW_BYTES = 8


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes from each source to each sink at the least total cost; cost(i, j) >= 0 is for a byte. Total supply fits the capacities.

    Successive shortest paths with potentials on the bipartite residual graph.
    """
    n, m = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    into: list[dict[int, None]] = [{} for _ in range(m)]
    high_i, high_j = [0] * n, [0] * m
    for start in sorted(range(n), key=lambda i: -supply[i]):
        while left[start]:
            far_i, far_j, from_j, from_i = {start: 0}, {}, {}, {}
            heap, done, end = [(0, 0, start)], set(), None
            while heap:
                d, side, at = heapq.heappop(heap)
                if (side, at) in done:
                    continue
                done.add((side, at))
                if side == 0:
                    for j in range(m):
                        step = d + cost(at, j) + high_i[at] - high_j[j]
                        if step < far_j.get(j, 1 << 60):
                            far_j[j], from_j[j] = step, at
                            heapq.heappush(heap, (step, 1, j))
                else:
                    if room[at]:
                        end = at
                        break
                    for i in into[at]:
                        step = d - cost(i, at) + high_j[at] - high_i[i]
                        if step < far_i.get(i, 1 << 60):
                            far_i[i], from_i[i] = step, at
                            heapq.heappush(heap, (step, 0, i))
            reached = far_j[end]
            for i in range(n):
                high_i[i] += min(far_i.get(i, reached), reached)
            for j in range(m):
                high_j[j] += min(far_j.get(j, reached), reached)
            path, j, most = [], end, min(left[start], room[end])
            while True:
                i = from_j[j]
                path.append((i, j, 1))
                if i == start:
                    break
                j = from_i[i]
                path.append((i, j, -1))
                most = min(most, flow[i, j])
            for i, j, sign in path:
                flow[i, j] = flow.get((i, j), 0) + sign * most
                if flow[i, j]:
                    into[j][i] = None
                else:
                    into[j].pop(i, None)
            left[start] -= most
            room[end] -= most
    return {k: v for k, v in flow.items() if v}


def homes(sizes: list[int], shards: int) -> dict[int, int]:
    """Which old shard lives on as which new one: its own number where there is one, else the largest take what is left."""
    home = {i: i for i in range(min(len(sizes), shards))}
    if len(sizes) > shards:
        home = {i: j for j, i in enumerate(sorted(sorted(range(len(sizes)), key=lambda i: -sizes[i])[:shards]))}
    return home


def transfers(sizes: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """The cheapest flow from old to new shards, where only `homes` live on; any number of old shards."""
    home = homes(sizes, len(capacity))
    kept = sorted(home)
    rest = [i for i in range(len(sizes)) if i not in home]
    found = min_cost_flow([sizes[i] for i in kept] + [sum(sizes[i] for i in rest)], capacity, lambda a, j: int(a == len(kept) or home[kept[a]] != j))
    flow = {(kept[a], j): n for (a, j), n in found.items() if a < len(kept)}
    room = [[j, n] for (a, j), n in sorted(found.items()) if a == len(kept)]
    for i in rest:
        left = sizes[i]
        while left:
            n = min(left, room[0][1])
            flow[i, room[0][0]] = n
            left -= n
            room[0][1] -= n
            if not room[0][1]:
                room.pop(0)
    return flow


def fill(sizes: np.ndarray, pieces: list[tuple[int, int]]) -> np.ndarray:
    """The new shard of each row of a block, or -1: rows by falling size, each to the piece (new shard, room) with the most room if it fits there."""
    heap = [(-room, shard) for shard, room in pieces]
    heapq.heapify(heap)
    out = np.full(len(sizes), -1, np.int32)
    for n in np.argsort(-sizes, kind="stable").tolist():
        room, shard = heap[0]
        if sizes[n] <= -room:
            out[n] = shard
            heapq.heapreplace(heap, (room + int(sizes[n]), shard))
    return out


def along(flows: list[tuple[int, int]], blocks: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """For each block (number, bytes) of an old shard, in this order, the pieces (new shard, bytes) of the flow that are laid on it."""
    out, left = {}, [list(f) for f in reversed(flows)]
    for block, size in blocks:
        own = out[block] = []
        while size:
            n = min(size, left[-1][1])
            own.append((left[-1][0], n))
            size -= n
            left[-1][1] -= n
            if not left[-1][1]:
                left.pop()
    return out


def reshard(docs: DataFrame, shards: int, old: Column, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, old_shard, shard, slot (and ``row``, the whole input row, with ``carry``). old: the name of a row's old shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    extra = ["row"] if carry else []
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(old.cast("string"), F.lit("")).alias("_name"),
        F.monotonically_increasing_id().alias("_n"),
        *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []),
    )
    base = materialise(base, "reshard-rows")  # with the numbers of rows, so that every later job deals them alike

    olds = sorted(map(tuple, base.groupBy("_name").agg(F.sum("size"), F.count(F.lit(1))).collect()))  # a row for each old shard
    sizes = [size for _, size, _ in olds]
    capacity = [sum(sizes) // shards + (j < sum(sizes) % shards) for j in range(shards)]
    flows: dict[int, list[tuple[int, int]]] = {}
    for (i, j), n in sorted(transfers(sizes, capacity).items()):
        flows.setdefault(i, []).append((j, n))
    whole = [(name, i, -(-rows // BLOCK_ROWS), flows[i][0][0] if len(flows[i]) == 1 else None) for i, (name, _, rows) in enumerate(olds)]
    numbered = spark.createDataFrame(whole, "_name string, old_shard int, _blocks int, _whole int")
    base = base.join(checked(numbered, len(whole)), "_name").withColumn("_block", F.pmod(F.xxhash64("_n", "doc_id", "text_crc32"), F.col("_blocks")).cast("int"))

    # Only old shards that are split, fewer than new ones and cuts, tell the sizes of their blocks.
    sums: dict[int, list[tuple[int, int]]] = {}
    for i, b, size in sorted(map(tuple, base.filter("_whole IS NULL").groupBy("old_shard", "_block").agg(F.sum("size")).collect())):
        sums.setdefault(i, []).append((b, size))
    laid = {(i, b): pieces for i, blocks in sums.items() for b, pieces in along(flows[i], blocks).items()}
    split = {k: p for k, p in laid.items() if len(p) > 1}
    inside = spark.createDataFrame([(i, b, p[0][0] if len(p) == 1 else None) for (i, b), p in laid.items()], "old_shard int, _block int, _inside int")
    placed = base.join(checked(inside, len(laid)), ["old_shard", "_block"], "left").withColumn("shard", F.coalesce("_whole", "_inside"))
    placed = placed.select("doc_id", "size", "text_crc32", "old_shard", "_block", "_n", "shard", *extra)
    if split:

        def cut(rows: pa.Table) -> pa.Table:
            found = pa.array(fill(rows["size"].to_numpy(), split[rows["old_shard"][0].as_py(), rows["_block"][0].as_py()]))
            return rows.set_column(rows.column_names.index("shard"), "shard", pc.if_else(pc.less(found, 0), None, found))

        placed = placed.filter("shard IS NOT NULL").unionByName(placed.filter("shard IS NULL").groupBy("old_shard", "_block").applyInArrow(cut, placed.schema))
    placed = materialise(placed, "reshard-placed")

    loose = placed.filter("shard IS NULL").select("_n", "size").collect()  # fewer than pieces on cuts
    filled = {r[0]: r[1] for r in placed.filter("shard IS NOT NULL").groupBy("shard").agg(F.sum("size")).collect()}
    heap = [(filled.get(j, 0) - capacity[j], j) for j in range(shards)]
    heapq.heapify(heap)
    late = []
    for n, size in sorted(map(tuple, loose), key=lambda r: (-r[1], r[0])):
        over, j = heap[0]
        late.append((n, j))
        heapq.heapreplace(heap, (over + size, j))
    if late:
        late = spark.createDataFrame(late, "_n long, _late int")
        placed = placed.join(F.broadcast(late), "_n", "left").withColumn("shard", F.coalesce("shard", "_late")).drop("_late")

    tally = placed.groupBy("shard", "old_shard", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("old_shard", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select("shard", "old_shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("old_shard", "_block", "shard").orderBy("_n")) - 1
    slots = placed.withColumn("_rank", rank).join(checked(offsets, sum(w[2] for w in whole) + 2 * sum(map(len, split.values()))), ["shard", "old_shard", "_block"])
    return slots.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("_offset") + F.col("_rank")).alias("slot"), *extra)


def rewrite(placed: DataFrame, path: str) -> list[int]:
    """Writes the shards that changed, of a ``reshard(..., carry=True)``, as ``new_shard=<n>`` folders under ``path``; returns their numbers.

    A shard is unchanged if one old shard gave all its rows and kept none back.
    """
    placed = materialise(placed, "reshard-out")
    tally = placed.groupBy("shard", "old_shard").count().collect()
    sources: dict[int, set] = {}
    targets: dict[int, set] = {}
    for j, i, _ in tally:
        sources.setdefault(j, set()).add(i)
        targets.setdefault(i, set()).add(j)
    changed = sorted(j for j, own in sources.items() if len(own) > 1 or len(targets[next(iter(own))]) > 1)
    own = [F.col("row").getField(f.name).alias(f.name) for f in placed.schema["row"].dataType if f.name not in ("new_shard", "new_slot")]
    rows = placed.filter(F.col("shard").isin(changed)).select(*own, F.col("shard").alias("new_shard"), F.col("slot").alias("new_slot"))
    rows.repartition("new_shard", F.floor(F.col("new_slot") / 100_000)).sortWithinPartitions("new_shard", "new_slot").write.mode("overwrite").partitionBy("new_shard").parquet(path)
    return changed
