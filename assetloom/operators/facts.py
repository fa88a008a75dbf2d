"""Programs to facts: the one place where Python reads code, once for each asset.

An asset of any size is a row; batches are small because bodies are large. A text that is no program gives only its status, and
nothing that a body holds can make a task fail.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions.js.facts import STEPS

SCHEMA = (
    "asset_id string, pos bigint, file_path string, ord bigint, what string, bucket string, label string, detail string, auth string, "
    "line int, col int, path array<string>, to_name string, to_line int, to_col int"
)
DEPTH, ROWS = 20_000, 64
_ARROW = pa.schema(
    [("asset_id", pa.string()), ("pos", pa.int64()), ("file_path", pa.string()), ("ord", pa.int64()), *((n, pa.string()) for n in ("what", "bucket", "label", "detail", "auth"))]
    + [("line", pa.int32()), ("col", pa.int32()), ("path", pa.list_(pa.string())), ("to_name", pa.string()), ("to_line", pa.int32()), ("to_col", pa.int32())]
)


def _clean(value: str | None) -> str | None:
    return value if value is None or value.isascii() else value.encode("utf-8", "replace").decode()


def _extract(steps: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assetloom.functions.js.facts import Fact, extract

        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows: list[tuple] = []
                for asset, pos, path, source in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True):
                    try:
                        found = extract(source, steps)
                    except Exception as fault:  # one asset's fault is a row, not a failed job
                        found = [Fact("status", label="error", detail=type(fault).__name__)]
                    asset, path = _clean(asset), _clean(path)
                    rows += [
                        (asset, pos, path, n, f.what, f.bucket, _clean(f.label), _clean(f.detail), _clean(f.auth), f.line, f.col, f.path, _clean(f.to), f.to_line, f.to_col)
                        for n, f in enumerate(found)
                    ]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


def facts(sources: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """sources: asset_id, pos, file_path, source. Empty and unreadable bodies are left out before any Python.

    Who reads only findings, calls or traces names these steps, and the others aren't taken.
    """
    rows = sources.select("asset_id", F.col("pos").cast("long").alias("pos"), "file_path", "source").filter(F.col("source").isNotNull() & (F.col("source") != ""))
    return rows.mapInArrow(_extract(steps), SCHEMA)
