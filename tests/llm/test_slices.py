"""Slices of batches: rows and bytes."""

import pyarrow as pa

from casetrail.llm import common


def test_slices_hold_few_bytes():
    texts = [b"x" * n for n in (10, 2_000_000, 0, 600_000, 600_000, 5_000_000)] + [None] * 300 + [b"y"]
    batch = pa.record_batch({"k": pa.array(range(len(texts))), "text": pa.array(texts, pa.binary())})
    parts = list(common.slices_of(batch))
    assert [r for p in parts for r in p.column("k").to_pylist()] == list(range(len(texts)))
    for p in parts:
        size = sum(len(t or b"") for t in p.column("text").to_pylist())
        assert p.num_rows == 1 or (p.num_rows <= common.SLICE and size <= common.SLICE_BYTES)
    assert list(common.slices_of(batch.slice(0, 0))) == []
    sliced = list(common.slices_of(batch.slice(2, 4)))
    assert [r for p in sliced for r in p.column("k").to_pylist()] == [2, 3, 4, 5]
