"""Batches as bytes and in slices, and names that can't clash."""

import pyarrow as pa

from scenewright.llm import common


def test_slices_hold_all_rows_in_order():
    texts = ["é" * n for n in range(200)] + [None, "", "x" * 10_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    for size in (1, 500, 1 << 22):
        parts = list(common.small(iter([batch, batch.slice(0, 0)]), size))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
        assert [b for p in parts for b in common.as_bytes(p.column(1))] == [(t or "").encode() for t in texts]
    assert common.as_bytes(batch.slice(5, 3).column(1)) == [t.encode() for t in texts[5:8]]
    assert common.as_bytes(pa.array([], pa.string())) == [] and common.as_bytes(pa.array([None, None], pa.string())) == [b"", b""]


class _Columns:
    columns = ["line_gone", "LINE_DOC", "text"]


def test_fresh_names():
    assert common.fresh(_Columns(), "line_gone", "line_doc", "other") == ["line_gone_", "line_doc_", "other"]
