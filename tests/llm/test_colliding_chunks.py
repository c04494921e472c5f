"""Chunks of one digest within one task."""

from types import SimpleNamespace

import pyarrow as pa

from runledger.llm import chunk_dedup


def test_a_task_sends_both_chunks_of_a_digest(monkeypatch):
    monkeypatch.setattr(chunk_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(chunk_dedup, "xxhash", SimpleNamespace(xxh3_128_digest=lambda chunk: bytes(16)))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([b"one", b"two", b"one"])], names=["doc_id", "t"])
    sent = [c for out in chunk_dedup._recipes(16)([batch]) for c in out.column(5).to_pylist() if c is not None]
    assert sent == [b"one", b"two"]
