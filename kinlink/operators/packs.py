"""Rows that are dealt as compressed files: a shuffle holds a few bytes of a row instead of all of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq


def _packed(rows: pa.Table) -> bytes:
    """A table as a compressed file: equal values of a column are held once, and what is dealt is a fraction of its rows."""
    sink = pa.BufferOutputStream()
    pq.write_table(rows, sink, compression="zstd", write_statistics=False)
    return sink.getvalue().to_pybytes()


def opened(blobs: pa.Array) -> Iterator[pa.Table]:
    for blob in blobs.to_pylist():
        yield pq.read_table(pa.BufferReader(blob), use_threads=False)


def pack(one: str, two: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that makes rows with equal numbers ``one`` and ``two`` into files: (one, two, _blob). It holds about ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by([(one, "ascending"), (two, "ascending")]).combine_chunks()
            key = rows[one].to_numpy().astype(np.int64) << 32 | rows[two].to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            own, out = rows.drop_columns([one, two]), []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out.append((int(key[lo] >> 32), int(key[lo] & 0xFFFFFFFF), _packed(own.slice(lo, hi - lo))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], [one, two, "_blob"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) >= most:
                yield flush()
        if held:
            yield flush()

    return run
