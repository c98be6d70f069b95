"""What decoding holds at once does not follow the length of a run of ids."""

import tracemalloc

import numpy as np

from tessera.llm import bpe


def test_bytes_are_gathered_in_bounded_pieces():
    flat, ends = np.arange(60, dtype=np.uint8), np.array([0, 0, 1, 3, 10, 60])
    ids = np.random.default_rng(1).integers(0, 5, 3 * bpe.DECODED + 7)
    want = b"".join(flat[ends[i] : ends[i + 1]].tobytes() for i in ids)
    tracemalloc.start()
    try:
        got = bpe.decode_bytes(ids, flat, ends)
        many = bpe.decode_bytes(np.full(1_000_000, 3), flat, ends)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.tobytes() == want and len(bpe.decode_bytes(ids[:0], flat, ends)) == 0
    assert len(many) == 7_000_000 and peak < 50_000_000
