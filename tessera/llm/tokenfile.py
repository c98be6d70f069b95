"""Token-id output: documents as Simple-8b coded blocks in Parquet files.

A block row holds whole documents: their ids as Simple-8b words, the number of
ids of each document, and where the block starts in its file's run of ids.  A
word is 64 bits: a selector in the top four bits says how many ids of which
width follow.  Selector 15 is an escape: the next word is one raw value, for
values of more than 60 bits.  Each micro-block of ``MICRO`` ids starts a new
word, and the block keeps the words before each micro-block, so that all
micro-blocks decode side by side.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import TOGETHER, UnitEncoder
from tessera.llm.common import partitions, require_long, shared_dir, slices

U64 = np.uint64
#: Ids in a word and their width in bits, by selector; fixed by the coding.
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
ESCAPE = 15
MICRO = 256
#: Ids in a block, but for one document that has more.
BLOCK = 1 << 18
#: Parts up to which their sums, one row each, are broadcast.
BROADCAST_PARTS = 100_000


#: Bits of each number below 2**16, 1 at least.
_BITS = np.maximum(np.frexp(np.arange(1 << 16, dtype=np.float64))[1], 1).astype(np.uint8)


def bit_lengths(v: np.ndarray) -> np.ndarray:
    """Bits of each value, 1 at least."""
    out = _BITS[v & U64(0xFFFF)]
    top = int(v.max(initial=0))
    for k in range(16, top.bit_length(), 16):
        part = (v >> U64(k)) & U64(0xFFFF)
        out = np.where(part > 0, _BITS[part] + np.uint8(k), out)
    return out


def counts_at(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that a word starting at each place takes, and whether it is an escape."""
    n = len(v)
    bits = np.concatenate([bit_lengths(v), np.full(max(COUNTS), 255, np.uint8)])
    room = np.minimum(MICRO - np.arange(n) % MICRO, n - np.arange(n)).astype(np.uint16)
    widest = {1: bits}  # of the next c values, from two shorter stretches that cover them
    take = np.ones(n, np.uint8)
    for c, w in zip(COUNTS[::-1], WIDTHS[::-1], strict=True):
        if c > 1:
            half = max(h for h in widest if h < c and 2 * h >= c)
            widest[c] = np.maximum(widest[half][: half - c], widest[half][c - half :])
        fits = (widest[c][:n] <= w) & (room >= c)
        np.maximum(take, fits.view(np.uint8) * np.uint8(c), out=take)
    return take, bits[:n] > WIDTHS[-1]


def encode_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and the first word of each micro-block."""
    v = values.astype(U64)
    n = len(v)
    if not n:
        return np.empty(0, U64), np.zeros(1, np.int64)
    take, escape = counts_at(v)
    lanes = -(-n // MICRO)
    at = np.arange(lanes) * MICRO
    stop = np.minimum(at + MICRO, n)
    marks = np.zeros(n, bool)
    while len(at):  # all micro-blocks a word further
        marks[at] = True
        at = at + take[at].astype(np.int64)
        at, stop = at[at < stop], stop[at < stop]
    start = np.flatnonzero(marks)
    count, escaped, owner = take[start], escape[start], start // MICRO
    space = 1 + escaped.astype(np.int64)
    place = np.cumsum(space) - space
    words = np.zeros(int(space.sum()), U64)
    for sel, (c, w) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        own = np.flatnonzero((count == c) & ~escaped)
        if len(own):
            packed = v[start[own, None] + np.arange(c)] << (np.arange(c, dtype=U64) * U64(w))
            words[place[own]] = np.bitwise_or.reduce(packed, axis=1) | U64(sel << 60)
    if escaped.any():
        words[place[escaped]] = U64(ESCAPE << 60)
        words[place[escaped] + 1] = v[start[escaped]]
    first = np.r_[place[np.searchsorted(owner, np.arange(lanes))], len(words)]
    return words, first


def decode_block(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    out = np.zeros(n, U64)
    if not n:
        return out
    sel = (words >> U64(60)).astype(np.int64)
    is_raw = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():  # a raw word may look like a selector: walk from each micro-block's first word
        at, stop = first[:-1].copy(), first[1:]
        live = np.flatnonzero(at < stop)
        while len(live):
            hit = sel[at[live]] == ESCAPE
            is_raw[at[live[hit]] + 1] = True
            at[live] += 1 + hit
            live = live[at[live] < stop[live]]
    head = ~is_raw
    count = np.where(head, np.array([*COUNTS, 0, 1])[sel], 0)
    start = np.cumsum(count) - count
    for s, (c, w) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        own = np.flatnonzero(head & (sel == s))
        if len(own):
            shift = np.arange(c, dtype=U64) * U64(w)
            out[start[own, None] + np.arange(c)] = (words[own, None] >> shift) & U64((1 << w) - 1)
    own = np.flatnonzero(head & (sel == ESCAPE))
    out[start[own]] = words[own + 1]
    return out


FILE = "part int, block int, start_in_part long, doc_ids array<long>, counts array<long>, n_ids long, first array<long>, words binary"


_CODERS: dict[str, UnitEncoder] = {}


def tokenizer_coder(path: str) -> UnitEncoder:
    """Encoder of a tokenizers file, kept by the worker.

    The library's defaults hold: a special token's text in a document becomes that
    token.  Texts are split into units only if the file says that this is safe: byte
    level BPE by the pattern of :data:`bpe.UNIT_PATTERN`, no normalizer, no token
    added with spaces or with a reach beyond its own text.  Any other file works on
    whole texts.
    """
    if path in _CODERS:
        return _CODERS[path]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    said = json.loads(tokenizer.to_str())
    added = said["added_tokens"]
    split = (
        said["normalizer"] is None
        and said["model"].get("type") == "BPE"
        and not said["model"].get("dropout")
        and {k: said["pre_tokenizer"].get(k) for k in ("type", "add_prefix_space", "use_regex")} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added)
    )
    leads = np.zeros(1 + max(tokenizer.get_vocab().values()), bool)
    leads[[i for token, i in tokenizer.get_vocab().items() if token[:1] == "\u0120"]] = True

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    _CODERS[path] = UnitEncoder(encode, leads, lambda run: encode([run])[0], tuple(t["content"] for t in added), split)
    return _CODERS[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of every text, ``end_id`` after each, in ascending doc_id order.

    Rows are dealt by ranges of doc_id, so file ``part`` k holds smaller doc_ids
    than k + 1; a null text has only the end id, a null doc_id sorts first, rows
    with one doc_id stand in text order.  Ids that are not whole numbers are refused;
    other columns are not looked at; an empty table gives files without documents.
    Texts are read whole; a long one takes as many blocks' ids as it has.  Returns the folder.
    """
    require_long(docs, id_col)
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    n = partitions(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, done = TaskContext.get().partitionId(), 0, 0
        coder = tokenizer_coder(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, "text", TOGETHER):
                doc_ids = batch.column(0).to_pylist()
                ids, counts = coder.batch(batch.column(1))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                lo = 0
                while lo < len(counts):  # whole documents up to BLOCK ids, one at least
                    before = int(ends[lo - 1]) if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
                    own = ids[before : int(ends[hi - 1])]
                    words, first = encode_block(own)
                    row = [part, block, done, doc_ids[lo:hi], counts[lo:hi].tolist(), len(own), first.tolist(), words.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, ARROW, strict=True)], NAMES)
                    block, done, lo = block + 1, done + len(own), hi

    ordered = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE).write.parquet(out)
    return out


NAMES = ["part", "block", "start_in_part", "doc_ids", "counts", "n_ids", "first", "words"]
ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; ``start`` counts the
    ids of all documents before it.  The sums of files are one row per file."""
    return _reader(spark, path, lambda ids: pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), "ids", "ids array<long>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files."""
    crc = _reader(
        spark, path, lambda ids: pa.array([f"{len(x)} {zlib.crc32(x.astype('<u4').tobytes())}" for x in ids], pa.string()), "said", "said string"
    )
    said = F.split("said", " ")
    return crc.select("doc_id", "start", said[0].cast("long").alias("n_tokens"), said[1].cast("long").alias("ids_crc32"))


def _reader(spark: SparkSession, path: str, column, name: str, ddl: str) -> DataFrame:
    blocks = spark.read.schema(FILE).parquet(path)
    # one row per part: a few numbers, whatever the texts hold
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], U64)
                values = decode_block(words, np.array(row["first"], np.int64), row["n_ids"])
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                starts = row["before"] + row["start_in_part"] + ends - counts
                ids = np.split(values, ends[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts), column(ids)], ["doc_id", "start", name])

    side = F.broadcast(starts) if starts.count() <= BROADCAST_PARTS else starts
    return blocks.join(side, "part").mapInArrow(run, f"doc_id long, start long, {ddl}")
