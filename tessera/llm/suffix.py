"""Suffix-array dedup: remove every byte covered by a long string that occurs again.

Windows of ``LENGTH`` bytes that are equal choose the same anchor: the leftmost of
their smallest 64-byte hashes.  The windows of one anchor occurrence form a piece,
and a piece can only repeat in pieces with the same anchor.

1. Each task finds its pieces and sends (anchor, piece hash) to the anchor's
   partition.  Pieces met twice as a whole, by 96 bits of XXH3-128, repeat; so do all
   their windows.  An anchor with one piece only is done.  An anchor with several different pieces is
   open: one copy of each goes on.
2. The open pieces are gathered by anchor, and a Burrows-Wheeler transform of each
   collection is built column by column: each round inserts one symbol per piece,
   from its last to its first, at the place that the counts of symbols so far give.
   The suffix order it leaves puts equal strings side by side, and the common
   prefix of neighbours decides.  Columns are read and rewritten front to back, in
   memory, as a collection has a bounded number of pieces: whole documents would
   need as many rounds over the whole corpus as the longest one has bytes.
3. The spans found go back to the documents.

A piece that occurs in many places of a task is sent once.  An anchor with very
many different pieces (a long line in many contexts) is split by sub-ranges of its
windows and the bytes that those share, so no task gets all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import (
    PACKED,
    U64,
    Rolling,
    byte_values,
    keyed,
    mix,
    pack,
    packed_batches,
    part_of,
    partitions,
    slices,
    split_by_part,
    stored,
    text_bytes,
    unpack,
    unpack_all,
    with_payloads,
)

LENGTH = 200
GRAM = 64
#: Low bits that hold a position while smallest hashes are searched.
POSITION_BITS = 26
#: Different pieces of an anchor beyond which its windows are split by sub-ranges.
HOT_ANCHOR = 2048
SUB_RANGE = 17
#: Pieces in one collection of the transform, unless an anchor has more.
COLLECTION = 1024
#: Pieces a task holds before it sends them.
HELD = 1 << 21

SPANS, OPEN = 1, 2
#: Most bytes of one text that are looked at together.
SEGMENT = 1 << 22
PIECE = ["u4", "u8", "u4", "i8", "u4", "u1", "u1", "u1"]  # bits of the anchor, 96 bits of the piece, key, start, windows - 1, anchor - start, met twice
SPAN = ["i8", "u4", "u4"]  # key, start, bytes
WANTED = ["i8", "u4", "u1", "u1", "u4", "u1"]  # key, start, windows - 1, anchor - start, bits of the anchor, hot
SENT = ["u8", "i8", "u4", "u4"]  # bucket, key, start, bytes


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w consecutive values."""
    count = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, U64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])


def pieces_of(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor - start, anchor hash, 96 bits of the piece's XXH3-128) of all pieces."""
    n = len(raw)
    counts = np.maximum(np.diff(offsets) - (length - 1), 0)
    total = int(counts.sum())
    if not total:
        e = np.empty(0, np.int64)
        return e, e, e, e, e.astype(U64), e.astype(U64), e.astype(np.uint32)
    roll = Rolling(byte_values(raw))
    at = np.arange(n - gram + 1)
    grams = roll.of(at, at + gram)
    low = U64((1 << POSITION_BITS) - 1)
    least = sliding_min((grams & ~low) | at.astype(U64), length - gram + 1)
    starts = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(total)
    anchor = (least[starts] & low).astype(np.int64)
    first = np.r_[0, np.flatnonzero(np.diff(anchor)) + 1]
    s, a = starts[first], anchor[first]
    windows = np.diff(np.r_[first, total])
    text = np.searchsorted(offsets, s, "right") - 1
    view, digest = memoryview(np.ascontiguousarray(raw)), xxhash.xxh3_128_digest
    told = b"".join([digest(view[lo:hi]) for lo, hi in zip(s.tolist(), (s + windows + (length - 1)).tolist(), strict=True)])
    wide = np.frombuffer(told, U64).reshape(-1, 2)
    return text, s - offsets[text], windows, a - s, grams[a], wide[:, 0], wide[:, 1].astype(np.uint32)


def bwt_order(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a collection in sorted order, by inserting one
    symbol per string each round; ends sort first, in the strings' order."""
    m = len(start)
    symbols, code = np.unique(data, return_inverse=True)
    k = len(symbols)
    code = code.astype(np.int64)
    suffix = start + length  # the empty suffixes
    bwt = np.full(m, k, np.int64)
    place = np.arange(m)  # of each string's longest suffix so far
    live = np.arange(m)
    for step in range(1, int(length.max(initial=0)) + 1):
        live = live[length[live] >= step]
        live = live[np.argsort(place[live], kind="stable")]
        p = place[live]
        new = start[live] + length[live] - step
        c = code[new]
        bwt[p] = c
        # occurrences of each symbol before each place, from counts between places
        gap = np.zeros(len(bwt), np.int64)
        gap[p] = 1
        np.cumsum(gap, out=gap)
        counts = np.bincount(gap * (k + 1) + bwt, minlength=(len(p) + 1) * (k + 1)).reshape(-1, k + 1)
        # an element at a place belongs to the stretch that the place opens
        before = np.cumsum(counts, axis=0)[:-1]
        occurrence = before[np.arange(len(p)), c]
        totals = counts.sum(axis=0)[:k]
        rank = m + (np.cumsum(totals) - totals)[c] + occurrence
        size = len(bwt) + len(p)
        old = np.ones(size, bool)
        old[rank] = False
        grown, column = np.empty(size, np.int64), np.full(size, k, np.int64)
        grown[old], grown[rank] = suffix, new
        column[old] = bwt
        suffix, bwt = grown, column
        # later insertions move nothing that is already counted: ranks are in the new list
        place[live] = rank
        # strings that have ended keep their suffixes but no longer extend
    return suffix


def repeated_windows(data: np.ndarray, start: np.ndarray, length: np.ndarray, window: int = LENGTH) -> np.ndarray:
    """Flags at positions of ``data`` where a window starts that starts elsewhere too."""
    long = bwt_order(data, start, length)[len(start) :]  # the empty suffixes come first
    end = np.repeat(start + length, length)
    long = long[end[long] - long >= window]
    roll = Rolling(byte_values(data))
    h = roll.of(long, long + window)
    same = h[1:] == h[:-1]
    pairs = np.flatnonzero(same)
    for at in range(0, len(pairs), 4096):  # common prefixes, byte by byte
        p = pairs[at : at + 4096]
        cols = np.arange(window)
        same[p] = (data[long[p, None] + cols] == data[long[p + 1, None] + cols]).all(axis=1)
    flags = np.zeros(len(data), bool)
    flags[long[1:][same]] = True
    flags[long[:-1][same]] = True
    return flags


def runs(flag: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of runs of set flags that do not cross the given breaks."""
    edge = np.diff(np.r_[0, flag.view(np.int8), 0])
    cut = np.zeros(len(flag) + 1, bool)
    cut[breaks] = True
    inside = np.flatnonzero(cut[1:-1] & flag[1:] & flag[:-1]) + 1 if len(flag) > 1 else np.empty(0, np.int64)
    s = np.sort(np.r_[np.flatnonzero(edge == 1), inside])
    e = np.sort(np.r_[np.flatnonzero(edge == -1), inside])
    return s, e - s


def _survey(n: int):
    """Documents to (anchor, piece) rows for the anchors' partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId() % n

        def send(held: list[list[np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.lexsort((columns[2], columns[1], columns[0]))
            anchor, piece, more, key, start, windows, ahead = (c[order] for c in columns)
            same = np.r_[False, (anchor[1:] == anchor[:-1]) & (piece[1:] == piece[:-1]) & (more[1:] == more[:-1])]
            twice = same | np.r_[same[1:], False]
            first = ~same
            if twice.any():
                by = np.flatnonzero(twice)[np.lexsort((start[twice], key[twice]))]
                yield here, SPANS, pack([key[by], start[by], windows[by].astype(np.uint32) + np.uint32(LENGTH)])
            by = np.flatnonzero(first)[np.lexsort((start[first], key[first]))]  # runs of one key pack well
            anchor, piece, more, key, start, windows, ahead, twice = (c[by] for c in (anchor, piece, more, key, start, windows, ahead, twice))
            # 32 bits of the anchor beside its partition: a chance match is compared like any other
            columns = [anchor.astype(np.uint32), piece, more, key, start, windows, ahead, twice.astype(np.uint8)]
            for part, blob in split_by_part(part_of(mix(anchor), n), columns):
                yield part, 0, blob

        def rows() -> Iterator[tuple[int, int, bytes]]:
            held, size = [], 0
            for whole in batches:
                for batch in slices(whole, "text"):
                    key = batch.column(0).to_numpy()
                    raw, offsets = text_bytes(batch.column(1))
                    for lo, hi, base in segments(offsets):
                        text, s, w, a, ah, ph, more = pieces_of(raw[lo:hi], np.clip(offsets, lo, hi) - lo)
                        if len(s):
                            held.append([ah, ph, more, key[text], (s + base).astype(np.uint32), (w - 1).astype(np.uint8), a.astype(np.uint8)])
                            size += len(s)
                    if size >= HELD:
                        yield from send(held)
                        held, size = [], 0
            if held:
                yield from send(held)

        yield from packed_batches(rows())

    return run


def segments(offsets: np.ndarray, most: int = SEGMENT) -> Iterator[tuple[int, int, int]]:
    """Byte ranges of a slice, and what to add to starts: one range, or for a single
    text longer than that, ranges that overlap by a window less one."""
    if offsets[-1] <= most:
        yield 0, int(offsets[-1]), 0
        return
    for lo in range(0, int(offsets[-1]), most):  # only a slice of one text is that long
        yield lo, int(min(lo + most + LENGTH - 1, offsets[-1])), lo


def _judge(n: int):
    """Pieces of an anchor together: spans that repeat, and pieces still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            blobs, direct = [], []
            for batch in batches:
                for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    (direct if kind == SPANS else blobs).append(payload)
            key, start, size = unpack_all(direct, SPAN)
            for part, blob in split_by_part(part_of(key.view(U64), n), [key, start, size]):
                yield part, SPANS, blob
            columns = unpack_all(blobs, PIECE)
            if not len(columns[0]):
                return
            order = np.lexsort((columns[2], columns[1], columns[0]))
            anchor, piece, more, key, start, windows, ahead, twice = (c[order] for c in columns)
            new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
            new_piece = new_anchor | np.r_[True, (piece[1:] != piece[:-1]) | (more[1:] != more[:-1])]
            group = np.cumsum(new_piece) - 1
            whole = (np.bincount(group) > 1) | (np.bincount(group, twice) > 0)
            again = whole[group] & (twice == 0)  # what was met twice in a task is told already
            spans = [c[again] for c in (key, start)] + [windows[again].astype(np.uint32) + np.uint32(LENGTH)]
            for part, blob in split_by_part(part_of(spans[0].view(U64), n), spans):
                yield part, SPANS, blob
            lead = np.flatnonzero(new_piece)  # one of each piece
            owner = np.cumsum(new_anchor[lead]) - 1
            different = np.bincount(owner)[owner]
            lead, different = lead[different > 1], different[different > 1]
            columns = [key[lead], start[lead], windows[lead], ahead[lead], anchor[lead], (different > HOT_ANCHOR).astype(np.uint8)]
            for part, blob in split_by_part(part_of(columns[0].view(U64), n), columns):
                yield part, OPEN, blob

        yield from packed_batches(rows())

    return run


def _fetch(n: int):
    """Open pieces' bytes from their documents, to the partitions of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            blobs: list[bytes] = []
            wanted = None
            for batch in batches:
                kinds = batch.column(1).to_numpy()
                blobs += batch.column(2).filter(pa.array(kinds != 1)).to_pylist()
                docs = batch.filter(pa.array(kinds == 1))
                if not docs.num_rows:
                    continue
                if wanted is None:
                    wanted = unpack_all(blobs, WANTED)
                    order = np.argsort(wanted[0], kind="stable")
                    wanted = [c[order] for c in wanted]
                for part in slices(docs, "text"):
                    yield from take(part, wanted)

        def take(docs: pa.RecordBatch, wanted: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
            raw, offsets = text_bytes(docs.column(5))
            keys = docs.column(3).to_numpy()
            keys, nth = np.unique(keys, return_index=True)  # equal rows once
            lo, hi = np.searchsorted(wanted[0], keys), np.searchsorted(wanted[0], keys, "right")
            each = hi - lo
            pick = np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum())
            base = np.repeat(offsets[nth], each)
            if not len(pick):
                return
            key, start, windows, ahead, anchor, hot = (c[pick] for c in wanted)
            start, windows, ahead = start.astype(np.int64), windows.astype(np.int64) + 1, ahead.astype(np.int64)
            bucket, size = anchor.astype(U64), windows + (LENGTH - 1)
            cold = hot == 0
            parts = [[bucket[cold], key[cold], start[cold], size[cold], base[cold]]]
            if not cold.all():
                roll = Rolling(byte_values(raw))
                at, w, a, b = start[~cold], windows[~cold], ahead[~cold], base[~cold]
                for j in range(-(-256 // SUB_RANGE)):
                    # windows of the piece whose distance to the anchor is in the sub-range
                    far, near = np.minimum(a, SUB_RANGE * j + SUB_RANGE - 1), np.maximum(a - w + 1, SUB_RANGE * j)
                    on = np.flatnonzero(far >= near)
                    if len(on):
                        core = b[on] + at[on] + a[on] - SUB_RANGE * j
                        shared = mix(roll.of(core, core + LENGTH - SUB_RANGE + 1) + anchor[~cold][on] + U64(j))
                        parts.append([shared, key[~cold][on], at[on] + a[on] - far[on], far[on] - near[on] + LENGTH, b[on]])
            bucket, key, start, size, base = (np.concatenate(x) for x in zip(*parts, strict=True))
            target = part_of(mix(bucket), n)
            order = np.argsort(target, kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(target[order])) + 1, len(order)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                own = order[lo:hi]
                s, z = (base + start)[own], size[own]
                data = raw[np.repeat(s - (np.cumsum(z) - z), z) + np.arange(z.sum())]
                yield int(target[own[0]]), OPEN, pack([bucket[own], key[own], start[own].astype(np.uint32), z.astype(np.uint32)]) + data.tobytes()

        yield from packed_batches(rows())

    return run


def _collate(n: int):
    """Collections of open pieces to the spans of their repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            columns, data = [], []
            for batch in batches:
                for payload in batch.column(2).to_pylist():
                    own = unpack(payload, SENT)
                    columns.append(own)
                    data.append(np.frombuffer(payload, np.uint8, int(own[3].sum()), len(payload) - int(own[3].sum())))
            if not columns:
                return
            bucket, key, start, size = (np.concatenate(c) for c in zip(*columns, strict=True))
            raw = np.concatenate(data)
            size = size.astype(np.int64)
            at = np.cumsum(size) - size
            order = np.argsort(bucket, kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
            lo = 0
            while lo < len(edges) - 1:
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + COLLECTION, "right")) - 1)
                own = order[edges[lo] : edges[hi]]
                lo = hi
                z = size[own]
                s = np.cumsum(z) - z
                piece = raw[np.repeat(at[own] - s, z) + np.arange(z.sum())]
                first, many = runs(repeated_windows(piece, s, z), s)
                owner = np.searchsorted(s, first, "right") - 1
                spans = [key[own][owner], (start[own][owner] + (first - s[owner])).astype(np.uint32), (many + LENGTH - 1).astype(np.uint32)]
                for part, blob in split_by_part(part_of(spans[0].view(U64), n), spans):
                    yield part, SPANS, blob

        yield from packed_batches(rows())

    return run


def covered(length: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    edge = np.bincount(start, minlength=length + 1) - np.bincount(start + size, minlength=length + 1)
    return np.cumsum(edge[:length]) > 0


def _cut(out_names: list[str], finish):
    """Documents with their spans; ``finish(batch, list of (text bytes, removed))``
    gives the output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        spans = None
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            blobs += batch.column(2).filter(pa.array(kinds == 0)).to_pylist()
            docs = batch.filter(pa.array(kinds != 0))
            if not docs.num_rows:
                continue
            if spans is None:
                spans = unpack_all(blobs, SPAN)
                order = np.argsort(spans[0], kind="stable")
                spans = [c[order] for c in spans]
                blobs.clear()
            for part in slices(docs, "text"):
                raw, offsets = text_bytes(part.column(5))
                key = part.column(3).to_numpy()
                lo, hi = np.searchsorted(spans[0], key), np.searchsorted(spans[0], key, "right")
                texts = []
                for d in range(len(key)):
                    own = slice(lo[d], hi[d])
                    text = raw[offsets[d] : offsets[d + 1]]
                    texts.append((text, covered(len(text), spans[1][own].astype(np.int64), spans[2][own].astype(np.int64)) if hi[d] > lo[d] else None))
                yield pa.RecordBatch.from_arrays(finish(part, texts), out_names)

    return run


def _spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, DataFrame]:
    n = partitions(docs)
    rows = keyed(docs, n, id_col, text_col)
    judged = stored(rows.select("key", "text").mapInArrow(_survey(n), PACKED).repartitionById(n, F.col("part")).mapInArrow(_judge(n), PACKED), "pieces")
    wanted = judged.where(F.col("kind") == OPEN).withColumn("kind", F.lit(0))
    open_spans = with_payloads(rows, wanted, n).mapInArrow(_fetch(n), PACKED).repartitionById(n, F.col("part")).mapInArrow(_collate(n), PACKED)
    return rows, n, judged.where(F.col("kind") == SPANS).unionByName(open_spans).withColumn("kind", F.lit(0))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row.

    Null texts are empty.  Repeated rows are documents of their own, so a text of
    200 bytes or more that stands in two rows is removed from both.  Ids may have any
    type and be null or repeated; other columns are not looked at.  An empty table
    gives an empty table.
    """
    rows, n, spans = _spans(docs, id_col, text_col)

    def finish(part: pa.RecordBatch, texts) -> list[pa.Array]:
        size = [len(t) for t, _ in texts]
        removed = [0 if r is None else int(r.sum()) for _, r in texts]
        found = [0 if r is None else int(np.count_nonzero(np.diff(np.r_[0, r.view(np.int8)]) == 1)) for _, r in texts]
        sha = [hashlib.sha256(np.ascontiguousarray(t if r is None else t[~r])).hexdigest() for t, r in texts]
        return [part.column(4), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(found, pa.int64()), pa.array(sha, pa.string())]

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return with_payloads(rows, spans, n).mapInArrow(_cut(names, finish), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut from its texts; a null text stays null, a
    character of which a byte is cut goes whole.  Other columns stay as they are,
    whatever their names; ids may have any type and be null or repeated."""
    others = [c for c in docs.columns if c != text_col]
    rows, n, spans = _spans(docs, id_col, text_col)
    own = docs.select(  # names of our own only, whatever the columns are called
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{text_col}`").isNull().alias("null"),
        F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("row"),
    )
    wide = keyed(own, n, also=["null", "row"])

    def finish(part: pa.RecordBatch, texts) -> list[pa.Array]:
        null = part.column(6).to_pylist()
        kept = [None if z else bytes(t if r is None else t[~r]).decode("utf-8", "ignore") for (t, r), z in zip(texts, null, strict=True)]
        return [part.column(7), pa.array(kept, pa.string())]

    cut = with_payloads(wide, spans, n).mapInArrow(_cut(["row", "text"], finish), own.select("row", "text").schema)
    place = {c: F.col(f"row.c{k}").alias(c) for k, c in enumerate(others)}
    return cut.select(*[place.get(c, F.col("text").alias(c)) for c in docs.columns])
