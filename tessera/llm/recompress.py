"""Substring dedup by recompression of word sequences.

Level 0 names runs of one word; each later level names pairs (a, b) where a falls
on the left and b on the right by a bit of their names, so pairs never overlap and
whether two symbols join depends on the two alone.  A name is a hash of what it
stands for, so equal strings get equal names in all documents without a table: a
table of names would take a round of joins for each level, over nearly all pairs.

Each symbol carries its *extent*: the words that must be seen to know that it is
formed.  A symbol whose extent lies inside a window is formed in the same way
wherever that window stands.  A window's name is the first such symbol of the
highest level that has one, with the words of its extent; windows inside one run,
which have none, are named by their words.

1. Names of windows go to the name's partition: those in two documents are shared.
2. Windows with a shared name are verified by 96 bits of two chained hashes of the
   XXH3-128 of each of their words; the smallest doc_id keeps, the others lose the
   window's words.
3. What is lost goes back to the documents.

Tasks send one row for a name or window that many of their documents have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import (
    PACKED,
    U64,
    Rolling,
    keyed,
    mix,
    pack,
    packed_batches,
    part_of,
    partitions,
    require_long,
    slices,
    split_by_part,
    stored,
    text_bytes,
    unpack_all,
    with_payloads,
    word_hashes,
    word_spans,
)
from tessera.llm.suffix import covered

WINDOW = 13
LEVELS = 5
#: Names or windows a task holds before it sends them.
HELD = 1 << 22

_A, _B = U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
FAR = np.iinfo(np.int64).max // 4
LAST_ID = np.iinfo(np.int64).max  # of a null doc_id: no document is after it

NAME = ["u4", "i8", "u1"]  # bits of the name, key, known to be shared
SHARED = ["i8", "u4"]  # key, bits of (key, name)
SEEN = ["u8", "u4", "i8", "i8", "u4"]  # 96 bits of the window, doc_id, key, first word
LOST = ["i8", "u4", "u4"]  # key, first word, windows


def levels(word: np.ndarray, text: np.ndarray, top: int = LEVELS) -> list[tuple[np.ndarray, ...]]:
    """(name, first extent word, end of extent) of the symbols of each level, from 0.

    ``word`` holds word hashes, ``text`` the text of each.  Extents that would pass
    the end of a text are put out of reach."""
    n = len(word)
    if not n:
        return []
    new = np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, n])
    name = mix(word[first] + _A * count.astype(U64))
    owner = text[first]
    lo, hi = first - 1, first + count + 1  # both neighbours tell where a run ends
    out = [(name, lo, hi)]
    for level in range(1, top + 1):
        m = len(name)
        left = (mix(name ^ (_B * U64(level))) & U64(1)).astype(bool)
        joined = np.zeros(m, bool)  # with the next
        joined[:-1] = left[:-1] & ~left[1:] & (owner[:-1] == owner[1:])
        second = np.r_[False, joined[:-1]]
        has_next = np.r_[owner[1:] == owner[:-1], False]
        has_last = np.r_[False, owner[1:] == owner[:-1]]
        next_hi = np.where(has_next, np.r_[hi[1:], 0], FAR)
        last_lo = np.where(has_last, np.r_[0, lo[:-1]], -FAR)
        # a left symbol that stays must see the next, a right one the last
        new_lo = np.where(left, lo, last_lo)
        new_hi = np.where(left, next_hi, hi)
        new_lo = np.where(joined, lo, new_lo)
        pair = np.r_[mix(name[:-1] * _A + mix(name[1:] + U64(level))), U64(0)]
        keep = ~second
        name, lo, hi, owner = np.where(joined, pair, name)[keep], new_lo[keep], new_hi[keep], owner[keep]
        out.append((name, np.maximum.accumulate(lo), hi))
    return out


def window_names(word: np.ndarray, text: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Name of the window at each start."""
    roll = Rolling(word)
    out = np.zeros(len(starts), U64)
    todo = np.arange(len(starts))
    for level, (name, lo, hi) in reversed(list(enumerate(levels(word, text)))):
        if not len(todo):
            break
        s = starts[todo]
        at = np.searchsorted(lo, s)
        inside = at < len(lo)
        at = np.minimum(at, len(lo) - 1)
        inside &= hi[at] <= s + window
        done = todo[inside]
        sym = at[inside]
        out[done] = mix(name[sym] * _A + roll.of(lo[sym], hi[sym]) + U64(level))
        todo = todo[~inside]
    if len(todo):
        out[todo] = mix(roll.of(starts[todo], starts[todo] + window) + _B)
    return out


def words_of(raw: np.ndarray, offsets: np.ndarray):
    """Both hashes of the words, text of each word, words before each text, window starts."""
    starts, ends, before = word_spans(raw, offsets)
    word, more = word_hashes(raw, starts, ends)
    counts = np.diff(before)
    text = np.repeat(np.arange(len(counts)), counts)
    windows = np.maximum(counts - WINDOW + 1, 0)
    at = np.repeat(before[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    return word, more, text, before, at


def window_hashes(word: np.ndarray, more: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each window: its words one after another, through two hashes."""
    a, b = np.zeros(len(at), U64), np.full(len(at), _B)
    for k in range(WINDOW):
        a, b = mix(a * _A + word[at + k]), mix(b * _B ^ more[at + k])
    return a, b.astype(np.uint32)


def tag(key: np.ndarray, name: np.ndarray) -> np.ndarray:
    return (mix(key.view(U64) * _A + name.astype(U64)) >> U64(32)).astype(np.uint32)


def _name(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId() % n

        def send(held: list[list[np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
            name, key = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((key, name))
            name, key = name[order], key[order]
            new = np.r_[True, (name[1:] != name[:-1]) | (key[1:] != key[:-1])]
            name, key = name[new], key[new]
            same = np.r_[False, name[1:] == name[:-1]]
            shared = same | np.r_[same[1:], False]
            if shared.any():
                yield here, 1, pack(_by_key([key[shared], tag(key[shared], name[shared].astype(np.uint32))]))
            first = np.flatnonzero(~same)
            first = first[np.argsort(key[first], kind="stable")]  # runs of one key pack well
            # 32 bits of the name beside its partition: a chance match costs a check, no result
            for part, blob in split_by_part(part_of(mix(name[first]), n), [name[first].astype(np.uint32), key[first], shared[first].astype(np.uint8)]):
                yield part, 0, blob

        def rows() -> Iterator[tuple[int, int, bytes]]:
            held, size = [], 0
            for whole in batches:
                for batch in slices(whole, "text"):
                    key = batch.column(0).to_numpy()
                    word, _, text, _, at = words_of(*text_bytes(batch.column(1)))
                    if not len(at):
                        continue
                    name, owner = window_names(word, text, at), text[at]
                    new = np.r_[True, (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])]
                    held.append([name[new], key[owner[new]]])
                    size += int(new.sum())
                    if size >= HELD:
                        yield from send(held)
                        held, size = [], 0
            if held:
                yield from send(held)

        yield from packed_batches(rows())

    return run


def _forward(blobs: list[bytes], types: list[str], kind: int, n: int) -> Iterator[tuple[int, int, bytes]]:
    """What a task knew already, on to its documents' partitions."""
    columns = unpack_all(blobs, types)
    for part, blob in split_by_part(part_of(columns[0].view(U64), n), columns):
        yield part, kind, blob


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list[bytes], list[bytes]]:
    entries, direct = [], []
    for batch in batches:
        for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            (direct if kind else entries).append(payload)
    return entries, direct


def _share(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            entries, direct = _gathered(batches)
            yield from _forward(direct, SHARED, 0, n)
            name, key, known = unpack_all(entries, NAME)
            if not len(name):
                return
            order = np.lexsort((key, name))
            name, key, known = name[order], key[order], known[order]
            new = np.r_[True, name[1:] != name[:-1]]
            group = np.cumsum(new) - 1
            # equal rows in several tasks are one document here: only other keys share
            other = np.r_[False, (name[1:] == name[:-1]) & (key[1:] != key[:-1])]
            shared = (np.bincount(group, known) + np.bincount(group, other) > 0)[group] & (known == 0)
            key, bits = key[shared], tag(key[shared], name[shared])
            for part, blob in split_by_part(part_of(key.view(U64), n), [key, bits]):
                yield part, 0, blob

        yield from packed_batches(rows())

    return run


def _documents(batches: Iterator[pa.RecordBatch], types: list[str]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the documents of a partition, with the packed rows sorted by key."""
    blobs: list[bytes] = []
    side = None
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        blobs += batch.column(2).filter(pa.array(kinds == 0)).to_pylist()
        docs = batch.filter(pa.array(kinds != 0))
        if not docs.num_rows:
            continue
        if side is None:
            side = unpack_all(blobs, types)
            order = np.argsort(side[0], kind="stable")
            side = [c[order] for c in side]
            blobs.clear()
        for part in slices(docs, "text"):
            yield part, side


def _verify(n: int):
    """Windows with shared names to the partitions of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId() % n

        def send(held: list[list[np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.lexsort((columns[2], columns[1], columns[0]))
            window, more, doc, key, first = (c[order] for c in columns)
            new = np.r_[True, (window[1:] != window[:-1]) | (more[1:] != more[:-1])]
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            lost = doc > least
            if lost.any():
                yield here, 1, pack(_runs(key[lost], first[lost]))
            key, window, more, doc, first = _by_key([c[~lost] for c in (key, window, more, doc, first)])
            for part, blob in split_by_part(part_of(mix(window), n), [window, more, doc, key, first]):
                yield part, 0, blob

        def rows() -> Iterator[tuple[int, int, bytes]]:
            held, size, bits = [], 0, None
            for batch, side in _documents(batches, SHARED):
                if bits is None:
                    bits = np.unique(side[1])
                key = batch.column(3).to_numpy()
                doc = batch.column(4).fill_null(LAST_ID).to_numpy()
                word, more, text, before, at = words_of(*text_bytes(batch.column(5)))
                if not len(at) or not len(bits):
                    continue
                owner = text[at]
                marked = tag(key[owner], window_names(word, text, at).astype(np.uint32))
                place = np.minimum(np.searchsorted(bits, marked), len(bits) - 1)
                shared = bits[place] == marked
                at, owner = at[shared], owner[shared]
                held.append([*window_hashes(word, more, at), doc[owner], key[owner], (at - before[owner]).astype(np.uint32)])
                size += len(at)
                if size >= HELD:
                    yield from send(held)
                    held, size = [], 0
            if held:
                yield from send(held)

        yield from packed_batches(rows())

    return run


def _by_key(columns: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _runs(key: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """(key, first, windows) of runs of consecutive windows."""
    order = np.lexsort((first, key))
    key, first = key[order], first[order].astype(np.int64)
    if not len(key):
        return [key, first.astype(np.uint32), first.astype(np.uint32)]
    new = np.r_[True, (key[1:] != key[:-1]) | (first[1:] > first[:-1] + 1)]
    lead = np.flatnonzero(new)
    last = np.r_[lead[1:], len(key)] - 1
    return [key[lead], first[lead].astype(np.uint32), (first[last] - first[lead] + 1).astype(np.uint32)]


def _least(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            entries, direct = _gathered(batches)
            yield from _forward(direct, LOST, 0, n)
            columns = unpack_all(entries, SEEN)
            if not len(columns[0]):
                return
            order = np.lexsort((columns[2], columns[1], columns[0]))
            window, more, doc, key, first = (c[order] for c in columns)
            new = np.r_[True, (window[1:] != window[:-1]) | (more[1:] != more[:-1])]
            lost = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            columns = _runs(key[lost], first[lost])
            for part, blob in split_by_part(part_of(columns[0].view(U64), n), columns):
                yield part, 0, blob

        yield from packed_batches(rows())

    return run


def _cut(names: list[str], finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (side_key, first, many) in _documents(batches, LOST):
            raw, offsets = text_bytes(batch.column(5))
            starts, ends, before = word_spans(raw, offsets)
            key = batch.column(3).to_numpy()
            lo, hi = np.searchsorted(side_key, key), np.searchsorted(side_key, key, "right")
            texts = []
            for d in range(len(key)):
                s, e = starts[before[d] : before[d + 1]], ends[before[d] : before[d + 1]]
                gone = None
                if hi[d] > lo[d]:
                    gone = covered(len(s), first[lo[d] : hi[d]].astype(np.int64), many[lo[d] : hi[d]].astype(np.int64) + (WINDOW - 1))
                texts.append((s, e, gone))
            yield pa.RecordBatch.from_arrays(finish(batch, raw, texts), names)

    return run


def kept_bytes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, gone: np.ndarray | None) -> bytes:
    """Kept words joined by one space."""
    if gone is not None:
        s, e = s[~gone], e[~gone]
    if not len(s):
        return b""
    z = e - s
    to = np.cumsum(z + 1) - (z + 1)
    out = np.full(int(z.sum() + len(z) - 1), 0x20, np.uint8)
    step = np.repeat(np.cumsum(z) - z, z)
    k = np.arange(z.sum()) - step
    out[np.repeat(to, z) + k] = raw[np.repeat(s, z) + k]
    return out.tobytes()


def _lost(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, DataFrame, DataFrame]:
    require_long(docs, id_col)
    n = partitions(docs)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    own = docs.select(  # names of our own only, whatever the columns are called
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{text_col}`").isNull().alias("null"),
        F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("row"),
    )
    rows = keyed(own, n)
    shared = stored(rows.select("key", "text").mapInArrow(_name(n), PACKED).repartitionById(n, F.col("part")).mapInArrow(_share(n), PACKED), "names")
    lost = with_payloads(rows, shared, n).mapInArrow(_verify(n), PACKED).repartitionById(n, F.col("part")).mapInArrow(_least(n), PACKED)
    return rows, n, lost, own


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row.

    Null texts have no words; rows with one doc_id do not remove from each other;
    a null doc_id comes after all others; a run of one word that is longer than the
    window is named by its words.  Other columns are not looked at.  Ids that are not
    whole numbers are refused.  An empty table gives an empty table.
    """
    rows, n, lost, _ = _lost(docs, id_col, text_col)

    def finish(batch: pa.RecordBatch, raw: np.ndarray, texts) -> list[pa.Array]:
        return [
            batch.column(4),
            pa.array([len(s) for s, _, _ in texts], pa.int64()),
            pa.array([0 if g is None else int(g.sum()) for _, _, g in texts], pa.int64()),
            pa.array([hashlib.sha256(kept_bytes(raw, *t)).hexdigest() for t in texts], pa.string()),
        ]

    return with_payloads(rows, lost, n).mapInArrow(_cut(["doc_id", "n_words", "n_removed", "kept_sha256"], finish), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept words of each text joined by one space; a null text stays
    null.  Other columns stay as they are, whatever their names."""
    _, n, lost, own = _lost(docs, id_col, text_col)
    rows = keyed(own, n, also=["null", "row"])

    def finish(batch: pa.RecordBatch, raw: np.ndarray, texts) -> list[pa.Array]:
        null = batch.column(6).to_pylist()
        return [batch.column(4), batch.column(7), pa.array([None if z else kept_bytes(raw, *t).decode() for t, z in zip(texts, null, strict=True)], pa.string())]

    cut = with_payloads(rows, lost, n).mapInArrow(_cut(["doc_id", "row", "text"], finish), own.select("doc_id", "row", "text").schema)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    place = {c: F.col(f"row.c{k}").alias(c) for k, c in enumerate(others)} | {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), text_col: F.col("text").alias(text_col)}
    return cut.select(*[place[c] for c in docs.columns])
