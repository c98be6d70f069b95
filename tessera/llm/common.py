"""Session, storage and packing helpers shared by the operators here."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none and runs on one machine a temporary folder is
    made and set as the checkpoint folder; a cluster without one is refused, as its
    machines can't read each other's files.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        named = sc.getCheckpointDir()
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if named is None:
        named = tempfile.mkdtemp(prefix="tessera-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_WRITTEN: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later stages start
    from files, whatever executors are lost meanwhile."""
    return _kept(df, name)[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`stored`, but never deleted with the :func:`scratch` around it."""
    out, path = _kept(df, name)
    for paths in _WRITTEN:
        if path in paths:
            paths.remove(path)
    return out


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What :func:`stored` writes inside is deleted at the end: for results that
    have been written elsewhere by then."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def require_long(df: DataFrame, column: str) -> None:
    """Refuse ids that are not whole numbers, before any work is done."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"column {column} must hold whole numbers, not {kind}")


def plain(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: Arrow functions can't take names with dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def partitions(df: DataFrame) -> int:
    """Partitions for an exchange of ``df``: the session's number, or as many as
    its scan has, so that the count follows the input."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


# -- packed rows -----------------------------------------------------------------
# Millions of small keys travel as a few large binary rows: each task groups its
# keys by target partition and sends one row of packed columns to each target.


def pack(columns: list[np.ndarray]) -> bytes:
    return b"".join([np.int64(len(columns[0])).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])


def unpack(blob: bytes, types: list[str]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for t in types:
        out.append(np.frombuffer(blob, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def unpack_all(blobs: list[bytes], types: list[str]) -> list[np.ndarray]:
    if not blobs:
        return [np.empty(0, t) for t in types]
    return [np.concatenate(x) for x in zip(*(unpack(b, types) for b in blobs), strict=True)]


def split_by_part(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """One (part, packed columns) for each part; rows keep their order."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(part)], strict=True):
        yield int(part[lo]), pack([c[lo:hi] for c in columns])


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    """Target partition of a 64-bit hash, from bits other than its low ones."""
    return ((h >> U64(33)) % U64(n)).astype(np.int32)


PACKED = "part int, kind int, payload binary"


def packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch(
        [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())],
        names=["part", "kind", "payload"],
    )


def packed_batches(rows: Iterator[tuple[int, int, bytes]], limit: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Record batches of at most about ``limit`` bytes of payload."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= limit:
            yield packed_batch(held)
            held, size = [], 0
    if held:
        yield packed_batch(held)


def keyed(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", also: list[str] = ()) -> DataFrame:
    """(part, kind 1, payload null, key, doc_id, text, also ...): ``key`` tells rows
    apart that share a doc_id but not the text; ``part`` is where a key lives.

    The key has 64 bits: of 10^10 different rows, 2.7 pairs are expected to share one, and
    such rows get each other's spans, too.
    """
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return docs.select(
        F.expr(f"cast(pmod(shiftrightunsigned(xxhash64(`{id_col}`, `{text_col}`), 33), {n}) as int)").alias("part"),
        F.lit(1).alias("kind"),
        F.lit(None).cast("binary").alias("payload"),
        key.alias("key"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *also,
    )


def with_payloads(keyed_docs: DataFrame, packed: DataFrame, n: int) -> DataFrame:
    """Documents and the packed rows of their partition together, packed rows first."""
    side = packed.select("part", "kind", "payload", *[F.lit(None).cast(f.dataType).alias(f.name) for f in keyed_docs.schema.fields[3:]])
    return side.unionByName(keyed_docs).repartitionById(n, F.col("part")).sortWithinPartitions("kind")


# -- hashes ------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(31)
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


class Rolling:
    """Hashes of any substring of a byte or symbol array, from one running sum.

    With odd base b, ``sum(c[j] * b**j)`` over a range times ``b**-start`` does
    not depend on where the range starts.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, down = powers(n + 1)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(values * up[:n], out=total[1:])
        self.total, self.down = total, down

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U64))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b & (2**64 - 1), U64)
            p[0] = 1
            out.append(np.cumprod(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


# -- texts of a batch ------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a whole string column and the offset of each text (nulls empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, at least one row."""
    at = batch.schema.get_field_index(column)
    sizes = batch.column(at)
    if sizes.null_count:
        sizes = sizes.fill_null("")
    sizes = sizes.cast(pa.large_string())
    ends = np.frombuffer(sizes.buffers()[1], np.int64, len(sizes) + 1, sizes.offset * 8)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, ``[^\\x20\\x09-\\x0D]+`` unless ``between`` marks other
    bytes, and the number of words before each text; words never cross texts."""
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    np.logical_not(between[raw], out=inside[:n])
    starts = inside[:n].copy()
    starts[1:] &= ~inside[: n - 1] if n else starts[1:]
    firsts = offsets[:-1][(offsets[:-1] < n) & (offsets[:-1] < offsets[1:])]
    starts[firsts] = inside[firsts]
    ends = inside[:n] & ~inside[1:]
    lasts = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[lasts] = inside[lasts]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, the same for equal words of ``raw`` and no others, and
    the distinct words by number.  The spans are those of :func:`word_spans`."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    data = np.ascontiguousarray(raw[~between[raw]])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the XXH3-128 of each word; each distinct word is hashed once."""
    index, words = distinct_words(raw, starts, ends)
    told = b"".join(map(xxhash.xxh3_128_digest, words.to_numpy(zero_copy_only=False)))
    wide = np.frombuffer(told, U64).reshape(-1, 2)
    return wide[index, 0], wide[index, 1]


def exact_names(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row of the columns of small numbers, equal for equal rows only."""
    out, top = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        k = int(c.max(initial=0)) + 1
        if top * k >= 1 << 63:
            kinds, out = np.unique(out, return_inverse=True)
            top = len(kinds)
        out = out * k + c
        top *= k
    return out
