"""Byte-level BPE encoding and decoding of whole text columns.

Texts are pre-split at *safe* boundaries of ``UNIT_PATTERN``: a single space between
two characters that are not white space always starts a new match, so the units
between such spaces can be encoded apart from each other.  Distinct units that are
not known yet go to the library joined in one string, and its ids are cut again
where a token begins with a space, which only a unit's first token does.  A text in
which some space touches other white space, or which holds white space outside
ASCII, goes to the library as a whole: long ones in pieces that end before a single
space and a letter, and long runs of white space as the single match that they are.
Texts under any other pattern are never split.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

#: The pre-tokenization pattern that the boundaries here are safe for; a fixed value.
UNIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space beside other white space (ASCII control separators included), white space outside ASCII, or a long run of it.
ODD_SPACE = (
    r" [\x09-\x0D\x1C-\x20]|[\x09-\x0D\x1C-\x1F] "
    r"|[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    r"|[\x09-\x0D]{1000}"
)
#: Longest text given to the library in one call where safe pieces exist.
LONG_TEXT = 1 << 16
#: Bytes of text whose distinct units are looked up together.
TOGETHER = 1 << 21
#: Ids whose bytes are gathered together: an index of 8 bytes is made for each byte.
DECODED = 1 << 14
#: Units that go to the library in one string.
JOINED = 256
#: ASCII marks; as all of a unit's end after a letter or digit of ``_BEFORE_MARKS`` they are one match of their own.
MARKS = ".,;:!?)]}\"|*#%&$/-"
_BEFORE_MARKS = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]\z"
_SAFE_PIECE = re.compile(r"(?<=[^\s])(?= [A-Za-z])")
#: Runs of white space, as the pattern has it, that the library's matcher is spared.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


class UnitEncoder:
    """Ids of texts through a cache of encoded units.

    ``encode(list of strings) -> list of id lists`` is the library's call;
    ``leads[id]`` says whether a token begins with a space; ``one_match(string)``
    gives the ids of a run of white space that is one match; a text that holds one of
    ``special`` goes to the library whole, and every text if ``split`` is false.  The
    cache holds two generations of at most ``most`` units: what is asked for again
    moves to the younger one, and the older one is dropped when that is full.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], leads: np.ndarray, one_match: Callable[[str], list[int]], special: tuple[str, ...] = (), split: bool = True, most: int = 200_000):
        self.encode, self.leads, self.one_match, self.special, self.split, self.most = encode, leads, one_match, special, split, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def units(self, words: list[str]) -> list[bytes]:
        """Ids, as bytes, of each of the distinct ``words`` with a space before it."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        got = list(map(self.young.get, words))
        missing = [k for k, ids in enumerate(got) if ids is None]
        if not missing:
            return got
        new = []
        for k in missing:
            ids = self.old.get(words[k])
            if ids is None:
                new.append(k)
            else:
                got[k] = self.young[words[k]] = ids
        # white space at a unit's end would meet the next unit's space
        joined = [k for k in new if words[k] and not words[k][-1].isspace()]
        for at in range(0, len(joined), JOINED):
            part = [words[k] for k in joined[at : at + JOINED]]
            ids = np.array(self.encode([" " + " ".join(part)])[0], np.uint32)
            edges = [*(np.flatnonzero(self.leads[ids]) * 4).tolist(), 4 * len(ids)]
            if len(edges) != len(part) + 1:
                raise ValueError("a token that begins with a space stands inside a unit: not a byte-level vocabulary")
            raw = ids.tobytes()
            for k, word, lo, hi in zip(joined[at : at + JOINED], part, edges, edges[1:], strict=False):
                got[k] = self.young[word] = raw[lo:hi]
        for k in new:
            if got[k] is None:
                got[k] = np.array(self.encode([" " + words[k]])[0], np.uint32).tobytes()
        return got

    def marked_units(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct units, by their bodies without the marks at their ends."""
        body = pc.utf8_rtrim(words, MARKS)
        body = pc.if_else(pc.match_substring_regex(body, _BEFORE_MARKS), body, words)
        coded = body.dictionary_encode()
        bodies = self.units(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        out = [bodies[i] for i in coded.indices.to_numpy().tolist()]
        size = (pc.binary_length(words).to_numpy() - pc.binary_length(body).to_numpy()).astype(np.int64)
        marked = np.flatnonzero(size)
        if len(self.marks) > self.most:
            self.marks.clear()
        for k, word, n in zip(marked.tolist(), words.take(pa.array(marked)).to_numpy(zero_copy_only=False), size[marked].tolist(), strict=True):
            ids = self.marks.get(word[-n:])
            if ids is None:
                ids = self.marks[word[-n:]] = np.array(self.encode([word[-n:]])[0], np.uint32).tobytes()
            out[k] += ids
        return out

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text without the cache."""
        if not self.split:
            return np.array(self.encode([text])[0], np.uint32)
        out: list[list[int]] = []
        at = 0
        for m in _LONG_SPACE.finditer(text):
            # all of a run but its last character is one match, or all of it at the end
            end = m.end() - (m.end() < len(text))
            out += self.encode(self.pieces(text[at : m.start()]))
            out.append(self.one_match(text[m.start() : end]))
            at = end
        out += self.encode(self.pieces(text[at:]))
        return np.concatenate([np.array(x, np.uint32) for x in out]) if out else np.empty(0, np.uint32)

    @staticmethod
    def pieces(text: str) -> list[str]:
        if len(text) <= LONG_TEXT:
            return [text] if text else []
        pieces, at = [], 0
        for m in _SAFE_PIECE.finditer(text):
            if m.start() - at >= LONG_TEXT:
                pieces.append(text[at : m.start()])
                at = m.start()
        return [*pieces, text[at:]]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (nulls are empty) and the number of each text's ids."""
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the cache is a large heap to walk
        try:
            return self._batch(texts)
        finally:
            if collects:
                gc.enable()

    def _batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = np.asarray(pc.match_substring_regex(texts, ODD_SPACE)) if self.split else np.ones(len(texts), bool)
        for token in self.special:
            odd = odd | np.asarray(pc.match_substring(texts, token))
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        ids, counts = self._plain(plain) if len(plain) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        if not odd.any():
            return ids, counts
        plain_ids = iter(np.split(ids, np.cumsum(counts)[:-1]))
        found = [self.whole(t.as_py()) if o else next(plain_ids) for t, o in zip(texts, odd, strict=True)]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(texts, " ")
        sizes = np.diff(np.asarray(parts.offsets))
        flat = parts.flatten()
        firsts = np.cumsum(sizes) - sizes
        heads = flat.take(pa.array(firsts)).to_pylist()
        tail = np.ones(len(flat), bool)
        tail[firsts] = False
        coded = flat.filter(pa.array(tail)).dictionary_encode()
        units = self.marked_units(coded.dictionary)
        # a text's first word has no space before it
        units += [np.array(x, np.uint32).tobytes() for x in self.encode(heads)]
        row = np.empty(len(flat), np.int64)
        row[tail] = coded.indices.to_numpy()
        row[firsts] = len(units) - len(heads) + np.arange(len(heads))
        length = np.fromiter(map(len, units), np.int64, len(units)) // 4
        start = np.cumsum(length) - length
        every = np.frombuffer(b"".join(units), np.uint32)
        each = length[row]
        ids = every[np.repeat(start[row] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        return ids, np.add.reduceat(each, firsts)


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a local rank file, built once in each worker."""
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        _ENCODINGS[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=rank_file(path), special_tokens={})
    return _ENCODINGS[path, pattern]


_CODERS: dict[tuple[str, str], UnitEncoder] = {}


def coder_of(path: str, pattern: str) -> UnitEncoder:
    """The unit encoder of a rank file, kept by the worker; no special tokens."""
    if (path, pattern) not in _CODERS:
        enc = encoding(path, pattern)
        leads = np.zeros(enc.n_vocab, bool)
        leads[[rank for token, rank in rank_file(path).items() if token[:1] == b" "]] = True
        _CODERS[path, pattern] = UnitEncoder(
            lambda texts: [enc.encode_ordinary(t) for t in texts], leads, lambda run: enc._encode_single_piece(run.encode()), split=pattern == UNIT_PATTERN
        )
    return _CODERS[path, pattern]


def token_bytes(enc) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens in id order, and where each begins."""
    tokens = [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]
    ends = np.cumsum([0, *map(len, tokens)])
    return np.frombuffer(b"".join(tokens), np.uint8), ends


def decode_bytes(ids: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Raw bytes of a run of ids."""
    out = [np.empty(0, np.uint8)]
    for at in range(0, len(ids), DECODED):
        part = ids[at : at + DECODED]
        each = ends[part + 1] - ends[part]
        out.append(flat[np.repeat(ends[part] - (np.cumsum(each) - each), each) + np.arange(each.sum())])
    return np.concatenate(out)


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with an array column of token ids in front of its other columns.

    A null or empty text has no ids.  ``rank_path`` is a file that every executor
    can read (an installed vocabulary).  Rows, repeated or not, stay as they are.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns if c != ids_col]
    schema = docs.select(F.array(F.lit(0)).alias(ids_col), *cols).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(rank_path, pattern)
        for whole in batches:
            for batch in slices(whole, text_col, TOGETHER):
                ids, counts = coder.batch(batch.column(batch.schema.get_field_index(text_col)))
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, *batch.columns], [ids_col, *batch.schema.names])

    return docs.select(*cols).mapInArrow(run, schema)


def decode(coded: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``coded`` with the raw bytes of its ids in front: bytes, as a cut run of ids
    need not be valid UTF-8.  A null id list decodes to no bytes."""
    cols = [F.col(f"`{c}`") for c in coded.columns if c != bytes_col]
    schema = coded.select(F.lit(b"").alias(bytes_col), *cols).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, ends = token_bytes(encoding(rank_path, pattern))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            at = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype(np.int64)
            empty = np.asarray(lists.is_null())
            out = [b"" if e else decode_bytes(values[a:b], flat, ends).tobytes() for a, b, e in zip(at[:-1], at[1:], empty, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *batch.columns], [bytes_col, *batch.schema.names])

    return coded.select(*cols).mapInArrow(run, schema)


def digest(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text: encoded,
    then decoded from the ids, in one pass without an exchange.

    Null texts are empty and have no ids; texts are read whole, however long.  Repeated rows get
    equal results, an empty table gives an empty one, null ids stay, other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(rank_path, pattern)
        flat, ends = token_bytes(encoding(rank_path, pattern))
        for whole in batches:
            for batch in slices(whole, "text", TOGETHER):
                ids, counts = coder.batch(batch.column(1))
                raw = decode_bytes(ids.astype(np.int64), flat, ends)
                width = np.r_[0, np.cumsum(ends[ids.astype(np.int64) + 1] - ends[ids])]
                at = np.r_[0, np.cumsum(counts)]
                little = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(counts),
                        pa.array([hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
                        pa.array([hashlib.sha256(raw[width[a] : width[b]]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
