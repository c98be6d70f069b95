"""Secrets in texts: fixed patterns, and strings that a primed zstandard finds new.

A string near words like *password* is a candidate.  What it costs is the bytes by
which it lengthens the compressed text around it, where the compressor knows the
frequent words of the corpus and common identifiers.  Names and words cost little,
keys cost about a byte a character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import distinct_words, slices, stored, text_bytes, word_spans

# The patterns, least lengths and order of kinds of the base.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "novel")

#: A candidate: a run of key characters with a digit and a letter, this long at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Words that make a place sensitive, in the NEAR characters before a candidate or the candidate's line up to it.
SENSITIVE = re.compile(
    r"passw(?:or)?d|passphrase|passcode|\bpwd\b|\bpw\b|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|encryption[_ -]?key|signing[_ -]?key|\bauth|bearer|credential|client[_ -]?id|\bcookie|session[_ -]?(?:id|key)|\bjwt\b|\blogin",
    re.I | re.A,
)
NEAR = 64
#: Characters of the surroundings that are compressed with a candidate, before and after it.
AROUND = 256
#: Marginal compressed bytes a character from which a candidate is new, and at least so many bytes.
NOVELTY, LEAST_BYTES = 0.95, 12
#: Words of the corpus in the dictionary, and its bytes, at most.
DICTIONARY_WORDS, DICTIONARY_BYTES = 8192, 1 << 16
#: Matches of 4 bytes and up, and all else as it stands: with a code for single letters, the cost
#: of a string would depend on the letters around it more than on itself.
FAST = dict(strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=4, window_log=18, hash_log=17, chain_log=16, search_log=1)

#: Names that code and settings use; they prime the dictionary beside the words of the corpus.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret username user_name "
    "authorization authentication bearer basic credential credentials session cookie signature certificate encryption decrypt encrypt hash salt "
    "config configuration settings environment variable default value example sample placeholder your_password_here changeme test_user "
    "localhost database connection string server host port timeout retry refresh expire expires_in grant_type redirect_uri response_type "
    "function return import from class public private static const final void string integer boolean null true false none undefined "
    "request response header content type application json http https www com org net index html path file name key id url uri version "
    "select insert update delete where table column create alter drop index primary foreign "
    "0123456789 123456789 abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 2020 2021 2022 2023 2024 2025 000000000000 xxxxxxxxxxxx XXXXXXXX ---- ==== ____"
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BETWEEN = ~_LETTER
_BETWEEN[np.frombuffer(b"0123456789_+/=-", np.uint8)] = False


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS, size: int = DICTIONARY_BYTES, text_col: str = "text") -> bytes:
    """Content for the compressor: the most frequent words of all texts, of 4 to 24 bytes,
    the most frequent last, where matches cost least; then IDENTIFIERS.

    A word is a whole run of key characters that are all letters.  Candidates hold a
    digit, so copies of a document don't teach parts of its key.  Words are counted
    over all rows, summed in each slice of a task first; ties go by code point.  Null
    and empty texts add nothing; without any text the identifiers remain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, offsets = text_bytes(batch.column(0))
                starts, ends, _ = word_spans(raw, offsets, _BETWEEN)
                index, names = distinct_words(raw, starts, ends, _BETWEEN)
                other = np.r_[0, np.cumsum(~_LETTER[raw])]
                word = (other[ends] == other[starts]) & (ends - starts >= 4) & (ends - starts <= 24)
                counts = np.bincount(index[word], minlength=len(names))
                yield pa.RecordBatch.from_arrays([names.filter(pa.array(counts > 0)).cast(pa.binary()), pa.array(counts[counts > 0])], ["word", "n"])

    counted = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "words")
    # only words that can be among the first go to the driver: counts are cut at a power of two first
    power = F.floor(F.log2("n")).cast("int")
    least, have = 0, 0
    for p, n in sorted(counted.groupBy(power).count().collect(), reverse=True):  # 64 rows at most
        least, have = 1 << p, have + n
        if have >= words:
            break
    most = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(words).collect()  # a top list of fixed length
    out, room = [], size - len(IDENTIFIERS) - 1
    for r in most:
        room -= len(r.word) + 1
        if room < 0:
            break
        out.append(bytes(r.word))
    return b" ".join([*out[::-1], IDENTIFIERS.encode()])


class Novelty:
    """Compressed lengths with a dictionary that is loaded once."""

    def __init__(self, content: bytes):
        how = zstandard.ZstdCompressionParameters(**FAST, write_content_size=False, write_dict_id=False)
        primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(compression_params=how)
        self.compress = zstandard.ZstdCompressor(dict_data=primed, compression_params=how).compress

    def marginal(self, text: str, start: int, end: int) -> int:
        """Bytes by which text[start:end] lengthens the compressed text around it.  Other
        places of the same string are left out of the surroundings: a key that stands twice is as new as one that stands once."""
        string = text[start:end]
        wide = AROUND + len(string)  # no part of another place is left at the edge
        before = text[max(0, start - wide) : start].replace(string, "")[-AROUND:]
        after = text[end : end + wide].replace(string, "")[:AROUND]
        return len(self.compress((before + string + after).encode("utf-8", "surrogatepass"))) - len(self.compress((before + after).encode("utf-8", "surrogatepass")))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns: leftmost matches of each kind that don't overlap, too short ones dropped."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    return found


def novel_spans(text: str, base: list[tuple[int, str, int]], novelty: Novelty) -> list[tuple[int, str, int]]:
    """Candidates in sensitive places that are new to the compressor and touch no base span."""
    taken = sorted((s, e) for s, _, e in base)
    starts, ends = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]) if taken else []
    found = []
    for m in CANDIDATE.finditer(text):
        string, (start, end) = m[0], m.span()
        if not (re.search("[0-9]", string) and re.search("[A-Za-z]", string)):
            continue
        k = int(np.searchsorted(starts, end))  # base spans that begin before its end
        if k and ends[k - 1] > start:
            continue
        if not SENSITIVE.search(text[max(0, start - NEAR) : start]):
            continue
        cost = novelty.marginal(text, start, end)
        if cost >= LEAST_BYTES and cost >= NOVELTY * (end - start):
            found.append((start, "novel", end))
    return found


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))))


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True
_CUES = [w.encode() for w in ("pass", "pwd", "pw", "secret", "token", "key", "auth", "bearer", "credential", "client", "cookie", "session", "jwt", "login")]


def _worth(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that can hold a span: a long run of hexadecimal digits, AKIA or a part of a sensitive word."""
    edge = np.diff(np.concatenate([[0], _HEX_BYTE[raw].astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= LEAST["hex"]  # a run over the end of a text may be too short in each: looked at in vain
    text = lambda at: np.searchsorted(offsets, at, "right") - 1
    mark = np.zeros(len(offsets), np.int64)
    np.add.at(mark, text(start[long]), 1)
    np.add.at(mark, text(end[long] - 1) + 1, -1)
    out = np.cumsum(mark[:-1]) > 0
    data = raw.tobytes()
    low = data.lower()
    for cue, where in [(b"AKIA", data), *((c, low) for c in _CUES)]:
        at = where.find(cue)
        while at >= 0:
            k = int(text(at))
            out[k] = True
            at = where.find(cue, int(offsets[k + 1]))
    return out


def spans(docs: DataFrame, content: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) of each row; see :func:`scan`."""
    shared = docs.sparkSession.sparkContext.broadcast(content)  # DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(shared.value)
        none = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, offsets = text_bytes(batch.column(1))
                rows = []
                for worth, lo, hi in zip(_worth(raw, offsets).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if not worth:
                        rows.append(none)
                        continue
                    text = raw[lo:hi].tobytes().decode()
                    base = base_spans(text)
                    all_of = base + novel_spans(text, base, novelty)
                    kinds = [k for _, k, _ in all_of]
                    rows.append((*map(kinds.count, KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(all_of)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                    ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    )


def scan(docs: DataFrame, content: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) of each row, in one pass without an exchange.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then as
    KINDS has them.  Null and empty texts have none.  Rows don't depend on each other:
    repeated rows get equal results, an empty table gives an empty table, other
    columns are not looked at.  A text is scanned whole, in time linear in its length.
    """
    return spans(docs, content, id_col, text_col).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def findings(docs: DataFrame, content: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end) with a row for each span."""
    rows = spans(docs, content, id_col, text_col).where("spans != ''").select("doc_id", F.explode(F.split("spans", ",")).alias("span"))
    part = lambda k: F.split_part("span", F.lit(":"), F.lit(k))
    return rows.select("doc_id", part(1).alias("kind"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))
