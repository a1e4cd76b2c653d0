"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a piece there is exactly one token that can end its encoding: the
token matching a suffix whose predecessor, the last token of the prefix before it,
is compatible with it (merging would not have joined or split the two otherwise).
An Aho-Corasick automaton over the vocabulary yields the suffix matches; back-pointers
give the ids.  The outcome equals merging by rank, without a merge loop.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.util
import sys
import types
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, type_of

#: The pre-splitting of byte_bpe_50k: contractions, runs of letters, digits or other characters with a blank before, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE, CACHE_CHARS = 300_000, 40
_BLANKS = regex.compile(r"\s\s")
UNKNOWN = "\ufffd".encode()


def default_vocabulary() -> str:
    """The rank file of the installed public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(folder / "byte_bpe_50k.tiktoken")


class Bpe:
    """An exact encoder for a vocabulary of ranked byte strings that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        if missing := 256 - sum(len(b) == 1 for b in ranks):
            raise ValueError(f"{missing} single bytes are not in the vocabulary, so some texts have no encoding")
        self.bytes = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.by_blank = pattern == PATTERN
        self.cache: dict[str, tuple[int, ...]] = {}
        self.units: dict[str, tuple[int, ...]] = {}
        self.auto = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.auto.add_word(b.decode("latin-1"), (i, len(b)))
        self.auto.make_automaton()
        self.merged: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.fit: dict[int, bool] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.split[i] = (i, i)
                continue
            parts = self._merge_below(b, i, ranks)
            if len(parts) == 2:
                pair = (ranks[parts[0]], ranks[parts[1]])
                self.merged[pair] = i
                self.split[i] = pair

    @staticmethod
    def _merge_below(b: bytes, limit: int, ranks: dict[bytes, int]) -> list[bytes]:
        """The parts left when a token is merged with ranks under its own."""
        parts = [b[k : k + 1] for k in range(len(b))]
        while len(parts) > 2:
            r, k = min((ranks.get(parts[k] + parts[k + 1], limit), k) for k in range(len(parts) - 1))
            if r >= limit:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that once stood at an end of a token (0: its left end), each with the token that took it in."""
        known = self.edges[side].get(token)
        if known is None:
            known, whole = [(token, 1 << 62)], token
            while self.split[whole][side] != whole:
                known.append((self.split[whole][side], whole))
                whole = self.split[whole][side]
            self.edges[side][token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay side by side when the bytes of both are merged by rank.

        They do not if a token at a's right end and one at b's left end make a merge whose
        turn comes while both stand there: before either is taken in by a token of its own
        side.  Of equal ranks the one to the left goes first.
        """
        right, left = self._edge(a, 1), self._edge(b, 0)
        for x, taken in right:
            for y, took in left:
                m = self.merged.get((x, y))
                if m is not None and m < taken and m <= took:
                    return False
        return True

    def piece(self, s: str) -> tuple[int, ...]:
        """Ids of one pre-split piece, given as its bytes in latin-1."""
        last, back = [0] * (len(s) + 1), [-1] * (len(s) + 1)
        back[0] = 0
        fit, split = self.fit, self.split
        for end, (token, length) in self.auto.iter(s):
            end += 1
            if back[end] >= 0 or token not in split:
                continue
            start = end - length
            if start:
                if back[start] < 0:
                    continue
                key = last[start] << 32 | token
                ok = fit.get(key)
                if ok is None:
                    if len(fit) >= CACHE:
                        fit.clear()
                    ok = fit[key] = self.compatible(last[start], token)
                if not ok:
                    continue
            last[end], back[end] = token, start
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at = back[at]
        return tuple(reversed(out))

    def _known(self, p: str) -> tuple[int, ...]:
        """Ids of one piece, remembered where it is short."""
        ids = self.cache.get(p)
        if ids is None:
            ids = self.piece(p.encode("utf-8", "surrogatepass").decode("latin-1"))
            if len(p) <= CACHE_CHARS:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[p] = ids
        return ids

    def pieces(self, text: str) -> list[int]:
        """Ids of a text, split by the pattern."""
        out: list[int] = []
        for p in self.pattern.findall(text):
            out += self._known(p)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text.

        Where no two blanks meet, the pattern never matches across a blank, only from one
        on; such texts are cut at blanks and the ids of each " word" are remembered.
        """
        if not self.by_blank or text[:1].isspace() or text[-1:].isspace() or _BLANKS.search(text):
            return self.pieces(text)
        first, *rest = text.split(" ")
        out, units = self.pieces(first), self.units
        for u in rest:
            ids = units.get(u)
            if ids is None:
                parts = self.pattern.findall(" " + u)
                ids = self._known(parts[0]) if len(parts) == 1 else tuple(i for p in parts for i in self._known(p))  # a word alone is held once
                if len(u) <= CACHE_CHARS:
                    if len(units) >= CACHE:
                        units.clear()
                    units[u] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; an unknown id, and bytes that are not UTF-8, become U+FFFD."""
        return b"".join([self.bytes.get(i, UNKNOWN) for i in ids]).decode("utf-8", "replace")


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of lines with a base64 token and its rank each."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


def read_ranks(path: str) -> dict[bytes, int]:
    return parse_ranks(Path(path).read_bytes())


def _shipped(spark: SparkSession, vocabulary: str | None):
    """The rank file as a broadcast value, with its digest."""
    data = Path(vocabulary or default_vocabulary()).read_bytes()
    return spark.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))  # the vocabulary: its size hangs on no table


def _encoder(shipped) -> Bpe:
    """The encoder of a shipped vocabulary; a worker keeps it, and what it remembers, from task to task."""
    kept = sys.modules.setdefault("_quillon_kept", types.ModuleType("_quillon_kept")).__dict__
    digest, data = shipped.value
    if digest not in kept:
        kept[digest] = Bpe(parse_ranks(data))
    return kept[digest]


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, exact) for each row: its ids, and whether they decode to the very text.

    ``vocabulary`` is the path, on the driver, of a rank file; it is broadcast.  A null text
    has null ids and counts; an empty one has none of them; texts of any length are encoded
    whole; ids of documents may be null, repeat (a row each) and be of any type; an empty
    table gives an empty result; other columns are ignored.  Letters and digits are those of
    the regex library's Unicode version, which may be newer than another encoder's.
    """
    shipped = _shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shipped)
        for b in chunks(batches):
            texts = b.column("text").to_pylist()
            ids = [None if t is None else np.array(bpe.encode(t), np.int32) for t in texts]
            exact = [None if t is None else bpe.decode(i.tolist()) == t for t, i in zip(texts, ids, strict=True)]
            flat = np.concatenate([np.zeros(0, np.int32), *(i for i in ids if i is not None)])
            ends = np.cumsum([0] + [0 if i is None else len(i) for i in ids]).astype(np.int32)
            null = np.array([i is None for i in ids])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if i is None else len(i) for i in ids], pa.int32()), lists, pa.array(exact, pa.bool_())], ["doc_id", "n_tokens", "ids", "exact"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, n_tokens int, ids array<int>, exact boolean")


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) for each row of doc_id and ids.

    Null ids give a null text, none an empty one; an unknown id, a null among the ids, and
    bytes that are not UTF-8, become U+FFFD.  Repeated rows give a row each; an empty table
    gives an empty result; other columns are ignored.
    """
    shipped = _shipped(tokens.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shipped)
        for b in batches:
            texts = [None if i is None else bpe.decode(i) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {type_of(tokens, 'doc_id')}, text string")


def op10(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
