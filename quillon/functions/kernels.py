"""The built-in tokenizers and filters over Arrow arrays, with the results of their Column forms.

A batch of texts is taken in slices of ``SLICE`` bytes, so that memory follows neither the
batch nor the table.  Tokens are found with numpy over the UTF-8 bytes; filters do each
distinct term of a slice once.  The classes of characters are those of the JVM.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

SLICE = 4 << 20
#: Planes from here on have no letters, digits or blanks.
LAST = 0x40000
LETTER, SPACE, UPPER, LOWER = 1, 2, 4, 8
_CLASSES = {LETTER: r"[\p{L}\p{Nd}]", SPACE: r"[\s\x{85}\p{Z}]", UPPER: r"\p{Lu}", LOWER: r"\p{Ll}"}
_packed: dict[str, tuple[bytes, dict[int, str]]] = {}


@dataclass(frozen=True)
class Alphabet:
    """Classes of all code points, compressed, and the lower-case forms that Python does not know; small enough for a closure."""

    packed: bytes
    forms: tuple[tuple[int, str], ...]

    @property
    def table(self) -> np.ndarray:
        return _table(self.packed)

    def lower(self, terms: list[str]) -> list[str]:
        """The terms in lower case: all at once, as the sign between them is no letter."""
        if any("\n" in t for t in terms):
            return [x for t in terms for x in (["\n".join(self.lower(t.split("\n")))] if "\n" in t else self.lower([t]))]
        whole = "\n".join(terms)
        if self.forms and not whole.isascii():
            whole = whole.translate(dict(self.forms)) if _either(tuple(chr(c) for c, _ in self.forms)).search(whole) else whole
        return whole.lower().split("\n") if terms else []


@lru_cache(2)
def _either(signs: tuple[str, ...]) -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, signs)) + "]")


@lru_cache(2)
def _table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _cased() -> list[int]:
    """Characters that Python has a lower case for."""
    return [c for c in range(128, LAST) if not 0xD800 <= c < 0xE000 and chr(c).lower() != chr(c)]


def alphabet(spark) -> Alphabet:
    """The alphabet of a session, asked from its JVM once."""
    key = spark.sparkContext.applicationId
    if key not in _packed:
        sign = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        signs = spark.range(1, LAST, numPartitions=4).where("id < 55296 or id > 57343").select("id", sign.alias("sign"))
        kind = sum((F.when(F.col("sign").rlike(p), bit).otherwise(0) for bit, p in _CLASSES.items()), F.lit(0))
        low = F.lower("sign")
        rows = signs.select("id", kind.cast("tinyint").alias("kind"), F.when(low != F.col("sign"), low).alias("low")).where("kind > 0 or low is not null").toArrow()
        at = rows["id"].to_numpy()
        table = np.zeros(0x110000, np.uint8)
        table[at] = rows["kind"].to_numpy()
        lows = dict(zip(at.tolist(), rows["low"].to_pylist(), strict=True))
        _packed[key] = zlib.compress(table.tobytes()), {c: lows.get(c) or chr(c) for c in {*lows, *_cased()} if (lows.get(c) or chr(c)) != chr(c).lower()}
    packed, forms = _packed[key]
    return Alphabet(packed, tuple(forms.items()))


@dataclass
class Tokens:
    """Tokens of a slice, by row and place in it: terms as codes of distinct ones; starts and ends are bytes of the row's text."""

    rows: int
    row: np.ndarray
    position: np.ndarray
    code: np.ndarray
    terms: pa.StringArray
    start: np.ndarray
    end: np.ndarray
    low: bool = False  # all terms are in lower case

    def sizes(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def flat(self) -> pa.Array:
        return self.terms.take(pa.array(self.code))

    def picked(self, at: np.ndarray) -> Tokens:
        return replace(self, row=self.row[at], position=self.position[at], code=self.code[at], start=self.start[at], end=self.end[at])


#: texts, alphabet -> tokens; filters: tokens, alphabet -> tokens
Kernel = Callable[[pa.StringArray, Alphabet], Tokens]
FilterKernel = Callable[[Tokens, Alphabet], Tokens]


def slices(b: pa.RecordBatch, size: pa.Array, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose rows have a size of ``most`` together, or are one row; a null has none."""
    most = most or SLICE
    part, at = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most, 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]:
        if end > at:
            yield b.slice(at, end - at)
        at = end


def _text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows and all their bytes, three more behind; wrong UTF-8 becomes U+FFFD, a null the empty text."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], np.concatenate([raw, np.zeros(3, np.uint8)])


def _classes(raw: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The kind of each byte's character; the last three bytes are padding."""
    out = kinds[:256].copy()
    out[128:] = 0
    out = out[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        a, b, c, d = (raw[lead + k].astype(np.int32) for k in range(4))
        two, three = (a & 0x1F) << 6 | b & 0x3F, (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F
        four = (a & 0x07) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | d & 0x3F
        kind = kinds[np.minimum(np.where(a < 0xE0, two, np.where(a < 0xF0, three, four)), 0x10FFFF)]
        out[lead] = kind
        out[lead + 1] = kind
        out[lead[a >= 0xE0] + 2] = kind[a >= 0xE0]
        out[lead[a >= 0xF0] + 3] = kind[a >= 0xF0]
    return out[:-3]


def _cut(texts: pa.Array, kinds: np.ndarray) -> Tokens:
    """Tokens of texts: runs of characters of kind 1, and each character of kind 2."""
    offsets, raw = _text(texts)
    kind, n = _classes(raw, kinds), len(texts)
    raw = raw[:-3]
    run, size = kind == 1, len(kind)
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    start, end = run.copy(), run.copy()
    start[1:] &= ~run[:-1] | edge[1:size]
    end[:-1] &= ~run[1:] | edge[1:size]
    single = kind == 2
    if single.any():
        more = np.append(raw & 0xC0 == 0x80, False)  # bytes of a character that began before
        start |= single & ~more[:-1]
        end |= single & ~more[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    kept = raw[kind > 0]
    lengths = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(lengths), pa.py_buffer(kept)).dictionary_encode()
    base = np.searchsorted(starts, offsets)
    many = np.diff(base)
    row = np.repeat(np.arange(n), many)
    place = np.arange(len(starts)) - np.repeat(base[:-1], many) + 1
    first = np.repeat(offsets[:-1], many)
    return Tokens(n, row, place.astype(np.int32), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, (starts - first).astype(np.int32), (ends - first).astype(np.int32))


def unicode_tokens(texts: pa.Array, own: Alphabet) -> Tokens:
    return _cut(texts, own.table & LETTER)


def whitespace_tokens(texts: pa.Array, own: Alphabet) -> Tokens:
    return _cut(texts, (own.table & SPACE == 0).astype(np.uint8))


def keyword_tokens(texts: pa.Array, own: Alphabet) -> Tokens:
    offsets, raw = _text(texts)
    row = np.flatnonzero(np.diff(offsets))
    coded = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)).take(pa.array(row)).dictionary_encode()
    return Tokens(len(texts), row, np.ones(len(row), np.int32), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.zeros(len(row), np.int32), np.diff(offsets)[row].astype(np.int32))


def code_tokens(texts: pa.Array, own: Alphabet) -> Tokens:
    table = own.table
    kinds = np.where(table & LETTER > 0, 1, np.where(table & SPACE > 0, 0, 2)).astype(np.uint8)
    kinds[[ord("_"), ord(".")]] = 1

    raws = _cut(texts, kinds)
    terms = raws.terms.to_pylist()
    made = [[x] for x in terms]
    sign = np.frombuffer("\n".join(["", *terms, ""]).encode("utf-32-le"), np.uint32)
    kind, edge = table[np.minimum(sign, 0x10FFFF)], sign == 10
    small = kind & LOWER > 0
    hump = np.zeros(len(sign), bool)  # where a part begins: at a capital behind a small letter, or before one or the end
    hump[1:-1] = (kind[1:-1] & UPPER > 0) & ~edge[:-2] & (small[2:] | edge[2:] | small[:-2])
    humps, bounds = np.flatnonzero(hump), np.flatnonzero(edge)
    some = np.unique(np.searchsorted(bounds, np.flatnonzero(hump | (sign == 46) | (sign == 95))) - 1)
    for i, at, first, last in zip(some.tolist(), (bounds[some] + 1).tolist(), np.searchsorted(humps, bounds[some]).tolist(), np.searchsorted(humps, bounds[some + 1]).tolist(), strict=True):
        raw, cuts = terms[i], [0, *(humps[first:last] - at).tolist(), None]
        for x in "._":
            if x in raw:
                made[i] += [p for p in raw.split(x) if p]
        split = [p for p in (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)) if p not in ("", "_")]
        made[i] += split if len(split) > 1 else []
    return lowercase(mapped(raws, made), own)


# filters


def mapped(t: Tokens, made: list[list[str]]) -> Tokens:
    """Tokens with each distinct term replaced by those made of it, at the same place."""
    many = np.fromiter(map(len, made), np.int64, len(made))
    coded = pa.array([x for m in made for x in m], pa.string()).dictionary_encode()
    code, first = coded.indices.to_numpy(zero_copy_only=False), np.cumsum(many) - many
    n = many[t.code]
    at = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return replace(t.picked(at), code=code[first[t.code[at]] + inside], terms=coded.dictionary, low=False)


def each(f: Callable[[str], list[str]]) -> FilterKernel:
    return lambda t, own: mapped(t, list(map(f, t.terms.to_pylist())))


def lowercase(t: Tokens, own: Alphabet) -> Tokens:
    if t.low:
        return t
    low = pa.array(own.lower(t.terms.to_pylist()), pa.string()).dictionary_encode()
    return replace(t, code=low.indices.to_numpy(zero_copy_only=False)[t.code], terms=low.dictionary, low=True)


def kept(f: Callable[[str], bool], lower: bool = False) -> FilterKernel:
    """Only the tokens whose term, in lower case where asked for, passes."""

    def run(t: Tokens, own: Alphabet) -> Tokens:
        terms = t.terms.to_pylist()
        ok = np.fromiter(map(f, own.lower(terms) if lower else terms), bool, len(terms))
        return t.picked(np.flatnonzero(ok[t.code]))

    return run


def by_term(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The order of tokens by row, term and place, and where in it a new term begins."""
    n, key = len(t.row), t.row * (int(t.code.max(initial=0)) + 1) + t.code
    bits = n.bit_length()
    if int(key.max(initial=0)) >> (62 - bits):
        order = np.argsort(key, kind="stable")
        key = key[order]
    else:  # sorting values is faster than sorting places
        both = np.sort(key << bits | np.arange(n))
        order, key = both & (1 << bits) - 1, both >> bits
    return order, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, np.int64)


def unique(t: Tokens, own: Alphabet) -> Tokens:
    """The first token of each term of a row, by position and then term."""
    order, head = by_term(t)
    out = t.picked(np.sort(order[head]))
    tie = np.zeros(len(out.row) + 1, bool)
    tie[1:-1] = (out.row[1:] == out.row[:-1]) & (out.position[1:] == out.position[:-1])
    some = np.flatnonzero(tie[1:] | tie[:-1])  # several terms at one position
    if len(some):
        codes, rank = np.unique(out.code[some], return_inverse=True)
        place = np.empty(len(codes), np.int64)
        place[pc.array_sort_indices(out.terms.take(pa.array(codes)).cast(pa.binary())).to_numpy()] = np.arange(len(codes))
        at = np.arange(len(out.row))
        at[some] = some[np.lexsort((place[rank], out.position[some], out.row[some]))]
        out = out.picked(at)
    return out


# rows and columns


def flat_columns(t: Tokens, offsets: bool = False) -> list[pa.Array]:
    """term, position and, where asked for, start and end."""
    return [t.flat(), pa.array(t.position), *((pa.array(t.start), pa.array(t.end)) if offsets else ())]


def listed(t: Tokens, gone: pa.Array | None = None) -> pa.ListArray:
    """An array of (term, position, start, end) for each row; null where ``gone``."""
    items = pa.StructArray.from_arrays(flat_columns(t, True), ["term", "position", "start", "end"])
    ends = np.concatenate(([0], np.cumsum(t.sizes()))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), items, mask=gone)


def heads(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Where a new (row, code) begins in sorted ones."""
    return np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, np.int64)


def counted(t: Tokens, positions: bool = True) -> tuple[np.ndarray, list[pa.Array]]:
    """The rows of the terms of each row; term, tf and positions."""
    order, head = by_term(t)
    first, ends = order[head], np.append(head, len(order)).astype(np.int32)
    spots = pa.ListArray.from_arrays(pa.array(ends), pa.array(t.position[order])) if positions else pa.nulls(len(head), pa.list_(pa.int32()))
    return t.row[first], [t.terms.take(pa.array(t.code[first])), pa.array(np.diff(ends)), spots]


def only(t: Tokens, terms: list[str]) -> Tokens:
    """The tokens with one of some terms."""
    ok = pc.is_in(t.terms, pa.array(terms, pa.string())).to_numpy(zero_copy_only=False)
    return t.picked(np.flatnonzero(ok[t.code]))
