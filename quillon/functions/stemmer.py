"""A light suffix stemmer; lengths count UTF-8 bytes, words of two bytes or fewer stay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_ENDINGS = (
    ("ational>ate tional>tion enci>ence anci>ance izer>ize isation>ize ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble eli>e ousli>ous entli>ent alli>al"),
    ("icate>ic ative> alize>al iciti>ic ical>ic ful> ness>"),
)
STEP2, STEP3 = (tuple((a.encode(), b.encode()) for a, b in (x.split(">") for x in group.split())) for group in LONG_ENDINGS)
STEP4 = tuple(x.encode() for x in "ement ment ent ant ence ance able ible ate ive ize ise iti al er ic ou ion".split())


def _voiced(w: bytes) -> bool:
    return any(c in b"aeiou" for c in w)


def _tidy(w: bytes) -> bytes:
    if w.endswith((b"at", b"bl", b"iz")):
        return w + b"e"
    return w[:-1] if len(w) > 1 and w[-1] == w[-2] and w[-1:] not in (b"l", b"s", b"z") else w


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.encode("utf-8", "surrogatepass")
    if len(w) <= 2:
        return word
    if w.endswith(b"sses"):
        w = w[:-2]
    elif w.endswith(b"ies") and len(w) > 4:
        w = w[:-2]
    elif w.endswith(b"s") and not w.endswith((b"ss", b"us", b"is")) and len(w) > 3:
        w = w[:-1]
    if w.endswith(b"eed"):
        w = w[:-1] if len(w) > 4 else w
    elif w.endswith(b"ed") and len(w) > 4 and _voiced(w[:-2]):
        w = _tidy(w[:-2])
    elif w.endswith(b"ing") and len(w) > 5 and _voiced(w[:-3]):
        w = _tidy(w[:-3])
    if w.endswith(b"y") and len(w) > 2 and _voiced(w[:-1]):
        w = w[:-1] + b"i"
    for table in (STEP2, STEP3):
        hit = next(((a, b) for a, b in table if w.endswith(a)), None)
        if hit and len(w) - len(hit[0]) > 1:
            w = w[: -len(hit[0])] + hit[1]
    end = next((a for a in STEP4 if w.endswith(a)), None)
    if end and len(w) - len(end) > 2 and (end != b"ion" or w[-4:-3] in (b"s", b"t")):
        w = w[: -len(end)]
    if w.endswith(b"e") and len(w) > 3:
        w = w[:-1]
    if w.endswith(b"ll") and len(w) > 3:
        w = w[:-1]
    return w.decode("utf-8", "replace")


def stems(terms: Column) -> Column:
    """Stems of an array of words; each distinct word of a batch is stemmed once."""

    @F.arrow_udf("array<string>")
    def run(col: pa.Array) -> pa.Array:
        coded = col.flatten().cast(pa.string()).dictionary_encode()
        flat = pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(col.value_lengths(), 0).to_numpy(zero_copy_only=False)))).astype(np.int32)
        gone = col.is_null() if col.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends), flat, mask=gone)

    return run(terms)
