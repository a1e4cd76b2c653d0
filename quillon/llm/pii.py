"""PII by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Regex, gazetteer and context labelers each vote on every candidate span: what has an
at-sign, digits, or a long run of letters, as ``CANDIDATE`` finds it, and any value
assigned to the name of a secret.  Dawid-Skene EM over the counts of all vote patterns
estimates each labeler's confusion matrix; its posteriors train a multinomial logistic
classifier on the votes and on discretised shape features.  Votes and features take
finitely many values, so what is collected, the distinct patterns with their counts, is
bounded whatever the input, and every span of a pattern gets one decision.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import chunks, discard, fresh, materialise, type_of

KINDS = ["none", "email", "phone", "ip", "card", "secret", "iban"]
NONE, EMAIL, PHONE, IP, CARD, SECRET, IBAN = range(7)
ABSTAIN = -1
RIGHT = 5.0


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


@dataclass(frozen=True)
class Gazetteers:
    """Lists that labelers look things up in; ``of`` takes others from tables."""

    domains: frozenset[str] = _set(
        """com org net edu gov mil int info biz name pro mobi app dev ai io co me tv cc eu
        ac ad ae af ag al am ao ar at au az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cd cf cg ch ci cl cm cn cr cu cv cy cz
        de dj dk dm do dz ec ee eg es et fi fj fm fo fr ga ge gf gg gh gi gl gm gn gp gr gt gy hk hn hr ht hu id ie il im in iq ir is it je
        jm jo jp ke kg kh km kn kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md mg mk ml mm mn mo mr mt mu mv mw mx my mz na nc ne ng
        ni nl no np nz om pa pe pf pg ph pk pl ps pt py qa re ro rs ru rw sa sb sc sd se sg si sk sl sm sn so sr ss st sv sy sz td tg th tj
        tl tm tn to tr tt tw tz ua ug uk us uy uz va vc ve vn vu ws ye za zm zw example test invalid"""
    )
    names: frozenset[str] = _set(
        """adam alan albert alex alice amy ana andrea andrew angela ann anna anne antonio barbara ben bob brian carla carlos carol caroline
        charles charlotte chris christian christina claire clara claudia daniel david diana diego eva elena elisabeth elizabeth emily emma
        eric erik felix frank george hannah hans helen henry ian ines isabel jack jacob james jan jane javier jean jennifer jessica joan john
        jonas jorge jose joseph juan julia julie karen karl kate katharina kevin klaus laura lea leon linda lisa louis lucas lucia luis lukas
        manuel marc marco maria marie mark marta martin mary matthias max michael miguel monica nicolas nina olivia oscar patricia patrick
        paul pedro peter philip pierre rachel raul richard robert rosa ruth sam samuel sandra sara sarah simon sofia sophie stefan stephen
        steven susan thomas tim tom ursula victor wolfgang yvonne"""
    )
    calling: frozenset[str] = _set(
        """1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94
        95 98 211 212 213 216 218 220 221 223 225 226 227 228 229 230 231 233 234 237 238 240 241 242 243 244 248 249 250 251 252 253 254
        255 256 257 258 260 261 263 264 265 266 267 268 291 297 298 299 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376
        377 378 380 381 382 383 385 386 387 389 420 421 423 501 502 503 504 505 506 507 509 590 591 592 593 594 595 596 597 598 599 670 673
        852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 992 993 994 995 996 998"""
    )
    #: The first digits of payment cards, with the lengths of their numbers.
    issuers: frozenset[tuple[str, int]] = frozenset(
        [("4", 13), ("4", 16), ("4", 19), *((p, 15) for p in ("34", "37")), *((str(p), 16) for p in (*range(51, 56), *range(2221, 2721), 6011, 65, *range(644, 650), *range(3528, 3590)))]
        + [(str(p), 14) for p in (36, 38, 39, *range(300, 306))]
        + [(str(p), n) for p in (5018, 5020, 5038, 5893, 6304, 6759, 6761, 6762, 6763) for n in range(13, 20)]
    )
    #: Countries of account numbers, with the length.
    accounts: frozenset[tuple[str, int]] = frozenset(
        (x[:2], int(x[2:]))
        for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20".split()
    )

    @classmethod
    def of(cls, tables: dict[str, DataFrame], most: int = 1_000_000) -> Gazetteers:
        """Lists from one-column tables (domains, names, calling), in lower case; a table of over ``most`` rows is refused, as it is sent to every worker."""
        out = {}
        for name, t in tables.items():
            rows = t.where(F.col(t.columns[0]).isNotNull()).limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"gazetteer {name!r} has over {most} rows")
            out[name] = frozenset(str(r[0]).lower() for r in rows)
        return cls(**out)


GAZETTEERS = Gazetteers()
CUES: dict[str, int] = (
    dict.fromkeys("email mail e-mail correo courriel contact".split(), EMAIL)
    | dict.fromkeys("phone tel telephone call fax mobile cell telefon handy teléfono téléphone".split(), PHONE)
    | dict.fromkeys("ip host address server addr ipv4 ipv6".split(), IP)
    | dict.fromkeys("card visa mastercard credit tarjeta carte".split(), CARD)
    | dict.fromkeys("iban account konto cuenta compte".split(), IBAN)
    | dict.fromkeys("token key secret password passwd pwd apikey api_key api-key auth bearer credential credentials".split(), SECRET)
    | dict.fromkeys("version v chapter section page by-nc by-sa by figure license licensed copyright isbn".split(), NONE)
)
CANDIDATE = re.compile(
    r"[\w.+-]*\w@\w[\w-]*(?:\.[\w-]*\w)+"  # with an at-sign
    r"|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"  # four parts
    r"|(?<![\w:])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*(?![\w:])"  # colons and hexadecimal digits
    r"|(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"  # a country, two digits and groups of four
    r"|(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}[ .-]?\d{3,4}(?!\d)"  # with a bracketed area
    r"|(?<![\w-])\d{9,}(?![\w-])"  # an unbroken number
    r"|(?<!\w)[A-Za-z0-9_\-]{20,}(?!\w)"  # long tokens
    r"|\+?\d(?:[ .-]?\d)+"  # digits, perhaps in groups
)
#: What a text needs to hold a candidate: a digit, an at-sign or a long token, or, where it has a colon or =, one of these signs in their places.
_PLAIN, _SIGNED = r"\p{Nd}|@|[A-Za-z0-9_\-]{20}", r":[0-9A-Fa-f]{0,4}:|(?:[Tt][Oo][Kk][Ee][Nn]|[Kk][Ee][Yy]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss]|[Pp][Ww][Dd]|[Aa][Uu][Tt][Hh]|[Bb][Ee][Aa][Rr][Ee][Rr]|[Cc][Rr][Ee][Dd][Ee][Nn])\w*[\"']?\s*[:=]"
_VALUE = re.compile(r"[:=]>?[ \t]*[\"']?([^\s\"'`,;<>()\[\]{}]{4,})")
_QUADS, _NUMERIC, _HEX = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}"), re.compile(r"[\d +().-]+"), re.compile(r"[0-9a-fA-F]{20,}")
_ASSIGN, _GROUP, _NO_DIGIT = re.compile(r"[:=]>?\s*[\"']?$"), re.compile(r"[ ().-]"), re.compile(r"\D")
_ACCOUNT, _WORD = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9 ]+"), re.compile(r"[^\W\d_]+")
LABELERS = ["rx_email", "rx_phone", "rx_ip", "rx_card", "rx_secret", "rx_iban", "gaz_domain", "gaz_name", "gaz_calling", "gaz_issuer", "gaz_account", "ctx_cue", "ctx_assign", "lf_short", "lf_word"]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _checks(account: str) -> bool:
    """An account number's check digits."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def before(text: str, at: int) -> tuple[str, str]:
    """The word before a place, however far back, and what stands between: blanks, quotes and the signs : = ( #."""
    k = at
    while k and (text[k - 1].isspace() or text[k - 1] in ":=>\"'(#"):
        k -= 1
    j = k
    while j and (text[j - 1].isalnum() or text[j - 1] in "_-"):
        j -= 1
    return text[j:k].lstrip("-").lower(), text[k:at]


def find(text: str) -> list[tuple[int, int]]:
    """Candidate spans in order, none overlapping: values assigned to a secret's name, and matches of ``CANDIDATE``."""
    given = []
    for m in _VALUE.finditer(text):
        if CUES.get(before(text, m.start())[0]) == SECRET:
            given.append((m.start(1), m.start(1) + max(1, len(m.group(1).rstrip(".:!?")))))
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(given) and given[k][1] <= s:
            k += 1
        if k == len(given) or e <= given[k][0]:
            out.append((s, e))
    return sorted(out + given)


def votes(text: str, s: int, e: int, gaz: Gazetteers = GAZETTEERS) -> list[int]:
    """Votes of the labelers on a span (``ABSTAIN`` or a kind), then its shape features."""
    span = text[s:e]
    word, between = before(text, s)
    cue, assign = CUES.get(word), _ASSIGN.search(between) is not None
    digits = _NO_DIGIT.sub("", span)
    n, at, plus = len(digits), "@" in span, span.startswith("+")
    quads = _QUADS.fullmatch(span) is not None
    colons = span.count(":") >= 2
    is_ip = False
    if quads or colons:
        try:
            is_ip = bool(ipaddress.ip_address(span if colons else ".".join(str(int(x)) for x in span.split("."))))
        except ValueError:
            pass
    numeric = _NUMERIC.fullmatch(span) is not None
    account = span.replace(" ", "") if _ACCOUNT.fullmatch(span) else ""
    is_account = bool(account) and _checks(account)
    long_token = len(span) >= 20 and not at and not numeric and not colons and not is_account
    hexish = _HEX.fullmatch(span) is not None
    mixed = long_token and 0 < n < len(span)
    plain = _WORD.fullmatch(span) is not None and not (not span.islower() and not span.istitle() and not span.isupper())
    grouped = numeric and _GROUP.search(span) is not None
    other = not (numeric or at or long_token or colons)
    named = at and not gaz.names.isdisjoint(re.split(r"[^a-z]+", span.split("@")[0].lower()))
    v = [
        EMAIL if at else (NONE if numeric or long_token else ABSTAIN),
        PHONE if numeric and not quads and 9 <= n <= 15 and (plus or grouped) else (NONE if not other and (at or long_token or colons or n < 7) else ABSTAIN),
        IP if is_ip else (NONE if not other and not quads else ABSTAIN),
        CARD if numeric and 13 <= n <= 19 and not plus and "(" not in span and not quads else (NONE if not other and n < 12 else ABSTAIN),
        SECRET if mixed and (hexish or n >= 4) else (NONE if numeric or at or colons else ABSTAIN),
        IBAN if is_account else (NONE if account else ABSTAIN),
        EMAIL if at and span.rsplit(".", 1)[-1].lower() in gaz.domains else ABSTAIN,
        EMAIL if named else ABSTAIN,
        PHONE if plus and 9 <= n <= 15 and any(digits[:k] in gaz.calling for k in (1, 2, 3)) else ABSTAIN,
        CARD if numeric and luhn(digits) and any((digits[:k], n) in gaz.issuers for k in (1, 2, 3, 4)) else ABSTAIN,
        IBAN if account and (account[:2], len(account)) in gaz.accounts else ABSTAIN,
        cue if cue is not None else ABSTAIN,
        SECRET if assign and (long_token or cue == SECRET and not numeric and not plain and not at) else ABSTAIN,
        NONE if numeric and n < 7 and not is_ip else ABSTAIN,
        NONE if plain and len(span) < 20 else ABSTAIN,
    ]
    shape = [int(at), int(is_ip), int(numeric), min(n, 20), int(plus), int(grouped), int(hexish), int(mixed), int(assign), min(len(span) // 8, 8)]
    return v + shape


def _may_hold(text: Column) -> Column:
    """Whether a text can hold a candidate; told in the JVM, so that Python reads no other."""
    return text.rlike(_PLAIN) | ((F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & text.rlike(_SIGNED))


def candidates(docs: DataFrame, gaz: Gazetteers = GAZETTEERS) -> DataFrame:
    """(doc_id, begin, end, pattern) of each candidate, of rows with a null id too; pattern: its votes and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            rows, begins, ends, patterns = [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for s, e in find(t):
                    rows.append(i), begins.append(s), ends.append(e), patterns.append(votes(t, s, e, gaz))
            ids = b.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(patterns, pa.list_(pa.int32()))], ["doc_id", "begin", "end", "pattern"])

    rows = docs.select("doc_id", "text").where(_may_hold(F.col("text")))
    return rows.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, begin int, end int, pattern array<int>")


def reliabilities(v: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dawid-Skene over vote patterns: class prior, confusion (labeler, class, vote) and posterior of each pattern.

    It starts from the majority of the votes, so classes keep their names; a "none" counts
    less the more votes for a kind there are, as most say only that a pattern does not match.
    """
    k, n = len(KINDS), v.shape[1]
    post = np.full((len(v), k), 0.01)
    for c in range(1, k):
        post[:, c] += (v == c).sum(1)
    post[:, 0] += 0.4 * (v == 0).sum(1) / (1 + (v > 0).sum(1))
    post /= post.sum(1, keepdims=True)
    prior = conf = np.zeros(0)
    can = np.stack([(v == c).any(0) for c in range(k)], 1)  # a labeler that votes for a kind is taken to be right, until candidates say otherwise
    for _ in range(rounds):
        w = post * count[:, None]
        prior = (w.sum(0) + 1) / (w.sum() + k)
        conf = np.full((n, k, k + 1), 0.1)  # the last vote: abstain
        for j in range(n):
            np.add.at(conf[j].T, v[:, j], w)  # row -1: abstain
        conf[np.arange(n)[:, None], np.arange(k), np.arange(k)] += RIGHT * can
        conf /= conf.sum(2, keepdims=True)
        logp = np.log(prior) + sum(np.log(conf[j][:, v[:, j]]).T for j in range(n))
        new = np.exp(logp - logp.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done, post = np.abs(new - post).max(initial=0) < 1e-6, new
        if done:
            break
    return prior, conf, post


def _design(p: np.ndarray) -> np.ndarray:
    """One-hot votes, shape flags and digit-count buckets of patterns."""
    n = len(LABELERS)
    hot = (p[:, :n, None] == np.arange(-1, len(KINDS))).reshape(len(p), -1)
    f = p[:, n:]
    wide = [f[:, [0, 1, 2, 4, 5, 6, 7, 8]], f[:, 3:4] == np.arange(21), f[:, 9:10] == np.arange(9), np.ones((len(p), 1))]
    return np.concatenate([hot, *wide], 1).astype(float)


def train(p: np.ndarray, post: np.ndarray, count: np.ndarray, steps: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a multinomial logistic classifier fitted to the posteriors."""
    x, w = _design(p), np.sqrt(count) / np.sqrt(count).sum()
    theta, seen = np.zeros((x.shape[1], len(KINDS))), np.full((x.shape[1], len(KINDS)), 1e-8)
    for _ in range(steps):
        z = x @ theta
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        g = x.T @ ((q - post) * w[:, None]) + ridge * theta
        seen += g * g
        theta -= rate * g / np.sqrt(seen)
    return theta


def decisions(found: DataFrame) -> list[tuple[list[int], str, float]]:
    """(pattern, kind, confidence) of the candidates' patterns decided to be personal data or a secret."""
    counted: list[Row] = found.groupBy("pattern").count().orderBy("pattern").collect()
    if not counted:
        return []
    p, count = np.array([r["pattern"] for r in counted]), np.array([r["count"] for r in counted], float)
    _, _, post = reliabilities(p[:, : len(LABELERS)], count)
    z = _design(p) @ train(p, post, count)
    q = np.exp(z - z.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    return [(r["pattern"], KINDS[int(k)], round(float(q[i, k]), 4)) for i, (r, k) in enumerate(zip(counted, q.argmax(1), strict=True)) if k]


def spans(docs: DataFrame, gaz: Gazetteers = GAZETTEERS) -> DataFrame:
    """(doc_id, begin, end, kind, confidence) of every span decided to be personal data or a secret.

    begin and end count characters of the text, which is read whole, of any length, and so
    is what stands before a span.  Labelers, EM and classifier use the candidates of all
    the documents, repeated rows each.  Rows with a null id or text and empty texts have no
    spans here; repeated rows give their spans once; an empty table gives an empty result;
    other columns are ignored.  Ids may be of any type.
    """
    found = materialise(candidates(docs, gaz), "candidates")
    decided = docs.sparkSession.createDataFrame(decisions(found), "pattern array<int>, kind string, confidence double")
    out = found.where("doc_id is not null").join(F.broadcast(decided), "pattern").select("doc_id", "begin", "end", "kind", "confidence").distinct()  # as many rows as patterns
    out = materialise(out, "spans")
    discard(found)
    return out


def redact(docs: DataFrame, gaz: Gazetteers = GAZETTEERS) -> DataFrame:
    """The documents with each decided span replaced by its kind in brackets, n_chars (where there) counted anew; same columns.

    Every row is redacted by its own text, whatever its id: null and repeated ids are no
    matter.  Null and empty texts, and texts of which nothing is replaced, stay as they are.
    """
    kinds = {tuple(p): k for p, k, _ in decisions(candidates(docs, gaz))}

    def put(text: pa.Array) -> pa.Array:
        """The texts that change, as they become; null for the others."""
        new = [None if t is None else _redacted(t, kinds, gaz) for t in text.to_pylist()]
        return pa.array([None if a == b else a for a, b in zip(new, text.to_pylist(), strict=True)], pa.string())

    key = fresh(docs, "__text")
    out = docs.withColumn(key, F.arrow_udf(put, "string")(F.when(_may_hold(F.col("text")), F.col("text"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(key).isNull(), F.col("n_chars")).otherwise(F.length(key).cast(docs.schema["n_chars"].dataType)))
    return out.withColumn("text", F.coalesce(key, "text")).select(*docs.columns)


def _redacted(text: str, kinds: dict[tuple[int, ...], str], gaz: Gazetteers = GAZETTEERS) -> str:
    out, at = [], 0
    for s, e in find(text):
        kind = kinds.get(tuple(votes(text, s, e, gaz)))
        if kind:
            out += [text[at:s], f"[{kind}]"]
            at = e
    return "".join([*out, text[at:]]) if out else text


def op8(spark, sf_dir: str) -> DataFrame:
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
