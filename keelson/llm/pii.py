"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Five steps per text, each linear in its length: a pattern proposes spans; a validator (Luhn for cards, mod-97 for
IBANs, octet and digit-count rules, issuing rules for social security numbers) confirms or drops each one; words
within ``CONTEXT_CHARS`` on either side raise or lower the score; spans under ``min_score`` go, and an added span
that overlaps a base span goes.

Base kinds (``email ip card phone``) score 1 and are never dropped by context. The added kinds need a checksum
(``iban``) or a context word (``ssn``, ``phone_local``).

Every unbounded class run is matched possessively and only from its first character, so long digit runs or
address-like junk cost linear time. An IBAN candidate tries one end, or at most 20 of at most 34 characters.

Defined cases: a null text counts as empty; an empty text has no spans; repeated rows give repeated results; extra
input columns are ignored by ``find_pii`` and kept by ``mask_pii``. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import bounded_batches, enter_task, sha256_hex, string_array

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "phone_local")
KINDS = BASE_KINDS + ADDED_KINDS
_ORDER = {k: i for i, k in enumerate(KINDS)}
CONTEXT_CHARS = 40
MIN_SCORE = 0.6

_LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
# what follows, by its number of characters; at most 30
_IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])") for n in range(11, 31)}
_IBAN_LENGTH = {c: int(x[:2]) for x in (
    "15 NO", "16 BE", "18 DK FI FK FO GL NL SD", "19 MK SI", "20 AT BA EE KZ LT LU MN XK", "21 CH HR LI LV",
    "22 BG BH CR DE GB GE IE ME RS VA", "23 AE GI IL IQ OM SO TL", "24 AD CZ ES MD PK RO SA SE SK TN VG",
    "25 LY PT ST", "26 IS TR", "27 BI DJ FR GR IT MC MR SM", "28 AL AZ BY CY DO GT HN HU LB NI PL SV", "29 BR EG PS QA UA",
    "30 JO KW MU YE", "31 MT SC", "32 LC", "33 RU") for c in x[3:].split()}
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

CONTEXT = {
    "iban": (re.compile(r"\b(?:iban|bank|account|konto|compte|cuenta)\b", re.I), None),
    "ssn": (re.compile(r"\b(?:ssn|social|security)\b", re.I), re.compile(r"\b(?:order|invoice|part|isbn)\b", re.I)),
    "phone_local": (re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|cell)\b", re.I),
                    re.compile(r"\b(?:order|invoice|part|isbn|version)\b", re.I)),
}
PRIOR = {"iban": 0.7, "ssn": 0.4, "phone_local": 0.4}


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i & 1:
            d *= 2
            if d > 9:
                d -= 9
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    rest = 0
    for ch in s[4:] + s[:4]:
        rest = (rest * (10 if ch.isdigit() else 100) + int(ch, 36)) % 97
    return rest == 1


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost matches, found from each ``@``: the local part is the run of local characters before
    it, cut at the previous match's end."""
    done = 0       # end of the previous match
    seen = 0       # just after the previous @
    at = t.find("@")
    while at >= 0:
        left = max(done, seen)
        run = t[left:at]
        start = left + len(run.rstrip(_LOCAL_CHARS))
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            done = m.end()
            yield start, done
        seen = at + 1
        at = t.find("@", at + 1)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four base kinds, leftmost and non-overlapping within each kind."""
    out = []
    if "@" in t:
        out += [(s, e, "email") for s, e in _emails(t)]
    if _DIGIT.search(t):
        for m in _IP.finditer(t):
            if all(map(_octet, m[0].split("."))):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda x: (x[0], _ORDER[x[2]]))
    return out


def _ibans(t: str) -> Iterator[tuple[int, int]]:
    """The country's length decides where an IBAN ends, not what follows it. Codes of no known country: the longest end
    whose checksum holds."""
    done = 0
    for m in _IBAN.finditer(t):
        if m.start() < done:
            continue
        known = _IBAN_LENGTH.get(m[0][:2])
        for n in (known - 4,) if known else range(30, 10, -1):
            rest = _IBAN_REST[n].match(t, m.end())
            if rest and mod97(t[m.start():rest.end()]):
                done = rest.end()
                yield m.start(), done
                break


def _added(t: str) -> Iterator[tuple[int, int, str]]:
    if not _DIGIT.search(t):
        return
    yield from ((s, e, "iban") for s, e in _ibans(t))
    for m in _SSN.finditer(t):
        if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000":
            yield m.start(), m.end(), "ssn"
    for m in _PHONE_LOCAL.finditer(t):
        yield m.start(), m.end(), "phone_local"


def _score(t: str, start: int, end: int, kind: str) -> float:
    near = t[max(0, start - CONTEXT_CHARS):start] + " " + t[end:end + CONTEXT_CHARS]
    up, down = CONTEXT[kind]
    s = PRIOR[kind]
    if up.search(near):
        s += 0.3
    if down is not None and down.search(near):
        s -= 0.3
    return round(s, 3)


def all_spans(t: str, min_score: float = MIN_SCORE) -> list[tuple[int, int, str, float]]:
    """Base spans (score 1) and the added spans that reach ``min_score`` and overlap no base span, in order."""
    base = base_spans(t)
    out = [(s, e, k, 1.0) for s, e, k in base]
    taken = sorted((s, e) for s, e, _ in base)
    reach = []          # running maximum of ends, for the overlap test by bisection
    for _, e in taken:
        reach.append(max(e, reach[-1]) if reach else e)
    from bisect import bisect_left
    for s, e, k in _added(t):
        i = bisect_left(taken, (e, -1))
        if i and reach[i - 1] > s:
            continue
        sc = _score(t, s, e, k)
        if sc >= min_score:
            out.append((s, e, k, sc))
    out.sort(key=lambda x: (x[0], _ORDER[x[2]], x[1]))
    return out


SPAN_DDL = "array<struct<start:int,end:int,kind:string,score:double>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document: the id and its spans. Map-only: nothing is shuffled."""
    src = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()),
                                    ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            rows = [[dict(zip(("start", "end", "kind", "score"), x)) for x in all_spans(t.as_py(), min_score)]
                    for t in string_array(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, span_type)], ["doc_id", "spans"])

    ddl = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {ddl}, spans {SPAN_DDL}")


def _mask(t: str, min_score: float) -> str:
    spans = all_spans(t, min_score)
    if not spans:
        return t
    out, done = [], 0
    for s, e, k, _ in spans:
        if s < done:            # overlapping kinds: one placeholder covers the union
            done = max(done, e)
            continue
        out += [t[done:s], f"<{k.upper()}>"]
        done = e
    out.append(t[done:])
    return "".join(out)


def mask_pii(docs: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Every row of ``docs`` with each span of its text replaced by ``<KIND>`` (a null text stays null);
    overlapping spans become the first one's placeholder. All other columns are unchanged."""

    def run(batches):
        enter_task("pii")
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = [None if t is None else _mask(t, min_score) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                 x["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_pii``'s rows: n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    counts = [_count(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def empty_digest() -> str:
    return sha256_hex(b"")
