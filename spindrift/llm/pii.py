"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

A span's score starts from its kind, rises by a word on either side that speaks for the kind and falls by one that speaks
against it. Spans that are ambiguous by themselves (card numbers of 13 to 15 digits, telephone numbers without a
country) start below the threshold and need such a word; an account number loses its place by a word against it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import text_or_empty

# Patterns of the span kinds.
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of a country's account numbers, without spaces.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
DIGIT = re.compile(r"[0-9]")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)[ -]?)?[0-9]{2,5}(?:[ ./-][0-9]{2,5}){1,4}(?![0-9A-Za-z])")
DATE = re.compile(r"[12][0-9]{3}([./-])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\2[12][0-9]{3}")
KINDS = ("email", "ip", "card", "phone", "iban", "short_card", "local_phone")
BASE_KINDS = KINDS[:4]
_ACCOUNT = "iban account bank konto compte cuenta"
_CARD = "card visa mastercard amex credit debit payment karte carte tarjeta"
_PHONE = "phone telephone tel mobile call fax telefon téléphone teléfono handy"
#: Words near a span that speak for its kind, and such that speak against it.
FOR = {"email": "mail email contact write", "ip": "ip host server address", "card": _CARD, "phone": _PHONE, "iban": _ACCOUNT, "short_card": _CARD, "local_phone": _PHONE}
_NUMBERED = "version release invoice isbn issn serial tracking article"
AGAINST = {"email": "", "ip": "version release build firmware chapter section", "card": _NUMBERED, "phone": _NUMBERED, "iban": _NUMBERED, "short_card": _NUMBERED, "local_phone": _NUMBERED}
_WORDS = {kind: [re.compile(rf"(?<!\w)(?:{'|'.join(words[kind].split())})(?!\w)") if words[kind] else None for words in (FOR, AGAINST)] for kind in KINDS}
#: Score of a proposed span before its context is read, what a word for it adds, what one against it takes. A word
#: against it does not bring an address or a number that its form or checksum tells under the usual threshold of one half.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.8, "iban": 0.7, "short_card": 0.4, "local_phone": 0.4}
GAIN, LOSS = 0.2, 0.3

SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Only an @ can end a local part, so each @ is tried with the run of local characters before it: one pass, however long the runs."""
    end = 0
    at = text.find("@")
    while at >= 0:
        if at >= end:
            before = text[end:at]
            start = end + len(before.rstrip(LOCAL_CHARS))
            domain = DOMAIN.match(text, at + 1)
            if start < at and domain:
                end = domain.end()
                yield start, end
            else:
                end = at + 1
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= len(DIGIT.findall(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each match, the words' end that mod 97 confirms: first where the country's length ends, then the last one; if none, the next start is tried."""
    m = IBAN.search(text)
    while m:
        plain, end, ends = "", m.start() - 1, []
        for word in m[0].split(" "):
            plain, end = plain + word, end + 1 + len(word)
            if 15 <= len(plain) <= 34:
                ends.append((len(plain) == IBAN_LENGTHS.get(plain[:2]), end, plain))
        found = next((e for _, e, p in sorted(ends, reverse=True) if mod97(p)), None)
        if found:
            yield m.start(), found
        m = IBAN.search(text, found or m.start() + 1)


def _short_cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 15 and luhn(digits):
            yield m.span()


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in LOCAL_PHONE.finditer(text):
        if 7 <= len(DIGIT.findall(m[0])) <= 12 and not DATE.fullmatch(m[0]):
            yield m.span()


def score(kind: str, text: str, start: int, end: int, reach: int = 40) -> float:
    """Of a span: by its kind and the words within ``reach`` characters on either side."""
    near = f"{text[max(0, start - reach) : start]} \n {text[end : end + reach]}".lower()
    speaks_for, against = ((p is not None and p.search(near) is not None) for p in _WORDS[kind])
    return round(START[kind] + GAIN * speaks_for - LOSS * against, 3)


SEARCHES = dict(zip(KINDS, (_emails, _ips, _cards, _phones, _ibans, _short_cards, _local_phones)))


def spans_of(text: str, reach: int = 40) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind as listed in KINDS, then by start; code points, end exclusive. Added kinds leave out what meets a span found before."""
    found: list[tuple[str, int, int, float, bool]] = []
    digits = DIGIT.search(text) is not None
    for kind, search in SEARCHES.items():
        if ("@" in text) if kind == "email" else ("+" in text and digits) if kind == "phone" else digits:
            base = kind in BASE_KINDS
            taken = sorted((s, e) for _, s, e, *_ in found)
            ends = list(accumulate((e for _, e in taken), max))
            for start, end in search(text):
                # A span meets an earlier one if the furthest end of those that start before its own end lies behind its start.
                at = bisect_left(taken, (end,))
                if base or not at or ends[at - 1] <= start:
                    found.append((kind, start, end, score(kind, text, start, end, reach), base))
    return found


def detect(docs: DataFrame, min_score: float = 0.5, reach: int = 40) -> DataFrame:
    """(doc_id, text, spans): every span of the whole text, one row per input row.

    Spans of the base kinds (email, ip, card, phone) are always returned, with their scores; those of the added kinds
    (iban, short_card, local_phone) only from ``min_score`` on. A null text is empty. Rows that repeat stay apart;
    other columns are left out. No row is moved between tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
        names = ("kind", "start", "end", "score", "base")
        for batch in batches:
            spans = [[dict(zip(names, s)) for s in spans_of(t.as_py(), reach) if s[4] or s[3] >= min_score] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], ["doc_id", "text", "spans"])

    docs = docs.select("doc_id", text_or_empty().alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, spans {SPAN_TYPE}")


def joined(spans: Column, base_only: bool) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kept = F.filter(spans, lambda s: s["base"]) if base_only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Replace spans by <KIND>; where spans overlap, the one that starts first (then the longer) wins."""
    out, end = [], 0
    for start, stop, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= end:
            out += [text[end:start], f"<{kind.upper()}>"]
            end = stop
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, column: str = "text", min_score: float = 0.5, reach: int = 40) -> DataFrame:
    """The same rows and columns with personal data of ``min_score`` or more replaced by the name of its kind, such as <EMAIL>; a null text stays null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [x if x is None else redact_text(x, [(s, e, k) for k, s, e, sure, _ in spans_of(x, reach) if sure >= min_score]) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if c == column else batch.column(c) for c in names], names)

    return docs.mapInArrow(run, docs.schema)
