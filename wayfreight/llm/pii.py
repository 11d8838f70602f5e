"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wayfreight.llm.common import narrow, sliced

#: Kinds in the order in which spans with the same start are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

#: Words that speak for a kind when they stand within CONTEXT_CHARS of a span.
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "client", "addr"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "debit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte", "transfer"),
    "ssn": ("ssn", "social", "security", "tax"),
}
CONTEXT_CHARS = 48
#: Score of a span by kind before its context; a context word adds CONTEXT_GAIN.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.75, "phone": 0.65, "iban": 0.85, "ssn": 0.3}
CONTEXT_GAIN = 0.25
#: Added kinds are reported from this score on; base kinds always are.
LEAST_SCORE = 0.5

_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: How many characters an account number has in its country (registry of ISO 13616).
_IBAN_LENGTH = {
    code: int(n)
    for n, codes in (
        pair.split(":")
        for pair in (
            "15:NO 16:BE 18:DK,FO,FI,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:HR,LV,LI,CH 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
            "23:AE,IL,IQ,OM,SO,TL,GI 24:AD,CZ,MD,PK,RO,SA,SK,ES,SE,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
            "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for code in codes.split(",")
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    """Whether the digits pass: every second one from the right doubled, digits summed, a multiple of ten."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number without blanks leaves 1 modulo 97, letters counted from ten."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so that a long run of address characters is walked once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        domain = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            free, at = at + 1, text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Whole dotted runs of numbers, taken four parts at a time from the left."""
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() < 7:
            continue
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each place where one may begin: as long as its country has it, if it passes modulo 97.

    The pattern takes words in capitals and digits that follow, so the end of any word inside the match
    may be the number's; for countries that are not listed the longest that passes is taken.
    """
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        at = start + 1  # a number may begin inside a match that is none
        whole = [e for e in range(start + 15, end + 1) if e == end or text[e] == " "]
        sizes = {e: e - start - text.count(" ", start, e) for e in whole}
        fixed = _IBAN_LENGTH.get(text[start : start + 2])
        ends = [e for e in reversed(whole) if sizes[e] >= 15]
        if fixed:
            ends = [e for e in ends if sizes[e] == fixed]
        for e in ends:
            if mod97(text[start:e].replace(" ", "")):
                yield start, e
                at = e
                break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = set(_WORD.findall(near.lower()))
    return min(1.0, PRIOR[kind] + CONTEXT_GAIN * any(w in words for w in CONTEXT_WORDS[kind]))


def find_spans(text: str) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) of all personal data in a text, by start and then kind as listed.

    Spans of one kind do not overlap; spans of two kinds may. An added span inside a base span of
    another kind is not reported.
    """
    found = [(s, "email", e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [(s, "ip", e) for s, e in _ips(text)]
        found += [(s, "card", e) for s, e in _cards(text)]
        found += [(s, "phone", e) for s, e in _phones(text)]
        base = sorted((s, e) for s, _, e in found)
        for kind, spans in (("iban", _ibans(text)), ("ssn", _ssns(text))):
            found += [(s, kind, e) for s, e in spans if not any(a <= s and e <= b for a, b in base)]
    scored = [(s, kind, e, _score(text, kind, s, e)) for s, kind, e in found]
    kept = [x for x in scored if x[1] in BASE_KINDS or x[3] >= LEAST_SCORE]
    return sorted(kept, key=lambda x: (x[0], KINDS.index(x[1])))


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in sliced(batches, "text"):
        counts = {k: [] for k in BASE_KINDS}
        digests, joined, scores = [], [], []
        for text in batch.column("text").to_pylist():
            spans = find_spans(text or "")
            base = [f"{k}:{s}:{e}" for s, k, e, _ in spans if k in BASE_KINDS]
            for k in BASE_KINDS:
                counts[k].append(sum(x[1] == k for x in spans))
            digests.append(hashlib.sha256(",".join(base).encode()).hexdigest())
            joined.append(",".join(f"{k}:{s}:{e}" for s, k, e, _ in spans))
            scores.append([round(x[3], 4) for x in spans])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS),
                pa.array(digests, pa.string()),
                pa.array(joined, pa.string()),
                pa.array(scores, pa.list_(pa.float64())),
            ],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"],
        )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and their scores for every whole text.

    Each kind takes the leftmost non-overlapping matches of its pattern and drops those whose check
    fails (octets up to 255, Luhn, 9 to 15 digits), without trying again inside. The searches are
    written so that long runs of digits or address characters cost no more than their length. Added
    kinds: account numbers of their country's length confirmed modulo 97, which other words may follow, and social security numbers, which only words nearby
    lift above the threshold. Offsets count code points.

    Defined cases: a null text is empty and has no spans (the digest is that of the empty string); a
    null id stays null; repeated rows repeat; an empty table gives an empty result; other columns are not
    looked at.
    """
    schema = (
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        "base_sha256 string, spans string, scores array<double>"
    )
    return narrow(docs, id_col, text_col).mapInArrow(_find_batches, schema)
