"""PII: format-preserving Feistel pseudonyms.

Values that pass validation (card numbers by Luhn's rule, account numbers by their remainder of 97,
dates by the calendar, addresses by their ranges, social security numbers by those never given out) are
permuted within their format by a keyed Feistel network with cycle walking, after their
separators are taken out (a pseudonym that fails its rule is permuted again); the same key thus gives equal values equal pseudonyms in all documents.
Pseudonyms keep length, letter case, separators, script, the check digits' validity and the calendar's; values
that differ in letter case alone stay linked. Values that fail validation stay as they are, and what begins within
them is tried. Days of 1900 to 2099 stay within these years, all others without them. A dotted number after
"version" or "v" is no address.
Secrets (access keys, tokens, passwords) are permuted over their own alphabet in the same way."""

from __future__ import annotations

import datetime
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

ROUNDS = 10
#: Fixed patterns of the formats that are looked for.
EMAIL = r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9.\-]{0,252}[A-Za-z0-9])?\.[A-Za-z]{2,24})"
#: What stands before a secret: name=value, name = "value", "name": "value", name: value.
NAMED = r"(?i:(?:password|passwd|secret|token|api_key)(?:=[\"']?| ?= ?[\"']|[\"'] ?: ?[\"'])|(?:password|passwd|token|api_key): ?[\"']?|(?<=key = \"))"
SECRET = rf"(?:(?<![A-Za-z0-9])(?=A[KS]IA[A-Z0-9]{{16}}(?![A-Za-z0-9]))|{NAMED})(?P<secret>(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![A-Za-z0-9])|[A-Za-z0-9_\-]{{8,128}})"
DATE = r"(?P<date>(?<![\d\-/.])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d\-/]))"
ADDRESS = r"(?P<ip>(?<![\d.])(?<![vV])(?<![vV]ersion )(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d))"
SSN = r"(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
PHONE = r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{3}[ .\-])\d{3,4}[ .\-]\d{4}(?!\d)|(?<![\w+])\+\d{8,15}(?!\d))"
CARD = r"(?P<card>(?<![\d\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\d\-]))"
IBAN = r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))"
FORMATS = dict(email=EMAIL, secret=SECRET, iban=IBAN, date=DATE, ip=ADDRESS, ssn=SSN, phone=PHONE, card=CARD)
FOUND = re.compile("|".join(FORMATS.values()))
ONE = {kind: re.compile(p) for kind, p in FORMATS.items()}
#: A line with a match of FOUND holds one of these.
HINT = re.compile(r"[\d@]|password|passwd|secret|token|key|AKIA|ASIA", re.I)
FIRST, DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # 1900-01-01 to 2099-12-31, which stay among themselves


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def remainder(account: str) -> int:
    """Of 97, of an account number whose letters count as 10 to 35, its head of four last."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def cased(shape: str, s: str) -> str:
    return "".join(c.upper() if o.isupper() else c for o, c in zip(shape, s))


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): Feistel over a square that holds it, walked back into the range."""
    side = max(2, math.isqrt(size - 1) + 1)
    long = side.bit_length() // 8 + 9
    while True:
        a, b = divmod(x, side)
        for r in range(ROUNDS):
            f = hashlib.shake_256(key + f"{tweak}|{size}|{r}|{b}".encode()).digest(long)
            a, b = b, (a + int.from_bytes(f)) % side
        x = a * side + b
        if x < size:
            return x


def mixed(s: str, key: bytes, tweak: str) -> str:
    """s with its letters and digits permuted, each within its own alphabet; other characters stay."""
    sizes = [10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 1 for c in s]
    x, total = 0, 1
    for c, n in zip(s, sizes):
        x, total = x * n + (int(c) if n == 10 else ord(c.lower()) - 97 if n == 26 else 0), total * n
    y, out = permute(x, total, key, tweak) if total > 1 else x, []
    for c, n in zip(reversed(s), reversed(sizes)):
        y, k = divmod(y, n)
        out.append(str(k) if n == 10 else (chr(97 + k).upper() if c.isupper() else chr(97 + k)) if n == 26 else c)
    return "".join(reversed(out))


def refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def other_day(x: int, key: bytes) -> int:
    """The pseudonym of a day's number: of 1900 to 2099 if it is one of these, else of all other years up to 9999."""
    if FIRST <= x < FIRST + DAYS:
        return permute(x - FIRST, DAYS, key, "date") + FIRST
    before = FIRST - 1  # days are numbered from 1
    y = permute(x - 1 if x < FIRST else x - 1 - DAYS, datetime.date.max.toordinal() - DAYS, key, "far date")
    return y + 1 if y < before else y + 1 + DAYS


def issued(digits: str) -> bool:
    """Whether a social security number is one that may be given out."""
    return not (digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000")


def pseudonym(kind: str, s: str, key: bytes) -> str | None:
    """The value's pseudonym, or None where it isn't valid. Digits of other scripts count by their value, and those of the
    pseudonym are of the first one's script."""
    if s.isascii() or not (own := next((c for c in s if c.isdecimal() and not c.isascii()), None)):
        return plain_pseudonym(kind, s, key)
    zero = ord(own) - int(own)
    new = plain_pseudonym(kind, "".join(str(int(c)) if c.isdecimal() else c for c in s), key)
    if new is None:
        return None
    where = [not c.isascii() for c in s] if len(new) == len(s) else [True] * len(new)
    return "".join(chr(zero + int(c)) if at and c.isdigit() else c for c, at in zip(new, where))


def plain_pseudonym(kind: str, s: str, key: bytes) -> str | None:
    digits = "".join(c for c in s if c.isdigit())
    if kind == "email":
        name, _, host = s.partition("@")
        own, _, top = host.rpartition(".")
        return cased(name, mixed(name.lower(), key, "email")) + "@" + cased(own, mixed(own.lower(), key, "host")) + "." + top
    if kind == "iban":
        plain = s.replace(" ", "")
        if not 15 <= len(plain) <= 34 or remainder(plain) != 1:
            return None
        body = mixed(plain[4:].lower(), key, "iban").upper()
        new = iter(plain[:2] + f"{98 - remainder(plain[:2] + '00' + body):02}" + body)
        return "".join(c if c == " " else next(new) for c in s)
    if kind == "ssn":
        if not issued(digits):
            return None
        new = digits
        while not issued(new := f"{permute(int(new), 10**9, key, 'ssn9'):09d}"):  # on to the next that is
            pass
        return refill(s, new)
    if kind == "secret":
        head = s[:4] if s[:4] in ("AKIA", "ASIA") else ""
        return head + mixed(s[len(head) :], key, "secret")
    if kind == "date":
        try:
            if len(s.split(s[4])) == 3 and not s[4].isdigit():
                y, m, d = map(int, re.split(r"\D", s))
                put = lambda v: f"{v.year:04}{s[4]}{v.month:02}{s[4]}{v.day:02}"
            elif s[2] == ".":
                d, m, y = map(int, s.split("."))
                put = lambda v: f"{v.day:02}.{v.month:02}.{v.year:04}"
            else:  # the month first, or second where that alone is a date
                m, d, y = map(int, s.split("/"))
                put = lambda v: f"{v.month:02}/{v.day:02}/{v.year:04}"
                if m > 12:
                    m, d = d, m
                    put = lambda v: f"{v.day:02}/{v.month:02}/{v.year:04}"
            x = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        return put(datetime.date.fromordinal(other_day(x, key)))
    if kind == "ip":
        p = [int(x) for x in s.split(".")]
        if max(p) > 255:
            return None
        y = permute(int.from_bytes(bytes(p)), 1 << 32, key, "ip")
        return ".".join(map(str, y.to_bytes(4)))
    if kind == "card":
        if not luhn(digits):
            return None
        body = f"{permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, f'card{len(digits)}'):0{len(digits) - 1}d}"
        return refill(s, next(body + c for c in "0123456789" if luhn(body + c)))
    lead = re.match(r"\+\d{1,3}(?=[ .\-(])", s)
    keep = sum(map(str.isdigit, lead[0])) if lead else 0
    n = len(digits) - keep
    return refill(s, digits[:keep] + f"{permute(int(digits[keep:]), 10**n, key, f'{kind}{n}'):0{n}d}")


def rewrite(text: str, key: bytes, known: dict) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was found, in the characters of text."""
    spans, out, at, begin = [], [], 0, 0

    def told(kind: str, value: str) -> str | None:
        pair = (kind, value)
        if pair not in known:
            if len(known) > 200_000:
                known.clear()
            known[pair] = pseudonym(kind, value, key)
        return known[pair]

    def valid(m: re.Match, end: int) -> tuple[str, re.Match, str] | None:
        """The match, or one of a later format at its place, that is valid."""
        kinds = list(ONE)
        for kind in kinds[kinds.index(m.lastgroup) :]:
            own = m if kind == m.lastgroup else ONE[kind].match(text, m.start(), end)
            if own and (new := told(kind, own[kind])) is not None:
                return kind, own, new
        return None

    for line in text.split("\n"):
        place, end = begin, begin + len(line)
        if HINT.search(line):
            while m := FOUND.search(text, place, end):
                if got := valid(m, end):
                    kind, own, new = got
                    spans.append((kind, own.start(kind), own.end(kind)))
                    out += [text[at : own.start(kind)], new]
                    at = own.end(kind)
                    place = max(at, m.start() + 1)
                else:  # what begins within it may be valid
                    place = m.start() + 1
        begin = end + 1
    return "".join([*out, text[at:]]) if spans else text, spans


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_found, spans) for every row: one narrow pass, no exchange.

    The key is the caller's secret: with it alone pseudonyms can be told back. Null texts stay null with no
    spans; empty ones stay empty; repeated rows get the same result. Of values that overlap the first counts;
    of those that begin together the first of: address, secret, account, date, IP, SSN, phone, card."""
    if not key:
        raise ValueError("a key is needed")
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        known: dict = {}
        for b in batches:
            got = [(None, []) if t is None else rewrite(t, secret, known) if HINT.search(t) else (t, []) for t in b.column(1).to_pylist()]
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for _, x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, span)], ["doc_id", "text", "n_found", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_rows(rows).mapInArrow(run, "doc_id long, text string, n_found long, spans array<struct<kind string, start int, end int>>")
