"""Personal data replaced by format-preserving Feistel pseudonyms.

A value is read as a number in mixed radices, one for each letter, digit or
field that may change, and permuted by a keyed Feistel network over just these
radices. So a pseudonym has the value's format and length, equal values get
equal pseudonyms in all documents, and whoever has the key can undo it. Card and
account numbers must have right check digits and get right ones again; dates and
addresses must exist and stay existing ones.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
KINDS = ["email", "card", "phone", "ssn", "iban", "ipv4", "date"]


def _draw(key: bytes, tweak: str, step: int, half: int, below: int) -> int:
    h = hashlib.blake2b(f"{tweak}|{step}|{half}".encode(), key=key[:64], digest_size=16 + (below.bit_length() + 7) // 8)
    return int.from_bytes(h.digest(), "big") % below


def _join(digits: list[int], radices: list[int]) -> int:
    n = 0
    for d, r in zip(digits, radices):
        n = n * r + d
    return n


def _cut(n: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        n, d = divmod(n, r)
        out.append(d)
    return out[::-1]


def permute(digits: list[int], radices: list[int], key: bytes, tweak: str, back: bool = False) -> list[int]:
    """A keyed permutation of the numbers with these radices (back: its inverse). The halves are changed in turn, each by a sum with a hash of the other."""
    half = len(radices) // 2
    ra, rb = radices[:half], radices[half:]
    ma, mb = prod(ra), prod(rb)
    a, b = _join(digits[:half], ra), _join(digits[half:], rb)
    tweak = f"{tweak}|{','.join(map(str, radices))}"
    sign = -1 if back else 1
    for step in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        if step % 2 and half:
            a = (a + sign * _draw(key, tweak, step, b, ma)) % ma
        else:
            b = (b + sign * _draw(key, tweak, step, a, mb)) % mb
    return _cut(a, ra) + _cut(b, rb)


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_SETS = {c: s for s in (_LOWER, _UPPER, _DIGIT) for c in s}


def permute_text(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """ASCII letters and digits change within their kind and place; all else stays."""
    at = [i for i, c in enumerate(text) if c in _SETS]
    if not at:
        return text
    sets = [_SETS[text[i]] for i in at]
    new = permute([s.index(text[i]) for s, i in zip(sets, at)], [len(s) for s in sets], key, tweak, back)
    out = list(text)
    for i, s, d in zip(at, sets, new):
        out[i] = s[d]
    return "".join(out)


def _refill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in _DIGIT else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGIT)


def luhn_sum(digits: str) -> int:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def card(text: str, key: bytes, back: bool = False) -> str | None:
    """13 to 19 digits with a right check digit; the first digit stays."""
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn_sum(d) or len(set(d)) == 1:
        return None
    body = d[0] + permute_text(d[1:-1], key, f"card{d[0]}", back)
    return _refill(text, body + str(-luhn_sum(body + "0") % 10))


#: Country codes of one and two digits (fixed values); all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone(text: str, key: bytes, back: bool = False) -> str | None:
    """8 to 15 digits. A country code after + stays, with or without a mark behind it; ten digits without one are those of country 1."""
    d = _digits(text)
    if not 8 <= len(d) <= 15:
        return None
    n = next((i for i in (1, 2) if d[:i] in SHORT_CODES), 3) if text.startswith("+") else 0
    code = d[:n] or ("1" if len(d) == 10 else "")
    return _refill(text, d[:n] + permute_text(d[n:], key, f"phone{code}", back))


def ssn(text: str, key: bytes, back: bool = False) -> str | None:
    """Three numbers within the ranges that are given out."""
    a, b, c = (int(x) for x in text.split("-"))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    a, b, c = permute([a - 1 - (a > 666), b - 1, c - 1], [898, 99, 9999], key, "ssn", back)
    return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"


def _iban_rest(bare: str) -> int:
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def iban(text: str, key: bytes, back: bool = False) -> str | None:
    """Country, two right check digits and 11 to 30 signs. The country stays."""
    bare = text.replace(" ", "")
    if not 15 <= len(bare) <= 34 or _iban_rest(bare) != 1:
        return None
    body = permute_text(bare[4:], key, f"iban{bare[:2]}", back)
    new = bare[:2] + f"{98 - _iban_rest(bare[:2] + '00' + body):02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


_OCTETS = [(0, 9), (10, 99), (100, 255)]


def ipv4(text: str, key: bytes, back: bool = False) -> str | None:
    """Four numbers up to 255; each keeps its length."""
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    ranges = [_OCTETS[len(p) - 1] for p in parts]
    new = permute([int(p) - lo for p, (lo, _) in zip(parts, ranges)], [hi - lo + 1 for lo, hi in ranges], key, "ipv4", back)
    return ".".join(str(d + lo) for d, (lo, _) in zip(new, ranges))


def a_date(text: str, key: bytes, back: bool = False) -> str | None:
    """yyyy-mm-dd, or day and month in two digits before the year, with the day first if that exists.

    Days of two centuries are permuted, the same way in all formats. Days of
    the month up to 12 and above stay among themselves, so that a pseudonym is
    read in the order in which it was written.
    """
    f = [int(x) for x in re.split(r"[-./]", text)]
    for order in [(0, 1, 2)] if text[4:5] in "-./" else [(2, 1, 0), (2, 0, 1)]:
        try:
            day = date(*(f[i] for i in order))
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        span, n = (LAST_DAY - FIRST_DAY).days + 1, (day - FIRST_DAY).days
        new = None
        while new is None or (new.day <= 12) != (day.day <= 12):
            n = _join(permute(_cut(n, [271, 270]), [271, 270], key, "date", back), [271, 270])
            new = FIRST_DAY + timedelta(n) if n < span else None
        values = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:02d}", order[2]: f"{new.day:02d}"}
        marks = re.findall(r"[-./]", text)
        return values[0] + marks[0] + values[1] + marks[1] + values[2]
    return None


def email(text: str, key: bytes, back: bool = False) -> str | None:
    """The name and the host but for its last label."""
    head, _, top = text.rpartition(".")
    return permute_text(head, key, f"email.{top.lower()}", back) + "." + top


FINDERS: list[tuple[str, str, Callable]] = [
    ("date", r"(?<![\w.+-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})(?!(?!T\d)[\w-]|[./]\d)", a_date),
    ("ipv4", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)", ipv4),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    ("card", r"(?<![\w-])\d(?:[ -]?\d){12,}(?![\w-])", card),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])", phone),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", iban),
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])", email),
]
_NUMBERS = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in FINDERS if k not in ("card", "iban", "email")))
_CARD_RUN = re.compile(FINDERS[3][1])
_IBAN = re.compile(FINDERS[5][1])
_EMAIL = re.compile(FINDERS[6][1])
_MAKE = {k: f for k, _, f in FINDERS}
#: Quick scans for where a value may stand; the patterns above look only there.
_DIGIT_ZONE = re.compile(r"[+(]?[0-9][0-9 ().+/-]{5,}[0-9]")
_IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2}")
_SPACE = re.compile(r"\s")
_GROUP = re.compile(r"\d+")
#: Lengths of the digit groups that cards are printed in; these go before other parts of a run of digits.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}
IBAN_LENGTHS = {
    k: int(n)
    for n, of in (x.split(":") for x in "15:NO 16:BE 18:DK FI FO GL NL 19:MK SI 20:AT BA EE KZ LT LU XK 21:CH HR LI LV 22:BG BH CR DE GB GE IE ME RS VA 23:AE GI IL IQ TL 24:AD CZ ES MD PK RO SA SE SK TN VG 25:LY PT ST 26:IS TR 27:FR GR IT MC MR SM 28:AL AZ BY CY DO GT HU LB PL SV 29:BR EG PS QA UA 30:JO KW MU 31:MT SC 32:LC".replace(" 1", "|1").replace(" 2", "|2").replace(" 3", "|3").split("|"))
    for k in of.split()
}


@lru_cache(50_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    return _MAKE[kind](value, key)


def _iban_places(text: str, start: int, end: int, key: bytes) -> list[tuple[int, int, str, str]]:
    """The account number at start, in text up to end: of its country's length, or else the longest one, that has right check digits."""
    ends, size = [], 0
    for i in range(start, end):
        size += text[i] != " "
        if text[i] != " " and size >= 15 and (i + 1 == end or text[i + 1] == " "):
            ends.append((size != IBAN_LENGTHS.get(text[start : start + 2]), -i, i + 1))
    return next(([(start, e, "iban", text[start:e])] for _, _, e in sorted(ends) if pseudonym("iban", text[start:e], key) is not None), [])


def _card_places(text: str, start: int, end: int, key: bytes, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Cards in a run of digit groups, outside of what is taken: whole groups in the usual lengths first, then the most digits."""
    groups, valid = [m.span() for m in _GROUP.finditer(text, start, end)], []
    for i, (a, _) in enumerate(groups):
        sizes: tuple[int, ...] = ()
        for c, b in groups[i : i + 19]:
            sizes += (b - c,)
            if sum(sizes) > 19:
                break
            if sum(sizes) >= 13 and pseudonym("card", text[a:b], key) is not None:
                valid.append((len(sizes) > 1 and sizes not in CARD_GROUPS, -sum(sizes), a, b))
    out: list[tuple[int, int]] = []
    for _, _, a, b in sorted(valid):
        # both lists are in order and without overlaps
        if all((i := bisect_left(x, (b,))) == 0 or x[i - 1][1] <= a for x in (taken, out)):
            insort(out, (a, b))
    return out


def mask(text: str, key: bytes) -> tuple[str, dict[str, int], list[tuple[str, int, int]]]:
    """(text with pseudonyms, number of each kind, (kind, start, end) of what was replaced)."""
    found: list[tuple[int, int, str, str]] = []
    places, at, last = [], text.find("@"), 0
    while at >= 0:
        first = max(last, max(text.rfind(c, last, at) for c in " \n\t") + 1)
        last = m.start() if (m := _SPACE.search(text, at)) else len(text)
        places += [(m.start(), m.end(), "email", m[0]) for m in _EMAIL.finditer(text, first, last)]
        at = text.find("@", last)
    for z in _IBAN_START.finditer(text):
        if m := _IBAN.match(text, z.start()):
            places += _iban_places(text, m.start(), m.end(), key)
    runs = []
    for z in _DIGIT_ZONE.finditer(text):
        zone = z.start(), min(len(text), z.end() + 2)
        places += [(m.start(), m.end(), m.lastgroup, m[0]) for m in _NUMBERS.finditer(text, *zone) if m.end() <= z.end()]
        runs += [m.span() for m in _CARD_RUN.finditer(text, *zone) if m.end() <= z.end()]
    end = 0
    for a, b, kind, value in sorted(places, key=lambda p: (p[0], -p[1])):
        if a >= end and (new := pseudonym(kind, value, key)) is not None:
            found.append((a, b, kind, new))
            end = b
    taken = [(a, b) for a, b, _, _ in found]
    found += [(a, b, "card", pseudonym("card", text[a:b], key)) for run in runs for a, b in _card_places(text, *run, key, taken)]
    found.sort()
    out, at, counts = [], 0, dict.fromkeys(KINDS, 0)
    for a, b, kind, new in found:
        out += [text[at:a], new]
        at = b
        counts[kind] += 1
    return "".join([*out, text[at:]]), counts, [(kind, a, b) for a, b, kind, _ in found]


def pseudonymize(docs: DataFrame, key: bytes, report: bool = False) -> DataFrame:
    """docs with personal data in text replaced, all else unchanged; report adds n_<kind> and spans (kind, start, end).

    A null text stays null and an empty one empty. Every row is handled alone,
    repeated rows alike; no rows give no rows. Values that fail their check stay
    as they are. A column of docs with the name of a report column gives way to
    it.
    """
    extra = [f"n_{k}" for k in KINDS] + ["spans"] if report else []
    docs = docs.drop(*extra)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{n} " + ("array<struct<kind: string, start: int, end: int>>" if n == "spans" else "long") for n in extra])
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                i = part.schema.get_field_index("text")
                done = [None if t is None else mask(t, key) for t in part.column(i).to_pylist()]
                columns = part.columns
                columns[i] = pa.array([None if d is None else d[0] for d in done], part.column(i).type)
                for n in extra:
                    if n == "spans":
                        columns.append(pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in d[2]] if d else [] for d in done], span))
                    else:
                        columns.append(pa.array([d[1][n[2:]] if d else 0 for d in done], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *extra])

    return docs.mapInArrow(run, schema)
