"""Pseudonyms for personal numbers: format-preserving keyed permutations.

Values are found by shape and validated (Luhn, ISO 7064, calendar, number plans).
The value, freed of its separators, is a number below some N; a Feistel network
over the bits of N with keyed BLAKE2 rounds, walked until it lands below N and on
a valid value, permutes it; the result is written back into the same separators.
Equal values get equal pseudonyms in every document and format, different values
get different ones, and only the key's holder can tell or reverse them.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: Texts of a batch are handled so many at a time, which bounds what a task holds besides the batch.
SLICE = 256
#: The days that are permuted among themselves, English month names, lengths of IBANs.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
MONTHS = "January February March April May June July August September October November December".split()
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}

_MONTH = "|".join(m if len(m) < 4 else f"{m}|{m[:3]}" for m in MONTHS)
PATTERN = re.compile(
    rf"""
    (?P<email>(?<![\w.+%-])[A-Za-z0-9_.+%-]{{1,64}}@(?:[A-Za-z0-9-]{{1,63}}\.){{1,8}}[A-Za-z]{{2,24}}(?![\w-]))
  | (?P<iban>(?<!\w)[A-Z]{{2}}\d{{2}}(?:\ ?[A-Z0-9]{{4}}){{2,7}}(?:\ ?[A-Z0-9]{{1,3}})?(?!\w))
  | (?P<date>(?<![\w./-])(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{4}}/\d{{1,2}}/\d{{1,2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{1,2}}-\d{{1,2}}-\d{{4}})(?![\w/-]|\.\d))
  | (?P<wdate>(?<!\w)(?:\d{{1,2}}\ (?:{_MONTH})\ \d{{4}}|(?:{_MONTH})\ \d{{1,2}},\ \d{{4}})(?!\w))
  | (?P<ip>(?<![\w.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?![\w]|\.\d))
  | (?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
  | (?P<card>(?<![\w.-])\d(?:[\ -]?\d){{12,18}}(?![\w]|-\d|\.\d))
  | (?P<phone>(?<![\w.+-])(?:\+\d{{1,3}}[\ .-]?)?(?:\(\d{{2,5}}\)[\ .-]?|\d{{2,5}}[\ .-])\d{{2,5}}(?:[\ .-]\d{{2,5}}){{1,3}}(?!\w|-\d|\.\d)|(?<![\w.+-])\+\d{{1,3}}(?:[\ .-]?\d{{2,12}}|[\ .-]?\(\d{{1,5}}\)){{1,5}}(?!\w|-\d|\.\d))
    """,
    re.VERBOSE | re.ASCII,
)
#: A text with neither a digit nor an at sign holds nothing that PATTERN finds.
HINT = re.compile(r"[0-9@]")
#: What a rejected span gives up before matching goes on.
GROUP = re.compile(r"\W*\w+", re.ASCII)


class Permuter:
    """Keyed permutations of the numbers below any N, one for each N and domain name."""

    def __init__(self, key: bytes):
        self.key = blake2b(key).digest()
        self.permute = lru_cache(1 << 15)(self._permute)

    def _round(self, half: int, i: int, domain: str, bits: int) -> int:
        data = f"{domain}/{i}/{bits}/{half}".encode()
        return int.from_bytes(blake2b(data, key=self.key, digest_size=(bits + 7) // 8).digest(), "big") & ((1 << bits) - 1)

    def _permute(self, value: int, n: int, domain: str) -> int:
        """Balanced Feistel network, walked until the result is below n."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(right, i, f"{domain}/{n}", half)
            value = left << half | right
            if value < n:
                return value

    def walk(self, value: int, n: int, domain: str, valid) -> int:
        """The next valid number on the value's cycle: a permutation of the valid numbers."""
        while True:
            value = self.permute(value, n, domain)
            if valid(value):
                return value


def luhn_digit(digits: str) -> int:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced in order."""
    left = iter(chars)
    return "".join(next(left) if c.isalnum() else c for c in shape)


def _alike(p: Permuter, text: str, domain: str) -> str:
    """Letters to letters of the same case and digits to digits, as one number of mixed radix."""
    value, n, radix = 0, 1, []
    for c in text:
        base = 10 if c.isdigit() else 26 if c.isalpha() else 1
        radix.append(base)
        if base > 1:
            value = value * base + (int(c) if base == 10 else ord(c.lower()) - 97)
            n *= base
    if n == 1:
        return text
    value = p.permute(value, n, domain + "".join("d" if b == 10 else "a" if b == 26 else c for b, c in zip(radix, text)))
    out = []
    for c, base in zip(reversed(text), reversed(radix)):
        if base == 1:
            out.append(c)
            continue
        value, d = divmod(value, base)
        out.append(str(d) if base == 10 else chr(d + (65 if c.isupper() else 97)))
    return "".join(reversed(out))


def _email(p: Permuter, s: str) -> str:
    local, _, host = s.rpartition("@")
    labels = host.split(".")  # the last label stays, and so does the case of each letter
    fold = _alike(p, (local + "@" + ".".join(labels[:-1])).lower(), "email/" + labels[-1].lower())
    kept = local + "@" + ".".join(labels[:-1])
    return "".join(a.upper() if b.isupper() else a for a, b in zip(fold, kept)) + "." + labels[-1]


def _iban(p: Permuter, s: str) -> str | None:
    raw = s.replace(" ", "")
    if IBAN_LENGTHS.get(raw[:2]) != len(raw) or int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 != 1:
        return None
    body = _alike(p, raw[4:], "iban/" + raw[:2])
    check = 98 - int("".join(str(int(c, 36)) for c in body + raw[:2] + "00")) % 97
    return _refill(s, f"{raw[:2]}{check:02d}{body}")


def _iban_inside(p: Permuter, s: str) -> tuple[int, int, str] | None:
    """The number that a span begins with, if it ends at a blank: start, end, pseudonym."""
    length = IBAN_LENGTHS.get(s[:2])
    ends = [i for i, c in enumerate(s, 1) if c != " "]
    if length is None or length >= len(ends) or s[ends[length - 1]] != " ":
        return None
    new = _iban(p, s[: ends[length - 1]])
    return new and (0, ends[length - 1], new)


def _day(y: str, m: str, d: str) -> int | None:
    try:
        day = dt.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    return day if FIRST_DAY <= day <= LAST_DAY else None


def _moved(p: Permuter, day: int) -> dt.date:
    return dt.date.fromordinal(FIRST_DAY + p.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))


def _date(p: Permuter, s: str) -> str | None:
    mark = next(c for c in s if not c.isdigit())
    a, b, c = s.split(mark)
    year_first = len(a) == 4
    forms = [(0, 1, 2)] if year_first else [(2, 0, 1), (2, 1, 0)] if mark == "/" else [(2, 1, 0), (2, 0, 1)]
    for order in forms:
        day = _day(*((a, b, c)[i] for i in order))
        if day is not None:
            new = _moved(p, day)
            parts = ["", "", ""]
            for i, v in zip(order, (new.year, new.month, new.day)):
                parts[i] = str(v).zfill(len((a, b, c)[i]))
            return mark.join(parts)
    return None


def _wdate(p: Permuter, s: str) -> str | None:
    a, b, c = s.replace(",", "").split(" ")
    d, m = (a, b) if a.isdigit() else (b, a)
    month = next(i for i, name in enumerate(MONTHS, 1) if name.startswith(m))
    day = _day(c, str(month), d)
    if day is None:
        return None
    new = _moved(p, day)
    name = MONTHS[new.month - 1] if m in MONTHS else MONTHS[new.month - 1][:3]
    return f"{new.day} {name} {new.year}" if a.isdigit() else f"{name} {new.day}, {new.year}"


def _ip(p: Permuter, s: str) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255:
        return None
    v = p.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def _ssn_ok(v: int) -> bool:
    area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(p: Permuter, s: str) -> str | None:
    v = int(s.replace("-", ""))
    return _refill(s, f"{p.walk(v, 10**9, 'ssn', _ssn_ok):09d}") if _ssn_ok(v) else None


def _card(p: Permuter, s: str) -> str | None:
    digits = re.sub(r"\D", "", s)
    if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    # The first digit names the kind of card and stays.
    body = digits[0] + f"{p.permute(int(digits[1:-1]), 10 ** (len(digits) - 2), 'card' + digits[0]):0{len(digits) - 2}d}"
    return _refill(s, body + str(luhn_digit(body)))


def _card_inside(p: Permuter, s: str) -> tuple[int, int, str] | None:
    """The longest valid number between separators of a span, the first of equals: start, end, pseudonym."""
    groups = [m.span() for m in re.finditer(r"\d+", s)]
    spans = []
    for i, (start, _) in enumerate(groups):
        digits = 0
        for a, b in groups[i:]:
            digits += b - a
            if 13 <= digits <= 19:
                spans.append((-digits, start, b))
    for _, start, end in sorted(spans):
        new = _card(p, s[start:end])
        if new is not None:
            return start, end, new
    return None


def _nanp_ok(v: int) -> bool:
    return v // 10**9 >= 2 and v // 10**6 % 10 >= 2


def _phone(p: Permuter, s: str) -> str | None:
    digits = re.sub(r"\D", "", s)
    if not 9 <= len(digits) <= 15 or ("+" not in s and "(" not in s and len(digits) != 10):
        return None
    nanp = len(digits) == 10 or len(digits) == 11 and digits[0] == "1"
    if nanp and _nanp_ok(int(digits[-10:])):  # with or without the country code: the same subscriber
        return _refill(s, digits[:-10] + f"{p.walk(int(digits[-10:]), 10**10, 'nanp', _nanp_ok):010d}")
    lead = len(re.match(r"\+(\d*)", s)[1]) if s[0] == "+" and not s[1:].isdigit() else 2 if s[0] == "+" else 0
    body = digits[lead:]
    if len(body) < 4:
        return None
    return _refill(s, digits[:lead] + f"{p.permute(int(body), 10 ** len(body), 'phone' + digits[:lead]):0{len(body)}d}")


HANDLERS = {"email": _email, "iban": _iban, "date": _date, "wdate": _wdate, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}
#: Kinds whose spans may take in neighbouring groups: what finds a valid value inside of one.
INSIDE = {"iban": _iban_inside, "card": _card_inside}


def pseudonymise(p: Permuter, text: str) -> tuple[str, dict[str, int]]:
    """The text with every validated value replaced, and how many of each kind there were.

    A span that does not validate is searched for a shorter card number or IBAN between
    its separators; if there is none, matching goes on behind its first group.
    """
    if not HINT.search(text):
        return text, {}
    found: dict[str, int] = {}
    parts, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        kind, (start, end) = m.lastgroup, m.span()
        new = HANDLERS[kind](p, m[0])
        if new is None and kind in INSIDE and (inside := INSIDE[kind](p, m[0])):
            start, end, new = m.start() + inside[0], m.start() + inside[1], inside[2]
        if new is None and kind == "card":  # digits in groups may still be a telephone number
            kind, new = "phone", _phone(p, m[0]) if len(m[0]) > 12 and m[0][0] != "0" and not m[0].isdigit() and len(re.sub(r"\D", "", m[0])) <= 13 else None
        if new is None:
            at = GROUP.match(text, start).end()
            continue
        parts += text[done:start], new
        done = at = end
        kind = "date" if kind == "wdate" else kind
        found[kind] = found.get(kind, 0) + 1
    return "".join(parts) + text[done:], found


def pseudonyms(key: str):
    """A function from a column of texts to a column of struct text, n_replaced, kinds; see :func:`apply_pseudonyms`.

    Only the texts go to Python.
    """
    secret = key.encode()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = Permuter(secret)
        for texts in batches:
            parts = []
            for at in range(0, len(texts), SLICE):
                done = [(None, {}) if t is None else pseudonymise(p, t) for t in texts.slice(at, SLICE).to_pylist()]
                columns = [pa.array([t for t, _ in done], pa.string()), pa.array([sum(k.values()) for _, k in done], pa.int32()), pa.array([list(k.items()) for _, k in done], pa.map_(pa.string(), pa.int32()))]
                parts.append(pa.StructArray.from_arrays(columns, names=["text", "n_replaced", "kinds"]))
            yield pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.map_(pa.string(), pa.int32()))], names=["text", "n_replaced", "kinds"])

    # Annotated by name, for annotations of this module are strings.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # So called, a filter on the result does not compute it a second time.
    return F.arrow_udf(run, "text string, n_replaced int, kinds map<string,int>").asNondeterministic()


def apply_pseudonyms(documents: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id alone by default), text with pseudonyms, n_replaced and kinds (map of kind to count).

    Every row is treated on its own: repeated rows and ids, ties and extra columns
    do not matter.  Null text stays null with 0 replaced; an empty text stays empty.
    Whole texts are searched, however long.  No rows: no rows.  Values that do not
    validate are left as they are.  ``keep`` must not name text, n_replaced or kinds.
    """
    names = keep or ["doc_id"]
    new = fresh("new", names)
    return documents.select(*names, pseudonyms(key)("text").alias(new)).select(*names, f"{new}.text", f"{new}.n_replaced", f"{new}.kinds")
