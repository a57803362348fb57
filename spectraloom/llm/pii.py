"""Format-preserving pseudonyms for personal data.

Found values are validated (check digits, calendar, ranges), numbered within their
format and permuted there by a keyed Feistel network: a bijection, so equal values get
equal pseudonyms in every document and unequal ones stay apart.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.llm.textbatch import spread, struct_udf

KINDS = ("email", "iban", "date", "ipv4", "ssn", "card", "phone")
_patterns = (
    ("email", r"[\w.%+-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("date", r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])"),
    ("ipv4", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?[0-9]{3,4}[\x20.-]?[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])"),
)
# E-mail addresses are found from their @, so that long runs of letters and digits are read once.
_others = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _patterns if k != "email"))
_local = re.compile(r"[\w.%+-]*")
_domain = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}")
# Every match of a pattern holds one of these.
_trace = re.compile(r"[0-9]{3}|@|[0-9][\x20./-][0-9]|\+[0-9]|[A-Z]{2}[0-9]{2}")
RESULT = T.StructType([T.StructField("pseudonymised", T.StringType()), T.StructField("spans", T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS]])


def permute(key: bytes, tweak: str, x: int, size: int, rounds: int = 8) -> int:
    """A keyed bijection of range(size): an alternating Feistel network over two near-square halves, walked until it lands inside."""
    if size < 2:
        return x
    width = math.isqrt(size - 1) + 1
    length = (width.bit_length() + 7) // 8
    while True:
        left, right = divmod(x, width)
        for i in range(rounds):
            made = hashlib.blake2b(f"{tweak}|{size}|{i}|".encode() + right.to_bytes(length, "big"), key=key, digest_size=16 + length).digest()
            left, right = right, (left + int.from_bytes(made, "big")) % width
        x = left * width + right
        if x < size:
            return x


def luhn_digit(digits: str) -> str:
    """The check digit that makes `digits` plus it valid."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _refill(shape: str, chars: str) -> str:
    """`shape` with its letters and digits replaced in turn."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _digits(key: bytes, kind: str, digits: str) -> str:
    return str(permute(key, f"{kind}{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits))


def _block(c: str) -> tuple[int, int]:
    """First code point and size of the block of like characters in which `c` is permuted; 0 to keep it."""
    o = ord(c)
    for low, size in ((48, 10), (65, 26), (97, 26), (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8)):
        if low <= o < low + size:
            return low, size
    return (o & ~31, 32) if o >= 0x100 else (o, 0)


#: Characters of a local part that are one number; a longer one is cut, so that numbers stay small.
LOCAL = 64


def _email(key: bytes, value: str) -> str:
    """The local part's letters and digits, as one number in mixed radix for each LOCAL characters."""
    local, _, domain = value.rpartition("@")
    return "".join(_local_part(key, local[i : i + LOCAL], domain + f"|{i}" * (i > 0)) for i in range(0, len(local), LOCAL)) + "@" + domain


def _local_part(key: bytes, local: str, domain: str) -> str:
    blocks = [_block(c) for c in local]
    size, number = 1, 0
    for c, (low, n) in zip(local, blocks, strict=True):
        if n:
            number, size = number * n + ord(c) - low, size * n
    number = permute(key, f"email|{domain.lower()}|" + ",".join(f"{a}.{b}" for a, b in blocks), number, size)
    out = []
    for c, (low, n) in zip(reversed(local), reversed(blocks), strict=True):
        if n:
            number, r = divmod(number, n)
            c = chr(low + r)
        out.append(c)
    return "".join(reversed(out))


_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST


def _date(key: bytes, value: str) -> str | None:
    """Days of 1900 to 2099 are permuted; the day is tried before the month unless the calendar says otherwise."""
    parts = re.split(r"[-/.]", value)
    if len(parts[0]) == 4:
        order = "ymd"
    else:
        order = "dmy" if int(parts[1]) <= 12 else "mdy"
    at = dict(zip(order, map(int, parts), strict=True))
    try:
        day = datetime.date(at["y"], at["m"], at["d"]).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = datetime.date.fromordinal(_FIRST + permute(key, "date", day, _DAYS))
    made = {"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}
    return re.sub("[0-9]+", "{}", value).format(*[made[c] for c in order])


def _ipv4(key: bytes, value: str) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    new = permute(key, "ipv4", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, new.to_bytes(4, "big")))


def _card(key: bytes, value: str) -> str | None:
    digits = re.sub("[^0-9]", "", value)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    new = _digits(key, "card", digits[:-1])
    return _refill(value, new + luhn_digit(new))


def _iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02}"


def _iban(key: bytes, value: str) -> str | None:
    plain = value.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, body) != check:
        return None
    size, number = 1, 0
    for c in body:
        n = 10 if c.isdigit() else 26
        number, size = number * n + (ord(c) - (48 if n == 10 else 65)), size * n
    number = permute(key, "iban" + country + re.sub("[A-Z]", "A", re.sub("[0-9]", "0", body)), number, size)
    made = []
    for c in reversed(body):
        n = 10 if c.isdigit() else 26
        number, r = divmod(number, n)
        made.append(chr(r + (48 if n == 10 else 65)))
    body = "".join(reversed(made))
    return _refill(value, country + _iban_check(country, body) + body)


def _phone(key: bytes, value: str) -> str | None:
    """The country code stays; the other digits are permuted."""
    head = re.match(r"\+[0-9]{1,3}(?=[^0-9])|\+[0-9]|", value)[0]
    rest = value[len(head) :]
    digits = re.sub("[^0-9]", "", rest)
    if not 6 <= len(digits) <= 14:
        return None
    return head + _refill(rest, _digits(key, "phone" + head, digits))


def _ssn(key: bytes, value: str) -> str | None:
    area, group, serial = value.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    areas = [a for a in range(1, 900) if a != 666]
    number = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    number = permute(key, "ssn", number, len(areas) * 99 * 9999)
    number, s = divmod(number, 9999)
    a, g = divmod(number, 99)
    return f"{areas[a]:03}-{g + 1:02}-{s + 1:04}"


_makers = {"email": _email, "iban": _iban, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "card": _card, "phone": _phone}


@lru_cache(maxsize=65536)
def pseudonym(key: bytes, kind: str, value: str) -> str | None:
    """The value's pseudonym, None where it isn't valid for its kind."""
    return _makers[kind](key, value)


def replaced(key: bytes, text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms for its valid values, and the values' (kind, start, end) in the text as it was."""
    if not _trace.search(text):
        return text, []
    out, spans, done, at = [], [], 0, 0
    email, other = _next_email(text, 0, 0), _others.search(text)
    while email or other:
        kind, start = ("email", email[0]) if email and (not other or email[0] <= other.start()) else (other.lastgroup, other.start())
        # not valid: a shorter match or the next pattern that begins here may be
        for kind in KINDS[KINDS.index(kind) :]:
            end, new = next(((e, made) for e in _ends(kind, text, start) if (made := pseudonym(key, kind, text[start:e])) is not None), (0, None))
            if new is not None:
                break
        if new is None:
            at = start + 1
        else:
            out += [text[done:start], new]
            spans.append((kind, start, end))
            done = at = end
        if email and email[0] < at:
            email = _next_email(text, at, email[1])
        if other and other.start() < at:
            other = _others.search(text, at)
    return "".join(out) + text[done:], spans


def _next_email(text: str, at: int, sign: int) -> tuple[int, int] | None:
    """Start of the first address from `at` on, and its @; `sign` is where the search for that begins."""
    before = text.rfind("@", at, sign)
    while (sign := text.find("@", max(sign, at))) >= 0:
        n = _local.match(text[max(at, before + 1) : sign][::-1]).end()
        if n and _domain.match(text, sign + 1):
            return sign - n, sign
        before, sign = sign, sign + 1
    return None


_single = {k: re.compile(p) for k, p in _patterns}


def _ends(kind: str, text: str, start: int) -> Iterator[int]:
    """Ends of the kind's matches that begin at `start`: the longest first, then those before a separator in it, as a value may have taken in the number or word that follows."""
    m = _single[kind].match(text, start)
    if m:
        yield m.end()
        for end in [x.start() for x in re.finditer(r"[\x20.-]", m[0])][::-1]:
            if _single[kind].fullmatch(text, start, start + end):
                yield start + end


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Replaces the text by its pseudonymised form and adds spans (kind:start:end, comma-joined, in the old text) and n_<kind>.

    A null text stays null with no spans; clean texts stay as they are. Repeated rows stay;
    input columns named like the added ones are replaced.
    """
    if not 1 <= len(key.encode()) <= 64:
        raise ValueError("the key takes 1 to 64 bytes")
    secret = key.encode()

    def work(texts: pa.Array) -> list:
        rows = [(None, []) if t is None else replaced(secret, t) for t in texts.to_pylist()]
        spans = [",".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in rows]
        return [[t for t, _ in rows], spans, *[[sum(x[0] == k for x in s) for _, s in rows] for k in KINDS]]

    made = spread(df, F.col(f"`{text_col}`"), "__pii", struct_udf(RESULT, work))
    return made.withColumn(text_col, F.col("pseudonymised")).drop("pseudonymised")
