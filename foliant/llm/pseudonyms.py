"""Operator 3: format-preserving pseudonyms by a keyed Feistel permutation.

Numbers and dates that validate (card numbers by Luhn, account numbers by mod 97, social security
numbers, IPv4 addresses, calendar dates), what is written as a telephone number, e-mail names and secrets
are found in texts. Each is a number below the size of its format's domain; a Feistel network over the domain's bits, keyed and
tweaked by the format, permutes it, walking on while it is outside the domain. The result is written back
in the same format, check digits and all, so equal values stay equal in all documents and nothing links
them to the originals without the key.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.frames import bounded

ROUNDS = 8


class Key(bytes):
    """A secret; where `back` is set, everything that is done with it is undone instead."""

    back = False

    @classmethod
    def of(cls, secret: bytes, back: bool = False) -> Key:
        """Secrets of over 64 bytes count by their digest; an empty one is refused."""
        if not secret:
            raise ValueError("the key is empty")
        out = cls(secret if len(secret) <= 64 else hashlib.blake2b(secret).digest())
        out.back = back
        return out


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1, distinct for each tweak; its inverse for a Key with `back`."""
    if size < 2:
        return value
    half = (max((size - 1).bit_length(), 2) + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8
    salt, secret = hashlib.sha256(f"{tweak}/{size}".encode()).digest()[:16], bytes(key)

    def mixed(r: int, part: int) -> int:
        digest = hashlib.blake2b(part.to_bytes(width, "big"), key=secret, person=bytes([r]), salt=salt, digest_size=32).digest()
        return int.from_bytes((digest * (width // 32 + 1))[:width], "big") & mask

    back = getattr(key, "back", False)
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            left, right = (right ^ mixed(ROUNDS - 1 - r, left), left) if back else (right, left ^ mixed(r, right))
        value = (left << half) | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit for digits without one."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _spread(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in text)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or d[0] == "0" or luhn(d[:-1]) != int(d[-1]):
        return None
    base = 10 ** (len(d) - 2)
    body = str(base + permute(int(d[:-1]) - base, 9 * base, key, f"card{len(d)}"))
    return _spread(text, body + str(luhn(body)))


_CODES = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")


def phone(text: str, key: bytes) -> str | None:
    """The country code after a plus stays; what follows is a domain for each length, so ten digits are equal with and without code."""
    d = _digits(text)
    head = _CODES.match(d)[0] if text[0] == "+" else ""
    body = d[len(head) :]
    if not 7 <= len(d) <= 15:
        return None
    return _spread(text, f"{head}{permute(int(body), 10 ** len(body), key, f'phone{len(body)}'):0{len(body)}d}")


def ssn(text: str, key: bytes) -> str | None:
    a, b, c = (int(x) for x in text.split("-"))
    if a in (0, 666) or a >= 900 or b == 0 or c == 0:
        return None
    n = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    n, c = divmod(permute(n, 898 * 99 * 9999, key, "ssn"), 9999)
    a, b = divmod(n, 99)
    return f"{a + 1 + (a + 1 >= 666):03d}-{b + 1:02d}-{c + 1:04d}"


def ipv4(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permute(functools.reduce(lambda t, p: t * 256 + int(p), parts, 0), 1 << 32, key, "ipv4")
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def iban(text: str, key: bytes) -> str | None:
    raw = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(raw) <= 34 or number(raw[4:] + raw[:4]) % 97 != 1:
        return None
    body = string(raw[4:], key, f"iban{raw[:2]}")
    out = iter(raw[:2] + f"{98 - number(body + raw[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(out) for c in text)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(text: str, key: bytes) -> str | None:
    """Year first, else day first, else month first; the last are dates after the 12th alone and stay among these, as no other reading has them."""
    a, b, c = re.split(r"[-/.]", text)
    sep = text[len(a)]
    month_first = len(a) == 2 and int(b) > 12
    y, m, d = (a, b, c) if len(a) == 4 else (c, a, b) if month_first else (c, b, a)
    try:
        day = datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None
    if not _FIRST <= day.toordinal() <= _LAST:
        return None
    while True:
        day = datetime.date.fromordinal(_FIRST + permute(day.toordinal() - _FIRST, _LAST - _FIRST + 1, key, "date"))
        if not month_first or day.day > 12:
            break
    return day.strftime(f"%Y{sep}%m{sep}%d" if len(a) == 4 else f"%m{sep}%d{sep}%Y" if month_first else f"%d{sep}%m{sep}%Y")


def string(text: str, key: bytes, tweak: str) -> str:
    """Digits to digits and letters to letters of their case, as one number of mixed radix."""
    n, size, radix = 0, 1, []
    for c in text:
        base, r = (48, 10) if c.isascii() and c.isdigit() else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (ord(c), 1)
        radix.append((base, r))
        n, size = n * r + ord(c) - base, size * r
    n = permute(n, size, key, f"{tweak}{len(text)}")
    out = []
    for base, r in reversed(radix):
        n, d = divmod(n, r)
        out.append(chr(base + d))
    return "".join(reversed(out))


def hexadecimal(text: str, key: bytes) -> str:
    return f"{permute(int(text, 16), 16 ** len(text), key, f'hex{len(text)}'):0{len(text)}x}"


_KINDS: list[tuple[str, str, Callable[[str, bytes], str | None]]] = [
    ("email", r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,63})(?=@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})+)", lambda t, k: string(t, k, "email")),
    ("secret", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", lambda t, k: "AKIA" + string(t[4:], k, "akia")),
    ("secret", r"(?<![0-9a-z])(?:(?<=password=)[0-9a-f]{8,64}|[0-9a-f]{32,64})(?![0-9a-z])", hexadecimal),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("date", r"(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9])", date),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])", ssn),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", ipv4),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", card),
    ("card", r"(?<![0-9])[0-9]{4}([ \-])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{6}\1[0-9]{5})(?![0-9])", card),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9A-Za-z])", phone),
    ("phone", r"(?<![0-9A-Za-z+])\+[1-9](?:[ .\-()/]{0,2}[0-9]){6,14}(?![0-9A-Za-z])", phone),
    ("phone", r"(?<![0-9A-Za-z])\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9A-Za-z])", phone),
]
_FOUND = [(name, re.compile(pattern), how) for name, pattern, how in _KINDS]
#: A superset of the patterns.
_MAYBE = re.compile(r"[0-9]|@|AKIA|password=|[a-f]{32}")


def _without(text: str, taken: list[tuple[int, int, str, str]]) -> str:
    """text with letters for what is taken, so that a number beside it ends there."""
    out, at = [], 0
    for s, e, _, _ in sorted(taken):
        out += [text[at:s], "x" * (e - s)]
        at = e
    return "".join([*out, text[at:]])


def restored(text: str | None, key: bytes) -> str | None:
    """The text that pseudonymised() got, as long as its pseudonyms alone are found in what it gave."""
    return pseudonymised(text, Key.of(key, back=True))[0]


def pseudonymised(text: str | None, key: bytes) -> tuple[str | None, list[str]]:
    """The text with pseudonyms, and the kinds of what was replaced, in order of place. Earlier kinds win where two overlap."""
    if not text or not _MAYBE.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    covered = bytearray(len(text))
    for name, pattern, how in _FOUND:
        for m in pattern.finditer(_without(text, taken) if name == "phone" else text):
            if covered.find(1, m.start(), m.end()) < 0 and (new := how(m[0], key)) is not None:
                covered[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                taken.append((m.start(), m.end(), new, name))
    taken.sort()
    out, at = [], 0
    for s, e, new, _ in taken:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), [t[3] for t in taken]


def _replaced(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [pseudonymised(t, Key.of(key)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))], names=["id", "text", "kinds"])

    return run


def pseudonymise(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, kinds) for every row of docs: the text with pseudonyms, and the kind of each in order.

    The key is a secret of any length but 0. Null and empty texts stay as they are. Equal values of a kind and format get equal pseudonyms in all
    rows, distinct ones distinct pseudonyms. Values that don't validate stay. Of overlapping values the
    kind named first in the list above wins; ties of a kind go to the left one.
    """
    Key.of(key)
    bounded(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(_replaced(key), "id long, text string, kinds array<string>").withColumnsRenamed({"id": id_column, "text": text_column})
