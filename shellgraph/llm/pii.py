"""Format-preserving pseudonyms for personal data.

Values are found by pattern, validated (checksums, ranges, calendar), and replaced by a keyed
permutation of the values of their own format, so that a value has one pseudonym in all documents
and two values never share one. The permutation is a Feistel network of ten rounds over the smallest
even number of bits that holds the format's values, walked until it lands inside. A date keeps its
order, widths and separators; one date in two notations has one pseudonym date if both are written
with two-digit days and months and neither is month first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

ROUNDS = 10


class Feistel:
    """A keyed permutation of range(size), another for each ``tweak``."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        h = hashlib.blake2b(tweak + bytes([i]) + half.to_bytes((bits + 7) // 8, "big"), key=self.key, digest_size=min(64, (bits + 7) // 8 + 8))
        return int.from_bytes(h.digest(), "big") & ((1 << bits) - 1)

    def _walk(self, x: int, size: int, tweak: bytes, order: range) -> int:
        if not 0 <= x < size:
            raise ValueError("value outside its format")
        if size == 1:
            return x
        bits = ((size - 1).bit_length() + 1) // 2
        tweak += size.to_bytes((size.bit_length() + 7) // 8, "big")
        back = order.step < 0
        while True:
            a, b = x >> bits, x & ((1 << bits) - 1)
            for i in order:
                a, b = (b ^ self._round(tweak, i, a, bits), a) if back else (b, a ^ self._round(tweak, i, b, bits))
            x = a << bits | b
            if x < size:
                return x

    def hide(self, x: int, size: int, tweak: bytes) -> int:
        return self._walk(x, size, tweak, range(ROUNDS))

    def show(self, x: int, size: int, tweak: bytes) -> int:
        """The inverse of ``hide``."""
        return self._walk(x, size, tweak, range(ROUNDS - 1, -1, -1))


# ---------------------------------------------------------------- formats

_RADIX = {**dict.fromkeys("0123456789", "0123456789"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
Move = Callable[[int, int, bytes], int]


def _by_class(s: str, move: Move, tweak: bytes, alphabets: dict[str, str] = _RADIX) -> str:
    """Digits and ASCII letters moved within their classes; all else stays in place."""
    places = [(i, alphabets[c]) for i, c in enumerate(s) if c in alphabets]
    x, size = 0, 1
    for i, abc in places:
        x, size = x * len(abc) + abc.index(s[i]), size * len(abc)
    y, out = move(x, size, tweak + bytes(len(abc) for _, abc in places)), list(s)
    for i, abc in reversed(places):
        y, r = divmod(y, len(abc))
        out[i] = abc[r]
    return "".join(out)


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _fill(shape: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), shape)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _card(s: str, move: Move) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    body = d[0] + _by_class(d[1:-1], move, b"card" + d[0].encode())
    return _fill(s, body + next(c for c in "0123456789" if luhn(body + c)))


def _phone(s: str, move: Move) -> str | None:
    d = _digits(s)
    if not 10 <= len(d) <= 15:
        return None
    country = len(d) - 10 if s.startswith("+") else 0  # the last ten digits are the subscriber's
    return _fill(s, d[:country] + _by_class(d[country:], move, b"phone" + d[:country].encode()))


def _ip(s: str, move: Move) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts) or s in ("127.0.0.1", "0.0.0.0"):
        return None
    x = move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(s: str, move: Move) -> str | None:
    good = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = _digits(s)
    if not good(d):
        return None
    while True:  # walk on until the number is one that can be given out
        d = _by_class(d, move, b"ssn")
        if good(d):
            return _fill(s, d)


def _iban(s: str, move: Move) -> str | None:
    d = s.replace(" ", "").upper()
    value = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(d) <= 34 or value(d[4:] + d[:4]) % 97 != 1:
        return None
    body = _by_class(d[4:], move, b"iban" + d[:2].encode())
    new = iter(f"{d[:2]}{98 - value(body + d[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(new) for c in s)


_FIRST, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def _kinds(parts: tuple[str, str]) -> tuple[int, ...]:
    """How day and month are written: both with two digits, or each with one, with a leading zero, or with two."""
    return () if all(len(p) == 2 for p in parts) else tuple(len(p) + (p[0] == "0") for p in parts)


def _date(s: str, move: Move) -> str | None:
    """A date read day first can't be read otherwise where its month is above 12, so what is read month first is walked
    until its day is above 12; what has one digit is walked until it has one again."""
    a, sep, b, sep_2, c = re.fullmatch(r"(\d+)([-/.])(\d+)([-/.])(\d+)", s).groups()
    for order in ("ymd",) if len(a) == 4 else ("dmy", "mdy"):
        at = dict(zip(order, (a, b, c), strict=True))
        try:
            n = date(*(int(at[k]) for k in "ymd")).toordinal() - _FIRST
        except ValueError:
            continue
        if not 0 <= n < _DAYS:
            return None
        kinds = _kinds((at["d"], at["m"]))
        while True:
            n = move(n, _DAYS, b"date")
            d = date.fromordinal(_FIRST + n)
            if order == "mdy" and d.day <= 12:
                continue
            widths = [1 if k == 1 else 2 for k in kinds] or [2, 2]
            new = {"y": f"{d.year:04d}", "d": f"{d.day:0{widths[0]}d}", "m": f"{d.month:0{widths[1]}d}"}
            if _kinds((new["d"], new["m"])) == kinds:
                return new[order[0]] + sep + new[order[1]] + sep_2 + new[order[2]]
    return None


def _email(s: str, move: Move) -> str | None:
    local, _, domain = s.rpartition("@")
    # letter case is kept apart, so that one address has one pseudonym in any case
    low = _by_class(local.lower(), move, b"email" + domain.lower().encode())
    return "".join(n.upper() if c.isupper() else n for n, c in zip(low, local, strict=True)) + "@" + domain


_HEX = dict.fromkeys("0123456789abcdef", "0123456789abcdef")


def _secret(s: str, move: Move) -> str | None:
    low = _by_class(s.lower(), move, b"secret", _HEX)
    return low.upper() if s == s.upper() else low


# fixed patterns, most particular first; the first kind that validates takes the text
_ASCII_EDGE = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
KINDS: dict[str, tuple[str, Callable[[str, Move], str | None]]] = {
    "secret": (r"(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}", _secret),
    "iban": (r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?", _iban),
    "date": (r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}|(?![0-9A-Za-z]))|(?:(?<![0-9]\.)[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?!\.[0-9])|(?![0-9]+\.[0-9]+\.)[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2})(?![0-9A-Za-z])", _date),
    "ip": (r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])", _ip),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _ssn),
    "card": (r"[0-9](?:[ -]?[0-9]){12,18}", _card),
    "phone": (r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}", _phone),
}
_EACH = {k: re.compile(f"(?:{p}){'' if k == 'date' else _ASCII_EDGE[1]}") for k, (p, _) in KINDS.items()}  # a time may follow a date
_SHORTER = ("card", "phone", "iban")  # kinds whose longest match may run into what follows
_WHOLE = ("secret", "date", "ip", "ssn")  # kinds whose format leaves no doubt where they begin
_START = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]|\+[0-9]|\([0-9]|[A-Z]{2}[0-9]{2}|[a-fA-F][0-9A-Fa-f]{31})")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


class Pseudonyms:
    """Finds and replaces; ``back`` reverses a replacement with the same key."""

    def __init__(self, key: bytes, back: bool = False):
        f = Feistel(key)
        self._move = f.show if back else f.hide
        self.one = lru_cache(1 << 16)(self._one)

    def _one(self, kind: str, s: str) -> str | None:
        return _email(s, self._move) if kind == "email" else KINDS[kind][1](s, self._move)

    def _emails(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        at = text.find("@")
        while at >= 0:
            a = at
            while a and text[a - 1] in _LOCAL:
                a -= 1
            while a < at and text[a] in "._%+-":
                a += 1
            m = _DOMAIN.match(text, at + 1)
            if m and a < at:
                s = text[a : m.end()]
                yield a, m.end(), "email", self.one("email", s)
                at = text.find("@", m.end())
            else:
                at = text.find("@", at + 1)

    def _numbers(self, text: str, taken: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, str]]:
        pos, k = 0, 0
        while m := _START.search(text, pos):
            a = m.start()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k < len(taken) and taken[k][0] <= a:
                pos = taken[k][1]
                continue
            pos = a + 1
            limit = taken[k][0] if k < len(taken) else len(text)
            if found := self._first(text, a, limit):
                yield found
                pos = found[1]

    def _first(self, text: str, a: int, limit: int) -> tuple[int, int, str, str] | None:
        """The value that starts at ``a`` and ends by ``limit``: of the first kind whose longest match validates, else of
        the first of which a match that ends with an earlier group does."""
        rest = []
        for kind, pattern in _EACH.items():
            if v := pattern.match(text, a):
                if kind in _SHORTER:
                    if (new := self.one(kind, v.group())) is not None and v.end() <= limit and not self._cuts(text, a, v.end(), KINDS):
                        return a, v.end(), kind, new
                    rest.append((kind, v.end()))
                elif v.end() <= limit and (new := self.one(kind, v.group())) is not None:
                    return a, v.end(), kind, new
        for kind, last in rest:
            ends = [last, *(e for e in range(last - 1, a, -1) if text[e] in " .-()" and text[e - 1].isalnum())]
            good = [(e, new) for e in ends if e <= limit and _EACH[kind].fullmatch(text, a, e) and (new := self.one(kind, text[a:e])) is not None and not self._cuts(text, a, e, _WHOLE)]
            if good:
                e, new = next(g for g in good if not self._cuts(text, good[-1][0], g[0], KINDS))  # the last cuts nothing
                return a, e, kind, new
        return None

    def _cuts(self, text: str, a: int, end: int, kinds: Iterable[str]) -> bool:
        """Whether a value of ``kinds`` starts after a and before end and goes on beyond end."""
        for m in _START.finditer(text, a + 1):
            if m.start() >= end:
                break
            for kind in kinds:
                if (v := _EACH[kind].match(text, m.start())) and v.end() > end and self.one(kind, v.group()) is not None:
                    return True
        return False

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym), in order, disjoint."""
        mails = list(self._emails(text)) if "@" in text else []
        return sorted([*mails, *self._numbers(text, mails)])

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        found, out, pos = self.spans(text), [], 0
        for a, b, _, new in found:
            out += [text[pos:a], new]
            pos = b
        return ("".join([*out, text[pos:]]) if found else text), found


_NEW = T.StructType([T.StructField("n_private", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with private values in ``text`` replaced, n_private (how many) and kinds (sorted
    names), which replace columns of these names. Texts without private values, empty and null ones
    come back as they are, with 0 and an empty list. Whole texts are searched, one at a time; rows
    are independent, so repeated rows and ties change nothing."""
    C.small_batches(docs.sparkSession)
    own = [f for f in docs.schema.fields if f.name not in _NEW.names]
    names = [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for big in batches:
            for i in range(0, big.num_rows, 256):
                b = big.slice(i, 256)
                done = [(None, []) if t is None else p.replace(t) for t in b.column(text).to_pylist()]
                new = [pa.array([t for t, _ in done], b.column(text).type), pa.array([len(f) for _, f in done], pa.int64()), pa.array([sorted({k for *_, k, _ in f}) for _, f in done], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(new[0] if n == text else b.column(n) for n in names), *new[1:]], names=[*names, *_NEW.names])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, T.StructType([*own, *_NEW.fields]))
