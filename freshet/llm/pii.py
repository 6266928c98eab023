"""Format-preserving pseudonyms for personal values.

A value that passes its check is replaced by another of the same format, found by
a keyed permutation of all values of the format (a Feistel network with cycle
walking).  Equal values get equal pseudonyms in all documents, different values
different ones, and the holder of the key can undo them.

  card    13 to 19 digits whose check digit (Luhn) is right; the digits before it
          are permuted and the check digit is set anew; separators stay
  phone   three, three and four digits with separators, after an optional country
          code, which stays; area code and exchange start with 2 to 9 and do so in
          the pseudonym; others count only if a country code or parentheses mark
          them as a phone number, and stay among those others
  ssn     three, two and four digits with hyphens, none of the three all zero, the
          first neither 666 nor above 899; so in the pseudonym
  ip      four numbers up to 255
  date    a day of the years 1900 to 2099 as y-m-d, d.m.y or d/m/y (m/d/y where
          only that is a day); its day number is permuted
  email   letters and digits before the @ are permuted, upper case and other
          characters stay, and so does the domain; long names piece by piece, each
          with the pseudonyms before it as part of the key
  secret  32 to 64 hexadecimal digits with letters and digits among them

Numbers that fail their check stay as they are.  Defined results: a null text
stays null with no values, an empty one empty; repeated rows give equal rows; an
empty table gives no rows; other columns are kept, but ``spans`` replaces one of that
name; texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from datetime import date, timedelta
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from freshet.llm.textbytes import slices

ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1

PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<date>(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![/-]?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))"
    r"|(?P<phone>(?:(?<!\d)\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)|(?<!\d)\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\d))",
    re.ASCII,
)
_DIGIT_OR_AT = np.zeros(256, bool)
_DIGIT_OR_AT[48:58] = True
_DIGIT_OR_AT[ord("@")] = True


class Permutation:
    """Keyed permutations of 0 .. n-1, one for each (name, n)."""


    def __init__(self, key: bytes):
        self.key = key

    def _f(self, name: str, n: int, i: int, half: int, size: int) -> int:
        n_bytes = (n.bit_length() + 7) // 8
        said = name.encode() + b"|" + n.to_bytes(n_bytes, "big") + bytes([i]) + half.to_bytes(n_bytes, "big")
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest(), "big") % size

    def _once(self, name: str, n: int, a: int, b: int, x: int, undo: bool) -> int:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            sign = -1 if undo else 1
            if i % 2:
                right = (right + sign * self._f(name, n, i, left, b)) % b
            else:
                left = (left + sign * self._f(name, n, i, right, a)) % a
        return left * b + right

    def __call__(self, name: str, n: int, x: int, undo: bool = False) -> int:
        root = _root(n)
        a, b = root, -(-n // root)
        x = self._once(name, n, a, b, x, undo)
        while x >= n:
            x = self._once(name, n, a, b, x, undo)
        return x

    def within(self, name: str, n: int, x: int, kind, undo: bool = False) -> int:
        """Walks on until the value is of the same kind, so each kind is permuted in itself."""
        own = kind(x)
        name = f"{name} {own}"
        x = self(name, n, x, undo)
        while kind(x) != own:
            x = self(name, n, x, undo)
        return x


def _root(n: int) -> int:
    """The square root, rounded up."""
    r = isqrt(n)
    return r if r * r >= n else r + 1


def check_digit(digits: str) -> int:
    """The digit that completes ``digits`` by Luhn's rule."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(value: str, digits: str) -> str:
    """``value`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in value)


def _card(p: Permutation, v: str, undo: bool) -> str | None:
    d = re.sub(r"\D", "", v)
    if not 13 <= len(d) <= 19 or check_digit(d[:-1]) != int(d[-1]):
        return None
    body = str(p("card", 10 ** (len(d) - 1), int(d[:-1]), undo)).zfill(len(d) - 1)
    return _refill(v, body + str(check_digit(body)))


def _proper_phone(x: int) -> bool:
    return x // 10**9 >= 2 and x // 10**6 % 10 >= 2


def _phone(p: Permutation, v: str, undo: bool) -> str | None:
    d = re.sub(r"\D", "", v)
    code = len(d) - 10
    x = int(d[code:])
    if not (_proper_phone(x) or code or "(" in v):
        return None
    return _refill(v, d[:code] + str(p.within("phone", 10**10, x, _proper_phone, undo)).zfill(10))


def _proper_ssn(x: int) -> bool:
    area = x // 10**6
    return area not in (0, 666) and area < 900 and x // 10**4 % 100 > 0 and x % 10**4 > 0


def _ssn(p: Permutation, v: str, undo: bool) -> str | None:
    x = int(v.replace("-", ""))
    return _refill(v, str(p.within("ssn", 10**9, x, _proper_ssn, undo)).zfill(9)) if _proper_ssn(x) else None


def _ip(p: Permutation, v: str, undo: bool) -> str | None:
    parts = [int(x) for x in v.split(".")]
    if max(parts) > 255:
        return None
    x = p("ip", 1 << 32, int.from_bytes(bytes(parts), "big"), undo)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _day(y: int, m: int, d: int) -> date | None:
    try:
        day = date(y, m, d)
    except ValueError:
        return None
    return day if FIRST_DAY <= day <= LAST_DAY else None


def _date(p: Permutation, v: str, undo: bool) -> str | None:
    mark = re.search(r"\D", v).group()
    parts = [int(x) for x in v.split(mark)]
    month_first = False
    if mark == "-":
        day = _day(*parts)
    else:
        day = _day(parts[2], parts[1], parts[0])
        if day is None and mark == "/":
            day, month_first = _day(parts[2], parts[0], parts[1]), True
    if day is None:
        return None
    n = (day - FIRST_DAY).days
    if month_first:
        # Only days above 12 are told apart from d/m/y; permute among these.
        late = _late_days()
        new = late[p("date m/d", len(late), late.index(n), undo)]
    else:
        new = p("date", DAYS, n, undo)
    t = FIRST_DAY + timedelta(days=new)
    wide = lambda x, like: str(x).zfill(2) if len(like) == 2 else str(x)
    own = v.split(mark)
    if mark == "-":
        return f"{t.year}-{wide(t.month, own[1])}-{wide(t.day, own[2])}"
    first, second = (t.month, t.day) if month_first else (t.day, t.month)
    return f"{wide(first, own[0])}{mark}{wide(second, own[1])}{mark}{t.year}"


_late: list[int] = []


def _late_days() -> list[int]:
    if not _late:
        _late.extend(i for i in range(DAYS) if (FIRST_DAY + timedelta(days=i)).day > 12)
    return _late


#: Characters permuted at once; the halves of their number stay below a round's 256 bits.
TOGETHER = 64


def _letters(p: Permutation, name: str, v: str, undo: bool, hexadecimal: bool = False) -> str | None:
    """Permutes the letters and digits of a string, each within its kind.

    The kinds of all characters are part of the key; so are, for each further piece
    of a long string, the pseudonyms of the pieces before it.
    """
    low = v.lower()
    sizes = [16 if hexadecimal else 10 if c.isdigit() else 26 if c.isalpha() else 1 for c in low]
    if max(sizes, default=1) == 1:
        return None
    shape = "".join("h" if s == 16 else "d" if s == 10 else "a" if s == 26 else c for s, c in zip(sizes, low))
    said = hashlib.blake2b(shape.encode(), digest_size=16)
    out = []
    for first in range(0, len(v), TOGETHER):
        part, own = low[first : first + TOGETHER], sizes[first : first + TOGETHER]
        x, n = 0, 1
        for size, c in zip(own, part):
            x, n = x * size + (0 if size == 1 else int(c, 16) if size in (10, 16) else ord(c) - 97), n * size
        x = p(f"{name} {said.hexdigest()}", n, x, undo) if n > 1 else x
        new = []
        for size, c in zip(reversed(own), reversed(part)):
            x, place = divmod(x, size)
            new.append(c if size == 1 else "0123456789abcdef"[place] if size in (10, 16) else chr(97 + place))
        new = "".join(reversed(new))
        said.update((part if undo else new).encode())
        out.append("".join(b.upper() if a.isupper() else b for a, b in zip(v[first:], new)))
    return "".join(out)


def _email(p: Permutation, v: str, undo: bool) -> str | None:
    local, _, domain = v.partition("@")
    new = _letters(p, "email", local, undo)
    return None if new is None else f"{new}@{domain}"


def _secret(p: Permutation, v: str, undo: bool) -> str | None:
    if not re.search("[a-fA-F]", v) or not re.search(r"\d", v) or (re.search("[a-f]", v) and re.search("[A-F]", v)):
        return None
    new = _letters(p, "secret", v, undo, hexadecimal=True)
    return new.upper() if re.search("[A-F]", v) else new


_REPLACE = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonymise(text: str, p: Permutation, undo: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each value replaced."""
    found = []

    def swap(m: re.Match) -> str:
        new = _REPLACE[m.lastgroup](p, m.group(), undo)
        if new is None:
            return m.group()
        found.append((m.lastgroup, m.start(), m.end()))
        return new

    return PATTERN.sub(swap, text), found


def apply(docs: DataFrame, key: str, text_col: str = "text", undo: bool = False) -> DataFrame:
    """The rows with pseudonyms in the text, and ``spans``: kind, start and end of each value in the old text."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(rest)], F.col(text_col).alias("text"))

    def run(batches):
        p = Permutation(key.encode())
        for batch in batches:
            text = batch.column(len(rest))
            mask, new, spans = np.zeros(batch.num_rows, bool), [], [[] for _ in range(batch.num_rows)]
            for begin, end, data, at in slices(batch, "text"):
                sums = np.zeros(len(data) + 1, np.int64)
                np.cumsum(_DIGIT_OR_AT[data], out=sums[1:])
                for d in np.flatnonzero(sums[at[1:]] > sums[at[:-1]]):
                    out, found = pseudonymise(data[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace"), p, undo)
                    if found:
                        mask[begin + d] = True
                        new.append(out)
                        spans[begin + d] = [{"kind": k, "start": s, "end": e} for k, s, e in found]
            if new:
                text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text, pa.array(spans, span)], names=[*batch.schema.names, "spans"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    out = rows.mapInArrow(run, ", ".join([*kinds, "spans array<struct<kind: string, start: long, end: long>>"]))
    back = {c: F.col(f"k{i}").alias(c) for i, c in enumerate(rest)} | {text_col: F.col("text").alias(text_col)}
    return out.select(*[back[c] for c in docs.columns if c != "spans"], "spans")
