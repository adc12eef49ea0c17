"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Numbers and dates are found, validated (check digits, ranges, calendars) and permuted within the set of values that
their format allows, so a pseudonym is valid again and looks like what it replaces; days and months keep their number
of digits. The permutation depends on the key and the format alone, not on separators or the document: equal values get
equal pseudonyms everywhere, and the holder of the key can undo it. Mail addresses have letters permuted among letters
and digits among digits before the @.

Values that fail validation stay. Where a run of digit groups is no valid value, the runs that begin with the same group
and end sooner are tried, then the search goes on behind the first group, so a value is found beside other numbers. The permutation of a set of N values is a Feistel network over the least square
grid that holds N, walked on until it lands below N.

Defined results: null stays null and has no spans, empty texts stay empty; texts of any length are searched whole; of two
kinds that begin at one place the first of KINDS counts; repeated rows get equal results; rows and other columns stay as
they are, but one that has the name given for the spans gives way to them; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import secrets
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.session import table

ROUNDS = 8

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_BEGIN = r"(?<![A-Za-z0-9.])"
#: What may be a value of each kind, in the order in which kinds that begin at one place are tried.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": _BEGIN + r"(?:(?:19|20)[0-9]{2}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)(?:19|20)[0-9]{2}|[0-9]{1,2} (?:" + "|".join(MONTHS) + r") (?:19|20)[0-9]{2})(?![0-9])",
    "ip": _BEGIN + r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ssn": _BEGIN + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": _BEGIN + r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": _BEGIN + r"(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9](?:[ .-]?[0-9]){7,14})(?![0-9])",
    "named": r"\b(?:" + "|".join(MONTHS) + r") [0-9]{1,2}, (?:19|20)[0-9]{2}\b",
}
KINDS = tuple(PATTERNS)
ONE = {k: re.compile(p) for k, p in PATTERNS.items()}
FIND = re.compile("|".join(re.sub(r"\(\?P<", f"(?P<{k}_", p).replace("(?P=", f"(?P={k}_") for k, p in PATTERNS.items()))
#: Kinds that run over several groups, so that a shorter run may be the value.
RUNS = ("iban", "card", "phone")
GROUP = re.compile(r"[A-Za-z0-9(+]+\)?")
HINT = re.compile(r"[0-9@]")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
# Fixed value: lengths of account numbers by country, where they are checked.
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "CH": 21, "AT": 20, "PT": 25, "SE": 24, "DK": 18, "NO": 15, "FI": 18, "PL": 28, "IE": 22}


class Permutation:
    """Keyed permutations of ranges of integers."""

    def __init__(self, key: str):
        self.key = key.encode()
        self.permute = lru_cache(200_000)(self._permute)

    def _mix(self, kind: str, n: int, step: int, half: int, side: int) -> int:
        digest = hmac.digest(self.key, f"{kind}|{n}|{step}|{half}".encode(), "sha256")
        return int.from_bytes(digest, "big") % side

    def _permute(self, kind: str, n: int, value: int) -> int:
        return self._walk(kind, n, value, range(ROUNDS), 1)

    def undo(self, kind: str, n: int, value: int) -> int:
        return self._walk(kind, n, value, range(ROUNDS - 1, -1, -1), -1)

    def _walk(self, kind: str, n: int, value: int, steps: range, sign: int) -> int:
        if n < 2:
            return value
        side = isqrt(n - 1) + 1
        while True:
            left, right = divmod(value, side)
            for step in steps:
                if step % 2:
                    left = (left + sign * self._mix(kind, n, step, right, side)) % side
                else:
                    right = (right + sign * self._mix(kind, n, step, left, side)) % side
            value = left * side + right
            if value < n:
                return value


def luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _refill(shape: str, values: str) -> str:
    """shape with its digits replaced one by one."""
    it = iter(values)
    return "".join(next(it) if c.isdigit() else c for c in shape)


@lru_cache(16)
def _days(month: int | str, day: int | str) -> list[int]:
    """Ordinals of the days from 1900 to 2099 whose month and day have so many digits; "*" and 0 take any."""
    all_days = map(datetime.date.fromordinal, range(FIRST_DAY, LAST_DAY + 1))
    fits = lambda n, digits: digits in ("*", 0) or len(str(n)) == digits
    return [d.toordinal() for d in all_days if fits(d.month, month) and fits(d.day, day)]


class Pseudonyms:
    """Replaces the personal data of texts."""

    def __init__(self, key: str):
        self.p = Permutation(key)

    def card(self, s: str) -> str | None:
        d = "".join(filter(str.isdigit, s))
        if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        n = len(d) - 2
        body = d[0] + str(self.p.permute(f"card{len(d)}{d[0]}", 10**n, int(d[1:-1]))).zfill(n)
        return _refill(s, body + str(luhn(body)))

    def iban(self, s: str) -> str | None:
        a = s.replace(" ", "")
        if not 15 <= len(a) <= 34 or IBAN_LENGTHS.get(a[:2], len(a)) != len(a) or mod97(a) != 1:
            return None
        body = self._letters("iban" + a[:2], a[4:])
        check = 98 - mod97(a[:2] + "00" + body)
        it = iter(a[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(it) for c in s)

    def ssn(self, s: str) -> str | None:
        area, group, serial = map(int, s.split("-"))
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        areas = [*range(1, 666), *range(667, 900)]
        value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
        rest, serial = divmod(self.p.permute("ssn", len(areas) * 99 * 9999, value), 9999)
        area, group = divmod(rest, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip(self, s: str) -> str | None:
        parts = list(map(int, s.split(".")))
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
            return None
        value = self.p.permute("ip", 256**4, int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, value.to_bytes(4, "big")))

    def phone(self, s: str) -> str | None:
        d = "".join(filter(str.isdigit, s))
        if not ONE["phone"].fullmatch(s) or not 7 <= len(d) <= 15:
            return None
        own = d[-10:]
        if len(d) in (10, 11) and d[:-10] in ("", "1") and own[0] > "1" and own[3] > "1":  # North America: area and exchange begin with 2-9
            value = (int(own[:3]) - 200) * 800 * 10_000 + (int(own[3:6]) - 200) * 10_000 + int(own[6:])
            rest, line = divmod(self.p.permute("phone", 800 * 800 * 10_000, value), 10_000)
            area, exchange = divmod(rest, 800)
            return _refill(s, d[:-10] + f"{area + 200}{exchange + 200}{line:04d}")
        kept = 2 if s[0] == "+" else 1
        n = len(d) - kept
        return _refill(s, d[:kept] + str(self.p.permute(f"phone{len(d)}{d[:kept]}", 10**n, int(d[kept:]))).zfill(n))

    def date(self, s: str) -> str | None:
        named = re.fullmatch(r"([0-9]{1,2}) (\w+) ([0-9]{4})|(\w+) ([0-9]{1,2}), ([0-9]{4})", s)
        try:
            if named:
                day, month, year = (named[1], named[2], named[3]) if named[1] else (named[5], named[4], named[6])
                new = self._day(datetime.date(int(year), MONTHS.index(month) + 1, int(day)), "", day)
                text = str(new.day).zfill(len(day))
                return f"{text} {MONTHS[new.month - 1]} {new.year}" if named[1] else f"{MONTHS[new.month - 1]} {text}, {new.year}"
            sign = re.search(r"[-/.]", s)[0]
            a, b, c = s.split(sign)
            if len(a) == 4:
                order = "ymd"
            elif sign == "/" and int(a) <= 12:
                order = "mdy"
            else:
                order = "dmy"
            at = dict(zip(order, (a, b, c), strict=True))
            new = self._day(datetime.date(int(at["y"]), int(at["m"]), int(at["d"])), at["m"], at["d"])
            width = {k: len(v) for k, v in at.items()}
            return sign.join(str({"y": new.year, "m": new.month, "d": new.day}[k]).zfill(width[k]) for k in order)
        except ValueError:
            return None

    named = date

    def _day(self, date: datetime.date, month: str, day: str) -> datetime.date:
        """Permuted among the days that can be written like this: with as many digits, and padded only if this may be."""
        padded = "0" in (month[:1], day[:1]) or (len(month) == len(day) == 2 and month < "13")
        form = ("*" if padded and len(month) == 2 else len(month)), ("*" if padded and len(day) == 2 else len(day))
        days = _days(*form)
        return datetime.date.fromordinal(days[self.p.permute(f"date{form}", len(days), bisect_left(days, date.toordinal()))])

    def email(self, s: str) -> str | None:
        local, _, domain = s.rpartition("@")
        return f"{self._letters('email', local)}@{domain}"

    def _letters(self, kind: str, s: str) -> str:
        """Lower case letters, capitals and digits permuted, each among its own."""
        sets = [("0", 10) if c.isdigit() else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else ("", 0) for c in s]
        n, value = 1, 0
        for c, (zero, base) in zip(s, sets, strict=True):
            if base:
                n, value = n * base, value * base + ord(c) - ord(zero)
        value, out = self.p.permute(kind + "".join(z or c for (z, _), c in zip(sets, s, strict=True)), n, value), []
        for c, (zero, base) in zip(reversed(s), reversed(sets), strict=True):
            if base:
                value, k = divmod(value, base)
                c = chr(ord(zero) + k)
            out.append(c)
        return "".join(reversed(out))

    def at(self, text: str, start: int) -> tuple[str, int, str] | None:
        """(kind, end, pseudonym) of the value that begins at a place: of the first kind with a valid one, its longest."""
        for kind in KINDS:
            if not (m := ONE[kind].match(text, start)):
                continue
            ends = [m.end()]
            if kind in RUNS:
                ends += [start + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] in " -."]
            for end in ends:
                if (new := getattr(self, kind)(text[start:end])) is not None:
                    return ("date" if kind == "named" else kind), end, new
        return None

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of what was replaced, as places in the input."""
        if not HINT.search(text):
            return text, []
        out, spans, at, seek = [], [], 0, 0
        while m := FIND.search(text, seek):
            found = self.at(text, m.start())
            if found is None:
                seek = max(GROUP.match(text, m.start()).end(), m.start() + 1)
                continue
            kind, seek, new = found
            out += [text[at : m.start()], new]
            spans.append((kind, m.start(), seek))
            at = seek
        return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with pseudonyms in `text` and a column of "kind:start:end" of what was replaced, comma-joined."""
    kept = docs.drop(spans)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonyms(key)
        for batch in batches:
            done = [(None, []) if t is None else worker.replace(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in done], pa.string())], [*batch.schema.names, spans])

    return kept.mapInArrow(run, kept.withColumn(spans, F.lit("")).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms, the spans that they replace and their number.

    The session's seine.pseudonym.key links runs with each other. Without one a key is drawn for this run, which nobody
    can undo afterwards.
    """
    key = spark.conf.get("seine.pseudonym.key", None) or secrets.token_hex(32)
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return found.select("doc_id", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans"), "spans", "text")
