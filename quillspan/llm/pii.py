"""Format-preserving pseudonyms for personal data and secrets.

Values are found by pattern and validated (card numbers by their check digit, dates by the calendar, addresses by their
range).  Each is read as a number of its format's range and permuted in that range by a keyed Feistel network,
walking until the result lies in the range again.  So the result has the same format, equal values become equal
pseudonyms in every document, and different values stay different.

Formats: e-mail addresses (letters and digits of the local part and of the domain before its last label), phone
numbers, card numbers (the check digit is made anew), IPv4 and IPv6 addresses (an IPv6 address is linked as written),
social security numbers, account numbers (IBAN, check digits made anew), calendar dates, access key ids, and values
assigned to secret names.  Long values are permuted in linked parts, in time that grows with their length.

Defined results: a null text stays null; an empty or very long text is handled whole; repeated rows get equal
results; other columns pass through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from hashlib import blake2b
from ipaddress import IPv6Address

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .workers import begin

#: For tests; a deployment passes its own key or names one in the session, since anyone can undo this one's pseudonyms.
DEFAULT_KEY = b"quillspan pseudonyms"
#: The session's setting that holds the key.
KEY_SETTING = "spark.quillspan.pii.key"
ROUNDS = 8
#: Characters of a value that are permuted as one number.
LINKED = 64
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def permute(value: int, size: int, key: bytes) -> int:
    """The place of ``value`` in a keyed permutation of range(size): a balanced Feistel network with cycle walking."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            mixed = blake2b(i.to_bytes(1, "little") + right.to_bytes(width, "little"), key=key, digest_size=max(8, width)).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "little") & mask)
        value = left << half | right
        if value < size:
            return value


def luhn_digit(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def permute_digits(text: str, key: bytes) -> str:
    """The digits of ``text`` permuted among texts of its format; everything else stays."""
    digits = re.sub(r"\D", "", text)
    return refill(text, f"{permute(int(digits), 10 ** len(digits), key):0{len(digits)}d}") if digits else text


def refill(text: str, digits: str) -> str:
    rest = iter(digits)
    return re.sub(r"\d", lambda _: next(rest), text)


def alphabet_of(c: str, hexadecimal: bool) -> str:
    if hexadecimal:
        return DIGITS + (LOWER[:6] if c.islower() or c.isdigit() else UPPER[:6])
    return next((a for a in (LOWER, UPPER, DIGITS) if c in a), c)


def permute_letters(text: str, key: bytes, hexadecimal: bool = False) -> str:
    """ASCII letters and digits of ``text`` permuted, each within its kind.

    A text longer than ``LINKED`` is permuted in parts of that length, there and back: a part's key comes from the
    parts before it in the pass, so the first pass carries every change to the end and the second one to the front.
    """
    if len(text) <= LINKED:
        return _permute_letters(text, key, hexadecimal)
    parts = [text[k : k + LINKED] for k in range(0, len(text), LINKED)]
    for _ in range(2):
        linked, made = _key(key, "linked"), []
        for part in parts:
            made.append(_permute_letters(part, linked, hexadecimal))
            linked = blake2b(part.encode(), key=linked, digest_size=32).digest()
        parts = made[::-1]
    return "".join(parts)


def _permute_letters(text: str, key: bytes, hexadecimal: bool) -> str:
    kinds = [alphabet_of(c, hexadecimal) if c.isascii() and c.isalnum() else c for c in text]
    value, size = 0, 1
    for c, kind in zip(text, kinds):
        value, size = value * len(kind) + kind.index(c), size * len(kind)
    value, out = permute(value, size, key), []
    for kind in reversed(kinds):
        value, at = divmod(value, len(kind))
        out.append(kind[at])
    return "".join(reversed(out))


def _key(key: bytes, what: str) -> bytes:
    return blake2b(what.encode(), key=key[:64], digest_size=32).digest()


def email(m: re.Match, key: bytes) -> str:
    head, _, last = m.group().rpartition(".")
    return f"{permute_letters(head.lower(), _key(key, 'email'))}.{last}"


def card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m.group())
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]):
        return None
    body = permute_digits(digits[:-1], _key(key, "card"))
    return refill(m.group(), body + str(luhn_digit(body)))


class CardReadings:
    """The card numbers in spans of digit groups that a pattern finds, which may hold other numbers beside them.

    A reading is 13 to 19 digits from one group's start to a group's end and has the right check digit.  Usual layouts
    come first, then any; earlier starts before later, longer before shorter.  No two readings share a group.
    """

    USUAL = re.compile(r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}")
    GROUP, WHOLE = re.compile(r"\d+"), re.compile(r"[\d -]+")

    def __init__(self, pattern: str):
        self.pattern = re.compile(pattern)

    def finditer(self, text: str) -> Iterator[re.Match]:
        for span in self.pattern.finditer(text):
            valid = [(*g, usual) for g in self.valid(text, *span.span()) for usual in (self.USUAL.fullmatch(text, *g[2:]),)]
            taken, found = set(), []
            for i, j, start, end, usual in sorted(valid, key=lambda r: not r[4]):
                if taken.isdisjoint(range(i, j)):
                    taken.update(range(i, j))
                    found.append((start, end))
            for start, end in sorted(found):
                yield self.WHOLE.fullmatch(text, start, end)

    def valid(self, text: str, first: int, last: int) -> Iterator[tuple[int, int, int, int]]:
        """(first group, group behind the last, start, end) of each reading with the right check digit."""
        groups = [g.span() for g in self.GROUP.finditer(text, first, last)]
        before, sums = [0], ([0], [0])  # digits before a group; check sums with the even or the odd places doubled
        for start, end in groups:
            before.append(before[-1] + end - start)
            for d in map(int, text[start:end]):
                twice = 2 * d - 9 * (d > 4)
                even = len(sums[0]) % 2
                sums[0].append(sums[0][-1] + (twice if even else d))
                sums[1].append(sums[1][-1] + (d if even else twice))
        j = 0
        for i in range(len(groups)):
            while j < len(groups) and before[j + 1] - before[i] <= 19:
                j += 1
            for k in range(j, i, -1):
                if before[k] - before[i] < 13:
                    break
                of = sums[before[k] % 2]
                if (of[before[k]] - of[before[i]]) % 10 == 0:
                    yield i, k, groups[i][0], groups[k - 1][1]


def phone(m: re.Match, key: bytes) -> str | None:
    """Country code and layout stay, so that only numbers of one layout share a range."""
    digits = re.sub(r"\D", "", m.group("rest"))
    if not 7 <= len(digits) <= 12:
        return None
    return m.group("country") + permute_digits(m.group("rest"), _key(key, "phone" + re.sub(r"\D", "", m.group("country"))))


def address(m: re.Match, key: bytes) -> str | None:
    parts = [int(p) for p in m.group().split(".")]
    if any(p > 255 for p in parts):
        return None
    return ".".join(map(str, permute(int.from_bytes(parts, "big"), 1 << 32, _key(key, "ipv4")).to_bytes(4, "big")))


def long_address(m: re.Match, key: bytes) -> str | None:
    """The layout of an IPv6 address stays; its hexadecimal digits are permuted.  Times and names of code are none."""
    try:
        IPv6Address(m.group())
    except ValueError:
        return None
    usual = re.search(r"\d", m.group()) and re.search(r"\w{3}", m.group())
    return permute_letters(m.group(), _key(key, "ipv6"), hexadecimal=True) if usual else None


def social(m: re.Match, key: bytes) -> str | None:
    area, group, serial = (int(p) for p in m.group().split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    value = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, _key(key, "social"))
    return f"{areas[value // (99 * 9999)]:03d}-{value // 9999 % 99 + 1:02d}-{value % 9999 + 1:04d}"


def account(m: re.Match, key: bytes) -> str | None:
    plain = m.group().replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = permute_letters(plain[4:], _key(key, "iban" + plain[:2]))
    made = iter(f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")
    return re.sub(r"\w", lambda _: next(made), m.group())


def _day(year: int, month: int, day: int, key: bytes) -> date | None:
    try:
        number = (date(year, month, day) - FIRST_DAY).days
    except ValueError:
        return None
    span = (LAST_DAY - FIRST_DAY).days + 1
    return FIRST_DAY + timedelta(permute(number, span, _key(key, "date"))) if 0 <= number < span else None


def year_first(m: re.Match, key: bytes) -> str | None:
    found = _day(int(m["y"]), int(m["m"]), int(m["d"]), key)
    return found and f"{found.year}{m['s']}{found.month:02d}{m['s']}{found.day:02d}"


def day_first(m: re.Match, key: bytes) -> str | None:
    """Day before month; month before day where only that is a date."""
    a, b, year = int(m["a"]), int(m["b"]), int(m["y"])
    if found := _day(year, b, a, key):
        return f"{found.day:02d}{m['s']}{found.month:02d}{m['s']}{found.year}"
    if found := _day(year, a, b, key):
        return f"{found.month:02d}{m['s']}{found.day:02d}{m['s']}{found.year}"
    return None


def secret(m: re.Match, key: bytes) -> str:
    value = m["value"]
    hexadecimal = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)) and not value.isdigit()
    return m["name"] + permute_letters(value, _key(key, "secret"), hexadecimal)


def access_key(m: re.Match, key: bytes) -> str:
    return m.group()[:4] + permute_letters(m.group()[4:], _key(key, "access key"))


#: In this order; a later pattern never sees what an earlier one has replaced.
RULES: list[tuple[str, str, Callable]] = [
    ("secret", r"(?P<name>(?i:\b(?:api[_-]?key|secret(?:[_-]?key)?|access[_-]?token|auth[_-]?token|token|password|passwd|pwd)\b)[\"']?\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9_\-./+]{8,})", secret),
    ("access key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", access_key),
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", account),
    ("date", r"(?<![\d.,/-])(?P<y>(?:19|20)\d\d)(?P<s>[-/.])(?P<m>\d\d)(?P=s)(?P<d>\d\d)(?![\d/-])", year_first),
    ("date", r"(?<![\d.,/-])(?P<a>\d\d)(?P<s>[-/.])(?P<b>\d\d)(?P=s)(?P<y>(?:19|20)\d\d)(?![\d/-])", day_first),
    ("ipv4", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)", address),
    ("ipv6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![\w:])", long_address),
    ("social", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,}(?![\d-])", card),
    ("phone", r"(?P<country>(?<![\w+])\+\d{1,3}[ .-]?)(?P<rest>\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3})(?!\d)", phone),
    ("phone", r"(?P<country>(?<![\w+(.-]))(?P<rest>\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d-])", phone),
]
#: Every rule's values hold one of these: @ in addresses, = or : before a secret, the prefix of a key id, a digit in all others.
HINT = re.compile(r"[@=:\d]|AKIA|ASIA")


def pseudonymise(text: str, key: bytes = DEFAULT_KEY, rules: list | None = None) -> tuple[str, int]:
    """(text with pseudonyms, how many values were replaced)."""
    if not HINT.search(text):
        return text, 0
    parts, count = [(text, True)], 0
    for _, pattern, make in rules or compiled_rules():
        next_parts = []
        for part, free in parts:
            last = 0
            for m in pattern.finditer(part) if free else ():
                made = make(m, key)
                if made is not None:
                    next_parts += (part[last : m.start()], True), (made, False)
                    last, count = m.end(), count + 1
            next_parts.append((part[last:] if last else part, free))
        parts = next_parts
    return "".join(p for p, _ in parts), count


_compiled: list = []


def compiled_rules() -> list:
    if not _compiled:
        _compiled.extend((name, (CardReadings if make is card else re.compile)(pattern), make) for name, pattern, make in RULES)
    return _compiled


def replace_private(docs: DataFrame, key: bytes | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; ``count`` names a column that takes the number of replaced values.

    Without ``key``, the session's setting ``KEY_SETTING`` is the key, or where that is unset ``DEFAULT_KEY``.
    """
    names, schema = docs.columns, docs.schema
    key = key or docs.sparkSession.conf.get(KEY_SETTING, "").encode() or DEFAULT_KEY
    if count:
        schema = T.StructType([*schema.fields, T.StructField(count, T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        begin("pii")
        for batch in batches:
            found = [(None, 0) if t is None else pseudonymise(t, key) for t in batch.column("text").to_pylist()]
            made = {"text": pa.array([t for t, _ in found], pa.string())}
            columns = [made.get(c, batch.column(i)) for i, c in enumerate(names)]
            if count:
                columns.append(pa.array([n for _, n in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*names, count] if count else names)

    return docs.mapInArrow(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_private(docs, count="n_replaced").select("doc_id", "n_replaced", "text", F.sha2("text", 256).alias("text_sha256"))
