"""Personal data replaced by format-preserving pseudonyms.

Candidates are found by patterns and validated: card numbers by the first and the Luhn digit, IBANs
by their remainder, social security numbers by their forbidden ranges, dates by the calendar, addresses of
machines by their octets. Where the longest reading fails, e.g. as a date, a check number or a currency
follows, shorter ends at separators are tried, then later starts. A value that fails in all of them
stays as it is. A valid one is permuted within its
format by a keyed Feistel network: the digits of a card become other digits with a right check
digit, a date another date of the same years, and separators stay. The permutation depends on the
key and the kind only, so equal values stay equal in all documents and different ones different;
with the key it can be undone.

A number may be written in several ways; it is permuted by its digits, so all of them stay linked.
Kinds in the order in which they win where spans overlap: email, iban, card, ssn, phone, date, ip.

Defined cases: a null text stays null with no finding; null and repeated ids are rows of their own;
texts of any length are scanned whole; an empty table gives an empty result.
"""

import datetime
import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.textblocks import blocks, texts_of

ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "phone", "date", "ip")
#: Dates of these years are permuted among themselves.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
    "card": re.compile(r"(?<![\w.-])\d+(?:[ -]\d+)*"),  # a run of groups, any length; ``_cards`` reads it
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
                        r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"),
    "date": re.compile(r"(?<![\w./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?=[Tt]\d{2}|(?![\w/-]|\.\d))"),
    "ip": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"),
}
#: What may not follow a card.
_CARD_TAIL = re.compile(r"[\w-]|\.\d")
_GROUP = re.compile(r"\d+")
#: Sizes of the groups in which cards are usually printed; an unbroken number is usual as well.
CARD_GROUPS = {(4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3)}
#: The length of an IBAN by country.
IBAN_LENGTHS = {country: int(n) for n, countries in (line.split(":") for line in (
    "15:NO", "16:BE", "18:DK FO FI GL NL SD FK", "19:MK SI", "20:AT BA EE KZ LT LU XK MN", "21:CH HR LI LV",
    "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG",
    "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HU LB NI PL SV",
    "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU")) for country in countries.split()}


class Feistel:
    """Keyed permutations of the numbers below any bound."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _f(self, tweak: str, turn: int, value: int, modulus: int) -> int:
        digest = hashlib.blake2b(f"{tweak}|{turn}|{value}".encode(), key=self.key, digest_size=16).digest()
        return int.from_bytes(digest, "big") % modulus

    def permute(self, value: int, bound: int, tweak: str, back: bool = False) -> int:
        """Another number below ``bound``; numbers that leave the range walk on until they are in it."""
        if bound < 2:
            return value
        left = 1
        while left * left < bound:
            left += 1 if left < 16 else left // 16
        sides = (left, -(-bound // left))
        tweak = f"{tweak}|{bound}"
        while True:
            a, b = divmod(value, sides[1])
            turns = range(self.rounds)
            for turn in reversed(turns) if back else turns:
                if turn % 2 == 0:
                    step = self._f(tweak, turn, b, sides[0])
                    a = (a - step if back else a + step) % sides[0]
                else:
                    step = self._f(tweak, turn, a, sides[1])
                    b = (b - step if back else b + step) % sides[1]
            value = a * sides[1] + b
            if value < bound:
                return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_rest(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _fill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _date_parts(value: str):
    separator = next(c for c in value if not c.isdigit())
    parts = value.split(separator)
    year_first = len(parts[0]) == 4
    return separator, year_first, [int(p) for p in (parts if year_first else reversed(parts))]


def _as_date(value: str) -> datetime.date | None:
    """A date as year, month and day, or as day, month and year; else month, day and year."""
    separator, year_first, (year, month, day) = _date_parts(value)
    for m, d in ((month, day), (day, month)):
        try:
            found = datetime.date(year, m, d)
        except ValueError:
            if year_first:
                return None
            continue
        return found if FIRST_DAY <= found <= LAST_DAY else None
    return None


def valid(kind: str, value: str) -> bool:
    digits = "".join(c for c in value if c.isdigit())
    if kind == "card":
        return 13 <= len(digits) <= 19 and digits[0] in "23456" and luhn_digit(digits[:-1]) == digits[-1]
    if kind == "iban":
        plain = value.replace(" ", "")
        return 15 <= len(plain) <= 34 and 98 - _iban_rest(plain[:2], plain[4:]) == int(plain[2:4])
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "date":
        return _as_date(value) is not None
    if kind == "ip":
        return all(int(p) <= 255 and (p == "0" or p[0] != "0") for p in value.split("."))
    return True


def _permuted_digits(cipher: Feistel, digits: str, kind: str, back: bool) -> str:
    return str(cipher.permute(int(digits), 10 ** len(digits), kind, back)).zfill(len(digits))


def _permuted_text(cipher: Feistel, value: str, kind: str, back: bool) -> str:
    """Letters and digits among those of their own class, as one number of mixed base."""
    bases = [10 if c.isdigit() else 26 for c in value if c.isalnum()]
    number, bound = 0, 1
    for c, base in zip((c for c in value if c.isalnum()), bases):
        number = number * base + (int(c) if base == 10 else ord(c.lower()) - 97)
        bound *= base
    number = cipher.permute(number, bound, f"{kind}:{''.join('d' if b == 10 else 'l' for b in bases)}", back)
    out = []
    for base in reversed(bases):
        number, d = divmod(number, base)
        out.append(str(d) if base == 10 else chr(97 + d))
    it = iter(reversed(out))
    return "".join((n.upper() if c.isupper() else n) if c.isalnum() and (n := next(it)) else c for c in value)


def pseudonym(cipher: Feistel, kind: str, value: str, back: bool = False) -> str:
    """The pseudonym of a valid value, or with ``back`` the value of a pseudonym."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == "card":
        body = digits[:-1]
        while True:  # walk on until it begins like a card
            body = _permuted_digits(cipher, body, "card", back)
            if body[0] in "23456":
                return _fill(value, body + luhn_digit(body))
    if kind == "iban":
        plain = value.replace(" ", "")
        body = _permuted_text(cipher, plain[4:], "iban", back)
        it = iter(plain[:2] + f"{98 - _iban_rest(plain[:2], body):02d}" + body)
        return "".join(c if c == " " else next(it) for c in value)
    if kind == "ssn":  # walk on until the ranges are right again
        while True:
            digits = _permuted_digits(cipher, digits, "ssn", back)
            if valid("ssn", f"{digits[:3]}-{digits[3:5]}-{digits[5:]}"):
                return _fill(value, digits)
    if kind == "phone":
        code = 0
        if value.startswith("+"):  # the country code stays
            code = len(re.match(r"\+(\d{1,3}?)(?=[ .(-]|\d{10}$)|\+(\d{1,3})", value)[0]) - 1
        return _fill(value, digits[:code] + _permuted_digits(cipher, digits[code:], "phone", back))
    if kind == "date":
        separator, year_first, (_, month, day) = _date_parts(value)
        swapped = not year_first and month > 12
        days = (LAST_DAY - FIRST_DAY).days + 1
        at = cipher.permute((_as_date(value) - FIRST_DAY).days, days, "date", back)
        other = FIRST_DAY + datetime.timedelta(at)
        parts = [f"{other.year:04d}", f"{other.month:02d}", f"{other.day:02d}"]
        if not year_first:
            parts = [parts[1], parts[2], parts[0]] if swapped else [parts[2], parts[1], parts[0]]
        return separator.join(parts)
    if kind == "ip":
        number = 0
        for p in value.split("."):
            number = number << 8 | int(p)
        number = cipher.permute(number, 1 << 32, "ip", back)
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    local, _, domain = value.rpartition("@")
    return f"{_permuted_text(cipher, local, 'email', back)}@{domain}"


def _card_end(text: str, groups: list[tuple[int, int]], used: list[bool], i: int, usual: bool) -> int | None:
    """The last group of the longest valid card that begins with group ``i`` of a run."""
    start = groups[i][0]
    if text[start] not in "23456" or (i and text[start - 1] != " "):
        return None
    ends, n = [], 0
    for j in range(i, len(groups)):
        n += groups[j][1] - groups[j][0]
        if n > 19 or used[j]:
            break
        if n >= 13 and (j + 1 < len(groups) or not _CARD_TAIL.match(text, groups[j][1])):
            ends.append(j)
    for j in reversed(ends):
        if usual and j > i and tuple(b - a for a, b in groups[i:j + 1]) not in CARD_GROUPS:
            continue
        if valid("card", text[start:groups[j][1]]):
            return j
    return None


def _cards(text: str, free):
    """Spans of the valid cards within runs of free digit groups: first in usual groups, then in any."""
    for run in PATTERNS["card"].finditer(text):
        if run.end() - run.start() < 13:
            continue
        groups = [m.span() for m in _GROUP.finditer(text, *run.span())]
        used = [not free(a, b) for a, b in groups]
        for usual in (True, False):
            i = 0
            while i < len(groups):
                j = None if used[i] else _card_end(text, groups, used, i, usual)
                if j is None:
                    i += 1
                    continue
                used[i:j + 1] = [True] * (j + 1 - i)
                yield groups[i][0], groups[j][1]
                i = j + 1


def _ends(kind: str, m: re.Match) -> list[int]:
    """Where a value that begins with the match may end: the country's length, then the longest first."""
    if kind not in ("iban", "phone"):
        return [m.end()]
    inner = [m.start() + k for k, c in enumerate(m[0]) if c in (" " if kind == "iban" else " .-")]
    ends = [m.end(), *(e for e in reversed(inner) if m.re.fullmatch(m.string, m.start(), e))]
    if kind == "iban":
        wanted = IBAN_LENGTHS.get(m[0][:2])
        ends.sort(key=lambda e: len(m.string[m.start():e].replace(" ", "")) != wanted)
    return ends


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of valid values, in order and without overlap."""
    taken: list[tuple[int, int, str]] = []  # in order after each kind, and without overlap

    def free(start: int, end: int) -> bool:
        at = bisect_left(taken, (end,))  # the spans before it begin before ``end``, the last of them ends last
        return not at or taken[at - 1][1] <= start

    for kind in KINDS:
        if kind == "email" and "@" not in text:
            continue
        found = []
        if kind == "card":
            taken = sorted(taken + [(a, b, kind) for a, b in _cards(text, free)])
            continue
        at = 0
        while m := PATTERNS[kind].search(text, at):
            start, at = m.start(), m.start() + 1
            for end in _ends(kind, m):
                if valid(kind, text[start:end]) and free(start, end):
                    found.append((start, end, kind))
                    at = end
                    break
        taken = sorted(taken + found)
    return taken


def replace(text: str, cipher: Feistel, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], pseudonym(cipher, kind, text[start:end])]
        at = end
    return "".join(out) + text[at:]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: (doc_id, text, n_found, kinds), the text with its pseudonyms."""
    kind = dict(docs.dtypes)[ident]

    def work(batches):
        cipher = Feistel(key)
        for batch in batches:
            column = batch.column("text")
            n = batch.num_rows
            found, kinds, changed = np.zeros(n, np.int64), [""] * n, {}
            for low, high, data, offsets in blocks(texts_of(column)):
                telling = ((data >= 48) & (data <= 57)) | (data == 64)
                marks = np.concatenate([[0], np.cumsum(telling)])[offsets]
                for i in np.flatnonzero(np.diff(marks)):
                    body = data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    spans = find(body)
                    if spans:
                        changed[low + i] = replace(body, cipher, spans)
                        found[low + i] = len(spans)
                        kinds[low + i] = ",".join(k for k in KINDS if any(s[2] == k for s in spans))
            if changed:
                whole = column.to_pylist()
                for i, body in changed.items():
                    whole[i] = body
                column = pa.array(whole, column.type)
            yield pa.RecordBatch.from_arrays([batch.column("id"), column, pa.array(found), pa.array(kinds, pa.string())],
                                             ["doc_id", "text", "n_found", "kinds"])

    return (docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
            .mapInArrow(work, f"doc_id {kind}, text string, n_found long, kinds string"))
