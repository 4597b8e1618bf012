"""Format-preserving pseudonyms: validated numbers and dates are permuted within their format by a keyed Feistel network.

A value's digits (or letters, day, address) are a number below some N; the network permutes 0..N-1 under the key and the format's
name, walking on while a result is N or more. So a value always gets the same pseudonym, different values get different ones, check
digits are made anew, separators stay, and who holds the key can turn the permutation back.

Formats: cards (Luhn), IBANs (mod 97), social security numbers (valid areas, groups, serials), IPv4 addresses, calendar dates from
1900 to 2099, telephone numbers, and mail addresses (letters and digits permuted in place, the last label kept). Equal digits with
other separators stay linked: a telephone number's country code is told by its digits, not by what separates it, and mail addresses
that differ in case get pseudonyms that differ in case. Finds are taken in that order of trust and don't overlap. Everything else in
a text is left alone; no find has a limit of length but its format's own.

Null text stays null; empty text stays empty; null ids stay null; ids are integers; repeated rows are done each; other columns are left
out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import RELEASE, id_and_bytes, slices, worker_of

ROUNDS = 8
#: In UTF-8, by length: Latin letters beyond ASCII, marks on letters, full-width digits and letters. No value begins or ends beside
#: these or ASCII's; beside other scripts, punctuation and symbols it may.
LATIN_2 = rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9\xcc][\x80-\xbf]|[\xca\xcd][\x80-\xaf])"
LATIN_3 = (
    rb"(?:\xe1[\xb8-\xbb][\x80-\xbf]|\xe2\xb1[\xa0-\xbf]|\xea(?:\x9c[\xa0-\xbf]|[\x9d-\x9f][\x80-\xbf]|\xac[\xb0-\xbf]|\xad[\x80-\xaf])"
    rb"|\xef(?:\xac[\x80-\x86]|\xbc[\x90-\x99\xa1-\xba]|\xbd[\x81-\x9a]))"
)
NO_LATIN, LATIN = rb"(?<!" + LATIN_2 + rb")(?<!" + LATIN_3 + rb")", LATIN_2 + rb"|" + LATIN_3
L, R = rb"(?<![0-9A-Za-z_])" + NO_LATIN, rb"(?![0-9A-Za-z_]|" + LATIN + rb")"
PATTERNS = [
    ("iban", L + rb"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)" + R),
    ("card", rb"(?<![0-9A-Za-z_.])" + NO_LATIN + rb"(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{5})" + R),
    ("ssn", rb"(?<![0-9A-Za-z_\-])" + NO_LATIN + rb"[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-)" + R),
    ("ip", rb"(?<![0-9A-Za-z_.])" + NO_LATIN + rb"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?(?:[0-9A-Za-z_]|" + LATIN + rb"))"),
    ("date", L + rb"(?:[0-9]{4}([\-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([\-/.])[0-9]{1,2}\2[0-9]{4})" + R),
    ("phone", L + rb"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\) ?[0-9]{3,4}[ .\-]?[0-9]{3,4}|[0-9]{3}([ .\-])[0-9]{3}\1[0-9]{4})" + R),
    ("phone", L + rb"\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,5}){2,5}" + R),
]
FINDERS = [(kind, re.compile(p)) for kind, p in PATTERNS]
#: What stands before and after the sign of a mail address.
MAIL_LOCAL, MAIL_DOMAIN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-", re.compile(rb"(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}" + R)
#: Country calling codes of two digits; those that begin with 1 or 7 have one, all others three (fixed values).
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
DAY_0, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() - datetime.date(1900, 1, 1).toordinal() + 1


def permute(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..n-1: alternating Feistel on x = l * b + r, walked until the result is below n."""
    if n < 2:
        return x
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    while True:
        l, r = divmod(x, b)
        for k in order:
            half = r if k % 2 == 0 else l
            f = int.from_bytes(blake2b(b"%d/%d/%s/%d" % (k, n, tweak.encode(), half), key=key, digest_size=24).digest(), "big")
            f = -f if back else f
            l, r = ((l + f) % a, r) if k % 2 == 0 else (l, (r + f) % b)
        x = l * b + r
        if x < n:
            return x


def luhn_digit(body: str) -> str:
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def refill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def digits_of(s: str) -> str:
    return re.sub(r"\D", "", s)


def shift_digits(d: str, key: bytes, tweak: str, back: bool) -> str:
    return str(permute(int(d), 10 ** len(d), key, f"{tweak}{len(d)}", back)).zfill(len(d)) if d else d


def country_code(digits: str) -> str:
    """The country code that the digits of an international number begin with."""
    return digits[:1] if digits[:1] in ("1", "7") else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def shift_text(s: str, key: bytes, tweak: str, back: bool) -> str:
    """Letters and digits of ``s`` permuted as one number in mixed radix; each place keeps its kind."""
    kinds = [("0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isascii() and c.isalnum() else "" for c in s]
    n, x = 1, 0
    for c, k in zip(s, kinds):
        if k:
            x, n = x * len(k) + k.index(c), n * len(k)
    form = "".join(k[:1] or c for c, k in zip(s, kinds))
    x, out = permute(x, n, key, tweak + form, back), []
    for c, k in zip(reversed(s), reversed(kinds)):
        if k:
            x, at = divmod(x, len(k))
            c = k[at]
        out.append(c)
    return "".join(reversed(out))


def card(s: str, key: bytes, back: bool) -> str | None:
    d = digits_of(s)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[0] + shift_digits(d[1:-1], key, "card", back)
    return refill(s, body + luhn_digit(body))


def iban(s: str, key: bytes, back: bool) -> str | None:
    bare = s.replace(" ", "")
    mod = lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
    if not 15 <= len(bare) <= 34 or mod(bare[4:] + bare[:4]) != 1:
        return None
    body = shift_text(bare[4:], key, "iban", back)
    new = f"{bare[:2]}{98 - mod(body + bare[:2] + '00'):02}{body}"
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in s)


def ssn(s: str, key: bytes, back: bool) -> str | None:
    a, g, n = (int(x) for x in s.split("-"))
    if a in (0, 666) or a > 899 or not g or not n:
        return None
    x = permute(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1, 898 * 99 * 9999, key, "ssn", back)
    x, n = divmod(x, 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03}-{g + 1:02}-{n + 1:04}"


def ip(s: str, key: bytes, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def date(s: str, key: bytes, back: bool) -> str | None:
    sep = next(c for c in s if not c.isdigit())
    parts = s.split(sep)
    if len(parts[0]) == 4:
        order = (0, 1, 2)
    else:  # the day first, unless that can't be or the separator says otherwise
        order = (2, 0, 1) if (sep == "/" and int(parts[0]) <= 12) or int(parts[1]) > 12 else (2, 1, 0)
    try:
        day = datetime.date(*(int(parts[k]) for k in order)).toordinal() - DAY_0
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    padded = all(len(parts[k]) == 2 for k in order[1:])
    while True:  # months and days may trade places where the order was read from the value: walk on until it reads back the same
        day = permute(day, DAYS, key, "date", back)
        new = datetime.date.fromordinal(DAY_0 + day)
        out = ["", "", ""]
        for k, v, w in zip(order, (new.year, new.month, new.day), (4, 2, 2)):
            out[k] = f"{v:0{w}}" if padded or w == 4 else str(v)
        again = (0, 1, 2) if len(out[0]) == 4 else ((2, 0, 1) if (sep == "/" and int(out[0]) <= 12) or int(out[1]) > 12 else (2, 1, 0))
        if again == order and all(len(out[k]) == 2 for k in order[1:]) == padded:
            return sep.join(out)


def phone(s: str, key: bytes, back: bool) -> str | None:
    d = digits_of(s)
    code = country_code(d) if s[0] == "+" else ""
    d = d[len(code) :]
    if not 7 <= len(d) <= 13:
        return None
    if len(d) == 10 and code in ("", "1") and d[0] > "1" and d[3] > "1":
        x = permute((int(d[:3]) - 200) * 800 * 10**4 + (int(d[3:6]) - 200) * 10**4 + int(d[6:]), 800 * 800 * 10**4, key, "phone", back)
        x, line = divmod(x, 10**4)
        new = f"{x // 800 + 200}{x % 800 + 200}{line:04}"
    elif len(d) == 10 and code in ("", "1"):  # never into the numbers above
        while True:
            new = shift_digits(d, key, "phone-other", back)
            if not (new[0] > "1" and new[3] > "1"):
                break
            d = new
    else:
        new = shift_digits(d, key, "phone" + code, back)
    return refill(s, code + new)


def mail(s: str, key: bytes, back: bool) -> str | None:
    head, _, top = s.rpartition(".")
    new = shift_text(head.lower(), key, "mail", back)
    return f"{''.join(n.upper() if c.isupper() else n for c, n in zip(head, new))}.{top}"


SHIFTS = {"card": card, "iban": iban, "ssn": ssn, "ip": ip, "date": date, "phone": phone, "mail": mail}


@lru_cache(maxsize=50_000)
def shifted(kind: str, value: bytes, key: bytes, back: bool = False) -> bytes | None:
    new = SHIFTS[kind](value.decode("ascii"), key, back)
    return None if new is None else new.encode()


RELEASE.append(shifted.cache_clear)


def mails(text: bytes) -> Iterator[tuple[int, int]]:
    """Spans of mail addresses, each with all of its local part."""
    low, at = 0, text.find(b"@")
    while at >= 0:
        domain = MAIL_DOMAIN.match(text, at + 1)
        head = text[low:at]
        own = head[len(head.rstrip(MAIL_LOCAL)) :].lstrip(b"._%+-")
        low = at + 1
        if domain and own:
            yield at - len(own), domain.end()
            low = domain.end()
        at = text.find(b"@", low)


def spans(text: bytes) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what may be a value, in order of trust."""
    yield from (("mail", a, b) for a, b in mails(text))
    for kind, finder in FINDERS:
        yield from ((kind, *m.span()) for m in finder.finditer(text))


def finds(text: bytes, key: bytes, back: bool = False) -> list[tuple[int, int, str, bytes]]:
    """(start, end, kind, pseudonym) of every valid value, by place, without overlaps."""
    out: list[tuple[int, int, str, bytes]] = []
    if not HAS_DIGIT.search(text) and b"@" not in text:
        return out
    taken = bytearray(len(text))
    for kind, a, b in spans(text):
        if 1 in taken[a:b]:
            continue
        new = shifted(kind, text[a:b], key, back)
        if new is not None:
            out.append((a, b, kind, new))
            taken[a:b] = b"\1" * (b - a)
    return sorted(out)


HAS_DIGIT = re.compile(rb"[0-9]")


def replaced(text: bytes, found: list[tuple[int, int, str, bytes]]) -> bytes:
    parts, at = [], 0
    for a, b, _, new in found:
        parts += [text[at:a], new]
        at = b
    return b"".join([*parts, text[at:]])


FIND = "array<struct<kind string, start bigint, end bigint>>"


def pseudonym_batches(batches: Iterator[pa.RecordBatch], key: bytes, back: bool) -> Iterator[pa.RecordBatch]:
    worker_of("pii")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in (part for whole in batches for part in slices(whole)):
        texts = batch.column(1).to_pylist()
        found = [finds(t, key, back) if t else [] for t in texts]
        new = [replaced(t, f) if f else t for t, f in zip(texts, found)]
        spans = [[{"kind": k, "start": a, "end": b} for a, b, k, _ in f] for f in found]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([None if t is None else t.decode("utf-8", "replace") for t in new], pa.string()), pa.array(spans, kind)], ["doc_id", "text", "finds"])


def pseudonymized(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, and what was found where (bytes of the text as it was). ``back`` undoes it."""
    return id_and_bytes(docs).mapInArrow(lambda it: pseudonym_batches(it, key, back), f"doc_id bigint, text string, finds {FIND}")
