"""Secret scans: patterns propose candidates, a random forest removes the false ones.

A candidate is a value after a name and a sign of assignment, a token of a known issuer's form, a private key block, or a long mixed
run of letters and digits. The forest sees its length, how its characters follow one another, how much of it words of the dictionary
cover, whether it stands in a path, and its neighbouring words. It is trained from labelled findings: (text, start, end, kind, label)
rows, by default those of ``example_findings``, a seeded set of invented true and false findings; callers may pass their own.

A candidate is a whole run, however long; features see all of it. Null text has no candidates and stays null; empty text stays empty;
null ids stay null; ids are integers; repeated rows are scanned each; an empty table gives an empty result. Other columns are left
out unless the caller keeps them; a kept column with the name of a result (text, finds, n_candidates) gives way to it.
"""

from __future__ import annotations

import base64
import math
import random
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, worker_of
from .forest import Forest

NAMES = rb"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth(?:orization)?|bearer|credentials?"
KINDS = ["assigned", "issued", "block", "mixed"]
FINDERS = [
    ("block", re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s\\]{16,}-----END (?:[A-Z]+ )*PRIVATE KEY-----")),
    # prefixes of issuers' public token forms (fixed values)
    ("issued", re.compile(rb"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,})(?![A-Za-z0-9_])")),
    ("assigned", re.compile(rb"(?i)(?<![a-z])(?:" + NAMES + rb")s?[\"']?\s{0,3}(?::=|=>|[:=]|\s)\s{0,3}[\"']?([^\s\"'<>,;|]{6,})")),
    ("mixed", re.compile(rb"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20,}={0,2}")),
]
#: What finds of the kinds before leave of a candidate, where it is long enough to be one.
FREE, FREE_MIXED = re.compile(rb"\0{6,}"), re.compile(rb"\0{20,}")
DIGIT = re.compile(rb"[0-9]")
HINT = re.compile(rb"(?i)pass|pwd|secret|token|key|auth|bearer|credential")
TRUE_WORDS = re.compile(rb"(?i)pass|pwd|secret|token|key|auth|bearer|credential|login|account")
FALSE_WORDS = re.compile(rb"(?i)sha|md5|hash|checksum|digest|commit|uuid|guid|revision|version|example|placeholder|sample|test|dummy|integrity|etag|href|src|url")
#: Common words and word parts for the dictionary coverage (fixed values).
DICTIONARY = """about access account action address admin after again all and any app are array back base been before being bin bool build
but call case change class client code com config connection content count create data database date debug default delete dev doc does
down each edit end env error event example false field file find first float for format from function get group handle have head help here
home host how html http https id image import index info input int into item its java json key last length lib like line link list load local log
long main make map master max message method min mode model module more name net new next node not null number object off old one only open
option order org other out over own package page param part pass password path place placeholder plugin point port post print private
process public python query read remote remove request response result return root run sample save script search secret section select
self server service session set should show size some source start state static status stop store string style sub sys system table
tag target task temp test text that the their them then there these they this time title token tool top total true type update url use
user util value var version view want was web what when where which while who will with word work world would write xml year you your""".split()
WORDS = {w for w in DICTIONARY if len(w) > 2}
CLASS_OF = np.full(256, 3)
CLASS_OF[48:58], CLASS_OF[65:91], CLASS_OF[97:123] = 0, 1, 2
FEATURES = ["length", "digits", "uppers", "lowers", "others", "transitions", "entropy", "distinct", "dictionary", "hex", "vowels", "runs", "path", "slashes", "dots", "true_word", "false_word", "quoted", "uuid", "repeats", *KINDS]


def covered(text: bytes) -> float:
    """The share of the letters that words of the dictionary cover, longest first."""
    low, at, got = text.lower().decode("ascii", "replace"), 0, 0
    while at < len(low):
        for n in range(min(12, len(low) - at), 2, -1):
            if low[at : at + n] in WORDS:
                got, at = got + n, at + n
                break
        else:
            at += 1
    return got / max(len(low), 1)


def features_of(text: bytes, start: int, end: int, kind: str) -> list[float]:
    value = text[start:end]
    n = max(len(value), 1)
    raw = np.frombuffer(value, np.uint8)
    kinds = CLASS_OF[raw]
    share = np.bincount(kinds, minlength=4) / n
    hist = np.bincount(raw, minlength=256) / n
    hist = hist[hist > 0]
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    return [
        math.log(n),
        *share,
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        float(-(hist * np.log2(hist)).sum()),
        len(set(value)) / n,
        covered(value),
        sum(c in b"0123456789abcdefABCDEF" for c in value) / n,
        sum(c in b"aeiouAEIOU" for c in value) / n,
        float((raw[1:] == raw[:-1]).mean()) if n > 1 else 0.0,
        float(before[-1:] in (b"/", b"\\") or after[:1] == b"/" or b"://" in before[-12:]),
        value.count(b"/") / n,
        value.count(b".") / n,
        float(bool(TRUE_WORDS.search(before))),
        float(bool(FALSE_WORDS.search(before))),
        float(before[-1:] in (b'"', b"'")),
        float(bool(re.fullmatch(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        float(len(set(value)) <= 4),
        *(float(kind == k) for k in KINDS),
    ]


def candidates(text: bytes) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    taken = None
    hint = HINT.search(text) is not None
    for kind, finder in FINDERS:
        if (kind == "assigned" and not hint) or (kind == "block" and b"PRIVATE KEY" not in text):
            continue
        for m in finder.finditer(text):
            a, b = m.span(1) if kind == "assigned" else m.span()
            if kind == "assigned":
                while b > a and text[b - 1] in b"!?.$&%#*:)]}":
                    b -= 1
            if b - a < 6 or (kind == "mixed" and not DIGIT.search(text, a, b)):
                continue
            taken = bytearray(len(text)) if taken is None else taken
            for free in (FREE_MIXED if kind == "mixed" else FREE).finditer(bytes(taken[a:b])):
                c, d = a + free.start(), a + free.end()
                taken[c:d] = b"\1" * (d - c)
                out.append((c, d, kind))
    return sorted(out)


def example_findings(each: int = 60, seed: int = 5) -> list[tuple[bytes, int, int, str, int]]:
    """Labelled findings: invented secrets in the ways they leak, and what scanners mistake for them."""
    draw = random.Random(seed)
    pick = lambda chars, n: "".join(draw.choice(chars) for _ in range(n))
    hexa, b32, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["th", "er", "on", "an", "re", "ti", "es", "in", "ed", "or", "la", "que", "de", "ver", "sch", "ción", "ment", "ou", "be", "ge"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    mixed = lambda n: pick(alnum + "!@#$%^&*-_", n)
    name = lambda: draw.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth", "TOKEN", "Password"])
    sign = lambda: draw.choice(["=", " = ", ": ", ":", "=\"", " = \"", "\": \""])
    ident = lambda: "_".join(draw.choice(DICTIONARY) for _ in range(draw.randint(2, 4)))
    true = [
        lambda: (f"{name()}{sign()}", pick(hexa, draw.choice([16, 18, 20, 32, 40, 64]))),
        lambda: (f"{name()}{sign()}", pick(hexa, draw.choice([16, 18, 20, 32, 40, 64])).upper()),
        lambda: (f"{name()}{sign()}", pick(alnum, draw.randint(16, 48))),
        lambda: (f"{name()}{sign()}", mixed(draw.randint(10, 24))),
        lambda: ("", "AKIA" + pick(b32, 16)),
        lambda: (f"{name()}{sign()}", "AKIA" + pick(b32, 16)),
        lambda: ("", "ghp_" + pick(alnum, 36)),
        lambda: ("", "sk-" + pick(alnum, 40)),
        lambda: ("Authorization: Bearer ", pick(alnum + "-_", 40)),
        lambda: (f"{name()}{sign()}", base64.b64encode(draw.randbytes(30)).decode()),
    ]
    false = [
        lambda: (f"{draw.choice(['sha1', 'sha256', 'md5', 'commit', 'checksum', 'digest', 'etag', 'revision'])}{draw.choice([': ', '=', ' '])}", pick(hexa, draw.choice([32, 40, 64]))),
        lambda: (f"{draw.choice(['id', 'uuid', 'guid', 'request'])}{sign()}", str(uuid.UUID(int=draw.getrandbits(128)))),
        lambda: (f"{name()}{draw.choice([': ', ' = ', ' '])}", ident()),
        lambda: (f"{name()}{draw.choice([': ', ' ', ' = '])}", word() + word()),
        lambda: (f"{name()}{sign()}", draw.choice(["<your-token-here>", "your_api_key", "changeme", "xxxxxxxxxxxx", "********", "${TOKEN}", "os.environ['KEY']", "placeholder123", "example_secret_key"])),
        lambda: (f"https://{word()}.com/{word()}/", f"{ident()}/{draw.randint(1, 9999)}/{ident()}.html"),
        lambda: (f"src/{word()}/", f"{ident()}/{ident()}_v{draw.randint(1, 99)}/main.py"),
        lambda: ("integrity=", "sha384-" + base64.b64encode(draw.randbytes(48)).decode()),
        lambda: (f"{word()} ", f"{word()}{word()}{word()}{word()}-{draw.randint(10, 9999)}-{ident()}"),
        lambda: (f"{word()} ", pick("0123456789", draw.randint(20, 30))),
        lambda: (f"{word()} ", pick(hexa, draw.choice([24, 32, 40]))),
    ]
    out = []
    for label, makers in ((1, true), (0, false)):
        for make in makers:
            for _ in range(each):
                before, value = make()
                head = f"{prose(draw.randint(0, 6))} {before}".encode()
                text = head + value.encode() + (b'"' if before.endswith('"') else b"") + f"{draw.choice(['', '.', ' ', '***', '!!'])} {prose(3)}".encode()
                span = next(((a, b, k) for a, b, k in candidates(text) if a < len(head) + len(value.encode()) and b > len(head)), None)
                if span:
                    out.append((text, *span, label))
    return out


def trained(findings: list[tuple[bytes, int, int, str, int]]) -> Forest:
    x = np.array([features_of(t, a, b, k) for t, a, b, k, _ in findings])
    return Forest(x, np.array([label for *_, label in findings]))


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    return trained(example_findings())


SCAN = "doc_id bigint, text string, n_candidates bigint, finds array<struct<kind string, start bigint, end bigint, score double>>"


def scan_batches(batches: Iterator[pa.RecordBatch], forest: Forest, least: float, mask: bytes) -> Iterator[pa.RecordBatch]:
    worker_of("secrets")
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in (part for whole in batches for part in slices(whole)):
        texts = batch.column(1).to_pylist()
        rows, values = [], []
        for k, t in enumerate(texts):
            for a, b, kind in candidates(t) if t else ():
                rows.append((k, a, b, kind))
                values.append(features_of(t, a, b, kind))
        scores = forest(np.array(values)) if values else []
        n, found = [0] * len(texts), [[] for _ in texts]
        for (k, a, b, kind), score in zip(rows, scores):
            n[k] += 1
            if score >= least:
                found[k].append({"kind": kind, "start": a, "end": b, "score": float(score)})
        new = []
        for t, f in zip(texts, found):
            if f:
                parts, at = [], 0
                for x in f:
                    parts += [t[at : x["start"]], mask]
                    at = x["end"]
                t = b"".join([*parts, t[at:]])
            new.append(None if t is None else t.decode("utf-8", "replace"))
        own = [batch.column(0).cast(pa.int64()), pa.array(new, pa.string()), pa.array(n, pa.int64()), pa.array(found, kind_of)]
        yield pa.RecordBatch.from_arrays([*own, *batch.columns[2:]], ["doc_id", "text", "n_candidates", "finds", *batch.schema.names[2:]])


def scanned(docs: DataFrame, forest: Forest | None = None, least: float = 0.5, mask: bytes = b"[SECRET]", keep: list[str] = ()) -> DataFrame:
    """doc_id, text with its secrets masked, the number of candidates, the finds (bytes of the text as it was), and ``keep``."""
    forest = forest or default_forest()
    keep = [c for c in keep if c not in ("doc_id", "text", "n_candidates", "finds")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), *keep)
    schema = ", ".join([SCAN, *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:])])
    return rows.mapInArrow(lambda it: scan_batches(it, forest, least, mask), schema)
