"""Personal data by weak supervision.

Base rules find e-mail addresses, IP addresses, card and phone numbers; they always stay.  Looser patterns add
candidates (numbers that fail a base check, phone numbers without a plus sign, spelled-out addresses, credentials, bank account numbers,
national numbers, and given names with the capitalised word after them).
Labelers of three sorts vote yes, no or nothing on each candidate, base matches included: *regex*
labelers (the strict form, the usual length), *gazetteers* (top-level domains, calling codes, card issuers, address ranges,
key prefixes, countries of account numbers, areas of national numbers, given names) and *context* labelers (words around the span, characters that touch it).
Expectation maximisation (two classes, one confusion row per labeler and kind) estimates the labelers' reliabilities from
the counts of vote patterns and gives each pattern a probability.  A logistic span classifier is trained on these soft
labels.  Its features go beyond the votes: their agreement in pairs, the span's shape (separators, letters) and which word stands before it (one of ``BEFORE`` hash
classes), so it also learns contexts that no labeler lists; candidates it gives ``ACCEPT`` or more are added
where they overlap no accepted span.

Scale: one map over whole texts writes the spans and vote patterns (a few numbers per candidate) to the shared
folder; patterns are counted with a map-side combine.  There are at most ``PATTERNS`` of them whatever the input, so what
the driver collects and broadcasts is bounded.  All documents count; nothing is sampled.

Nulls, ties, repeats: NULL text is empty and has no spans; a NULL id is kept; repeated rows each give a row (and count as
often); spans are ordered by start, then kind as listed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_text

KINDS = ["email", "ip", "card", "phone", "secret", "iban", "national", "person"]
BASE = 4                              # the first four have base rules
EMAIL, IP, CARD, PHONE, SECRET, IBAN, NATIONAL, PERSON = range(8)
ACCEPT = 0.5
LABELERS = ["strict", "length", "gazetteer", "words", "touch"]
SHAPES = 4
BEFORE = 16
PATTERNS = len(KINDS) * 3 ** len(LABELERS) * SHAPES * BEFORE
EM_ROUNDS = 50

# Possessive forms of the base patterns: the same leftmost matches, linear on long runs of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ANY = re.compile("[0-9@]")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])")
# From the end of the local part on, which is read backwards.  Whole runs: the length labeler judges unusual ones.
_SPELLED = re.compile(r" ?[(\[ ]at[)\] ] ?[A-Za-z0-9-]++(?: ?[(\[ ]dot[)\] ] ?[A-Za-z0-9-]{2,}+)+")
_SECRET = re.compile(r"\b(?:(?:password|passwd|secret|token|api_key)[=:][^\s]{6,}+|[A-Z]{4}[A-Z0-9]{16}\b|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9]{20,}+)")

_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?\b")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NAMED = re.compile(r"\b([A-Z][a-z]{2,12}) (?:[A-Z]\. )?[A-Z][a-z]{1,20}\b")

# Fixed lists of the gazetteers and context labelers.
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15,
               "PL": 28, "PT": 25, "SE": 24}
GIVEN = {"Alice", "Anna", "Anne", "Antonio", "Barbara", "Carlos", "Carmen", "Charles", "Claude", "David", "Elizabeth", "Emma", "Francisco", "Hans", "Isabel",
         "James", "Jean", "Jennifer", "Jessica", "John", "Jorge", "Joseph", "Juan", "Karen", "Klaus", "Laura", "Linda", "Lisa", "Luis", "Manuel", "Maria",
         "Marie", "Martin", "Mary", "Michael", "Michel", "Monika", "Nancy", "Nicolas", "Patricia", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Richard",
         "Robert", "Sabine", "Sarah", "Sophie", "Stefan", "Stephen", "Susan", "Thomas", "Ursula", "William", "Wolfgang"}
DOMAINS = {"com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "it", "nl", "uk", "us", "eu", "ch", "at", "jp", "cn", "in", "br", "ca", "au"}
CALLING = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "61", "62", "63", "64", "65", "81", "82", "86", "90", "91"}
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|3[68]")
KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "password", "passwd", "secret", "token", "api_key")
WORDS_FOR = {
    EMAIL: {"mail", "email", "e-mail", "contact", "write", "address", "from", "to"},
    IP: {"ip", "host", "server", "address", "login", "from", "ping", "client"},
    CARD: {"card", "visa", "mastercard", "amex", "payment", "credit", "debit", "paid", "karte", "carte", "tarjeta"},
    PHONE: {"phone", "call", "tel", "telephone", "mobile", "fax", "cell", "reach", "telefon", "telefono"},
    SECRET: {"key", "password", "secret", "token", "login", "credentials", "aws"},
    IBAN: {"iban", "account", "bank", "transfer", "konto", "bankverbindung", "compte", "cuenta"},
    NATIONAL: {"ssn", "social", "security", "insurance", "taxpayer", "tin"},
    PERSON: {"mr", "mrs", "ms", "dr", "herr", "frau", "monsieur", "madame", "senor", "dear", "name", "by", "patient", "customer", "from"},
}
WORDS_AGAINST = {"version", "isbn", "issn", "figure", "section", "table", "page", "order", "serial", "part", "chapter", "no", "vol"}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _checks_out(iban: str) -> bool:
    """Length of the country and remainder 1 modulo 97."""
    turned = iban[4:] + iban[:4]
    return IBAN_LENGTH.get(iban[:2], len(iban)) == len(iban) and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _issued(national: str) -> bool:
    """Whether the number's area, group and serial are ones that are given out."""
    area, group, serial = national.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.domain: the local part cannot hold an @, so each @ is tried once, from
    the first character of the run before it that no earlier match took."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and _LOCAL.match(text, s - 1):
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
        # a local part never reaches back over an @
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def _spelled(text: str) -> list[tuple[int, int]]:
    """Spelled-out addresses with their whole local parts, which no earlier match took."""
    out, free, m = [], 0, _SPELLED.search(text)
    while m:
        s = m.start()
        while s > free and _LOCAL.match(text, s - 1):
            s -= 1
        if s < m.start():
            out.append((s, m.end()))
            free = m.end()
        m = _SPELLED.search(text, m.end() if s < m.start() else m.start() + 1)
    return out


def matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes) of the base patterns, failing matches included."""
    if not _ANY.search(text):
        return []
    out = [(EMAIL, s, e, True) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        out.append((IP, m.start(), m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12:
            d = _digits(m[0])
            out.append((CARD, m.start(), m.end(), 12 <= len(d) <= 19 and _luhn(d)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            out.append((PHONE, m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by start, then kind."""
    return sorted(((k, s, e) for k, s, e, ok in matches(text) if ok), key=lambda x: (x[1], x[0]))


def _votes(kind: int, text: str, s: int, e: int, strict: bool) -> list[int]:
    """1, 0 or -1 of each labeler."""
    span = text[s:e]
    digits = _digits(span[:256])
    usual = {EMAIL: 6 <= e - s <= 64, IP: 7 <= e - s <= 15, CARD: len(digits) in (15, 16), PHONE: 10 <= len(digits) <= 13,
             SECRET: 10 <= e - s <= 64, IBAN: 15 <= e - s <= 34, NATIONAL: True, PERSON: 7 <= e - s <= 30}[kind]
    if kind == EMAIL:
        known = 1 if re.split(r"[.\s()\[\]]+", span.rstrip(")]"))[-1].lower() in DOMAINS else -1
    elif kind == IP:
        first = span.split(".")[0].lstrip("0")
        known = -1 if not first or len(first) > 3 or int(first) > 223 else 1
    elif kind == CARD:
        known = 1 if ISSUERS.match(digits) else -1
    elif kind == PHONE:
        known = 0 if span[0] != "+" else 1 if any(digits[:k] in CALLING for k in (1, 2)) else -1
    elif kind == SECRET:
        known = 1 if span.startswith(KEYS) else -1
    elif kind == IBAN:
        known = 1 if span[:2] in IBAN_LENGTH else -1
    elif kind == NATIONAL:
        known = 0 if _issued(span) else -1
    else:
        known = 1 if span.split(" ", 1)[0] in GIVEN else -1
    before = _words_before(text, s)
    said = 1 if WORDS_FOR[kind] & set(before) else -1 if WORDS_AGAINST & set(before) else 0
    left, right = text[s - 1:s], text[e:e + 1]
    touch = -1 if left.isalnum() or right.isalnum() or left in "/=_#" and left or right in "/=_#" and right else 1
    return [1 if strict else -1, 1 if usual else -1, known, said, touch]


def _words_before(text: str, s: int) -> list[str]:
    return re.findall(r"[a-z-]+", text[max(0, s - 40):s].lower())[-4:]


def _pattern(kind: int, votes: list[int], shape: int, before: int = 0) -> int:
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    return (code * SHAPES + shape) * BEFORE + before


def before_class(code: int) -> int:
    """Hash class of the word before the span, 0: none."""
    return code % BEFORE


def unpattern(code: int) -> tuple[int, list[int], int]:
    code //= BEFORE
    shape, code, votes = code % SHAPES, code // SHAPES, []
    for _ in LABELERS:
        votes.append(code % 3 - 1)
        code //= 3
    return code, votes[::-1], shape


class _Taken:
    """Disjoint accepted stretches, sorted: each test is one bisection."""

    def __init__(self, spans):
        self.first: list[int] = []
        self.last: list[int] = []
        for s, e in sorted(spans):
            if self.last and s < self.last[-1]:
                self.last[-1] = max(self.last[-1], e)
            else:
                self.first.append(s)
                self.last.append(e)

    def meets(self, s: int, e: int) -> bool:
        i = bisect_left(self.first, e)
        return i > 0 and self.last[i - 1] > s

    def add(self, s: int, e: int) -> None:
        i = bisect_left(self.first, s)
        self.first.insert(i, s)
        self.last.insert(i, e)


def candidates(text: str) -> list[tuple[int, int, int, int, bool]]:
    """(kind, start, end, pattern, base) of all spans that are voted on."""
    found = matches(text)
    taken = _Taken((s, e) for _, s, e, ok in found if ok)
    if found or _ANY.search(text):
        for m in _LOOSE_PHONE.finditer(text):
            if not taken.meets(m.start(), m.end()):
                found.append((PHONE, m.start(), m.end(), False))
    found += [(SECRET, m.start(), m.end(), m[0].startswith(KEYS)) for m in _SECRET.finditer(text)]
    if "at" in text and "dot" in text:
        found += [(EMAIL, s, e, False) for s, e in _spelled(text)]
    for kind, pattern, holds in ((IBAN, _IBAN, lambda x: _checks_out(x.replace(" ", ""))), (NATIONAL, _NATIONAL, _issued)):
        if _ANY.search(text):
            found += [(kind, m.start(), m.end(), holds(m[0])) for m in pattern.finditer(text)]
    found += [(PERSON, m.start(), m.end(), m[1] in GIVEN) for m in _NAMED.finditer(text) if m[1] in GIVEN]
    out = []
    for kind, s, e, ok in found:
        span = text[s:min(e, s + 256)]
        shape = (1 if any(c in " -()" for c in span) else 0) + (2 if any(c.isalpha() for c in span) else 0)
        near = _words_before(text, s)[-1:]
        before = 1 + zlib.crc32(near[0].encode()) % (BEFORE - 1) if near else 0
        out.append((kind, s, e, _pattern(kind, _votes(kind, text, s, e, ok), shape, before), ok and kind < BASE))
    return out


# -- label model and classifier (from pattern counts) ------------------------------------

def reliabilities(counts: dict[int, int], rounds: int = EM_ROUNDS) -> dict[int, float]:
    """EM over the vote patterns of each kind: probability that a span with the pattern is personal data."""
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        codes = sorted(c for c in counts if unpattern(c)[0] == kind)
        if not codes:
            continue
        v = np.array([unpattern(c)[1] for c in codes]) + 1
        n = np.array([counts[c] for c in codes], np.float64)
        q = 1 / (1 + np.exp(-1.5 * (v - 1).sum(axis=1)))             # start: majority of the votes
        for _ in range(rounds):
            prior = (n @ q + 1) / (n.sum() + 2)
            like = np.zeros((len(codes), 2))
            for y, w in enumerate((n * (1 - q), n * q)):
                for j in range(v.shape[1]):
                    # a labeler is held to be better than chance: one pseudo-vote on its own side
                    table = np.bincount(v[:, j], w, 3) + np.array([[1.5, 1.0, 0.5], [0.5, 1.0, 1.5]][y])
                    like[:, y] += np.log(table / table.sum())[v[:, j]]
            z = like[:, 1] - like[:, 0] + np.log(prior / (1 - prior))
            q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        out |= dict(zip(codes, q.tolist()))
    return out


def _inputs(code: int) -> np.ndarray:
    kind, votes, shape = unpattern(code)
    v = np.array(votes, np.float64)
    k = np.eye(len(KINDS))[kind]
    pairs = [v[i] * v[j] for i in range(len(v)) for j in range(i + 1, len(v))]
    return np.concatenate((k, np.outer(k, v).ravel(), pairs, np.eye(SHAPES)[shape], np.outer(k, np.eye(SHAPES)[shape]).ravel(),
                           np.outer(k, np.eye(BEFORE)[before_class(code)]).ravel()))


def span_classifier(counts: dict[int, int], soft: dict[int, float], l2: float = 1e-3, steps: int = 400) -> dict[int, float]:
    """Logistic regression on the soft labels, every kind of equal weight; its probability of every pattern."""
    if not counts:
        return {}
    codes = sorted(counts)
    x = np.array([_inputs(c) for c in codes])
    y = np.array([soft[c] for c in codes])
    kinds = np.array([unpattern(c)[0] for c in codes])
    n = np.array([counts[c] for c in codes], np.float64)
    n = n / np.bincount(kinds, n, len(KINDS))[kinds]
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):                    # Newton steps settle in a few rounds
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + l2 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def added(found: list[tuple[int, int, int, int, bool]], scores: dict[int, float], accept: float = ACCEPT) -> list[tuple[int, int, int]]:
    """Base spans and the accepted others, likeliest first, that overlap nothing accepted before."""
    spans = [(k, s, e) for k, s, e, _, base in found if base]
    taken = _Taken((s, e) for _, s, e in spans)
    for k, s, e, c, base in sorted(found, key=lambda x: (-scores.get(x[3], 0.0), x[1], x[0])):
        if not base and scores.get(c, 0.0) >= accept and not taken.meets(s, e):
            spans.append((k, s, e))
            taken.add(s, e)
    return sorted(spans, key=lambda x: (x[1], x[0]))


# -- Spark ------------------------------------------------------------------------------

def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _scan(kind: str):
    fields = "kind int, first bigint, last bigint, pattern int, base boolean"
    pa_fields = pa.struct([("kind", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("pattern", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "first", "last", "pattern", "base")
        for b in batches:
            found = [[dict(zip(names, c)) for c in candidates(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa_fields))], names=["doc_id", "found"])

    return run, f"doc_id {kind}, found array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>"


def _spans_of(scores: dict[int, float], kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = [], []
            for cell in b.column(1).to_pylist():
                found = [(c["kind"], c["first"], c["last"], c["pattern"], c["base"]) for c in cell]
                base.append(sorted(((k, s, e) for k, s, e, _, ok in found if ok), key=lambda x: (x[1], x[0])))
                every.append(added(found, scores))
            counts = [pa.array([sum(k == kind for k, _, _ in spans) for spans in base], pa.int64()) for kind in range(BASE)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base]),
                 pa.array([written(x) for x in every], pa.string()), pa.array([len(x) for x in every], pa.int64())],
                names=["doc_id", *[f"n_{k}" for k in KINDS[:BASE]], "base_sha256", "spans", "n_spans"])

    return run, (f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS[:BASE])
                 + ", base_sha256 string, spans string, n_spans bigint")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as
    kind:start:end), n_spans."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scan, schema = _scan(kind)
    found = materialize(rows.mapInArrow(scan, schema))
    # at most PATTERNS rows
    counts = {r["pattern"]: r["n"] for r in found.select(F.explode("found.pattern").alias("pattern"))
              .groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    scores = span_classifier(counts, reliabilities(counts))
    run, schema = _spans_of(scores, kind)
    return found.mapInArrow(run, schema)
