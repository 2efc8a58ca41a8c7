"""Secret scan with multipart credential linking.

Strong findings are reported wherever they stand: assignments of a password or token, access identifiers, long runs of
lower-case hex.  Parts too weak for that - a user name, a random-looking word, an address - are reported only when
complementary parts co-occur: within a scope (a paragraph, cut by blank lines) the identifiers, secrets and endpoints
of a document are joined as intervals no more than ``reach`` code points apart.  A weak secret needs an identifier, a
weak identifier needs a secret, an endpoint needs both.  A random-looking word is any run of 16 or more key characters
of enough bits, whatever its case, digits or dashes; the parts beside it decide.  So long words and names of code next to
an identifier are reported too.  What is named as an identifier, or stands without a digit in an address, is taken as
part of that, not as a secret beside it, unless it has digits and both cases or is hex.

All of it happens in the row's own task: nothing is shuffled, and the sorted join of n parts takes n log n steps.

Defined cases: a null text counts as empty; an empty text has no findings; equal spans of two kinds are both reported;
repeated rows give repeated results; texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import keyed_texts, map_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
STRONG = ("assign", "access", "hex")

BLANK_LINES = re.compile(r"\n[ \t\r]*\n")
NAMED = re.compile(r"""\b(?:access_key_id|client_id|account_id|account|username|user|login)["']?[ ]*[:=][ ]*["']?"""
                   r"""([A-Za-z0-9._@-]{3,})""", re.IGNORECASE | re.ASCII)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}\b""",
                      re.IGNORECASE | re.ASCII)
KINDS = (*STRONG, "weak_id", "weak_secret", "endpoint")
RANK = {kind: i for i, kind in enumerate(KINDS)}
REACH = 300
MIN_BITS = 3.2  # of a character of a random-looking word

Span = tuple[int, int, str]


def strong_spans(text: str) -> list[Span]:
    """Findings that need no partner; of each kind the leftmost, not overlapping."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], RANK[s[2]], s[1]))


def looks_random(word: str) -> bool:
    """Many different characters."""
    n = len(word)
    return -sum(k / n * math.log2(k / n) for k in Counter(word).values()) >= MIN_BITS


def has_digit(word: str) -> bool:
    return any("0" <= c <= "9" for c in word)


def looks_key(word: str) -> bool:
    """Digits and both cases, or hex: no name of an identifier or a path."""
    mixed = any(c.islower() for c in word) and any(c.isupper() for c in word)
    return has_digit(word) and (mixed or re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", word) is not None)


def weak_parts(text: str, strong: list[Span]) -> list[Span]:
    """Parts that mean nothing alone and touch no strong finding; none where no identifier is."""
    starts, reach = [s for s, _, _ in strong], []
    for _, e, _ in strong:
        reach.append(max(e, reach[-1]) if reach else e)

    def apart(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k == 0 or reach[k - 1] <= start

    out = [(m.start(1), m.end(1), "weak_id") for m in NAMED.finditer(text) if apart(m.start(1), m.end(1))]
    if not out and all(kind != "access" for *_, kind in strong):
        return []
    addresses = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text) if apart(m.start(), m.end())]
    ids, paths = Intervals(out), Intervals(addresses)

    def beside(span: Span, word: str) -> bool:
        """Whether the word is not just the value of an identifier or the path of an address."""
        return looks_key(word) or not (ids.near(span, -1) or paths.near(span, -1) and not has_digit(word))

    words = [((m.start(), m.end(), "weak_secret"), m[0]) for m in RANDOM.finditer(text)]
    out += [span for span, word in words if apart(*span[:2]) and looks_random(word) and beside(span, word)]
    return out + addresses


def scopes(text: str) -> Iterator[tuple[int, int]]:
    """Paragraphs: what stands between blank lines."""
    start = 0
    for m in BLANK_LINES.finditer(text):
        yield start, m.start()
        start = m.end()
    yield start, len(text)


class Intervals:
    """Intervals by start, for the question whether one lies near."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts = [s for s, _, _ in spans]
        self.ends: list[int] = []  # the furthest end so far
        for _, e, _ in spans:
            self.ends.append(max(e, self.ends[-1]) if self.ends else e)

    def near(self, span: Span, reach: int) -> bool:
        """Whether an interval lies at most ``reach`` before or after; one that overlaps the span does."""
        k = bisect_right(self.starts, span[1] + reach)
        return k > 0 and self.ends[k - 1] >= span[0] - reach


def linked(parts: list[Span], reach: int = REACH) -> list[Span]:
    """The weak parts of one scope that have their complement near."""
    ids = [p for p in parts if p[2] in ("access", "weak_id")]
    secrets = [p for p in parts if p[2] in ("assign", "hex", "weak_secret")]
    if not ids or not secrets:
        return []
    near_id, near_secret = Intervals(ids), Intervals(secrets)
    complete = [p for p in secrets if near_id.near(p, reach)]
    near_pair = Intervals(complete)
    return ([p for p in complete if p[2] == "weak_secret"]
            + [p for p in ids if p[2] == "weak_id" and near_secret.near(p, reach)]
            + [p for p in parts if p[2] == "endpoint" and near_pair.near(p, reach)])


def scan(text: str, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """Strong findings, and all findings, of one text."""
    strong = strong_spans(text)
    weak = weak_parts(text, strong)
    if not weak:
        return strong, strong
    parts, found = sorted(strong + weak), []
    starts = [p[0] for p in parts]
    for start, end in scopes(text):
        inside = parts[bisect_left(starts, start):bisect_left(starts, end)]
        if len(inside) > 1:
            found += linked(inside, reach)
    return strong, ordered(strong + found)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Per document: doc_id, findings array<struct<kind, start, end, linked>> in order of start, and the counts and
    digests that compare them: n_assign, n_access, n_hex, base_sha256 (strong findings), spans (all findings)."""
    def work(key: list, text: list[str]) -> dict:
        each = [scan(t, reach) for t in text]
        count = lambda kind: [sum(s[2] == kind for s in strong) for strong, _ in each]
        return {"doc_id": key, **{f"n_{kind}": count(kind) for kind in STRONG},
                "base_sha256": [hashlib.sha256(listed(strong).encode()).hexdigest() for strong, _ in each],
                "spans": [listed(found) for _, found in each],
                "findings": [[{"kind": k, "start": s, "end": e, "linked": RANK[k] >= len(STRONG)} for s, e, k in found]
                             for _, found in each]}

    return map_batches(keyed_texts(docs, id_col, text_col), lambda: work,
                       "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                       "findings array<struct<kind: string, start: int, end: int, linked: boolean>>")


MASK = "[secret]"


def mask(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping findings replaced by one mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]
