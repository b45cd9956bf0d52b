"""Secret scan with multipart credential linking.

Strong parts stand on their own: ``assign`` (a password, secret, token or key being assigned),
``access`` (an access key id) and ``hex`` (a long hexadecimal run).  Weak parts are too common to
report alone: an ``identifier`` (a user, client or account name being assigned), a ``secret`` (a long
token of mixed characters, bare or after ``=``, of any length) and an ``endpoint`` (a URL, or a host
being assigned).  Names being assigned may follow an underscore, as in ``DB_USER=``.

Linking is an interval join within scopes.  A scope is a section of the text between blank lines.
Each part is an interval; two parts of complementary roles join if they lie in the same scope, however
far apart, and do not overlap:

* an identifier (weak or an access id) with a secret (weak, assigned or hex): the weak ones of the
  pair are reported;
* an endpoint with an access id, an assigned secret, or a weak part that is itself reported.

All parts of a document are in its row, so the join needs no shuffle: a part has a partner apart from it
if the interval of its scope that ends first, or the one that starts last, is apart from it.  A caller
can bound the distance; then the nearest intervals on either side come by bisection.

Defined cases: null and empty texts have no spans.  Rows are scanned one by one, so null, tied or
repeated ``doc_id`` values do not matter.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

#: Kinds in reporting order; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = 3
#: Least entropy of a weak secret, in bits a character.
ENTROPY = 3.5
MASK = "[SECRET]"

# fixed values: the base patterns
_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# names may follow an underscore (DB_USER); a token may follow '=' and be of any length
_IDENTIFIER = re.compile(r"(?ai:(?<![a-z0-9])(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})")
_IDENTIFIER_WORDS = ("user", "login", "client", "account", "access")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"(?ai:(?<![a-z0-9+.-])[0-9+.-]*+(?P<scheme>[a-z])[a-z0-9+.-]*+://[^\s\"'<>]+|(?<![a-z0-9])(?:end_?point|host(?:_?name)?|server)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9.-]+(?::\d{1,5})?)")
_ENDPOINT_WORDS = ("://", "endpoint", "end_point", "host", "server")
_SECTION = re.compile(r"\n[^\S\n]*\n\s*")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"

#: (kind number, start, end, start of the part to mask)
Span = tuple[int, int, int, int]


def base_spans(text: str) -> list[Span]:
    low, found = text.lower(), []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(0, m.start(), m.end(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    return found


def _mixed(token: str) -> bool:
    kinds = sum(any(f(c) for c in token) for f in (str.isupper, str.islower, str.isdigit))
    share = [n / len(token) for n in Counter(token).values()]
    return kinds == 3 and -sum(p * math.log2(p) for p in share) >= ENTROPY


def weak_parts(text: str) -> list[Span]:
    low, found = text.lower(), []
    if any(w in low for w in _IDENTIFIER_WORDS):
        found += [(3, m.start(), m.end(), m.start(1)) for m in _IDENTIFIER.finditer(text)]
    found += [(4, m.start(), m.end(), m.start()) for m in _SECRET.finditer(text) if _mixed(m.group())]
    if any(w in low for w in _ENDPOINT_WORDS):
        # a scheme begins at the first letter of its run, which is scanned once
        starts = [(m, max(m.start(), m.start("scheme"))) for m in _ENDPOINT.finditer(text)]
        found += [(5, a, m.end(), a) for m, a in starts]
    return found


def near(parts: list[Span], others: list[Span], sections: list[int], reach: int | None = None) -> list[Span]:
    """The ``parts`` that have one of ``others`` in the same section, and within ``reach`` if given.

    ``sections`` are the sorted starts of the sections after the first.  Overlapping spans are one
    part of the text, not two that co-occur.
    """
    if reach is None:  # a part stands apart from some other if from the one that ends first or starts last
        ends_first, starts_last = {}, {}
        for _, c, d, _ in others:
            i = bisect_right(sections, c)
            ends_first[i], starts_last[i] = min(d, ends_first.get(i, d)), max(c, starts_last.get(i, c))
        where = [bisect_right(sections, part[1]) for part in parts]
        return [part for part, i in zip(parts, where, strict=True) if i in ends_first and (ends_first[i] <= part[1] or part[2] <= starts_last[i])]
    others = sorted(others, key=lambda s: s[1:3])
    ends = list(accumulate((s[2] for s in others), max))
    out = []
    for part in parts:
        _, a, b, _ = part
        i = bisect_right(sections, a)
        low, high = (sections[i - 1] if i else 0), (sections[i] if i < len(sections) else math.inf)
        for j in range(bisect_left(ends, a - reach), len(others)):
            _, c, d, _ = others[j]
            if c > b + reach:
                break
            if low <= c < high and a - reach <= d and not (c < b and a < d):
                out.append(part)
                break
    return out


def scan(text: str | None, reach: int | None = None) -> list[Span]:
    """All spans of a whole text: base ones, and weak ones whose complement co-occurs."""
    text = text or ""
    found = base_spans(text)
    weak = weak_parts(text)
    if weak:
        sections = [m.end() for m in _SECTION.finditer(text)]
        of = lambda parts, *kinds: [s for s in parts if s[0] in kinds]
        secrets = of(found, 0, 2) + of(weak, 4)
        linked = near(of(weak, 3), secrets, sections, reach)
        linked += near(of(weak, 4), of(found, 1) + of(weak, 3), sections, reach)
        linked += near(of(weak, 5), of(found, 0, 1) + linked, sections, reach)
        found += linked
    return sorted(found, key=lambda s: (s[1], s[0]))


def masked(text: str | None) -> str | None:
    """The text with the secret part of every span replaced; overlapping spans count as one."""
    if not text or not (spans := scan(text)):
        return text
    out, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], MASK]
        at = end
    return "".join([*out, text[at:]])


def _name(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in spans)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for t in batch.column(1).to_pylist():
            spans = scan(t)
            count = Counter(s[0] for s in spans)
            base = _name([s for s in spans if s[0] < BASE])
            rows.append((count[0], count[1], count[2], hashlib.sha256(base.encode()).hexdigest(), _name(spans), sum(s[0] >= BASE for s in spans)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, a digest of the base spans, and all spans as text."""
    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(_digests, SCHEMA)


def spans(docs: DataFrame) -> DataFrame:
    """One row per span: ``doc_id, kind, start, end`` in code points, and the part itself."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, KINDS[k], a, b, t[v:b]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for k, a, b, v in scan(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "kind", "start", "end", "part"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, kind string, start long, end long, part string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the secret parts of ``text`` masked; all columns stay as they are."""
    ship(docs.sparkSession)
    at, kind = docs.columns.index("text"), docs.schema["text"].dataType
    if kind.simpleString() != "string":
        raise TypeError("text is a string column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            yield batch.set_column(at, batch.schema.field(at).name, pa.array([masked(t) for t in col.to_pylist()], col.type))

    return docs.mapInArrow(run, docs.schema)
