"""Secret scans: three base patterns, and dictionary-primed zstandard novelty for what they miss.

A candidate is a string of 16 or more characters with a sensitive word near it or on its line, or in a run of
such strings (the lines of a key) that has one.  It is compressed behind its surrounding
code, with a dictionary of common identifiers and that code; what it adds to the compressed size is its novelty.
Identifiers, words and repeats cost a few bytes there, random material costs about its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so this is "runs of [0-9a-f]+, those of 16 or more"
SENSITIVE = re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential|private|signature|session|cookie|salt", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
BEGIN = re.compile(r"-----BEGIN ([^\n-]{0,80})-----", re.A)
#: What may stand between two strings of a run: line ends (also escaped), quotes, signs and blanks.
GAP = re.compile(r"(?:\\[nrt]|[^A-Za-z0-9]){0,24}", re.A)
#: Words that code is made of.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key client_id client_secret username user_name "
    "authorization bearer credentials session_id session cookie signature certificate encryption connection_string database hostname "
    "import from return function class public static void const string boolean integer float double export default require module "
    "configuration config settings environment variable getenv process.env os.environ localhost http https www example.com "
    "application/json content-type user-agent charset=utf-8 text/html true false null none undefined self this "
    "initialize initialise constructor abstract interface implements extends override factory builder manager service handler controller "
    "request response exception error warning debug logger logging message callback listener observer iterator collection "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
)
SPANS = "array<struct<kind:string,start:int,end:int,novelty:double>>"


def _others(text: str, start: int, end: int, lo: int, hi: int) -> tuple[str, str]:
    """text[lo:start] and text[end:hi], both without what stands there again of text[start:end].

    Also a part of it without a name and = before it, or a run of 16 or more letters and digits, counts as a repeat.
    """
    own = text[start:end]
    parts = {own, own.strip("=_-/"), own.partition("=")[2].strip("="), *re.findall(r"[A-Za-z0-9]{16,}", own)}
    sides = [(lo, start), (end, hi)]
    out = [list(text[a:b]) for a, b in sides]
    for part in parts:
        if len(part) < 16:
            continue
        for (a, b), chars in zip(sides, out):
            # Repeats may reach over either end of the side.
            at = text.find(part, max(0, a - len(part) + 1), b + len(part))
            while 0 <= at < b:
                if at + len(part) > a:
                    x, y = max(at, a) - a, min(at + len(part), b) - a
                    chars[x:y] = [""] * (y - x)
                at = text.find(part, at + 1, b + len(part))
    return "".join(out[0]), "".join(out[1])


def novelty(text: str, start: int, end: int, around: int = 2048) -> float:
    """Marginal compressed bytes of text[start:end] behind its surroundings, as a share of its length.

    Its own repeats are no surroundings: a secret that stands twice is novel both times.
    """
    before, after = _others(text, start, end, max(0, start - around), min(len(text), end + around))
    code = before.encode("utf-8", "surrogatepass") + b"\n" + after.encode("utf-8", "surrogatepass")
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode() + code, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    z = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False)
    lead = before[-64:].encode("utf-8", "surrogatepass")
    own = text[start:end].encode()
    return (len(z.compress(lead + own)) - len(z.compress(lead))) / len(own)


def _sensitive(text: str, context: int) -> list[tuple[int, int]]:
    """Candidates with a sensitive word within ``context`` characters on either side, on their line, or as their
    own name before an =; those between BEGIN and END of something sensitive; and those in a run with such a one."""
    marks = [m.span() for m in SENSITIVE.finditer(text)]
    if not marks:
        return []
    starts = [a for a, _ in marks]
    blocks, last = [], 0
    for m in BEGIN.finditer(text):
        if m.end() > last and SENSITIVE.search(m[1]):
            last = text.find("-----END", m.end())
            last = len(text) if last < 0 else last
            blocks.append((m.end(), last))
    opens = [a for a, _ in blocks]

    def near(a: int, b: int) -> bool:
        lo = min(a - context, text.rfind("\n", 0, a) + 1)
        end = text.find("\n", b)
        hi = max(b + context, len(text) if end < 0 else end)
        i, j, k = bisect_left(starts, lo), bisect_left(starts, b), bisect_left(opens, b) - 1
        if i < len(marks) and marks[i][1] <= a or j < len(marks) and marks[j][1] <= hi or k >= 0 and blocks[k][0] <= a and b <= blocks[k][1]:
            return True
        name = text.find("=", a, b)
        i = bisect_left(starts, a)
        return name >= 0 and i < len(marks) and marks[i][1] <= name and b - name > 8

    found: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    wanted = False
    for m in CANDIDATE.finditer(text):
        if run and not GAP.fullmatch(text, run[-1][1], m.start()):
            found += run if wanted else []
            run, wanted = [], False
        run.append(m.span())
        wanted = wanted or near(*m.span())
    return found + (run if wanted else [])


def find_spans(text: str, min_novelty: float = 0.85, context: int = 48) -> list[tuple[str, int, int, float | None]]:
    """All spans by start, then kind: base spans whole, novelty spans where no base span overlaps."""
    found = [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b, _ in found)
    for a, b in _sensitive(text, context):
        i = bisect_left(taken, (b, -1))
        if any(y > a for _, y in taken[max(0, i - 3) : i]):
            continue
        if (n := novelty(text, a, b)) >= min_novelty:
            found.append(("novel", a, b, n))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "secrets", min_novelty: float = 0.85) -> DataFrame:
    """Add the spans (kind, start, end, novelty) of every whole text; offsets are code points, ends exclusive.

    Null and empty texts have none.  ``out_col`` replaces an input column of that name.
    """
    kept = [c for c in docs.columns if c != out_col]
    schema = docs.select(*kept).withColumn(out_col, F.array().cast(SPANS)).schema
    at = kept.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "novelty"), s)) for s in find_spans(t.as_py() or "", min_novelty)] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*kept, out_col])

    return docs.select(*kept).mapInArrow(run, schema)
