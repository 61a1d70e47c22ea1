"""Operator 4: secret scans.

Keywords are found by one Aho-Corasick pass over the lower-cased text; a kind's regular expression is tried only where one of
its keywords begins, anchored there. Runs of hexadecimal digits have no keyword: a run of HEX characters always meets three
successive places of every fifth, so those places are looked at, and the expression runs only around such triples. Tokens
that carry a checksum (base-62 CRC-32 of their body) count as found only if it is right.

Base kinds: assign, access, hex. Added kinds: github, npm (checksum), jwt (its header must decode to JSON with an algorithm),
pem (a private key to its END line; without one before the next BEGIN, to the end of its base64 lines). Spans are code points, end exclusive; within a kind they are leftmost and do not
overlap; a match that fails its length or checksum still ends the search within it.

Defined results: null and empty texts have no spans; whole texts are scanned whatever their length; every row is scanned by
itself, so repeated rows give repeated results; an empty table gives no rows;
other columns stay, but one named spans is replaced.
"""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scansmith.llm.common import map_texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt", "pem")
ASSIGN, ACCESS, HEX = 12, 18, 16  # least characters
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Each keyword's kind.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin": "pem",
}
#: Each kind's expression; the last group is the secret itself.
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"(AKIA[A-Z0-9]+)"),
    "github": re.compile(r"(gh[pousr]_[A-Za-z0-9]+)"),
    "npm": re.compile(r"(npm_[A-Za-z0-9]+)"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)"),
    "pem": re.compile(r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)"),
}
#: What follows the first line of a private key that has no END line: headers, and lines of base64 alone.
_PEM_BODY = re.compile(
    r"(?:\s*(?:\\r)?(?:\\n)?(?:Proc-Type|DEK-Info):[^\n\\]*)*(?:\s|\\[rn])*"
    r"[A-Za-z0-9+/]{16,}={0,2}(?:[ \t]*(?:\\r|\r)?(?:\\n|\n)[ \t]*[A-Za-z0-9+/]+={0,2}(?=[ \t\r]*(?:[\n\\\"']|$)))*"
)
_HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % HEX)
_HEX_PLACES = re.compile(r"[0-9a-f]{3,}")
_STEP = 5
_UPPER = {i: i + 32 for i in range(65, 91)}


def checksum(body: str) -> str:
    """The last six characters of a token that carries its CRC-32 in base 62."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.rjust(6, "0")


def _valid(kind: str, value: str) -> bool:
    if kind == "assign":
        return len(value) >= ASSIGN
    if kind == "access":
        return len(value) >= ACCESS
    if kind in ("github", "npm"):
        body = value[4:]
        return len(body) == 36 and checksum(body[:30]) == body[30:]
    if kind == "jwt":
        head = value.split(".", 1)[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (binascii.Error, ValueError, TypeError):
            return False
    return True


def _pem_end(text: str, m: re.Match[str]) -> int:
    """The end of the private key whose first line is m."""
    after = text.find("-----BEGIN ", m.end())
    after = len(text) if after < 0 else after
    last = m[1].replace("BEGIN", "END", 1)
    if (at := text.find(last, m.end(), after)) >= 0:
        return at + len(last)
    body = _PEM_BODY.match(text, m.end())
    return min(body.end(), after) if body else m.end()


@functools.cache
def _automaton():  # noqa: ANN202
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def find(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself), by start, then kind as listed."""
    low = text.lower()
    if len(low) != len(text):  # some capitals have longer small forms
        low = text.translate(_UPPER)
    found, ends = [], dict.fromkeys(PATTERNS, 0)
    for at, kind in sorted((end - n + 1, kind) for end, (kind, n) in _automaton().iter(low)):
        if at >= ends[kind] and (m := PATTERNS[kind].match(text, at)):
            ends[kind] = _pem_end(text, m) if kind == "pem" else m.end()
            if _valid(kind, m[m.lastindex]):
                found.append((kind, m.start(), ends[kind], m.start(m.lastindex)))
    for m in _HEX_PLACES.finditer(text[_STEP - 1 :: _STEP]):
        first, last = m.start() * _STEP + _STEP - 1, m.end() * _STEP - 1
        for r in _HEX_RUN.finditer(text, max(0, first - _STEP + 1), min(len(text), last + _STEP)):
            found.append(("hex", r.start(), r.end(), r.start()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, into: str = "spans") -> DataFrame:
    """docs (text, ...) with spans, or a column of another name: array of (kind, start, end, value), value being where the secret itself begins."""
    docs = docs.drop(into)
    names = docs.columns
    at = names.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in find(t or "")] for t in b.column(at).to_pylist()]
        return pa.record_batch([*b.columns, pa.array(spans, kind)], [*names, into])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_texts(docs, work, f"{own}, `{into}` array<struct<kind:string,start:bigint,end:bigint,value:bigint>>")


def hidden(text: str, mark: str) -> str:
    """text with a mark in place of each secret; secrets that overlap share one."""
    out, to = [], 0
    for start, end in sorted((s[3], s[2]) for s in find(text)):
        if start >= to:
            out += [text[to:start], mark]
        to = max(to, end)
    return "".join(out) + text[to:]


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with a mark in place of each secret of text; what names it, and all other text and columns, stay."""
    names = docs.columns
    at = names.index("text")

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t and hidden(t, mark) for t in b.column(at).to_pylist()]
        return pa.record_batch([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(b.columns)], names)

    return map_texts(docs, work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def digest(spans: F.Column) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and spans of secrets."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
