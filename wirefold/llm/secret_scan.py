"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions at the hits, checksum validation.

One pass of the automaton over a case-folded text finds all keywords; an
expression is only tried at the start of a hit.  Hex strings have no keyword:
there the text is mapped to character classes and the prefilter looks for a
run of sixteen hex characters.  Kinds with an embedded checksum are reported
only if it holds.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in reporting order; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "age")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "age": ("age-secret-key-1",),
}
PATTERNS = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "age": re.compile(r"AGE-SECRET-KEY-1([02-9AC-HJ-NP-Z]{58})(?![0-9A-Z])"),
}
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_HEX_CLASS = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x2E for b in range(256))
_FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


def crc32_base62(text: str) -> str:
    """The six-digit checksum at the end of prefixed access tokens."""
    n, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def bech32_valid(prefix: str, data: str) -> bool:
    """Whether the checksum at the end of ``data`` (upper case) holds."""
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(BECH32_STEPS):
            if top >> i & 1:
                check ^= step
    return check == 1


def _accepted(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= MIN_VALUE
    if kind == "access":
        return m.end() - m.start() >= MIN_ACCESS
    if kind in ("github", "npm"):
        return crc32_base62(m[1]) == m[2]
    if kind == "age":
        return bech32_valid("age-secret-key-", m[1])
    return True


def automaton():
    """The keyword automaton; a hit carries its kind and length."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Code point ranges of the hex strings of 16 characters or more."""
    data = text.encode("utf-8", "surrogatepass")
    classes = data.translate(_HEX_CLASS)
    need = b"h" * MIN_HEX
    out, at, point = [], 0, 0
    while (hit := classes.find(need, at)) >= 0:
        end = hit + MIN_HEX
        while classes[end:end + 1] == b"h":
            end += 1
        start = point + (hit - at if len(data) == len(text) else len(data[at:hit].decode("utf-8", "surrogatepass")))
        out.append((start, start + end - hit))
        at, point = end, start + end - hit
    return out


def secret_spans(text: str, keywords) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind; leftmost non-overlapping per kind."""
    folded = text.lower()
    if len(folded) != len(text):  # some letters grow when lower-cased
        folded = text.translate(_FOLD)
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in keywords.iter(folded):
        starts.setdefault(kind, []).append(end - n + 1)
    found = [("hex", a, b) for a, b in hex_runs(text)]
    for kind, at in starts.items():
        free = 0
        for p in sorted(set(at)):
            if p >= free and (m := PATTERNS[kind].match(text, p)):
                if _accepted(kind, m):
                    found.append((kind, p, m.end()))
                    free = m.end()
                elif kind in KINDS[:3]:
                    free = m.end()
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def spans_of(text: Column) -> Column:
    """Array of (kind, start, end) of all secrets of a text; empty for null and empty texts."""

    def scan(texts):
        found = automaton()
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in secret_spans(t, found)] if t else [] for t in texts.to_pylist()]
        return pa.array(rows, _SPANS_ARROW)

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, SPANS)(text)


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the spans of all secrets of the whole texts; no shuffle.

    Null and empty texts have none; a column named ``out`` is replaced; all
    rows, repeated ones too, are kept.
    """
    return docs.withColumn(out, spans_of(F.col(text_col)))


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret of the text replaced by ``mask``; overlapping spans are replaced as one.

    Null texts stay null; all rows and other columns stay as they are.
    """

    def redact(texts):
        found = automaton()
        out = []
        for t in texts.to_pylist():
            if not t:
                out.append(t)
                continue
            parts, at = [], 0
            for _, a, b in secret_spans(t, found):
                if a >= at:
                    parts += [t[at:a], mask]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]) if parts else t)
        return pa.array(out, pa.string())

    redact.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(text_col, F.arrow_udf(redact, "string")(F.col(text_col)))


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, a digest of the base spans and all spans, per document."""
    found = docs.select(F.col(id_col), spans_of(F.col(text_col)).alias("s"))

    def joined(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("s", lambda x: x["kind"].isin(*KINDS[:3]))
    return found.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
