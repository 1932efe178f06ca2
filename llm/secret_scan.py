"""Secrets in texts: keyword prefilter, anchored expressions near hits, checksums.

One Aho-Corasick automaton over the lower-cased UTF-8 bytes of a text finds every place
where a secret with a fixed beginning can start. Only there, an expression anchored at that
place is tried on the bytes. Runs of hex digits have no fixed beginning; one expression
that jumps from run to run finds them. Kinds that embed a checksum are kept only if it holds.

Kinds of the base (always reported; leftmost, non-overlapping per kind; a match that fails
its condition is dropped and its characters are not tried again):

* ``assign``: a name such as ``password`` or ``api_key``, ``:`` or ``=``, and a value of 8 or more;
* ``access``: ``AKIA`` and capitals or digits, 16 or more in all;
* ``hex``: 32 or more of ``0-9a-f``.

Added by the method, after the base kinds in the order of ``EXTRA``: service tokens whose last
six characters are the CRC-32 of the rest in base 62 (``service``), signed web tokens that start a
run of their characters and whose header, of ``HEADER_BYTES`` at most, decodes to an object with
``alg`` (``signed``), and private key blocks (``private``).

A null text is empty and has no spans. Offsets are code points, end exclusive. Rows that repeat are
scanned each, null ids too. Any text is read in linear time.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.common import code_points, map_batches, span_digest, texts_of

BASE = ("assign", "access", "hex")
EXTRA = ("service", "signed", "private")
KINDS = (*BASE, *EXTRA)

BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(
    rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
SERVICE = re.compile(rb"(gh[pousr]|npm)_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
# Possessive runs: one that is not followed by a dot fails at once.
SIGNED = re.compile(rb"(?<![0-9A-Za-z_-])(eyJ[0-9A-Za-z_-]++)\.([0-9A-Za-z_-]++)\.[0-9A-Za-z_-]++")
HEADER_BYTES = 4096  # no signed token has a longer header
PRIVATE = re.compile(rb"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----")

# How a secret of each kind begins, in lower case.
STARTS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "service": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "signed": ("eyj",),
    "private": ("-----begin ",),
}


def base62(number: int, width: int) -> bytes:
    digits = bytearray()
    for _ in range(width):
        number, digit = divmod(number, 62)
        digits.append(BASE62[digit])
    return bytes(reversed(digits))


def checksum_holds(match: re.Match) -> bool:
    """Whether the last six characters are the CRC-32 of the thirty before, in base 62."""
    body = match[2]
    return base62(zlib.crc32(body[:-6]), 6) == body[-6:]


def header_decodes(match: re.Match) -> bool:
    if len(match[1]) > HEADER_BYTES:
        return False
    try:
        header = json.loads(base64.urlsafe_b64decode(match[1] + b"=" * (-len(match[1]) % 4)))
    except (ValueError, RecursionError):  # no JSON, or nested beyond what the parser follows
        return False
    return isinstance(header, dict) and "alg" in header


RULES = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 8),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 16),
    "service": (SERVICE, checksum_holds),
    "signed": (SIGNED, header_decodes),
    "private": (PRIVATE, lambda m: True),
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Leads from the last byte of a beginning to its length and kind."""
    made = ahocorasick.Automaton()
    for kind, words in STARTS.items():
        for word in words:
            made.add_word(word, (len(word), kind))
    made.make_automaton()
    return made


def byte_spans(data: bytes) -> list[tuple[str, int, int]]:
    """Spans of all kinds in UTF-8 bytes, with byte offsets, by start and then kind."""
    found = [("hex", m.start(), m.end()) for m in HEX.finditer(data)]
    free = dict.fromkeys(RULES, 0)  # where the next match of a kind may start
    # One character per byte, so that places are byte offsets.
    hits = [
        (end - size + 1, kind)
        for end, (size, kind) in automaton().iter(data.lower().decode("latin-1"))
    ]
    for start, kind in sorted(hits):
        if start >= free[kind]:
            pattern, keep = RULES[kind]
            match = pattern.match(data, start)
            if match:
                free[kind] = match.end()
                if keep(match):
                    found.append((kind, start, match.end()))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of all kinds with code point offsets, by start and then kind."""
    data = text.encode("utf-8", "surrogatepass")
    return code_points(data, text, byte_spans(data))


def masked(text: str, label: str = "[SECRET]") -> str:
    """``text`` with every run of overlapping spans replaced by ``label``."""
    runs: list[list[int]] = []
    for _, start, end in spans(text):
        if runs and start < runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([start, end])
    parts, at = [], 0
    for start, end in runs:
        parts += [text[at:start], label]
        at = end
    return "".join([*parts, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, found array<struct<kind, start, end>>`` and, per base kind, ``n_<kind>``;
    ``base_sha256`` and ``spans`` as written by ``span_digest``. Other columns are ignored."""
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [spans(t) for t in texts_of(batch)]
            base = [[s for s in r if s[0] in BASE] for r in rows]
            columns = [
                batch.column("id"),
                pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], pa.list_(span)),
                *(pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in BASE),
                pa.array([span_digest(r)[1] for r in base], pa.string()),
                pa.array([span_digest(r)[0] for r in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["id", "found", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
            )

    schema = (
        f"id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>, "
        + ", ".join(f"n_{k} bigint" for k in BASE)
        + ", base_sha256 string, spans string"
    )
    return map_batches(df.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, schema)
