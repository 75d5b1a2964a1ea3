"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

A candidate is a run of at least 16 key-like characters that a sensitive word precedes closely.
Its novelty is what it adds to the compressed size of the text around it, with a compressor primed
by a dictionary of common identifiers: marginal bytes divided by its length. Words, paths and
repeated names cost little next to their surroundings; random keys cost near a byte a character
(hex digits over half a byte). Candidates at or above the threshold are reported as ``novel``.

The patterns (assign, access, hex) are reported whatever their novelty. Offsets are code points,
ends exclusive. Defined cases: null text is empty; empty text has no spans; a null doc_id stays null;
repeated rows give one result each.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.staging import arrow_map

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need not be matched and dropped
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|access.?key|private.?key|credential|bearer|auth|signature",
                       re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IDENTIFIERS = """
password passwd passphrase secret token api_key apikey access_key secret_key private_key client_secret
credential credentials bearer authorization authentication signature session cookie username user email
config settings environment variable database connection string host port localhost http https www com
public static final void class def return import from function const let var null none true false self this
string integer boolean double float long list dict map array object value name type index count length size
example sample placeholder changeme your_api_key_here insert_token_here xxxxxxxx 0123456789 abcdefghijklmnop
ABCDEFGHIJKLMNOPQRSTUVWXYZ the and that with from this which have for not are was were been
""".encode()


def novelty(compressor: zstandard.ZstdCompressor, before: str, candidate: str, after: str) -> float:
    """Bytes that ``candidate`` adds to the compressed surroundings, for each of its characters."""
    around = len(compressor.compress((before + after).encode("utf-8", "replace")))
    return (len(compressor.compress((before + candidate + after).encode("utf-8", "replace"))) - around) / len(candidate)


def scan(text: str, compressor: zstandard.ZstdCompressor, least: float, reach: int, context: int) -> list[tuple]:
    """(start, kind number, end, novelty or None) of all spans, sorted."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    near = -1
    for m in SENSITIVE.finditer(text):
        at = max(m.start(), near)
        if at > m.end() + reach:
            continue
        c = CANDIDATE.search(text, at)
        while c and c.start() <= m.end() + reach:
            near = c.end()
            # a sensitive word that the run itself begins with is context, not key
            a = max(c.start(), m.end()) if m.start() >= c.start() else c.start()
            key = text[a:c.end()].lstrip("_=-")
            if len(key) >= 16:
                b = c.end() - len(key)
                x = novelty(compressor, text[max(0, b - context):b], key, text[c.end():c.end() + context])
                if x >= least:
                    out.append((b, 3, c.end(), x))
            c = CANDIDATE.search(text, near)
    return sorted(out, key=lambda s: s[:3])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def _batches(least: float, reach: int, context: int):
    def run(batches):
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=9, dict_data=primed)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [[{"kind": KINDS[k], "start": s, "end": e, "novelty": x}
                          for s, k, e, x in scan(t.as_py() or "", compressor, least, reach, context)]
                         for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, SPANS)], names=["doc_id", "spans"])
    return run


def secret_spans(docs: DataFrame, least: float = 0.5, reach: int = 40, context: int = 160) -> DataFrame:
    """One row per row of ``docs``: doc_id as it is, of any type, spans (kind, start, end, novelty) by start, then kind."""
    own = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), _batches(least, reach, context),
                     f"doc_id {own}, spans array<struct<kind:string,start:bigint,end:bigint,novelty:double>>")


def digest(spans, kinds=KINDS):
    """kind:start:end of the spans of these kinds, comma-joined."""
    return F.concat_ws(",", F.transform(
        F.filter(spans, lambda s: s["kind"].isin(*kinds)),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
