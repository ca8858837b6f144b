"""Secret scan: fixed patterns, and strings that zstandard cannot compress although it knows their surroundings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
_HEX = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))

# Words that make a place sensitive, and identifiers that code and settings are full of.
SENSITIVE = ("secret", "token", "passw", "pwd", "apikey", "api_key", "auth", "credential", "private", "bearer", "signature",
             "akia", "access_key", "accesskey")
IDENTIFIERS = ("password secret token api_key apiKey access_key private_key public_key client_id client_secret username "
               "authorization bearer credential certificate signature session cookie header request response server host "
               "port localhost example config settings environment default true false null none return import from class "
               "function const let var string integer boolean static public private http https www com org net json xml "
               "yaml html utf8 base64 sha256 md5 uuid index version release build test debug error message value name type")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
BEFORE, AFTER = 24, 96  # how far before a sensitive word a candidate may end, and how far behind one it may begin
AROUND = 512  # characters on each side that prime the dictionary
PIECE = 48  # characters compressed at once: from 64 on, zstandard would also shorten random characters by an entropy code
BLOCK_HEADER = 3  # bytes
NOVEL = 0.85  # marginal bytes a character


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    marks = text.encode("latin-1", "replace").translate(_HEX)  # one byte a character: hexadecimal or not
    run, at = b"\x01" * LEAST["hex"], 0
    while (at := marks.find(run, at)) >= 0:
        end = marks.find(b"\x00", at)
        end = len(marks) if end < 0 else end
        found.append((at, 2, end))
        at = end
    return sorted(found)


def novel_spans(text: str, low: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans near a sensitive word, outside the base spans, whose marginal compressed size is near their length.

    Candidates are whole runs that hold a digit and a letter; the distance to a word counts from their nearer end.
    `base` is sorted, so candidates, zones and base spans are walked together.
    Of a candidate's size, that of the empty text is taken off, both compressed with a dictionary of identifiers
    and of the characters around the candidate. A candidate is one stream with a block for each PIECE, so that what
    it repeats of itself is found, but the few kinds of its characters do not count as a pattern.
    """
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    zones = sorted((max(0, m - BEFORE), m + len(word) + AFTER) for word in SENSITIVE for m in _places(low, word))
    if not zones:
        return []
    found = []
    zone, reach = 0, -1  # the zones that begin up to a candidate's end reach this far
    fixed, taken = 0, -1  # the base spans that begin before a candidate's end reach this far
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while zone < len(zones) and zones[zone][0] <= e:
            reach = max(reach, zones[zone][1])
            zone += 1
        if reach < s:
            continue
        while fixed < len(base) and base[fixed][0] < e:
            taken = max(taken, base[fixed][2])
            fixed += 1
        value = text[s:e]
        if taken > s or not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            continue
        around = (IDENTIFIERS + text[max(0, s - AROUND):s] + text[e:e + AROUND]).encode()
        zip_ = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False,
                                        dict_data=zstandard.ZstdCompressionDict(around, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        marginal = _stream_size(zip_, value) - len(zip_.compress(b""))
        if marginal >= NOVEL * len(value):
            found.append((s, 3, e))
    return found


def _stream_size(zip_: zstandard.ZstdCompressor, value: str) -> int:
    """Compressed size of `value` in blocks of PIECE, without the headers of the blocks; the frame's end is one block."""
    stream = zip_.compressobj(size=len(value))
    size = 0
    for at in range(0, len(value), PIECE):
        size += len(stream.compress(value[at:at + PIECE].encode())) + len(stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)) - BLOCK_HEADER
    return size + len(stream.flush())


def _places(low: str, word: str) -> Iterator[int]:
    at = low.find(word)
    while at >= 0:
        yield at
        at = low.find(word, at + len(word))


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_assign, n_access, n_hex, n_novel, base_sha256 and spans of every whole text.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind. A base span is the whole
    match of its pattern; of `assign`, the second group has the least length. Novel spans overlap no other span.
    Null text is empty; a text without a span has the hash of the empty string. Rows are independent, so repeated
    rows and null keys stay as they are; columns named like the new ones are replaced.
    """
    names = ["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                low = t.lower()
                base = base_spans(t, low)
                novel = novel_spans(t, low, base)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(novel),
                             hashlib.sha256(_written(base).encode()).hexdigest(), _written(sorted(base + novel))))
            yield pd.DataFrame(rows, columns=names)

    found = F.pandas_udf(run, "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
    found = found.asNondeterministic()  # a filter on the result does not scan twice
    return docs.withColumn("__spans", found(F.col(text))).withColumns({n: F.col(f"__spans.{n}") for n in names}).drop("__spans")
