"""Token counts by section: whole documents are encoded once, and their tokens given to sections by position."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("majority", "first", "last")
ROWS = 20_000
LONG_RUN = 10_000  # characters of white space that are not left to the pattern, which goes back over them
RUNS_AS_ONE = r"|\s+(?!\S)|\s+"  # end of a pattern that takes a run of white space but its last character as one piece
WHITE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}"  # the white space of these patterns


def load_encoding(path: str, pattern: str):
    """(tiktoken encoding of a rank file, bytes of every id)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        length[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length


def encode(text: str, encoding) -> np.ndarray:
    """Ids of the whole text. A long run of white space is one piece up to its last character (at the end of the text, with
    it), which goes with what follows; that piece is encoded as such, and the text on both sides of it by the pattern, so
    the ids are those of the whole. Patterns that treat such runs otherwise see the whole text."""
    ordinary = lambda part: encoding.encode_to_numpy(part, disallowed_special=())
    pattern = encoding._pat_str
    if len(text) < LONG_RUN or not pattern.endswith(RUNS_AS_ONE) or re.search(r"\\s[*+]|\\[rn]", pattern[:-len(RUNS_AS_ONE)]):
        return ordinary(text)
    parts, at = [], 0
    for run in re.finditer(WHITE, text):
        if len(run[0]) >= LONG_RUN:
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts += [ordinary(text[at:run.start()]),
                      np.array(encoding._encode_single_piece(text[run.start():end].encode()), np.uint32)]
            at = end
    return np.concatenate([*parts, ordinary(text[at:])]) if parts else ordinary(text)


def token_spans(text: str, encoding, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the tokens: a token covers every character of which it holds a byte."""
    ids = encode(text, encoding)
    ends = np.cumsum(length[ids])
    starts = ends - length[ids]
    data = text.encode()
    if len(data) == len(text):
        return starts, ends
    character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def line_starts(text: str) -> list[int]:
    """First character of every line; a line holds its line end."""
    out, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, number of tokens that cross a boundary). `sections` are the first characters of
    intervals that cover a text of `size` characters; a crossing token goes whole to one section by `rule`."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    of = last.copy() if rule == "last" else first.copy()
    if rule == "majority":
        bounds = np.append(sections, size)
        for t in crossing.tolist():
            a, b = int(first[t]), int(last[t])
            share = np.minimum(bounds[a + 1:b + 2], ends[t]) - np.maximum(bounds[a:b + 1], starts[t])
            of[t] = a + int(np.argmax(share))
    return np.bincount(of, minlength=len(sections)), len(crossing)


def count_by_section(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
                     rule: str = "majority") -> DataFrame:
    """For every line of every text: key, section (from 0), start, end (characters, end exclusive), n_tokens, and the
    document's doc_tokens and doc_crossing.

    A document is encoded as a whole, so its counts add up to its tokens. A token that crosses from one section
    into others belongs to the one with most of its characters, on a tie the earlier (`majority`), or to the
    first or the last it touches. Texts of any length go whole, with runs of blanks of any length. Null or empty text: one section 0 of no characters and no tokens. Repeated rows
    give repeated results, null keys stay, other columns are not looked at.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "section", "start", "end", "n_tokens", "doc_tokens", "doc_crossing"]
    worker = docs.sparkSession.sparkContext.broadcast({})  # what a worker keeps between tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encoding" not in worker.value:
            worker.value["encoding"] = load_encoding(path, pattern)
        encoding, length = worker.value["encoding"]
        for batch in batches:
            of, columns, rows = [], [], 0
            for i, t in enumerate(batch.column("text").to_pylist()):
                t = t or ""
                starts, ends = token_spans(t, encoding, length)
                sections = np.array(line_starts(t))
                counts, crossing = attribute(starts, ends, sections, len(t), rule)
                n = len(sections)
                columns.append((np.arange(n), sections, np.append(sections[1:], len(t)), counts,
                                np.full(n, len(starts)), np.full(n, crossing)))
                of.append(np.full(n, i))
                rows += n
                if rows >= ROWS:
                    yield _rows(batch, of, columns)
                    of, columns, rows = [], [], 0
            if rows:
                yield _rows(batch, of, columns)

    def _rows(batch, of, columns):
        keys = batch.column("key").take(pa.array(np.concatenate(of)))
        return pa.RecordBatch.from_arrays([keys, *(pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*columns))], names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, " + ", ".join(f"{n} long" for n in names[1:])).withColumnRenamed("key", key)
