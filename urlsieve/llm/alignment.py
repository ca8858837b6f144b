"""Alignment of two tokenizers: shared ends cut documents into windows of ids, which are aligned once each."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import text_buffers, text_runs

TEXT_BYTES = 1 << 20  # of text aligned at once
CACHE_WORDS = 300_000  # stretches between blanks whose ids a worker remembers, the first that it meets
CACHE_WINDOWS = 300_000  # windows whose alignment a worker remembers, the first that it meets
LONG_WINDOW = 4096  # ids; windows that come with a longer one are not remembered
AT_ONCE = 4096  # new stretches encoded as one text
HEAD_PAIRS = 1 << 20  # id pairs whose counts are broadcast (17 bytes each); the rest are joined
OTHER = np.uint32(1 << 31)  # marks ids of the second tokenizer in a window
MARK = "▁"


def byte_symbols() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes
    for the characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A byte-level tokenizers file; encodes a space and the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        symbols = byte_symbols()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            known = all(c in symbols for c in token)
            self.bytes[i] = bytes(symbols[c] for c in token) if known else token.encode()
        rules = json.loads(self.tokenizer.to_str())
        before = rules.get("pre_tokenizer") or {}
        #: Words are encoded apart, a word with the blank before it.
        self.by_words = not rules.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) \
            and not before.get("add_prefix_space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; sets a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and self.model.is_byte(i)
                      else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        #: No piece goes on behind a word.
        self.by_words = all(MARK not in p[1:] or not p.strip(MARK) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def align_windows(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, ends: np.ndarray,
                  names: list[str]) -> tuple[list[str], list[bytes], np.ndarray]:
    """For successive windows that end at the byte offsets `ends`: groups as text, links as packed pairs, numbers
    of groups. `a` and `b` are the ids of all windows, over the same bytes. A link joins two tokens that share a byte, so
    there is one for each stretch between two ends of either; a group ends where a token of both ends."""
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    cut = np.union1d(a_end, b_end)
    of_a, of_b = np.searchsorted(a_end, cut), np.searchsorted(b_end, cut)
    links = (a[of_a].astype("<i8") << 32 | b[of_b]).tobytes()
    both = np.flatnonzero((a_end[of_a] == cut) & (b_end[of_b] == cut))
    left, right = [names[x] for x in a.tolist()], [names[x] for x in b.tolist()]
    to_a, to_b = (of_a[both] + 1).tolist(), (of_b[both] + 1).tolist()
    groups = [",".join(left[s:e]) + "|" + ",".join(right[t:f]) for s, e, t, f in zip([0, *to_a], to_a, [0, *to_b], to_b)]
    at_link = (8 * np.searchsorted(cut, ends, "right")).tolist()
    at_group = np.searchsorted(cut[both], ends, "right")
    bounds = at_group.tolist()
    return ([";".join(groups[g:h]) for g, h in zip([0, *bounds], bounds)],
            [links[s:e] for s, e in zip([0, *at_link], at_link)], np.diff(at_group, prepend=0))


class Aligner:
    """What a worker keeps between batches: both tokenizers, ids of words, alignments of windows.

    A window is the ids of both tokenizers between two anchors, packed: first those of one, then those of the other,
    marked. Alignments have numbers; those of a full memory are given up after the batch.
    """

    CUT = re.compile(r"(?<=\S) (?=\S)")  # one blank between words: both tokenizers begin a token there

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_size, self.b_size = [np.array([len(x) for x in t.bytes]) for t in (self.a, self.b)]
        self.names = [str(i) for i in range(max(len(self.a_size), len(self.b_size)))]
        self.a_blank, self.b_blank = [np.array([x[:1] == b" " for x in t.bytes]) for t in (self.a, self.b)]
        self.by_words = self.a.by_words and self.b.by_words
        self.words: dict[str, bytes] = {}  # the window of a stretch that is one
        self.windows: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.links: list[bytes] = []
        self.numbers = np.zeros((0, 3), np.int64)  # tokens of both, groups

    def _split(self, a: list[int], b: list[int], want: bytes) -> tuple[list[bytes], np.ndarray] | None:
        """(windows, first bytes of them) of two id lists; None unless both spell `want`. A window begins where a
        token of both begins with a blank and what came before ends at one byte."""
        if not b"".join(map(self.a.bytes.__getitem__, a)) == want == b"".join(map(self.b.bytes.__getitem__, b)):
            return None
        a, b = np.array(a, "<u4"), np.array(b, "<u4")
        a_at, b_at = np.flatnonzero(self.a_blank[a]), np.flatnonzero(self.b_blank[b])
        a_start, b_start = np.cumsum(self.a_size[a]) - self.a_size[a], np.cumsum(self.b_size[b]) - self.b_size[b]
        shared, x, y = np.intersect1d(a_start[a_at], b_start[b_at], assume_unique=True, return_indices=True)
        of_a, of_b = np.append(a_at[x], len(a)), np.append(b_at[y], len(b))
        both = np.empty(len(a) + len(b), "<u4")
        both[np.arange(len(a)) + np.repeat(of_b[:-1], np.diff(of_a))] = a
        both[np.arange(len(b)) + np.repeat(of_a[1:], np.diff(of_b))] = b | OTHER
        at, packed = (4 * (of_a + of_b)).tolist(), both.tobytes()
        return [packed[s:e] for s, e in zip(at, at[1:])], shared

    def _learned(self, fresh: list[str]) -> tuple[dict[str, bytes], dict[str, list[bytes] | None]]:
        """New stretches that are one window, and the windows of the others, None where the ids do not spell them.
        Those without a blank are encoded many at once, as one text, the others one by one."""
        one: dict[str, bytes] = {}
        simple = [w for w in fresh if self.by_words and w and " " not in w and w == w.strip()]
        for i in range(0, len(simple), AT_ONCE):
            part = simple[i:i + AT_ONCE]
            text = " ".join(part)
            want = b" " + text.encode()
            split = self._split(*self.a.encode([text]), *self.b.encode([text]), want)
            if split and np.array_equal(split[1], np.flatnonzero(np.frombuffer(want, np.uint8) == 32)):
                one.update(zip(part, split[0]))
        rest = [w for w in fresh if w not in one]
        several: dict[str, list[bytes] | None] = {}
        for w, a, b in zip(rest, self.a.encode(rest), self.b.encode(rest)):
            split = self._split(a, b, b" " + w.encode()) if w else None
            if split and len(split[0]) == 1:
                one[w] = split[0][0]
            else:
                several[w] = split and split[0]
        return one, several

    def _texts_windows(self, texts: list[str]) -> list[list[bytes]]:
        """Windows of whole texts; none where a text has no tokens.

        A stretch between two single blanks is encoded once and remembered where both vocabularies allow it: then no
        token of either goes across such a blank, the ids are those of the whole text, and the blank is an anchor.
        """
        cut = [self.CUT.split(t) if self.by_words else [t] for t in texts]
        found = [list(map(self.words.get, words)) for words in cut]
        one, several = self._learned(list({w for words, known in zip(cut, found) if None in known
                                           for w, k in zip(words, known) if k is None}))
        out = []
        for text, words, known in zip(texts, cut, found):
            if None in known:
                known = [one.get(w) if k is None else k for w, k in zip(words, known)]
            if None in known:
                parts = [several[w] if k is None else [k] for w, k in zip(words, known)]
                if None in parts:  # a stretch alone does not come back: the whole text decides
                    split = self._split(*self.a.encode([text]), *self.b.encode([text]), b" " + text.encode()) if text else None
                    parts = [split[0] if split else []]
                known = list(chain.from_iterable(parts))
            out.append(known)
        if self.by_words and len(self.words) < CACHE_WORDS:
            self.words.update(one)
        return out

    def _align(self, fresh: list[bytes]) -> None:
        ids = np.frombuffer(b"".join(fresh), "<u4")
        mine = ids < OTHER
        left, right = ids[mine], ids[~mine] ^ OTHER
        stop = np.cumsum([len(k) // 4 for k in fresh]) - 1
        to_a = np.cumsum(mine)[stop]
        groups, links, counts = align_windows(left, right, self.a_size, self.b_size, np.cumsum(self.a_size[left])[to_a - 1], self.names)
        self.groups += groups
        self.links += links
        n_a = np.diff(to_a, prepend=0)
        self.numbers = np.concatenate((self.numbers, np.stack((n_a, np.diff(stop, prepend=-1) - n_a, counts), axis=1)))

    def __call__(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """For each text: tokens of both, groups, groups as text, links as packed pairs."""
        of = self._texts_windows(texts)
        keys = list(chain.from_iterable(of))
        numbers = list(map(self.windows.get, keys))
        fresh = list({k for k, n in zip(keys, numbers) if n is None}) if None in numbers else []
        kept = len(self.groups)
        if fresh:
            self._align(fresh)
            new = dict(zip(fresh, range(kept, kept + len(fresh))))
            numbers = [new[k] if n is None else n for k, n in zip(keys, numbers)]
        out, at = [], 0
        for windows in of:
            mine = numbers[at:at + len(windows)]
            at += len(windows)
            n_a, n_b, groups = self.numbers[mine].sum(axis=0).tolist() if mine else (0, 0, 0)
            out.append((n_a, n_b, groups, ";".join([self.groups[n] for n in mine]),
                        np.frombuffer(b"".join([self.links[n] for n in mine]), "<i8")))
        if fresh and kept < CACHE_WINDOWS and max(map(len, fresh)) <= 4 * LONG_WINDOW:
            self.windows.update(new)
        elif fresh:
            del self.groups[kept:], self.links[kept:]
            self.numbers = self.numbers[:kept]
        return out


def alignments(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row of `docs`: key, n_a, n_b (tokens), n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`, ids in order),
    and its distinct links as arrays a, b (ids) and times.

    `a_path` is a byte-level tokenizers file and encodes a space and the text; `b_path` is a sentencepiece model that
    sets that space itself. Whole documents are tokenised. Where tokens of both end at one byte and a token with a
    leading space follows in both, the documents are cut; the windows between are aligned once for each pair of id
    tuples and remembered. Null or empty text, and text that either tokenizer does not give back byte for byte:
    zeros, no groups, no links. Long texts without blanks are one window. Repeated rows give repeated results, null
    keys stay, an empty table gives an empty one, other columns are not looked at.
    """
    worker = docs.sparkSession.sparkContext.broadcast({})  # what a worker keeps between tasks
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "aligner" not in worker.value:
                worker.value["aligner"] = Aligner(a_path, b_path)
            for i, j in text_runs(text_buffers(batch.column("text"))[1], TEXT_BYTES):
                texts = [t or "" for t in batch.column("text").slice(i, j - i).to_pylist()]
                rows, pairs, times = [], [], []
                for n_a, n_b, n_groups, groups, links in worker.value["aligner"](texts):
                    distinct, often = np.unique(links, return_counts=True)
                    pairs.append(distinct)
                    times.append(often)
                    rows.append((n_a, n_b, n_groups, len(links), groups))
                at = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pairs]))), pa.int32())
                flat = np.concatenate(pairs)
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32)))
                         for x in (flat >> 32, flat & 0xFFFFFFFF, np.concatenate(times))]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(i, j - i), *(pa.array(c, pa.int64()) for c in columns[:4]),
                     pa.array(columns[4], pa.string()), *lists], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, "
             "times array<int>").withColumnRenamed("key", key)


def with_link_counts(aligned: DataFrame, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """`aligned` (with the arrays a, b, times of `alignments`, which go) and n_best, count_sum.

    The count of an id pair is the number of rows that hold it linked. count_sum adds it up over all links of a row;
    n_best counts the links whose pair has the highest count of its first id, ties included. Pairs are counted in the
    map tasks first. The commonest pairs, `head_pairs` at most, are given to every task; all others are joined.
    """
    spark = aligned.sparkSession
    aligned = written(aligned.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = written(aligned.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("docs")), "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    pairs = written(counts.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs")
    by_size = pairs.groupBy(F.floor(F.log2("docs")).alias("power")).agg(F.count("*").alias("n")) \
        .orderBy(F.desc("power")).collect()  # one row for each power of two
    held, least = 0, None
    for r in by_size:
        held += r["n"]
        if held <= head_pairs:
            least = 1 << r["power"]
    whole = held <= head_pairs
    head = pairs.filter(F.lit(least is not None) & (F.col("docs") >= (least or 1))).toArrow()
    packed = head.column("a").to_numpy().astype(np.int64) << 32 | head.column("b").to_numpy()
    order = np.argsort(packed)
    table = spark.sparkContext.broadcast((packed[order], head.column("docs").to_numpy()[order],
                                          head.column("best").to_numpy()[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, best = table.value
        for batch in batches:
            lists = [batch.column(c) for c in ("a", "b", "times")]
            a, b, times = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in lists)
            of = np.repeat(np.arange(len(batch)), lists[0].value_lengths().to_numpy(zero_copy_only=False))
            pair = a << 32 | b
            at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            at, group, weight = at[known], of[known], times[known]
            sums = [np.bincount(group, weights=weight * v[at], minlength=len(batch)).astype(np.int64) if len(at) else
                    np.zeros(len(batch), np.int64) for v in (best, docs)]
            rest = np.concatenate(([0], np.cumsum(np.bincount(of[~known], minlength=len(batch)))))
            rows = [pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(v[~known].astype(np.int32))) for v in (a, b, times)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(s) for s in sums] + rows,
                                             [*kept, "n_best", "count_sum", "a", "b", "times"])

    kept = [c for c in aligned.columns if c not in ("a", "b", "times")]
    types = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)
    found = aligned.select(*kept, "a", "b", "times").mapInArrow(
        look_up, types + ", n_best long, count_sum long, a array<int>, b array<int>, times array<int>")
    if whole:
        return found.drop("__row", "a", "b", "times")
    found = written(found, "counted")
    rare = found.select("__row", F.inline(F.arrays_zip("a", "b", "times"))).join(pairs, ["a", "b"])
    sums = rare.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                     F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
    return found.join(sums, "__row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}) \
        .drop("__row", "a", "b", "times", "more_best", "more_sum")
