"""Token-id files: fixed-size blocks of ids cut into byte or bit planes, each compressed, with a chunk index.

File layout, little-endian:
    8 bytes  magic PLANES01
    blocks   one after another: the compressed planes of BLOCK_IDS ids (the last block of a file may have fewer)
    index    compressed JSON of arrays: block offsets, ids in each block, plane lengths, and of every document its
             key, first id in the file and number of ids
    16 bytes offset and length of the index
A block or a document is read without the rest of the file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written
from .common import text_buffers, text_runs

MAGIC = b"PLANES01"
BLOCK_IDS = 1 << 16
LEVEL = 3
TEXT_BYTES = 1 << 21  # of text given to the tokenizer at once
CACHE_WORDS = 600_000  # encoded pieces of text a worker remembers


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """Planes of 32-bit ids: plane i holds the i-th byte (or bit) of every id, lowest first."""
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [np.ascontiguousarray(cells[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(bits.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    if unit == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; holds one block of ids."""

    def __init__(self, out, unit: str, block_ids: int = BLOCK_IDS):
        self.out, self.unit, self.block_ids = out, unit, block_ids
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[np.ndarray] = []
        self.size, self.total = 0, 0
        self.index = {"unit": unit, "offset": [], "ids": [], "planes": [], "key": [], "first": [], "count": []}
        out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, key, ids: np.ndarray) -> None:
        self.index["key"].append(key)
        self.index["first"].append(self.total)
        self.index["count"].append(len(ids))
        self.total += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block_ids:
            rest = np.concatenate(self.held)
            while len(rest) >= self.block_ids:
                self._block(rest[:self.block_ids])
                rest = rest[self.block_ids:]
            self.held, self.size = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.unit)]
        self.index["offset"].append(self.at)
        self.index["ids"].append(len(ids))
        self.index["planes"].append([len(p) for p in planes])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.size:
            self._block(np.concatenate(self.held))
        packed = self.zip.compress(json.dumps(self.index, separators=(",", ":")).encode())
        self.out.write(packed + self.at.to_bytes(8, "little") + len(packed).to_bytes(8, "little"))


class PlaneReader:
    """Reads one file, block by block."""

    def __init__(self, source):
        self.source = source
        self.unzip = zstandard.ZstdDecompressor()
        end = source.size()
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of id planes")
        source.seek(end - 16)
        tail = source.read(16)
        at, size = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little")
        source.seek(at)
        self.index = json.loads(self.unzip.decompress(source.read(size)))

    def block(self, i: int) -> np.ndarray:
        self.source.seek(self.index["offset"][i])
        planes = [self.unzip.decompress(self.source.read(n)) for n in self.index["planes"][i]]
        return from_planes(planes, self.index["ids"][i], self.index["unit"])

    def documents(self) -> Iterator[tuple]:
        """(key, first id in the file, ids) of every document, holding one block and one document."""
        at, rest = 0, np.zeros(0, "<u4")
        for key, first, count in zip(self.index["key"], self.index["first"], self.index["count"]):
            parts, missing = [rest[:count]], count - len(rest[:count])
            rest = rest[count:]
            while missing > 0:
                block = self.block(at)
                at += 1
                parts.append(block[:missing])
                rest, missing = block[missing:], missing - len(block[:missing])
            yield key, first, np.concatenate(parts)


def filesystem(path: str):
    """(file system, path in it) of a folder that driver and executors share."""
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


def cuts_at_blanks(rules: dict) -> bool:
    """Whether a tokenizer file shows that blanks and line ends are dropped before tokens are looked for, so that a text
    may be cut there: its normalizers change no blank into another character, its first split drops what it does not
    match, and its pattern names letters, numbers, marks and signs only. False where in doubt."""
    steps = lambda step, inside: [] if not step else step[inside] if step["type"] == "Sequence" else [step]
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if not all(n["type"] in ("NFC", "NFD", "Lowercase") or n == blank for n in steps(rules.get("normalizer"), "normalizers")):
        return False
    if any(re.search(r"\s", t["content"]) for t in rules.get("added_tokens", [])):
        return False
    first = next(iter(steps(rules.get("pre_tokenizer"), "pretokenizers")), {"type": None})
    if first["type"] != "Split":
        return first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    pattern = first["pattern"].get("Regex")
    if pattern is None or not first["invert"] or first["behavior"] != "Removed":
        return False
    return not re.search(r"[\\.^\s]", re.sub(r"\\p\{[LNPSM]\w?\}", "", pattern.replace(r"[^\s", "[")))


def parts_at_marks(rules: dict) -> bool:
    """Whether a tokenizer file shows that no token holds both a letter and a mark: its first split drops what it does not
    match, every alternative of its pattern names letters only, numbers only, signs only, or begins with an apostrophe, and
    no added token holds a mark. False where in doubt."""
    if any(set(t["content"]) & set(Encoder.MARKS) for t in rules.get("added_tokens", [])):
        return False
    step = rules.get("pre_tokenizer") or {}
    first = (step.get("pretokenizers") or [step])[0]
    if first.get("type") != "Split" or not first["invert"] or first["behavior"] != "Removed" or "Regex" not in first["pattern"]:
        return False
    return all(re.fullmatch(r"'[a-z]+|\[?\\p\{[LN]\}\]?\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+", a) for a in first["pattern"]["Regex"].split("|"))


class Encoder:
    """Ids of texts by a tokenizers file. Pieces between blanks and line ends are encoded once and remembered, up to
    CACHE_WORDS of them; the different pieces of a batch are looked up once each and put in place by their numbers.

    Such a cut changes no id where the tokenizer itself never joins across white space: `splits` says so, or where it is
    None, the tokenizer's file; any other tokenizer sees whole texts. Where the file shows that no token holds both a letter
    and a mark, a text is cut between a word and the marks at its end too. New pieces that are one word, or marks, are
    encoded many at once where the vocabulary marks word ends.
    """

    LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", ".,;:!?#$%&*"
    SIMPLE = re.compile(f"[{LETTERS}]+|[{MARKS}]+")
    LAST_MARKS = f"([{LETTERS}])([{MARKS}]+)([ \\n]|$)"
    AT_ONCE = 512

    def __init__(self, tokenizer_path: str, splits: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        rules = json.loads(self.tokenizer.to_str())
        self.splits = cuts_at_blanks(rules) if splits is None else splits
        self.parts = parts_at_marks(rules)
        self.known: dict[str, bytes] = {}
        suffix = rules["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix and self.parts:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        out = {}
        simple = [w for w in pieces if self.SIMPLE.fullmatch(w)] if self.ends is not None else []
        for i in range(0, len(simple), self.AT_ONCE):
            part = simple[i:i + self.AT_ONCE]
            ids = self._ids(" ".join(part))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                cuts = (4 * ends).tolist()
                packed = ids.tobytes()
                out.update(zip(part, [packed[a:b] for a, b in zip([0, *cuts], cuts)]))
        rest = [w for w in pieces if w not in out]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def __call__(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.splits:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
        if self.parts:
            column = pc.replace_substring_regex(column, self.LAST_MARKS, r"\1 \2\3")
        pieces = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        numbered = pieces.flatten().dictionary_encode()
        known, words = self.known, []
        if len(numbered):  # no piece holds a blank; one string for all is made faster than one for each
            every = pa.LargeListArray.from_arrays(pa.array([0, len(numbered.dictionary)], pa.int64()), numbered.dictionary)
            words = pc.binary_join(every, " ")[0].as_py().split(" ")
        fresh = self._encode([w for w in words if w not in known])
        known.update(fresh)
        packed = list(map(known.__getitem__, words))
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids, number = np.frombuffer(b"".join(packed), "<u4"), numbered.indices.to_numpy()
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size[number])))  # of the pieces, in the ids of the batch
        shift = (np.cumsum(size) - size)[number] - ends[:-1]
        ids = ids[np.repeat(shift, size[number]) + np.arange(ends[-1])]
        if len(known) > CACHE_WORDS:
            for w in fresh:
                del known[w]
        cuts = ends[np.concatenate((np.zeros(1, np.int64), np.cumsum(pc.list_value_length(pieces).to_numpy())))].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, key: str = "doc_id",
                      text: str = "text", unit: str = "byte", splits: bool | None = None) -> DataFrame:
    """Write the ids of every text, each followed by `end_id`, to files in `folder`, in ascending key order over the
    range-numbered files; returns (part, path, ids, documents), one row a file.

    Rows are range-partitioned and sorted by key before they are encoded, each task streams one file under a name
    of its own attempt and renames it when whole, so a repeated or lost task leaves no half file. Null text is
    empty; null keys come first; rows with one key are ordered by the hash of their text. No row: no file.
    `folder` must be one that all executors share.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, F.col("key").asc_nulls_first(), "hash") \
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "hash").select("key", "text")

    worker = docs.sparkSession.sparkContext.broadcast({})  # what a worker keeps between tasks

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        writer = encode = None
        fs, base = filesystem(folder)
        draft = f"{base}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        final = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}.planes"
        for batch in batches:
            if writer is None and len(batch):
                if "encoder" not in worker.value:
                    worker.value["encoder"] = Encoder(tokenizer_path, splits)
                encode = worker.value["encoder"]
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(draft)
                writer = PlaneWriter(out, unit)
            for i, j in text_runs(text_buffers(batch.column("text"))[1], TEXT_BYTES):
                texts = batch.column("text").slice(i, j - i)
                for k, ids in zip(batch.column("key").slice(i, j - i).to_pylist(), encode(texts)):
                    writer.add(k, np.append(ids, np.array([end_id], "<u4")))
        if writer is not None:
            writer.close()
            out.close()
            fs.move(draft, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [final],
                                              "ids": [writer.total], "documents": [len(writer.index["key"])]})

    return written(rows.mapInArrow(write, "part int, path string, ids long, documents long"), "token-files")


def read_token_files(spark: SparkSession, files: DataFrame, folder: str, key_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files that `write_token_files` returned."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    placed = files.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    schema = f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                with fs.open_input_file(path) as source:
                    rows = []
                    for key, first, ids in PlaneReader(source).documents():
                        rows.append((key, before + first, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    kind = pa.int64() if key_type in ("long", "bigint") else None

    def _batch(rows):
        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c[0], kind), *(pa.array(x, pa.int64()) for x in c[1:])],
                                          ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, placed.count()), "path").mapInArrow(read, schema)
