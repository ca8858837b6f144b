"""Language identification by cross-parsing entropy against suffix automata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .suffix_automaton import automaton, parse, table

UNDETERMINED = "und"
BLOCK = 256  # characters parsed at once; a phrase ends where its block ends
SAMPLE_ROWS = 400  # labelled rows drawn for each language
SAMPLE_CHARS = 65_536  # characters of them that the automaton of a language holds
MOST_LANGUAGES = 256
SYMBOLS = 191  # characters with a symbol of their own; others share these by code point
RUN_CHARS = 1 << 20  # characters handled at once
LETTER = r"\p{L}"


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS,
        chars: int = SAMPLE_CHARS) -> dict:
    """The model: for each label the suffix automaton of a sample of its texts. Rows with null text or label, or
    without a letter, teach nothing; no usable row gives a model without languages.

    The sample is bounded by its parameters: of each label the `rows` different texts with the smallest hash, cut
    to blocks, of these the ones with the smallest hash up to `chars` characters. More than MOST_LANGUAGES labels
    are refused, since each costs memory in every task.
    """
    d = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("h")) \
        .filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    langs = d.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels in {lang}")
    first = W.partitionBy("lang").orderBy("h", "once")
    chosen = d.select("lang", "h", F.lit(0).alias("once")).distinct().withColumn("rank", F.row_number().over(first)) \
        .filter(F.col("rank") <= rows).select("lang", "h")
    texts = d.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])  # at most labels x rows
    block = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / BLOCK).cast("int")),
                        lambda i: F.substring(F.col("text"), i * BLOCK + 1, F.lit(BLOCK)))
    blocks = texts.filter(F.col("text").rlike(LETTER)).select("lang", F.explode_outer(block).alias("block")) \
        .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("block"), "block")))
    taken = blocks.filter(F.col("rank") <= chars // BLOCK).orderBy("lang", "rank").collect()  # bounded by the same
    parts: dict[str, list[np.ndarray]] = {}
    for row in taken:
        parts.setdefault(row["lang"], []).append(_codes([row["block"]])[0])
    names = sorted(parts)
    seen = Counter(c for n in names for p in parts[n] for c in p.tolist())
    own = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:SYMBOLS]]
    symbol = {c: i for i, c in enumerate(own)}
    automata = []
    for n in names:
        codes = [32] + [c for p in parts[n] for c in [*p.tolist(), 32]]
        automata.append(automaton([symbol.get(c, c % max(1, len(own))) for c in codes]))
    return {"names": names, "own": own, "automata": automata,
            "bits": [float(np.log2(1 + sum(len(p) + 1 for p in parts[n]))) for n in names]}


def identify(docs: DataFrame, model: dict, text: str = "text", out: str = "lang_pred", score: str = "score",
             lettered: str | None = None) -> DataFrame:
    """`docs` with the predicted language and a score from 0 to 1; only the text is looked at, and all of it.

    A text is lower-cased, everything between letters becomes one space, and blocks of BLOCK characters are parsed
    into the longest phrases that the sample of a language holds. Phrases times the logarithm of the sample's
    length, a character, is the cross-parsing entropy; the lowest wins, ties go to the first label by code point.
    The score is 1 minus the lowest by the second lowest (1 with one language). Null, a text without a letter, or
    a model without languages: `und`, score 0. `lettered` names a further column: whether the text has a letter.
    Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    # Marked so that a later filter on the result does not make Spark parse every text twice.
    predict = F.pandas_udf(_predictor(shared), "lang string, score double, lettered boolean").asNondeterministic()
    new = {out: F.col("__found.lang"), score: F.col("__found.score")}
    if lettered:
        new[lettered] = F.col("__found.lettered")
    return docs.withColumn("__found", predict(F.col(text))).withColumns(new).drop("__found")


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, end of each): lower case, a space for everything between letters."""
    low = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) for t in low])
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(codes)
    between = ~letter
    repeated = between.copy()
    repeated[1:] &= between[:-1]
    starts = np.concatenate(([0], ends[:-1]))
    starts = starts[starts < len(codes)]
    repeated[starts] = between[starts]  # no space in front
    keep = ~repeated
    total = np.concatenate(([0], np.cumsum(keep)))
    return np.where(letter, codes, 32)[keep], total[ends]


def _letters(codes: np.ndarray) -> np.ndarray:
    found = ((codes >= 97) & (codes <= 122))
    high = codes >= 128
    if high.any():
        different, back = np.unique(codes[high], return_inverse=True)
        found[high] = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in different.tolist()])[back]
    return found


def _dense(model: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """Tables of the automata and the symbol of every code point, made once in a worker."""
    if "dense" not in model:
        n = len(model["own"])
        of = (np.arange(0x110000, dtype=np.uint32) % max(1, n)).astype(np.uint8)
        of[np.array(model["own"], np.int64)] = np.arange(n, dtype=np.uint8)
        model["dense"] = [table(*a, n) for a in model["automata"]], of
    return model["dense"]


def _predictor(shared: Broadcast):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names, bits = model["names"], np.array(model["bits"])
        tables, symbol = _dense(model)
        for texts in batches:
            texts = texts.tolist()
            langs, scores, lettered, i = [], [], [], 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j] or "") <= RUN_CHARS):
                    chars += len(texts[j] or "")
                    j += 1
                entropy, size = _entropies(texts[i:j], tables, symbol, bits)
                for x, n in zip(entropy.T, size.tolist()):
                    lettered.append(n > 0)
                    if not n or not names:
                        langs.append(UNDETERMINED), scores.append(0.0)
                        continue
                    best = int(np.argmin(x))
                    langs.append(names[best])
                    rest = np.delete(x, best)
                    scores.append(float(1 - x[best] / rest.min()) if len(rest) else 1.0)
                i = j
            yield pd.DataFrame({"lang": langs, "score": scores, "lettered": lettered})

    return run


def _entropies(texts: list[str | None], tables: list[np.ndarray], symbol: np.ndarray, bits: np.ndarray):
    """(bits a character of each table and text, length of each text) after normalisation; no letter: length 0."""
    codes, ends = _codes(texts)
    starts = np.concatenate(([0], ends[:-1]))
    size = ends - starts
    lettered = np.concatenate(([0], np.cumsum(codes != 32)))
    size[lettered[ends] == lettered[starts]] = 0
    many = -(-size // BLOCK)
    text_of = np.repeat(np.arange(len(texts)), many)
    if not len(text_of) or not tables:
        return np.zeros((len(tables), len(texts))), size
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(many) - many, many)
    place = (starts[text_of] + nth * BLOCK)[:, None] + np.arange(BLOCK)[None, :]
    ended = place >= ends[text_of][:, None]
    place[ended] = 0
    blocks = symbol[codes[place]]
    blocks[ended] = int(symbol.max()) + 1  # the end of a text
    phrases = parse(tables, blocks)
    total = np.stack([np.bincount(text_of, weights=p, minlength=len(texts)) for p in phrases])
    return total * bits[:, None] / np.maximum(size, 1), size

