"""Alignment of two tokenizers: the registered query against a plain reading of its contract."""

import hashlib
import re
from collections import Counter

import public_tokenizers as P
import pytest

from urlsieve.llm import alignment as G
from urlsieve.llm import queries as Q

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  two  blanks ", "\n\n\tx", "one", "It is what it is, isn't it?", "äöü ß 日本語のテキスト 漢字",
         "emoji 👩‍👩‍👧 and ▁ mark", "mark▁inside", "<|endoftext|> is <s> text </s> <0x41>", "a b c　d ​z",
         "x" * 3000, " " * 3000, "\n" * 500, "tab\tsep\r\nline", "1234567 89,01 3.14e10", "a  b   c    d     e", "\x00 \x1c \x85",
         "Ａ full width ﬁ ligature é combining", "de la " * 400, "don't we'll I'm 's 'x", "ends with blank ", "é" * 50]


def byte_chars():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {}, 0
    for b in range(256):
        out[chr(b) if b in plain else chr(256 + n)] = b
        n += b not in plain
    return out


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH), byte_chars()


def tokens(both, text):
    a, b, chars = both
    left = a.encode(" " + (text or ""), add_special_tokens=False).ids
    right = b.encode(text or "")
    la = [bytes(chars[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in left]
    lb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, right)]
    want = (" " + (text or "")).encode()
    return list(zip(left, la)) if text and b"".join(la) == want == b"".join(lb) else [], list(zip(right, lb))


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def contract(both, rows):
    of = []
    for i, text in rows:
        left, right = tokens(both, text)
        left, right = (spans(left), spans(right)) if left else ([], [])
        links = [(a, b) for a, s, e in left for b, u, v in right if max(s, u) < min(e, v)] if len(left) < 700 else \
            sweep(left, right)
        ends = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups, lo = [], 0
        for end in ends:
            groups.append(",".join(str(a) for a, s, e in left if lo <= s < end) + "|" +
                          ",".join(str(b) for b, s, e in right if lo <= s < end))
            lo = end
        of.append((i, len(left), len(right), groups, links))
    count = Counter(p for *_, links in of for p in set(links))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    return sorted(((i, a, b, len(g), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, links in of), key=repr)


def sweep(left, right):
    out, j = [], 0
    for a, s, e in left:
        while right[j][2] <= s:
            j += 1
        k = j
        while k < len(right) and right[k][1] < e:
            out.append((a, right[k][0]))
            k += 1
    return out


def query(spark, monkeypatch, rows):
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, a int, n_best string")
    monkeypatch.setattr(Q, "table", lambda *_: frame)
    return sorted((tuple(r) for r in Q.op12_token_alignment(spark, "").collect()), key=repr)


def test_query_keeps_its_contract(spark, monkeypatch, both):
    rows = list(enumerate(TEXTS)) + [(None, "one"), (5, "one"), (5, "one two")]
    assert query(spark, monkeypatch, rows) == contract(both, rows)
    assert query(spark, monkeypatch, []) == []


def test_rare_pairs_are_joined(spark, both):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [r[:7] for r in contract(both, rows)]
    for head in (0, 40, 10**6):
        found = G.with_link_counts(G.alignments(docs, A_PATH, B_PATH).drop("groups"), head)
        got = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum").collect()
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_operator_gives_groups_in_order(spark):
    docs = spark.createDataFrame([("k", "hello world")], "id string, body string")
    r = G.alignments(docs, A_PATH, B_PATH, "id", "body").first()
    assert r.id == "k" and r.n_groups == len(r.groups.split(";")) and sum(r.times) == r.n_links
    assert [g.count("|") for g in r.groups.split(";")] == [1] * r.n_groups


def test_remembered_words_and_windows_change_nothing(both, monkeypatch):
    monkeypatch.setattr(G, "CACHE_WORDS", 3)
    monkeypatch.setattr(G, "CACHE_WINDOWS", 3)
    small = G.Aligner(A_PATH, B_PATH)
    whole = G.Aligner(A_PATH, B_PATH)
    whole.by_words = False
    plain = lambda rows: [(*r[:4], r[4].tolist()) for r in rows]
    for text in TEXTS:
        want = plain(whole([text or ""]))
        assert plain(small([text or ""])) == want and plain(small([text or "", "x"]))[:1] == want


def test_small_tables_against_the_contract(spark, sf, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in Q.op12_token_alignment(spark, sf).collect()), key=repr)
    want = contract(both, [(i, t) for i, t in rows])
    assert got == want


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "ab" * 200_000), (2, "word and " * 150_000)], "doc_id long, text string")
    got = G.with_link_counts(G.alignments(docs, A_PATH, B_PATH).drop("groups")).orderBy("doc_id").collect()
    assert all(r.n_links >= max(r.n_a, r.n_b) > 0 for r in got)
