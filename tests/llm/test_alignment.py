import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import make_docs
from tramwise.llm import alignment
from tramwise.llm.token_counts import byte_letters

NUMBER = byte_letters()


@pytest.fixture(scope="module")
def sides():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return first, second


def tokens(sides, text):
    """(id, bytes) of both sides, by the libraries over the whole text."""
    first, second = sides
    a = first.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(NUMBER[c] for c in first.id_to_token(i))) for i in a.ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        held = bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()
        b.append((i, held))
    return a, b


def brute(sides, texts):
    """What the contract says, link by link."""
    found, counts = [], Counter()
    for text in texts:
        a, b = tokens(sides, text) if text else ([], [])
        whole = b" " + (text or "").encode()
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, held in side:
                own.append((at, at + len(held), i))
                at += len(held)
            spans.append(own)
        links = [
            (x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]
        ]
        counts.update(links)
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, begin = [], 0
        for cut in cuts:
            sides_ = [",".join(str(i) for s, e, i in own if begin <= s and e <= cut) for own in spans]
            groups.append("|".join(sides_))
            begin = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((len(a), len(b), len(groups), links, digest))
    best: dict[int, int] = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (n_a, n_b, n_g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest)
        for n_a, n_b, n_g, links, digest in found
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TRICKY = [
    None,
    "",
    " ",
    "  two  blanks  ",
    "\n line\n\n  two \t\n x",
    "don't we'll <|endoftext|> <s> </s> <unk> <0x41>",
    "café naïve 日本語 \U0001f600\U0001f468‍\U0001f469 x́",
    "no break  em 　wide \u0085next",
    "a▁b",
    "null \x00 and \x1c control",
    "word " * 3000,
    "x" * 5000,
    "   leading",
    "trailing  ",
    "   y",
]


def rows_of(frame):
    return [tuple(r[c] for c in COLUMNS) for r in frame.orderBy("doc_id").collect()]


@pytest.mark.parametrize("frequent", [1 << 20, 50, 0])
def test_equals_link_by_link(spark, sides, frequent):
    docs = make_docs(spark, list(enumerate(TRICKY)))
    assert rows_of(alignment.align(docs, frequent=frequent)) == brute(sides, TRICKY)


def test_whole_table(small, small_docs, sides):
    short = small_docs[small_docs.text.str.len() < 4000]
    docs = small("documents").where(F.length("text") < 4000)
    assert rows_of(alignment.align(docs)) == brute(sides, short.text.tolist())


def test_chunks_change_nothing(small_docs, sides):
    """Encoded chunk by chunk, a text has the tokens it has as a whole."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        first = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        aligner = alignment.Aligner(first, f.read())
    for text in [t for t in TRICKY if t] + small_docs.text.tolist():
        data = np.frombuffer(b" " + text.encode(), np.uint8)
        cut = [0, *alignment.chunk_starts(data).tolist(), len(data)]
        chunks = [data[s:e].tobytes() for s, e in zip(cut, cut[1:])]
        a, b = aligner.encode(chunks)
        whole = tokens(sides, text)
        assert [i for x in a for i in x] == [i for i, _ in whole[0]]
        assert [i for x in b for i in x] == [i for i, _ in whole[1]]


def test_components_of_a_long_chain():
    a = np.array([*range(1, 2000, 2), 2001])
    b = np.array([*range(2, 2001, 2), 2001])
    x, y = alignment.components(a, b)
    assert set(x) == set(y) == {0}


def test_odd_rows(odd, no_docs):
    rows = alignment.align(odd).collect()
    assert len(rows) == odd.count()
    assert sorted(r.n_a for r in rows if r.doc_id == 2) == [0]
    same = {tuple(r) for r in rows if r.doc_id == 1}
    assert len(same) == 2
    assert alignment.align(no_docs).collect() == []


def test_different_chunks_are_encoded_together(sides):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        first = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        aligner = alignment.Aligner(first, f.read())
    words = [f"w{i * 7919 % 1000}x{i}" for i in range(3000)]
    odd = ["", " two  blanks ", "line\n\nline\t end ", "\u00a0\u2003wide \u3000", "it's 'll we 've", "\u2581 lost", "caf\u00e9 \u00e9\u00e8 \U0001f600", "end\n"]
    texts = [" ".join(words), *odd, *[a + " " + b for a in odd for b in odd]]
    held = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, held)])
    calls, encode = [], aligner.fast.encode_ordinary

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return encode(text)

    aligner.fast = Counted()
    figures, links, digests, *_ = alignment.align_slice(aligner, np.frombuffer(b"".join(held), np.uint8), bounds)
    assert len(calls) < 100  # 3,000 words
    wanted = brute(sides, texts)
    assert [(*f, int(n), d) for *f, n, d in zip(*(f.tolist() for f in figures), links.tolist(), digests)] == [
        (*w[:4], w[-1]) for w in wanted
    ]
