"""Streaming BPE against the library on whole texts, cut anywhere, and on faulty bytes."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.test_operators import docs, none, texts  # noqa: F401
from tracewell.llm import bpe
from tracewell.llm.tokens import default_path

BYTE = default_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTE)
PARTS = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "'ll", "!", "1", "23", "é", "漢", "😀", "ֈ", "　", " the", "ing", "\t", "r", "A", "aaaa", "́", "½", "\x1c", "\x85", "\x00"]


def whole(text, special_text=False):
    return np.frombuffer(b"".join(bpe.Encoder.of(BYTE, special_text).blocks(text)), "<u4").tolist()


def in_pieces(text, size):
    machine = bpe.Transducer(bpe.Merges.of(BYTE), bpe.Encoder.of(BYTE).kinds)
    out = [i for at in range(0, len(text), size) for i in machine.push(text[at : at + size])]
    assert len(machine.window.held) < machine.window.full
    return out + machine.finish()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.integers(1, 9))
def test_ids_equal_the_library_wherever_a_text_is_cut(text, size):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert whole(text) == want and in_pieces(text, size) == want
    back = "".join(bpe.Decoder.of(BYTE).blocks(np.array(want, int)))
    assert back == LIBRARY.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 30000, "ab" * 9000, "=" * 20000, " " * 20000 + "x", "\n \t" * 5000, "漢字" * 6000, "'" * 9000 + "s", "0123456789" * 900, "".join(random.Random(3).choice("theingaoer") for _ in range(40000))])
def test_words_of_any_length_need_a_window_alone(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert whole(text) == want and in_pieces(text, 777) == want


def test_boundaries_before_the_lookahead_are_final():
    """Of random words, whatever follows: tokens that end the lookahead or more before the cut stay as they are."""
    merges, rng = bpe.Merges.of(BYTE), random.Random(11)
    tokens = [t for t in merges.bytes.values() if t.isalpha()]
    for _ in range(150):
        head = b"".join(rng.choice(tokens) for _ in range(60))
        ends = []
        for tail in (b"", *(b"".join(rng.choice(tokens) for _ in range(3)) for _ in range(6))):
            at = np.cumsum([len(merges.bytes[t]) for t in merges.merged([merges.first[b] for b in head + tail])])
            ends.append(at[at <= len(head) - merges.lookahead].tolist())
        assert all(e == ends[0] for e in ends)


def test_lookahead_of_small_merge_lists():
    """Against trying all continuations: no shorter boundary than the computed one may move."""
    from itertools import product

    rng = random.Random(4)
    for _ in range(40):
        m = object.__new__(bpe.Merges)
        m.bytes, m.rules = {0: b"a", 1: b"b"}, []
        for t in range(2, 7):
            a, b = rng.randrange(t), rng.randrange(t)
            if m.bytes[a] + m.bytes[b] not in m.bytes.values():
                m.rules.append((a, b, t))
                m.bytes[t] = m.bytes[a] + m.bytes[b]
            else:
                m.bytes[t] = b"#%d" % t
        m.made, m.order = [x[2] for x in m.rules], {x[:2]: r for r, x in enumerate(m.rules)}
        ends = lambda text: {int(x) for x in np.cumsum([len(m.bytes[t]) for t in m.merged([{97: 0, 98: 1}[c] for c in text])])}  # noqa: B023, E731
        far = m._lookahead()
        for n in (9, 12):
            for head in ({bytes(rng.choice(b"ab") for _ in range(n)) for _ in range(25)}):
                cuts = [ends(head + bytes(tail)) for k in range(4) for tail in product(b"ab", repeat=k)]
                assert len({frozenset(x for x in c if x <= n - far) for c in cuts}) == 1


def test_faulty_bytes_decode_as_in_the_library():
    merges, rng = bpe.Merges.of(BYTE), random.Random(7)
    for _ in range(2000):
        ids = [rng.randrange(50257) if rng.random() < 0.5 else merges.first[rng.randrange(128, 256)] for _ in range(rng.randint(0, 12))]
        machine = bpe.Utf8()
        assert "".join(machine.push(merges.bytes[i]) for i in ids) + machine.finish() == LIBRARY.decode(ids, skip_special_tokens=False)


def test_special_strings_and_other_files(spark):
    text = "a<|endoftext|> b<|endoftext|><|endof"
    assert whole(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    plain = Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = True
    assert whole(text, True) == plain.encode(text, add_special_tokens=False).ids
    assert "".join(bpe.Decoder.of(BYTE, True).blocks(np.array(whole(text)))) == "a b<|endof"
    with pytest.raises(ValueError):
        bpe.Merges(default_path("word_bpe_49k.json"))


def test_tables(spark, docs, none, texts):  # noqa: F811
    rows = bpe.digests(docs, BYTE).collect()
    assert len(rows) == docs.count() and bpe.digests(none, BYTE).count() == 0
    by_id = {i: t or "" for i, t in enumerate(texts)} | {None: texts[0]}
    for r in rows:
        want = LIBRARY.encode(by_id[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
    kept = bpe.decode(spark.createDataFrame([(1, None, "x")], "doc_id long, ids array<int>, base string"), BYTE).first()
    assert tuple(kept) == (1, None, "x", "")


def test_query_equals_the_library(spark):
    from tracewell.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}  # noqa: F811
    rows = queries.QUERIES["op12_bpe_round_trip"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and r["n_tokens"] == len(want)
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
