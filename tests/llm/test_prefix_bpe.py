"""BPE over prefixes against the tokenizers library."""

import hashlib
import random
import time
import unicodedata

import numpy as np
import public_tokenizers
import pytest

from thalweg.llm import prefix_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def right():
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(PATH)
    held.no_truncation()
    held.no_padding()
    return held


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


AWKWARD = ["", None, " ", "a", "the same", "the same", "Straße ñandú\t日本語 😀\n\r\nx", "word " * 3000, "a" * 3000, "don't we'll 12 345 --- ...  ", "<|endoftext|>", "x  <|endoftext|> y<|endoftext|><|endoftext|>\n", "<|endoftext", "\x1f x\x1cy z\x85w\xa0", "՘a ꟎b", " " * 500 + "x", "㈻0" + chr(0x323B0) + "a"]


def test_rows_equal_the_library(spark, right):
    rng = random.Random(12)
    texts = AWKWARD + ["".join(rng.choice(["a", "e", "th", "ing", " ", "  ", "\n", "'s", "é", "漢", "1", "<|endoftext|>", "aaaa", "_", "==", "­", "ه"]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "again", "", ""), (None, "again", "", "")], "doc_id long, text string, ids string, decoded string").repartition(3)
    rows = {r.doc_id: r for r in prefix_bpe.encode_texts(df).collect()}
    digests = {r.doc_id: r for r in prefix_bpe.encode_digests(df).collect()}
    assert len(rows) == len(texts) + 1 and prefix_bpe.encode_digests(df.filter("doc_id IS NULL")).count() == 2
    for i, t in enumerate(texts):
        ids = right.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].decoded == right.decode(ids, skip_special_tokens=False) == (t or "")
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert prefix_bpe.encode_texts(df.limit(0)).count() == 0


def test_characters_that_the_libraries_know_from_different_tables(right):
    encoder = prefix_bpe.Encoder(PATH)
    for c in [*range(0x250), *range(0x300, 0xD800, 7), *range(0xE000, 0x110000, 977), *(x for x in range(0x10FFFF) if unicodedata.category(chr(x)) in ("Zs", "No", "Nl"))]:
        s = f"a{chr(c)}1{chr(c)} {chr(c)}  {chr(c)}{chr(c)}b"
        assert ids_of(encoder.encode(s)) == right.encode(s, add_special_tokens=False).ids, hex(c)


def test_long_pieces_take_linear_time(right):
    encoder, rng = prefix_bpe.Encoder(PATH), random.Random(13)
    for text in ("ab" * 3000, "a" * 5001, "-" * 3333, "日本" * 900, "".join(rng.choice("abcdeiorst") for _ in range(20_000))):
        assert ids_of(encoder.encode(text)) == right.encode(text, add_special_tokens=False).ids
    took = []
    for n in (100_000, 400_000):
        text = "".join(rng.choice("abcdeiorstnlu") for _ in range(n))
        began = time.time()
        assert encoder.decode(encoder.encode(text)) == text
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 5


def test_automaton_names_all_tokens_that_end_a_prefix():
    words = {w: i for i, w in enumerate([b"a", b"b", b"c", b"ab", b"bab", b"abc", b"bc", b"babc", b"cc"])}
    automaton = prefix_bpe.SuffixAutomaton(words)
    for state in range(len(automaton.go)):
        assert [n for _, n in automaton.found[state]] == sorted((n for _, n in automaton.found[state]), reverse=True)
    vocab = prefix_bpe.vocabulary(PATH)
    known = {vocab.tokens[i]: i for i in vocab.made} | {bytes([b]): i for i, t in vocab.tokens.items() if len(t) == 1 for b in t}
    for text in (b" ontothe", b"aaaaaaa", b"ineaenstheing"):
        state = 0
        for end in range(1, len(text) + 1):
            while text[end - 1] not in vocab.automaton.go[state]:
                state = vocab.automaton.link[state]
            state = vocab.automaton.go[state][text[end - 1]]
            found = {t for t, n in vocab.automaton.found[state] if text[:end].endswith(vocab.tokens[t])}
            assert found == {known[text[i:end]] for i in range(end) if text[i:end] in known}
