"""The automaton against the public library, on fixed and on random texts."""

import hashlib
import random
import unicodedata

import pytest
from quirelay.llm import bpe

CASES = [
    "", " ", "　\n", "Hello World", "it's they're WE'LL don't", "a" * 5000, "aaa aaaa aaaaa", "İstanbul ΣΣ ΟΣ", "café café Å", "12345 1st", "x<|endoftext|>y <|startoftext|>", "<|endoftext|",
    "你好，世界", "\U0001f600\U0001f468‍\U0001f469", "a\x00b\x1cc\x85d", "ǅﬁ ßẞ", "...!!!??? --- ***", "'s 's't", " x​y",
]


@pytest.fixture(scope="module")
def tools():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    return lib, bpe.Encoder(*bpe.load(bpe.default_path()))


def same(tools, text):
    lib, own = tools
    want = lib.encode(text, add_special_tokens=False).ids
    ids = own.encode(text)
    assert list(memoryview(ids).cast("I")) == want, text
    assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_fixed(tools, text):
    same(tools, text)


def test_random(tools):
    rng = random.Random(5)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "aeinst' ", "ABCxyz0123.,!?'  \n", "".join(map(chr, range(0x20, 0x250))), "".join(c for c in map(chr, range(0x370, 0x600)) if unicodedata.category(c) != "Cn"), "éé̈a 一二"]
    for _ in range(3000):
        a = rng.choice(alphabets)
        same(tools, "".join(rng.choice(a) for _ in range(rng.randint(0, 40))))


def test_tiny_merges_by_brute_force():
    """Every word of up to seven letters, against the merges applied one by one."""
    import itertools

    merges = [("a", "a"), ("a", "b"), ("aa", "b</w>"), ("b", "a"), ("ab", "a</w>"), ("aa", "aa")]
    base = ["a", "b", "a</w>", "b</w>"]
    vocab = {t: i for i, t in enumerate(base + [u + v for u, v in merges])}
    own = bpe.Encoder(bpe.MergeAutomaton(vocab, merges), {}, r"\S+")
    for n in range(1, 8):
        for letters in itertools.product("ab", repeat=n):
            word = "".join(letters)
            tokens = [*word[:-1], word[-1] + "</w>"]
            for u, v in merges:
                i = 0
                while i + 1 < len(tokens):
                    if tokens[i] == u and tokens[i + 1] == v:
                        tokens[i : i + 2] = [u + v]
                    i += 1
            assert own.word(word) == [vocab[t] for t in tokens], word


def test_full_tables_start_anew(tools, monkeypatch):
    """Transitions are the same whatever states are kept; a second reading makes no state."""
    automaton = tools[1].words.automaton
    own = bpe.WordAutomaton(automaton)
    rng = random.Random(8)
    words = ["".join(rng.choice("aeinrstlowhd") for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["a</w>b", "</w>", "ab" * 4000, ""]
    want = [own.encode(w) for w in words]
    kept = len(own.states), len(own.moves)
    assert [own.encode(w) for w in words] == want and (len(own.states), len(own.moves)) == kept
    monkeypatch.setattr(bpe, "STATES", 50)
    small = bpe.WordAutomaton(automaton)
    assert [small.encode(w) for w in words] == want and len(small.states) <= 51


def test_rows(spark):
    docs = spark.createDataFrame([(1, "Hi there", 9), (2, None, 9), (2, None, 9), (None, "", 9)], "doc_id long, text string, id int")
    got = sorted(bpe.encode_decode(docs, bpe.default_path()).collect(), key=lambda r: (r["id"] is None, r["id"] or 0))
    assert [len(r["token_ids"]) for r in got] == [8, 0, 0, 0] and [r["decoded"] for r in got][1:] == ["", "", ""]
    assert hashlib.sha256(got[0]["token_ids"]).hexdigest() and bpe.encode_decode(docs.limit(0), bpe.default_path()).count() == 0
