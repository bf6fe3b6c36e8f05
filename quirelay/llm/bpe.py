"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled one after another. The automaton starts as one state that allows every base
symbol. The gadget of merge ``b: (u, v) -> uv`` acts if ``v`` may follow ``u``: the state behind ``u`` is
copied without the arc ``v``, all arcs ``u`` lead to the copy, and every state with an arc ``u`` gets an
arc ``uv`` to where ``v`` led. All arcs with one label always lead to one state, so a state is named by
the token before it, and copies are kept as differences: which gadget took which arc from the state
behind which token. The language of the result is the set of correct tokenizations, every prefix of one
included, so the last token of each prefix of a word is unique.

Words are read letter by letter, so each arc is spelt by the letters of its token, along a trie of the
vocabulary, and the result is made deterministic: a state of the word automaton is the set of (token before,
trie node) that the letters read so far allow, and holds the one token that ends there. States and
transitions are made the first time a word asks for them and kept in tables, within a worker for all of its
tasks; afterwards a letter costs one look-up. A pre-split word is encoded by these transitions, its tokens are
read off backwards. The tables, and that of encoded chunks of text, have bounded sizes and start anew when
full, which changes no result. Decoding emits the labels of the arcs, joined by blanks, as the tokenizer file
(which has no decoder) asks for.

Defined cases: a null or empty text has no tokens and decodes to ''; strings of added tokens in a text
become these tokens; further columns are ignored; any length of text and of word is encoded whole. Code points that Unicode 15.1
has not assigned may be split otherwise than a tokenizer with other tables splits them.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import arrow_map, pieces
from .util import read

#: Fixed value: the Unicode property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = re.compile(f"[^{SPACE}]+")
END = "</w>"
#: Entries of the tables of chunks and of states in a worker; both start anew when full.
CHUNKS, STATES = 300_000, 100_000
NEVER = 1 << 60
#: Letters stand in the low bits of a transition's key: byte letters are below 512, the last one means the end of a word.
BITS, LAST = 9, 511


def byte_letters() -> list[str]:
    """A printable letter for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    """Compiled merges; small enough to be broadcast (its size is that of the vocabulary)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab, self.labels = vocab, {i: t for t, i in vocab.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.birth: dict[int, int] = {}
        self.taken: dict[tuple[int, int], int] = {}  # (u, v): the gadget that took arc v from the state behind u
        self.first: dict[int, bool] = {}  # arcs that leave the start
        made = {vocab[u + v] for u, v in merges}
        for t in vocab.values():
            if t not in made:
                self.birth[t], self.first[t] = -1, True
        for b, (u, v) in enumerate(merges):
            self._gadget(b, vocab[u], vocab[v], vocab[u + v])

    def _gadget(self, b: int, u: int, v: int, uv: int) -> None:
        self.left[uv], self.right[uv] = u, v
        if u in self.birth and v in self.birth and self.follows(u, v, b):
            self.taken[u, v] = self.birth[uv] = b
            self.first[uv] = self.first[u]

    def follows(self, t: int, x: int, until: int = NEVER) -> bool:
        """Whether arc ``x`` leaves the state behind ``t`` once the gadgets before ``until`` have acted."""
        taken, birth = self.taken, self.birth
        while True:
            if x not in birth:
                return False
            at, end = t, until
            while True:
                if taken.get((at, x), NEVER) < end:
                    return False
                if birth[at] < 0:
                    break
                end = min(end, birth[at])  # the state behind uv began as the one behind v
                at = self.right[at]
            if birth[x] < 0:
                return True
            until = min(until, birth[x] + 1)
            x = self.left[x]


class WordAutomaton:
    """The deterministic automaton over the letters of words; states are numbers, 0 is the start."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.children: dict[int, int] = {}
        self.ends = [-1]  # trie node: the token that ends there
        self.inner = [False]  # trie node: whether letters follow
        self.sizes: dict[int, int] = {}  # token: letters, the end of a word not counted
        for t, x in automaton.vocab.items():
            letters = [ord(c) for c in t.removesuffix(END)]
            # Base symbols are single letters; other tokens that no merge makes stand in no word.
            if x in automaton.birth and letters and max(letters) < LAST and (automaton.birth[x] >= 0 or len(letters) == 1):
                self._spell([*letters, LAST] if t.endswith(END) else letters, x, len(letters))
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.tokens: list[int] = []  # state: the token that ends there
        self.moves: dict[int, int] = {}
        self._restart()

    def _spell(self, path: list[int], x: int, size: int) -> None:
        node = 0
        for c in path:
            child = self.children.setdefault(node << BITS | c, len(self.ends))
            if child == len(self.ends):
                self.ends.append(-1)
                self.inner.append(False)
            self.inner[node] = True
            node = child
        self.ends[node], self.sizes[x] = x, size

    def _restart(self) -> None:
        self.number.clear()
        self.states.clear()
        self.tokens.clear()
        self.moves.clear()
        self._state(((-1, 0),), -1)

    def _state(self, pairs: tuple[tuple[int, int], ...], token: int) -> int:
        found = self.number.get(pairs)
        if found is None:
            found = self.number[pairs] = len(self.states)
            self.states.append(pairs)
            self.tokens.append(token)
        return found

    def _move(self, state: int, c: int) -> int:
        """Make the transition from ``state`` by letter ``c``."""
        first, follows, children, ends, inner = self.automaton.first, self.automaton.follows, self.children, self.ends, self.inner
        token, pairs = -1, []
        # Earlier starts come first, so equal sets are equal tuples.
        for before, node in self.states[state]:
            child = children.get(node << BITS | c)
            if child is None:
                continue
            x = ends[child]
            # One token fits at most.
            if x >= 0 and token < 0 and (first[x] if before < 0 else follows(before, x)):
                token = x
            if inner[child]:
                pairs.append((before, child))
        if token < 0:
            raise ValueError(f"no tokenization with the letter {c}")
        # After the end of a word nothing is read; the token alone tells such states apart.
        pairs.append((token, -1 if c == LAST else 0))
        if len(self.states) >= STATES:
            self._restart()
            return self._state(tuple(pairs), token)
        found = self.moves[state << BITS | c] = self._state(tuple(pairs), token)
        return found

    def encode(self, letters: str) -> list[int]:
        """Tokens of one pre-split word, given as byte letters."""
        if not letters:
            return []
        moves, tokens, state, n = self.moves, self.tokens, 0, len(letters)
        at = []
        for c in map(ord, letters):
            found = moves.get(state << BITS | c)
            state = self._move(state, c) if found is None else found
            at.append(tokens[state])
        found = moves.get(state << BITS | LAST)
        at[-1] = tokens[self._move(state, LAST) if found is None else found]
        out = []
        while n:
            out.append(at[n - 1])
            n -= self.sizes[at[n - 1]]
        return out[::-1]


class Encoder:
    """Encodes and decodes whole texts with tables that grow while it runs."""

    def __init__(self, automaton: MergeAutomaton, added: dict[str, int], split: str):
        self.words, self.added = WordAutomaton(automaton), added
        self.split = regex.compile(split)
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.marks = {t[0] for t in added}
        self.letters = byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.chunks = Chunks(self)
        self.labels = {**automaton.labels, **{i: t for t, i in added.items()}}

    def word(self, letters: str) -> list[int]:
        return self.words.encode(letters)

    def chunk(self, raw: str) -> bytes:
        """Little-endian 32-bit ids of a text without white space."""
        norm = raw if raw.isascii() or unicodedata.is_normalized("NFC", raw) else unicodedata.normalize("NFC", raw)
        norm = norm.lower() if norm.isascii() else "".join(c.lower() for c in norm)
        found = self.split.findall(norm)
        # A piece that is a whole chunk is kept among the chunks alone.
        return b"".join(self.piece(piece, len(found) > 1 and len(piece) <= 40) for piece in found)

    def piece(self, piece: str, keep: bool) -> bytes:
        """Ids of a pre-split word."""
        found = self.pieces.get(piece)
        if found is None:
            ids = self.word(piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode())))
            found = struct.pack(f"<{len(ids)}I", *ids)
            if keep:
                if len(self.pieces) >= CHUNKS:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if any(m in text for m in self.marks):
            parts = self.added_split.split(text)
            if len(parts) > 1:
                return b"".join(self.added[p].to_bytes(4, "little") if k % 2 else b"".join(map(self.chunks.__getitem__, CHUNK.findall(p))) for k, p in enumerate(parts))
        return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, memoryview(ids).cast("I")))


class Chunks(dict):
    """ids by chunk; long chunks are not kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, raw: str) -> bytes:
        ids = self.encoder.chunk(raw)
        if len(raw) <= 40:
            if len(self) >= CHUNKS:
                self.clear()
            self[raw] = ids
        return ids


@lru_cache(maxsize=2)
def load(path: str) -> tuple[MergeAutomaton, dict[str, int], str]:
    """Compile a tokenizer file: its merges, its added tokens and its splitting pattern."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return MergeAutomaton(spec["model"]["vocab"], merges), {t["content"]: t["id"] for t in spec["added_tokens"]}, pattern


_encoders: list[tuple[object, Encoder]] = []


def encoder_of(compiled: tuple[MergeAutomaton, dict[str, int], str]) -> Encoder:
    """The encoder of this worker process for a broadcast tokenizer; its tables serve all tasks that the process runs."""
    if not _encoders or _encoders[0][0] is not compiled:
        _encoders[:] = [(compiled, Encoder(*compiled))]
    return _encoders[0][1]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, token_ids (binary, unsigned 32-bit little-endian), decoded (string)."""
    compiled = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(compiled.value)
        for batch, texts in pieces(batches, "text"):
            ids = [encoder.encode(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.string())], names=["id", "token_ids", "decoded"])

    return arrow_map(slim, run, f"id {id_type}, token_ids binary, decoded string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode_decode(read(spark, sf_dir, "documents"), default_path())
    return coded.select(F.col("id").alias("doc_id"), (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
