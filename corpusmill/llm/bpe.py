"""BPE encoding and decoding by depth-first traversal of a trie of distinct words.

A BPE encoding is the one sequence of tokens of which each neighbouring pair would be left as it is
if encoded by itself. So the encoding of a word's prefix needs only its last token: the token that
ends there and makes a valid pair with the last token of what stands before it. The distinct words
of a chunk, sorted, are the paths of their trie in depth-first order; a stack holds the last token
of each prefix on the current path, and what two words share is computed once. The symbol that
ends a word carries the end-of-word suffix and closes a path. Text around the words (Unicode
normal form, case, the split into pieces, special tokens) follows the tokenizer file.

Edge cases: null and empty texts have no tokens and decode to an empty text; strings of special
tokens become those tokens; texts of any length are encoded whole; rows are independent, so
repeated rows and an empty table need nothing special. Other columns are carried along by `encode`.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import turn_to

#: Distinct words kept between chunks by one Python worker, and text bytes of a chunk.
KEPT, CHUNK = 700_000, 4 << 20


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


#: Printable ASCII and precomposed Latin letters, but the one whose lower case is two characters.
LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch


class TrieEncoder:
    """The encoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.rank = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normal, self.pieces_of = library.normalizer, library.pre_tokenizer
        self.shown = dict(enumerate(byte_alphabet()))
        self.ascii_piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols_of: dict[str, tuple[str, ...]] = {}
        self.whole: dict[str, bool | None] = dict.fromkeys(self.vocab)  # None: not yet known
        self.pairs: dict[tuple[str, str], bool] = {}
        # the longest token for each ending of three symbols, and of fewer for short tokens
        self.longest: dict[str, int] = {}
        for t in self.vocab:
            n = len(self._symbols(t))
            key = t[-3 - len(self.suffix) :] if t.endswith(self.suffix) and t != self.suffix else t[-3:]
            if n >= 3 and self.longest.get(key, 2) < n:
                self.longest[key] = n
        self.halves: dict[str, tuple[str, str] | None] = {}
        # ids of the tokens of each run of text and of each piece
        self.ids: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _symbols(self, token: str) -> tuple[str, ...]:
        if (s := self.symbols_of.get(token)) is None:
            body = token.removesuffix(self.suffix) if token != self.suffix else token
            s = tuple(body[:-1]) + (body[-1] + self.suffix,) if token != body and body else tuple(token)
            self.symbols_of[token] = s
        return s

    def merge(self, symbols: Iterable[str]) -> list[str]:
        """Plain BPE: the lowest-ranked pair first, from the left. Settles single tokens only."""
        s = list(symbols)
        while len(s) > 1:
            best = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def _is_whole(self, token: str) -> bool:
        """Whether a token is what its own symbols are merged into; notes the two halves of the last merge."""
        if (w := self.whole.get(token, False)) is None:
            s = self._symbols(token)
            w = len(s) == 1
            self.halves[token] = None
            if not w:
                halves = self._two(s)
                if halves and halves in self.rank and halves[0] + halves[1] == token:
                    w, self.halves[token] = True, halves
            self.whole[token] = w
        return w

    def _two(self, symbols: tuple[str, ...]) -> tuple[str, str] | None:
        """The two tokens that are left before the last merge."""
        s = list(symbols)
        while len(s) > 2:
            best = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)))
            if best[0] == 1 << 60:
                return None
            i = best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s[0], s[1]

    def _made(self, token: str) -> int:
        """Rank of the merge that makes a token; -1 for a symbol."""
        halves = self.halves[token] if self._is_whole(token) else None
        return self.rank[halves] if halves else -1

    def _is_pair(self, a: str, b: str) -> bool:
        """Whether two whole tokens stay apart: undo their merges, latest first, and see if one across the gap would have come before."""
        if (p := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            p = self.pairs[a, b] = self._apart(a, b)
        return p

    def _apart(self, a: str, b: str) -> bool:
        # a merge across the gap must come after `limit`: the last merges on both sides that it would have to precede
        limit = 1 << 60
        ra, rb = self._made(a), self._made(b)
        while True:
            if self.rank.get((a, b), limit) < limit:
                return False
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # undo the left one: equal ranks stay with the left, which is merged first
                limit, a = ra, self.halves[a][1]
                ra = self._made(a)
            else:
                limit, b = rb + 1, self.halves[b][0]
                rb = self._made(b)

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, tokens) for distinct words in the byte alphabet, in depth-first order of their trie.

        stack[d] is the last token of the first d symbols and the depth before it.
        """
        stack: list[tuple[str, int]] = [("", 0)]
        before = ""
        suffix, longest, whole, pairs = self.suffix, self.longest, self.whole, self.pairs
        for word in sorted(words):
            size = len(word)
            shared, most = 0, min(len(before), size - 1, len(stack) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del stack[shared + 1 :]
            for depth in range(shared + 1, size + 1):
                end = suffix if depth == size else ""
                most = longest.get(word[depth - 3 : depth] + end, 2) if depth > 3 else depth
                for begin in range(depth - most if depth > most else 0, depth):
                    token = word[begin:depth] + end
                    known = whole.get(token, False)
                    if known is None:
                        known = self._is_whole(token)
                    if known:
                        if begin == 0:
                            break
                        apart = pairs.get((stack[begin][0], token))
                        if apart or (apart is None and self._is_pair(stack[begin][0], token)):
                            break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                if depth < size:
                    stack.append((token, begin))
            out = [token]
            while begin:
                token, begin = stack[begin]
                out.append(token)
            before = word
            yield word, out[::-1]

    def _split(self, word: str) -> list[str]:
        """Pieces, in the byte alphabet, of a run without white space or special tokens."""
        if word.isascii() and word.isalpha():
            return [word.lower()]
        if word.isascii() and word.isprintable():  # these bytes stand for themselves
            return self.ascii_piece.findall(word.lower())
        if LATIN(word):  # composed already, and lowered letter by letter
            return [p.encode().decode("latin-1").translate(self.shown) for p in self.ascii_piece.findall(word.lower())]
        normal = self.normal.normalize_str(word)
        return [p for p, _ in self.pieces_of.pre_tokenize_str(normal)]

    def _parts(self, word: str) -> list[tuple[bool, str]]:
        """(special, piece) in order."""
        if self.cut_special is None or "<" not in word:
            return [(False, p) for p in self._split(word)]
        out = []
        for part in self.cut_special.split(word):
            if part in self.special:
                out.append((True, part))
            else:
                out += [(False, p) for w in self._runs(part) for p in self._split(w)]
        return out

    @staticmethod
    def _runs(text: str) -> list[str]:
        # white space but U+001C to U+001F, which the tokenizer takes as characters
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [w for w in re.split(r"[^\S\x1c-\x1f]+", text) if w]
        return text.split()

    def learn(self, words: Iterable[str]) -> None:
        """Encode the runs that aren't known yet."""
        parts = {w: self._parts(w) for w in words}
        new = {p for x in parts.values() for special, p in x if not special and p not in self.pieces}
        vocab = self.vocab
        for piece, tokens in self.encode_words(new):
            self.pieces[piece] = b"".join([vocab[t].to_bytes(4, "little") for t in tokens])
        for w, x in parts.items():
            if len(x) == 1 and not x[0][0]:
                self.ids[w] = self.pieces[x[0][1]]
            else:
                self.ids[w] = b"".join([self.special[p].to_bytes(4, "little") if special else self.pieces[p] for special, p in x])

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[int, bytes, str]]:
        """(number of tokens, ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        cut = [self._runs(t) for t in texts]
        if len(self.ids) > KEPT:
            self.ids.clear(), self.pieces.clear()
        self.learn(set().union(*cut).difference(self.ids))
        name = self.names.__getitem__
        for c in cut:
            data = b"".join(map(self.ids.__getitem__, c))
            yield len(data) // 4, data, " ".join(map(name, array("I", data)))

    def decode(self, ids: bytes) -> str:
        """Names of the tokens, joined by a space: the file names no decoder."""
        return " ".join(self.names[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4))


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    _ENCODERS.clear()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _groups(texts: list[str | None], chunk: int) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= chunk:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str | None = None, ids: bool = True, digests: bool = True, texts: bool = True) -> DataFrame:
    """The documents (as asked without their text) with n_tokens, and as asked token_ids (array), ids_sha256 and decoded_sha256.

    A column of the input with one of these names gives way to the new one.
    """
    path = path or default_path()
    new = [("n_tokens", T.LongType())]
    new += [("token_ids", T.ArrayType(T.IntegerType()))] * ids
    new += [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] * digests
    docs = docs.drop(*(n for n, _ in new))
    names = docs.columns
    text = names.index("text")
    out = [f for f in docs.schema.fields if texts or f.name != "text"]
    stay = [names.index(f.name) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("bpe", forget)
        bpe = encoder(path)
        was = gc.isenabled()
        gc.disable()  # what is kept has no cycles, and there is much of it
        try:
            for b in batches:
                at = 0
                for group in _groups(b.column(text).to_pylist(), CHUNK):
                    counts, parts, shas, decoded_shas = [], [], [], []
                    for n, data, decoded in bpe.encode_texts(group):
                        counts.append(n)
                        if ids:
                            parts.append(data)
                        if digests:
                            shas.append(hashlib.sha256(data).hexdigest())
                            decoded_shas.append(hashlib.sha256(decoded.encode()).hexdigest())
                    cols = [pa.array(counts, pa.int64())]
                    if ids:
                        ends = np.cumsum([0, *counts], dtype=np.int32)
                        cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32))))
                    if digests:
                        cols += [pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string())]
                    own = b.slice(at, len(group)).columns
                    yield pa.RecordBatch.from_arrays([*(own[i] for i in stay), *cols], names=[*(names[i] for i in stay), *(n for n, _ in new)])
                    at += len(group)
        finally:
            if was:
                gc.enable()

    return docs.mapInArrow(run, T.StructType([*out, *(T.StructField(n, t) for n, t in new)]))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """token_ids decoded into the column decoded; a null array decodes to null."""
    path = path or default_path()
    names = [c for c in encoded.columns if c != "decoded"]
    at = names.index("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path).names
        for b in batches:
            texts = [None if x is None else " ".join([known[i] for i in x]) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    plain = encoded.select(*(F.col(f"`{c}`") for c in names))
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("decoded", T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, ids=False, texts=False)
