"""Tokenizer files: which tokens may stand side by side, and fast exact ids for byte-level vocabularies."""

from __future__ import annotations

import json
import re
from array import array

# The letters, numbers and white space of U+0000 to U+024F and U+2010 to U+205E, apart from which
# the library itself splits a text into words.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \x85\xa0\u2028\u2029\u202f"
OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e]")
# Fixed value: the contractions that the tokenizer files split off.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_words = re.compile(
    f" ?[{LETTERS}]+|{CONTRACTIONS}| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b if b in set(plain) else 256 + rest.index(b)) for b in range(256)]


def _pair(rule: list[str] | str) -> tuple[str, str]:
    """The two parts of a merge rule, which files write as a list or with a space between."""
    a, b = rule if isinstance(rule, list) else rule.split(" ")
    return a, b


class Merges:
    """The merge rules of a tokenizer file, and the pairs of tokens that may stand side by side.

    Undoing the merges along the touching edges of two tokens gives the symbols that meet there and the span of
    ranks in which each exists; the pair is refused if some rule would have joined two of them while both existed. A
    sequence of tokens of the vocabulary is the encoding of its text if all its pairs are compatible."""

    def __init__(self, model: dict):
        vocab: dict[str, int] = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, (a, b) in enumerate(map(_pair, model["merges"])):
            x, y, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = r
            self.parts[whole], self.born[whole] = (x, y), r
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols that stand at one edge while token is built, each with the rank that ends it."""
        if (token, side) not in self.edges:
            out, ends, t = [], float("inf"), token
            while t is not None:
                out.append((t, ends))
                ends = self.born.get(t, -1)
                t = self.parts[t][side] if t in self.parts else None
            self.edges[token, side] = out
        return self.edges[token, side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging a's and b's symbols side by side yields a, b."""
        got = self.fits.get((a, b))
        if got is None:
            got = True
            for x, x_ends in self._edge(a, 1):
                for y, y_ends in self._edge(b, 0):
                    r = self.rank.get((x, y))
                    # of equal rules the left one is applied first
                    if r is not None and r < x_ends and r <= y_ends:
                        got = False
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[a, b] = got
        return got


class ByteTokens(dict):
    """Encodes texts as the tokenizers library does with a byte-level file; ids as little-endian bytes.

    Each word is encoded once, by a faster library that joins any two neighbours whose bytes make a token, in order of the
    token's rank. That equals applying the merge rules if every token's own bytes merge to it: neighbours that cover such a token
    were formed within it, as they are when it stands alone, so they are the two parts of its rule. Tokens whose bytes
    merge to something else never arise and are left out. Known words are forgotten when they are too many."""

    def __init__(self, path: str, most_words: int = 300_000):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most_words = Tokenizer.from_file(path), most_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [x["content"] for x in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        byte, merged = {c: b for b, c in enumerate(byte_symbols())}, self.tokenizer.model.tokenize
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added and len(merged(t)) == 1}
        # rank and id are the same only if tokens are numbered in order of their rules
        order = [vocab[a + b] for a, b in map(_pair, spec["model"]["merges"]) if a + b in vocab]
        if order != sorted(order):
            raise ValueError(f"{path}: ids are not in order of the merge rules")
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}
        self.joiner = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        got = array("I", self.joiner.encode_ordinary(word)).tobytes()
        if len(word) < 64:
            if len(self) >= self.most_words:
                self.clear()
            self[word] = got
        return got

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if OTHER.search(text) or self.added and self.added.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _words.findall(text)))


_encoders: dict[str, ByteTokens] = {}


def encoder(path: str) -> ByteTokens:
    """A worker's encoder, whose words serve its later tasks too."""
    if path not in _encoders:
        _encoders[path] = ByteTokens(path)
    return _encoders[path]
