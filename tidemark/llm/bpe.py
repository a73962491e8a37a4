"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that can end its encoding. An automaton over the
vocabulary reports all tokens that are suffixes of a prefix; the one that is kept is the one that may follow
the last token of the shorter prefix it leaves. Whether two tokens may stand side by side is a matter of the
pair alone: undoing the merges along the touching edges gives the symbols that meet there and the span of
merge ranks in which each exists, and the pair is refused if some rule would have joined two of them while
both existed. Following the back-pointers from the whole word gives the exact ids.

Normalising, splitting into words and the special tokens follow the tokenizer file (NFC, white-space runs to
one space, lower case; special tokens are found in the raw text). Texts that consist of common Latin characters, before and after lower-casing,
are split by an equivalent pattern here; any other text is normalised and split by the library's own parts. Where special
tokens overlap, the first in the text wins, then the longest; files whose special tokens strip spaces, match whole
words only or are sought in the normalised text are refused.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows are encoded alike;
an empty table gives an empty table; only the id and text columns are read, so other columns may have any
name. Work is per row, without a shuffle; memory is one Arrow batch and a word cache of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import slices, values
from .tokens import CONTRACTIONS, LETTERS, NUMBERS, OTHER, SPACE, Merges, byte_symbols

_words = re.compile(f"[{LETTERS}]+|{CONTRACTIONS}|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")
#: Added to the last symbol of a word, in place of the suffix that marks it in the file.
LAST = 0x1000


class PrefixBpe:
    """The encoder of one tokenizer file."""

    def __init__(self, path: str, most_words: int = 300_000):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        if any(x.get(flag) for x in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: special tokens with flags are not supported")
        self.added = {x["content"]: x["id"] for x in sorted(spec["added_tokens"], key=lambda x: -len(x["content"]))}
        self.names |= {i: t for t, i in self.added.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.bytes = dict(enumerate(byte_symbols()))
        self.automaton = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        for t, i in vocab.items():
            symbols = self._symbols(t)
            self.automaton.add_word(symbols, i)
            self.length[i] = len(symbols)
        self.automaton.make_automaton()
        self.merges = Merges(spec["model"])
        self.most_words = most_words
        self.known = _Words(self)

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + LAST)
        return token

    def word(self, symbols: str) -> list[int]:
        """The ids of one word, given as byte symbols, the last one marked."""
        n = len(symbols)
        last = [-1] * (n + 1)
        length, fits, compatible = self.length, self.merges.fits, self.merges.compatible
        for at, token in self.automaton.iter(symbols):
            if last[at + 1] < 0:
                before = at + 1 - length[token]
                if before:
                    left = last[before]
                    if left < 0:
                        continue
                    ok = fits.get((left, token))
                    if not (compatible(left, token) if ok is None else ok):
                        continue
                last[at + 1] = token
        out, i = [], n
        while i:
            out.append(last[i])
            i -= length[last[i]]
        return out[::-1]

    def mapped(self, word: str) -> list[int]:
        """The ids of a word whose bytes are already symbols."""
        return self.word(word[:-1] + chr(ord(word[-1]) + LAST) if self.suffix else word)

    def raw(self, word: str) -> list[int]:
        return self.mapped(word.encode().decode("latin-1").translate(self.bytes))

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is a special token, text) in order."""
        if self.specials is None or not self.specials.search(text):
            yield False, text
            return
        for i, part in enumerate(self.specials.split(text)):
            if part:
                yield i % 2 == 1, part

    def strings(self, text: str) -> tuple[list[str], list[str]]:
        """The ids and the decoded tokens of each word in turn, as texts joined by a space."""
        ids: list[str] = []
        out: list[str] = []
        for special, part in self.segments(text):
            if special:
                ids.append(str(self.added[part]))
                out.append(part)
            elif not part.isascii() and (OTHER.search(part) or OTHER.search(part.lower())):
                norm = self.library.normalizer.normalize_str(part)
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(norm):
                    got = self.mapped(piece)
                    ids.append(" ".join(map(str, got)))
                    out.append(self.decode(got))
            else:
                for i, d in map(self.known.__getitem__, _words.findall(part.lower())):
                    ids.append(i)
                    out.append(d)
        return ids, out

    def encode(self, text: str) -> list[int]:
        return [int(i) for s in self.strings(text)[0] for i in s.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space."""
        return " ".join([self.names[i] for i in ids])


class _Words(dict):
    """The ids and decoded tokens of each word, as texts; emptied when it is full."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[str, str]:
        ids = self.bpe.raw(word)
        got = " ".join(map(str, ids)), self.bpe.decode(ids)
        if len(word) < 64:
            if len(self) >= self.bpe.most_words:
                self.clear()
            self[word] = got
        return got


_encoders: dict[str, PrefixBpe] = {}


def encoder(path: str) -> PrefixBpe:
    """A worker's encoder, whose words serve its later tasks too."""
    if path not in _encoders:
        _encoders[path] = PrefixBpe(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, digests of ids and of the decoded text, and (with_ids) both in full."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([read.schema["doc_id"], *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for b in slices(batches):
            rows = []
            for text in values(b.column(1)):
                ids, out = bpe.strings(text or "")
                joined, decoded = " ".join(ids), " ".join(out)
                row = (joined.count(" ") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, [int(i) for i in joined.split()], decoded) if with_ids else row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            cols = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(schema) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], schema.names)

    ship(docs.sparkSession)
    return read.mapInArrow(run, schema)
