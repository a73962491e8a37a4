"""A hierarchical Pitman-Yor language model over words, and the add-one word baseline beside it.

The model's symbols are words in ASCII lower case and an end mark behind the last. The context of a symbol is the word before
it (a start mark before the first). Every context is a restaurant whose customers are the symbols that followed it in the
training part; all share one parent, the restaurant without context, whose base measure is uniform over the V known
symbols and one place for all others, which is the baseline's own measure of an unknown word.

Counting covers the whole training part and the model holds every pair of neighbours of it. Nothing of the model
passes through the driver but sums:

1. ``blocks``: tasks cut what they read into blocks of ``block_tokens`` tokens and count each block's distinct pairs, dealt
   over shards by the context word, and its distinct words, dealt over word shards. Shards grow in number with the text.
   A context that makes up more than half a shard's share of all tokens (judged on a hashed sample, for placement only) is dealt by the pair.
2. ``burn in``: each shard seats its customers, with the words' shares of its own tables as the parent's probabilities,
   and sends the number of tables of each word up.
3. ``parent``: each word shard seats those tables as the parent's customers, and answers shards with the parent's
   discounted customers of each word, blocks with each word's training count.
4. ``sample``: each shard seats its customers again under the parent's probabilities, and averages the predictive
   probabilities over the sweeps after ``burn_in``. It answers every pair of every block, known or not.
5. ``score``: each block adds up the answers of its rows' tokens.

Gibbs sampling: in each sweep all customers of a dish leave and are seated one after the other; a customer opens
a table with probability (strength + discount * tables) * P(dish in the parent) against (customers - discount * tables)
of the dish. The restaurant's other tables are those of the sweep before, so its dishes can be seated together; the parent is
brought up to date once, between the burn-in and the sampling sweeps, as in approximate distributed Gibbs
sampling of topic models. The first 16 customers are seated singly; from there on, in steps of an eighth more, the number of new tables is drawn at
once, with the chance of one halfway through the step. So the steps of a seating grow with the logarithm of its count. Discounts are n1 / (n1 + 2 n2) of
each level's counts. A prediction is linear in the numbers of tables, so averaging these averages the predictions.

A restaurant that is dealt over several shards knows all its customers and dishes exactly; each shard takes the tables of the others to be as
many a dish as its own, so its probabilities add up to one within the sampling error of that; all others' do exactly.

Defined results: a null or empty text is the end token alone; rows with a null id are scored, not learned from,
and count as not held out; repeated rows are learned from and scored each; without training rows all counts are 0 and
model and baseline give every token probability 1, there being one place only; an empty table gives no rows; only the id and text columns
are read, so other columns may have any name. Long texts are read in parts and may span blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import held_out, removed, slices, stored

#: Words are never empty and hold no space, so these stand for the marks.
START, END = b" ", b""
#: Long texts are split into words in parts of about so many bytes.
PART = 1 << 20
_space = re.compile(rb"[ \t-\r]")
#: The bits of a word's hash that the model knows it by; the baseline's counts use all 64. Of ten thousand million words one in
#: 28,000 shares these with another, and its statistics.
MODEL_BITS = np.uint64((1 << 48) - 1)


@dataclass(frozen=True)
class PitmanYor:
    strength: float = 0.5
    burn_in: int = 4
    samples: int = 4
    seed: int = 11
    folds: int = 7
    left_out: int = 2
    block_tokens: int = 1 << 22
    shard_bytes: int = 12 << 20
    least_shards: int = 16
    #: contexts of less than this share of all tokens are never dealt over shards, so that the list of those that are stays bounded
    least_share: float = 1 / 16384


def parts_of(text: str | None) -> Iterator[list[bytes]]:
    """A text's words, in parts."""
    raw = (text or "").encode().lower()
    at = 0
    while at < len(raw):
        end = _space.search(raw, at + PART) if len(raw) - at > PART else None
        upto = end.start() if end else len(raw)
        yield raw[at:upto].split()
        at = upto


def hashed(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_shard_of(word: np.ndarray, shards: int) -> np.ndarray:
    return (mixed((word & MODEL_BITS) + np.uint64(1)) >> np.uint64(20)).astype(np.int64) % shards


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other: the lowest bytes of all numbers, then the next ones, as many as the greatest needs."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu":
            width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
            a = a.astype("<u8")
        else:
            width = a.dtype.itemsize
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize)[:, :width].T
        out += [f"{a.dtype.str} {width} {len(a)} ".encode(), planes.tobytes()]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays; whole numbers come as 64 bits."""
    out, at = [], 0
    while at < len(data):
        head = data[at : at + 32].split(b" ", 3)[:3]
        at += sum(map(len, head)) + 3
        kind, width, n = np.dtype(head[0].decode()), int(head[1]), int(head[2])
        a = np.zeros((n, kind.itemsize), np.uint8)
        a[:, :width] = np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T
        out.append(a.view(kind).ravel() if kind.kind == "f" else a.view("<i8").ravel())
        at += width * n
    return out


def _cut(of: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array."""
    if not len(of):
        return []
    at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist()
    return [(int(of[s]), s, e) for s, e in zip(at, [*at[1:], len(of)])]


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


class Block:
    """Tokens of consecutive rows, and what is made of them."""

    def __init__(self):
        self.places = _Places({START: 0, END: 1})
        self.tokens: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, learned: bool, before: bytes, words: list[bytes], ended: bool) -> None:
        """Words of a row (row, doc_id, held_out), behind the word before."""
        n = len(words) + ended
        ids = np.fromiter(map(self.places.__getitem__, (before, *words, END) if ended else (before, *words)), np.int32, n + 1)
        self.tokens.append(ids)
        self.rows.append((*row, learned, n))
        self.size += n

    def cells(self, shards: int, word_shards: int, hot: np.ndarray, kind: pa.DataType) -> Iterator[tuple[str, int, bytes]]:
        """(kind, shard, bytes): the rows, the pairs of each shard, the words of each word shard."""
        hashes = hashed(self.places)
        self.places.clear()
        n = np.array([r[4] for r in self.rows])
        flat = np.concatenate(self.tokens)
        self.tokens.clear()
        distinct, place = np.unique(neighbours(flat, np.cumsum(n + 1) - n - 1), return_inverse=True)
        count = np.bincount(place[np.repeat([bool(r[3]) for r in self.rows], n)], minlength=len(distinct))
        del place
        context, word = (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)
        shard = context_shards(hashes, shards)
        dealt = np.flatnonzero(np.isin(hashes, hot))
        shard[dealt] = -1
        order, of = pair_order(shard, context, pair_shards(hashes, context, word, shard, shards))
        for s, i, j in _cut(of):
            some = order[i:j]
            yield "pairs", s, pack_pairs(hashes, context[some], word[some], count[some])

        # the start mark is no token
        of = word_shard_of(hashes, word_shards)
        of[0] = -1
        order = np.lexsort((hashes, of))[1:]
        at = np.zeros(len(hashes), np.int64)
        at[order] = np.arange(len(order))
        total = np.bincount(word, count, len(hashes)).astype(np.int64)
        for s, i, j in _cut(of[order]):
            yield "words", s, packed(hashes[order[i:j]], total[order[i:j]])

        rows = pa.table({"row": pa.array([r[0] for r in self.rows], pa.int64()), "doc_id": pa.array([r[1] for r in self.rows], kind), "held_out": pa.array([r[2] for r in self.rows], pa.bool_())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        yield "rows", 0, packed(n, flat, at, shard + 1, pair_shards(hashes, context, word, shard, shards), np.frombuffer(sink.getvalue(), np.uint8))


def neighbours(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Context and word of each token in one number; what stands at a start is a context only."""
    first = np.zeros(len(flat), bool)
    first[starts] = True
    out = flat[:-1].astype(np.uint64)
    out <<= np.uint64(32)
    out |= flat[1:].astype(np.uint64)
    return out[~first[1:]]


def context_shards(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(20)).astype(np.int64) % shards


def pair_shards(hashes: np.ndarray, context: np.ndarray, word: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """The shards of the pairs, in their order, whose context has none."""
    dealt = shard[context] < 0
    return context_shards(mixed(hashes[context[dealt]] + hashes[word[dealt]] * np.uint64(0x9E3779B97F4A7C15)), shards)


def pair_order(shard: np.ndarray, context: np.ndarray, dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs by shard, and their shards in that order."""
    of = shard[context]
    of[of < 0] = dealt
    order = np.argsort(of.astype(np.min_scalar_type(int(of.max(initial=0)))), kind="stable")
    return order, of[order]


def pack_pairs(hashes: np.ndarray, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> bytes:
    """Pairs in order of context: their words' hashes, the runs of contexts, the words, the counts."""
    used = np.zeros(len(hashes), bool)
    used[context] = used[word] = True
    place = np.cumsum(used) - 1
    at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    return packed(hashes[used] & MODEL_BITS, place[context[at]], np.diff(at, append=len(context)), place[word], count)


CELLS = "kind string, block long, shard long, cell binary"


def blocks(docs: DataFrame, how: PitmanYor, shards: int, word_shards: int, hot: np.ndarray) -> DataFrame:
    """Rows (row, doc_id, held_out, learned, text) as cells of blocks, stored by kind."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()
        names = [f.split()[0] for f in CELLS.split(", ")]

        def finished(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal number, block
            out, size = [], 0
            for what, shard, cell in block.cells(shards, word_shards, shared.value, kind):
                out.append((what, number, shard, cell))
                size += len(cell)
                if size > 4 << 20 or what == "rows":
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names)
                    out, size = [], 0
            number, block = number + 1, Block()

        kind = None
        for b in slices(batches):
            kind = b.column(1).type
            for row, doc, held, learned, text in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4)):
                before = START
                for words in parts_of(text.as_py()):
                    if words:
                        block.add((row, doc, held), learned, before, words, False)
                        before = words[-1]
                    if block.size >= how.block_tokens:
                        yield from finished(kind)
                block.add((row, doc, held), learned, before, [], True)
                if block.size >= how.block_tokens:
                    yield from finished(kind)
        if block.rows:
            yield from finished(kind)

    ship(docs.sparkSession)
    return stored(docs.mapInArrow(run, CELLS), "lm-blocks", by="kind")


def seat(customers: np.ndarray, base: np.ndarray, step: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables after seating ``customers`` of each dish; base + step * tables is the weight of a new table."""
    tables = np.minimum(customers, 1).astype(np.int64)
    for i in range(1, 16):
        at = np.flatnonzero(customers > i)
        new = base[at] + step[at] * tables[at]
        tables[at] += draw.random(len(at)) * (i - discount * tables[at] + new) < new
    at, here = np.flatnonzero(customers > 16), 16
    while len(at):
        more = np.minimum(here // 8, customers[at] - here)

        def chance(seated: float | np.ndarray, tables: np.ndarray) -> np.ndarray:
            new = base[at] + step[at] * tables
            return new / (seated - discount * tables + new)

        # the chance halfway, which the tables opened until then have changed
        halfway = tables[at] + more / 2 * chance(here, tables[at])
        tables[at] += draw.binomial(more, np.clip(chance(here + more / 2 - 0.5, halfway), 0, 1))
        here += here // 8
        at = at[customers[at] > here]
    return tables


def discount_of(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


class Shard:
    """The restaurants of the contexts of a shard: dishes are pairs, with 0 customers where they are only asked for."""

    def __init__(self, cells: list[bytes]):
        own = [unpacked(c)[0] for c in cells]
        hashes, place = np.unique(np.concatenate(own).view(np.uint64), return_inverse=True)
        keys, counts, at = [], [], 0
        for c, h in zip(cells, own):
            _, context, runs, word, count = unpacked(c)
            here = place[at : at + len(h)].astype(np.uint64)
            keys.append(np.repeat(here[context], runs) << np.uint64(32) | here[word])
            counts.append(count.astype(np.int32))
            at += len(h)
        self.lengths = [len(k) for k in keys]
        pairs, self.place = np.unique(np.concatenate(keys), return_inverse=True)
        del keys, own, place
        self.counts = np.bincount(self.place, np.concatenate(counts), len(pairs)).astype(np.int64)
        self.place = self.place.astype(np.int32)
        context, self.of = np.unique(pairs >> np.uint64(32), return_inverse=True)
        word, self.word = np.unique(pairs & np.uint64(0xFFFFFFFF), return_inverse=True)
        del pairs
        self.of, self.word = self.of.astype(np.int32), self.word.astype(np.int32)
        self.contexts, self.words = hashes[context.astype(np.int64)], hashes[word.astype(np.int64)]
        self.customers = np.bincount(self.of, self.counts, len(self.contexts))
        self.dishes = np.bincount(self.of, self.counts > 0, len(self.contexts))
        #: all tables of a restaurant for each table here
        self.share = np.ones(len(self.contexts))
        self.tables = np.minimum(self.counts, 1)

    def once_and_twice(self) -> tuple[int, int]:
        return int((self.counts == 1).sum()), int((self.counts == 2).sum())

    def all_tables(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, tables, len(self.contexts)) * self.share

    def reseat(self, below: np.ndarray, discount: float, strength: float, draw: np.random.Generator) -> None:
        """One sweep; ``below`` is the probability of each word in the parent."""
        p = below[self.word]
        others = self.all_tables(self.tables)[self.of] - self.tables
        self.tables = seat(self.counts, (strength + discount * others) * p, discount * p, discount, draw)

    def tables_by_word(self) -> np.ndarray:
        return np.bincount(self.word, self.tables, len(self.words)).astype(np.int64)

    def burn_in(self, how: PitmanYor, draw: np.random.Generator) -> None:
        """Sweeps with the words' shares of the tables here for the parent's probabilities."""
        discount = discount_of(*self.once_and_twice())
        for _ in range(how.burn_in):
            sent = self.tables_by_word()
            self.reseat((sent + 1) / (sent.sum() + len(sent) + 1), discount, how.strength, draw)

    def predictive(self, below: np.ndarray, discount: float, how: PitmanYor, draw: np.random.Generator) -> np.ndarray:
        """The probability of each pair's word after its context, averaged over the sweeps after the burn-in."""
        total = np.zeros(len(self.counts))
        for sweep in range(how.burn_in + how.samples):
            self.reseat(below, discount, how.strength, draw)
            if sweep >= how.burn_in:
                total += self.tables
        tables = total / how.samples
        back = (how.strength + discount * self.all_tables(tables)) / (how.strength + self.customers)
        return (self.counts - discount * tables) / (how.strength + self.customers)[self.of] + back[self.of] * below[self.word]


@dataclass
class Parent:
    """The sums of the restaurant without context: training tokens, known words, customers, and the mass that discounts take."""

    tokens: int
    distinct: int
    customers: int
    mass: float

    def probabilities(self, left: np.ndarray, strength: float) -> np.ndarray:
        """Of words whose customers less discounts are ``left``."""
        return (left + (strength + self.mass) / (self.distinct + 1)) / (strength + self.customers)


def seat_parent(customers: np.ndarray, known: int, shards: int, how: PitmanYor, draw: np.random.Generator) -> np.ndarray:
    """What discounts leave of the customers of each word of a word shard, averaged over the sweeps after the burn-in.

    The whole restaurant is taken to have ``shards`` times the tables and the ``known`` words of this shard."""
    discount = discount_of(int((customers == 1).sum()), int((customers == 2).sum()))
    tables, total = np.minimum(customers, 1), np.zeros(len(customers))
    for sweep in range(how.burn_in + how.samples):
        others = tables.sum() - tables
        base = (how.strength + discount * shards * others) / (shards * known + 1)
        tables = seat(customers, base, np.full(len(customers), discount / (shards * known + 1)), discount, draw)
        if sweep >= how.burn_in:
            total += tables
    return customers - discount * total / how.samples


#: To word shards from shards and blocks (source: the shard, or -1 - block); with a shard's first cell, its sums.
SENT = "source long, shard long, cell binary, ones long, twos long, hot binary"
#: From word shards; with a word shard's first cell, its sums.
TOLD = "source long, shard long, cell binary, tokens long, distinct long, customers long, mass double"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _cells(t: pa.Table) -> list[bytes]:
    return [x.as_py() for x in t["cell"]]


def _by_word_shard(words: np.ndarray, word_shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order in which a shard's words are sent, and the cuts between word shards."""
    of = word_shard_of(words, word_shards)
    order = np.argsort(of, kind="stable")
    return order, _cut(of[order])


def burnt_in(pairs: DataFrame, how: PitmanYor, word_shards: int, hot: np.ndarray) -> DataFrame:
    """What shards send up after their burn-in, stored."""
    shared = pairs.sparkSession.sparkContext.broadcast(hot)

    def run(t: pa.Table) -> pa.Table:
        number = t["shard"][0].as_py()
        shard = Shard(_cells(t))
        shard.burn_in(how, np.random.default_rng([how.seed, 0, number]))
        order, cuts = _by_word_shard(shard.words, word_shards)
        words, sent = shard.words[order], shard.tables_by_word()[order]
        dealt = np.flatnonzero(np.isin(shard.contexts, shared.value & MODEL_BITS))
        tables = np.bincount(shard.of, shard.tables, len(shard.contexts))[dealt]
        sums = [*shard.once_and_twice(), packed(shard.contexts[dealt], shard.customers[dealt].astype(np.int64), shard.dishes[dealt].astype(np.int64), tables.astype(np.int64))]
        rows = [(number, s, packed(words[i:j], sent[i:j]), *(sums if not i else (0, 0, None))) for s, i, j in cuts]
        return pa.table({n: [r[k] for r in rows] for k, n in enumerate(_names(SENT))})

    return stored(pairs.select("shard", "cell").groupBy("shard").applyInArrow(run, SENT), "lm-sent")


def parents(sent: DataFrame, words: DataFrame, how: PitmanYor, word_shards: int) -> DataFrame:
    """The word shards' answers to shards and blocks, stored."""
    asked = sent.select("source", "shard", "cell").union(words.select(-1 - F.col("block"), "shard", "cell"))

    def run(t: pa.Table) -> pa.Table:
        number, source = t["shard"][0].as_py(), t["source"].to_numpy()
        parts, rows, sums = [unpacked(c) for c in _cells(t)], [], [0, 0, 0, 0.0]
        for of_shards in (False, True):
            some = np.flatnonzero((source >= 0) == of_shards).tolist()
            if some:
                distinct, place = np.unique(np.concatenate([parts[i][0] for i in some]), return_inverse=True)
                numbers = np.bincount(place, np.concatenate([parts[i][1] for i in some]), len(distinct)).astype(np.int64)
                if of_shards:
                    told = seat_parent(numbers, sums[1], word_shards, how, np.random.default_rng([how.seed, 1, number])).astype(np.float32)
                    sums[2:] = int(numbers.sum()), float((numbers - told).sum())
                else:
                    told, sums[:2] = numbers, (int(numbers.sum()), int((numbers > 0).sum()))
                ends = np.cumsum([len(parts[i][0]) for i in some])[:-1]
                rows += [(int(source[i]), number, packed(x)) for i, x in zip(some, np.split(told[place], ends))]
        rows = [(*r, *(sums if not i else (0, 0, 0, 0.0))) for i, r in enumerate(rows)]
        return pa.table({n: [r[k] for r in rows] for k, n in enumerate(_names(TOLD))})

    return stored(asked.groupBy("shard").applyInArrow(run, TOLD), "lm-told")


def dealt_contexts(sent: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Of each context that is dealt over shards: all its customers, dishes, and tables after the burn-in."""
    out: dict[int, np.ndarray] = {}
    for r in sent.where("hot IS NOT NULL").select("hot").toLocalIterator():
        hashes, *numbers = unpacked(r.hot)
        for h, *n in zip(hashes.tolist(), *(x.tolist() for x in numbers)):
            out[h] = out.get(h, 0) + np.array(n, np.int64)
    return {h: tuple(n.tolist()) for h, n in out.items()}


def answers(pairs: DataFrame, told: DataFrame, parent: Parent, discount: float, dealt: dict, how: PitmanYor, word_shards: int) -> DataFrame:
    """(block, shard, cell): the log10 probability of each pair of each block, stored."""
    shared = pairs.sparkSession.sparkContext.broadcast(dealt)

    def run(asked: pa.Table, above: pa.Table) -> pa.Table:
        number = asked["shard"][0].as_py()
        shard = Shard(_cells(asked))
        order, _ = _by_word_shard(shard.words, word_shards)
        left = np.empty(len(order))
        left[order] = np.concatenate([unpacked(c)[0] for c in _cells(above.sort_by("shard"))])
        for i in np.flatnonzero(np.isin(shard.contexts, np.array(sorted(shared.value), np.uint64))).tolist():
            customers, dishes, tables = shared.value[int(shard.contexts[i])]
            shard.customers[i] = customers
            if shard.dishes[i]:
                shard.share[i] = dishes / shard.dishes[i]
        p = shard.predictive(parent.probabilities(left, how.strength), discount, how, np.random.default_rng([how.seed, 2, number]))
        logs = np.log10(p).astype(np.float32)[shard.place]
        ends = np.cumsum(shard.lengths)[:-1]
        return pa.table({"block": asked["block"], "shard": asked["shard"], "cell": pa.array([packed(x) for x in np.split(logs, ends)], pa.binary())})

    # every shard has words, so each is answered
    asked = pairs.select("shard", "block", "cell").groupBy("shard")
    above = told.where("source >= 0").select("source", "shard", "cell").groupBy("source")
    return stored(asked.cogroup(above).applyInArrow(run, "block long, shard long, cell binary"), "lm-answers")


def hot_contexts(read: DataFrame, share: float, size: int) -> np.ndarray:
    """Hashes of the words that make up more than a share of the tokens, from a hashed sample of rows; the start mark is one of them."""
    wanted = min(1.0, 6000 / share / max(1, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            flat = [w for text in b.column(0) for words in parts_of(text.as_py()) for w in words] + [START] * len(b)
            keys, n = np.unique(hashed(flat), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys.view(np.int64), [0]])), pa.array(np.concatenate([n, [len(flat)]]))], ["key", "n"])

    some = read.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= F.lit(int(wanted * (1 << 30)))).select("text")
    top = some.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(int(2 / share) + 2).collect()
    total = max((r.n for r in top if r.key == 0), default=0)
    return np.array(sorted(r.key % (1 << 64) for r in top if r.key and r.n > share * total), np.uint64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: PitmanYor = PitmanYor()) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = held_out("doc_id", how.folds, how.left_out)
    rows = read.select(F.monotonically_increasing_id().alias("row"), "doc_id", held.alias("held_out"), (F.col("doc_id").isNotNull() & ~held).alias("learned"), "text")
    size = read.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(how.least_shards, size // how.shard_bytes)
    word_shards = max(how.least_shards, shards // 4)
    hot = hot_contexts(read, max(0.5 / shards, how.least_share), size)
    cells = blocks(rows, how, shards, word_shards, hot)

    cells_at = cells._stored_at

    def of(kind: str) -> DataFrame:
        return cells.where(F.col("kind") == kind)

    sent = burnt_in(of("pairs"), how, word_shards, hot)
    told = parents(sent, of("words"), how, word_shards)
    ones, twos = sent.agg(F.sum("ones"), F.sum("twos")).first()
    sums = told.agg(F.sum("tokens"), F.sum("distinct"), F.sum("customers"), F.sum("mass")).first()
    parent = Parent(*(x or 0 for x in sums))
    dealt = dealt_contexts(sent)
    removed(spark, sent, f"{cells._stored_at}/kind=words")
    cells = spark.read.schema(CELLS).parquet(cells_at)
    logs = answers(of("pairs"), told, parent, discount_of(ones or 0, twos or 0), dealt, how, word_shards)
    removed(spark, f"{cells_at}/kind=pairs")
    schema = T.StructType([T.StructField("row", T.LongType()), read.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, base_score double, score double").fields])

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("shard")
        number = found["shard"].to_numpy()
        got = [unpacked(c)[0] for c in _cells(found)]
        known = np.concatenate([g for g, s in zip(got, number) if s < 0]).astype(np.int64)
        log = np.concatenate([g for g, s in zip(got, number) if s >= 0]).astype(float)
        n, flat, word_at, shard, dealt, table = unpacked(block["cell"][0].as_py())
        t = pa.ipc.open_stream(pa.py_buffer(table.astype(np.uint8).tobytes())).read_all()
        distinct, place = np.unique(neighbours(flat, np.cumsum(n + 1) - n - 1), return_inverse=True)
        order, _ = pair_order(shard - 1, (distinct >> np.uint64(32)).astype(np.int64), dealt)
        log = log[np.argsort(order)][place]
        at = word_at[(distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)][place]
        some = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[some]
        base = np.log10(known + 1.0) - np.log10(parent.tokens + parent.distinct + 1.0)

        def sums(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(n), x.dtype)
            out[some] = np.add.reduceat(x, first)
            return out

        cols = [t["row"], t["doc_id"], t["held_out"], pa.array(n), pa.array(sums((known[at] > 0).astype(np.int64))), pa.array(sums(base[at])), pa.array(sums(log))]
        return pa.table(cols, schema.names)

    # word shards stand in reverse before the shards
    back = told.where("source < 0").select((-1 - F.col("source")).alias("block"), (F.col("shard") - F.lit(1 << 40)).alias("shard"), "cell").union(logs)
    texts = spark.read.schema(CELLS).parquet(cells_at).where("kind = 'rows'").select("block", "cell")
    scored = stored(texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema), "lm-scored")
    removed(spark, told, logs, cells_at)
    whole = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(parent.tokens).cast("long").alias("train_tokens"), "base_score", "score")
