"""Near-duplicate documents: MinHash bands propose, odd sketches and full shingle sets decide.

A document's set holds its distinct shingles of ``words`` words as 64-bit hashes (a shorter text is one shingle as a
whole, a text without words has no set). Documents with equal sets form a class, and only one member of each, the
smallest id, is compared. ``bands`` x ``rows`` MinHash samples give the keys of buckets; documents that meet in a
bucket may be linked. The samples of each document are folded into an odd sketch, a parity bitmap in which each
sample flips one bit, and the population count of two sketches' XOR estimates the similarity; a pair is near if the
estimate lies at most ``margin`` below the threshold. In each bucket the sketches tell which members are near its
smallest, the hub; the others, far ones, are compared with all members. The transitive closure of what is near and
meets parts the representatives into clusters, and no link leaves a cluster, so a passage that many documents share
makes large buckets, but joins no documents that are not alike. Inside a cluster pairs are compared in blocks of
bounded size: each near pair is confirmed on the full sets, unless both ends are joined already.

Large groups. A block holds at most ``block_docs`` documents and ``block_bytes`` of sets. The smallest document of a
cluster goes to each of its blocks, so near copies are joined by one comparison each. What is not joined to
it is compared with all other blocks of its cluster. Tasks return spanning links, never all pairs, and no group
is collected whole. A bucket of more than ``block_docs`` documents with far members is compared by pairs of blocks of
sketches, and its near members with the far ones only. Buckets, clusters and candidates have no caps.

At similarity 0.8 a pair shares no bucket with probability (1 - 0.8^6)^40 = 5e-6; at 0.85 with 6e-9. The margin of 0.2
is over eight standard deviations of the estimate.

Defined results: a null or empty text has no shingles and is linked with nothing; a row with a null id is linked with nothing and kept, its component is null;
rows that share an id are one document, linked through any of their texts; an empty table gives no rows; only
the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import removed, slices, stored, values

#: Up to so many ids (some 50 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Near:
    words: int = 5
    similar_pct: int = 80
    rows: int = 6
    bands: int = 40
    sketch_bits: int = 2048
    margin: float = 0.2
    block_docs: int = 2048
    block_bytes: int = 32 << 20
    seed: int = 7


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, hashes: WordHashes, n: int = 2) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles, or of the whole text if it is shorter."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(n, len(h))
    out = mixed(h[: len(h) - n + 1] + np.uint64(n))
    for i in range(1, n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


class MinHash:
    def __init__(self, how: Near):
        draw = np.random.default_rng(how.seed)
        k = how.rows * how.bands
        self.how = how
        self.a = draw.integers(0, 1 << 32, k, np.uint32) | np.uint32(1)
        self.b = draw.integers(0, 1 << 32, k, np.uint32)
        self.place = draw.integers(1, 1 << 63, k, np.uint64) | np.uint64(1)
        self.band = draw.integers(1, 1 << 63, how.bands, np.uint64)

    def samples(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(out, (x[i : i + 1024, None] * self.a + self.b).min(axis=0), out=out)
        return out

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """The bucket of each band, as one number each."""
        rows = samples.reshape(self.how.bands, self.how.rows).astype(np.uint64)
        key = self.band
        for j in range(self.how.rows):
            key = mixed(key + rows[:, j])
        return key.view(np.int64)

    def sketch(self, samples: np.ndarray) -> bytes:
        """The parity bitmap: each sample flips the bit that its number and value select."""
        bits = mixed(samples.astype(np.uint64) * self.place + self.place) % np.uint64(self.how.sketch_bits)
        return np.packbits(np.bincount(bits.astype(np.int64), minlength=self.how.sketch_bits) & 1).tobytes()


def most_bits(how: Near) -> float:
    """The population count that stands for a similarity of threshold - margin."""
    k, n = how.rows * how.bands, how.sketch_bits
    return n / 2 * (1 - np.exp(-4 * k / n * (1 - how.similar_pct / 100 + how.margin)))


def features(docs: DataFrame, how: Near) -> DataFrame:
    """doc_id, n_shingles, set_key (null without shingles), the bucket keys and the sketch of each row of (doc_id, text)."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_shingles long, set_key binary, keys array<long>, sketch binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = WordHashes(), MinHash(how)
        for b in slices(batches):
            n, key, bands, sketches = [], [], [], []
            for text in values(b.column(1)):
                s = shingles(text, hashes, how.words)
                samples = minhash.samples(s) if len(s) else None
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(minhash.keys(samples) if len(s) else None)
                sketches.append(minhash.sketch(samples) if len(s) else None)
            cols = [pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], schema.names)

    return docs.mapInArrow(run, schema)


def components(links: DataFrame, name: str) -> DataFrame:
    """(id, label): the smallest id reachable by the links (a, b); ids without links to others are left out.

    Large-star and small-star steps alternate until the links no longer change; each round is stored."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        # both sides of each join come straight from tables, so that a hub's rows can be split between tasks
        first = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = stored(both.where("b > a").join(first, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), name)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, stored(small.union(least.select("a", "m")).distinct(), name)
        removed(edges.sparkSession, before, first, large, least)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def similar(a: np.ndarray, b: np.ndarray, pct: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < pct * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= pct * (len(a) + len(b) - both)


def joined(label: np.ndarray, block: np.ndarray | None, sets: list[np.ndarray], sketches: np.ndarray, how: Near) -> list[tuple[int, int]]:
    """Confirmed links that join the rows, which stand in order of id, where ``label`` doesn't join them yet.

    With ``block``, only rows of different blocks are compared. Labels are changed in place."""
    most, size, links = most_bits(how), np.array([len(s) for s in sets]), []
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(rest):
            if block is None and (label == label[0]).all():
                break
            continue
        rest = rest[(100 * np.minimum(size[rest], size[i]) >= how.similar_pct * np.maximum(size[rest], size[i]))]
        if block is not None:
            rest = rest[block[rest] != block[i]]
        rest = rest[np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1, dtype=np.int64) <= most]
        for j in rest.tolist():
            if label[i] != label[j] and similar(sets[i], sets[j], how.similar_pct):
                links.append((i, j))
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return links


def met(far: np.ndarray, block: np.ndarray, sketches: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Near pairs that join rows of a bucket to its far rows; those that are not far count as joined.

    Of rows in two blocks only pairs of different blocks are compared."""
    label, links = np.where(far, np.arange(1, len(far) + 1), 0), []
    crossed = block.min() != block.max()
    for i in np.flatnonzero(far).tolist():
        rest = np.flatnonzero((label != label[i]) & (block != block[i]) if crossed else label != label[i])
        rest = rest[np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1, dtype=np.int64) <= most]
        for j in rest.tolist():
            if label[i] != label[j]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _clusters(t: pa.Table, by: str = "cluster") -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Each cluster of a table, in order of id."""
    t = t.sort_by([(by, "ascending"), ("id", "ascending")])
    ends = np.flatnonzero(np.diff(t[by].to_numpy())) + 1
    for s, e in zip([0, *ends.tolist()], [*ends.tolist(), len(t)]):
        part = t.slice(s, e - s)
        yield part["id"].to_numpy(), part


def _words(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _arrays(part: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    return _words(part["set"]), np.stack(_words(part["sketch"]))


def _limited(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint while its stored rows are few."""
    return F.broadcast(df) if df.count() <= most else df


def proposals(reps: DataFrame, how: Near) -> DataFrame:
    """Pairs (a, b) that join whatever meets in a bucket and is near by the sketches; reps holds id, keys and sketch.

    The hub's sketch is compared with each member's. What is far from its hub is compared with the bucket's other members."""
    buckets = stored(reps.select("id", F.explode("keys").alias("key")), "near-buckets")
    shared = buckets.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count("*").alias("n")).where("hub < top")
    meeting = stored(buckets.join(shared.select("key", "hub", "n"), "key"), "near-meeting")
    removed(reps.sparkSession, buckets)
    most = most_bits(how)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if len(b):
                bits = np.bitwise_count(np.stack(_words(b.column(2))) ^ np.stack(_words(b.column(3)))).sum(axis=1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits > most)], ["id", "hub", "far"])

    sketches = reps.select("id", "sketch")
    hubs = sketches.select(F.col("id").alias("hub"), F.col("sketch").alias("of_hub"))
    pairs = stored(meeting.where("id <> hub").select("id", "hub").distinct(), "near-pairs")
    tested = pairs.join(sketches, "id").join(hubs, "hub").select("id", "hub", "sketch", "of_hub").mapInArrow(compare, "id long, hub long, far boolean")
    # rows that share an id are one document, far only if each text is
    tested = stored(tested.groupBy("id", "hub").agg(F.min("far").alias("far")), "near-tested")
    near = tested.where("NOT far").select(F.col("id").alias("a"), F.col("hub").alias("b"))

    # a bucket of two is settled, and so is one whose members are all near the hub
    marked = meeting.where("n > 2").join(tested, ["id", "hub"], "left").select("key", "id", "n", F.coalesce("far", F.lit(False)).alias("far"))
    marked = stored(marked, "near-marked")
    removed(reps.sparkSession, pairs, meeting)
    loose = stored(marked.groupBy("key").agg(F.bool_or("far").alias("any")).where("any").select("key"), "near-loose-keys")
    if loose.isEmpty():
        return near
    # small buckets share groups of about a block; of a large one all pairs of blocks meet
    marked = marked.join(loose, "key").withColumn("m", F.ceil(F.col("n") / how.block_docs).cast("long"))
    total = marked.where("m = 1").count()
    own = F.pmod(F.xxhash64("id"), F.col("m"))
    every = F.sequence(F.lit(0).cast("long"), F.col("m") - 1)
    met_at = F.transform(every, lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    marked = marked.withColumn("block", own).withColumn("at", F.explode(met_at))
    group = F.when(F.col("m") == 1, F.pmod(F.xxhash64("key"), F.lit(max(1, total // how.block_docs)))).otherwise(F.col("key"))
    placed = marked.withColumn("own", F.col("m") > 1).withColumn("group", group).select("own", "group", "key", "id", "far", "block", "at.i", "at.j")

    def meet(t: pa.Table) -> pa.Table:
        a, b = [], []
        for ids, part in _clusters(t, "key"):
            far = part["far"].to_numpy()
            if far.any():
                for i, j in met(far, part["block"].to_numpy(), np.stack(_words(part["sketch"])), most):
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = placed.join(sketches, "id").groupBy("own", "group", "i", "j").applyInArrow(meet, "a long, b long")
    return near.union(stored(found, "near-met"))


def near_links(docs: DataFrame, how: Near = Near()) -> tuple[DataFrame, DataFrame]:
    """(features, links): of rows (doc_id, text), with a long id, the stored features and links that join what is similar."""
    ship(docs.sparkSession)
    feats = stored(features(docs, how), "near-features")
    known = feats.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    reps = stored(known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("keys", "sketch"), "doc_id").alias("f"), F.count("*").alias("n")).select("set_key", "id", "f.*", "n"), "near-classes")
    maybe = proposals(reps, how)
    members = stored(components(maybe, "near-maybe").withColumnRenamed("label", "cluster"), "near-members")

    schema = T.StructType.fromDDL("cluster long, id long, set binary, sketch binary")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = WordHashes(), MinHash(how)
        for b in slices(batches):
            sets = [shingles(x, hashes, how.words) for x in values(b.column(2))]
            sketches = [minhash.sketch(minhash.samples(s)) for s in sets]
            keep = pa.array([len(s) > 0 for s in sets])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sketches, pa.binary())], schema.names).filter(keep)

    texts = docs.join(_limited(members), docs["doc_id"] == members["id"]).select("cluster", "id", "text")
    sets = stored(texts.mapInArrow(sets_of, schema), "near-sets")

    blocks = F.greatest(F.ceil(F.count("*") / how.block_docs), F.ceil(F.sum(F.octet_length("set")) / how.block_bytes))
    sizes = stored(sets.groupBy("cluster").agg(blocks.cast("long").alias("m"), F.min("id").alias("hub"), F.sum(F.octet_length("set")).alias("bytes"), F.count("*").alias("n")), "near-sizes")
    large = sizes.where("m > 1").select("cluster", "m", "hub")
    some = _limited(large)
    # small clusters share groups of about a block
    total = sizes.where("m = 1").agg(F.sum("bytes"), F.sum("n")).first()
    groups = int(max(1, 2 * (total[0] or 0) // how.block_bytes, 2 * (total[1] or 0) // how.block_docs))
    placed = sets.join(some, "cluster", "left")
    placed = placed.withColumn("block", F.when(F.col("m").isNull(), F.array(-1 - F.pmod(F.xxhash64("cluster"), F.lit(groups)))).when(F.col("id") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("m")))))
    placed = placed.withColumn("block", F.explode("block"))
    owner = F.when(F.col("block") < 0, F.lit(None)).otherwise(F.col("cluster"))
    placed = placed.withColumn("owner", F.coalesce(owner, F.lit(-1).cast("long")))

    rooted = T.StructType.fromDDL("cluster long, id long, root long, block long")

    def within(t: pa.Table) -> pa.Table:
        out = []
        for ids, part in _clusters(t):
            label = np.arange(len(ids))
            # rows that share an id are one document
            label[1:][ids[1:] == ids[:-1]] = 0
            label = np.maximum.accumulate(label) if len(ids) > 1 else label
            joined(label, None, *_arrays(part), how)
            out.append(pa.table({"cluster": part["cluster"], "id": part["id"], "root": ids[label], "block": part["block"]}))
        return pa.concat_tables(out).cast(_arrow(rooted))

    found = stored(placed.select("cluster", "id", "set", "sketch", "block", "owner").groupBy("owner", "block").applyInArrow(within, rooted), "near-rooted")
    links = found.select(F.col("id").alias("a"), F.col("root").alias("b"))
    if large.head(1):
        links = links.union(_across(sets, found, large, how))
    copies = known.select("doc_id", "set_key").join(reps.where("n > 1").select("set_key", "id"), "set_key").where("doc_id <> id")
    return feats, links.union(copies.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64()) for f in schema])


def _across(sets: DataFrame, found: DataFrame, large: DataFrame, how: Near) -> DataFrame:
    """Links between blocks of one cluster: what is not joined to its hub against all other blocks."""
    at = found.join(_limited(large), "cluster").where("block >= 0")
    loose = at.where("root <> hub").groupBy("cluster", "m").agg(F.sort_array(F.collect_set("block")).alias("loose"))
    loose = stored(loose, "near-loose")
    rows = at.where("id <> hub").select("cluster", "id", "root", "block").dropDuplicates().join(_limited(loose), "cluster")
    # a block with loose rows meets every other block; any other meets those with loose rows
    every = F.sequence(F.lit(0).cast("long"), F.col("m") - 1)
    others = F.when(F.array_contains("loose", F.col("block")), every).otherwise(F.col("loose"))
    rows = rows.withColumn("other", F.explode(F.array_except(others, F.array("block"))))
    rows = rows.select("cluster", "id", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    placed = sets.join(rows, ["cluster", "id"])
    schema = T.StructType.fromDDL("a long, b long")

    def between(t: pa.Table) -> pa.Table:
        a, b = [], []
        for ids, part in _clusters(t):
            _, label = np.unique(part["root"].to_numpy(), return_inverse=True)
            for i, j in joined(label, part["block"].to_numpy(), *_arrays(part), how):
                a.append(ids[i])
                b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(placed.groupBy("cluster", "i", "j").applyInArrow(between, schema), "near-across")


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Near = Near()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    feats, links = near_links(_read(docs, id_col, text_col), how)
    labels = components(links, "near-components")
    out = feats.select("doc_id", "n_shingles").join(labels, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Near = Near()) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns.

    Of rows that share an id, which are one document, the one with the least text stays; rows with a null id all do."""
    feats, links = near_links(_read(docs, id_col, text_col), how)
    gone = _limited(stored(components(links, "near-components").where("id <> label").select("id"), "near-gone"))
    kept = docs.join(gone, docs[id_col].cast("long") == gone["id"], "left_anti")
    again = stored(feats.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id")), "near-again")
    if again.isEmpty():
        return kept
    # the rank limit is applied before the shuffle too, so an id of many rows sends one a task
    key = F.col(id_col).cast("long")
    ranks = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    nth = next(n for n in map("nth{}".format, range(len(docs.columns) + 1)) if n not in docs.columns)
    repeated = kept.join(again, key == again["id"], "left_semi").withColumn(nth, F.row_number().over(ranks)).where(F.col(nth) == 1).drop(nth)
    return kept.join(again, key == again["id"], "left_anti").union(repeated)


def oracle_sql(how: Near) -> str:
    """Every pair compared, in DuckDB; for shingles of two words."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {how.similar_pct} * (x.n + y.n - common)),
e AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
