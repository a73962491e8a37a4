import random
import re

import pytest

from tidemark.llm import neardup
from tidemark.llm.neardup import Near


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, id int, label string")


def brute(rows, pct=80, n=2):
    """Every pair compared, links closed."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= pct * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


TWO = Near(words=2)


def run(df, how=TWO):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, how=how).collect()}


def corpus(seed=1, n=120, words=60):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            w = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 4, 6])):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(999)}"
        else:
            w = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 5, 8, words, 3 * words]))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(docs(spark, rows)) == brute(rows)


def test_five_words(spark):
    rows = corpus(5) + [(900, "a b c d e f"), (901, "A b c d e f"), (902, "a b c d"), (903, "a b c d"), (904, "a b c")]
    assert run(docs(spark, rows), Near()) == brute(rows, n=5)


def test_chains_and_large_clusters_in_small_blocks(spark):
    # a chain whose ends share little: neighbours are linked, few are linked to the hub
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[2 * i : 2 * i + 100])) for i in range(40)]
    rows += [(100 + i, " ".join([*base[:100], f"tail{i}"])) for i in range(60)]
    expected = brute(rows)
    assert run(docs(spark, rows), Near(words=2, block_docs=8)) == expected
    assert run(docs(spark, rows), Near(words=2, block_bytes=4000)) == expected


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    rows = corpus(3, 60)
    assert run(docs(spark, rows), Near(words=2, block_docs=4)) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A\x0bB"), (8, long), (9, long + " end"), (10, "É é"), (11, "é é"), (12, "a\x1cb")]
    assert run(docs(spark, rows)) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, "x y z"), (3, "p q r"), (4, "p q r")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, rows), how=TWO).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, None, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)], key=str)


def test_empty_table(spark):
    assert neardup.near_duplicates(docs(spark, [])).collect() == []


def test_first_of_each_keeps_columns(spark):
    df = docs(spark, [(2, "a b c d"), (1, "a b c d"), (3, "other words here"), (None, None)])
    got = neardup.first_of_each(df)
    assert got.columns == df.columns and sorted((r.doc_id for r in got.collect()), key=str) == sorted([1, 3, None], key=str)


def test_sketches_estimate_high_similarities():
    import numpy as np

    how = Near()
    minhash, draw = neardup.MinHash(how), np.random.default_rng(0)
    for want in (0.6, 0.8, 0.9, 0.97):
        both = draw.integers(0, 1 << 63, round(1000 * want), np.uint64)
        side = (1000 - len(both)) // 2
        a = np.unique(np.concatenate([both, draw.integers(0, 1 << 63, side, np.uint64)]))
        b = np.unique(np.concatenate([both, draw.integers(0, 1 << 63, side, np.uint64)]))
        x, y = (np.frombuffer(minhash.sketch(minhash.samples(s)), np.uint64) for s in (a, b))
        z, k, n = int(np.bitwise_count(x ^ y).sum()), how.rows * how.bands, how.sketch_bits
        assert abs(1 + n / (4 * k) * np.log(1 - 2 * z / n) - want) < 0.1


def boilerplate(n=240, seed=3):
    """Documents of a passage that all share and words of their own (similarity about 0.4), some of them near copies."""
    rnd = random.Random(seed)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if i % 8 == 7:
            w = rows[rnd.randrange(len(rows))][1].split(" ")
            w[rnd.randrange(len(w))] = f"x{i}"
        else:
            w = shared + [f"o{i}_{j}" for j in range(45)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("block_docs", [8, 2048])
def test_shared_passages_do_not_join_clusters(spark, block_docs):
    rows = boilerplate()
    how = Near(words=2, block_docs=block_docs)
    expected = brute(rows)
    assert run(docs(spark, rows), how) == expected
    reps = neardup.features(docs(spark, rows).select("doc_id", "text"), how).withColumnRenamed("doc_id", "id")
    found = neardup.proposals(reps, how)
    clusters = neardup.components(found, "test").groupBy("label").count().collect()
    # without the sketches the buckets join nearly all documents into one cluster
    buckets, whole = {}, {}
    for r in reps.select("id", "keys").collect():
        mine = {r["id"]}
        for k in r["keys"]:
            mine |= whole.get(buckets.setdefault(k, r["id"]), set())
        for i in mine:
            whole[i] = mine
    assert max(map(len, whole.values())) > len(rows) / 2
    sizes = {}
    for _, root, _ in expected.values():
        sizes[root] = sizes.get(root, 0) + 1
    assert max(r["count"] for r in clusters) <= max(sizes.values())


def test_all_documents_of_a_small_table_against_exact_links(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert run(df) == brute_by_sizes([(r.doc_id, r.text) for r in df.collect()])


def brute_by_sizes(rows, pct=80):
    """``brute`` over more rows: counts common shingles by an inverted index over whole sets."""
    sets = {i: v for i, v in ((i, shingle_set(t)) for i, t in rows)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i in sorted(sets):
        common = {}
        for s in sets[i]:
            for j in where.setdefault(s, []):
                common[j] = common.get(j, 0) + 1
            where[s].append(i)
        for j, n in common.items():
            if 100 * n >= pct * (len(sets[i]) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def shingle_set(t, n=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
