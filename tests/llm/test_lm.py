import math
import random
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import lm
from tidemark.llm.lm import PitmanYor


def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", 0, "k") for r in rows], "doc_id long, text string, lang string, c int, key string")


def corpus(n=200, seed=1):
    rnd = random.Random(seed)
    words = ["the", "Of", "river", "stone", "ünder", "walking", "bright"]
    return [(i, " ".join(rnd.choice(words) + rnd.choice(["", "", "s", f"{rnd.randrange(500)}"]) for _ in range(rnd.randint(0, 60)))) for i in range(n)]


def base(rows):
    """n_tokens, n_known, train_tokens and base_score of each row, in plain Python."""
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, len(w := tokens(t)), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, t in rows]


def check(got, rows):
    want = sorted(base(rows), key=lambda r: (str(r[0]), r[1], round(r[4], 6)))
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=lambda r: (str(r[0]), r[1], round(r[4], 6)))
    assert [r[:4] for r in mine] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in mine], [r[4] for r in want])


ODD = [(1000, None), (1001, ""), (1002, " \t"), (5, "the the of"), (5, "the the of"), (None, "The river unseen"), (1003, "zzz " * 40_000), (1004, "nul\x00byte a\x1cb")]


def test_baseline_and_folds(spark):
    rows = corpus() + ODD
    got = lm.score(docs(spark, rows)).collect()
    check(got, rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.score < 0 and math.isfinite(r.score)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm.score(docs(spark, [(held, "ab c")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert lm.score(docs(spark, [])).collect() == []


def plain_sampler(rows, how, seed):
    """Two levels of Chinese restaurants with every customer seated singly; the averaged log10 score of each row."""
    rnd = random.Random(seed)
    tokens = lambda t: [" ", *(t or "").lower().split(), ""]
    learned = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    pairs = [p for ws in learned for p in zip(ws, ws[1:])]
    v = len({w for _, w in pairs})
    of = lambda c: lm.discount_of(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
    low, top = of(Counter(pairs)), of(Counter(w for _, w in set(pairs)))
    rooms, theta = {}, how.strength

    def room(c):
        return rooms.setdefault(c, {})

    def p(context, w):
        d, below = (top, 1 / (v + 1)) if context is None else (low, p(None, w))
        r = room(context)
        n, t = sum(map(sum, r.values())), sum(map(len, r.values()))
        here = r.get(w, [])
        return (sum(here) - d * len(here) + (theta + d * t) * below) / (theta + n)

    def add(context, w):
        d, below = (top, 1 / (v + 1)) if context is None else (low, p(None, w))
        r = room(context)
        here, t = r.setdefault(w, []), sum(map(len, r.values()))
        weights = [x - d for x in here] + [(theta + d * t) * below]
        k = rnd.choices(range(len(weights)), weights)[0]
        if k < len(here):
            here[k] += 1
        else:
            here.append(1)
            if context is not None:
                add(None, w)

    def drop(context, w):
        here = room(context)[w]
        k = rnd.choices(range(len(here)), here)[0]
        here[k] -= 1
        if not here[k]:
            del here[k]
            if context is not None:
                drop(None, w)

    for c, w in pairs:
        add(c, w)
    asked = sorted({q for _, t in rows for q in zip(tokens(t), tokens(t)[1:])})
    total = dict.fromkeys(asked, 0.0)
    for sweep in range(6 + 6):
        for c, w in pairs:
            drop(c, w)
            add(c, w)
        if sweep >= 6:
            for q in asked:
                total[q] += p(*q) / 6
    return {i: sum(math.log10(total[q]) for q in zip(tokens(t), tokens(t)[1:])) for i, t in rows}


def small(n=70, seed=3):
    """Words that follow one another: each but every fifth is drawn from the two successors of the one before."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        ws = [rnd.choice(words)]
        while len(ws) < 25:
            at = words.index(ws[-1])
            ws.append(rnd.choice(words) if rnd.random() < 0.2 else words[(at * 7 + rnd.randrange(2)) % 30])
        rows.append((i, " ".join(ws)))
    return rows


def test_scores_as_a_plain_sampler(spark):
    rows = small() + [(900, "w1 new w2"), (901, "")]
    mine = {r.doc_id: r.score for r in lm.score(docs(spark, rows)).collect()}
    want, other = plain_sampler(rows, PitmanYor(), 1), plain_sampler(rows, PitmanYor(), 2)
    n = np.array([len(t.split()) + 1 for _, t in rows])
    diff = lambda a, b: np.abs(np.array([a[i] - b[i] for i, _ in rows]) / n).mean()
    # two chains of the plain sampler differ too
    assert diff(mine, want) < 0.02 + 2 * diff(want, other)


def test_word_order_is_learned(spark):
    rows = small(400, 5)
    got = [r for r in lm.score(docs(spark, rows)).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in got)
    assert (sum(r.score for r in got) - sum(r.base_score for r in got)) / tokens > 0.35


def test_documents_that_occur_twice_score_apart(spark):
    rnd = random.Random(9)
    odd = lambda: " ".join(f"{rnd.choice('bcdfgh')}{rnd.randrange(10**6)}" for _ in range(60))
    held = [i for i in range(4000, 6000) if zlib.crc32(str(i).encode()) % 7 == 2][:40]
    learned = [i for i in range(6000, 8000) if zlib.crc32(str(i).encode()) % 7 != 2][:20]
    texts = [odd() for _ in held]
    rows = corpus() + list(zip(held, texts)) + list(zip(learned, texts))
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(docs(spark, rows)).collect()}
    assert min(got[i] for i in held[:20]) > max(got[i] for i in held[20:]) + 1


def test_placement_does_not_matter(spark):
    """Blocks, shards and dealt contexts change the draws, not the model; the baseline not at all."""
    rows = corpus(300, 4) + ODD
    results = {}
    for name, how in {"one": PitmanYor(least_shards=1), "many": PitmanYor(least_shards=40, block_tokens=700), "all dealt": PitmanYor(least_shards=5, least_share=1e-9)}.items():
        got = lm.score(docs(spark, rows), how=how).collect()
        check(got, rows)
        results[name] = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score / r.n_tokens for r in got}
    for name in ("many", "all dealt"):
        diff = [abs(results["one"][k] - results[name][k]) for k in results["one"]]
        assert np.mean(diff) < 0.06 and len(diff) > 290


def shards_of(texts, how, number, hot=()):
    b = lm.Block()
    for i, t in enumerate(texts):
        before = lm.START
        for ws in lm.parts_of(t):
            b.add((i, i, False), True, before, ws, False)
            before = ws[-1]
        b.add((i, i, False), True, before, [], True)
    return [c for kind, _, c in b.cells(number, 3, lm.hashed(hot), lm.pa.int64()) if kind == "pairs"]


def test_probabilities_sum_to_one():
    how, texts = PitmanYor(), [t for _, t in corpus(80)]
    words = sorted({w for t in texts for ws in lm.parts_of(t) for w in ws} | {lm.END})
    # held-out pairs: every known word after "the"
    (cell,) = shards_of([*texts, *(f"the {w.decode()}" for w in words if w)], how, 1)
    shard = lm.Shard([cell])
    below = np.random.default_rng(1).random(len(shard.words))
    below /= below.sum() * 1.25
    p = shard.predictive(below, 0.6, how, np.random.default_rng(2))
    (the,) = np.flatnonzero(shard.contexts == (lm.hashed([b"the"]) & lm.MODEL_BITS)[0])
    some = shard.of == the
    asked = below[shard.word[some]].sum()
    assert asked > 0.79
    # what is not asked for has its share of the parent's probability
    assert 0 < 1 - p[some].sum() < 0.21


def test_parent_sums_to_one():
    how, draw = PitmanYor(), np.random.default_rng(4)
    customers = draw.integers(1, 60, 500)
    left = lm.seat_parent(customers, 500, 1, how, draw)
    parent = lm.Parent(10_000, 500, int(customers.sum()), float((customers - left).sum()))
    p = parent.probabilities(np.append(left, 0.0), how.strength)
    assert math.isclose(p.sum(), 1, rel_tol=1e-9) and (left < customers).all()


def test_cells_round_trip():
    arrays = [np.array([0, 1, 300, 1 << 40]), np.empty(0, np.int64), np.array([1.5, -2.0], np.float32), np.array([(1 << 64) - 1, 5], np.uint64)]
    back = lm.unpacked(lm.packed(*arrays))
    assert [a.tolist() for a in back[:3]] == [a.tolist() for a in arrays[:3]] and back[3].view(np.uint64).tolist() == arrays[3].tolist()


def test_hot_contexts_are_found(spark):
    rows = [(i, "a b a c a d") for i in range(300)]
    hot = lm.hot_contexts(docs(spark, rows).select("doc_id", "text"), 0.3, 300 * 11)
    assert hot.tolist() == lm.hashed([b"a"]).tolist()


def test_seating_as_one_by_one():
    draw = np.random.default_rng(1)
    discount, customers, base_weight, step = 0.4, 60, 1.2, 0.1
    fast = lm.seat(np.full(20_000, customers), np.full(20_000, base_weight), np.full(20_000, step), discount, draw)
    slow = []
    for _ in range(4000):
        t = 1
        for i in range(1, customers):
            new = base_weight + step * t
            t += draw.random() * (i - discount * t + new) < new
        slow.append(t)
    assert abs(fast.mean() - np.mean(slow)) < 0.1 and abs(fast.std() - np.std(slow)) < 0.15
    assert lm.seat(np.array([0, 1, 10**9]), np.ones(3), np.zeros(3), 0.5, draw)[:2].tolist() == [0, 1]


def test_long_texts_are_split_alike(monkeypatch):
    text = "some words that are\tcut\x0b into  parts " * 20
    whole = [w for ws in lm.parts_of(text) for w in ws]
    monkeypatch.setattr(lm, "PART", 17)
    assert [w for ws in lm.parts_of(text) for w in ws] == whole == text.encode().split()


def test_sweeps_are_not_cut_for_the_limits():
    how = PitmanYor()
    assert (how.burn_in, how.samples) == (4, 4)


def test_many_tables_as_one_by_one():
    draw = np.random.default_rng(5)
    fast, slow = lm.seat(np.full(4000, 2000), np.full(4000, 20.0), np.full(4000, 0.5), 0.9, draw), np.ones(4000)
    for i in range(1, 2000):
        new = 20 + 0.5 * slow
        slow += draw.random(4000) * (i - 0.9 * slow + new) < new
    assert abs(fast.mean() / slow.mean() - 1) < 0.04
