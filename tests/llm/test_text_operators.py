"""Line rules, BPE, packing, language and quality against brute force, the library, or held-out rows."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import bpe, langid, lines, packing, quality, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", "é", "É", "İ", "Σ", "ς", "'s", "'ll", "'", "1", "²", "½", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "中", "한", "😀", "<|endoftext|>", "<|startoftext|>", "é", "ﬁ", "!!", "don't", "THE", "\x00", "​", "ẞ", "Ⅷ", "-"]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def docs(spark, rows):
    # names that the operators use themselves
    return spark.createDataFrame([(*r, "en", "s", 0, "q") for r in rows], "doc_id long, text string, lang string, source string, n_tokens int, row string")


ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one word"), (4, "one word"), (None, "no id here. " * 20), (5, "long " * 50_000)]


# lines


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(tri)
    repeated = {i + j for i, t in enumerate(tri) if often[t] > 1 for j in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_line_counts_as_brute_force():
    rnd = random.Random(4)
    for _ in range(400):
        text = "".join(rnd.choice(["a ", "b ", "c", "\n", " ", "#", "|", "x y z ", "\x0b", "\x1c", "é."]) for _ in range(rnd.randint(0, 90)))
        got = lines.analyse(text, lines.Rules())
        assert got[:5] == plain_counts(text)
        assert got[5] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (got[5] and got[6])


def test_failing_lines():
    fails = lambda s: lines.line_fails(s, len(s.split()), lines.Rules())
    for s in ("Home | About | Contact | Help", "Menu", "LIKE!! THIS!! ONE!!", "this*** has### many$$$ symbols", "12 345 6789 10 11", "Licensed under the Apache License, Version 2.0.", "All RIGHTS reserved by someone in the end."):
        assert fails(s), s
    for s in ("A plain sentence of words.", "Yes.", "Some words | and one bar in a long line of words", "What a day!"):
        assert not fails(s), s


def test_sentence_ends_of_other_scripts():
    for line in ("\u201cYes, of course.\u201d", "\u4f60\u597d\u3002", "Oui \u00bb", "Well\u2026 \t"):
        assert not lines.line_fails(line, len(line.split()), lines.Rules())
    assert lines.line_fails("Home page", 2, lines.Rules())


def test_documents_that_lose_too_much_go(spark):
    good = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) + "." for i in range(12))
    nav = "\n".join("Home | News | Sport %d | Help" % i for i in range(60))
    df = docs(spark, [(1, good), (2, good + "\nHome | News | About | Help"), (3, good + "\n" + nav), *ROWS])
    got = {(r.doc_id, r.n_words): r for r in lines.line_verdicts(df).collect()}
    kept = {k[0] for k, r in got.items() if r.kept}
    assert kept == {1, 2}
    out = lines.clean_documents(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: good, 2: good}
    assert lines.line_verdicts(docs(spark, [])).collect() == []


# BPE


def test_words_as_the_library():
    b = bpe.PrefixBpe(WORD)
    rnd = random.Random(2)
    pieces = [t.removesuffix("</w>") for t in list(b.names.values())[600:9000] if t.isascii() and t.removesuffix("</w>").isalpha()]
    texts = odd_texts(4000) + [" ".join("".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 4))) for _ in range(8)) for _ in range(800)] + ["a" * 3000, "ab" * 900, "!" * 700]
    for text in texts:
        want = b.library.encode(text, add_special_tokens=False).ids
        ids, out = b.strings(text)
        assert b.encode(text) == want, text
        assert " ".join(out) == b.decode(want) == b.library.decode(want, skip_special_tokens=False)


#: the range that is split without the library
COMMON = [chr(c) for c in [*range(0x250), *range(0x2010, 0x205F)]]


@pytest.mark.parametrize("file", [WORD, BYTE])
def test_every_common_character_as_the_library(file):
    rnd = random.Random(4)
    texts = [t for c in COMMON for t in (c, f"a{c}b", f"{c}1 x{c}", f"'{c}s", c + c)] + ["\u0181an \u0181auchi", "\u018fli \u018fh\u0259dov", "\u212a\u212b", "I\u0307 \u0130x"]
    texts += ["".join(rnd.choice(COMMON) for _ in range(rnd.randint(1, 12))) for _ in range(20_000)]
    if file == WORD:
        enc = bpe.PrefixBpe(WORD)
        wanted = enc.library.encode_batch(texts, add_special_tokens=False)
        for text, want in zip(texts, wanted):
            assert enc.encode(text) == want.ids, text
    else:
        enc = tokens.ByteTokens(BYTE)
        for text, want in zip(texts, enc.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == want.ids, text


def test_special_tokens_with_flags_are_refused(tmp_path):
    spec = json.loads(open(WORD, encoding="utf-8").read())
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.PrefixBpe(str(tmp_path / "t.json"))


def test_encoded_documents(spark):
    rows = ROWS + [(10 + i, t) for i, t in enumerate(odd_texts(60, 3))]
    library = bpe.PrefixBpe(WORD).library
    got = sorted(bpe.encode_documents(docs(spark, rows), WORD).collect(), key=str)
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert bpe.encode_documents(docs(spark, []), WORD).collect() == []


# packing


def test_byte_tokens_as_the_library():
    enc = tokens.ByteTokens(BYTE, most_words=50)
    for text in odd_texts(4000, 5):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_every_token_and_random_words_as_the_library():
    enc = tokens.ByteTokens(BYTE)
    rnd = random.Random(8)
    names = [t.replace("Ġ", " ") for t in enc.tokenizer.get_vocab() if t.replace("Ġ", "").isascii()]
    texts = names + ["".join(rnd.choice(names) for _ in range(rnd.randint(2, 6))) for _ in range(20_000)]
    for text, want in zip(texts, enc.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want.ids, text


def test_differencing_balances():
    sums, bins = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(i for b in bins for i in b) == list(range(5)) and max(sums) - min(sums) == 2
    rnd = random.Random(1)
    for _ in range(20):
        sizes = [rnd.randint(1, 700) for _ in range(rnd.randint(1, 150))]
        got = packing.windows(sizes, 2048)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in b) for b in got) <= 2048
        assert len(got) <= sum(sizes) // 2048 + 2
    assert packing.windows([2048, 2048, 1], 2048) and packing.windows([], 2048) == []


def test_packed_pieces(spark):
    enc = tokens.ByteTokens(BYTE)
    rnd = random.Random(3)
    rows = ROWS + [(100 + i, " ".join(rnd.choice(["alpha", "Beta", "x1", "öl", "…"]) for _ in range(rnd.randint(0, 3000)))) for i in range(300)]
    got = packing.pack(docs(spark, rows).coalesce(2), BYTE, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(np.frombuffer(enc.whole(t or ""), "<u4").tolist() + [1])
    for i, want in texts.items():
        pieces = by_doc[i]
        assert all(p.doc_tokens == len(want[0]) for p in pieces) and sum(p.length for p in pieces) == len(want) * len(want[0])
        for p in pieces:
            assert p.ids == want[0][p.start : p.start + p.length]
        starts = Counter(p.start for p in pieces)
        assert set(starts.values()) == {len(want)}
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    used = sum(r.length for r in got)
    assert used / (2048 * len(by_seq)) > 0.96
    assert packing.pack(docs(spark, []), BYTE).collect() == []


# language


SYLLABLES = {"xx": ["ka", "to", "mi", "ra"], "yy": ["sch", "ung", "ein", "ber"], "zz": ["ção", "lh", "inh", "ões"]}


def language_rows(n, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(3, 40))), lang if rnd.random() < 0.8 else None, lang))
    return out


def test_language_of_held_out_rows(spark):
    rows = language_rows(400)
    truth = {r[0]: r[3] for r in rows}
    extra = [(1000, None, "xx", ""), (1001, "", "yy", ""), (1002, "123 !!! \n", "zz", ""), (None, "ka to mi ra", "zz", ""), (5, rows[5][1], rows[5][2], "")]
    df = spark.createDataFrame([(*r[:3], "clash", 1.0) for r in rows + extra], "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.train(df)
    assert model.languages == ["xx", "yy", "zz"]
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id >= 1000:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is None:
            assert r.lang_pred == "xx" and not r.held_out
        else:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]
    assert sum(right) >= 0.98 * len(right)
    kept = langid.known_language(df, model)
    assert kept.columns == df.columns and kept.count() == len(rows) + 2


def test_labels_of_the_left_out_fold_are_not_learned(spark):
    rows = [(i, "ka to mi", "held" if zlib.crc32(str(i).encode()) % 4 == 2 else "seen") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["seen"]


def test_ngrams_of_texts_longer_than_a_block(monkeypatch):
    rnd = random.Random(8)
    text = "".join(rnd.choice("abc éß, \n京😀") for _ in range(1000))
    sizes = (1 << 10, 1 << 12, 1 << 14, 1 << 15)
    whole = langid.ngrams(text, sizes)
    for block in (1, 2, 7, 100, 999, 1000):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert all(np.array_equal(a, b) for a, b in zip(whole, langid.ngrams(text, sizes)))
    # only the last block holds a letter
    assert langid.ngrams("1" * 999 + "a", sizes) is not None and langid.ngrams("1" * 1000, sizes) is None


def test_tied_languages_take_the_first_name(spark):
    # the same text under two languages: neither outweighs the other
    rows = [(i, "ka to mi ra", lang) for i, lang in enumerate(["yy", "xx"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    model.weights = [np.repeat(w[:, :1], 2, axis=1) for w in model.weights]
    long = spark.createDataFrame([(1, "ka to mi ra " * 100_000), (2, "ka to mi ra"), (2, "ka to mi ra")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langid.predict(long, model).collect()} == {("xx", 0.5)}


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "ka to", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.predict(df, langid.train(df)).collect()] == [("und", 0.0)]
    assert langid.predict(df.limit(0), langid.train(df.limit(0))).collect() == []


def test_weights_are_the_kernel_regression():
    kernel = langid.Kernel(sizes=(64, 128, 256), landmarks=12)
    sample = [(r[3], langid.ngrams(r[1], kernel.sizes)) for r in language_rows(30, 2)]
    model = langid.fit(sample, kernel)

    def k(x, y):
        return sum(w * len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for w, a, b in zip(kernel.weights, x, y) if len(a) and len(b))

    by = {c: [g for x, g in sample if x == c] for c in model.languages}
    marks = [by[c][i] for i in range(30) for c in model.languages if i < len(by[c])][:12]
    kmm = np.array([[k(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(kmm)
    root = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T
    z = np.array([[k(g, b) for b in marks] for _, g in sample]) @ root
    y = np.array([[1 if x == c else -1 for c in model.languages] for x, _ in sample])
    w = np.linalg.solve(z.T @ z + kernel.ridge * len(sample) * np.eye(12), z.T @ y)
    x = langid.ngrams("ka tosch mi", kernel.sizes)
    direct = np.array([k(x, b) for b in marks]) @ root @ w
    primal = sum(m[g].sum(axis=0) / np.sqrt(len(g)) for m, g in zip(model.weights, x))
    assert np.allclose(direct, primal, atol=1e-3)


# quality


def quality_rows(n, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [rnd.choice(["plain", "words", "of", "good", "text"]) + str(rnd.randrange(99)) for _ in range(rnd.randint(20, 200))]
        bad = rnd.random() < 0.3
        out.append((i, " ".join(w.upper() + "!!" if bad and rnd.random() < 0.8 else w for w in words) + ".", 0 if bad else 1))
    return out


def test_quality_of_held_out_rows(spark):
    rows = quality_rows(300)
    df = docs(spark, [r[:2] for r in rows] + ROWS[:3] + [(None, "no id")])
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows if r[0] % 2] + [(None, 1, 0), (7, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {r[0]: r[2] for r in rows if r[0] > 5}
    held = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]
    assert sum(held) >= 0.97 * len(held)
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_discriminant_is_the_density_ratio():
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(0, 1, (80, 3)), draw.normal(1.5, 2, (120, 3))])
    y = np.repeat([0, 1], [80, 120])
    how = quality.Discriminant(to_pooled=0, to_round=0)
    model = quality.fit(x, y, how)

    def log_density(v, g):
        m, c = g.mean(axis=0), np.cov(g.T, bias=True) + 1e-9 * np.eye(3)
        return -0.5 * ((v - m) @ np.linalg.solve(c, v - m) + np.linalg.slogdet(c)[1])

    want = [1 / (1 + np.exp(-(np.log(120 / 80) + log_density(v, x[y == 1]) - log_density(v, x[y == 0])))) for v in x]
    assert np.allclose(model.scores(x), want)


def test_shrunk_discriminant_is_the_density_ratio_of_the_shrunk_covariances():
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(0, 1, (70, 4)) * [1, 2, 3, 4], draw.normal(1, 2, (50, 4))])
    y = np.repeat([0, 1], [70, 50])
    how = quality.Discriminant()
    assert how.to_pooled and how.to_round
    model = quality.fit(x, y, how)
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (70 * own[0] + 50 * own[1]) / 120

    def log_density(v, c):
        cov = own[c] + how.to_pooled * (pooled - own[c])
        cov = cov + how.to_round * (np.eye(4) * np.mean(np.diag(cov)) - cov)
        d = v - x[y == c].mean(axis=0)
        return -0.5 * (d @ np.linalg.inv(cov) @ d + np.linalg.slogdet(cov)[1])

    want = [1 / (1 + (70 / 50) * np.exp(log_density(v, 0) - log_density(v, 1))) for v in x]
    assert np.allclose(model.scores(x), want, atol=1e-6)


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a a a", "AB 12 #$!\n\nAB 12 #$!\n x|y, http://z. é", "É\x0bx\u3000y <b>&amp;</b> 100%*", "w " * 30_000])
def test_statistics_as_brute_force(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]

    def count(pattern):
        return len(re.findall(pattern, raw))

    rates = [count(rb"[A-Z]") / 6, count(rb"[0-9]"), count(rb"[#*$%&<>]"), count(rb"!"), count(rb"[|]"), count(rb"[.]"), count(rb","), len(lines)]
    rates += [sum(x in lines[:i] for i, x in enumerate(lines)), len(words) - len(set(words)), count(rb"http"), len(raw) / 6]
    want = [np.log1p(len(words)) / 4] + [np.log((r + 0.4) / (len(words) + 20)) for r in rates]
    assert np.allclose(quality.statistics(text, 20.0), want)


def test_quality_of_odd_rows(spark):
    rows = quality_rows(200)
    long = "good text of plain words, " * 60_000
    extra = [(1000, long), (1001, long), (5, rows[5][1]), (5, rows[5][1])]
    made = [(i, t, 1, 0.5, True) for i, t in [r[:2] for r in rows] + extra]
    df = spark.createDataFrame(made, "doc_id long, text string, predicted int, score double, held_out boolean")
    labels = spark.createDataFrame([(r[0], r[2], "t") for r in rows + rows[:9]], "doc_id long, quality int, text string")
    got = quality.score(df, quality.train(df, labels)).collect()
    assert len(got) == len(made) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(1000 if r.doc_id == 1001 else r.doc_id, set()).add(r.score)
    assert all(len(x) == 1 for x in by.values())
    # repeated labels and rows change nothing, nor do values in columns of the same names
    plain = quality.train(docs(spark, [r[:2] for r in rows]), labels.dropDuplicates())
    assert np.allclose([r.score for r in quality.score(docs(spark, [r[:2] for r in rows]), plain).orderBy("doc_id").collect()], [min(by[r[0]]) for r in rows])


def test_quality_without_labels(spark):
    df = docs(spark, [(1, "a")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(df, quality.train(df, none)).collect()] == [0.5]
    assert quality.score(docs(spark, []), quality.train(docs(spark, []), none)).collect() == []
