"""Operators over documents, against brute force and on odd rows."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import cases
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from threadloom.llm import bpe, decontam, langid, neardup, quality, sharding, substring

VOCABULARY = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def split(text):
    return (text or "").encode().split()


# Sharding


def test_shards_by_key(spark):
    docs = cases.odd_documents(spark)
    got = sharding.shard_documents(docs, [1.0] * 5, grown=[1.0]).collect()
    assert len(got) == docs.count()
    by_key = {}
    for r in got:
        assert by_key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 5)
    for shard in {r.shard for r in got}:
        mine = sorted(r.slot for r in got if r.shard == shard)
        assert mine == list(range(len(mine)))
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in cases.odd_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected


def test_shard_draws_by_hand(spark):
    weights = [1.0, 2.0, 0.5]
    got = sharding.assign(spark.range(300), "id", weights).collect()
    for r in got:
        draws = [(int(hashlib.md5(f"{r.id}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13 for s in range(3)]
        assert r.shard == min(range(3), key=lambda s: -math.log(draws[s]) / weights[s])
    share = Counter(r.shard for r in got)
    assert share[1] > share[0] > share[2]


def test_shards_follow_weights_and_move_little(spark):
    got = sharding.assign(spark.range(20_000), "id", [1.0, 1.0, 2.0], grown=[1.0])
    counts = {r.shard: r["count"] for r in got.groupBy("shard").count().collect()}
    assert abs(counts[2] / 20_000 - 0.5) < 0.02
    moved = got.filter("shard != grown_shard")
    assert moved.filter("grown_shard != 3").count() == 0
    assert abs(moved.count() / 20_000 - 0.2) < 0.02


def test_shards_of_nothing(spark):
    assert sharding.shard_documents(cases.no_documents(spark), [1.0]).collect() == []
    with pytest.raises(ValueError):
        sharding.costs(F.lit("a"), [1.0, 0.0])


# Quality


def counts(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


REPEATING = "a b c a b c a b x y a b c\nsame line here.\n\nsame line here.\n \nother # line | with < marks >.\r\n" * 4


def test_quality_counts(spark):
    rows = [*cases.odd_rows(), (20, REPEATING), (21, "x " * 300), (22, "a b c d e " * 3)]
    got = quality.judge_documents(cases.documents(spark, rows)).collect()
    expected = Counter((i, *counts(t)) for i, t in rows)
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert Counter(tuple(r[n] for n in names) for r in got) == expected


def test_quality_lines(spark):
    good = [cases.prose(i, 30) for i in range(4)]
    bad = [
        "Home | News | About | Contact | Login", "word### more*** marks%%% here&&& again$$$",
        "spam " * 12 + ".", "Copyright by us. All rights reserved.", "so many words without the end of any sentence at all",
    ]
    short = "A title"
    text = "\n".join([short, *good[:2], *bad, "", *good[2:]])
    docs = cases.documents(spark, {1: text, 2: "\n".join(bad * 6), 3: "\n".join(good), 4: None})
    got = {r.doc_id: r for r in quality.judge_documents(docs).collect()}
    assert got[1].cleaned_text == "\n".join([short, *good[:2], "", *good[2:]])
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert got[3].cleaned_text == "\n".join(good) and got[3].lost_share == 0
    kept = {r.doc_id: r for r in quality.clean_documents(docs).collect()}
    assert set(kept) == {1, 3} and kept[1].text == got[1].cleaned_text and kept[1].n_chars == len(kept[1].text)


def test_sentence_ends_of_all_scripts(spark):
    ends = {"hi": ("शब्द", "।"), "ur": ("لفظ", "۔"), "ar": ("كلمة", "؟"), "hy": ("բառ", "։"), "am": ("ቃል", "።"), "my": ("စာ", "။"), "km": ("ពាក្យ", "។"), "th": ("คำ", ""), "en": ("word", ".")}
    lines = [(k, " ".join(f"{w}{w * (i % 6)}" for i in range(11)) + end) for k, (w, end) in ends.items()]
    lines += [("hi-", "शब्द " * 5 + "एक दो तीन चार पांच"), ("en-", "a คำ b c d e f g h i")]
    got = spark.createDataFrame(lines, "k string, line string").select("k", quality.line_fails(F.col("line"), quality.LineRules()).alias("why"))
    assert {r.k: r.why for r in got.collect()} == {**dict.fromkeys(ends), "hi-": "punctuation", "en-": "punctuation"}


def test_quality_odd_tables(spark):
    docs = cases.odd_documents(spark)
    assert quality.judge_documents(docs).count() == docs.count()
    kept = quality.clean_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert quality.clean_documents(cases.no_documents(spark)).collect() == []


# Near duplicates


def components(rows, size, percent=80):
    texts = {}
    for i, t in rows:
        w = split(t and t.encode().lower().decode())
        s = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) or frozenset([tuple(w)] if w else [])
        if i is not None:
            texts.setdefault(i, set()).add(s)
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in texts[a] for y in texts[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}


def changed(text, every, mark):
    return " ".join(f"{w}{mark}" if i % every == 3 else w for i, w in enumerate(text.split()))


def near_rows():
    base = [cases.prose(100 + i, 200) for i in range(6)]
    rows = [*cases.odd_rows(), (30, "A b C"), (31, "a B c")]
    rows += [(40 + i, t) for i, t in enumerate(base)]
    rows += [(60 + i, changed(base[i % 3], 60 + 20 * (i // 3), f"x{i}")) for i in range(12)]  # similar, chained
    rows += [(80 + i, changed(base[i], 5, "y")) for i in range(3)]  # not similar
    rows += [(90 + i, base[5].upper()) for i in range(4)]
    return rows


def test_near_duplicates_brute_force(spark):
    rows = near_rows()
    got = neardup.near_duplicates(cases.documents(spark, rows), neardup.Similarity(shingle_words=4)).collect()
    expected = components(rows, 4)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)


@pytest.mark.parametrize("block_chars", [1 << 20, 3000])
def test_near_duplicates_within_mixed_buckets(spark, block_chars):
    """One-row collections put unlike texts into the same buckets; no pair is lost in them."""
    head = cases.prose(7, 100)
    rows = [(i, f"{head} {cases.prose(50 + i // 2, 60)} {cases.prose(900 + i, 4)}") for i in range(16)]
    chain = cases.prose(8, 160).split()
    rows += [(20 + i, " ".join(chain[6 * i : 6 * i + 100])) for i in range(10)]
    rule = neardup.Similarity(shingle_words=4, collections=10, rows=1, block_chars=block_chars)
    got = neardup.near_duplicates(cases.documents(spark, rows), rule).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows, 4)


def test_one_of_each(spark):
    docs = cases.odd_documents(spark)
    got = neardup.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8]
    assert neardup.one_of_each(cases.no_documents(spark)).collect() == []


# Repeated passages


def without_repeats(rows, size=13):
    first = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - size + 1):
            k = tuple(w[j : j + size])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        drop = [False] * len(w)
        for j in range(len(w) - size + 1):
            if i is not None and first[tuple(w[j : j + size])] < i:
                drop[j : j + size] = [True] * size
        out.append((i, len(w), sum(drop), b" ".join(x for x, d in zip(w, drop, strict=True) if not d)))
    return Counter(out)


def passage_rows():
    common, other = cases.prose(500, 60), cases.prose(501, 13)
    frame = "a b c d e f"  # the same run of six words in ever other surroundings
    rows = [*cases.odd_rows()]
    rows += [(100 + i, f"{cases.prose(600 + i, 30)}\n\n{common}  {cases.prose(700 + i, 20)}") for i in range(5)]
    rows += [(120 + i, f"{cases.prose(800 + i, 9)} {other}\t{cases.prose(900 + i, 9)}") for i in range(4)]
    rows += [(140 + i, f"{cases.prose(40 + i // 2, 7)} {frame} {cases.prose(70 + i // 2, 7)}") for i in range(12)]
    rows += [(160, "x " * 50), (161, "x " * 12), (162, "x " * 13), (163, " ".join(common.split()[:12]))]
    return rows


def test_repeats_brute_force(spark):
    rows = passage_rows()
    got = substring.remove_repeats(cases.documents(spark, rows), shard_words=500, chunk_bytes=2000).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, b" ".join(split(r.text))) for r in got) == without_repeats(rows)
    left = {r.doc_id: r.text for r in got}
    assert left[120] == dict(rows)[120]  # an untouched text keeps its spaces
    assert left[3] is None and left[101].startswith(cases.prose(601, 30) + "\n\n")


def test_repeats_odd_tables(spark):
    docs = cases.odd_documents(spark)
    got = substring.remove_repeats(docs)
    assert set(got.columns) == set(docs.columns) | {"n_removed"} and got.count() == docs.count()
    assert substring.remove_repeats(cases.no_documents(spark)).collect() == []


# Benchmark items


def test_contained_items(spark):
    items = [(i, cases.prose(300 + i, 20 + i)) for i in range(5)] + [(7, "too short"), (8, None), (None, "a b c d e f g"), (0, cases.prose(300, 20))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        *cases.odd_rows(),
        (50, f"{cases.prose(1, 300)} {items[0][1].upper().replace('.', ' ;')} {cases.prose(2, 300)}"),
        (51, f"{cases.prose(3, 30)} {' '.join(items[1][1].split()[:19])} and more"),  # 15 of 17 shingles
        (52, f"{' '.join(items[2][1].split()[:12])} only half"),
        (53, f"{items[3][1]} {items[4][1]}"), (53, f"{items[3][1]} {items[4][1]}"),
    ]
    docs = cases.documents(spark, rows)
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in decontam.contained_items(docs, benchmark).collect()}
    assert got == {(50, 0): (16, 16), (51, 1): (15, 17), (53, 3): (19, 19), (53, 4): (20, 20)}
    left = decontam.without_items(cases.odd_documents(spark), benchmark)
    assert left.count() == len(cases.odd_rows())
    assert sorted(r.doc_id for r in decontam.without_items(docs, benchmark).collect() if r.doc_id and r.doc_id > 49) == [52]
    assert decontam.contained_items(cases.no_documents(spark), benchmark).collect() == []
    assert decontam.contained_items(docs, benchmark.limit(0)).collect() == []


def test_items_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 0)
    benchmark = spark.createDataFrame([(1, cases.prose(1, 30))], "item_id long, text string")
    docs = cases.documents(spark, {1: cases.prose(9, 20) + " " + cases.prose(1, 30), 2: cases.prose(10, 90)})
    assert [r.doc_id for r in decontam.contained_items(docs, benchmark).collect()] == [1]


def test_short_and_unspaced_items(spark):
    items = [(1, "Yes!"), (2, "Mount Fuji"), (3, "who, what, where, when"), (4, "日本の首都は東京です。"), (5, "ประเทศไทย"), (6, "東京")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = {
        1: "They say yes to it", 2: "yesterday Fuji Mount", 3: "at (mount) FUJI, who what where else when", 4: "x who what where when",
        5: "昨日、日本の首都は東京ですと聞いた", 6: "อยู่ในประเทศไทยนี้", 7: "京東",
    }
    got = decontam.contained_items(cases.documents(spark, rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (4, 3), (5, 4), (5, 6), (6, 5)}
    assert all(r.n_shared == r.n_shingles == 1 for r in got if r.item_id in (1, 2, 3, 6))


# Languages


def speech(lang, seed, n=60):
    import random

    draw = random.Random(f"{lang}{seed}")
    parts = {"en": ["the", "ing", "th", "wh", "ed"], "de": ["sch", "ung", "ei", "ü", "ß"], "ru": ["пр", "ов", "ст", "ни", "щ"]}[lang]
    return " ".join("".join(draw.choices(parts, k=draw.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rows = [(i, speech(lang, i), lang) for i, lang in enumerate(["en", "de", "ru"] * 60)]
    rows += [(900, None, "en"), (901, "text", None), (902, "123 ?!", "de"), (None, speech("en", 9), "en")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "ru"]
    asked = [(i, speech(lang, 5000 + i, n), lang) for i, (lang, n) in enumerate([(x, k) for x in ("en", "de", "ru") for k in (1, 5, 20_000)] * 4)]
    odd = [(100, None, "und"), (101, "", "und"), (102, "12 34 .", "und")]
    docs = spark.createDataFrame([(*r, "x") for r in asked + odd], "doc_id long, text string, expected string, score string")
    got = langid.predict(docs, model).collect()
    assert len(got) == len(asked) + 3
    assert all(0 <= r.score <= 1 and r.lang_pred in ("de", "en", "ru", "und") for r in got)
    right = [r.lang_pred == r.expected for r in got]
    assert sum(right) / len(right) > 0.9 and all(r.rejected for r in got if r.doc_id >= 100)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id >= 100)


def test_letters_of_all_code_points(spark):
    letter = langid._letters()
    for text in ["\U0001F600\U0001F680", "。！", "\u3000\u3000", "「」"]:
        assert langid._stream(text, letter).size == 0
    assert langid._stream("漢字。\U00020000", letter).tolist() == [0x6F22, 0x5B57, 32, 0x20000]
    rows = [(i, speech(lang, i), lang) for i, lang in enumerate(["en", "ru"] * 10)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.predict(cases.documents(spark, {1: "\U0001F600 。！", 2: "\u3000"}), model).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in got} == {("und", 0.0, True)}


def test_languages_of_nothing(spark):
    model = langid.train(cases.no_documents(spark))
    got = langid.predict(cases.odd_documents(spark), model)
    assert model.languages == [] and {r.lang_pred for r in got.collect()} == {"und"}
    assert langid.predict(cases.no_documents(spark), model).collect() == []


def test_every_label_is_learned(spark):
    rows = [(10 * n + k, " ".join([chr(0x4E00 + 7 * n) * 3] * 20), f"l{n:02d}") for n in range(70) for k in range(9)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted({r[2] for r in rows})
    asked = spark.createDataFrame(rows[::9], "doc_id long, text string, expected string")
    assert all(r.lang_pred == r.expected for r in langid.predict(asked, model).collect())


@pytest.mark.parametrize("keys", ["null", "same", "different"])
def test_training_rows_are_bounded(spark, keys):
    number = {"null": lambda i: None, "same": lambda i: 7, "different": lambda i: i}[keys]
    rows = [(number(i), speech(lang, i), lang) for lang in ("en", "de") for i in range(90)]
    rows += [(number(0), speech("ru", 0), "ru")] * 50  # repeated rows are one
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    setup = langid.Training(rows_per_language=40, max_rows=90)
    got = langid.training_rows(labelled, setup, "doc_id", "text", "lang").distinct().groupBy("l").count().collect()
    assert dict(got) == {"en": 30, "de": 30, "ru": 1}


def test_prediction_by_hand(spark):
    setup = langid.Training(epochs=3)
    rows = [(i, speech(lang, i), lang) for i, lang in enumerate(["en", "de", "ru"] * 20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), setup)
    texts = {i: speech(lang, 70 + i, 3) for i, lang in enumerate(["en", "de", "ru"])} | {5: "a", 6: "ab. " * 9}
    weights, bias, (temperature, threshold) = langid.unpack(model.packed)
    weights, letter = weights.reshape(-1, 3).astype(float), langid._letters()
    for r in langid.predict(cases.documents(spark, texts), model).collect():
        logits = (langid._features(texts[r.doc_id], setup, letter).astype(float) @ weights + bias) / temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        assert r.lang_pred == model.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-5
        assert r.rejected == (r.score < threshold)


# Tokens


def expected_ids(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = encoding.encode_ordinary(text or "")
    return struct.pack(f"<{len(ids)}I", *ids)


TRICKY = ["it's  we'll\t\tgo\n\n  'tis 123abc", "<|endoftext|> x", "   ", "\n", "a" * 5000, "🙂🙂 é\u0301 漢字ab", "'s't''re", "x\u00a0\u3000y  "]


def test_decoding_of_odd_ids(spark):
    rows = [(1, None), (2, b""), (3, expected_ids("plain words")), (4, expected_ids("\U0001F642 é"))]
    tokens = spark.createDataFrame(rows, "doc_id long, token_ids binary")
    got = {r.doc_id: r.decoded if r.decoded is None else bytes(r.decoded) for r in bpe.decode(tokens, VOCABULARY).collect()}
    assert got == {1: None, 2: b"", 3: b"plain words", 4: "\U0001F642 é".encode()}
    unknown = spark.createDataFrame([(5, struct.pack("<2I", 1, 4_000_000_000))], "doc_id long, token_ids binary")
    with pytest.raises(Exception):
        bpe.decode(unknown, VOCABULARY).collect()


def test_tokens(spark):
    rows = [*cases.odd_rows(), *[(200 + i, t) for i, t in enumerate(TRICKY)]]
    docs = cases.documents(spark, rows)
    tokens = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, keys=["doc_id", "n_chars"], chunk_bytes=600, body_bytes=300).cache()
    got = Counter((r.doc_id, r.n_chars, r.n_tokens, bytes(r.token_ids)) for r in tokens.collect())
    ids = {t: expected_ids(t) for _, t in rows}
    assert got == Counter((i, len(t or ""), len(ids[t]) // 4, ids[t]) for i, t in rows)
    back = bpe.decode(tokens, VOCABULARY)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in rows)
    one = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, buckets=1)
    assert Counter(bytes(r.token_ids) for r in one.collect()) == Counter(ids[t] for _, t in rows)


def test_tokens_of_nothing(spark):
    empty = bpe.encode(cases.no_documents(spark), VOCABULARY, public_tokenizers.PATTERN)
    assert empty.collect() == [] and bpe.decode(empty, VOCABULARY).collect() == []


def near_copies(seed, groups, size, words=150, changed=2):
    """Groups of documents that differ from their first one in a few words."""
    draw = random.Random(seed)
    out = []
    for g in range(groups):
        base = cases.prose(1000 * seed + g, words).split()
        for _ in range(size):
            w = list(base)
            for _ in range(changed):
                w[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def all_links(texts, rule):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + rule.shingle_words]) for i in range(len(w) - rule.shingle_words + 1)}

    sets = [shingles(t) for t in texts]
    return [
        (i, j) for i in range(len(sets)) for j in range(i)
        if 100 * len(sets[i] & sets[j]) >= rule.percent * len(sets[i] | sets[j])
    ]


def test_components_across_many_blocks_and_tasks(spark, monkeypatch):
    """Groups whose texts are at the edge of the threshold, dealt into small blocks, centres and forests."""
    monkeypatch.setattr(neardup, "_MEMBERS", 7)
    monkeypatch.setattr(neardup, "_FOREST", 10)
    rule = neardup.Similarity(shingle_words=4, block_chars=8000)
    texts = near_copies(3, 2, 60, changed=4) + near_copies(4, 20, 3, changed=3) + [cases.prose(i, 60) for i in range(40)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(cases.documents(spark, dict(enumerate(texts))), rule).collect()}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in all_links(texts, rule):
        low, high = sorted((root(i), root(j)))
        parent[high] = low
    assert got == {i: root(i) for i in range(len(texts))}
    assert len(set(got.values())) > 45


def test_tables_that_grow_with_the_documents_are_not_broadcast(spark, tmp_path):
    """Exploded keys of a few classes look small; a bucket join of many must not bring them to the driver."""
    rule = neardup.Similarity(shingle_words=4)
    texts = {i: cases.prose(i % 30, 60) + (" more" if i > 30 else "") for i in range(40)}
    found = neardup.signatures(cases.documents(spark, texts), rule).select("id", "parts")
    found.write.parquet(str(tmp_path / "classes"))
    pairs = neardup._centre_pairs(spark.read.parquet(str(tmp_path / "classes")), rule)
    assert {(r.a, r.b) for r in pairs.collect()} >= {(1, 31), (5, 35), (0, 30)}
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
