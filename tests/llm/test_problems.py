import math
import random

import numpy as np
import pytest
from oracle import DATA, check
from pyspark.sql import functions as F

from matnflow.llm import canonical, encode, mixing, neardup, neighbours, overlap, queries, spam, vocabulary


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_query_equals_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.sql())))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


# ---------------------------------------------------------------- problem 3


def test_forms(spark):
    same = [
        ("ﻣﺮﺣﺒﺎ", "مرحبا"), ("ﻻ ﺑﺄﺱ", "لا بأس"), ("أٰ", "أٰ"), ("غیر", "غير"), ("علی", "على"), ("ییی", "ييى"), ("کتاب", "كتاب"),
        ("ａｂｃ　１２", "abc 12"), ("a​b‍", "ab"), (" a \t\n b ", "a b"), ("رaMЕ", "رaME"), ("é", "é"), ("۱۲۳۷۸۹", "١٢٣٧٨٩"),
        ("شَّ", "شَّ"), ("ﰀ", "ئج"), ("سی\u064e\u0654ب", "سئ\u064eب"), ("سي\u0650\u0651\u0654", "سئ\u0650\u0651"), ("a\u2011b", "a\u2010b"), ("ﬁn", "fin"),
        ("\u037e", ";"), ("\u1112\u1161\u11ab", "\ud55c"),
    ]
    other = [("علي", "على"), ("كتـاب", "كتاب"), ("ا", "أ"), ("ب", "بَ"), ("a,b", "a.b"), ("٤", "۴"), ("ملک", "ملك"), ("x²", "x2"), ("ﷺ", "صلى الله عليه وسلم")]
    rows = [(i, a, b) for i, (a, b) in enumerate(same + other)]
    df = spark.createDataFrame([(i, t) for i, a, b in rows for t in (a, b)], "i int, text string")
    forms = {}
    for r in canonical.canonicalize(df).collect():
        forms.setdefault(r.i, []).append(r.form)
    for i, (a, b) in enumerate(same):
        assert forms[i][0] == forms[i][1], (a, b, forms[i])
    for i in range(len(same), len(rows)):
        assert forms[i][0] != forms[i][1], rows[i]


def test_forms_equal_the_printing_model():
    """Random strings of the characters that matter: the operator's form is the table's, character by character."""
    import duckdb

    draw = random.Random(5)
    signs = "ابتيىیکكلمهوءأؤئآٱ \u064b\u064e\u0651\u0652\u0653\u0654\u0655\u0670\u200b\u200c\u00a0\u3000\ufeff\u00ad.,:«»()aBо۱٤ﻻﺍﻳﻲﷲﷺｘ（é"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(12))) for _ in range(3000)] + [None, "", "\u200b"]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::VARCHAR[]) AS text", [texts])
    ours = dict(con.sql("SELECT text, f FROM (" + canonical.form_query("t", "text") + ")").fetchall())
    theirs = dict(con.sql("SELECT text, f FROM (" + queries.printed_sql("t", "text") + ")").fetchall())
    assert {t: (ours[t], theirs[t]) for t in ours if ours[t] != theirs[t]} == {}


def test_forms_of_odd_rows(spark):
    long = "ﻣﻦ " * 200_000
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "​ ", 9), (4, long, 9)], "rec_id int, text string, form int")
    got = {r.rec_id: r.form for r in canonical.canonicalize(df).collect()}
    assert got[1] is None and got[2] == "" and got[3] == "" and got[4] == ("من " * 200_000).strip()
    assert canonical.canonicalize(df.where(F.lit(False))).count() == 0
    pairs = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "a​b"), (4, None), (5, None), (6, "x")], "rec_id int, text string")
    assert sorted(map(tuple, canonical.alike_pairs(pairs).collect())) == [(1, 3), (2, 3)]
    assert canonical.alike_pairs(pairs.where(F.lit(False))).count() == 0


# ---------------------------------------------------------------- problem 1


def test_golay_covers():
    code = neardup.Golay(3)
    x = np.random.default_rng(1).integers(0, 1 << 23, 4000)
    near = code.near(x)
    assert ((near >= 0).sum(axis=1) == 1).all()  # a perfect code: one anchor within radius 3
    wide = neardup.Golay(4).near(x)
    assert (wide >= 0).sum(axis=1).max() == 6 and all(set(a[a >= 0]) <= set(b[b >= 0]) for a, b in zip(near, wide))


def brute_near(rows, share):
    sets = [(i, set(t.split())) for i, t in rows if t]
    return sorted((min(i, j), max(i, j)) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and len(a & b) >= share * len(a | b) - 1e-9)


def test_near_duplicates_equal_brute_force(spark):
    draw = random.Random(3)
    letters = "بتثجحخدذرزسشصضطظعغفقكلمن"
    lexicon = ["".join(draw.choice(letters) for _ in range(6)) for _ in range(3000)]
    rows = []
    for size in (1, 2, 3, 4, 6, 10, 18, 22, 40, 75, 90, 300):
        for _ in range(6):
            base = draw.sample(lexicon, size)
            rows.append(base)
            for _ in range(4):
                copy = list(base)
                for _ in range(draw.randint(0, max(1, size // 6))):
                    copy[draw.randrange(len(copy))] = draw.choice(lexicon)
                draw.shuffle(copy)
                rows.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    odd = [(9001, None), (9002, ""), (9003, ""), (9004, "latin only"), (9005, rows[0][1]), (9006, rows[0][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows + odd], "rec_id int, text string, n int")
    want = brute_near(rows + odd[4:], 0.7)
    got = sorted(map(tuple, neardup.similar_pairs(df).collect()))
    assert set(got) <= set(want) and len(got) == len(set(got))
    assert len(got) >= 0.98 * len(want)
    # crowded anchors in chunks that meet pairwise give the same pairs
    assert sorted(map(tuple, neardup.similar_pairs(df, hot_rows=7).collect())) == got
    assert neardup.similar_pairs(df.where(F.lit(False))).count() == 0


def test_matching_form_equals_the_core(spark):
    from matnflow.functions.normalize import fold_letters

    df = spark.read.parquet(f"{DATA}/dorar_hadith.parquet").select("text").where("text IS NOT NULL")
    letters = neardup.Letters()
    for r in df.select("text", fold_letters("text").alias("f")).collect():
        assert neardup.words_of(r.text, letters) == set(r.f.split())


# ---------------------------------------------------------------- problem 2


def vectors(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(-90, 90, (40, 64))
    rows = []
    for i in range(400):
        v = np.clip(base[i % 40] + draw.integers(-12, 13, 64) * (i % 3), -127, 127)
        rows.append((i, 0.5, v.tolist(), "x"))
    rows += [(1000 + i, 0.1, base[0].tolist(), "x") for i in range(30)]  # copies
    rows += [(2000, None, base[1].tolist(), "x"), (2001, 1.0, None, "x"), (2002, 1.0, [1, 2], "x"), (2003, 1.0, [0] * 64, "x"), (2004, 1.0, [None] + [1] * 63, "x"), (2005, -1.0, base[2].tolist(), "x")]
    return spark.createDataFrame(rows, "vec_id long, scales float, data array<tinyint>, id string")


def brute_vectors(df, k, least):
    rows = [(r.vec_id, np.array(r.data, float) * math.copysign(1, r.scales)) for r in df.collect() if r.scales is not None and r.data and len(r.data) == 64 and None not in r.data and any(r.data)]
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    cos = (x @ x.T) / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1)))
    pairs, lists = set(), {}
    for n in range(len(ids)):
        order = [j for j in np.lexsort((ids, -cos[n])) if j != n][:k]
        lists[int(ids[n])] = [int(ids[j]) for j in order]
        pairs |= {(int(min(ids[n], ids[j])), int(max(ids[n], ids[j]))) for j in order if cos[n, j] >= least}
    return pairs, lists


def test_similar_vectors_equal_brute_force(spark):
    df = vectors(spark)
    pairs, lists = brute_vectors(df, 10, 0.9)
    for factor in (0.25, 0.5, 1.0):
        got = list(map(tuple, neighbours.similar_pairs(df, factor=factor).collect()))
        assert len(got) == len(set(got)) and set(got) == pairs
    found = neighbours.nearest_of(df, df.where("vec_id % 50 = 0"), factor=1.0, shard_rows=100)
    by = {}
    for r in found.orderBy("vec_id", "rank").collect():
        by.setdefault(r.vec_id, []).append(r.neighbour)
    assert by == {i: lists[i] for i in lists if i % 50 == 0}
    for factor, shard in ((1.0, 30), (1.0, None), (0.35, None)):
        every = {}
        for r in neighbours.nearest_to_all(df, factor=factor, shard_rows=shard).orderBy("vec_id", "rank").collect():
            every.setdefault(r.vec_id, []).append(r.neighbour)
        found = sum(len(set(every[i]) & set(lists[i])) for i in lists) / sum(map(len, lists.values()))
        assert every == lists if factor == 1.0 else found >= 0.9
    assert neighbours.similar_pairs(df.where(F.lit(False))).count() == 0
    assert neighbours.nearest_to_all(df.where(F.lit(False))).count() == 0


def test_nearest_of_many_ties_are_the_smallest_ids(spark):
    draw = np.random.default_rng(7)
    rows = [(i, 1.0, (draw.integers(1, 5) * np.ones(64, int)).tolist(), "x") for i in range(120)]  # one direction, four lengths
    rows += [(200 + i, 1.0, draw.integers(-90, 90, 64).tolist(), "x") for i in range(80)]
    order = draw.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "vec_id long, scales float, data array<tinyint>, id string")
    asked = [0, 50, 119]
    got = {i: [] for i in asked}
    for r in neighbours.nearest_of(df, df.where(F.col("vec_id").isin(asked)), factor=1.0).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append(r.neighbour)
    assert got == {i: [j for j in range(12) if j != i][:10] for i in asked}
    copies = spark.createDataFrame([(i, 1.0, [3] * 64, "x") for i in draw.permutation(300).tolist()], "vec_id long, scales float, data array<tinyint>, id string")
    near = neighbours.nearest_of(copies, copies.where("vec_id = 250"), shard_rows=100).orderBy("rank").collect()
    assert [r.neighbour for r in near] == list(range(10))


def test_many_shards_keep_every_link(spark):
    df = vectors(spark)
    rows = neighbours.usable(df)
    classes = neighbours.classes_of(rows, 11).cache()
    routed = neighbours.Routed(classes, shard_rows=20)
    assert routed.shards > 4
    links = routed.near(11, 0.9, 0.5)
    near = neighbours.near_lists(rows, classes, links, 10)
    pairs = near.select("vec", F.explode("near").alias("n")).where("n.far <= -0.9").select(F.least("vec", "n.id"), F.greatest("vec", "n.id")).distinct()
    assert set(map(tuple, pairs.collect())) == brute_vectors(df, 10, 0.9)[0]


# ---------------------------------------------------------------- problem 4


def test_edit_distance_is_a_metric():
    draw = random.Random(2)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(0, 6))) for _ in range(60)]
    assert vocabulary.edit_distance("ab", "ba") == 1 and vocabulary.edit_distance("ca", "abc") == 2 and vocabulary.edit_distance("", "abc") == 3
    for _ in range(3000):
        a, b, c = draw.choice(words), draw.choice(words), draw.choice(words)
        assert vocabulary.edit_distance(a, b) == vocabulary.edit_distance(b, a)
        assert vocabulary.edit_distance(a, c) <= vocabulary.edit_distance(a, b) + vocabulary.edit_distance(b, c)


def test_trees_find_all_and_measure_less():
    """Every entry within its tolerance, the words in any order, as by trying all orders of all runs."""
    from itertools import permutations

    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6)))
    entries = [" ".join(word() for _ in range(draw.randint(1, 3))) for _ in range(300)]
    matcher = vocabulary.Matcher(list(enumerate(entries)))
    forms = []
    for _ in range(150):
        q = list(draw.choice(entries))
        for _ in range(draw.randint(0, 2)):
            q[draw.randrange(len(q))] = draw.choice("abcdefgh ")
        words = [*"".join(q).split(), *[word() for _ in range(draw.randint(0, 1))]]
        draw.shuffle(words)
        forms.append(" ".join(words))
    for form, got in zip(forms, matcher.best(forms)):
        words, best = form.split(), None
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                for order in permutations(words[i:j]):
                    joined = "".join(order)
                    for n, e in enumerate(entries):
                        e = e.replace(" ", "")
                        most = int(len(e) * 0.2 + 1e-9)
                        if abs(len(joined) - len(e)) <= most and (d := vocabulary.edit_distance(joined, e)) <= most:
                            best = min(best or (0, 0, 0), (-len(e), d, n))
        assert got == (best and (-best[0], best[1], best[2])), form
    asked = sum(len(matcher.runs(f)) for f in set(forms))
    assert sum(t.measured for t in matcher.trees.values()) < 0.5 * asked * len(entries)


def test_many_words_in_any_order():
    words = "ab cd ef gh ij kl mn op".split()
    matcher = vocabulary.Matcher([(1, " ".join(words))])
    assert matcher.best([" ".join(reversed(words)), "op ab zz mn cd ij ef kl gh", "xx yy"]) == [(16, 0, 1), (16, 2, 1), None]
    assert matcher.best(["op ab mn cd ij ef kl ga"]) == [(16, 1, 1)]


def test_values(spark):
    labels = spark.createDataFrame([(1, "صحيح"), (2, "حسن"), (3, "حسن صحيح"), (4, "ضعيف جدا"), (5, "منكر المتن"), (6, None), (7, "---"), (9, "صحيح")], "grade_id int, label string")
    cases = [
        ("صحيح ", 1), ("صَحِيحٌ", 1), ("صحيح حسن", 3), ("حسنصحيح", 3), ("قال: ضـعـيف جـدا (والله أعلم)", 4), ("منكر املتن", 5),
        ("ضعيف", -1), ("ورقة تالفة", -1), ("!!!", -1), ("﻿صحيح", 1), ("صحيح! صحيح", 1), ("حسن؛ وقد تقدم", 2),
    ]
    skipped = [None, "", " \t", " ", "صحيح", "حسن صحيح"]
    rows = [(i, v) for i, (v, _) in enumerate(cases)] + [(100 + i, v) for i, v in enumerate(skipped)] + [(200, "صحيح " + "كلمة " * 20_000)]
    df = spark.createDataFrame(rows, "rec_id int, value string")
    got = {r.rec_id: r.grade_id for r in vocabulary.map_values(df, labels).collect()}
    assert got == {i: g for i, (_, g) in enumerate(cases)} | {200: 1}
    assert {r.grade_id for r in vocabulary.map_values(df, labels.where(F.lit(False))).collect()} == {-1}
    assert vocabulary.map_values(df.where(F.lit(False)), labels).count() == 0


def test_shards_merge(spark):
    labels = spark.createDataFrame([(1, "صحيح"), (2, "حسن"), (3, "حسن صحيح"), (4, "ضعيف جدا"), (5, "منكر المتن")], "grade_id int, label string")
    df = spark.createDataFrame([(1, "حسن صحيح!"), (2, "ضعيف جدا."), (3, "شيء")], "rec_id int, value string")
    assert {r.rec_id: r.grade_id for r in vocabulary.map_values(df, labels, shard_rows=2).collect()} == {1: 3, 2: 4, 3: -1}


def test_values_of_any_script(spark):
    labels = spark.createDataFrame([(1, "New York"), (2, "São Paulo"), (3, "Αθήνα"), (4, "صحيح")], "grade_id int, label string")
    df = spark.createDataFrame([(1, "york, NEW"), (2, "Sao-Paulo (BR)"), (3, "αθηνα"), (4, "صحـيح!"), (5, "Paris")], "rec_id int, value string")
    assert {r.rec_id: r.grade_id for r in vocabulary.map_values(df, labels, script="any").collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: -1}


# ---------------------------------------------------------------- problem 5


def test_overlaps_equal_brute_force(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("بتجدرسعفكلمن") for _ in range(draw.randint(2, 6)))
    rows, texts = [], []
    for i in range(160):
        if texts and draw.random() < 0.5:
            t = list(draw.choice(texts))
            for _ in range(draw.randint(0, max(1, len(t) // 5))):
                p = draw.randrange(len(t))
                t[p : p + draw.randint(0, 1)] = draw.choice(["ب", "", "ت", " "])
            t = "".join(t)
        else:
            t = " ".join(word() for _ in range(draw.randint(1, 14)))
        texts.append(t or "ب")
        rows.append((i, draw.choice(["train", "train", "test", "valid", None]), "hadith", None, t, 1))
    odd = [(900, "train", "quran", " ٢:٠٥ ", None, 1), (901, "test", "quran", "2:5", "", 1), (902, "test", "hadith", "2:5", None, 1), (903, "valid", "quran", None, None, 1), (904, "test", None, "2:5", None, 1)]
    df = spark.createDataFrame(rows + odd, "row_id int, split string, source string, id string, text string, n int")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(900, 901)}
    forms = [(i, s, " ".join(t.split())) for i, s, _, _, t, _ in rows]
    for i, s, a in forms:
        for j, u, b in forms:
            if s == "train" and u in ("test", "valid") and a and b and edits(a, b) <= 0.15 * max(len(a), len(b)) + 1e-9:
                want.add((min(i, j), max(i, j)))
    got = list(map(tuple, overlap.split_overlaps(df).collect()))
    assert len(got) == len(set(got)) and set(got) == want
    report = overlap.overlap_report(df).collect()
    assert sum(r.pairs for r in report) == len(want)
    assert overlap.split_overlaps(df.where(F.lit(False))).count() == 0


def test_chunks_outnumber_edits():
    for n in range(1, 5000):
        assert -(-n // overlap.Q) >= math.floor(n * 0.15 / 0.85 + 1e-9) + 1


# ---------------------------------------------------------------- problems 6 and 7


def test_ids_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    draw = random.Random(8)
    pieces = [" ", "\n", "\t", "\r", "\x85", "\xa0", " ", "　", "\x1c", "\0", "a", "word", "'s", "12", "ﻻ", "é", "à", "٠", "ش", ".", "<|endoftext|>", "😀", "�", "漢字"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    texts += [None, "", " ", "x" * 30_000, "ابت" * 5000, " " * 5000 + "x", "a \xa0 b à c"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, ids int")
    rows = encode.encode_corpus(df, flush_mb=1).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == (reference.encode(texts[r.doc_id], add_special_tokens=False).ids if texts[r.doc_id] else []), texts[r.doc_id][:50]
    counts = {r.doc_id: r.n_tokens for r in encode.count_tokens(df).collect()}
    assert all(counts[r.doc_id] == len(r.ids) for r in rows)
    assert encode.encode_corpus(df.where(F.lit(False))).count() == 0


def test_forced_boundaries_are_certain():
    ranks = encode.read_ranks(open(encode.default_vocabulary(), "rb").read())
    certain = encode.forced_boundaries(ranks)
    assert certain.sum() > 20_000 and not any(certain[a, b] for t in list(ranks)[:5000] for a, b in zip(t, t[1:]))


def test_water_filling():
    s = [mixing.Share("a", 0.5, 100, 2), mixing.Share("b", 0.3, 1000, 1), mixing.Share("c", 0.2, 1000, 1), mixing.Share("d", 0.0, 10, 1)]
    mixing.water_fill(s, 1000)
    assert [x.tokens for x in s] == [200.0, 480.0, 320.0, 0.0] and [x.clamped for x in s] == [True, False, False, False]
    mixing.water_fill(t := [mixing.Share("a", 1.0, 10, 3)], 1000)
    assert t[0].tokens == 30


def test_mixture(spark):
    draw = random.Random(9)
    rows = [(i, draw.choice("aaaaaaaabbc"), "word " * draw.randint(1, 40)) for i in range(3000)]
    rows += [(9001, None, "word"), (9002, "zz", "word"), (9003, "a", None), (9004, "b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 3), ("c", 0.3, 2), ("gone", 0.5, 4), ("b", None, None)], "source string, weight double, max_repeats int")
    mix = mixing.Mixture(docs, targets)
    used = mix.records_used().collect()
    assert sorted(r.doc_id for r in used) == sorted(i for i, s, _ in rows if s in ("a", "b", "c"))
    report = {r.source: r for r in mix.report().collect()}
    want = {s.source: s for s in mix.shares}
    for name in "abc":
        total = sum(r.n_tokens * r.repeats for r in used if r.source == name)
        assert total == report[name].tokens and want[name].tokens - 45 <= total <= want[name].tokens + 1e-6
        assert max(r.repeats for r in used if r.source == name) <= want[name].cap
    assert report["c"].clamped and report["gone"].tokens == 0 and abs(sum(r.share for r in report.values()) - 1) < 1e-9
    again = {r.doc_id: r.repeats for r in mixing.Mixture(docs.repartition(5), targets).records_used().collect()}
    assert again == {r.doc_id: r.repeats for r in used}
    empty = mixing.Mixture(docs.where(F.lit(False)), targets)
    assert empty.records_used().count() == 0 and empty.report().agg(F.sum("tokens")).first()[0] == 0


# ---------------------------------------------------------------- problem 8


def test_spam(spark):
    draw = random.Random(10)
    nouns = ["".join(draw.choice("abdeilmnorst") for _ in range(7)) for _ in range(900)]
    little = ["the", "of", "and", "in", "was", "a", "to", "by"]
    sentence = lambda: " ".join(draw.choice(little) if draw.random() < 0.4 else draw.choice(nouns) for _ in range(14)).capitalize() + "."
    article = lambda n: "\n".join(" ".join(sentence() for _ in range(4)) for _ in range(n))
    rows = [(i, article(6), "en") for i in range(150)]
    rows += [(200 + i, "\n".join(f"* [[{draw.choice(nouns)}]] ({1900 + j})" for j in range(25)), "EN") for i in range(5)]
    rows += [(220 + i, "{| class=x\n" + "\n".join(f"|-\n| {draw.choice(nouns)} || yes || no || {j}" for j in range(25)) + "\n|}", "en-x") for i in range(5)]
    rows += [(240, "#REDIRECT [[Somewhere]]", "en"), (241, "x" * 400, "en"), (242, None, "en"), (243, "", "en"), (244, article(6) + "\n* [http://a.example/x buy it]", "en")]
    keyword = lambda: f"{draw.choice(['buy', 'cheap', 'order'])} {draw.choice(nouns[:3])}"
    rows += [(300, " | ".join(keyword() for _ in range(120)), "en"), (301, "\n".join(keyword() for _ in range(80)), None), (302, " ".join(f"#buy{draw.choice(nouns[:3])}" for _ in range(60)), "en")]
    rows += [(303, "\n".join(f"<a href='http://{draw.choice(nouns)}.example/'>{draw.choice(nouns)}</a>" for _ in range(20)), "en"), (304, "\n".join(f"{draw.choice(nouns[:4])} A{j} {j}9.99" for j in range(50)), "en")]
    rows += [(305, article(1) + "\n" + ", ".join(keyword() for _ in range(200)), "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, spam int")
    assert {r.doc_id for r in spam.spam_documents(df).collect()} == {300, 301, 302, 303, 304, 305}
    assert spam.spam_documents(df.where(F.lit(False))).count() == 0
