from pyspark.sql import functions as F

from matnflow.operators import candidates as cd
from matnflow.operators import match as mt
from matnflow.plans.pipeline import check_posts, distinct_texts, verify_texts
from matnflow.profiles import SERVICE

# Invented verses: nonsense words, three suras; the last verse of sura 2 recurs in sura 3.
VERSES = [
    (0, 1, 1, "ذهبت الغيوم فوق التلال البعيدة مساء"),
    (1, 1, 2, "وعادت السفن محملة بالقمح والزيتون"),
    (2, 1, 3, "ثم انصرف التجار نحو الأسواق القديمة"),
    (3, 2, 1, "تسلق الراعي جبلا شاهقا يبحث عن غنمه"),
    (4, 2, 2, "فوجدها عند النبع تشرب ماء عذبا باردا"),
    (5, 3, 1, "فوجدها عند النبع تشرب ماء عذبا باردا"),
    (6, 3, 2, "وأنشد الشاعر قصيدة طويلة عن الوطن"),
    (7, 3, 3, None),
]
REPORTS = [(0, "a", "عن فلان قال: «من زرع شجرة فله ظلها وثمرها دائما»"), (1, "b", "عن علان قال: «أحسن الناس من أطعم جاره وكتم سره»"), (2, None, None)]


def verses(spark):
    return spark.createDataFrame(VERSES, "pos int, sura int, aya int, text string")


def search(spark, *texts, **kw):
    q = mt.with_skeleton(spark.createDataFrame(list(enumerate(texts)), "query int, text string")).select("query", "skeleton")
    return {r.query: r for r in mt.search_verses(q, mt.with_skeleton(verses(spark)), **kw).collect()}


def test_exact_partial_and_several_verses(spark):
    got = search(spark, VERSES[3][3], "السفن محملة بالقمح والزيتون", VERSES[0][3] + " " + VERSES[1][3] + " " + VERSES[2][3], "لا علاقة لهذا الكلام بشيء مما سبق", "قصير", VERSES[4][3])
    assert (got[0].similarity, got[0].first, got[0].last) == (1.0, 3, 3)
    assert (got[1].first, got[1].last) == (1, 1)
    assert (got[2].similarity, got[2].first, got[2].last) == (1.0, 0, 2)
    assert 3 not in got or got[3].similarity < 0.75
    assert 4 not in got
    assert got[5].first == 4 and got[5].also_at == [5]


def test_changed_word_and_longer_post(spark):
    got = search(spark, "تسلق الراعي جبلا عاليا يبحث عن غنمه", "وقد كتبنا لكم اليوم ما يلي ايها الاصدقاء " + VERSES[6][3] + " والسلام عليكم جميعا", "قد قيل " + VERSES[3][3] + " " + VERSES[4][3] + " انتهى الكلام هنا")
    assert 0.75 <= got[0].similarity < 0.97 and got[0].first == 3
    assert got[1].similarity >= 0.97 and (got[1].first, got[1].last) == (6, 6)
    assert got[2].similarity >= 0.97 and (got[2].first, got[2].last) == (3, 4)


def test_growth_beyond_the_window(spark):
    letters = "بتثجحخدذرزسشصضطظعغفقكلمنهو"
    word = lambda i: "".join(letters[(i * 7 + j * (i % 5 + 3)) % 26] for j in range(14))
    rows = [(i, 1, i, word(i)) for i in range(60)]
    corpus = mt.with_skeleton(spark.createDataFrame(rows, "pos int, sura int, aya int, text string"))
    q = spark.createDataFrame([(1, "".join(word(i) for i in range(2, 58)))], "query int, skeleton string")
    hit = mt.search_verses(q, corpus).first()
    # each neighbour may lower the share by 0.02, so the four that the quote lacks are taken in as well
    assert (round(hit.similarity, 9), hit.first, hit.last) == (round(56 / 60, 9), 0, 59)


def test_service_profile(spark):
    got = search(spark, VERSES[4][3], VERSES[0][3] + " " + VERSES[1][3], profile=SERVICE)
    assert (got[0].similarity, got[0].first, got[0].last) == (1.0, 4, 4)
    assert got[1].similarity >= 0.98 and (got[1].first, got[1].last) == (0, 1)


def test_reports_and_gates(spark):
    reports = mt.with_skeleton(spark.createDataFrame(REPORTS, "pos int, id string, text string"))
    q = mt.with_skeleton(spark.createDataFrame([(1, "من زرع شجرة فله ظلها وثمرها دائما"), (2, "من غرس نخلة فله فيؤها وثمرها دائما")], "query int, text string")).select("query", "skeleton")
    hits = mt.search_reports(q, reports)
    assert {r.query: r.pos for r in hits.collect()}[1] == 0
    assert mt.search_reports(q, reports, SERVICE).where("query = 1").first().similarity == 1.0
    near = spark.createDataFrame([(2, 0, 0.93), (2, 1, 0.91)], "query int, pos int, score double")
    lifted = {r.query: (r.pos, r.similarity) for r in mt.report_gate(q, hits.where("query = 1"), near, reports).collect()}
    assert lifted[1][0] == 0 and lifted.get(2, (0, 0.72)) == (0, 0.72)
    spans = spark.createDataFrame([(1, 0.6, 3, 3), (2, 0.5, 3, 3), (3, 0.6, 3, 3)], "query int, similarity double, first int, last int")
    close = spark.createDataFrame([(1, 3, 0.93), (2, 3, 0.99), (3, 6, 0.99)], "query int, pos int, score double")
    assert {r.query: r.similarity for r in mt.verse_gate(spans, close).collect()} == {1: 0.75, 2: 0.5, 3: 0.6}


def test_candidates(spark):
    df = spark.createDataFrame([("abcdabcd",), ("abc",), ("",), (None,)], "t string")
    assert [r.g and sorted(r.g) for r in df.select(cd.grams("t").alias("g")).collect()] == [["abcd", "bcda", "cdab", "dabc"], [], [], None]
    counted = spark.createDataFrame([(1, 5, 4, 2), (1, 6, 4, 1), (1, 7, 9, 8), (1, 8, 1, 0)], "query int, pos int, n int, first int")
    assert [(r.pos, r.rank) for r in cd.top_candidates(counted, 2, 2).orderBy("rank").collect()] == [(7, 1), (6, 2)]
    corpus = spark.createDataFrame([(5,), (9,)], "pos int")
    extras = spark.createDataFrame([(1, 5, 1), (1, 9, 2), (1, 77, 3)], "query int, pos int, rank int")
    both = cd.with_extras(cd.top_candidates(counted, 2, 3), extras, corpus)
    assert [r.pos for r in both.orderBy("rank").collect()] == [7, 6, 5, 9]


def test_whole_check(spark):
    posts = [
        (1, "قال تعالى ﴿تسلق الراعي جبلا شاهقا يبحث عن غنمه﴾ صدق الله العظيم"),
        (2, "قال رسول الله: «من زرع شجرة فله ظلها وثمرها دائما»"),
        (3, "هذا نص عادي لا شأن له بما نبحث عنه هنا"),
        (4, "قال رسول الله: كلام لم يرد في اي مصدر من مصادرنا هذه"),
        (5, "قال رسول الله: قول ضعيف السند جاء في كتاب قديم واحد"),
        (6, None),
    ]
    rulings = [
        ("قول ضعيف السند جاء في كتاب قديم واحد", 0, "قول ضعيف السند جاء في كتاب قديم واحد", "س", "موضوع", "ك", "1", False),
        ("كلام لم يرد في اي مصدر من مصادرنا هذه", 0, None, None, None, None, None, True),
    ]
    found = check_posts(
        spark.createDataFrame(posts, "post_id int, text string"), verses(spark), spark.createDataFrame(REPORTS, "pos int, id string, text string"),
        spark.createDataFrame(rulings, "query string, ord int, text string, scholar string, ruling string, book string, page_or_number string, failed boolean"),
    )
    rows = {r.post_id: r for r in found.collect()}
    assert [v.kind for v in rows[1].verdicts] == ["quran_exact"] and rows[1].verdicts[0].key == "2:1"
    assert [v.kind for v in rows[2].verdicts] == ["hadith_authentic"] and rows[2].religious
    assert rows[3].verdicts == [] and not rows[3].religious
    assert rows[4].verdicts == [] and rows[4].incomplete
    assert [v.kind for v in rows[5].verdicts] == ["weak_or_fabricated"]
    assert rows[6].verdicts == [] and not rows[6].religious


def test_whole_texts(spark):
    report = "من زرع شجرة فله ظلها وثمرها دائما"
    texts = [(1, VERSES[3][3]), (2, "قال رسول الله: " + report), (3, "ab"), (4, None), (5, "لا علاقة لهذا الكلام بشيء مما سبق ذكره"), (6, "قول قصير السند جاء في كتاب قديم")]
    ruled = [(6, 0, "قول قصير السند جاء في كتاب قديم", "س", "ضعيف", "ك", "1")]
    out = verify_texts(
        spark.createDataFrame(texts, "query int, text string"), verses(spark), spark.createDataFrame(REPORTS, "pos int, id string, text string"),
        spark.createDataFrame(ruled, "query int, ord int, text string, scholar string, ruling string, book string, page_or_number string"),
    )
    got = {r.query: (r.status, r.origin, r.kind, r.confidence) for r in out.collect()}
    assert got == {
        1: ("ok", "verses", "quran_exact", "high"), 2: ("ok", "reports", "hadith_authentic", "high"), 3: ("needs_input", None, None, None),
        4: ("needs_input", None, None, None), 5: ("ok", None, "not_found", "low"), 6: ("ok", "rulings", "weak_or_fabricated", "high"),
    }


def test_distinct_texts(spark):
    texts, links = distinct_texts(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "post_id int, text string"))
    assert texts.count() == 2 and links.join(texts, "query").count() == 3


def test_running_offset(spark):
    df = spark.createDataFrame([(i, "x" * (i % 4)) for i in range(50)] + [(50, None)], "pos int, skeleton string")
    got = {r.pos: r.offset for r in cd.running_offset(df).collect()}
    assert all(got[i] == sum(j % 4 for j in range(i)) for i in range(51))
    assert cd.running_offset(df.where(F.lit(False))).count() == 0


NEAR_MISS = "تسلق الراعي تلا عاليا يبحث طويلا عن خرافه"  # between the semantic floor and the close threshold for verse 2:1


def meaning_of(spark, cosine):
    """Toy vectors: the near miss lies at ``cosine`` from the verse at position 3, other texts far from all."""
    from pyspark.sql import types as T

    @F.udf(T.ArrayType(T.DoubleType()))
    def embed(text):
        return [cosine, (1 - cosine**2) ** 0.5] if "تسلق" in text else [0.0, -1.0]

    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (6, [-1.0, 0.0])], "pos int, vector array<double>")
    return mt.Meaning(embed, verses=vectors, reports=spark.createDataFrame([(0, [1.0, 0.0])], "pos int, vector array<double>"))


def test_meaning_lifts_near_misses_only(spark):
    alone = search(spark, NEAR_MISS)
    assert 0.55 <= alone[0].similarity < 0.75 and alone[0].first == 3
    posts = spark.createDataFrame([(1, f"قال تعالى ﴿{NEAR_MISS}﴾"), (2, "قال تعالى ﴿كلام اخر لا علاقة له بشيء مما سبق ذكره﴾")], "post_id int, text string")
    reports = spark.createDataFrame(REPORTS, "pos int, id string, text string")
    for cosine, kind in ((0.93, "different_wording"), (0.80, "not_found"), (None, "not_found")):
        meaning = None if cosine is None else meaning_of(spark, cosine)
        rows = {r.post_id: [v.kind for v in r.verdicts] for r in check_posts(posts, verses(spark), reports, meaning=meaning).collect()}
        assert rows == {1: [kind], 2: ["not_found"]}
    service = verify_texts(spark.createDataFrame([(1, NEAR_MISS)], "query int, text string"), verses(spark), reports, meaning=meaning_of(spark, 0.93)).first()
    assert service.kind in ("different_wording", "not_found") and service.status == "ok"


def test_posts_framed_by_brackets_and_by_hand(spark):
    reports = spark.createDataFrame(REPORTS, "pos int, id string, text string")
    posts = spark.createDataFrame([(1, "﴿كلام اخر لا علاقة له بشيء مما سبق ذكره﴾"), (2, "abc"), (3, None)], "post_id int, text string")
    rows = {r.post_id: (r.religious, [(v.kind, v.origin) for v in r.verdicts]) for r in check_posts(posts, verses(spark), reports).collect()}
    assert rows == {1: (True, [("not_found", "none")]), 2: (False, []), 3: (False, [])}
    by_hand = {r.post_id: [(v.kind, v.checked) for v in r.verdicts] for r in check_posts(posts, verses(spark), reports, manual=True).collect()}
    assert by_hand[2] == [("not_found", "abc")] and by_hand[1][0][0] == "not_found"


def test_results_tell_where_to_look(spark):
    reports = spark.createDataFrame([(0, "77", REPORTS[0][2], "صحيح", "رواه فلان")], "pos int, id string, text string, grade string, attribution string")
    posts = spark.createDataFrame([(1, f"قال تعالى ﴿{VERSES[4][3]}﴾"), (2, "قال رسول الله: «من زرع شجرة فله ظلها وثمرها دائما»")], "post_id int, text string")
    rows = {r.post_id: r.verdicts[0] for r in check_posts(posts, verses(spark), reports).collect()}
    assert (rows[1].label, rows[1].url, rows[1].also_at) == ("سورة البقرة 2", "https://quranenc.com/ar/browse/english_saheeh/2#2", ["3:1"])
    assert rows[2].url == "https://hadeethenc.com/ar/browse/hadith/77" and (rows[2].rulings[0].ruling, rows[2].rulings[0].book) == ("صحيح", "رواه فلان")
    failed = spark.createDataFrame([(1, 0, None, None, None, None, None, True)], "query int, ord int, text string, scholar string, ruling string, book string, page_or_number string, failed boolean")
    texts = spark.createDataFrame([(1, "لا علاقة لهذا الكلام بشيء مما سبق ذكره"), (2, VERSES[3][3])], "query int, text string")
    out = {r.query: r for r in verify_texts(texts, verses(spark), reports, failed).collect()}
    assert out[1].status == "error" and out[1].kind is None
    assert out[2].status == "ok" and out[2].reference == "سورة البقرة · الآية 1" and out[2].note and out[2].correct is None


def test_held_and_joined_index_agree(spark):
    import random

    draw = random.Random(8)
    text = lambda n: "".join(draw.choice("abcde") for _ in range(n))
    corpus = spark.createDataFrame([(i, text(draw.randrange(60))) for i in range(80)] + [(99, None)], "pos int, skeleton string")
    asked = spark.createDataFrame([(i, text(draw.randrange(40))) for i in range(60)], "query int, skeleton string")
    for k, part in ((5, 0.0), (None, 0.0), (None, 0.3)):
        one, two = (sorted(map(tuple, cd.retrieve(asked, corpus, 2, k, part, held).collect())) for held in (10**6, 0))
        assert one == two and one
    assert cd.retrieve(asked, corpus.where(F.lit(False)), 2, 5).count() == 0


def test_shards_answer_as_one_index_without_shuffling_grams(spark):
    import random

    draw = random.Random(9)
    text = lambda n: "".join(draw.choice("abcd") for _ in range(n))
    corpus = spark.createDataFrame([(i, text(draw.randrange(60))) for i in range(90)] + [(99, None)], "pos int, skeleton string")
    asked = spark.createDataFrame([(f"q{i}", text(draw.randrange(40))) for i in range(50)], "query string, skeleton string")
    counted = cd.shared_grams(asked, cd.inverted_index(corpus))
    whole = sorted(map(tuple, cd.top_candidates(counted, 2, 4).select("query", "pos", "n", "rank").collect()))
    for letters in (10**6, 700):
        found = cd.retrieve(asked, corpus, 2, 4, held_letters=0, shard_letters=letters)
        assert sorted(map(tuple, found.collect())) == whole and found.schema["pos"].dataType.simpleString() == "int"
        assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
    every = {(r.query, r.pos, r.n) for r in cd.retrieve(asked, corpus, 3, None, held_letters=0, shard_letters=300).collect()}
    assert every == {(r.query, r.pos, r.n) for r in counted.where("n >= 3").collect()}
