import numpy as np
from pyspark.sql import functions as F

from matnflow.operators import evaluation as ev
from matnflow.operators import images as im
from matnflow.operators import labels as lb
from matnflow.operators import rulings as rl
from matnflow.operators import vectors as vc
from matnflow.sources import binary, corpora, pages
from matnflow.streaming import feed


def test_ruling_classes(spark):
    cases = [
        ("صحيح", "authentic", "sahih"), ("إسناده حسن", "authentic", "sahih"), ("لا يصح", "fabricated", "weak"), ("ليس بصحيح", "weak", "weak"),
        ("ضعيف جدا", "weak", "weak"), ("موضوع", "fabricated", "weak"), ("صحيحة الإسناد", "authentic", "sahih"), ("فيه نظر", "unclassified", "other"),
        ("", "unclassified", "other"), (None, "unclassified", "other"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, r string")
    rows = df.select("i", rl.classify_ruling("r").alias("a"), rl.grade_service("r").alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in rows] == [c[1:] for c in cases]


def test_verdict_of_classes(spark):
    cases = [(["unclassified"], "rulings_verbatim"), ([], "rulings_verbatim"), (["authentic", "unclassified"], "hadith_authentic"), (["weak", "fabricated"], "weak_or_fabricated"), (["weak", "authentic"], "scholars_differed")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, c array<string>")
    assert [r.v for r in df.select("i", rl.verdict_of(F.col("c")).alias("v")).orderBy("i").collect()] == [c[1] for c in cases]


def test_snippets(spark):
    html = (
        '<div class="hadith">1 - متن <b>أول</b></div><div class="hadith-info"><span>الراوي:</span> فلان - <span>المحدث:</span> علان - '
        "<span>المصدر:</span> كتاب - <span>الصفحة أو الرقم:</span> 3/4 - <span>خلاصة حكم المحدث:</span> صحيح</div>"
    )
    df = spark.createDataFrame([(1, html + html.replace("أول", "ثان")), (2, ""), (3, None)], "k int, html string")
    for rows in (rl.parse_snippets(df), rl.parse_snippets_service(df, "k")):
        got = rows.orderBy("no").collect()
        assert [(r.k, r.text, r.narrator, r.scholar, r.book, r.page_or_number, r.ruling) for r in got] == [
            (1, f"متن {x}", "فلان", "علان", "كتاب", "3/4", "صحيح") for x in ("أول", "ثان")
        ]
    answers = spark.createDataFrame([('{"ahadith": {"result": "a"}}',), ('{"ahadith": [{"th": "b"}, {"th": "c"}, {}]}',), ("{}",), ("x",), (None,)], "j string")
    assert [r.h for r in answers.select(rl.result_html("j").alias("h")).collect()] == ["a", "bc", "", "", ""]


def test_checks_of_rulings(spark):
    text = "من زرع شجرة فله ظلها وثمرها دائما"
    rows = [
        (1, text, 0, text, "أ", "صحيح", "ك", "1"), (1, text, 1, text, "أ", "صحيح", "ك", "2"), (1, text, 2, text, "ب", "ضعيف", "ك", "1"),
        (2, text, 0, text, "أ", "حسن", "ك", "1"), (2, text, 1, "شيء آخر تماما لا صلة له", "ب", "موضوع", "ك", "1"),
        (3, text, 0, "شيء آخر تماما لا صلة له", "ب", "موضوع", "ك", "1"), (4, text, 0, text, "أ", None, None, None),
    ]
    df = spark.createDataFrame(rows, "query int, text_q string, ord int, text string, scholar string, ruling string, book string, page_or_number string")
    got = {r.query: r for r in rl.check_rulings(df).collect()}
    assert got[1].kind == "scholars_differed" and [x.scholar for x in got[1].rulings] == ["أ", "ب"]
    assert got[2].kind == "hadith_authentic" and len(got[2].rulings) == 1
    assert 3 not in got and 4 not in got
    service = {r.query: r for r in rl.check_rulings_service(df).collect()}
    assert {q: r.kind for q, r in service.items()} == {1: "scholars_differed", 2: "hadith_authentic", 3: "not_found", 4: "rulings_verbatim"}
    assert service[1].rulings == "أ: صحيح | أ: صحيح | ب: ضعيف" and service[3].confidence == "low"


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [-2.5, 127.0])], "pos long, vector array<double>")
    unit = {r.pos: r.v for r in df.select("pos", vc.normalise("vector").alias("v")).collect()}
    assert unit[1] == [0.6, 0.8] and unit[2] == [0.0, 0.0] and unit[3] is None
    q = {r.pos: r.q for r in df.select("pos", vc.quantise("vector").alias("q")).collect()}
    assert q[1].q == [95, 127] and q[2].q == [0, 0] and q[4].q == [-2, 127]  # a half is rounded up
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0]), (5, None)], "pos long, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.5]), (8, None)], "query long, vector array<double>")
    assert [(r.query, r.pos, r.score) for r in vc.top_k(asked, corpus, 2).orderBy("rank").collect()] == [(7, 1, 1.0), (7, 2, 1.0)]
    try:
        vc.check_shape(corpus, asked)
        raise AssertionError
    except ValueError:
        pass


def test_evaluation(spark):
    rows = [(i, f"f{i % 2}", f"f{i % 2}-{'Regular' if i == 4 else 'Bold'}{i}", "ar", i % 2 == 0, False, "card", False, 0.05 * i, i < 5) for i in range(8)]
    rows.append((8, "f0", None, "ar", None, None, None, None, None, None))
    df = spark.createDataFrame(rows, "row_id int, family string, font string, lang string, decorative boolean, heldout boolean, kind string, vowelled boolean, cer double, found boolean")
    report = {r.slice: r for r in ev.score_report(df).collect()}
    assert report["all"].n == 9 and abs(report["all"].accuracy - 82.5) < 1e-9 and report["photo"].n == 0 and report["photo"].accuracy is None
    assert {r.family: r.font for r in ev.one_per_family(df).collect()} == {"f0": "f0-Regular4", "f1": "f1-Bold1"}
    assert ev.modulo_split(df, "row_id").where("split = 'test'").count() == 1
    assert [r.row_id for r in ev.seeded_sample(df, "row_id", 3).collect()] == [r.row_id for r in ev.seeded_sample(df.repartition(3), "row_id", 3).collect()]
    q = spark.createDataFrame([("a", x) for x in (1, 2, 3, 10)] + [("b", None)], "g string, v int")
    assert [(r.g, r.quantile) for r in ev.lower_quantile(q, "g", "v").collect()] == [("a", 3)]
    assert {r.bin: r.n for r in ev.histogram(spark.createDataFrame([(0.0,), (0.99,), (7.0,), (None,)], "v double"), "v", 10).collect()} == {0: 1, 9: 2}


def test_pictures(spark, tmp_path):
    dark = np.full((60, 200), 230, np.uint8)
    for i in range(8):
        dark[20:35, 10 + 22 * i : 18 + 22 * i] = 30
    assert im.letter_height(dark, im.otsu(dark)) == 15
    assert sorted(im.components(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool))) == [(2, 1, 2), (3, 2, 3)]
    assert (im.dark_on_light(255 - dark) == dark).all() and (im.dark_on_light(dark) == dark).all()
    assert im.line_height(dark, 128) == 15.0
    picture, threshold, letters, scale = im.prepare(np.repeat(dark[:, :, None], 3, axis=2))
    assert letters == 15 and scale == 2.0 and picture.shape == (160, 440) and picture[0, 0] == 255
    (tmp_path / "a.pgm").write_bytes(im.write_pgm(dark))
    (tmp_path / "b.pgm").write_bytes(b"nothing")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.pgm"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in im.prepare_images(files).collect()}
    assert rows["a.pgm"].letters == 15 and rows["b.pgm"].error and rows["b.pgm"].content is None


def test_binary_vectors(spark, tmp_path):
    rows = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "v.npy").write_bytes(binary.write_npy(rows))
    got = binary.read_npy(spark, str(tmp_path / "v.npy")).orderBy("row").collect()
    assert [r.vector for r in got] == rows.tolist()
    df = spark.createDataFrame([(i, 0.5, [i, -i]) for i in range(5)], "pos long, scale float, q array<tinyint>")
    parts = binary.packed_parts(df, rows_a_part=3).orderBy("part").collect()
    assert len(parts) == 2
    (tmp_path / "p.bin").write_bytes(parts[0].content)
    back = binary.read_packed(spark, str(tmp_path / "p.bin")).orderBy("row").collect()
    assert [(r.scale, r.q) for r in back] == [(0.5, [i, -i]) for i in range(3)]


def test_corpora(spark, tmp_path):
    assert corpora.read_json_list(spark, str(tmp_path / "none*.json"), corpora.VERSE_SCHEMA).count() == 0
    (tmp_path / "s1.json").write_text('{"result": [{"sura": "1", "aya": "2", "arabic_text": "ب", "translation": "b"}, {"sura": "1", "aya": "1", "arabic_text": "ا"}]}', encoding="utf-8")
    (tmp_path / "s2.json").write_text('{"result": [{"sura": "2", "aya": "1", "arabic_text": "ج"}]}', encoding="utf-8")
    verses = corpora.read_suras(spark, str(tmp_path / "s*.json"))
    assert [(r.pos, r.sura, r.aya, r.text) for r in verses.orderBy("pos").collect()] == [(0, 1, 1, "ا"), (1, 1, 2, "ب"), (2, 2, 1, "ج")]
    assert corpora.check_whole(verses, 3).count() == 3
    try:
        corpora.check_whole(verses, 4).collect()
        raise AssertionError
    except Exception as e:
        assert "rows: 3" in str(e)
    corpora.write_json(verses, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    wanted = spark.createDataFrame([("1",), ("2",), ("2",), (None,), ("4",)], "id string")
    have = spark.createDataFrame([("1", "x"), ("9", "y")], "id string, text string")
    kept, todo = corpora.to_fetch(wanted, have)
    assert [r.id for r in kept.collect()] == ["1"] and sorted(r.id for r in todo.collect()) == ["2", "4"]

    def fetch(i):
        if i == "4":
            raise OSError("unreachable")
        return (f"text {i}",)

    got = {r.id: (r.text, r.failed) for r in corpora.fetch_batches(todo, fetch, "text string").collect()}
    assert got == {"2": ("text 2", False), "4": (None, True)}
    ids = spark.createDataFrame([("10", 0), ("9", 1), ("10", 2)], "id string, no int")
    assert [r.id for r in corpora.distinct_ids(ids).collect()] == ["9", "10"]
    assert [r.id for r in corpora.distinct_ids(ids, by_number=False).collect()] == ["10", "9"]


def test_pages(spark):
    html = '<div class="post x"><p class="body">first<br>line</p><img src="a" width="300"><img src="b" width="20"></div><div class="post"><p class="body">second'
    df = spark.createDataFrame([(1, html), (2, None)], "k int, html string")
    rows = pages.extract_posts(df, "k", "html", ("div", "class", "post"), ("p", "class", "body")).orderBy("no").collect()
    assert [(r.k, r.text, r.images) for r in rows] == [(1, "first\nline", ["a"]), (1, "second", [])]
    urls = spark.createDataFrame([("https://www.example.org/x",), ("https://badexample.org",), (None,)], "u string")
    assert [r.h for r in urls.select(pages.on_hosts("u", ["example.org"]).alias("h")).collect()] == [True, False, False]
    card = spark.range(1).select(pages.card_html(F.lit("k"), F.lit("<l>"), F.lit("a&b"), F.lit(None).cast("string")).alias("h")).first().h
    assert "&lt;l&gt;" in card and "a&amp;b" in card and "source" not in card
    assert spark.range(1).select(lb.label(F.lit("not_found"), "en").alias("x")).first().x == "Source not found"


def test_stream_resumes_without_doubling(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    post = "نص طويل يكفي لكي يفحص حقا رقم"
    for round_ in range(2):
        rows = [(round_ * 2, post), (round_ * 2 + 1, post), (0, post), (99, "قصير")]
        spark.createDataFrame(rows, "post_id int, text string").coalesce(1).write.mode("append").parquet(source)
        posts = spark.readStream.schema("post_id int, text string").parquet(source)
        run = feed.check_feed(feed.worth_checking(feed.new_posts(posts)), lambda b: b.select("post_id"), out, state, once=True)
        run.awaitTermination()
    assert sorted(r.post_id for r in spark.read.parquet(f"{out}/batch=*").collect()) == [0, 1, 2, 3]


def ruled_tables(folder, spark):
    """Tables of a report, and of rulings on it in words changed at the beginning; a reading of the report and one that only a ruling holds."""
    report = "من زرع شجرة فله ظلها وثمرها دائما ومن سقى عطشان في يوم حار كتب له اجر كبير عند ربه"
    other = "خير الناس انفعهم للناس واحب الاعمال سرور تدخله على قلب مسلم حزين او جائع فقير"
    enc = [(1, 0, "1", report)]
    held = [(10, report.replace("شجرة", "نخلة"), "أ", "صحيح"), (11, report, "ب", "ضعيف"), (12, other.replace("الناس", "العباد", 1), "ج", "موضوع")]
    spark.createDataFrame(enc, "rec_id long, pos int, id string, text string").write.parquet(f"{folder}/enc_hadith.parquet")
    held = spark.createDataFrame(held, "rec_id long, text string, scholar string, ruling string").withColumns({"book": F.lit("ك"), "page_or_number": F.lit("1")})
    held.write.parquet(f"{folder}/dorar_hadith.parquet")
    spark.createDataFrame([(1, 0, 1, 1, "طلع الصباح على الوادي البعيد فاستيقظ الرعاة")], "rec_id long, pos int, sura int, aya int, text string").write.parquet(f"{folder}/ayat.parquet")
    posts = [(1, "hadith", f"قال رسول الله ﷺ «{report}»"), (2, "hadith", f"قال رسول الله ﷺ «{other}»")]
    spark.createDataFrame(posts, "row_id long, source string, text string").write.parquet(f"{folder}/evaluate.parquet")
    return str(folder)


def test_rulings_reach_reworded_beginnings(spark, tmp_path):
    from matnflow.plans import catalogue

    d = ruled_tables(tmp_path, spark)
    assert [(r.query, r.kind, r.rulings) for r in catalogue.QUERIES["rul_check"](spark, d).collect()] == [(1, "scholars_differed", 2)]
    got = catalogue.QUERIES["rul_check_service"](spark, d).collect()
    assert [(r.query, r.kind, r.rulings) for r in got] == [(1, "scholars_differed", "ب: ضعيف | أ: صحيح")]


def test_registered_pipelines_read_rulings(spark, tmp_path):
    from matnflow.plans import catalogue

    d = ruled_tables(tmp_path, spark)
    kinds = {r.post_id: r.kind for r in catalogue.QUERIES["check_all"](spark, d).collect()}
    assert kinds == {1: "hadith_authentic", 2: "weak_or_fabricated"}
    told = {r.query: (r.origin, r.kind) for r in catalogue.QUERIES["verify_all"](spark, d).collect()}
    assert told == {1: ("reports", "hadith_authentic"), 2: ("rulings", "weak_or_fabricated")}
