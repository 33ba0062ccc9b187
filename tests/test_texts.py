from pyspark.sql import functions as F

from matnflow.functions import fragments as fr
from matnflow.functions import normalize as nm


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_fold_letters(spark):
    got = values(spark, ["الصَّلَاةِ", "الصلوٰة", "أإآٱ", "مؤمن شيء", "ﷺ", "a1 ب ت", "", None, "ـــ"], nm.fold_letters("t"))
    assert got == ["الصلاه", "الصلاه", "اااا", "مومن شي", "صلي الله عليه وسلم", "ب ت", "", None, ""]


def test_skeleton_and_counts(spark):
    assert values(spark, ["السلام عليكم", None], nm.skeleton("t")) == ["لسلمعليكم", None]
    assert values(spark, ["السلام عليكم", "!!", ""], nm.count_arabic_words("t")) == [2, 0, 0]


def test_other_forms(spark):
    assert values(spark, ["صحيحٌ  إسنادُه، ١٢"], nm.fold_report("t")) == ["صحيح اسناده، ١٢"]
    assert values(spark, ["صحيحٌ، إسنادُه ١٢"], nm.report_letters("t")) == ["صحيح اسناده"]
    assert values(spark, ["Café_12 x½", "ٱلۡحَمۡدُ"], nm.fold_any_script("t")) == ["café x½", "الحمد"]
    assert values(spark, ["ab\n قال  نعم \n."], nm.tidy_lines("t")) == ["قال نعم"]
    assert values(spark, ["<b>a</b><br/>&amp;&nbsp;b"], nm.strip_tags("t")) == ["a & b"]
    assert values(spark, ["<a>&\"'"], nm.escape_html("t")) == ["&lt;a&gt;&amp;&quot;&#39;"]
    assert values(spark, ["a b!(~)'*"], nm.encode_query("t")) == ["a%20b!(~)'*"]
    assert values(spark, ["{أ، ب}–‌"], nm.fix_labels("t")) == ["أ, ب-"]
    assert values(spark, [" 1 2 3 4 5 6 7 8 9 10 11 12 13", None, ""], nm.first_words("t")) == ["1 2 3 4 5 6 7 8 9 10 11 12", None, ""]
    assert values(spark, [" abc ", "abcd", None], nm.too_short("t")) == [True, False, True]


def test_wrap(spark):
    assert values(spark, ["aaa bbb  cc dddddddd e", "", None], nm.wrap("t", 7)) == [["aaa bbb", "cc", "dddddddd", "e"], [], None]


def test_clip_words(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = values(spark, ["short", text, "x" * 100, None], nm.clip_words("t", "i"))
    assert got[0] == "short" and 20 <= len(got[1]) <= 60 and got[1] in text and got[2] == "x" * 60 and got[3] is None


def test_quotes_and_parts(spark):
    assert values(spark, ['قال «أ ب» و "ج" ﴿د﴾ “ه”', "", None], fr.quotes("t")) == [["أ ب", "ج", "د", "ه"], [], None]
    assert values(spark, ["a\n\nb"], fr.paragraphs("t")) == [["a", "b"]]
    assert values(spark, ["a(b)c"], fr.bracket_parts("t")) == [["a", "b", "c"]]


def test_markers_and_framing(spark):
    posts = ["قال رسول الله ﷺ: إنما الأعمال بالنيات رواه البخاري", "نص عادي", None]
    assert values(spark, posts, fr.has_any("t", fr.REPORT_MARKERS)) == [True, False, False]
    assert values(spark, posts, fr.strip_framing("t")) == ["انما الاعمال بالنيات", "نص عادي", None]
    assert values(spark, posts, fr.strip_framing_original("t"))[0] == "إنما الأعمال بالنيات"
    assert values(spark, posts, fr.strip_framing_service("t"))[1:] == ["نص عادي", None]
    assert values(spark, ["قليل", "كلام طويل يكفي لذلك حقا"], fr.looks_arabic("t")) == [False, True]


def test_fragments(spark):
    post = "قال رسول الله: «الكلمة الطيبة صدقة لكم» (رواه مسلم)\nسطر آخر فيه حروف كثيرة جدا"
    df = spark.createDataFrame([(1, post, "x"), (2, None, "x"), (3, "قصير", "x")], "post_id int, text string, form string")
    rows = fr.fragments(df).orderBy("frag_no").collect()
    assert {r.post_id for r in rows} == {1}
    assert rows[0].fragment == "الكلمة الطيبة صدقة لكم" and rows[0].report_like
    assert not [r for r in rows if r.fragment.startswith("سطر")][0].report_like
    assert len({r.form for r in rows}) == len(rows)
    assert fr.fragments(df.where(F.lit(False))).count() == 0
