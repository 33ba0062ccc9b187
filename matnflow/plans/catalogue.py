"""Queries of the core operators over the driver's tables, and their SQL.

Every query reads its whole tables. Where an operator is beyond SQL (alignment kernels,
ordered folds, parsers) there is no SQL; those are tested against brute force in tests/.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fragments as fr
from ..functions import kernels as kn
from ..functions import normalize as nm
from ..operators import candidates as cd
from ..operators import evaluation as ev
from ..operators import labels as lb
from ..operators import match as mt
from ..operators import rulings as rl
from ..operators import vectors as vc
from ..operators import verdicts as vd
from ..profiles import SERVICE
from ..session import keep_apart, scratch, spread, table
from ..sources import corpora as cp
from ..sources import pages as pg
from ..streaming import feed as st
from .pipeline import check_posts, distinct_texts, verify_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# Fixed values of the matching forms, as DuckDB writes them.
_MARKS = r"[\x{610}-\x{61a}\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6ed}\x{8d3}-\x{8ff}\x{640}]"
_VOWELS = r"[\x{610}-\x{61a}\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6ed}\x{640}]"
_SPACE = r"[\t-\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def sql() -> dict[str, str]:
    return dict(_SQL)


def s_squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '{_SPACE}', ' ', 'g'))"


def s_fold(t: str) -> str:
    x = f"replace(replace({t}, 'ﷺ', ' صلى الله عليه وسلم '), 'وٰ', 'ا')"
    x = f"regexp_replace(translate({x}, 'ۧ', 'ي'), '{_MARKS}', '', 'g')"
    x = f"translate({x}, 'آأإٱٲٳٵىةؤئء', 'ااااااايهوي')"
    return rf"trim(regexp_replace({x}, '[^\x{{622}}-\x{{64a}}]+', ' ', 'g'))"


def s_skeleton(t: str) -> str:
    return f"translate({s_fold(t)}, 'ا ', '')"


def s_report(t: str) -> str:
    return s_squeeze(f"translate(regexp_replace({t}, '{_VOWELS}', '', 'g'), 'إأآٱىة', 'اااايه')")


def s_letters(t: str) -> str:
    return s_squeeze(rf"regexp_replace({s_report(t)}, '[^\x{{621}}-\x{{64a}}\s]', ' ', 'g')")


def s_plain(t: str) -> str:
    return rf"regexp_replace(translate({t}, 'ٱ', 'ا'), '{_VOWELS}', '', 'g')"


def s_any(t: str) -> str:
    return rf"trim(regexp_replace(lower(translate({s_plain(t)}, 'إأآىةؤئ', 'ااايهوي')), '[^\pL\p{{Nl}}\p{{No}}]+', ' ', 'g'))"


def s_has(form: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(concat(' ', {form}, ' '), ' {p} ')" for p in phrases) + ")"


def s_begins(form: str) -> str:
    return f"(contains(concat(' ', {form}), ' صحيح') OR contains(concat(' ', {form}), ' حسن'))"


def s_class(form: str) -> str:
    return (
        f"CASE WHEN {s_has(form, rl.FABRICATED)} THEN 'fabricated' WHEN {s_has(form, rl.WEAK)} THEN 'weak' "
        f"WHEN {s_has(form, rl.AUTHENTIC)} OR {s_begins(form)} THEN 'authentic' ELSE 'unclassified' END"
    )


# ---------------------------------------------------------------- normal forms


@query(f"SELECT rec_id, {s_fold('text')} AS form FROM dorar_hadith")
def norm_fold_letters(spark, d):
    return table(spark, d, "dorar_hadith").select("rec_id", nm.fold_letters("text").alias("form"))


@query(
    f"SELECT rec_id, {s_skeleton('text')} AS skeleton, length({s_skeleton('text')})::INTEGER AS letters, "
    f"CASE WHEN {s_fold('text')} = '' THEN 0 ELSE len(string_split({s_fold('text')}, ' ')) END::INTEGER AS words FROM ayat WHERE text IS NOT NULL"
)
def norm_skeleton(spark, d):
    t = table(spark, d, "ayat").where("text IS NOT NULL")
    return t.select("rec_id", nm.skeleton("text").alias("skeleton"), nm.arabic_length("text").alias("letters"), nm.count_arabic_words("text").alias("words"))


@query(f"SELECT rec_id, {s_report('text')} AS light, {s_letters('text')} AS letters FROM enc_hadith")
def norm_report(spark, d):
    return table(spark, d, "enc_hadith").select("rec_id", nm.fold_report("text").alias("light"), nm.report_letters("text").alias("letters"))


@query(f"SELECT row_id, {s_plain('text')} AS plain, {s_any('text')} AS form FROM evaluate")
def norm_any_script(spark, d):
    return table(spark, d, "evaluate").select("row_id", nm.plain_arabic("text").alias("plain"), nm.fold_any_script("text").alias("form"))


@query(
    "SELECT row_id, array_to_string(list_filter(list_transform(string_split(ocr, chr(10)), lambda l: "
    + s_squeeze("l")
    + r"), lambda x: length(regexp_replace(x, '[^\x{621}-\x{64a}]', '', 'g')) >= 3), chr(10)) AS tidy FROM evaluate WHERE ocr IS NOT NULL"
)
def norm_tidy_lines(spark, d):
    return table(spark, d, "evaluate").where("ocr IS NOT NULL").select("row_id", nm.tidy_lines("ocr").alias("tidy"))


@query(
    "SELECT doc_id, "
    + s_squeeze("replace(replace(replace(regexp_replace(regexp_replace(text, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&quot;', '\"'), '&amp;', '&')")
    + " AS plain FROM documents"
)
def norm_strip_tags(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", nm.strip_tags("text").alias("plain"))


_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"SELECT doc_id, {_ESCAPED.format('text')} AS html FROM documents")
def norm_escape_html(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", nm.escape_html("text").alias("html"))


_FIRST = "array_to_string(list_filter(regexp_split_to_array(text, '" + _SPACE + "'), lambda w: w <> '')[1:12], ' ')"


@query(f"SELECT rec_id, {_FIRST} AS lookup FROM dorar_hadith WHERE text IS NOT NULL")
def norm_first_words(spark, d):
    return table(spark, d, "dorar_hadith").where("text IS NOT NULL").select("rec_id", nm.first_words("text").alias("lookup"))


@query(
    "SELECT rec_id, replace(replace(replace(replace(replace(url_encode(grade), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS query FROM enc_hadith"
)
def norm_encode_query(spark, d):
    return table(spark, d, "enc_hadith").select("rec_id", nm.encode_query("grade").alias("query"))


@query("SELECT row_id, translate(text, '،–‌{}﴿﴾', ',-') AS label FROM evaluate")
def norm_fix_labels(spark, d):
    return table(spark, d, "evaluate").select("row_id", nm.fix_labels("text").alias("label"))


@query()
def norm_clip_words(spark, d):
    return table(spark, d, "dorar_hadith").select("rec_id", nm.clip_words("text", "rec_id").alias("clip"))


@query(f"SELECT row_id, coalesce(length({s_squeeze('text')}), 0) < 4 AS short FROM evaluate")
def norm_too_short(spark, d):
    return table(spark, d, "evaluate").select("row_id", nm.too_short("text").alias("short"))


_NAME = "coalesce((" + repr(lb.SURAS) + ")[sura], sura::VARCHAR)"


@query(f"SELECT rec_id, 'سورة ' || {_NAME} || ' · الآية ' || aya AS label, 'https://quranenc.com/ar/browse/english_saheeh/' || sura || '#' || aya AS url FROM ayat")
def norm_verse_label(spark, d):
    return table(spark, d, "ayat").select("rec_id", lb.verse_label("sura", "aya", "aya").alias("label"), lb.verse_url("sura", "aya").alias("url"))


# ---------------------------------------------------------------- fragments


@query(
    f"SELECT rec_id, unnest(list_transform(regexp_extract_all(text, '{fr.QUOTES}'), lambda q: substr(q, 2, length(q) - 2))) AS quote FROM dorar_hadith"
)
def frag_quotes(spark, d):
    return table(spark, d, "dorar_hadith").select("rec_id", F.explode(fr.quotes("text")).alias("quote"))


@query("SELECT doc_id, unnest(regexp_split_to_array(text, chr(10) || '+')) AS paragraph FROM documents WHERE text IS NOT NULL")
def frag_paragraphs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(fr.paragraphs("text")).alias("paragraph"))


@query("SELECT rec_id, unnest(regexp_split_to_array(text, '[()]+')) AS part FROM dorar_hadith WHERE text IS NOT NULL")
def frag_brackets(spark, d):
    return table(spark, d, "dorar_hadith").select("rec_id", F.explode(fr.bracket_parts("text")).alias("part"))


@query(
    f"SELECT rec_id, coalesce(len(list_filter({fr.REPORT_MARKERS!r}, lambda m: contains({s_fold('text')}, m))) > 0, false) AS report_like, "
    f"coalesce(len(list_filter({fr.VERSE_MARKERS!r}, lambda m: contains({s_fold('text')}, m))) > 0, false) AS verse_like, "
    f"coalesce(length({s_skeleton('text')}), 0) >= 12 AS arabic FROM dorar_hadith"
)
def frag_markers(spark, d):
    t = table(spark, d, "dorar_hadith")
    return t.select("rec_id", fr.has_any("text", fr.REPORT_MARKERS).alias("report_like"), fr.has_any("text", fr.VERSE_MARKERS).alias("verse_like"), fr.looks_arabic("text").alias("arabic"))


_STRIPPED = s_fold("text")
for _p in fr.LEAD_INS + fr.TAILS:
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_p}', '')"


@query(f"SELECT rec_id, trim({_STRIPPED}) AS core FROM enc_hadith")
def frag_strip_framing(spark, d):
    return table(spark, d, "enc_hadith").select("rec_id", fr.strip_framing("text").alias("core"))


_SERVICE = s_squeeze("translate(replace(text, 'ﷺ', ' صلى الله عليه وسلم '), 'إأآ', 'ااا')")
for _p in fr.SERVICE_LEAD_INS + fr.SERVICE_TAILS:
    _SERVICE = f"regexp_replace({_SERVICE}, '{_p}', '')"


@query(f"SELECT rec_id, trim({_SERVICE}, ' :،.\"«»“”') AS core FROM enc_hadith")
def frag_strip_framing_service(spark, d):
    return table(spark, d, "enc_hadith").select("rec_id", fr.strip_framing_service("text").alias("core"))


_WORDS = "list_filter(regexp_split_to_array(replace(text, 'ﷺ', ' '), '" + _SPACE + "'), lambda w: w <> '')"
_KEPT = (
    f"SELECT rec_id, text, {_WORDS} AS w, list_transform({_WORDS}, lambda w: {s_fold('w')}) AS f, list_filter(string_split(trim({_STRIPPED}), ' '), lambda w: w <> '') AS c FROM enc_hadith"
)
_AFTER = "list_filter(f[i + 1:], lambda x: x <> '')[1]"
_BEGINS = f"coalesce(list_filter(range(1, len(f) + 1), lambda i: f[i] = c[1] AND (len(c) < 2 OR {_AFTER} = c[2]))[1], 1)"
_ENDS_AT = "coalesce(list_filter(range(b, len(f) + 1), lambda i: f[i] = c[-1])[-1], len(f))"


@query(
    f"SELECT rec_id, CASE WHEN text IS NULL THEN NULL WHEN len(c) = 0 THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(array_to_string(w[b:{_ENDS_AT}], ' '), '^[«\"“﴿(\\[]+', ''), "
    f"'[»\"”﴾)\\].،:]+$', ''), '^\\s+|\\s+$', '', 'g') END AS core FROM (SELECT *, {_BEGINS} AS b FROM ({_KEPT}))"
)
def frag_original_core(spark, d):
    return table(spark, d, "enc_hadith").select("rec_id", fr.strip_framing_original("text").alias("core"))


_ENDS = r"regexp_replace({0}, '^[\s\x{{a0}}\x{{85}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x{{a0}}\x{{85}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"


@query(
    "WITH base AS (SELECT rec_id AS post_id, replace(text, 'ﷺ', ' صلى الله عليه وسلم ') AS post FROM dorar_hadith WHERE text IS NOT NULL), "
    f"cutup AS (SELECT post_id, post, list_transform(list_transform(regexp_extract_all(post, '{fr.QUOTES}'), lambda q: substr(q, 2, length(q) - 2)), lambda p: {_ENDS.format('p')}) AS marked FROM base), "
    "pieces AS (SELECT post_id, post, marked, list_concat(marked, list_transform(list_concat(regexp_split_to_array(post, chr(10) || '+'), "
    f"regexp_split_to_array(post, '[()]+'), [post]), lambda p: {_ENDS.format('p')})) AS l FROM cutup), "
    "rows AS (SELECT post_id, post, marked, unnest(l) AS fragment, generate_subscripts(l, 1) AS no FROM pieces), "
    f"formed AS (SELECT *, {s_fold('fragment')} AS form FROM rows WHERE fragment <> ''), "
    "kept AS (SELECT *, row_number() OVER (PARTITION BY post_id, form ORDER BY no) AS k FROM formed WHERE length(translate(form, 'ا ', '')) >= 12) "
    f"SELECT post_id, fragment, form, len(list_filter({fr.REPORT_MARKERS!r}, lambda m: contains({s_fold('post')}, m))) > 0 "
    f"AND (list_contains(marked, fragment) OR len(list_filter({fr.REPORT_MARKERS!r}, lambda m: contains(form, m))) > 0) AS report_like, "
    f"len(list_filter({fr.VERSE_MARKERS!r}, lambda m: contains({s_fold('post')}, m))) > 0 OR contains(post, '﴿') AS verse_like FROM kept WHERE k = 1"
)
def frag_fragments(spark, d):
    return fr.fragments(spread(table(spark, d, "dorar_hadith").select("rec_id", "text")), "rec_id").drop("frag_no")


# ---------------------------------------------------------------- retrieval


def _verses(spark, d):
    return mt.with_skeleton(spread(table(spark, d, "ayat").select("pos", "sura", "aya", "text", "translation")))


def _reports(spark, d):
    return mt.with_skeleton(spread(table(spark, d, "enc_hadith").select("pos", "id", "text", "grade", "attribution")))


def _asked(spark, d):
    """Every text of evaluate."""
    return mt.with_skeleton(table(spark, d, "evaluate").select(F.col("row_id").alias("query"), "text")).select("query", "skeleton")


_GRAMS = "SELECT DISTINCT {key}, substr(s, i, 4) AS gram FROM (SELECT {key}, s, unnest(range(1, length(s) - 2)) AS i FROM ({source}))"


@query(
    "SELECT gram, count(*) AS df FROM ("
    + _GRAMS.format(key="pos", source=f"SELECT pos, coalesce({s_skeleton('text')}, '') AS s FROM ayat")
    + ") GROUP BY gram"
)
def cand_index_df(spark, d):
    return cd.inverted_index(_verses(spark, d)).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def _topk_sql(corpus: str, least: int, k: int) -> str:
    asked = f"SELECT row_id AS query, coalesce({s_skeleton('text')}, '') AS s FROM evaluate"
    held = f"SELECT pos, coalesce({s_skeleton('text')}, '') AS s FROM {corpus}"
    return (
        f"WITH q AS (SELECT query, substr(s, i, 4) AS gram, min(i) AS place FROM (SELECT query, s, unnest(range(1, length(s) - 2)) AS i FROM ({asked}) WHERE length(s) >= 12) GROUP BY ALL), "
        f"c AS ({_GRAMS.format(key='pos', source=held)}), "
        f"n AS (SELECT query, pos, count(*) AS n, min(place) AS first FROM q JOIN c USING (gram) GROUP BY ALL HAVING count(*) >= {least}), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, first, pos) AS rank FROM n) "
        f"SELECT query, pos, n, rank::INTEGER AS rank FROM r WHERE rank <= {k}"
    )


@query(_topk_sql("ayat", 2, 15))
def cand_verse_topk(spark, d):
    asked = spread(_asked(spark, d)).where("length(skeleton) >= 12")
    return cd.retrieve(asked, _verses(spark, d), 2, 15)


@query(_topk_sql("enc_hadith", 3, 10))
def cand_report_topk(spark, d):
    texts, rows = distinct_texts(spread(_asked(spark, d)).where("length(skeleton) >= 12"), "skeleton", "no")
    found = cd.retrieve(keep_apart(texts, "no"), _reports(spark, d), 3, 10, query="no")
    return rows.select("query", "no").join(found, "no").drop("no")


@query(
    "SELECT vec_id, coalesce(p, -1)::INTEGER AS position FROM vectors LEFT JOIN (SELECT id, max(pos) AS p FROM enc_hadith GROUP BY id) USING (id) WHERE corpus = 'hadith'"
)
def cand_positions(spark, d):
    ids = table(spark, d, "vectors").where("corpus = 'hadith'").select("vec_id", "id")
    return cd.positions_of(ids, table(spark, d, "enc_hadith").select("id", "pos")).select("vec_id", "position")


_WINDOW = (
    "SELECT a.pos, string_agg(b.s, '|' ORDER BY b.pos) AS joined, count(*) AS n FROM ayat a JOIN "
    f"(SELECT pos, sura, coalesce({s_skeleton('text')}, '') AS s FROM ayat) b ON b.pos BETWEEN a.pos - 2 AND a.pos + 3"
)


def _windows(spark, d, same):
    w = cd.neighbours(_verses(spark, d), same=same)
    return w.select("pos", F.array_join(F.transform("window", lambda x: x["skeleton"]), "|").alias("joined"), F.size("window").cast("long").alias("n"))


@query(f"{_WINDOW} GROUP BY a.pos")
def cand_neighbours(spark, d):
    return _windows(spark, d, None)


@query(f"{_WINDOW} AND a.sura = b.sura GROUP BY a.pos")
def cand_neighbours_within(spark, d):
    return _windows(spark, d, "sura")


@query(f"SELECT pos, coalesce(sum(coalesce(length({s_skeleton('text')}), 0)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM ayat")
def cand_running_offset(spark, d):
    return cd.running_offset(_verses(spark, d)).select("pos", F.col("offset").cast("long").alias("offset"))


# ---------------------------------------------------------------- kernels and search


def s_letter_bytes(form: str) -> str:
    """A folded form with a byte a letter, as DuckDB's edit distance counts bytes."""
    return f"translate({form}, 'ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')"


_READ = f"(SELECT row_id, {s_letter_bytes(s_any('text'))} AS a, {s_letter_bytes(s_any('ocr'))} AS b FROM evaluate WHERE text IS NOT NULL AND ocr IS NOT NULL)"
_ALIKE = "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END"


@query(f"SELECT row_id, round({_ALIKE}, 9) AS similarity, round(levenshtein(a, b) / greatest(length(a), 1), 9) AS rate FROM {_READ}")
def kern_similarity(spark, d):
    t = table(spark, d, "evaluate").where("text IS NOT NULL AND ocr IS NOT NULL")
    t = t.select("row_id", nm.fold_any_script("text").alias("text"), nm.fold_any_script("ocr").alias("ocr"))
    return t.select("row_id", F.round(kn.similarity("text", "ocr"), 9).alias("similarity"), F.round(kn.error_rate("text", "ocr"), 9).alias("rate"))


def _read_pairs(spark, d):
    t = spread(table(spark, d, "evaluate").where("text IS NOT NULL AND ocr IS NOT NULL").select("row_id", "text", "ocr"))
    return t.select("row_id", nm.skeleton("text").alias("a"), nm.skeleton("ocr").alias("b"))


def s_nearest(pattern: str, text: str) -> str:
    """[distance, end] of the substring of ``text`` nearest to ``pattern``: the table of distances, a row a letter of the text."""
    inner = (
        f"list_reduce(list_transform(range(1, length({pattern}) + 1), lambda i: [i]), lambda row, i: list_append(row, "
        f"least(acc[i[1]] + ({pattern}[i[1]] <> {text}[j[1]])::BIGINT, row[-1] + 1, acc[i[1] + 1] + 1)), [0::BIGINT])"
    )
    step = f"list_transform([{inner}], lambda r: list_concat(r, [least(acc[-2], r[-1]), CASE WHEN r[-1] < acc[-2] THEN j[1] ELSE acc[-1] END]))[1]"
    start = f"list_concat(range(0, length({pattern}) + 1), [length({pattern}), 0])"
    return f"list_reduce(list_transform(range(1, length({text}) + 1), lambda j: [j]), lambda acc, j: {step}, {start})[-2:]"


_PAIRS = f"SELECT row_id, {s_skeleton('text')} AS a, {s_skeleton('ocr')} AS b FROM evaluate WHERE text IS NOT NULL AND ocr IS NOT NULL"
_SHARE = "CASE WHEN length({p}) = 0 THEN 0.0 ELSE greatest(0.0, 1 - {d} / length({p})) END"


@query(
    f"SELECT row_id, round({_SHARE.format(p='b', d='n[1]')}, 9) AS contained, round(CASE WHEN a = '' OR b = '' THEN 0.0 ELSE {_SHARE.format(p='s', d='e[1]')} END, 9) AS either FROM "
    f"(SELECT *, {s_nearest('b', 'a')} AS n, {s_nearest('s', 'l')} AS e FROM (SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM ({_PAIRS})))"
)
def kern_containment(spark, d):
    pairs = _read_pairs(spark, d)
    return pairs.select("row_id", F.round(kn.containment_udf("b", "a"), 9).alias("contained"), F.round(kn.either_containment_udf("a", "b"), 9).alias("either"))


@query(
    f"SELECT row_id, n[1]::INTEGER AS distance, (n[2] - {s_nearest('rb', 'ra')}[2])::INTEGER AS \"start\", n[2]::INTEGER AS \"end\" FROM "
    f"(SELECT *, reverse(b) AS rb, reverse(substr(a, 1, n[2])) AS ra FROM (SELECT *, {s_nearest('b', 'a')} AS n FROM ({_PAIRS})))"
)
def kern_locate(spark, d):
    return _read_pairs(spark, d).select("row_id", kn.locate_udf("b", "a").alias("at")).select("row_id", "at.*")


@query()
def kern_partial_ratio(spark, d):
    return _read_pairs(spark, d).select("row_id", F.round(kn.partial_ratio_udf("a", "b"), 9).alias("ratio"))


@query()
def kern_sequence_ratio(spark, d):
    return _read_pairs(spark, d).select("row_id", F.round(kn.sequence_ratio_udf("a", "b"), 9).alias("ratio"))


def s_cells() -> str:
    """CTEs over ``pairs`` (id, p, t): ``nearest`` (id, d), the distance of the substring of t nearest to p.

    The table of distances, a row for each letter of p, advanced a letter of t at a time.
    """
    return (
        "cells AS (SELECT id, 0 AS j, i, i AS d FROM (SELECT id, unnest(range(1, length(p) + 1)) AS i FROM pairs) UNION ALL "
        "SELECT id, j + 1, i, least(i, i + min(tmp - i) OVER (PARTITION BY id ORDER BY i)) FROM (SELECT id, j, i, "
        "least(d + 1, coalesce(lag(d) OVER (PARTITION BY id ORDER BY i), 0) + (p[i] <> t[j + 1])::INT) AS tmp FROM cells JOIN pairs USING (id) WHERE j < length(t))), "
        "nearest AS (SELECT id, min(d) AS d FROM cells JOIN pairs USING (id) WHERE i = length(p) GROUP BY id)"
    )


_FOUND_REPORTS = (
    f"WITH RECURSIVE a AS MATERIALIZED (SELECT row_id, coalesce(translate(trim({_STRIPPED}), 'ا ', ''), '') AS s FROM evaluate), "
    "q AS (SELECT s, substr(s, i, 4) AS gram, min(i) AS place FROM (SELECT s, unnest(range(1, length(s) - 2)) AS i FROM (SELECT DISTINCT s FROM a WHERE length(s) >= 12)) GROUP BY ALL), "
    f"h AS MATERIALIZED (SELECT pos, coalesce({s_skeleton('text')}, '') AS t FROM enc_hadith), "
    f"g AS ({_GRAMS.format(key='pos', source='SELECT pos, t AS s FROM h')}), "
    "n AS (SELECT s, pos, count(*) AS n, min(place) AS first FROM q JOIN g USING (gram) GROUP BY ALL HAVING count(*) >= 3), "
    "r AS (SELECT s, pos, row_number() OVER (PARTITION BY s ORDER BY n DESC, first, pos) AS rank FROM n QUALIFY rank <= 10), "
    f"pairs AS MATERIALIZED (SELECT row_number() OVER () AS id, s AS p, t, pos, rank FROM r JOIN h USING (pos)), {s_cells()}, "
    "o AS (SELECT p, pos, 1 - d / length(p) AS similarity FROM nearest JOIN pairs USING (id) QUALIFY row_number() OVER (PARTITION BY p ORDER BY d, rank) = 1) "
    "SELECT row_id AS query, pos, round(greatest(similarity, 0.0), 9) AS similarity FROM a JOIN o ON a.s = o.p"
)


def _once(spark, d, form, search):
    """``search`` of the distinct forms of evaluate's texts, told for every row."""
    rows = table(spark, d, "evaluate").select(F.col("row_id").alias("row"), F.coalesce(form("text"), F.lit("")).alias("skeleton"))
    texts, rows = distinct_texts(rows, "skeleton")
    hits = search(keep_apart(texts, "query"))
    return rows.select("row", "query").join(hits, "query").drop("query").withColumnRenamed("row", "query")


@query()
def find_verses(spark, d):
    hits = _once(spark, d, nm.skeleton, lambda asked: mt.search_verses(asked, _verses(spark, d)))
    return hits.select("query", F.round("similarity", 9).alias("similarity"), "first", "last", F.size("also_at").alias("elsewhere"))


@query()
def find_verses_service(spark, d):
    hits = _once(spark, d, nm.skeleton, lambda asked: mt.search_verses(asked, _verses(spark, d), profile=SERVICE))
    return hits.select("query", F.round("similarity", 9).alias("similarity"), "first", "last")


@query(_FOUND_REPORTS)
def find_reports(spark, d):
    hits = _once(spark, d, lambda t: nm.skeleton(fr.strip_framing(t)), lambda asked: mt.search_reports(asked, _reports(spark, d)))
    return hits.select("query", "pos", F.round("similarity", 9).alias("similarity"))


@query()
def find_reports_service(spark, d):
    hits = _once(spark, d, lambda t: nm.skeleton(fr.strip_framing_service(t)), lambda asked: mt.search_reports(asked, _reports(spark, d), SERVICE))
    return hits.select("query", "pos", F.round("similarity", 9).alias("similarity"))


@query(
    f"SELECT row_id, CASE WHEN s >= 0.97 THEN 'quran_exact' WHEN s >= 0.75 THEN 'different_wording' END AS kind, CASE WHEN s >= 0.9 THEN 'high' ELSE 'medium' END AS confidence "
    f"FROM (SELECT row_id, {_ALIKE} AS s FROM {_READ})"
)
def verdict_case(spark, d):
    t = table(spark, d, "evaluate").where("text IS NOT NULL AND ocr IS NOT NULL")
    s = t.select("row_id", nm.fold_any_script("text").alias("a"), nm.fold_any_script("ocr").alias("b")).withColumn("s", kn.similarity("a", "b"))
    return s.select("row_id", vd.verse_kind("s").alias("kind"), vd.confidence("s").alias("confidence"))


# ---------------------------------------------------------------- rulings


@query(f"SELECT rec_id, {s_class('f')} AS class FROM (SELECT rec_id, coalesce({s_fold('ruling')}, '') AS f FROM dorar_hadith)")
def rul_classify(spark, d):
    return table(spark, d, "dorar_hadith").select("rec_id", rl.classify_ruling("ruling").alias("class"))


@query(
    f"SELECT rec_id, CASE WHEN {s_has('f', rl.FABRICATED + rl.WEAK)} THEN 'weak' WHEN {s_has('f', rl.AUTHENTIC)} OR {s_begins('f')} THEN 'sahih' ELSE 'other' END AS grade "
    f"FROM (SELECT rec_id, coalesce({s_letters('ruling')}, '') AS f FROM dorar_hadith)"
)
def rul_grade_service(spark, d):
    return table(spark, d, "dorar_hadith").select("rec_id", rl.grade_service("ruling").alias("grade"))


@query(
    f"SELECT scholar, CASE WHEN sum((c <> 'unclassified')::INT) = 0 THEN 'rulings_verbatim' WHEN sum((c NOT IN ('unclassified', 'authentic'))::INT) = 0 THEN 'hadith_authentic' "
    f"WHEN sum((c = 'authentic')::INT) = 0 THEN 'weak_or_fabricated' ELSE 'scholars_differed' END AS verdict FROM "
    f"(SELECT scholar, {s_class('f')} AS c FROM (SELECT scholar, coalesce({s_fold('ruling')}, '') AS f FROM dorar_hadith)) GROUP BY scholar"
)
def rul_verdict_of_set(spark, d):
    t = table(spark, d, "dorar_hadith").select("scholar", rl.classify_ruling("ruling").alias("c"))
    return t.groupBy("scholar").agg(F.collect_set("c").alias("cs")).select("scholar", rl.verdict_of(F.col("cs")).alias("verdict"))


@query(
    "SELECT scholar, ruling, book, rec_id FROM (SELECT *, row_number() OVER (PARTITION BY scholar, ruling, book ORDER BY rec_id) AS k FROM dorar_hadith WHERE coalesce(ruling, '') <> '') WHERE k = 1"
)
def rul_keep_first(spark, d):
    t = table(spark, d, "dorar_hadith").where("coalesce(ruling, '') <> ''")
    return t.groupBy("scholar", "ruling", "book").agg(F.min("rec_id").alias("rec_id"))


def _snippets(spark, d):
    t = table(spark, d, "dorar_hadith").where("text IS NOT NULL").select("rec_id", "text", "narrator", "scholar", "book", "page_or_number", "ruling")
    parts = [F.lit('<div class="hadith">1 - '), nm.escape_html("text"), F.lit('</div><div class="hadith-info">')]
    for field, label in rl.FIELDS.items():
        parts += [F.lit(f"<span>{label}:</span> "), F.coalesce(F.col(field), F.lit("")), F.lit(" - ")]
    return t.select("rec_id", F.concat(*parts, F.lit("</div>")).alias("html"))


_FIELD = r"coalesce(trim(regexp_replace({0}, '\s*-\s*$', '')), '')"
_TOLD = ", ".join(f"{_FIELD.format(s_squeeze(f))} AS {f}" for f in rl.FIELDS)
_BODY = s_squeeze("replace(replace(replace(text, '<', '&lt;'), '>', '&gt;'), '''', '&#39;')")


@query(f"SELECT rec_id, 0 AS no, {_BODY} AS text, {_TOLD} FROM dorar_hadith WHERE text IS NOT NULL AND {_BODY} <> ''")
def rul_parse_snippets(spark, d):
    payload = F.to_json(F.struct(F.struct(F.col("html").alias("result")).alias("ahadith")))
    answers = _snippets(spark, d).select("rec_id", rl.result_html(payload).alias("html"))
    return rl.parse_snippets(answers).select("rec_id", "no", "text", *rl.FIELDS)


@query()
def rul_parse_snippets_service(spark, d):
    return rl.parse_snippets_service(_snippets(spark, d), "rec_id")


def _records(spark, d):
    return table(spark, d, "dorar_hadith").select(F.col("rec_id").alias("ord"), "text", "scholar", "ruling", "book", "page_or_number")


def _lookup(spark, d):
    """Reports with the ruling records that a lookup finds."""
    reports = table(spark, d, "enc_hadith").select(F.col("rec_id").alias("query"), F.col("text").alias("text_q"))
    return rl.local_rulings(reports, _records(spark, d))


_CHECKED = (
    f"WITH RECURSIVE q AS MATERIALIZED (SELECT rec_id AS query, {s_skeleton('text')} AS s FROM enc_hadith WHERE {s_skeleton('text')} <> ''), "
    f"r AS MATERIALIZED (SELECT rec_id AS ord, {s_skeleton('text')} AS s, scholar, ruling, book FROM dorar_hadith WHERE {s_skeleton('text')} <> ''), "
    f"gq AS ({_GRAMS.format(key='s', source='SELECT DISTINCT s FROM q')}), gr AS ({_GRAMS.format(key='s', source='SELECT DISTINCT s FROM r')}), "
    "nq AS (SELECT s, count(*) AS c FROM gq GROUP BY s), nr AS (SELECT s, count(*) AS c FROM gr GROUP BY s), "
    "m AS (SELECT gq.s AS sq, gr.s AS sr, count(*) AS n FROM gq JOIN gr USING (gram) GROUP BY ALL HAVING count(*) >= 3), "
    "pairs AS MATERIALIZED (SELECT row_number() OVER () AS id, sq, sr, CASE WHEN length(sq) <= length(sr) THEN sq ELSE sr END AS p, CASE WHEN length(sq) <= length(sr) THEN sr ELSE sq END AS t "
    f"FROM m JOIN nq ON nq.s = sq JOIN nr ON nr.s = sr WHERE n >= 0.15 * least(nq.c, nr.c)), {s_cells()}, "
    "w AS (SELECT query, ord, scholar, ruling, book, 1 - d / length(p) AS similarity FROM nearest JOIN pairs USING (id) JOIN q ON q.s = sq JOIN r ON r.s = sr WHERE 1 - d / length(p) >= 0.65), "
    "best AS (SELECT query, max(similarity) AS similarity FROM w GROUP BY query), "
    f"l AS (SELECT DISTINCT query, scholar, ruling, book, {s_class('f')} AS c FROM (SELECT *, {s_fold('ruling')} AS f FROM w WHERE coalesce(ruling, '') <> '')), "
    "k AS (SELECT query, count(*) AS n, sum((c <> 'unclassified')::INT) AS known, sum((c = 'authentic')::INT) AS good, sum((c IN ('weak', 'fabricated'))::INT) AS bad FROM l GROUP BY query) "
    "SELECT query, CASE WHEN known = 0 THEN 'rulings_verbatim' WHEN bad = 0 THEN CASE WHEN similarity < 0.99 THEN 'different_wording' ELSE 'hadith_authentic' END "
    "WHEN good = 0 THEN 'weak_or_fabricated' ELSE 'scholars_differed' END AS kind, round(similarity, 9) AS similarity, n::INTEGER AS rulings FROM k JOIN best USING (query)"
)


@query(_CHECKED)
def rul_check(spark, d):
    return rl.check_rulings(_lookup(spark, d)).select("query", "kind", F.round("similarity", 9).alias("similarity"), F.size("rulings").alias("rulings"))


@query()
def rul_check_service(spark, d):
    return rl.check_rulings_service(_lookup(spark, d)).select("query", "kind", "confidence", F.round("similarity", 9).alias("similarity"), "rulings")


# ---------------------------------------------------------------- vectors

_UNIT = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings"


@query(f"SELECT vec_id, list_transform(v, lambda x: round(x, 6)) AS v FROM ({_UNIT})")
def vec_normalise(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(vc.normalise("embedding"), lambda x: F.round(x, 6)).alias("v"))


@query(
    f"SELECT vec_id, round(s, 6) AS scale, list_transform(v, lambda x: floor(x / s + 0.5)::TINYINT) AS q FROM (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS s FROM ({_UNIT}))"
)
def vec_quantise(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", vc.quantise("embedding").alias("x"))
    return t.select("vec_id", F.round(F.col("x.scale").cast("double"), 6).alias("scale"), "x.q")


@query(
    "SELECT a.vec_id AS query, b.vec_id AS pos, round(list_dot_product(a.e, b.e), 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0) a "
    "CROSS JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.e, b.e) DESC, b.vec_id) <= 10"
)
def vec_top_k(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = vc.top_k(t.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query"), t.withColumnRenamed("vec_id", "pos"))
    return found.select("query", "pos", F.round("score", 6).alias("score"))


@query(
    "WITH v AS (SELECT vec_id, list_transform(data, lambda x: x::DOUBLE * scales::DOUBLE) AS e FROM vectors WHERE scales IS NOT NULL AND data IS NOT NULL AND NOT list_contains(list_transform(data, lambda x: x IS NULL), true)), "
    "s AS (SELECT a.vec_id AS query, b.vec_id AS pos, list_dot_product(a.e, b.e) AS score FROM v a JOIN v b ON len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0) "
    "SELECT query, pos, round(score, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos)::INTEGER AS rank FROM s QUALIFY rank <= 10"
)
def vec_top_k_quantised(spark, d):
    t = table(spark, d, "vectors").where("scales IS NOT NULL AND data IS NOT NULL").select("vec_id", vc.dequantise("scales", "data").alias("vector"))
    found = vc.top_k(t.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query"), spread(t.withColumnRenamed("vec_id", "pos")))
    return found.select("query", "pos", F.round("score", 4).alias("score"), "rank")


# ---------------------------------------------------------------- aggregates, order, splits


@query("SELECT sura, string_agg(text, ' ' ORDER BY pos) AS text, count(text) AS verses FROM ayat GROUP BY sura")
def agg_ordered_text(spark, d):
    t = table(spark, d, "ayat").where("text IS NOT NULL").groupBy("sura").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("l"), F.count("text").alias("verses"))
    full = t.select("sura", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"), "verses")
    suras = table(spark, d, "ayat").select("sura").distinct()
    return suras.join(full, "sura", "left").select("sura", "text", F.coalesce("verses", F.lit(0)).alias("verses"))


@query(
    "SELECT 'reports' AS corpus, count(*) AS n FROM enc_hadith UNION ALL SELECT 'rulings', count(*) FROM dorar_hadith UNION ALL SELECT 'verses', count(*) FROM ayat"
)
def agg_health(spark, d):
    return cp.health(verses=table(spark, d, "ayat"), reports=table(spark, d, "enc_hadith"), rulings=table(spark, d, "dorar_hadith"))


_SLICED = " UNION ALL ".join(
    f"SELECT lang, '{n}' AS slice, sum(coalesce(({t}), false)::INT)::BIGINT AS n, round(100 * (1 - avg(least(1.0, cer)) FILTER (coalesce(({t}), false) AND cer IS NOT NULL)), 6) AS accuracy, "
    f"round(avg((cer <= 0.10)::INT) FILTER (coalesce(({t}), false)), 6) AS near_perfect, round(avg(found::INT) FILTER (coalesce(({t}), false)), 6) AS found_share FROM evaluate GROUP BY lang"
    for n, t in ev.SLICES.items()
)


@query(_SLICED)
def eval_report(spark, d):
    r = ev.score_report(table(spark, d, "evaluate"))
    return r.select("lang", "slice", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "near_perfect", "found_share")])


@query()
def eval_source_found(spark, d):
    corpus = cp.training_texts(table(spark, d, "ayat"), table(spark, d, "enc_hadith")).withColumn("pos", F.xxhash64("source", "id", "text"))
    rows = spread(table(spark, d, "evaluate").select("row_id", "text", "ocr"))
    found = ev.source_found(rows, corpus.select("pos", "text"))
    return found.select("row_id", F.round("true_ratio", 9).alias("true_ratio"), F.round("rival_ratio", 9).alias("rival_ratio"), "found")


@query("SELECT least(19, greatest(0, floor(cer / 0.05)))::INTEGER AS bin, count(*) AS n FROM evaluate WHERE cer IS NOT NULL GROUP BY ALL")
def eval_histogram(spark, d):
    return ev.histogram(table(spark, d, "evaluate"), "cer", bins=20)


@query(
    "SELECT family, any_value(size) AS quantile FROM (SELECT family, size, row_number() OVER (PARTITION BY family ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY family) AS n "
    "FROM evaluate WHERE size IS NOT NULL) WHERE i = floor(0.9 * (n - 1)) GROUP BY family"
)
def eval_lower_quantile(spark, d):
    return ev.lower_quantile(table(spark, d, "evaluate"), "family", "size")


@query("SELECT row_id, CASE WHEN row_id % 10 = 3 THEN 'test' ELSE 'train' END AS split FROM evaluate")
def split_modulo(spark, d):
    return ev.modulo_split(table(spark, d, "evaluate").select("row_id"), "row_id")


@query(
    "SELECT family, coalesce(arg_max(font, row_id) FILTER (contains(font, 'Regular')), arg_min(font, row_id)) AS font FROM evaluate GROUP BY family"
)
def split_one_per_family(spark, d):
    return ev.one_per_family(table(spark, d, "evaluate").select("row_id", "family", "font"))


@query()
def split_seeded_sample(spark, d):
    return ev.seeded_sample(table(spark, d, "evaluate").select("row_id", "text"), "row_id", 1000)


@query(
    "SELECT 'kept' AS part, count(*) AS n FROM enc_hadith WHERE id IN (SELECT id FROM vectors WHERE corpus = 'hadith') UNION ALL "
    "SELECT 'todo', count(DISTINCT id) FROM vectors WHERE corpus = 'hadith' AND id NOT IN (SELECT id FROM enc_hadith WHERE id IS NOT NULL)"
)
def sync_resume(spark, d):
    wanted = table(spark, d, "vectors").where("corpus = 'hadith'").select("id")
    kept, todo = cp.to_fetch(wanted, table(spark, d, "enc_hadith"))
    return kept.agg(F.lit("kept").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(todo.agg(F.lit("todo").alias("part"), F.count(F.lit(1)).alias("n")))


@query(
    "SELECT * FROM (SELECT 'quran' AS source, sura || ':' || aya AS id, text FROM ayat WHERE text IS NOT NULL UNION ALL "
    r"SELECT 'quran-en', sura || ':' || aya, trim(regexp_replace(translation, '\[\d+\]', '', 'g')) FROM ayat WHERE translation IS NOT NULL UNION ALL "
    "SELECT 'hadith', id, CASE WHEN regexp_extract(text, '«([^»]{15,})»', 1) <> '' THEN regexp_extract(text, '«([^»]{15,})»', 1) ELSE text END FROM enc_hadith WHERE text IS NOT NULL) "
    f"WHERE {s_squeeze('text')} <> ''"
)
def sync_training_texts(spark, d):
    return cp.training_texts(table(spark, d, "ayat"), table(spark, d, "enc_hadith"))


@query("SELECT rec_id, text, t AS translation FROM enc_hadith LEFT JOIN (SELECT id, min(translation) AS t FROM enc_hadith GROUP BY id) USING (id)")
def sync_translations(spark, d):
    t = table(spark, d, "enc_hadith").select("rec_id", "id", "text", "translation")
    return cp.with_translation(t, t.select("id", "translation")).select("rec_id", "text", "translation")


# ---------------------------------------------------------------- posts, pages, streams


@query()
def check_all(spark, d):
    return flagship(spark, d)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Every reading of a picture as a post, checked against verses, reports and rulings; one row per post."""
    posts = spread(table(spark, d, "evaluate").select(F.col("row_id").alias("post_id"), "text"))
    out = check_posts(posts, table(spark, d, "ayat").select("pos", "sura", "aya", "text"), table(spark, d, "enc_hadith").select("pos", "id", "text"), records=_records(spark, d))
    v = F.element_at("verdicts", 1)
    return out.select("post_id", "religious", "incomplete", F.size("verdicts").alias("results"), F.when(F.size("verdicts") > 0, v["kind"]).alias("kind"), F.when(F.size("verdicts") > 0, F.round(v["similarity"], 9)).alias("similarity"))


@query()
def verify_all(spark, d):
    """Every text of a picture verified as a whole, by the service profile."""
    texts = spread(table(spark, d, "evaluate").select(F.col("row_id").alias("query"), "text"))
    out = verify_texts(texts, table(spark, d, "ayat").select("pos", "sura", "aya", "text"), table(spark, d, "enc_hadith").select("pos", "id", "text"), records=_records(spark, d))
    return out.select("query", "status", "origin", "kind", "confidence", F.round("similarity", 9).alias("similarity"))


_FILLED = (
    "list_reduce(list_filter(regexp_split_to_array(text, '" + _SPACE + "'), lambda w: w <> ''), lambda acc, w: concat(acc, "
    "CASE WHEN length(string_split(acc, chr(10))[-1]) + 1 + length(w) <= 40 THEN ' ' ELSE chr(10) END, w))"
)


@query(f"SELECT row_id, unnest(string_split({_FILLED}, chr(10))) AS line FROM evaluate WHERE regexp_replace(text, '{_SPACE}', '', 'g') <> ''")
def frag_wrap(spark, d):
    return table(spark, d, "evaluate").select("row_id", F.explode(nm.wrap("text")).alias("line"))


_CARD = (
    "concat('<article class=\"card\" data-kind=\"found\"><h3>', {e[grade]}, '</h3><blockquote>', {e[text]}, '</blockquote>', "
    "CASE WHEN attribution IS NULL THEN '' ELSE concat('<blockquote class=\"source\">', {e[attribution]}, '</blockquote>') END, '</article>')"
).format(e={c: _ESCAPED.format(f"coalesce({c}, '')") for c in ("grade", "text", "attribution")})


@query(f"SELECT rec_id, {_CARD} AS html FROM enc_hadith")
def page_cards(spark, d):
    t = table(spark, d, "enc_hadith")
    return t.select("rec_id", pg.card_html(F.lit("found"), F.coalesce("grade", F.lit("")), F.col("text"), F.col("attribution")).alias("html"))


@query(f"SELECT rec_id, 0 AS no, {_ENDS.format('coalesce(text, chr(32))')} AS text, ['a.png'] AS images FROM enc_hadith")
def page_posts(spark, d):
    t = table(spark, d, "enc_hadith").select("rec_id", F.concat(F.lit('<main><article><div class="body">'), nm.escape_html(F.coalesce("text", F.lit(""))), F.lit('</div><img width="300" src="a.png"></article></main>')).alias("html"))
    return pg.extract_posts(t, "rec_id", "html", ("article", "", ""), ("div", "class", "body"))


@query()
def stream_check(spark, d):
    """The rulings as a feed: each record once, those with enough letters, classed in micro-batches."""
    base = scratch(spark)
    source = table(spark, d, "dorar_hadith")
    # the stream reads a directory of files, whatever form the table has
    source.select("rec_id", "text", "ruling").write.parquet(f"{base}/in")
    feed = spark.readStream.schema("rec_id bigint, text string, ruling string").parquet(f"{base}/in")
    posts = st.worth_checking(st.new_posts(feed, "rec_id"))
    run = st.check_feed(posts, lambda b: b.select("rec_id", rl.classify_ruling("ruling").alias("class")), f"{base}/out", f"{base}/state", once=True)
    run.awaitTermination()
    return spark.read.schema("rec_id bigint, class string").parquet(f"{base}/out/batch=*")


_SQL["stream_check"] = (
    f"SELECT rec_id, {s_class('f')} AS class FROM (SELECT rec_id, coalesce({s_fold('ruling')}, '') AS f FROM dorar_hadith WHERE length({s_skeleton('text')}) >= 12)"
)
