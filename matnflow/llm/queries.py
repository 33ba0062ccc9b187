"""The queries of the llm problems over the driver's tables, and the SQL of those that SQL can state."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, table


def _texts(spark: SparkSession, d: str, *names: str) -> DataFrame:
    out = None
    for name in names:
        one = table(spark, d, name).select("rec_id", "text")
        out = one if out is None else out.unionByName(one)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from .neardup import similar_pairs

    return similar_pairs(_texts(spark, d, "enc_hadith", "dorar_hadith"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .neighbours import similar_pairs

    return similar_pairs(spread(table(spark, d, "vectors").select("vec_id", "scales", "data")))


def p2_knn(spark: SparkSession, d: str) -> DataFrame:
    """The search form: every vector whose id is divisible by 50 against all."""
    from .neighbours import nearest_of

    vectors = table(spark, d, "vectors").select("vec_id", "scales", "data")
    return nearest_of(spread(vectors), vectors.where("vec_id % 50 = 0")).selectExpr(
        "vec_id", "rank", "neighbour", "round(cosine, 6) AS cosine"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .canonical import alike_pairs

    return alike_pairs(_texts(spark, d, "ayat", "enc_hadith", "dorar_hadith"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    from .canonical import canonicalize

    return canonicalize(_texts(spark, d, "ayat", "enc_hadith", "dorar_hadith")).select("rec_id", "form")


def _free_values(spark: SparkSession, d: str) -> DataFrame:
    grades = table(spark, d, "enc_hadith").selectExpr("rec_id", "grade AS value")
    return grades.unionByName(table(spark, d, "dorar_hadith").selectExpr("rec_id", "ruling AS value"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from .vocabulary import map_values

    return map_values(_free_values(spark, d), table(spark, d, "gradelist"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    from .vocabulary import map_values

    values = _free_values(spark, d)
    lost = map_values(values, table(spark, d, "gradelist")).where("grade_id = -1").select("rec_id")
    return values.join(lost, "rec_id").groupBy("value").count().withColumnRenamed("count", "n")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .overlap import split_overlaps

    return split_overlaps(table(spark, d, "evaluate").select("row_id", "split", "source", "id", "text"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    from .overlap import overlap_report

    return overlap_report(table(spark, d, "evaluate").select("row_id", "split", "source", "id", "text"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from .encode import encode_corpus

    return encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")))


def _mixture(spark: SparkSession, d: str):
    from .mixing import Mixture

    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    return Mixture(docs, table(spark, d, "mixtargets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).records_used()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from .spam import spam_documents

    return spam_documents(spread(table(spark, d, "documents").select("doc_id", "text", "lang"))).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_knn": p2_knn,
    "p3_found": p3_found,
    "p3_forms": p3_forms,
    "p4_found": p4_found,
    "p4_unmatched": p4_unmatched,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
}


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def printed_sql(source: str, text: str) -> str:
    """How a text prints, stated apart from the operator: character by character, by a table taken from Unicode's own data.

    ``source``'s columns and ``f``. Shapes and widths go by NFKC, what has no width by its
    category; yeh and kaf are then drawn by the next letter that is no mark.
    """
    shown: dict[str, str] = {}
    for cp in [*range(0x1D00), *range(0x1E00, 0x2070), *range(0x3000, 0x3165), *range(0xFB00, 0xFDF0), *range(0xFE00, 0xFFF0), *range(0xE0000, 0xE01F0)]:
        c = chr(cp)
        wide = unicodedata.normalize("NFKC", c)
        if c.isspace() or cp == 0xFEFF:
            to = "" if cp == 0xFEFF else " "
        elif unicodedata.category(c) in ("Cf", "Cn") and cp not in (0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x8E2, 0x890, 0x891):
            to = ""
        elif 0xFE00 <= cp < 0xFE10 or 0xE0100 <= cp or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0):
            to = ""
        elif (0xFB00 <= cp < 0xFDF0 or cp >= 0xFE70) and not wide.startswith(" "):
            to = wide
        else:
            continue
        if to != c and unicodedata.category(c) != "Cn":
            shown[c] = to
    # letters of other scripts that are drawn alike
    for other, latin in (("АВЕЅІЈКМНОРСТУХ", "ABESIJKMHOPCTYX"), ("аеіјоѕрсухԁһԛԝӏ", "aeijospcyxdhqwl"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"), ("۰۱۲۳۷۸۹", "٠١٢٣٧٨٩")):
        shown |= dict(zip(other, latin))
    mark = r"[\x{610}-\x{61a}\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6dc}\x{6df}-\x{6e4}\x{6e7}\x{6e8}\x{6ea}-\x{6ed}\x{8d3}-\x{8ff}]"
    joins = r"^[\x{620}\x{622}-\x{64a}\x{66e}-\x{66f}\x{671}-\x{6d3}\x{6d5}]"
    below = r"[\x{618}-\x{61a}\x{64b}-\x{652}\x{655}\x{656}\x{65c}\x{65f}\x{670}]"
    chars = f"SELECT *, coalesce(array_to_string(list_transform(string_split({text}, ''), lambda c: coalesce(map([{_quoted(shown)}], [{_quoted(shown.values())}])[c], c)), ''), CASE WHEN {text} = '' THEN '' END) AS g FROM {source}"
    composed = rf"nfc_normalize(regexp_replace(nfc_normalize(g), '[ىی]({below}*)ٔ', 'ي\1ٔ', 'g'))"
    normal = rf"SELECT * EXCLUDE (g), string_split(regexp_replace({composed}, '\s+', ' ', 'g'), '') AS l FROM ({chars})"
    following = f"array_to_string(l[i + 1:], '')"
    drawn = (
        f"CASE WHEN c NOT IN ('ی', 'ک') THEN c WHEN regexp_matches(regexp_replace({following}, '^{mark}*', ''), '{joins}') THEN translate(c, 'یک', 'يك') WHEN c = 'ی' THEN 'ى' ELSE c END"
    )
    return f"SELECT * EXCLUDE (l), CASE WHEN l IS NOT NULL THEN trim(array_to_string(list_transform(l, lambda c, i: {drawn}), '')) END AS f FROM ({normal})"


def _letters_sql(form: str) -> str:
    """SURVEY N1 of a text in the problem-3 form."""
    t = f"replace(replace({form}, 'ﷺ', ' صلى الله عليه وسلم '), 'وٰ', 'ا')"
    t = rf"regexp_replace(translate({t}, 'ۧ', 'ي'), '[\x{{610}}-\x{{61a}}\x{{64b}}-\x{{65f}}\x{{670}}\x{{6d6}}-\x{{6ed}}\x{{8d3}}-\x{{8ff}}\x{{640}}]', '', 'g')"
    t = f"translate({t}, 'آأإٱٲٳٵىةؤئء', 'ااااااايهوي')"
    return rf"trim(regexp_replace({t}, '[^\x{{622}}-\x{{64a}}]+', ' ', 'g'))"


def _any_script_sql(form: str) -> str:
    """SURVEY N8 of a text in the problem-3 form."""
    t = rf"regexp_replace(translate({form}, 'ٱ', 'ا'), '[\x{{610}}-\x{{61a}}\x{{64b}}-\x{{65f}}\x{{670}}\x{{6d6}}-\x{{6ed}}\x{{640}}]', '', 'g')"
    t = f"lower(translate({t}, 'إأآىةؤئ', 'ااايهوي'))"
    return rf"trim(regexp_replace({t}, '[^\pL\p{{Nl}}\p{{No}}]+', ' ', 'g'))"


def sql() -> dict[str, str]:
    """DuckDB SQL by brute force; problems 4, 6, 7 and 8 are beyond SQL and tested otherwise."""
    records = " UNION ALL ".join(f"SELECT rec_id, text FROM {t}" for t in ("ayat", "enc_hadith", "dorar_hadith"))
    formed = printed_sql(f"({records})", "text")
    reports = printed_sql("(SELECT rec_id, text FROM enc_hadith UNION ALL SELECT rec_id, text FROM dorar_hadith)", "text")
    usable = (
        "SELECT vec_id, list_transform(data, lambda x: x::DOUBLE) AS v, sign(scales) AS s FROM vectors WHERE scales IS NOT NULL "
        "AND scales <> 0 AND len(data) = 64 AND len(list_filter(data, lambda x: x IS NULL)) = 0 AND len(list_filter(data, lambda x: x <> 0)) > 0"
    )
    cosines = (
        f"u AS MATERIALIZED ({usable}), c AS (SELECT a.vec_id AS a, b.vec_id AS b, a.s * b.s * list_dot_product(a.v, b.v) "
        "/ sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id)"
    )
    ranked = "r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM c)"
    key = (
        r"regexp_replace(regexp_replace(translate(id, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), "
        r"'[\s\x{a0}\x{2000}-\x{200f}\x{202f}\x{205f}\x{3000}]', '', 'g'), '(^|[^0-9])0+([0-9])', '\1\2', 'g')"
    )
    rows = printed_sql("(SELECT row_id, split, source, id, text FROM evaluate WHERE split IN ('train', 'test', 'valid'))", "text")
    # DuckDB's edit distance counts bytes: every Arabic letter becomes one (the form has no capitals and digits)
    bytes_ = f"translate({_any_script_sql('f')}, 'ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')"
    overlaps = (
        f"e AS MATERIALIZED (SELECT row_id, split, source, nullif({key}, '') AS k, nullif({bytes_}, '') AS t FROM ({rows})), "
        "o AS (SELECT b.row_id AS held, a.row_id AS train, b.split, b.source FROM e a JOIN e b ON a.split = 'train' AND b.split <> 'train' AND "
        "((a.source = b.source AND a.k = b.k) OR (abs(length(a.t) - length(b.t)) <= floor(0.15 * greatest(length(a.t), length(b.t)) + 1e-9) "
        "AND levenshtein(a.t, b.t) <= floor(0.15 * greatest(length(a.t), length(b.t)) + 1e-9))))"
    )
    return {
        "p1_found": f"WITH s AS MATERIALIZED (SELECT rec_id, list_distinct(string_split(n, ' ')) AS w FROM (SELECT rec_id, {_letters_sql('f')} AS n "
        f"FROM ({reports}) WHERE text IS NOT NULL) WHERE n <> ''), x AS (SELECT rec_id, len(w) AS n, unnest(w) AS word FROM s) "
        "SELECT rec_a, rec_b FROM (SELECT a.rec_id AS rec_a, b.rec_id AS rec_b, count(*) AS common, any_value(a.n + b.n) AS total "
        "FROM x a JOIN x b ON a.word = b.word AND a.rec_id < b.rec_id GROUP BY ALL) WHERE common >= 0.7 * (total - common) - 1e-9",
        "p2_found": f"WITH {cosines}, {ranked} SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE k <= 10 AND c >= 0.9",
        "p2_knn": f"WITH {cosines}, {ranked} SELECT a AS vec_id, k::INTEGER AS rank, b AS neighbour, round(c, 6) AS cosine FROM r WHERE k <= 10 AND a % 50 = 0",
        "p3_forms": f"SELECT rec_id, f AS form FROM ({formed})",
        "p3_found": f"WITH s AS MATERIALIZED ({formed}) SELECT a.rec_id AS rec_a, b.rec_id AS rec_b "
        "FROM s a JOIN s b ON a.f = b.f AND a.text <> b.text AND a.rec_id < b.rec_id",
        "p5_found": f"WITH {overlaps} SELECT DISTINCT least(held, train) AS row_a, greatest(held, train) AS row_b FROM o",
        "p5_report": f"WITH {overlaps} SELECT split, source, count(*) AS pairs, count(DISTINCT held) AS rows_hit, "
        "count(DISTINCT train) AS train_rows FROM o GROUP BY ALL",
    }
