"""Problem 3: one form for texts that print alike.

DuckDB runs inside the Arrow partitions (``mapInArrow``): ``nfc_normalize``,
``translate`` and regular expressions in embedded SQL map invisible characters,
compatibility forms and look-alike letters. Grouping by the form is left to Spark.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

# Look-alike letters (Cyrillic and Greek capitals and small letters that print as Latin ones).
LOOKALIKES = {
    "АВЕЅІЈКМНОРСТУХаеіјоѕрсухԁһԛԝӏ": "ABESIJKMHOPCTYXaeijospcyxdhqwl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο": "ABEZHIKMNOPTYXo",
    "۰۱۲۳۷۸۹": "٠١٢٣٧٨٩",  # 4, 5 and 6 are drawn differently
}
# Characters without width, as RE2 writes them.
INVISIBLE = (
    r"\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}"
    r"\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{e0001}-\x{e007f}\x{e0100}-\x{e01ef}"
)
BLANK = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
JOINED = r"([\x{64b}-\x{65f}\x{670}]*[\x{620}\x{622}-\x{64a}\x{66e}-\x{66f}\x{671}-\x{6d3}\x{6d5}])"
# Marks that a hamza above passes on its way to its letter (their combining class is below its own).
PASSED = r"\x{64b}-\x{652}\x{655}\x{656}\x{65c}\x{65f}\x{670}\x{618}-\x{61a}\x{8f0}-\x{8f2}"
_KINDS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
# Ranges whose <compat> decompositions are drawn like the letters they stand for: digraphs and f-ligatures.
_DIGRAPHS = ((0x132, 0x133), (0x1C7, 0x1CC), (0xFB00, 0xFB06), (0xFB13, 0xFB17))


@cache
def compatibility_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that are only another shape of one letter, and of several, by Unicode's own decompositions.

    The signs from U+FDF0 print as one drawing, not as the words they stand for, and stay;
    so do marks shown on a blank. A hyphen that doesn't break prints as one that does.
    """
    one, many = {"\u2011": "\u2010"}, {}
    ranges = [(r, _KINDS) for r in ((0xFB50, 0xFDEF), (0xFE70, 0xFEFC), (0xFF01, 0xFFEE))] + [(r, ("<compat>",)) for r in _DIGRAPHS]
    for (first, last), kinds in ranges:
        for cp in range(first, last + 1):
            kind, _, codes = unicodedata.decomposition(chr(cp)).partition(" ")
            to = unicodedata.normalize("NFC", "".join(chr(int(c, 16)) for c in codes.split()))
            if kind in kinds and to and to[0] != " ":
                (one if len(to) == 1 else many)[chr(cp)] = to
    return one, many


def _ranges(codes: list[int]) -> str:
    """Code points in order as the inside of an RE2 class."""
    spans: list[list[int]] = []
    for c in codes:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in spans)


@cache
def composable() -> str:
    """RE2 class of all that NFC may change: marks, Hangul letters, and single characters with another normal form."""
    singles = [c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    return f"[\\p{{M}}\\x{{1100}}-\\x{{11ff}}{_ranges(singles)}]"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_query(source: str, text: str) -> str:
    """DuckDB query over ``source``: all its columns and ``form``, the one form of its column ``text``.

    The steps are nested selects, so that each is computed once; the wide tables are
    consulted only for the texts that hold one of their characters.
    """
    one, many = compatibility_forms()
    shapes, plain = "".join(one), "".join(one.values())
    seldom = _ranges(sorted(map(ord, one))) + "\\x{fef5}-\\x{fefc}"
    others = "".join(LOOKALIKES)
    # ligatures of several letters: lam-alef by single replacements, the rest only where a text holds one
    rest = [c for c in many if not "ﻵ" <= c <= "ﻼ"]
    spelled = f"map([{', '.join(map(_quote, rest))}], [{', '.join(_quote(many[c]) for c in rest)}])"
    lam_alef = "f"
    for pair in ("ﻵﻶ", "ﻷﻸ", "ﻹﻺ", "ﻻﻼ"):
        lam_alef = f"regexp_replace({lam_alef}, '[{pair}]', '{many[pair[0]]}', 'g')"
    # Farsi yeh and keheh print as the Arabic letters where the next letter joins; two passes reach neighbours
    joining = "f"
    for letter, joined in (("ی", "ي"), ("ی", "ي"), ("ک", "ك"), ("ک", "ك")):
        joining = f"regexp_replace({joining}, '{letter}{JOINED}', '{joined}\\1', 'g')"
    steps = [
        f"regexp_replace({text}, '[{INVISIBLE}]+', '', 'g')",
        f"CASE WHEN regexp_matches(f, '[{_ranges(sorted(map(ord, rest)))}]') THEN "
        f"array_to_string(list_transform(string_split(f, ''), lambda c: coalesce({spelled}[c], c)), '') ELSE f END",
        f"CASE WHEN regexp_matches(f, '[{seldom}]') THEN translate({lam_alef}, {_quote(shapes)}, {_quote(plain)}) ELSE f END",
        f"CASE WHEN regexp_matches(f, '[{others}]') THEN translate(f, {_quote(others)}, {_quote(''.join(LOOKALIKES.values()))}) ELSE f END",
        f"CASE WHEN regexp_matches(f, '{composable()}') THEN regexp_replace(nfc_normalize(f), '[\\x{{649}}\\x{{64a}}\\x{{6cc}}]([{PASSED}]*)\\x{{654}}', 'ئ\\1', 'g') ELSE f END",
        f"CASE WHEN regexp_matches(f, '[یک]') THEN translate({joining}, 'ی', 'ى') ELSE f END",
        f"trim(regexp_replace(f, '{BLANK}', ' ', 'g'))",
    ]
    query = source
    for i, step in enumerate(steps):
        query = f"(SELECT * {'REPLACE (' if i else ', '}{step} AS f{')' if i else ''} FROM {query})"
    return query[1:-1]


def canonicalize(df: DataFrame, text: str = "text", form: str = "form", threads: int = 1) -> DataFrame:
    """``df`` with the column ``form``: equal for texts that print alike, and for no others.

    A null text has the form null, an empty one and one of white space or invisible
    characters alone have the empty form. Other columns pass through; a column that is
    already called ``form`` is replaced. Texts of any length are handled whole.
    """
    rest = df.drop(form) if form != text else df
    fields = [f for f in rest.schema.fields if f.name != form]
    schema = T.StructType([*fields, T.StructField(form, T.StringType())])
    query = f"SELECT f FROM ({form_query('batch', 'x')})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": threads})
        for b in batches:
            con.register("batch", pa.table({"x": b.column(text).cast(pa.string())}))
            forms = con.sql(query).to_arrow_table().column("f").combine_chunks()
            con.unregister("batch")
            forms = forms.combine_chunks() if isinstance(forms, pa.ChunkedArray) else forms
            cols = [b.column(f.name) for f in fields] + [forms.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields] + [form])

    return rest.mapInArrow(run, schema)


def wide_hash(column: str | Column, a: str, b: str) -> list[Column]:
    """A 128-bit hash as two columns: by it texts are compared without being shuffled."""
    c = F.col(column) if isinstance(column, str) else column
    return [F.xxhash64(c).alias(a), F.xxhash64(F.lit("2"), c).alias(b)]


def alike_pairs(records: DataFrame, rec_id: str = "rec_id", text: str = "text") -> DataFrame:
    """Pairs (rec_a, rec_b), rec_a < rec_b, of records whose texts print alike but are not equal.

    Null texts match nothing. Records are first gathered into classes of equal text;
    pairs are formed between classes of one form and then expanded to their records, so
    copies of one text cost nothing and every row that a join makes is a row of the result.
    """
    slim = records.select(F.col(rec_id).cast("long").alias("rec"), F.col(text).alias("x")).where("x IS NOT NULL")
    formed = canonicalize(slim, "x", "f")
    # read five times below: the texts are formed once, five numbers a record stay
    keyed = cut(formed.select("rec", *wide_hash("f", "f1", "f2"), *wide_hash("x", "r1", "r2")))
    mixed = keyed.groupBy("f1", "f2").agg(F.min("r1").alias("lo"), F.max("r1").alias("hi")).where("lo <> hi")
    members = keyed.join(mixed.select("f1", "f2"), ["f1", "f2"], "left_semi")
    classes = members.select("f1", "f2", "r1", "r2").distinct()
    left = classes.toDF("f1", "f2", "a1", "a2")
    right = classes.toDF("f1", "f2", "b1", "b2")
    pairs = left.join(right, ["f1", "f2"]).where("struct(a1, a2) < struct(b1, b2)")
    one = members.select("f1", "f2", F.col("r1").alias("a1"), F.col("r2").alias("a2"), F.col("rec").alias("one"))
    two = members.select("f1", "f2", F.col("r1").alias("b1"), F.col("r2").alias("b2"), F.col("rec").alias("two"))
    full = pairs.join(one, ["f1", "f2", "a1", "a2"]).join(two, ["f1", "f2", "b1", "b2"])
    return full.where("one <> two").select(
        F.least("one", "two").alias("rec_a"), F.greatest("one", "two").alias("rec_b")
    )
