"""Text normal forms as Catalyst expressions (no Python in the hot path).

Every function takes a column (or its name) and returns a column; null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of the normal forms.
MARKS = "ؐ-ًؚ-ٰٟۖ-ۭ࣓-ࣿ"
VOWELS = "ؐ-ًؚ-ٰٟۖ-ۭ"
TATWEEL = "ـ"
ALEF = "ا"
ALEF_FORMS = "آأإٱٲٳٵ"
ALEF_FORMS_SHORT = "إأآٱ"
LETTERS = "ء-ي"
BLESSING = " صلى الله عليه وسلم "
# Java's \s lacks the non-breaking space and its kin; (?U) brings them in.
SPACE = r"(?U)[\s﻿]+"


def _c(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def squeeze(text: Column | str) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), SPACE, " "))


def fold_letters(text: Column | str) -> Column:
    """N1, the matching form: Arabic letters of one spelling, words parted by one space."""
    t = F.replace(_c(text), F.lit("ﷺ"), F.lit(BLESSING))
    t = F.replace(t, F.lit("وٰ"), F.lit(ALEF))  # only a bare waw carries the small alef
    t = F.regexp_replace(F.translate(t, "ۧ", "ي"), f"[{MARKS}{TATWEEL}]+", "")
    t = F.translate(t, ALEF_FORMS + "ىةؤئء", ALEF * len(ALEF_FORMS) + "يهوي")
    return F.trim(F.regexp_replace(t, f"[^آ-ي]+", " "))


def skeleton(text: Column | str) -> Column:
    """The matching form without alefs and spaces."""
    return F.translate(fold_letters(text), ALEF + " ", "")


def arabic_length(text: Column | str) -> Column:
    """Letters of the skeleton."""
    return F.length(skeleton(text))


def count_arabic_words(text: Column | str) -> Column:
    """Words of the matching form, 0 where there are none."""
    n = fold_letters(text)
    return F.when(n == "", 0).otherwise(F.size(F.split(n, " ")))


def fold_report(text: Column | str) -> Column:
    """N5, the lighter form for rulings: keeps hamzas, digits and punctuation."""
    t = F.regexp_replace(_c(text), f"[{VOWELS}{TATWEEL}]+", "")
    t = F.translate(t, ALEF_FORMS_SHORT + "ىة", ALEF * 4 + "يه")
    return squeeze(t)


def report_letters(text: Column | str) -> Column:
    """The lighter form with nothing but letters and spaces."""
    return squeeze(F.regexp_replace(fold_report(text), rf"(?U)[^{LETTERS}\s]", " "))


def plain_arabic(text: Column | str) -> Column:
    """Without vowel marks, small letters and tatweel; wasla becomes alef."""
    t = F.regexp_replace(F.translate(_c(text), "ٱ", ALEF), "[۟-ۭ]", "")
    return F.regexp_replace(t, f"[{VOWELS}{TATWEEL}]+", "")


def fold_any_script(text: Column | str) -> Column:
    """The evaluation form, for Latin text as well; letters only, lower case."""
    t = F.translate(plain_arabic(text), ALEF_FORMS_SHORT + "ىةؤئ", ALEF * 4 + "يهوي")
    # letters and letter-like numbers stay (Roman numerals, fractions); decimal digits and marks go
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{Nl}\p{No}]+", " "))


def tidy_lines(text: Column | str, latin: bool = False) -> Column:
    """Squeezed lines that hold three letters at least, joined by a line break."""
    keep = f"[^{LETTERS}A-Za-z]" if latin else f"[^{LETTERS}]"
    lines = F.transform(F.split(_c(text), "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: F.length(F.regexp_replace(x, keep, "")) >= 3), "\n")


def join_lines(text: Column | str) -> Column:
    """The tidy lines of a reading as one text, so that a quote may run over lines."""
    return F.replace(tidy_lines(text), F.lit("\n"), F.lit(" "))


def strip_tags(html: Column | str) -> Column:
    """Text of an HTML snippet."""
    t = F.regexp_replace(_c(html), r"(?i)<br\s*/?>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")):
        t = F.regexp_replace(t, entity, char)
    return squeeze(t)


def escape_html(text: Column | str) -> Column:
    """The five special characters as entities, ampersand first."""
    t = _c(text)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(char), F.lit(entity))
    return t


def encode_query(text: Column | str) -> Column:
    """Percent-encoding of a query value, a space as %20 and ``!'()*~`` left bare."""
    t = F.replace(F.url_encode(_c(text)), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        t = F.replace(t, F.lit(code), F.lit(char))
    return t


def fix_labels(text: Column | str) -> Column:
    """Characters that a training label writes otherwise or not at all."""
    return F.translate(_c(text), "،–‌{}﴿﴾", ",-")


def first_words(text: Column | str, n: int = 12) -> Column:
    """The first ``n`` words, parted by one space."""
    words = F.filter(F.split(_c(text), SPACE), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def clip_words(text: Column | str, key: Column | str, low: int = 20, high: int = 60, seed: int = 0) -> Column:
    """A run of words of at most ``high`` characters from the first third of a longer text.

    The start is drawn by hash of ``key`` and ``seed``, so reruns agree. A run shorter
    than ``low`` gives way to the first ``high`` characters.
    """
    t = _c(text)
    words = F.split(t, SPACE)
    third = F.greatest(F.lit(1), F.floor(F.size(words) / 3))
    start = F.pmod(F.xxhash64(_c(key), F.lit(seed)), third).cast("int") + 1
    rest = F.slice(words, start, F.size(words))

    def take(acc: Column, word: Column) -> Column:
        longer = F.when(acc["run"] == "", word).otherwise(F.concat(acc["run"], F.lit(" "), word))
        go = acc["open"] & (F.length(longer) <= high)
        return F.struct(F.when(go, longer).otherwise(acc["run"]).alias("run"), go.alias("open"))

    run = F.aggregate(rest, F.struct(F.lit("").alias("run"), F.lit(True).alias("open")), take)["run"]
    return F.when(F.length(t) <= high, t).when(F.length(run) < low, F.substring(t, 1, high)).otherwise(run)


def wrap(text: Column | str, width: int = 40) -> Column:
    """lines of at most ``width`` characters, filled greedily; a longer word has a line of its own."""
    words = F.filter(F.split(_c(text), SPACE), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(acc: Column, word: Column) -> Column:
        longer = F.when(acc["line"] == "", word).otherwise(F.concat(acc["line"], F.lit(" "), word))
        full = (acc["line"] != "") & (F.length(longer) > width)
        lines = F.when(full, F.concat(acc["lines"], F.array(acc["line"]))).otherwise(acc["lines"])
        return F.struct(lines.alias("lines"), F.when(full, word).otherwise(longer).alias("line"))

    return F.aggregate(words, start, add, lambda acc: F.when(acc["line"] == "", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"]))))


def too_short(text: Column | str, least: int = 4) -> Column:
    """Whether a text is null or trims to fewer than ``least`` characters."""
    return F.coalesce(F.length(squeeze(text)), F.lit(0)) < least
