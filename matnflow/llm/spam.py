"""Problem 8: keyword-stuffed and link-list pages by robust Mahalanobis distance.

Texts are cut into blocks. Each block has features of link and tag density, repetition,
function words and entropy. Medians, deviations and correlations are estimated robustly
over all blocks of a language; a block is spam where it is an outlier that lies in the
directions of spam. A document is a case where such blocks make up more than half of it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

FEATURES = ("links", "tags", "repeats", "function", "entropy")
SPAM_SIGNS = np.array([1.0, 1.0, 1.0, -1.0, -1.0])
LEAST_SCALE = np.array([0.03, 0.03, 0.05, 0.08, 0.05])  # of a robust deviation: most blocks hold no link at all
CUTOFF = 25.0  # squared distance, about the 99.99 % point of chi-square with five degrees
EVIDENCE = 5.0  # deviations by which a block must exceed in links, tags or repeats
CONE = 0.6  # part of an outlier's squared length that must lie in the directions of spam
SHORT, LONG = 120, 600  # characters: lines below are joined to blocks of one kind, lines above are cut
WIDE_SPREAD = 0.2  # documents of a language that hold a function word, at least
FEW_DOCS, FEW_BLOCKS = 100, 500  # a language with fewer takes the words and the statistics of all

_URL = r"(?:(?:https?|hxxps?|ftp)://|www\.)[^\s\]|<>\"')]*|[\w-]+(?:\.[\w-]+)*\s?\[dot\]\s?\w+(?:/[^\s\]|<>\"')]*)?"
URL = re.compile(_URL, re.I)
ARCHIVED = re.compile(r"\[?(?:https?:)?//(?:web\.)?archive\.[^\s\]]*[^\]\n]*\]?", re.I)
REFERENCE = re.compile(r"(?is)<ref[^>/]*/>|<ref[^>]*>.*?</ref>")
LINK = re.compile(
    rf"<a\s[^>]*>.*?</a>|\[url[^\]]*\].*?\[/url\]|\[[^\]\n\[]*\]\({_URL}\)|\[\s?(?:{_URL})[^\]\n]*\]|{_URL}", re.I
)
PRICE = re.compile(r"(?<![\d.,])\d{1,6}[.,٫]\d\d(?![\d.,]?\d)|[$€£¥₺₽]\s?\d+|\d+\s?[$€£¥₺₽]")
HASHTAG = re.compile(r"(?<![\w#{])#\w++(?!\s*:?\s*\[\[)")  # but no parser function and no redirect
INNER = re.compile(r"\[\[[^\]\n]*\]\]|\{\{[^{}]*\}\}|<[^>\n]*>|&\w+;")
TABLE = re.compile(r"(?m)^\s*(?:\{\||\|\}|[|!]).*$")
WORD = re.compile(r"[^\W\d_]+")
HEADING = re.compile(r"^\s*=+[^=\n]+=+\s*$")


def language(lang: str | Column) -> Column:
    """A language's two-letter code however it is written; what has none is ``und``. At most 677 groups."""
    code = F.regexp_extract(F.lower(F.trim(F.col(lang) if isinstance(lang, str) else lang)), "^([a-z]{2})(?![a-z])", 1)
    return F.when(F.coalesce(code, F.lit("")) == "", "und").otherwise(code)


def blocks_of(text: str) -> Iterator[str]:
    """Blocks of a text: long lines in pieces, runs of short lines of one kind together; headings are left out."""
    run: list[str] = []
    kind = None
    for line in text.splitlines():
        if not line.strip() or HEADING.match(line):
            continue
        if len(line) < SHORT:
            k = (bool(URL.search(line)), bool(PRICE.search(line)), "[[" in line, line.lstrip()[:1] in "|!{#")
            if run and k != kind:
                yield "\n".join(run)
                run = []
            kind = k
            run.append(line)
            continue
        if run:
            yield "\n".join(run)
            run = []
        while len(line) > LONG:
            end = line.rfind(" ", LONG // 3, LONG // 2)
            end = end if end > 0 else LONG // 2
            yield line[:end]
            line = line[end:].lstrip(" |!")  # what follows a cut is no row of a table
        yield line
    if run:
        yield "\n".join(run)


def features_of(block: str, function_words: frozenset[str]) -> tuple[float, ...]:
    size = len(block)
    plain = ARCHIVED.sub(" ", REFERENCE.sub(" ", block)) if "ref" in block or "archive" in block else block
    links = 0
    if "://" in plain or "www." in plain or "[dot]" in plain or "[url" in plain:
        links = sum(m.end() - m.start() for m in LINK.finditer(plain))
        plain = LINK.sub(" ", plain)
    tags = len(PRICE.findall(plain)) + len(HASHTAG.findall(plain))
    if "|" in plain or "[[" in plain or "{{" in plain or "<" in plain:
        plain = TABLE.sub(" ", INNER.sub(" ", plain))
    words = WORD.findall(plain.lower())
    n = len(words)
    tags = tags / max(n, tags, 4)
    if n < 6:  # too few words to tell
        return links / size, tags, 0.0, math.nan, math.nan
    counts = Counter(words)
    repeats = sum(c for w, c in counts.items() if c >= 3 and w not in function_words) / n
    function = sum(c for w, c in counts.items() if w in function_words) / n
    entropy = math.log2(n) - sum(c * math.log2(c) for c in counts.values() if c > 1) / n
    return links / size, tags, repeats, function, entropy / math.log2(n)


def function_words(docs: DataFrame) -> dict[str, frozenset[str]]:
    """Words that at least ``WIDE_SPREAD`` of a language's documents of 30 words or more hold, by counts over all documents.

    Few words can be in a fifth of all documents: at most five times the mean number of
    distinct words of a document reach the driver, for each language. A language of few
    documents takes the words of all languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            rows = [(g, w, n) for (g, w), n in held.items()]
            held.clear()
            cols = list(zip(*rows)) if rows else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "word", "n"])

        for b in batches:
            for group, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                words = WORD.findall(text.lower())
                if len(words) >= 30:
                    held.update([(group, w) for w in set(words)])
                    held[group, ""] += 1
                if len(held) > 500_000:
                    yield flush()
        yield flush()

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = cut(counted.where("n > 1 OR word = ''"))
    whole = counted.where("word = ''").select("lang", F.col("n").alias("docs"))
    rows = counted.where("word <> ''").join(F.broadcast(whole), "lang").where(F.col("n") >= F.greatest(F.lit(2.0), WIDE_SPREAD * F.col("docs"))).collect()
    out: dict[str, set[str]] = {}
    for r in rows:
        if r.docs >= FEW_DOCS:
            out.setdefault(r.lang, set()).add(r.word)
    every = frozenset(r.word for r in rows) if not out else frozenset().union(*out.values())
    return {k: frozenset(v) for k, v in out.items()} | {"": every}


def block_features(docs: DataFrame, words: dict[str, frozenset[str]]) -> DataFrame:
    """(doc_id, lang, whole, size, links, tags, repeats, function, entropy) of each block; whole: characters of the text."""
    schema = "doc_id long, lang string, whole long, size long, " + ", ".join(f"{f} float" for f in FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, group, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                known = words.get(group, words[""])
                # equal blocks of a text are measured once
                pieces = Counter(blocks_of(text))
                whole = sum(len(line) + 1 for line in text.splitlines() if line.strip()) - 1
                rows += [(doc, group, whole, len(p) * k, *features_of(p, known)) for p, k in pieces.items()]
            cols = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.float32()] * 5
            arrays = [pa.array(c, k, from_pandas=True) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "whole", "size", *FEATURES])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, schema)


def _standard(center: dict, scale: dict | None, feature: int) -> Column:
    """The feature's deviation from its language's median, in robust deviations if ``scale`` is given; 0 where unknown."""
    name = FEATURES[feature]

    def lookup(values: dict) -> Column:
        pairs = [x for lang, v in sorted(values.items()) for x in (F.lit(lang), F.lit(float(v[feature])))]
        return F.create_map(*pairs)[F.col("lang")]

    z = F.col(name).cast("double") - lookup(center)
    return z if scale is None else F.coalesce(z / lookup(scale), F.lit(0.0))


def spam_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``distance`` (squared) and ``spam``.

    Per language: medians, median absolute deviations (not below a least scale), and the
    correlation of deviations clipped at 2.5, all over all blocks. A language of few
    blocks, where spam could be the rule, takes the statistics of all languages.
    """
    # the rollup's row without a language holds all of them
    medians = blocks.rollup("lang").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.percentile_approx(f, 0.5, 2000), F.lit(0.0)).alias(f) for f in FEATURES]).collect()
    center = {r.lang: [r[f] for f in FEATURES] for r in medians}
    every = center.pop(None, None)
    few = {r.lang for r in medians if r.lang is not None and r.n < FEW_BLOCKS}
    center |= {lang: every for lang in few}
    if not center:
        return blocks.withColumn("distance", F.lit(0.0)).withColumn("spam", F.lit(False))
    off = [F.abs(_standard(center, None, i)) for i in range(5)]
    deviations = blocks.rollup("lang").agg(*[F.coalesce(F.percentile_approx(o, 0.5, 2000), F.lit(0.0)).alias(f) for o, f in zip(off, FEATURES)]).collect()
    scale = {r.lang: np.maximum(1.4826 * np.array([r[f] for f in FEATURES]), LEAST_SCALE) for r in deviations}
    every = scale.pop(None)
    scale |= {lang: every for lang in few}
    z = [_standard(center, scale, i) for i in range(5)]
    clipped = [F.greatest(F.lit(-2.5), F.least(F.lit(2.5), x)) for x in z]
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    moments = blocks.rollup("lang").agg(*[F.avg(clipped[i] * clipped[j]).alias(f"m{i}{j}") for i, j in pairs]).collect()
    inverse = {}
    for r in moments:
        m = np.zeros((5, 5))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}{j}"] or 0.0
        d = np.sqrt(np.maximum(np.diag(m), 0.05))
        inverse[r.lang] = np.linalg.inv(0.8 * m / np.outer(d, d) * (1 - np.eye(5)) + np.eye(5))

    every = inverse.pop(None)
    inverse |= {lang: every for lang in few}

    schema = blocks.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", distance double, spam boolean"
    names = [f.name for f in blocks.schema.fields]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in FEATURES], axis=1)
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            distance, spam = np.zeros(len(x)), np.zeros(len(x), dtype=bool)
            for lang in set(langs.tolist()):
                at = langs == lang
                dev = np.nan_to_num((x[at] - np.array(center[lang])) / scale[lang])
                distance[at] = np.einsum("ij,jk,ik->i", dev, inverse[lang], dev)
                directed = np.maximum(dev * SPAM_SIGNS, 0.0)
                part = (directed**2).sum(axis=1) / np.maximum((dev**2).sum(axis=1), 1e-9)
                spam[at] = (distance[at] > CUTOFF) & (part >= CONE) & (directed[:, :3].max(axis=1) > EVIDENCE)
            cols = [b.column(n) for n in names] + [pa.array(distance), pa.array(spam)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "distance", "spam"])

    return blocks.mapInArrow(judge, schema)


def spam_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", share: float = 0.5) -> DataFrame:
    """(doc_id, spam_share): documents of which more than ``share``, by characters, is spam.

    Null and blank texts are no cases. Unevenly written languages are brought to two
    letters; texts without one are a group of their own. Rows with the same doc_id are
    judged together. Whole texts are read, whatever their length.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), language(lang).alias("lang"), F.col(text).alias("text"))
    docs = docs.where(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    blocks = cut(block_features(docs, function_words(docs)))
    judged = spam_blocks(blocks).groupBy("doc_id").agg(
        F.sum(F.when(F.col("spam"), F.col("size")).otherwise(0)).alias("spam_chars"), F.max("whole").alias("whole")
    )
    share_of = F.col("spam_chars") / F.greatest("whole", F.lit(1))
    return judged.select("doc_id", share_of.alias("spam_share")).where(F.col("spam_share") > share)
