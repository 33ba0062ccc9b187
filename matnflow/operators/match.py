"""Searching verses and reports for a quote: candidates, alignment, spans, best match."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import containment, containment_udf, containments, locate_many, once, partial_alignments, partial_ratio_udf
from ..functions.normalize import skeleton
from ..profiles import EXTENSION, MIN_LETTERS, REPORT_CANDIDATES, REPORT_LEAST, SERVICE, VERSE_CANDIDATES, VERSE_LEAST, Profile
from ..session import cut, keep_apart
from .candidates import neighbours, retrieve, with_extras
from .vectors import top_k

LEAST_VERSE = 10  # letters from which a whole verse is looked for inside a quote
GROWING = 0.9  # similarity from which a whole verse is grown
NEAR = 48  # verses on each side that a match is grown through before the whole sura is fetched
SPAN = T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
GROWN = T.StructType([*SPAN.fields, T.StructField("edge", T.BooleanType())])


def with_skeleton(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its skeleton; a null text has an empty one and matches nothing."""
    return df.withColumn("skeleton", F.coalesce(skeleton(text), F.lit("")))


def covered(start: int, end: int, lengths: list[int]) -> tuple[int, int] | None:
    """First and last of the adjoining pieces that a span covers by five letters or half of the piece; empty pieces don't count."""
    hit, at = [], 0
    for i, n in enumerate(lengths):
        if n and min(end, at + n) - max(start, at) >= min(5, (n + 1) // 2):
            hit.append(i)
        at += n
    return (hit[0], hit[-1]) if hit else None


def align_in_windows(queries: list[str], windows: list[list[dict]]) -> list[dict | None]:
    """Each quote aligned in its joined window; similarity and the positions that it covers."""
    distance, start, end = locate_many(queries, ["".join(w["skeleton"] for w in window) for window in windows])
    out = []
    for q, window, d, a, b in zip(queries, windows, distance.tolist(), start.tolist(), end.tolist()):
        span = covered(a, b, [len(w["skeleton"]) for w in window])
        out.append(span and {"similarity": 1 - d / len(q), "first": window[span[0]]["pos"], "last": window[span[1]]["pos"]})
    return out


def align_in_windows_service(queries: list[str], windows: list[list[dict]]) -> list[dict | None]:
    """The service profile: indel alignment, scored anew on the covered verses alone."""
    joined = ["".join(w["skeleton"] for w in window) for window in windows]
    spans = []
    for q, text, window, (_, start, end) in zip(queries, joined, windows, partial_alignments(queries, joined)):
        start, end = (0, len(text)) if len(q) > len(text) else (start, end)
        spans.append(covered(start, end, [len(w["skeleton"]) for w in window]))
    parts = ["".join(w["skeleton"] for w in window[s[0] : s[1] + 1]) if s else "" for s, window in zip(spans, windows)]
    ratios = partial_alignments(queries, parts)
    return [s and {"similarity": r, "first": window[s[0]]["pos"], "last": window[s[1]]["pos"]} for s, (r, _, _), window in zip(spans, ratios, windows)]


def grow(q: str, center: int, similarity: float, pieces: dict[int, str], low: float, high: float) -> dict:
    """Q2: a whole-verse match grown to neighbours that the quote holds as faithfully.

    ``pieces``: skeletons of the sura's verses from position ``low`` to ``high``; ``edge``
    if the growth asked for one beyond, so that it has to be repeated with more of them.
    """
    first = last = center
    while True:
        for a, b in ((first, last + 1), (first - 1, last)):
            new = b if b > last else a
            if not low <= new <= high:
                return {"similarity": similarity, "first": first, "last": last, "edge": True}
            if not pieces.get(new):  # another sura, or a verse without letters
                continue
            s = containment("".join(pieces[p] for p in range(a, b + 1)), q)
            if s >= similarity - 0.02:
                first, last, similarity = a, b, s
                break
        else:
            return {"similarity": similarity, "first": first, "last": last, "edge": False}


def spans_at(queries: list[str], centers: list[int], windows: list[list[dict]]) -> list[dict]:
    """Both spans of each candidate: the quote in its window, and the verse in the quote (if it is long enough) as far as the window shows."""
    inside = align_in_windows(queries, windows)
    own = [next(w for w in window if w["pos"] == center) for window, center in zip(windows, centers)]
    held = containments([o["skeleton"] for o in own], queries).tolist()
    out = []
    for q, center, window, o, similarity, span in zip(queries, centers, windows, own, held, inside):
        whole = None
        if len(o["skeleton"]) >= LEAST_VERSE:
            whole = {"similarity": similarity, "first": center, "last": center, "edge": False}
            if similarity >= GROWING:
                pieces = {w["pos"]: w["skeleton"] for w in window if w["sura"] == o["sura"]}
                whole = grow(q, center, similarity, pieces, center - 2, center + 3)
        out.append({"inside": span, "whole": whole})
    return out


def grow_within(q: str, center: int, reach: int | None, around: list[dict]) -> dict:
    """``grow`` from the start, with the verses up to ``reach`` places away, or the whole sura."""
    pieces = {w["pos"]: w["skeleton"] for w in around}
    low, high = (float("-inf"), float("inf")) if reach is None else (center - reach, center + reach)
    return grow(q, center, containment(pieces[center], q), pieces, low, high)


_ARROW = {T.DoubleType: pa.float64(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_()}


def _arrow_struct(kind: T.StructType) -> pa.DataType:
    return pa.struct([(f.name, _arrow_struct(f.dataType) if isinstance(f.dataType, T.StructType) else _ARROW[type(f.dataType)]) for f in kind.fields])


def _arrow_rows(kernel, kind: T.StructType, columns: int):
    """An Arrow function of a kernel over whole columns."""

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(kernel(a.to_pylist(), b.to_pylist()), _arrow_struct(kind))

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array(kernel(a.to_pylist(), b.to_pylist(), c.to_pylist()), _arrow_struct(kind))

    def four(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return pa.array(kernel(a.to_pylist(), b.to_pylist(), c.to_pylist(), d.to_pylist()), _arrow_struct(kind))

    return once(F.arrow_udf({2: two, 3: three, 4: four}[columns], kind))


BOTH = T.StructType([T.StructField("inside", SPAN), T.StructField("whole", GROWN)])


def _align_service(queries: pa.Array, windows: pa.Array) -> pa.Array:
    """``align_in_windows_service`` of columns; windows are taken apart by column, which is faster than by row."""
    rows, sizes = windows.flatten(), windows.value_lengths().to_pylist()
    pieces = iter([{"pos": p, "skeleton": s} for p, s in zip(rows.field("pos").to_pylist(), rows.field("skeleton").to_pylist())])
    return pa.array(align_in_windows_service(queries.to_pylist(), [list(islice(pieces, n)) for n in sizes]), _arrow_struct(SPAN))


align_service_udf = once(F.arrow_udf(_align_service, SPAN))
spans_udf = _arrow_rows(spans_at, BOTH, 3)
grow_udf = _arrow_rows(lambda *columns: [grow_within(*r) for r in zip(*columns)], GROWN, 4)


def verse_candidates(queries: DataFrame, corpus: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """J1-J5 for verses: (query, pos, rank)."""
    found = retrieve(queries, corpus, VERSE_LEAST, VERSE_CANDIDATES).select("query", "pos", "rank")
    return with_extras(found, extras, corpus) if extras is not None else found


def _around(corpus: DataFrame, positions: DataFrame, reach: int) -> DataFrame:
    """(pos, around): the verses of the same sura up to ``reach`` places away, for the asked positions only."""
    wanted = positions.select("pos").distinct().join(corpus.select("pos", "sura"), "pos")
    steps = wanted.select(F.col("pos").alias("center"), F.col("sura").alias("s"), F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)).alias("pos"))
    near = steps.join(corpus.select("pos", "sura", "skeleton"), "pos").where(F.col("sura").eqNullSafe(F.col("s")))
    return near.groupBy(F.col("center").alias("pos")).agg(F.collect_list(F.struct("pos", "skeleton")).alias("around"))


def verse_spans(queries: DataFrame, corpus: DataFrame, extras: DataFrame | None = None, profile: Profile = EXTENSION) -> DataFrame:
    """(query, pos, rank, kind, similarity, first, last): every scored span of each query (query, skeleton).

    Kind 0 aligns the quote in the verses around a candidate, kind 1 finds a candidate
    verse whole inside the quote and grows it. Queries of fewer than twelve letters have none.
    """
    asked = queries.where(F.length("skeleton") >= MIN_LETTERS).select("query", F.col("skeleton"))
    found = verse_candidates(asked, corpus, extras).join(asked.withColumnRenamed("skeleton", "q"), "query")
    found = keep_apart(found, "pos")  # merge joins keep these tasks; a broadcast of this side would leave the kernel to few
    if profile.within_sura:
        inside = found.join(neighbours(corpus, same="sura").hint("merge"), "pos").withColumn("span", align_service_udf("q", "window")).where("span IS NOT NULL")
        return inside.select("query", "pos", "rank", F.lit(0).alias("kind"), "span.similarity", "span.first", "span.last")
    scored = found.join(neighbours(corpus, carry="sura").hint("merge"), "pos").withColumn("s", spans_udf("q", "pos", "window"))
    scored = cut(scored.select("query", "pos", "rank", "s"))  # read three times, aligned once
    inside = scored.where("s.inside IS NOT NULL").select("query", "pos", "rank", F.lit(0).alias("kind"), "s.inside.*")
    whole = scored.where("s.whole IS NOT NULL AND NOT s.whole.edge").select("query", "pos", "rank", F.lit(1).alias("kind"), "s.whole.similarity", "s.whole.first", "s.whole.last")
    # growth beyond the window is repeated with more verses, and beyond those with the whole sura
    columns = ["query", "pos", "rank", F.lit(1).alias("kind"), "g.similarity", "g.first", "g.last"]
    wide = scored.where("s.whole.edge").select("query", "pos", "rank").join(asked.withColumnRenamed("skeleton", "q"), "query")
    grown = wide.join(_around(corpus, wide, NEAR), "pos").withColumn("g", grow_udf("q", "pos", F.lit(NEAR), "around"))
    grown = cut(grown.select("query", "pos", "rank", "g"))
    again = grown.where("g.edge").select("query", "pos", "rank").join(asked.withColumnRenamed("skeleton", "q"), "query")
    suras = corpus.select("pos", "skeleton", "sura").join(again.select("pos").distinct().join(corpus.select("pos", "sura"), "pos").select("sura").distinct(), "sura", "left_semi")
    suras = suras.groupBy("sura").agg(F.collect_list(F.struct("pos", "skeleton")).alias("around"))
    again = again.join(corpus.select("pos", "sura"), "pos").join(suras, "sura").withColumn("g", grow_udf("q", "pos", F.lit(None).cast("int"), "around"))
    return inside.unionByName(whole).unionByName(grown.where("NOT g.edge").select(*columns)).unionByName(again.select(*columns))


def search_verses(queries: DataFrame, corpus: DataFrame, extras: DataFrame | None = None, profile: Profile = EXTENSION) -> DataFrame:
    """Q1, Q3, Q4: (query, similarity, first, last, also_at): the best span of each query that has one.

    Ties go to the span that begins first, then to the better candidate. ``also_at``:
    beginnings of other spans within 0.005 of the best and outside of it, best first.
    A query has some thirty spans, so they are gathered in one row.
    """
    spans = verse_spans(queries, corpus, extras, profile)
    row = F.struct((-F.col("similarity")).alias("far"), "first", "rank", "kind", "last")
    gathered = spans.groupBy("query").agg(F.array_sort(F.collect_list(row)).alias("spans")).withColumn("best", F.element_at("spans", 1))
    outside = F.filter(
        "spans",
        lambda s: (s["far"] - F.col("best.far") <= 0.005) & ((s["first"] < F.col("best.first")) | (s["first"] > F.col("best.last"))),
    )
    also = F.array_distinct(F.transform(outside, lambda s: s["first"]))
    also = F.array().cast("array<int>") if profile.within_sura else also
    return gathered.select("query", F.greatest(F.lit(0.0), -F.col("best.far")).alias("similarity"), "best.first", "best.last", also.alias("also_at"))


def report_candidates(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """J1-J4 for reports: (query, pos, rank) with both skeletons as q and s."""
    asked = queries.where(F.length("skeleton") >= MIN_LETTERS).select("query", "skeleton")
    found = retrieve(asked, corpus, REPORT_LEAST, REPORT_CANDIDATES)
    found = keep_apart(found.join(asked.withColumnRenamed("skeleton", "q"), "query"), "pos")
    return found.join(corpus.select("pos", F.col("skeleton").alias("s")).hint("merge"), "pos").select("query", "pos", "rank", "q", "s")


def search_reports(queries: DataFrame, corpus: DataFrame, profile: Profile = EXTENSION) -> DataFrame:
    """Q5, Q6: (query, pos, similarity) of the best report.

    Extension profile: containment of the quote, ties to the first candidate. Service
    profile: partial ratio, ties to the largest position.
    """
    service = profile.within_sura
    scored = report_candidates(queries, corpus).withColumn("similarity", (partial_ratio_udf if service else containment_udf)("q", "s"))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), F.desc("pos") if service else F.asc("rank"))
    return scored.withColumn("k", F.row_number().over(order)).where("k = 1").select("query", "pos", "similarity")


def score_at(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, profile: Profile = EXTENSION) -> DataFrame:
    """Q7: given pairs (query, pos) with their similarity; pairs outside of the corpus are dropped."""
    joined = pairs.join(queries.select("query", F.col("skeleton").alias("q")), "query").join(corpus.select("pos", F.col("skeleton").alias("s")), "pos")
    return joined.withColumn("similarity", (partial_ratio_udf if profile.within_sura else containment_udf)("q", "s")).drop("q", "s")


@dataclass
class Meaning:
    """Vectors as an optional second source of candidates (E5-E9); without them every search is by wording alone.

    ``embed`` gives the vector of a text (a column expression of a text column, such as a
    ``predict_batch_udf``); verses and reports: (pos, vector) of the corpora.
    """

    embed: Callable[[Column], Column]
    verses: DataFrame | None = None
    reports: DataFrame | None = None
    k: int = 10

    def near(self, texts: DataFrame, vectors: DataFrame) -> DataFrame:
        """(query, pos, score, rank) of texts (query, text): the k nearest records of each."""
        asked = texts.select("query", self.embed(F.col("text")).alias("vector"))
        return top_k(asked, vectors, self.k)


def search_verses_by_meaning(asked: DataFrame, corpus: DataFrame, meaning: Meaning | None, profile: Profile = EXTENSION) -> DataFrame:
    """``search_verses`` of asked (query, skeleton, text, verse_like), helped by vectors where they can matter.

    Extension profile: quotes framed as verses, and near misses, that wording alone leaves
    below the close threshold are searched again with the nearest verses as candidates.
    Service profile: the nearest verses are candidates of every search.
    """
    slim = asked.select("query", "skeleton")
    if meaning is None or meaning.verses is None:
        return search_verses(slim, corpus, profile=profile)
    if profile.semantic_always:
        near = cut(meaning.near(asked.where(F.length("skeleton") >= MIN_LETTERS), meaning.verses))
        return verse_gate(search_verses(slim, corpus, near, profile), near, profile)
    hits = cut(search_verses(slim, corpus, profile=profile))
    known = asked.join(hits.select("query", F.col("similarity").alias("s")), "query", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    open_ = known.where((F.col("s") < profile.verse_close) & (F.col("verse_like") | (F.col("s") >= profile.semantic_floor)))
    near = cut(meaning.near(open_, meaning.verses))
    again = search_verses(slim.join(near.select("query").distinct(), "query", "left_semi"), corpus, near, profile)
    better = again.join(open_.select("query", "s"), "query").where(F.col("similarity") >= F.col("s")).drop("s")
    better = cut(better)
    return verse_gate(hits.join(better.select("query"), "query", "left_anti").unionByName(better), near, profile)


def search_reports_by_meaning(asked: DataFrame, corpus: DataFrame, meaning: Meaning | None, profile: Profile = EXTENSION) -> DataFrame:
    """``search_reports`` of asked (query, skeleton, text, report_like), helped by vectors where no report is close.

    Extension profile: only texts framed as reports.
    """
    slim = asked.select("query", "skeleton")
    hits = search_reports(slim, corpus, profile)
    if meaning is None or meaning.reports is None:
        return hits
    hits = cut(hits)
    framed = asked if profile.semantic_always else asked.where("report_like")
    close = hits.where(F.col("similarity") >= profile.report_close).select("query")
    near = cut(meaning.near(framed.where(F.length("skeleton") >= MIN_LETTERS).join(close, "query", "left_anti"), meaning.reports))
    return report_gate(slim, hits, near, corpus, profile)


def verse_gate(hits: DataFrame, near: DataFrame, profile: Profile = EXTENSION) -> DataFrame:
    """Hits lifted to the close threshold where a vector inside their span is near and the wording shares the floor.

    near: (query, pos, score). A search without vectors stays as it is (E9).
    """
    inside = hits.join(near.select("query", "pos", "score"), "query", "left").where((F.col("pos") >= F.col("first")) & (F.col("pos") <= F.col("last")))
    best = inside.groupBy("query").agg(F.max("score").alias("cosine"))
    lifted = (F.col("similarity") < profile.verse_close) & (F.col("similarity") >= profile.semantic_floor) & (F.coalesce("cosine", F.lit(0.0)) >= profile.semantic_least)
    return hits.join(best, "query", "left").withColumn("similarity", F.when(lifted, profile.verse_close).otherwise(F.col("similarity"))).drop("cosine")


def report_gate(queries: DataFrame, hits: DataFrame, near: DataFrame, corpus: DataFrame, profile: Profile = EXTENSION) -> DataFrame:
    """Where no report is close, the first near one (by score) that shares the floor of wording, at the close threshold."""
    open_ = queries.join(hits.where(F.col("similarity") >= profile.report_close).select("query"), "query", "left_anti")
    likely = near.where(F.col("score") >= profile.semantic_least).join(open_.select("query"), "query", "left_semi")
    scored = score_at(likely.select("query", "pos", "score"), queries, corpus, profile).where(F.col("similarity") >= profile.semantic_floor)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "pos")
    lifted = scored.withColumn("k", F.row_number().over(order)).where("k = 1").select("query", "pos", F.lit(profile.report_close).alias("similarity"))
    return hits.join(lifted.select("query"), "query", "left_anti").unionByName(lifted)
