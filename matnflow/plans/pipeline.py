"""The whole check: posts to fragments, fragments to hits in every source, hits to a result per post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fragments import fragments, strip_framing, strip_framing_original, strip_framing_service
from ..functions.normalize import first_words, report_letters, skeleton, too_short
from ..operators import labels as lb
from ..operators.match import Meaning, search_reports_by_meaning, search_verses_by_meaning, with_skeleton
from ..operators.rulings import check_rulings, check_rulings_service, close_by_letters, close_by_words, local_rulings
from ..operators.verdicts import confidence, first_source, fold_posts, found, report_kind, verse_kind
from ..profiles import EXTENSION, SERVICE, Profile
from ..session import cut, keep_apart, spread


def distinct_texts(rows: DataFrame, text: str = "text", number: str = "query") -> tuple[DataFrame, DataFrame]:
    """C14: (texts, rows with their number): each text once under a number of its own, so that what is asked twice is searched once.

    The numbers are those of a written table, so they are the same for every reader.
    """
    texts = cut(rows.select(text).where(F.col(text).isNotNull()).distinct().withColumn(number, F.monotonically_increasing_id()))
    return texts, rows.join(texts, text)


def _given(df: DataFrame, name: str) -> Column:
    """A column that a corpus may lack."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _joined(rows: Column, field: str, gap: str = " ") -> Column:
    return F.array_join(F.transform(rows, lambda r: F.coalesce(r[field], F.lit(""))), gap)


def _covered(hits: DataFrame, verses: DataFrame) -> DataFrame:
    """Hits with ``rows``, the verses of their span in order."""
    spans = hits.withColumn("pos", F.explode(F.sequence("first", "last")))
    told = verses.select("pos", "sura", "aya", F.coalesce("text", F.lit("")).alias("text"), _given(verses, "translation").alias("translation"))
    rows = spans.join(told, "pos").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("pos", "sura", "aya", "text", "translation"))).alias("rows"))
    return hits.join(rows, "query")


def _places(hits: DataFrame, verses: DataFrame) -> DataFrame:
    """(query, also): sura and verse of the other places of each hit, best first."""
    at = hits.select("query", F.posexplode("also_at").alias("no", "pos")).join(verses.select("pos", "sura", "aya"), "pos")
    entry = F.struct("no", F.concat_ws(":", F.col("sura").cast("string"), F.col("aya").cast("string")).alias("at"))
    return at.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["at"]).alias("also"))


def verse_results(asked: DataFrame, verses: DataFrame, profile: Profile, meaning: Meaning | None = None, lang: str = "ar") -> DataFrame:
    """(query, verse, first, last, sura): the verses' answer to each of asked (query, skeleton, text, verse_like)."""
    hits = search_verses_by_meaning(asked, verses, meaning, profile).withColumn("kind", verse_kind("similarity", profile)).where("kind IS NOT NULL")
    hits = cut(hits)
    whole = _covered(hits, verses).join(_places(hits, verses), "query", "left")
    one, last = F.element_at("rows", 1), F.element_at("rows", -1)
    label = F.concat(lb.sura_label(one["sura"], lang), F.lit(" "), lb.verse_range(one["aya"], last["aya"]))
    translation = F.nullif(F.trim(_joined(F.col("rows"), "translation")), F.lit(""))
    result = found(
        kind=F.col("kind"), source=_joined(F.col("rows"), "text"), similarity=F.col("similarity"), key=F.concat_ws(":", one["sura"].cast("string"), one["aya"].cast("string")),
        origin=F.lit("verses"), translation=translation, label=label, url=lb.verse_url(one["sura"], one["aya"]), also_at=F.coalesce("also", F.array().cast("array<string>")),
    )
    return whole.select("query", result.alias("verse"), one["aya"].alias("first"), last["aya"].alias("last"), one["sura"].alias("sura"))


def report_results(asked: DataFrame, reports: DataFrame, profile: Profile, meaning: Meaning | None = None, lang: str = "ar") -> DataFrame:
    """(query, report): the reports' answer to each of asked (query, skeleton, text, report_like)."""
    hits = search_reports_by_meaning(asked, reports, meaning, profile).withColumn("kind", report_kind("similarity", profile)).where("kind IS NOT NULL")
    told = reports.select("pos", F.col("text").alias("_text"), _given(reports, "id").alias("_id"), *[_given(reports, c).alias(f"_{c}") for c in ("translation", "grade", "attribution")])
    by = F.coalesce("_attribution", F.lit(""))
    ruling = F.array(F.struct(F.lit("").alias("scholar"), F.coalesce("_grade", F.lit("")).alias("ruling"), by.alias("book"), F.lit("").alias("page_or_number")))
    result = found(
        kind=F.col("kind"), source=F.col("_text"), similarity=F.col("similarity"), origin=F.lit("reports"), translation=F.col("_translation"),
        label=F.concat(F.lit(lb.REPORTS_NAME + " - "), by), url=lb.report_url("_id", lang), rulings=ruling,
    )
    return hits.join(told, "pos").select("query", result.alias("report"))


def _ruling(told: DataFrame) -> DataFrame:
    result = found(
        kind=F.col("kind"), source=F.col("source_text"), similarity=F.col("similarity"), origin=F.lit("rulings"),
        label=F.lit(lb.RULINGS_NAME), rulings=F.col("rulings"),
    )
    return told.select("query", result.alias("ruling"))


def check_posts(
    posts: DataFrame, verses: DataFrame, reports: DataFrame, rulings: DataFrame | None = None, profile: Profile = EXTENSION,
    manual: bool = False, records: DataFrame | None = None, meaning: Meaning | None = None, lang: str = "ar",
) -> DataFrame:
    """(post_id, religious, incomplete, verdicts) of posts (post_id, text), one row each.

    verses: (pos, sura, aya, text, and maybe translation); reports: (pos, id, text, and maybe
    translation, grade, attribution); rulings: (query, ord, text, scholar, ruling, book,
    page_or_number, failed), what a lookup by the unframed quote's first twelve words
    returned. records: a local source of rulings instead, (ord, text, scholar, ruling, book,
    page_or_number), looked up for the fragments that no verse or report answers. Pieces of
    one matching form are searched once, however many posts show them. A null text has no
    fragment; vectors are asked for a form's smallest wording.
    """
    pieces = cut(fragments(posts))  # read several times: the posts are taken apart once
    forms = pieces.groupBy("form", "report_like", "verse_like").agg(F.min("fragment").alias("text"))
    forms = cut(forms.withColumn("query", F.monotonically_increasing_id()))
    apart = keep_apart(forms, "query")
    # read by every step of the search: their forms are computed once, on all cores
    verses, reports = cut(with_skeleton(spread(verses))), cut(with_skeleton(spread(reports)))
    verse = verse_results(apart.select("query", skeleton("form").alias("skeleton"), "text", "verse_like"), verses, profile, meaning, lang).select("query", "verse")
    framed = apart.select("query", skeleton(strip_framing("form")).alias("skeleton"), strip_framing_original("text").alias("text"), "report_like")
    framed = cut(framed if meaning else framed.drop("text"))
    report = report_results(framed, reports, profile, meaning, lang)
    scored = apart.drop("text").join(verse.hint("merge"), "query", "left").join(report, "query", "left")
    if records is not None:
        scored = cut(scored)  # the fold asks for rulings of these only; the hits are computed once
        open_ = scored.where(F.col("verse").isNull() & F.col("report").isNull() & (F.col("report_like") | F.lit(manual)))
        pairs = local_rulings(open_.select("query", strip_framing("form").alias("text_q")), records, judge=close_by_letters(profile.ruling_same))
        scored = scored.join(_ruling(check_rulings(pairs, profile)), "query", "left").withColumn("failed", F.lit(False))
    elif rulings is None:
        scored = scored.withColumn("ruling", found()).withColumn("ruling", F.when(F.lit(False), F.col("ruling"))).withColumn("failed", F.lit(False))
    scored = pieces.join(scored.drop("query") if records is not None or rulings is None else scored, ["form", "report_like", "verse_like"])
    if records is None and rulings is not None:
        words = pieces.select("post_id", "frag_no", strip_framing("fragment").alias("text_q"), first_words(strip_framing_original("fragment")).alias("lookup"))
        words = words.withColumn("query", F.struct("post_id", "frag_no"))
        answered = words.join(rulings.withColumnRenamed("query", "lookup"), "lookup")
        told = _ruling(check_rulings(answered.where("NOT failed"), profile)).select("query.*", "ruling")
        failed = answered.groupBy("post_id", "frag_no").agg(F.max("failed").alias("failed"))
        scored = scored.join(told, ["post_id", "frag_no"], "left").join(failed, ["post_id", "frag_no"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    asked_for = lb.rulings_url(strip_framing_original("fragment"))
    scored = scored.withColumn("ruling", F.when(F.col("ruling").isNotNull(), F.col("ruling").withField("url", asked_for)))
    return fold_posts(scored.withColumn("skeleton", skeleton("form")), posts, manual)


def verify_texts(
    texts: DataFrame, verses: DataFrame, reports: DataFrame, rulings: DataFrame | None = None, profile: Profile = SERVICE,
    records: DataFrame | None = None, meaning: Meaning | None = None,
) -> DataFrame:
    """Whole texts (query, text) verified, one row each.

    (query, status, origin, kind, confidence, similarity, source, reference, ruling, correct,
    note, url). Verses come before reports and these before rulings (query, ord, text, scholar,
    ruling, book, page_or_number, and maybe failed: what was looked up for each text; or
    ``records``, a local source without ``query``, looked up for the texts that no verse or
    report answers). Null texts and those of fewer than four characters get the status
    ``needs_input``, one whose lookup failed ``error``; what no source holds is ``not_found``
    with low confidence. A text is searched once, however many rows show it.
    """
    base = texts.select("query", "text", too_short("text").alias("short"))
    once, rows = distinct_texts(base.where("NOT short").select(F.col("query").alias("row"), "text"))
    once = keep_apart(once, "query")
    verses, reports = cut(with_skeleton(spread(verses))), cut(with_skeleton(spread(reports)))
    verse = verse_results(with_skeleton(once).withColumn("verse_like", F.lit(False)), verses, profile, meaning)
    verse = verse.withColumn("verse", F.col("verse").withField("label", lb.verse_label("sura", "first", "last"))).select("query", "verse")
    # what a verse answers is not looked for in reports
    verse = cut(verse)
    core = strip_framing_service("text")
    framed = once.join(verse, "query", "left_anti").select("query", F.coalesce(skeleton(core), F.lit("")).alias("skeleton"), core.alias("text"), F.lit(False).alias("report_like"))
    report = report_results(framed, reports, profile, meaning).withColumn("report", F.col("report").withField("label", F.replace("report.label", F.lit(" - "), F.lit(" · "))))
    sure = lambda c: F.col(c).withField("confidence", confidence(F.col(c)["similarity"])).withField("note", F.lit(lb.NOTES[c + "s"]))
    out = once.select("query", "text").join(verse.withColumn("verse", sure("verse")), "query", "left").join(report.withColumn("report", sure("report")), "query", "left")
    card = lambda c: F.struct(*[F.col(c)[n].alias(n) for n in ("origin", "kind", "confidence", "similarity", "source", "label", "url", "note")], _graded(F.col(c)).alias("ruling"))
    out = cut(out.select("query", "text", F.when(F.col("verse").isNotNull(), card("verse")).alias("verse"), F.when(F.col("report").isNotNull(), card("report")).alias("report")))
    told = rows.join(out.drop("text"), "query").select(F.col("row").alias("query"), "verse", "report", F.col("query").alias("text_no"))
    sources, failed = [F.col("verse"), F.col("report")], F.lit(False)
    if records is not None or rulings is not None:
        if records is not None:
            open_ = out.where(F.col("verse").isNull() & F.col("report").isNull())
            pairs, number = local_rulings(open_.select("query", F.col("text").alias("text_q")), records, judge=close_by_words(profile.ruling_same), judged=report_letters), "text_no"
        else:
            pairs, number = base.select("query", F.col("text").alias("text_q")).join(rulings, "query"), "query"
            if "failed" in rulings.columns:
                told = told.join(pairs.groupBy("query").agg(F.max("failed").alias("failed")), "query", "left")
                pairs, failed = pairs.where("NOT failed"), F.coalesce("failed", F.lit(False))
        ruled = check_rulings_service(pairs, profile).where("kind <> 'not_found'")
        fields = {"origin": F.lit("rulings"), "kind": F.col("kind"), "confidence": F.col("confidence"), "similarity": F.col("similarity"), "source": F.col("source_text"), "label": F.lit(lb.RULINGS_NAME), "url": F.lit(None).cast("string"), "note": F.lit(None).cast("string"), "ruling": F.col("rulings")}
        told = told.join(ruled.select(F.col("query").alias(number), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("ruled")), number, "left")
        sources.append(F.col("ruled"))
    told = told.withColumn("r", first_source(*sources)).withColumn("failed", failed & F.col("r").isNull())
    out = base.join(told.select("query", "r", "failed"), "query", "left")
    asked = ~F.col("short") & ~F.coalesce("failed", F.lit(False))
    correct = F.when(F.col("r.kind") == "different_wording", F.col("r.source"))
    url = F.coalesce("r.url", F.when(F.col("r.origin") == "rulings", lb.rulings_url("text")))
    return out.select(
        "query", F.when(F.col("short"), "needs_input").when(F.col("failed"), "error").otherwise("ok").alias("status"), "r.origin",
        F.when(asked, F.coalesce("r.kind", F.lit("not_found"))).alias("kind"), F.when(asked, F.coalesce("r.confidence", F.lit("low"))).alias("confidence"),
        "r.similarity", "r.source", F.col("r.label").alias("reference"), "r.ruling", correct.alias("correct"), "r.note", url.alias("url"),
    )


def _graded(result: Column) -> Column:
    """A report's grade and attribution in one line; null where the source tells no ruling."""
    one = F.element_at(result["rulings"], 1)
    return F.when(result["rulings"].isNotNull(), F.array_join(F.filter(F.array(one["ruling"], one["book"]), lambda x: x != ""), " · "))
