"""From the full text of papers to their baseline tables, designs and reasons for exclusion.

A paper is parsed once, in a worker, to its metadata, paragraphs and tables;
everything that follows is expressions over these columns.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.functions import patterns as P
from tabsift.functions.storage import checkpointed
from tabsift.functions.text import country_name, publication_date, repair_numbers, roman, squish

#: Rewrites of the markup before it is parsed, in order.
REWRITES = [
    (r"(?s)<!DOCTYPE[^>]*>|<\?xml[^>]*\?>", ""),
    (r"<xref[^>]*>|</xref>", " "),
    (r"<break ?/?>|</break>", " "),
    (r"<underline>\+</underline>", "±"),
    (r"\bn\s?[0-9]=", "n="),
    (r"&(?!#?[0-9A-Za-z]{1,10};)", "&amp;"),
]
_DROPPED = ("boxed-text", "supplementary-material", "graphic", "permissions")
_TABLE = pa.struct([("wrap", pa.string()), ("caption", pa.string()), ("footnote", pa.string()), ("text", pa.string())])
_FIELDS = [("title", pa.string()), ("abstract", pa.string()), ("year", pa.int32()), ("month", pa.int32()), ("day", pa.int32()), ("journal", pa.string()), ("country_tag", pa.string()), ("affiliation", pa.string()), ("body", pa.string()), ("paragraphs", pa.list_(pa.string())), ("tables", pa.list_(_TABLE))]
_SCHEMA = "title string, abstract string, year int, month int, day int, journal string, country_tag string, affiliation string, body string, paragraphs array<string>, tables array<struct<wrap string, caption string, footnote string, text string>>"


def _text(e: ET.Element | None) -> str | None:
    return None if e is None else re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def _caption(wrap: ET.Element) -> str:
    c = wrap.find(".//caption")
    if c is None:
        return ""
    ps = [_text(p) or "" for p in c.iter("p")]
    return " ".join([_text(t) or "" for t in c.iter("title")] + ps).strip() if ps else _text(c) or ""


def parse_paper(xml: str) -> dict | None:
    """Metadata, paragraphs and tables of a paper; None if its markup can't be read."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    date = next(iter(root.iter("pub-date")), None)
    part = lambda k: int(x) if date is not None and (x := (date.findtext(k) or "").strip()).isdigit() else None
    aff = next(iter(root.iter("aff")), None)
    out = {
        "title": _text(next(iter(root.iter("article-title")), None)),
        "abstract": _text(next(iter(root.iter("abstract")), None)),
        "year": part("year"),
        "month": part("month"),
        "day": part("day"),
        "journal": _text(next(iter(root.iter("journal-title")), None)),
        "country_tag": None if aff is None else _text(next(iter(aff.iter("country")), None)),
        "affiliation": _text(aff),
    }
    for parent in list(root.iter()):
        for child in list(parent):
            if child.tag in _DROPPED:
                parent.remove(child)
    body = next(iter(root.iter("body")), None)
    out["body"] = _text(body)
    tables, paragraphs = [], []
    if body is not None:
        for w in body.iter("table-wrap"):
            feet = " ".join(_text(f) or "" for f in w.iter("table-wrap-foot"))
            tables.append({"wrap": ET.tostring(w, encoding="unicode"), "caption": _caption(w), "footnote": feet, "text": " ".join(_text(t) or "" for t in w.iter("table"))})
        inside = {id(e) for w in body.iter("table-wrap") for e in w.iter()}
        for e in body.iter():
            if e.tag in ("title", "p") and id(e) not in inside:
                paragraphs.append(("# " if e.tag == "title" else "") + (_text(e) or ""))
    return out | {"tables": tables, "paragraphs": paragraphs}


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [parse_paper(x) if x else None for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g is not None for g in got]), *(pa.array([g[k] if g else None for g in got], t) for k, t in _FIELDS)], ["pmcid", "readable", *(k for k, _ in _FIELDS)])


def parse_papers(papers: DataFrame) -> DataFrame:
    """Columns of parse_paper() for every row of (pmcid, xml), after the rewrites and repairs of its text."""
    xml = reduce(lambda c, r: F.regexp_replace(c, *r), REWRITES, F.col("xml"))
    return papers.select("pmcid", repair_numbers(xml).alias("xml")).mapInArrow(_run, f"pmcid string, readable boolean, {_SCHEMA}")


def plain_caption(c: Column) -> Column:
    return squish(F.regexp_replace(F.lower(c), r"[^0-9|a-z ]", ""))


def candidate_tables(parsed: DataFrame) -> DataFrame:
    """(pmcid, table_no, wrap, caption, footnote, text, words, candidate): T3, tables by number with the baseline words of their captions."""
    t = parsed.select("pmcid", F.posexplode("tables").alias("i", "t")).select("pmcid", (F.col("i") + 1).alias("table_no"), "t.*").withColumn("caption", plain_caption(F.col("caption")))
    words = F.regexp_count("caption", F.lit(P.BASELINE))
    return t.withColumns({"words": words, "candidate": (words > 0) & ~F.col("caption").rlike(P.NOT_BASELINE)})


def enough_numbers(text: Column) -> Column:
    """T5: a tenth as many digits as letters, at least."""
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit("[0-9]")), F.regexp_count(text, F.lit("[a-z]"))) >= 0.1, F.length(text) > 0)


def choose_tables(candidates: DataFrame) -> DataFrame:
    """(pmcid, table_no, named_no, wrap, caption, footnote): the table to read, and the number that the text is searched for.

    Read is the first candidate that isn't text. The number searched for starts
    at the caption with the most baseline words, the first of several, and moves
    on by as many candidates as were passed over, as published.
    """
    listed = candidates.groupBy("pmcid").agg(
        F.array_sort(F.collect_list(F.when(F.col("candidate"), F.struct("table_no", "wrap", "caption", "footnote", "text")))).alias("c"),
        F.max_by("table_no", F.struct("words", -F.col("table_no"))).alias("most"),
    )
    nth = F.expr("array_position(transform(c, x -> coalesce(try_divide(regexp_count(x.text, '[0-9]'), regexp_count(x.text, '[a-z]')) >= 0.1, length(x.text) > 0)), true)").cast("int")
    only = F.when(F.size("c") == 1, F.col("c")[0]["table_no"]).otherwise(F.col("most"))
    chosen = listed.filter(F.size("c") > 0).withColumn("nth", nth).filter("nth > 0").withColumn("x", F.expr("c[nth - 1]"))
    return chosen.select("pmcid", F.col("x.table_no").alias("table_no"), (only + F.col("nth") - 1).alias("named_no"), "x.wrap", "x.caption", "x.footnote")


def screen(parsed: DataFrame, chosen: DataFrame, exclude_non_trials: bool = True) -> DataFrame:
    """(pmcid, reason): T2, the first reason against each paper, null for none."""
    has_candidate = candidate_tables(parsed).groupBy("pmcid").agg(F.bool_or("candidate").alias("has_candidate"))
    joined = parsed.join(has_candidate, "pmcid", "left").join(chosen.select("pmcid", F.col("caption").alias("chosen_caption")), "pmcid", "left")
    title, abstract = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("abstract", F.lit("")))
    no_trial = title.rlike(P.NOT_TRIAL_TITLE) | abstract.rlike(P.NOT_TRIAL_ABSTRACT)
    reason = (
        F.when(~F.col("readable"), "Full text not available")
        .when(title.rlike("single.arm") | abstract.rlike("single.arm"), "Single-arm study")
        .when(F.lit(exclude_non_trials) & no_trial, "Not an RCT")
        .when(~F.coalesce("has_candidate", F.lit(False)), "No baseline table")
        .when(F.col("chosen_caption").isNull(), "No baseline table")
        .when(F.col("chosen_caption").rlike(P.FOLLOW_UP), "Follow-up results in baseline table")
    )
    return joined.select("pmcid", reason.alias("reason"))


def p_value_in_text(parsed: DataFrame, chosen: DataFrame) -> DataFrame:
    """(pmcid, in_text): T32, p-values in paragraphs of the results that name the table; null if none names it.

    The table may be named by an arabic or a roman number, up to 20.
    """
    numerals = F.create_map(*[F.lit(x) for k in range(1, 21) for x in (k, roman(k))])
    paragraphs = parsed.select("pmcid", F.posexplode("paragraphs").alias("i", "p")).withColumn("p", F.lower(squish(F.col("p"))))
    start = paragraphs.filter(F.col("p").rlike("^# .*results$|^# results")).groupBy("pmcid").agg(F.min("i").alias("from"))
    named = chosen.select("pmcid", F.col("named_no").cast("int").alias("k")).withColumn("form", F.format_string(r"\btab(le)?s?.(%d|%s)\b", F.col("k"), F.coalesce(numerals[F.col("k")], F.col("k").cast("string"))))
    hits = paragraphs.join(named, "pmcid").join(start, "pmcid", "left").filter(F.regexp_like("p", F.col("form")) & ~F.col("p").rlike("(supplementary|supplement|appendix) table") & (F.col("i") >= F.coalesce("from", F.lit(0))))
    found = hits.groupBy("pmcid").agg(F.bool_or(F.col("p").rlike(P.P_VALUE)).alias("in_text"))
    return chosen.select("pmcid").join(found, "pmcid", "left")


def design(parsed: DataFrame, chosen: DataFrame) -> DataFrame:
    """What is known of each paper's design, date and place."""
    text, title = F.coalesce("body", F.lit("")), F.coalesce("title", F.lit(""))
    table = chosen.select("pmcid", F.lower(F.concat_ws(" ", "footnote", F.regexp_replace("wrap", "<[^>]*>", " "))).alias("table_text"))
    return parsed.join(table, "pmcid", "left").select(
        "pmcid",
        publication_date(F.col("year"), F.col("month"), F.col("day")).alias("date"),
        "journal",
        country_name(F.coalesce("country_tag", "affiliation")).alias("affiliation"),
        (title.rlike(P.TRIAL) | F.coalesce("abstract", F.lit("")).rlike(P.TRIAL)).alias("rct"),
        F.lower(title).rlike(r"\bcluster\b").alias("cluster"),
        F.lower(title).rlike(r"\bpilot\b").alias("pilot"),
        text.rlike(P.BLOCKED).alias("block_randomisation"),
        text.rlike(P.ADAPTIVE).alias("adaptive_randomisation"),
        F.col("table_text").rlike(P.SEM).alias("sem"),
    )


def extract(papers: DataFrame, exclude_non_trials: bool = True) -> dict[str, DataFrame]:
    """The whole way from (pmcid, xml): ``table_data``, ``excluded``, ``pvalues``, ``pvals`` and ``design``.

    Parsed papers are used several times, so they are written once to the shared
    folder that spark.checkpoint.dir names.
    """
    from tabsift.operators import tables as T

    parsed = checkpointed(parse_papers(papers))
    chosen = choose_tables(candidate_tables(parsed))
    screened = screen(parsed, chosen, exclude_non_trials)
    usable = chosen.join(screened.filter("reason IS NULL"), "pmcid", "left_semi")
    read = checkpointed(T.interpret_tables(usable))
    excluded = screened.filter("reason IS NOT NULL").unionByName(read.filter("reason IS NOT NULL").select("pmcid", "reason"))
    known = read.filter("reason IS NULL OR reason = 'No sample size' OR pvalues_in_table IS NOT NULL").select("pmcid", F.col("pvalues_in_table").alias("in_table"))
    return {
        "table_data": T.table_data(read).distinct(),
        "excluded": excluded,
        "pvalues": known.join(p_value_in_text(parsed, chosen), "pmcid", "left"),
        "pvals": T.p_values(read),
        "design": design(parsed, chosen).join(read.filter("reason IS NULL"), "pmcid", "left_semi"),
    }
