"""A table's markup as rows of the table of summary statistics, or the reason why not."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.functions import patterns as P
from tabsift.operators import detect as D
from tabsift.operators import grid as G

STATS = ["statistic", "stat1", "stat2", "stat3", "stat4", "dp1", "dp2", "sample_size"]


def interpret(wrap: str, footnote: str = "", caption: str = "") -> dict:
    """(reason, rows, pvalues_in_table, pvalues) of one table wrap; reason is None for a table that can be used."""
    try:
        return _interpret(wrap, footnote, caption)
    except G.Stop as s:
        return {"reason": s.reason, "rows": [], "pvalues_in_table": s.pvalues, "pvalues": []}


def _interpret(wrap: str, footnote: str, caption: str) -> dict:
    inside = " ".join(G.squish(re.sub("<[^>]*>", " ", x)) for x in re.findall(r"(?s)<tfoot.*?</tfoot>", wrap))
    footnote = G.squish(re.sub(r"[^0-9|a-z=<>% ]", " ", f"{footnote} {inside}".lower()))
    g = G.open_table(wrap)
    G.drop_blank_and_repeated(g)
    G.name_columns(g)
    G.reject_follow_up(g)
    G.unique_names(g)
    G.transpose_if_turned(g)
    g.rows = [[G.squish(r[0]), *r[1:]] for r in g.rows]
    G.sizes_to_heading(g)
    g.need_columns()
    if G.merge_labels(g):
        g.need_columns()
        G.merge_labels(g)
    g.need_columns()
    g.apply(G.flag_median)
    G.merge_brackets(g)
    G.mark_percents(g, footnote)
    G.plain_cells(g)
    G.drop_totals(g)
    tests = G.drop_tests(g)
    G.merge_neighbours(g)
    G.merge_rows(g, ["mean"], ["sd", "standard deviation", r"95%\s?c.?i.?"])
    G.merge_rows(g, ["median"], ["iqr", "range"])
    G.drop_size_columns(g)
    g.need_columns()
    G.drop_unwanted_rows(g)
    start = G.first_data_row(g)
    g.rows = [[f"n={x}" for x in r] if r[0] == "n" else r for r in g.rows]
    header, body = g.rows[:start], g.rows[start:]
    # Rows that give sizes again
    body = [r for r in body if sum(G.has("n ?= ?[0-9]", G.squish(x)) for x in r) != g.width - 1]
    kinds, pcols = D.detect_sections(body, g.names, header, footnote, caption)
    keep = [k for k in range(g.width) if k not in pcols]
    in_table = bool(pcols) or G.has(P.P_VALUE, footnote) or G.has(P.P_VALUE, tests) or "pvals" in kinds
    if len(keep) < 2 or keep[0] != 0:
        raise G.Stop(G.ONE_COLUMN, in_table)
    left = [[r[k] for k in keep] for r in body]
    numeric = G.numeric_rows(left)
    shown = [k for k in numeric if kinds[k]]
    number = {k: i + 1 for i, k in enumerate(numeric)}
    cells = [t | {"row": number[k], "column": c, "statistic": kinds[k]} for k in shown for c in range(1, len(keep)) if (t := D.tokens(left[k][c]))]
    pvalues = [{"row": number[k], "pvalue": re.sub("[ a-zA-Z]", "", body[k][min(pcols)])} for k in numeric] if pcols else []
    if not cells:
        raise G.Stop("Could not detect statistics")
    sizes = D.estimate_sizes(g.names[1:], [r[1:] for r in header], g.rows[:4], cells)
    if len(sizes) < 2:
        raise G.Stop("Just one sample size" if sizes else "No sample size", in_table)
    cells = D.merge_mirrors(D.drop_repeated_columns(D.attach_sizes(cells, sizes)))
    return {"reason": None, "rows": cells, "pvalues_in_table": in_table, "pvalues": pvalues}


_CELL = pa.struct([("row", pa.float64()), ("column", pa.int32()), ("statistic", pa.string()), *[(f"stat{i}", pa.float64()) for i in (1, 2, 3, 4)], ("dp1", pa.int32()), ("dp2", pa.int32()), ("sample_size", pa.float64())])
_SCHEMA = "reason string, rows array<struct<row double, column int, statistic string, stat1 double, stat2 double, stat3 double, stat4 double, dp1 int, dp2 int, sample_size double>>, pvalues_in_table boolean, pvalues array<struct<row double, pvalue string>>"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [interpret(w or "", f or "", c or "") for w, f, c in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
        rows = [[{k: (float(v) if k == "row" else v) for k, v in c.items()} for c in g["rows"]] for g in got]
        pvals = [[{"row": float(p["row"]), "pvalue": p["pvalue"]} for p in g["pvalues"]] for g in got]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([g["reason"] for g in got], pa.string()), pa.array(rows, pa.list_(_CELL)), pa.array([g["pvalues_in_table"] for g in got], pa.bool_()), pa.array(pvals, pa.list_(pa.struct([("row", pa.float64()), ("pvalue", pa.string())])))],
            ["pmcid", "reason", "rows", "pvalues_in_table", "pvalues"],
        )


def interpret_tables(tables: DataFrame) -> DataFrame:
    """interpret() of every row of (pmcid, wrap, footnote, caption); one narrow stage, a row in and a row out."""
    return tables.select("pmcid", "wrap", "footnote", "caption").mapInArrow(_run, f"pmcid string, {_SCHEMA}")


def table_data(interpreted: DataFrame) -> DataFrame:
    """The usable tables' cells as a table of summary statistics."""
    return interpreted.filter("reason IS NULL").select("pmcid", F.explode("rows").alias("c")).select("pmcid", "c.*")


def p_values(interpreted: DataFrame) -> DataFrame:
    """(pmcid, row, pvalue): printed p-values that are numbers from 0 to 1."""
    from tabsift.functions.na import as_number

    p = interpreted.select("pmcid", F.explode("pvalues").alias("p")).select("pmcid", "p.row", as_number(F.col("p.pvalue")).alias("pvalue"))
    return p.filter("pvalue BETWEEN 0 AND 1")


def cells(tables: DataFrame) -> DataFrame:
    """(pmcid, r, c, is_header, text): the grid of each row of (pmcid, wrap), spans filled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(p, r, c, r == 0, x) for p, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r, line in enumerate(G.parse(w or "")) for c, x in enumerate(line)]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string()))], ["pmcid", "r", "c", "is_header", "text"])

    return tables.select("pmcid", "wrap").mapInArrow(run, "pmcid string, r int, c int, is_header boolean, text string")
