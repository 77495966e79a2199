"""Queries of table grids and papers over small made tables; their SQL lists the rows expected, worked out by hand from the rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsift.operators import detect as D
from tabsift.operators import documents, tables
from tabsift.operators import grid as G
from tabsift.plans.registry import ORACLE, QUERIES

Cases = list[tuple[str, str, str]]


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of a table of literals."""

    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


def to_grid(text: str) -> G.Grid:
    """Rows parted by ' ; ' and cells by '|', the heading first."""
    names, *rows = [line.split("|") for line in text.split(" ; ")]
    return G.Grid(names, rows)


def to_text(g: G.Grid) -> str:
    return " ; ".join("|".join(r) for r in [g.names, *g.rows])


def stage(name: str, step: Callable[[G.Grid], object], cases: Cases) -> None:
    """Register a repair of grids; what it returns, if anything, follows the grid."""

    def one(text: str) -> str:
        g = to_grid(text)
        try:
            extra = step(g)
        except G.Stop as s:
            return f"STOP {s.reason}"
        return to_text(g) if extra is None else f"{to_text(g)} => {extra}"

    scalar(name, one, cases)


def scalar(name: str, one: Callable[[str], object], cases: Cases) -> None:
    """Register a function of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"case_id": b["case_id"], "result": [str(one(x)) for x in b["input"]]})

    def query(spark: SparkSession, d: str) -> DataFrame:
        return spark.createDataFrame([c[:2] for c in cases], "case_id string, input string").mapInPandas(run, "case_id string, result string")

    QUERIES[name] = query
    ORACLE[name] = values("case_id, result", [(c[0], c[2]) for c in cases])


def _open(markup: str) -> str:
    try:
        return to_text(G.open_table(markup))
    except G.Stop as s:
        return f"STOP {s.reason}"


def _table(*rows: str) -> str:
    return "<table>" + "".join(f"<tr>{''.join(f'<td>{x}</td>' for x in r.split('|'))}</tr>" for r in rows) + "</table>"


scalar(
    "t1_x5_open_table",
    _open,
    [
        ("spans", '<table-wrap><table><thead><tr><th>A</th><th colspan="2">B</th></tr></thead><tbody><tr><td rowspan="2">x</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></tbody></table></table-wrap>', "A|B|B ; x|1|2 ; x|3|4"),
        ("doctype first", '<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.0 Transitional//EN" "http://www.w3.org/TR/REC-html40/loose.dtd">\n<?xml version="1.0" encoding="UTF-8"?><table-wrap><table><tr><th>A</th><th>B</th></tr><tr><td>a</td></tr><tr><td>b <b>c</b></td><td>2</td></tr></table></table-wrap>', "A|B ; a| ; b c|2"),
        ("foot", "<table><tr><th>A</th><th>B</th></tr><tfoot><tr><td>note</td></tr></tfoot><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2<br>3</td></tr></table>", "A|B ; a|1 ; b|2 3"),
        ("second table", _table("A|B", "a|1", "b|2") + _table("X|Y", "x|1", "y|2"), "A|B ; a|1 ; b|2"),
    ],
)
scalar("t6_unusable_tables", _open, [("graphic", "<table-wrap><inline-graphic/></table-wrap>", "STOP Table is graphic"), ("no rows", "<table-wrap><table></table></table-wrap>", "STOP Table is graphic"), ("only a heading", _table("A|B"), "STOP Table is graphic"), ("one row", _table("A|B", "a|1"), "STOP Complex format"), ("two rows", _table("A|B", "a|1", "b|2"), "A|B ; a|1 ; b|2")])
stage("t7_blank_and_repeated_rows", G.drop_blank_and_repeated, [("blank", "h|i ; x|1 ; |  ; y|2", "h|i ; x|1 ; y|2"), ("repeated", "h|i ; x|1 ; x|1 ; x|2 ; x|2", "h|i ; x|1 ; x|2"), ("apart", "h|i ; x|1 ; y|2 ; x|1", "h|i ; x|1 ; y|2 ; x|1")])


def _names(g: G.Grid) -> None:
    G.name_columns(g)
    G.unique_names(g)


stage(
    "t8_headings",
    _names,
    [
        ("sizes and blanks", "|Drug (20)|Drug (20)|%| ; a|1|2|3|4", "c1|drug n= 20|Adrug n= 20|%|c2 ; a|1|2|3|4"),
        ("variable once", "Variable|X*|X* ; a|1|2", "VARIABLES|x|Ax ; a|1|2"),
        ("variable twice", "Variable|Variable|x ; a|1|2", "VARIABLES|variable|x ; a|1|2"),
        ("variable thrice", "Variable|Variable|variable ; a|1|2", "STOP Difficult layout"),
    ],
)
stage("t9_follow_up", G.reject_follow_up, [("in heading", "label|change from baseline|b ; a|1|2", "STOP Follow-up results in baseline table"), ("in first row", "label|a|b ; |week 4|week 8 ; a|1|2", "STOP Follow-up results in baseline table"), ("later row", "label|a|b ; x|1|2 ; week 4|3|4", "label|a|b ; x|1|2 ; week 4|3|4")])
stage(
    "t10_r6_transpose",
    G.transpose_if_turned,
    [
        ("groups in rows", "group|score|mass|bmi|pulse ; drug|1|2|3|4 ; placebo|5|6|7|8", "label|drug|placebo ; score|1|5 ; mass|2|6 ; bmi|3|7 ; pulse|4|8"),
        ("no name", "group|score|mass|bmi|pulse ; |1|2|3|4 ; placebo|5|6|7|8", "label|A|placebo ; score|1|5 ; mass|2|6 ; bmi|3|7 ; pulse|4|8"),
        ("labels in heading", "arm|age|n ; drug|40|20 ; placebo|41|21 ; both|40|41", "label|drug|placebo|both ; age|40|41|40 ; n|20|21|41"),
        ("common label", "group|x|y|z ; age|1|2|3", "group|x|y|z ; age|1|2|3"),
        ("sizes in heading", "group|x n=3|y n=3|z ; mass|1|2|3", "group|x n=3|y n=3|z ; mass|1|2|3"),
    ],
)
stage(
    "t11_sizes_to_heading",
    G.sizes_to_heading,
    [
        ("row n", "variables|drug|placebo ; n|40|42 ; age|50|51", "variables n=n|drug n=40|placebo n=42 ; age|50|51"),
        ("percent cell", "label|drug|drug % ; total|40|100% ; age|50|51", "label n=total|drug n=40|drug %  ; age|50|51"),
        ("percent heading", "label|drug|drug % ; age|50|51 ; total|40|100", "label n=total|drug n=40|drug %  ; age|50|51"),
        ("none", "label|drug|placebo ; age|50|51", "label|drug|placebo ; age|50|51"),
    ],
)
stage("t12_r4_label_columns", G.merge_labels, [("text", "variable|level|drug ; sex|female|10 ; sex|male|9 ; note|note|1", "label|drug ; sex female|10 ; sex male|9 ; note|1 => True"), ("numbers", "variable|drug|placebo ; age|50|51 ; bmi|20 kg|21", "variable|drug|placebo ; age|50|51 ; bmi|20 kg|21 => False"), ("last row apart", "variable|drug|placebo ; age|50|51 ; note|see the text below|", "variable|drug|placebo ; age|50|51 ; note|see the text below| => False")])
stage(
    "t13_bracket_columns",
    G.merge_brackets,
    [
        ("spread", "label|mean|sd|c ; age|41.75|(12.66)|5 ; bmi|22.1|(3.2)|6 ; wt|70|(8)|7", "label|mean sd|c ; age|41.75 (12.66)|5 ; bmi|22.1 (3.2)|6 ; wt|70 (8)|7"),
        ("two groups", "label|a|a2|b|b2 ; age|1|(2)|3|(4) ; bmi|5|(6)|7|(8)", "label|a a2|b b2 ; age|1 (2)|3 (4) ; bmi|5 (6)|7 (8)"),
        ("few brackets", "label|a|b ; age|1|(2) ; bmi|5|6 ; wt|5|6", "label|a|b ; age|1|(2) ; bmi|5|6 ; wt|5|6"),
    ],
)


def _marked(g: G.Grid) -> None:
    footnote = g.names[-1] if g.names[-1].startswith("values") else ""
    G.mark_percents(g, footnote)


stage("t14_percent_marks", _marked, [("with means", "a|b ; age|41 ± 3 ; female|10 (25)", "a|b ; age|41 ± 3 ; female|10 (25%)"), ("footnote", "a|values are number ; female|10 (25.5)", "a|values are number ; female|10 (25.5%)"), ("has percents", "a|b ; age|41 ± 3 ; female|10 (25) ; male|3 (5%)", "a|b ; age|41 ± 3 ; female|10 (25) ; male|3 (5%)"), ("no hint", "a|b ; female|10 (25)", "a|b ; female|10 (25)")])
stage(
    "t15_totals_and_text_columns",
    G.drop_totals,
    [
        ("total and women", "label|drug n=20|placebo n=20|total n=40|women ; age|1|2|3|4", "label|drug n=20|placebo n=20 ; age|1|2"),
        ("total in first row", "label|a|b|c ; |drug|placebo|all ; age|1|2|3", "label|a|b ; |drug|placebo ; age|1|2"),
        ("first column stays", "total|a|b ; age|1|2", "total|a|b ; age|1|2"),
        ("text", "label|a|b|tool ; age|1|2|chart", "label|a|b ; age|1|2"),
        ("p values without numbers", "label|a|b|p value ; age|1|2|ns", "label|a|b|p value ; age|1|2|ns"),
        ("one group", "label|a|total ; age|1|2", "STOP Just one column in table"),
    ],
)
stage(
    "t15_tests_and_ranges",
    G.drop_tests,
    [
        ("test", "label|a|b|t test ; age|1|2|0.4 p = 0.7", "label|a|b ; age|1|2 => 0.4 p = 0.7"),
        ("pre and post", "label|pre|b|c ; age|1|2|3", "STOP Pre-post comparison"),
        ("range", "label|a|b|range ; age|1|2|3", "label|a|b ; age|1|2 => "),
        ("range in first row", "label|a|b|c ; |x|y|reference range ; age|1|2|3", "label|a|b ; |x|y ; age|1|2 => "),
    ],
)
stage(
    "t16_w2_neighbouring_columns",
    G.merge_neighbours,
    [
        ("mean and sd", "label|drug mean|drug sd|placebo mean|placebo sd ; age|41|12|42|11 ; bmi|22|3|23|4", "label|drug mean drug sd|placebo mean placebo sd ; age|41 12|42 11 ; bmi|22 3|23 4"),
        ("one pair", "label|drug mean|drug sd|other ; age|41|12|42 ; bmi|22|3|23", "label|drug mean|drug sd|other ; age|41|12|42 ; bmi|22|3|23"),
        ("percent before n", "label|drug %|drug n|placebo %|placebo n ; female|55%|22|57%|24 ; male|45%|18|43%|18", "label|drug n drug %|placebo n placebo % ; female|22 55%|24 57% ; male|18 45%|18 43%"),
        ("in first row", "label|a|b|c|d ; |median|iqr|median|iqr ; age|41|12|42|11", "label|a b|c d ; |median iqr|median iqr ; age|41 12|42 11"),
    ],
)
stage(
    "t17_neighbouring_rows",
    lambda g: G.merge_rows(g, ["mean"], ["sd", "standard deviation"]),
    [
        ("mean over sd", "label|a|b ; age|| ; mean|41|42 ; sd|12|11 ; bmi|20|21", "label|a|b ; age|| ; mean sd|41 12|42 11 ; bmi|20|21"),
        ("not from the first row", "label|a|b ; mean|41|42 ; sd|12|11", "label|a|b ; mean|41|42 ; sd|12|11"),
        ("takes in any row", "label|a|b ; age|| ; mean|41|42 ; bmi|20|21", "label|a|b ; age|| ; mean bmi|41 20|42 21"),
    ],
)
stage(
    "t18_size_columns",
    G.drop_size_columns,
    [
        ("to next heading", "label|n|drug|an|placebo ; age|40|50.1|42|51.2 ; bmi|40|22|43|23", "label|drug n=40|placebo n=42 ; age|50.1|51.2 ; bmi|22|23"),
        ("sizes known", "label|n|drug n=40|an|placebo n=42 ; age|40|50.1|42|51.2 ; bmi|40|22|43|23", "label|drug n=40|placebo n=42 ; age|50.1|51.2 ; bmi|22|23"),
        ("not only numbers", "label|n|drug ; age|40 (5)|50.1 ; bmi|22 (3)|22", "label|n|drug ; age|40 (5)|50.1 ; bmi|22 (3)|22"),
    ],
)
stage("t19_t20_rows", G.drop_unwanted_rows, [("ratios and totals", "label|a|b ; age|1|2 ; waist to hip ratio|3|4 ; odds ratio|5|6 ; total|7|8 ; geometric mean titre|9|9", "label|a|b ; age|1|2 ; waist to hip ratio|3|4"), ("label all over", "label|a|b ; sex|sex|sex ; age|1|2", "label|a|b ; sex|| ; age|1|2")])
stage("t21_first_data_row", G.first_data_row, [("third", "label|a|b ; group|drug arm|placebo ; n|n=20|n=21 ; age|50.1|49", "label|a|b ; group|drug arm|placebo ; n|n=20|n=21 ; age|50.1|49 => 2"), ("first", "label|a|b ; age|50.1|49", "label|a|b ; age|50.1|49 => 0"), ("one size", "label|a|b ; n|n=20|21 ; age|5|4", "label|a|b ; n|n=20|21 ; age|5|4 => 0")])
stage("t22_numeric_rows", lambda g: G.numeric_rows(g.rows), [("some", "h|a ; age|50.1 ; sex, n (%)| ; male|10 (5%) ; note|50 years old", "h|a ; age|50.1 ; sex, n (%)| ; male|10 (5%) ; note|50 years old => [0, 2]")])
stage("t23_sections", lambda g: D.sections(g.rows), [("one", "h|a|b ; age|50|51 ; bmi|20|21", "h|a|b ; age|50|51 ; bmi|20|21 => [(0, 2, None)]"), ("heading row", "h|a|b ; age|50|51 ; sex|| ; male|10|12 ; female|9|8", "h|a|b ; age|50|51 ; sex|| ; male|10|12 ; female|9|8 => [(0, 1, None), (2, 4, 1)]")])


def _flags(x: str) -> str:
    return " ".join(k for k, v in D.cell_flags(x).items() if v)


scalar("t24_cell_flags", _flags, [("percent", "12 (30%)", "percent"), ("mean", "41.2 ± 3", "continuous"), ("numbers", "12/30", "numbers"), ("extremes", "min 3 max 9", "min_max"), ("p", "p = 0.3", "pvals"), ("ci", "3 (1 to 5)", "ci median"), ("list", "1, 5", "ci"), ("range", "20 - 30", "median"), ("flagged", "20 !!! 10", "median"), ("none", "12.5", "")])


def _detected(text: str) -> str:
    head, *foot = text.split(" ## ")
    g = to_grid(head)
    kinds, columns = D.detect(g.rows, [g.names], foot[0] if foot else "", "")
    return f"{kinds} {sorted(columns)}"


scalar(
    "t25_t26_statistics",
    _detected,
    [
        ("labels", "label|a|b ; age, mean|50|51 ; female, %|10|12 ; weight, median (iqr)|70|71", "['continuous', 'percent', 'median'] []"),
        ("cells", "label|a|b ; x|50 ± 3|51 ± 4 ; y|10 (5%)|11 (6%) ; z|3 - 5|4 - 6", "['continuous', 'percent', 'median'] []"),
        ("carried on", "label|a|b ; x|50 ± 3|51 ± 4 ; y|5|6", "['continuous', 'continuous'] []"),
        ("nothing known", "label|a|b ; x|50|51", "[None] []"),
        ("tie goes to percent", "label|a|b ; x|5% ± 2|6% ± 2", "['percent'] []"),
        ("p values by heading", "label|a|p value ; x|50 ± 3|0.4", "['continuous'] [2]"),
        ("p values by cells", "label|a|b|c ; x|5 ± 3|6 ± 3|p = 0.4 ; y|5 ± 3|6 ± 3|p = 0.2", "['continuous', 'continuous'] [3]"),
        ("interval in heading", "label|a 95% ci|b 95% ci ; x|5 (3 to 7)|6 (4 to 8)", "['ci'] []"),
    ],
)
scalar(
    "t27_cell_numbers",
    lambda x: D.tokens(x) and " ".join(str(v) for v in D.tokens(x).values()),
    [("mean and sd", "41.50 ± 10.2", "41.5 10.2 None None 2 1"), ("count and percent", "22 (55%)", "22.0 55.0 None None 0 0"), ("three", "-1.5 (0.25, 3)", "-1.5 0.25 3.0 None 1 2"), ("four of five", "1 2 3 4 5", "1.0 2.0 3.0 4.0 0 0"), ("one", "7", "7.0 None None None 0 None"), ("text", "n/a", "None"), ("starts with none", "- 5", "None")],
)


def _cells(text: str) -> list[dict]:
    """row,column,statistic,stat1,stat2 parted by blanks."""
    out = []
    for c in text.split():
        r, k, s, a, b = c.split(",")
        out.append({"row": int(r), "column": int(k), "statistic": s, "stat1": float(a), "stat2": float(b) if b else None, "stat3": None, "dp1": 0})
    return out


def _sizes(text: str) -> str:
    names, header, top, cells = text.split(" ## ")
    rows = lambda x: [line.split("|") for line in x.split(" ; ")] if x else []
    return str({k: int(v) for k, v in sorted(D.estimate_sizes(names.split("|"), rows(header), rows(top), _cells(cells)).items())})


scalar(
    "t28_f15_sample_sizes",
    _sizes,
    [
        ("header row", "a|b ## x|y ; n = 20|n=21 ## age|1|2 ## ", "{1: 20, 2: 21}"),
        ("headings", "drug (n = 79)|placebo (n = 81) ##  ## age|1|2 ## ", "{1: 79, 2: 81}"),
        ("first rows", "a|b ##  ## age|1|2 ; size|n=5|n=6 ## ", "{1: 5, 2: 6}"),
        ("row label", "a|b ##  ## age|1|2 ; number of patients|15|16/20 ## ", "{1: 15, 2: 16}"),
        ("numbers", "a|b ##  ## x|1|2 ## 1,1,numbers,4,6 1,2,numbers,5,6 2,1,numbers,3,7 2,2,numbers,1,10", "{1: 10, 2: 11}"),
        ("percents", "a|b ##  ## x|1|2 ## 1,1,percent,5,50 1,2,percent,6,50 2,1,percent,1,10 2,2,percent,3,25", "{1: 10, 2: 12}"),
        ("percents disagree", "a|b ##  ## x|1|2 ## 1,1,percent,5,50 1,2,percent,6,50 2,1,percent,1,90 2,2,percent,3,90", "{}"),
    ],
)


def _attached(text: str) -> str:
    cells, sizes = text.split(" ## ")
    got = D.attach_sizes(_cells(cells), {int(k): float(v) for k, v in (x.split(":") for x in sizes.split())})
    return " ".join(f"{c['row']},{c['column']},{c['stat1']:g},{c['sample_size']:g}" for c in got)


scalar(
    "t29_attach_sizes",
    _attached,
    [
        ("by column", "1,1,percent,5, 1,2,percent,6, ## 1:10 2:12", "1,1,5,10 1,2,6,12"),
        ("shifted", "1,1,percent,5, 1,2,percent,6, ## 2:10 3:12", "1,1,5,10 1,2,6,12"),
        ("row of sizes", "1,1,numbers,10, 1,2,numbers,12, 2,1,percent,5, 2,2,percent,6, ## 1:10 2:12", "1,1,5,10 1,2,6,12"),
        ("no size", "1,1,percent,5, 1,2,percent,6, 1,3,percent,7, ## 1:10 2:12", "1,1,5,10 1,2,6,12"),
    ],
)
_show = lambda cells: " ".join(f"{c['row']},{c['column']},{c['stat1']:g}" for c in cells)
scalar(
    "t30_repeated_columns",
    lambda x: _show(D.drop_repeated_columns(_cells(x))),
    [
        ("one twice", "1,1,percent,5,1 1,2,percent,5,1 1,3,percent,6,1 2,1,percent,7,1 2,2,percent,7,1 2,3,percent,8,1", "1,1,5 1,2,6 2,1,7 2,2,8"),
        ("half alike", "1,1,percent,5,1 1,2,percent,5,1 2,1,percent,7,1 2,2,percent,8,1", "1,1,5 1,2,5 2,1,7 2,2,8"),
    ],
)
scalar(
    "t31_mirrored_columns",
    lambda x: _show(D.merge_mirrors(_cells(x))),
    [("gaps filled", "1,1,percent,5,1 1,3,percent,6,1 2,2,percent,7,1 2,4,percent,8,1", "1,1,5 1,2,6 2,1,7 2,2,8"), ("no gaps", "1,1,percent,5,1 1,2,percent,6,1 2,1,percent,7,1 2,2,percent,8,1", "1,1,5 1,2,6 2,1,7 2,2,8")],
)


def _interpreted(markup: str) -> str:
    got = tables.interpret(markup)
    return got["reason"] or " ".join(f"{c['row']},{c['column']},{c['statistic']},{c['stat1']:g},{'' if c['stat2'] is None else format(c['stat2'], 'g')},{c['sample_size']:g}" for c in got["rows"])


scalar(
    "t34_t22_whole_tables",
    _interpreted,
    [
        (
            "brackets in their own columns",
            "<table-wrap>" + _table("|Experimental (n = 24)||Control (n = 22)|", "Age (years), mean (SD)|41.75|(12.66)|43.05|(11.9)", "BMI, mean (SD)|24.1|(3.2)|25.0|(2.9)", "Weight, mean (SD)|70.2|(8.1)|71.9|(9.2)") + "</table-wrap>",
            "1,1,continuous,41.75,12.66,24 1,2,continuous,43.05,11.9,22 2,1,continuous,24.1,3.2,24 2,2,continuous,25,2.9,22 3,1,continuous,70.2,8.1,24 3,2,continuous,71.9,9.2,22",
        ),
        (
            "sections and p values",
            "<table-wrap>" + _table("Variable|Drug (n = 40)|Placebo (n = 42)|P", "Age, mean ± SD|41.5 ± 10.2|42.7 ± 11.9|0.62", "Sex, n (%)|||", "Female|22 (55%)|24 (57%)|0.85", "Male|18 (45%)|18 (43%)|") + "</table-wrap>",
            "1,1,continuous,41.5,10.2,40 1,2,continuous,42.7,11.9,42 2,1,percent,22,55,40 2,2,percent,24,57,42 3,1,percent,18,45,40 3,2,percent,18,43,42",
        ),
        ("sizes again", "<table-wrap>" + _table("|A (n=10)|B (n=12)", "Age, mean (SD)|5 (1)|6 (2)", "Second part|n=9|n=11", "BMI, mean (SD)|20 (1)|21 (2)") + "</table-wrap>", "1,1,continuous,5,1,10 1,2,continuous,6,2,12 2,1,continuous,20,1,10 2,2,continuous,21,2,12"),
        ("no sizes", "<table-wrap>" + _table("|A|B", "Age, mean ± SD|5 ± 1|6 ± 2", "BMI, mean ± SD|20 ± 1|21 ± 2") + "</table-wrap>", "No sample size"),
        ("one size", "<table-wrap>" + _table("|A (n=10)|B", "Age, mean ± SD|5 ± 1|6 ± 2", "BMI, mean ± SD|20 ± 1|21 ± 2") + "</table-wrap>", "Just one sample size"),
        ("one group", "<table-wrap>" + _table("|A (n=10)|Total", "Age|5 ± 1|6 ± 2", "BMI|20 ± 1|21 ± 2") + "</table-wrap>", "Just one column in table"),
    ],
)


_WRAP = """<table-wrap id="T{n}"><label>Table {n}</label><caption><p>{caption}</p></caption><table><thead><tr><th>Variable</th><th>Drug (n = 40)</th><th>Placebo (n = 42)</th><th>P value</th></tr></thead>
<tbody><tr><td>Age, mean (SD)</td><td>41.5 (10.2)</td><td>42.7 (11.9)</td><td>0.62</td></tr><tr><td>Female, n (%)</td><td>22 (55.0)</td><td>24 (57.1)</td><td>0.85</td></tr><tr><td>Weight, median (IQR)</td><td>71 (60–82)</td><td>70 (61–80)</td><td>0.77</td></tr></tbody></table><table-wrap-foot><p>{foot}</p></table-wrap-foot></table-wrap>"""
_WORDS = "<table-wrap><caption><p>Baseline characteristics in words</p></caption><table><tr><td>A table of words without any number at all</td></tr></table></table-wrap>"


def _wrap(caption: str, n: int = 1, foot: str = "") -> str:
    return _WRAP.format(n=n, caption=caption, foot=foot)


def _paper(tables_: str, title: str = "A randomised controlled trial of a drug", abstract: str = "We did a trial.", methods: str = "", results: str = "", date: str = "<year>2019</year><month>4</month>", aff: str = "Clinic, London, England") -> str:
    return f"""<?xml version="1.0"?><article><front><journal-meta><journal-title>Journal</journal-title></journal-meta><article-meta><title-group><article-title>{title}</article-title></title-group><pub-date>{date}</pub-date><aff>{aff}</aff><abstract><p>{abstract}</p></abstract></article-meta></front>
<body><sec><title>Methods</title><p>{methods}</p><boxed-text><p>A box with p = 0.01 in Table 1.</p></boxed-text></sec><sec><title>Results</title><p>{results}</p>{tables_}</sec></body></article>"""


BASE = "Baseline characteristics of participants"
PAPERS = {
    "P01 usable": _paper(_wrap(BASE, foot="Values are mean ± standard error"), results="Groups were alike (<xref>Table 1</xref>), with p = 0.6 for age.", methods="Block randomisation was used."),
    "P02 unreadable": "<article><body>",
    "P03 single arm": _paper(_wrap(BASE), title="A single-arm trial"),
    "P04 protocol": _paper(_wrap(BASE), title="Protocol of a randomised trial"),
    "P05 abstract": _paper(_wrap(BASE), abstract="A secondary analysis of a trial."),
    "P06 no table": _paper(_wrap("Outcomes")),
    "P07 negative": _paper(_wrap("Baseline characteristics of those excluded")),
    "P08 words": _paper(_WORDS),
    "P09 follow-up": _paper(_wrap("Baseline and 3 month characteristics")),
    "P10 second": _paper(_WORDS + _wrap(BASE, 2), results="See Table II. P = 0.3."),
    "P11 most words": _paper(_wrap("Baseline scores") + _wrap("Baseline demographic characteristics", 2), results="Nothing in table 3 (p = 0.2)."),
    "P12 before results": _paper(_wrap(BASE), methods="Table 1 has no test.", results="Table 1 shows the groups.", title="A pilot cluster trial", date="<year>2020</year>", aff="University, Seoul, Korea", abstract="adaptive"),
    "P13 adaptive": _paper(_wrap(BASE), methods="We used adaptive randomization, and random blocks of four.", date="<year>2021</year><month>2</month><day>30</day>", aff="Beijing University, P.R. China"),
}


def _papers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PAPERS.items()), "pmcid string, xml string")


def listed(name: str, columns: str, rows: list[tuple], run: Callable[[SparkSession], DataFrame]) -> None:
    """Register a query without input, with its rows."""
    QUERIES[name] = lambda spark, d: run(spark)
    ORACLE[name] = values(columns, rows)


def _parsed(spark: SparkSession) -> DataFrame:
    p = documents.parse_papers(_papers(spark))
    return p.select("pmcid", "readable", "title", "year", "month", "day", "journal", "affiliation", F.size("tables").alias("n_tables"), F.contains(F.col("body"), F.lit("A box")).alias("has_box"))


def _parsed_rows() -> list[tuple]:
    title = {"P03": "A single-arm trial", "P04": "Protocol of a randomised trial", "P12": "A pilot cluster trial"}
    dates = {"P12": (2020, None, None), "P13": (2021, 2, 30)}
    place = {"P12": "University, Seoul, Korea", "P13": "Beijing University, P.R. China"}
    out = []
    for k in PAPERS:
        n = k[:3]
        if n == "P02":
            out.append((k, False, *[None] * 8))
        else:
            out.append((k, True, title.get(n, "A randomised controlled trial of a drug"), *dates.get(n, (2019, 4, None)), "Journal", place.get(n, "Clinic, London, England"), 2 if n in ("P10", "P11") else 1, False))
    return out


listed("x1_x2_parsed_papers", "pmcid, readable, title, year, month, day, journal, affiliation, n_tables, has_box", _parsed_rows(), _parsed)
_REASONS = {"P02": "Full text not available", "P03": "Single-arm study", "P04": "Not an RCT", "P05": "Not an RCT", "P06": "No baseline table", "P07": "No baseline table", "P08": "No baseline table", "P09": "Follow-up results in baseline table"}


def _screened(spark: SparkSession) -> DataFrame:
    parsed = documents.parse_papers(_papers(spark))
    return documents.screen(parsed, documents.choose_tables(documents.candidate_tables(parsed)))


listed("t2_screening", "pmcid, reason", [(k, _REASONS.get(k[:3])) for k in PAPERS], _screened)
listed("t2_screening_of_other_studies", "pmcid, reason", [(k, None if k[:3] in ("P04", "P05") else _REASONS.get(k[:3])) for k in PAPERS], lambda spark: documents.screen(p := documents.parse_papers(_papers(spark)), documents.choose_tables(documents.candidate_tables(p)), exclude_non_trials=False))
_CAPTIONS = [
    ("P01 usable", 1, "baseline characteristics of participants", 2, True),
    ("P06 no table", 1, "outcomes", 0, False),
    ("P07 negative", 1, "baseline characteristics of those excluded", 2, False),
    ("P10 second", 1, "baseline characteristics in words", 2, True),
    ("P10 second", 2, "baseline characteristics of participants", 2, True),
    ("P11 most words", 1, "baseline scores", 1, True),
    ("P11 most words", 2, "baseline demographic characteristics", 3, True),
]
listed(
    "t3_x3_captions",
    "pmcid, table_no, caption, words, candidate",
    _CAPTIONS,
    lambda spark: documents.candidate_tables(documents.parse_papers(_papers(spark).filter(F.col("pmcid").isin([c[0] for c in _CAPTIONS])))).select("pmcid", "table_no", "caption", F.col("words").cast("int").alias("words"), "candidate"),
)
listed(
    "t4_t5_chosen_tables",
    "pmcid, table_no, named_no, caption",
    [(k, 2 if k.startswith("P10") else 1, 2 if k[:3] in ("P10", "P11") else 1, {"P09": "baseline and 3 month characteristics", "P11": "baseline scores"}.get(k[:3], "baseline characteristics of participants")) for k in PAPERS if k[:3] not in ("P02", "P06", "P07", "P08")],
    lambda spark: documents.choose_tables(documents.candidate_tables(documents.parse_papers(_papers(spark)))).select("pmcid", "table_no", "named_no", "caption"),
)


def _in_text(spark: SparkSession) -> DataFrame:
    parsed = documents.parse_papers(_papers(spark))
    return documents.p_value_in_text(parsed, documents.choose_tables(documents.candidate_tables(parsed)))


listed("t32_f17_p_values_in_text", "pmcid, in_text", [(k, {"P01": True, "P10": True, "P12": False}.get(k[:3])) for k in PAPERS if k[:3] not in ("P02", "P06", "P07", "P08")], _in_text)


def _design(spark: SparkSession) -> DataFrame:
    parsed = documents.parse_papers(_papers(spark).filter(F.col("pmcid").isin("P01 usable", "P12 before results", "P13 adaptive")))
    return documents.design(parsed, documents.choose_tables(documents.candidate_tables(parsed))).withColumn("date", F.col("date").cast("string"))


listed(
    "t33_x4_f20_design",
    "pmcid, date, journal, affiliation, rct, cluster, pilot, block_randomisation, adaptive_randomisation, sem",
    [("P01 usable", "2019-04-15", "Journal", "UK", True, False, False, True, False, True), ("P12 before results", "2020-06-15", "Journal", "South Korea", False, True, True, False, False, False), ("P13 adaptive", None, "Journal", "China", True, False, False, True, True, False)],
    _design,
)
_KEPT = ["P01 usable", "P10 second", "P11 most words", "P12 before results", "P13 adaptive"]
_DATA = [(1, 1, "continuous", 41.5, 10.2, None, 1, 1, 40), (1, 2, "continuous", 42.7, 11.9, None, 1, 1, 42), (2, 1, "percent", 22, 55, None, 0, 1, 40), (2, 2, "percent", 24, 57.1, None, 0, 1, 42), (3, 1, "median", 71, 60, 82, 0, 0, 40), (3, 2, "median", 70, 61, 80, 0, 0, 42)]
listed(
    "t_extract_table_data",
    'pmcid, "row", "column", statistic, stat1, stat2, stat3, dp1, dp2, sample_size',
    [(k, *(float(x) if i in (0, 3, 4, 5, 8) and x is not None else x for i, x in enumerate(r))) for k in _KEPT for r in _DATA],
    lambda spark: documents.extract(_papers(spark))["table_data"].drop("stat4"),
)
listed("t_extract_excluded", "pmcid, reason", [(k, _REASONS[k[:3]]) for k in PAPERS if k[:3] in _REASONS], lambda spark: documents.extract(_papers(spark))["excluded"])
listed("t26_extract_pvals", 'pmcid, "row", pvalue', [(k, float(r), p) for k in _KEPT for r, p in ((1, 0.62), (2, 0.85), (3, 0.77))], lambda spark: documents.extract(_papers(spark))["pvals"])
