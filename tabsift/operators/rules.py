"""Ordered repair and exclusion rules over the table of summary statistics.

A rule tests a cell, a row (pmcid, row) or a study, and changes or drops what it
hits. Tests over rows and studies are window functions, so that the whole chain
needs one exchange by study, whatever the number of rules; a dropped cell stays,
marked, until the end, which is what the audit is counted from.

Rules are text in the SQL that Spark and DuckDB share, so one definition gives
the plan and the statement that checks it. ``[x]`` quotes a name, ``{row}`` and
``{study}`` stand for the window clauses, EVEN(x) rounds half to even.

A missing value spreads: a sum over a row with a null term is null, and a rule
that needs every cell of a row doesn't fire.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.functions.stats import Z975


def count_if(test: str, over: str = "{row}") -> str:
    return f"count(CASE WHEN [dropped] IS NULL AND ({test}) THEN 1 END) OVER {over}"


def strict(x: str, among: str, over: str = "{row}") -> str:
    """Sum of x over the cells for which ``among`` holds, null if a term is."""
    live = f"[dropped] IS NULL AND ({among})"
    return f"(CASE WHEN {count_if(f'({among}) AND ({x}) IS NOT NULL', over)} = {count_if(among, over)} THEN sum(CASE WHEN {live} THEN {x} END) OVER {over} END)"


def every(test: str, among: str, over: str = "{row}") -> str:
    """All cells for which ``among`` holds pass the test, and there is one."""
    return f"({count_if(f'({among}) AND ({test})', over)} = {count_if(among, over)} AND {count_if(among, over)} > 0)"


def some(test: str, over: str = "{row}") -> str:
    return f"({count_if(test, over)} > 0)"


@dataclass(frozen=True)
class Rule:
    """``set`` maps columns to new values; without it what is hit is dropped for ``reason``, counted by ``unit``."""

    key: str
    test: str
    set: dict[str, str] = field(default_factory=dict)
    reason: str = ""
    unit: str = "row"
    mark: bool = True  # a change is recorded in ``changed``


def kind(*names: str) -> str:
    return "[statistic] IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def to(name: str, **more: str) -> dict[str, str]:
    return {"statistic": f"'{name}'"} | more


_share = "abs([stat2] - 100 * ([stat1] / nullif([sample_size], 0)))"
_swap_diff = "abs([stat1] - 100 * ([stat2] / nullif([sample_size], 0)))"
_inside = "([stat1] >= [stat2] AND [stat1] <= [stat3] AND [stat3] IS NOT NULL)"
_swap = {"stat1": "[stat2]", "stat2": "[stat1]", "dp1": "0"}


def _swapped(among: str) -> str:
    n = count_if(among)
    return f"({strict(_swap_diff, among)} < 1.0 / nullif({n}, 0) AND {strict('CASE WHEN [stat1] = [stat2] THEN 1 WHEN [stat1] <> [stat2] THEN 0 END', among)} < {n} AND {every('[dp2] = 0', among)})"


_C, _P, _M, _CI = kind("continuous"), kind("percent"), kind("median"), kind("ci")
_three = f"{_C} AND [stat4] IS NULL"
_h1a, _h1b = f"{_P} AND [stat2] IS NOT NULL", f"{kind('continuous', 'median', 'ci')} AND [stat2] IS NOT NULL AND [stat3] IS NULL"
_l = kind("min_max", "median", "continuous")

RULES = [
    Rule("pre", f"max(CASE WHEN [dropped] IS NULL THEN [column] END) OVER {{study}} >= 8", reason="Trials with eight or more columns", unit="study"),
    Rule("0", some("[sample_size] <= 2", "{study}"), reason="Trials with sample size under three", unit="study"),
    Rule("a", some("floor([sample_size]) <> [sample_size]", "{study}"), reason="Trials with non-integer sample size", unit="study"),
    Rule("b", some(f"{kind('numbers')} AND [dp2] <> 0"), to("percent")),
    Rule("c", f"{strict('abs(EVEN(100 * ([stat1] / nullif([stat2], 0))) - [stat3])', _C)} < 0.5", to("percent", stat2="[stat3]")),
    Rule("d", every(_inside, _three), to("median")),
    Rule("e", every("[stat3] IS NULL", _M), to("continuous")),
    Rule("f", every("[dp1] = 0 AND [stat2] IS NULL", _C), to("percent", from_f="TRUE")),
    Rule("g", every("[stat2] IS NULL AND [dp1] > 0", _P), {"stat1": "EVEN([stat1] / 100 * [sample_size])", "dp1": "0"}),
    Rule("h1a", _swapped(_h1a), to("percent", **_swap, stat3="NULL")),
    Rule("h1b", _swapped(_h1b), to("percent", **_swap)),
    Rule("h2", f"{strict('CASE WHEN [dp1] > 0 THEN 1 WHEN [dp1] <= 0 THEN 0 END', _P)} > 0", reason="Numbers that are not integers"),
    Rule("k", some(f"{_P} AND {_share} > 1"), reason="Not a percent"),
    Rule("l", every(f"{_share} <= 1.5 AND [dp1] = 0", _l), to("percent")),
    Rule("m1", f"{some(f'{_P} AND [stat1] > [sample_size]')} AND [from_f]", to("continuous", changed="FALSE", was_m="TRUE"), mark=False),
    Rule("m2", f"{some(f'{_P} AND [stat1] > [sample_size]')} AND NOT [from_f]", reason="Guessed percent but n > sample size (rows)"),
    Rule("o", f"{_P} AND [stat1] < 0", reason="Negative percent", unit="cell"),
    Rule("p", f"{_C} AND [stat2] = 0", {"stat2": "([stat1] + 0.0001) * 0.01"}),
    Rule("q1", f"{_CI} AND [stat3] < [stat2]", reason="Upper CI interval less than lower (results)", unit="cell"),
    Rule("q2", some(f"{_CI} AND ([stat3] IS NULL OR [stat1] < [stat2] OR [stat1] > [stat3])"), to("continuous")),
    Rule("q3", _CI, {"stat2": f"sqrt([sample_size]) * ([stat3] - [stat2]) / (2 * CAST({Z975} AS DOUBLE))", "stat3": "NULL"}, mark=False),
    Rule("r", every(_inside, _P), to("median")),
    Rule("z", every("[dp1] = 0 AND [stat1] <= [sample_size] AND [stat1] >= 0 AND [stat2] IS NULL", kind("median", "continuous")), to("percent")),
    Rule("w", some(f"{_C} AND [stat2] < 0"), reason="Rows with negative standard deviation"),
    Rule("b2", f"{kind('numbers')} AND [dp1] > 0", {"stat1": "EVEN([sample_size] * [stat1] / 100)", "dp1": "0"}),
    Rule("i", f"{kind('continuous', 'median', 'min_max')} AND [stat2] IS NULL", reason="No second statistic for continuous/median (results)", unit="cell"),
    Rule("last", f"{count_if('TRUE')} = 1", reason="Only one result per row"),
]
COLUMNS = ["pmcid", "row", "column", "statistic", "stat1", "stat2", "stat3", "stat4", "dp1", "dp2", "sample_size", "changed"]
_STATE = ["from_f", "was_m", "dropped", "dropped_unit"]
_KINDS = {"row": "double", "column": "int", "dp1": "int", "dp2": "int"} | {f"stat{i}": "double" for i in (1, 2, 3, 4)} | {"sample_size": "double"}


def _dialect(sql: str, duck: bool) -> str:
    quote = r'"\1"' if duck else r"`\1`"
    sql = sql.replace("{row}", "(PARTITION BY [pmcid], [row])").replace("{study}", "(PARTITION BY [pmcid])")
    return re.sub(r"\[(\w+)\]", quote, sql).replace("EVEN(", "ROUND_EVEN_(" if duck else "bround(")


def _changes(rule: Rule) -> dict[str, str]:
    hit = "coalesce([hit], FALSE) AND [dropped] IS NULL"
    if not rule.set:
        return {"dropped_unit": f"CASE WHEN {hit} THEN '{rule.unit}' ELSE [dropped_unit] END", "dropped": f"CASE WHEN {hit} THEN '{rule.reason}' ELSE [dropped] END"}
    new = dict(rule.set)
    if rule.mark:
        new["changed"] = "TRUE"
    return {c: f"CASE WHEN {hit} THEN {x if x != 'NULL' else 'CAST(NULL AS DOUBLE)'} ELSE [{c}] END" for c, x in new.items()}


def mark(table: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The table with every rule applied; cells that a rule dropped have its reason in ``dropped``.

    ``from_f`` and ``was_m`` remember rows that rule f turned into percents, and
    those of them that rule m turned back.
    """
    base = table.select("*").drop("changed", *_STATE)
    df = base.repartition("pmcid").withColumns({c: F.col(c).cast(t) for c, t in _KINDS.items()})
    df = df.withColumns({"changed": F.lit(False), "from_f": F.lit(False), "was_m": F.lit(False), "dropped": F.lit(None).cast("string"), "dropped_unit": F.lit(None).cast("string")})
    for rule in rules:
        df = df.withColumn("hit", F.expr(_dialect(rule.test, False)))
        df = df.withColumns({c: F.expr(_dialect(x, False)) for c, x in _changes(rule).items()})
    return df.drop("hit")


def clean(table: DataFrame, rules: list[Rule] = RULES, renumber: bool = True) -> DataFrame:
    """What the rules leave, with groups numbered from 1 in each study; ``renumber`` is off for tables of known layout."""
    kept = mark(table, rules).filter("dropped IS NULL").drop(*_STATE)
    if renumber:
        kept = kept.withColumn("column", F.expr("dense_rank() OVER (PARTITION BY pmcid ORDER BY `column`)"))
    return kept


def audit(marked: DataFrame) -> DataFrame:
    """(reason, unit, count) of what mark() dropped: studies, rows or cells. Rows that rule m turned back count with those that it dropped."""
    lost = marked.filter("dropped IS NOT NULL").groupBy(F.col("dropped").alias("reason"), F.col("dropped_unit").alias("unit")).agg(F.countDistinct("pmcid").alias("s"), F.countDistinct("pmcid", "row").alias("r"), F.count(F.lit(1)).alias("c"))
    return lost.select("reason", "unit", F.when(F.col("unit") == "study", F.col("s")).when(F.col("unit") == "row", F.col("r")).otherwise(F.col("c")).alias("count"))


def counted(table: DataFrame) -> DataFrame:
    """(check_name, n): rule n, percentages out of range, which are counted and stay; and printed p-values that are kept, as they are from 0 to 1."""
    outside = (F.col("statistic") == "percent") & ((F.col("stat1") < 0) | (F.col("stat1") > 100))
    kept = (F.col("statistic") == "pvals") & F.col("stat1").between(0, 1)
    n = table.agg(F.count_if(outside).alias("a"), F.count_if(kept).alias("b"))
    return n.select(F.explode(F.create_map(F.lit("percent outside 0 to 100"), F.col("a"), F.lit("p values kept"), F.col("b"))).alias("check_name", "n"))


def clean_sql(source: str, rules: list[Rule] = RULES, dropped: bool = False) -> str:
    """mark(), and unless ``dropped`` clean(), as one statement for DuckDB over a subquery with the table's columns."""
    cast = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER"}
    first = ", ".join(f'CAST("{c}" AS {cast[_KINDS.get(c, "string")]}) AS "{c}"' for c in COLUMNS if c != "changed")
    ctes = [f"s0 AS (SELECT {first}, FALSE AS changed, FALSE AS from_f, FALSE AS was_m, NULL::VARCHAR AS dropped, NULL::VARCHAR AS dropped_unit FROM ({source}))"]
    for k, rule in enumerate(rules):
        changes = _changes(rule)
        out = ", ".join(f"{_dialect(changes[c], True)} AS \"{c}\"" if c in changes else f'"{c}"' for c in COLUMNS + _STATE)
        ctes.append(f"h{k} AS MATERIALIZED (SELECT *, {_dialect(rule.test, True)} AS hit FROM s{k})")
        ctes.append(f"s{k + 1} AS (SELECT {out} FROM h{k})")
    sql = f"WITH {', '.join(ctes)} "
    sql = re.sub(r"ROUND_EVEN_\(", "EVEN0(", sql)
    sql = _even(sql)
    last = f"s{len(rules)}"
    if dropped:
        return f"{sql} SELECT * FROM {last}"
    cols = ", ".join("CAST(dense_rank() OVER (PARTITION BY pmcid ORDER BY \"column\") AS INTEGER) AS \"column\"" if c == "column" else f'"{c}"' for c in COLUMNS)
    return f"{sql} SELECT {cols} FROM {last} WHERE dropped IS NULL"


def _even(sql: str) -> str:
    """EVEN0(x) as round_even(x, 0), by matching brackets."""
    while (at := sql.find("EVEN0(")) >= 0:
        depth, k = 1, at + 6
        while depth:
            depth += (sql[k] == "(") - (sql[k] == ")")
            k += 1
        sql = f"{sql[:at]}round_even({sql[at + 6 : k - 1]}, 0){sql[k:]}"
    return sql
