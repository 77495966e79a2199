"""Quality rules as a short-circuit cascade.

Each rule is a Spark expression that is true for a text to reject. On a sample
every rule is timed, and the sample's verdicts give its selectivity among what
the rules before it leave; rules then run in order of rejection per cost, as
branches of one CASE, of which Spark evaluates none after the first that holds.
The order only decides how soon a text is rejected: kept documents are those
for which no rule holds, in any order.

Defined results:
* a null text, and one without a letter, is rejected (rule ``no_letters``);
* ratios compare whole numbers, and a ratio at its limit passes;
* rules on ratios need the least number of words, letters or lines stated, so
  short texts pass them;
* every row is judged by its own text alone: repeated rows and null ids are
  kept or dropped alike; very long texts count whole.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.llm.common import col, shared_dir

WORD, SYMBOL = r"[^ \t\n\r]+", r"[#%&*$|!{}<>~^=_]"


@dataclass(frozen=True)
class Rule:
    """A reason to reject; ``spark`` and ``sql`` say the same of a text column."""

    name: str
    spark: object  # Column -> Column
    sql: str  # DuckDB's, of {t}


def _count(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern)).cast("bigint")


def _words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(WORD), F.lit(0))


def _let(value: Column, test) -> Column:
    """test(value) with the value computed once, however often the test names it; branches of a CASE share nothing by themselves."""
    return F.element_at(F.transform(F.array(value), test), 1)


def _stutter(w: Column) -> Column:
    same = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(0))), lambda a, b: a == b)
    return (F.size(w) >= 20) & (F.size(F.filter(same, lambda x: x)) * 5 > F.size(w))


def _repeated(x: Column) -> Column:
    return (F.size(x) >= 5) & (F.size(F.array_distinct(x)) * 10 < F.size(x) * 3)


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all({{t}}, '{pattern}'))"


_W, _L = f"regexp_extract_all({{t}}, '{WORD}')", "string_split({t}, chr(10))"
RULES = [
    Rule("no_letters", lambda t: t.isNull() | ~t.rlike(r"\p{L}"), r"({t} IS NULL OR NOT regexp_matches({t}, '\p{{L}}'))".replace("{{", "{").replace("}}", "}")),
    Rule("symbols", lambda t: _count(t, SYMBOL) * 10 > _count(t, WORD) * 3, f"{_n(SYMBOL)} * 10 > {_n(WORD)} * 3"),
    Rule("capitals", lambda t: _let(F.length(F.regexp_replace(t, "[^A-Za-z]+", "")), lambda n: (n >= 20) & (_count(t, "[A-Z]") * 2 > n)), f"({_n('[A-Za-z]')} >= 20 AND {_n('[A-Z]')} * 2 > {_n('[A-Za-z]')})"),
    Rule("few_distinct_words", lambda t: _let(_words(t), lambda w: (F.size(w) >= 20) & (F.size(F.array_distinct(w)) * 5 < F.size(w))), f"(len({_W}) >= 20 AND len(list_distinct({_W})) * 5 < len({_W}))"),
    Rule("stutter", lambda t: _let(_words(t), _stutter), f"(len({_W}) >= 20 AND len(list_filter(list_zip({_W}[:-2], {_W}[2:]), lambda p: p[1] = p[2])) * 5 > len({_W}))"),
    Rule("repeated_lines", lambda t: _let(F.split(t, "\n"), _repeated), f"(len({_L}) >= 5 AND len(list_distinct({_L})) * 10 < len({_L}) * 3)"),
    Rule("word_length", lambda t: _let(_count(t, WORD), lambda n: (n >= 5) & ((F.length(t) < n * 2) | (F.length(t) > n * 25))), f"({_n(WORD)} >= 5 AND (length({{t}}) < {_n(WORD)} * 2 OR length({{t}}) > {_n(WORD)} * 25))"),
]
#: At most so many rows are sampled to order the rules, of this share of the rows looked at, and so much of each.
SAMPLE_ROWS, SAMPLE_SHARE, SAMPLE_CHARS, SEED = 1000, 0.05, 100_000, 7


def holds(rule: Rule, t: Column) -> Column:
    return F.coalesce(rule.spark(t), F.lit(True))


def order(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """The rules with (seconds a row, share of what reaches them that they reject), best first.

    The sample's bounds, SAMPLE_ROWS rows of SAMPLE_CHARS characters, keep its cost
    the same at any size; the driver takes it and reads no more partitions than fill it.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    t = F.col("text")
    picked = docs.select(F.left(col(text_col).cast("string"), F.lit(SAMPLE_CHARS)).alias("text"))
    spark.createDataFrame(picked.sample(fraction=SAMPLE_SHARE, seed=SEED).take(SAMPLE_ROWS), "text string").coalesce(1).write.parquet(path)
    sample = spark.read.schema("text string").parquet(path)
    verdicts = sample.select(*[holds(r, t).alias(f"r{i}") for i, r in enumerate(rules)]).groupBy(*[f"r{i}" for i in range(len(rules))]).count().collect()
    total = sum(v["count"] for v in verdicts)

    def seconds(*exprs: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.count("text"), *[F.sum(e.cast("int")) for e in exprs]).collect()
        return time.perf_counter() - began

    base = min(seconds(), seconds())
    cost = [max(min(seconds(holds(r, t)), seconds(holds(r, t))) - base, 1e-5) / max(total, 1) for r in rules]
    left, out = set(range(len(rules))), []
    while left:
        rows = sum(v["count"] for v in verdicts)
        share = {i: sum(v["count"] for v in verdicts if v[f"r{i}"]) / rows if rows else 0.0 for i in left}
        best = max(left, key=lambda i: (share[i] / cost[i], -cost[i], -i))
        out.append((rules[best], cost[best], share[best]))
        verdicts = [v for v in verdicts if not v[f"r{best}"]]
        left.remove(best)
    return out


def cascade(t: Column, rules: list[Rule]) -> Column:
    """True for a text to keep; rules run in the given order and stop at the first that holds."""
    out = F.lit(True)
    for r in reversed(rules):
        out = F.when(holds(r, t), F.lit(False)).otherwise(out)
    return out


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that no rule rejects."""
    return docs.filter(cascade(col(text_col).cast("string"), [r for r, _, _ in order(docs, rules, text_col)]))


def keep_sql(t: str = "text", rules: list[Rule] = RULES) -> str:
    """The same condition for DuckDB."""
    return " AND ".join(f"NOT coalesce({r.sql.replace('{t}', t)}, true)" for r in rules)
