"""Secret scans over an incremental blob ledger.

Every version of a path is content-addressed: its blob is the SHA-256 of its
text. The ledger holds which (blob, rule and rule version) pairs were scanned,
and what was found in them. A scan looks at unseen pairs only, once for each
blob whatever number of paths and versions carry it; a report joins the findings
of all blobs back to all paths. Raising a rule's version scans every blob again
by that rule alone. Findings hold the secret's SHA-256, never the secret; a
private key's covers its body. What a run adds to the ledger is a written table,
so that appending it scans nothing again.

Defined results:
* a null text is no version and has no blob; an empty text is one, without findings;
* a null source is an empty folder, a null id an empty name, of the path;
* repeated rows are one path with one blob and are reported once for each row id;
* texts are searched whole; matches of one rule don't overlap, and equal matches
  in a blob are one finding with a count;
* secrets of any length are taken whole: no rule ends a secret at a bound. (Names
  of assigned secrets may go on for 40 characters after the telling word.)
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.llm.common import col, stash


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A pattern that Java and RE2 read alike; texts without any of the ``needles`` need no search."""

    name: str
    version: int
    pattern: str
    needles: tuple[str, ...] = ()


_BODY = r"(?:[\r\n]+Proc-Type: [^\r\n]*[\r\n]+DEK-Info: [^\r\n]*)?[A-Za-z0-9+/=\\\r\n]*"
RULES = [
    Rule("assigned_secret", 4, "(?:" + "|".join(_any_case(w) for w in ("token", "secret", "passw", "api_key", "apikey")) + r")[A-Za-z0-9_]{0,40}[\"']?[ \t]*[=:][ \t]*[\"']?[A-Za-z0-9_+/-]{16,}"),
    Rule("aws_access_key", 1, r"(?:AKIA|ASIA)[0-9A-Z]{16}", ("AKIA", "ASIA")),
    Rule("github_token", 1, r"gh[pousr]_[A-Za-z0-9]{36}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", 2, r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("google_api_key", 1, r"AIza[0-9A-Za-z_-]{35}", ("AIza",)),
    Rule("stripe_key", 2, r"[rs]k_live_[0-9A-Za-z]{24,}", ("k_live_",)),
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ("eyJ",)),
    Rule("private_key", 2, r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----" + _BODY, ("PRIVATE KEY-----",)),
]
LEDGER = "blob string, rule string, rule_version int"
FINDINGS = "blob string, rule string, rule_version int, secret string, n bigint"


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, path, blob, text): every row that has a text, content-addressed."""
    t = col(text_col).cast("string")
    path = F.concat(F.coalesce(col(source_col).cast("string"), F.lit("")), F.lit("/"), F.coalesce(col(id_col).cast("string"), F.lit("")))
    return docs.filter(t.isNotNull()).select(col(id_col).alias("doc_id"), path.alias("path"), F.sha2(t, 256).alias("blob"), t.alias("text"))


def _search(rule: Rule, t: Column) -> Column:
    found = F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(0))
    if rule.needles:
        found = F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(n)) for n in rule.needles]), found)
    return found


def scan(files: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger rows) of the pairs that ``ledger`` doesn't have, for rows of versions(); both are of one written table."""
    have = {r.name for r in rules}
    if len(have) < len(rules):
        raise ValueError("rule names must differ")
    tag = {r: f"{r.name}@{r.version}" for r in rules}
    files = files.select("blob", "text")
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "rule_version")).alias("seen"))
        files = files.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        files = files.filter(reduce(lambda a, b: a | b, [~F.array_contains("seen", tag[r]) for r in rules]))
        blobs = files.groupBy("blob").agg(F.first("text").alias("text"), F.first("seen").alias("seen"))
        unseen = {r: ~F.array_contains("seen", tag[r]) for r in rules}
    else:
        blobs = files.groupBy("blob").agg(F.first("text").alias("text"))
        unseen = {r: F.lit(True) for r in rules}
    hashed = lambda found: F.transform(found, lambda x: F.sha2(x, 256))
    each = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), F.when(unseen[r], hashed(_search(r, F.col("text")))).alias("secrets"), unseen[r].alias("new")) for r in rules]
    scanned = stash(blobs.select("blob", F.array(*each).alias("x"))).select("blob", F.explode("x").alias("x")).select("blob", "x.*").filter("new")
    secrets = scanned.filter(F.size("secrets") > 0).select("blob", "rule", "rule_version", F.explode("secrets").alias("secret"))
    findings = secrets.groupBy("blob", "rule", "rule_version", "secret").agg(F.count("*").alias("n"))
    return findings, scanned.select("blob", "rule", "rule_version")


def report(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, path, blob, rule, rule_version, secret, n): findings at every path and version of their blobs."""
    return files.select("doc_id", "path", "blob").join(findings, "blob").select("doc_id", "path", "blob", "rule", "rule_version", "secret", "n")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, found: DataFrame | None = None, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, new ledger rows, new findings); the latter two are to be appended to ``ledger`` and ``found`` for the next run.

    ``ledger`` and ``found`` are what earlier runs returned, and have the columns of LEDGER and FINDINGS.
    The report is of all findings, old and new, by the given rules and their versions.
    """
    files = versions(docs, id_col, text_col, source_col)
    findings, rows = scan(files, ledger, rules)
    if found is None:
        return report(files, findings), rows, findings
    known = reduce(lambda a, b: a | b, [(F.col("rule") == r.name) & (F.col("rule_version") == r.version) for r in rules])
    return report(files, findings.unionByName(found.filter(known))), rows, findings


def report_sql(rules: list[Rule] = RULES) -> str:
    """What scan_documents reports of a first run, for DuckDB."""
    parts = []
    for r in rules:
        pattern = r.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, source, text, '{r.name}' AS rule, {r.version} AS rule_version, unnest(regexp_extract_all(text, '{pattern}')) AS s FROM documents WHERE text IS NOT NULL")
    union = " UNION ALL ".join(parts)
    return f"SELECT doc_id, coalesce(source, '') || '/' || coalesce(CAST(doc_id AS VARCHAR), '') AS path, sha256(text) AS blob, rule, rule_version, sha256(s) AS secret, count(*) AS n FROM ({union}) GROUP BY ALL"
