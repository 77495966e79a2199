import hashlib
import re

from tabsift.llm import secretscan as S

KEY = "AKIA" + "ABCDEFGH12345678"
TOKEN = 'token = "0123456789abcdef0123456789abcdef01234567"'
SAMPLES = {
    "assigned_secret": TOKEN,
    "aws_access_key": KEY,
    "github_token": "ghp_" + "a1B2" * 9,
    "slack_token": "xoxb-" + "1234567890-abc",
    "google_api_key": "AIza" + "x" * 35,
    "stripe_key": "sk_live_" + "Z" * 24,
    "jwt": "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12,
    "private_key": "-----BEGIN RSA PRIVATE KEY-----",
}
SCHEMA = "doc_id long, text string, source string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_each_rule(spark):
    rows = [(i, f"before {x} after", "s") for i, x in enumerate(SAMPLES.values())] + [(99, "no secrets; token = short, AKIA too", "s")]
    got = {(r.doc_id, r.rule) for r in S.scan_documents(table(spark, rows))[0].collect()}
    assert got == {(i, k) for i, k in enumerate(SAMPLES)}


def test_long_tokens_and_quoted_names(spark):
    part = lambda n: "Zx09_-" * (n // 6)
    rows = [(1, "eyJ" + part(996) + "." + part(6000) + "." + part(1200), "s"), (2, '{"api_key": "0123456789abcdef0123", "n": 1}', "s"), (3, "'secret' = '0123456789abcdef0123'", "s")]
    got = {(r.doc_id, r.rule, r.secret) for r in S.scan_documents(table(spark, rows))[0].collect()}
    assert S.RULES[0].version > 3
    found = {1: rows[0][1], 2: 'api_key": "0123456789abcdef0123', 3: "secret' = '0123456789abcdef0123"}
    assert got == {(k, "jwt" if k == 1 else "assigned_secret", hashlib.sha256(v.encode()).hexdigest()) for k, v in found.items()}


def test_secrets_count_whole(spark):
    """Secrets that differ after any number of characters differ, and so do keys with different bodies."""
    long = "Ab9_" * 1300
    key = lambda body: f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{body}\n-----END RSA PRIVATE KEY-----"
    texts = [f"secret = {long}x", f"secret = {long}y", "sk_live_" + "a" * 5000, "xoxb-" + "1" * 5000, key("MIIE" * 16 + "\nAA=="), key("MIIE" * 16 + "\nBB=="), "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\\nMIIE\\n"]
    got = S.scan_documents(table(spark, [(i, x, "s") for i, x in enumerate(texts)]))[0].collect()
    assert [r.doc_id for r in sorted(got)] == list(range(8)) and len({r.secret for r in got}) == 8
    want = {0: texts[0], 2: texts[2], 3: texts[3], 4: texts[4].split("\n-----END")[0] + "\n", 7: texts[7]}
    assert all(r.secret == hashlib.sha256(want[r.doc_id].encode()).hexdigest() for r in got if r.doc_id in want)


def test_against_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    want = {}
    for r in docs.collect():
        for rule in S.RULES:
            for m in re.findall(rule.pattern, r.text):
                want[r.doc_id, rule.name] = want.get((r.doc_id, rule.name), 0) + 1
    got = {}
    for r in S.scan_documents(docs)[0].collect():
        got[r.doc_id, r.rule] = got.get((r.doc_id, r.rule), 0) + r.n
    assert got == want and want


def test_only_unseen_pairs_are_scanned(spark):
    first = table(spark, [(1, TOKEN, "a"), (2, TOKEN, "b"), (3, "clean", "a")])
    _, ledger, found = S.scan_documents(first)
    assert ledger.count() == 2 * len(S.RULES) and found.count() == 1
    second = table(spark, [(1, TOKEN, "a"), (4, KEY, "c"), (5, TOKEN, "z")])
    new, rows = S.scan(S.versions(second), ledger)
    assert {r.rule for r in new.collect()} == {"aws_access_key"}
    assert rows.select("blob").distinct().count() == 1
    report, more, found2 = S.scan_documents(second, ledger, found)
    assert {(r.path, r.rule) for r in report.collect()} == {("a/1", "assigned_secret"), ("z/5", "assigned_secret"), ("c/4", "aws_access_key")}
    assert more.count() == len(S.RULES) and [r.rule for r in found2.collect()] == ["aws_access_key"]
    again, none, nothing = S.scan_documents(second, ledger.unionByName(more), found.unionByName(found2))
    assert none.count() == nothing.count() == 0 and sorted(again.collect()) == sorted(report.collect())


def test_the_state_can_be_appended_to_the_tables_it_came_from(spark, tmp_path):
    """The tables of a ledger are read by the run whose rows they then take."""
    paths = [f"{tmp_path}/{k}" for k in ("ledger", "found")]
    batches = [[(1, TOKEN, "a"), (2, "clean", "a")], [(1, TOKEN, "a"), (3, KEY, "b")], [(3, KEY, "b"), (4, TOKEN, "c")]]
    files = []
    for k, batch in enumerate(batches):
        state = [spark.read.parquet(p) for p in paths] if k else [None, None]
        report, *new = S.scan_documents(table(spark, batch), *state)
        files.append({(r.path, r.rule) for r in report.collect()})
        for df, p in zip(new, paths):
            df.write.mode("append").parquet(p)
    assert files == [{("a/1", "assigned_secret")}, {("a/1", "assigned_secret"), ("b/3", "aws_access_key")}, {("b/3", "aws_access_key"), ("c/4", "assigned_secret")}]
    assert spark.read.parquet(paths[0]).count() == 3 * len(S.RULES) and spark.read.parquet(paths[1]).count() == 2


def test_a_rules_new_version_scans_all_blobs_again(spark):
    files = table(spark, [(1, TOKEN, "a"), (2, KEY, "a")])
    old = S.RULES[:2]
    _, ledger, found = S.scan_documents(files, rules=old)
    new = [S.Rule(old[0].name, 2, "AKIA"), old[1]]
    findings, rows = S.scan(S.versions(files), ledger, new)
    assert {(r.rule, r.rule_version) for r in rows.collect()} == {(old[0].name, 2)} and rows.count() == 2
    report, _, _ = S.scan_documents(files, ledger, found, new)
    assert {(r.doc_id, r.rule, r.rule_version) for r in report.collect()} == {(2, old[0].name, 2), (2, "aws_access_key", 1)}


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, TOKEN, None), (3, f"{TOKEN}\n{TOKEN} {KEY}", "a"), (3, f"{TOKEN}\n{TOKEN} {KEY}", "a"), (4, "x " * 200_000 + KEY, "a")]
    df = spark.createDataFrame([(*r, "q") for r in rows], SCHEMA + ", blob string")
    report, ledger, _ = S.scan_documents(df)
    got = sorted((r.path, r.rule, r.n) for r in report.collect())
    assert got == [("/", "assigned_secret", 1), ("a/3", "assigned_secret", 2), ("a/3", "assigned_secret", 2), ("a/3", "aws_access_key", 1), ("a/3", "aws_access_key", 1), ("a/4", "aws_access_key", 1)]
    assert ledger.select("blob").distinct().count() == 4
    empty = S.scan_documents(df.limit(0))
    assert all(x.count() == 0 for x in empty)
