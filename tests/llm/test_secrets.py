import hashlib
import random
import re

from twinframe.llm import secrets
from twinframe.llm.secrets import RULES, trigram_query


def plain(text):
    found = []
    for rank, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), rank, rule.kind, m.end()))
    return sorted(found)


def test_queries():
    assert trigram_query("hello") == [frozenset({"hel", "ell", "llo"})]
    assert trigram_query("[0-9a-f]+") == [frozenset()] and trigram_query("ab|hello") == [frozenset()]
    assert set(trigram_query("(abc|def)x")) == {frozenset({"abc", "bcx"}), frozenset({"def", "efx"})}
    assert trigram_query("(?i:ABC)[0-9]*DEF") == [frozenset({"abc", "def"})]
    assert trigram_query("(abcd)+x*") == [frozenset({"abc", "bcd"})] and trigram_query("(abcd)*") == [frozenset()]
    kinds = {r.kind: trigram_query(r.pattern) for r in RULES}
    assert {frozenset({"tok", "oke", "ken"}), frozenset({"api", "pik", "ike", "key"})} <= set(kinds["assign"]) and len(kinds["assign"]) == 6
    assert kinds["access"] == [frozenset({"aki", "kia"})] and kinds["hex"] == [frozenset()]


PARTS = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "api", "=", ":", " ", " ", '"', "'", "abc", "hunter22", "AKIA", "ABCDEFGH12345678",
         "0123456789abcdef", "deadbeef", "x", "é", "日", "\n", "ghp_", "A" * 40, "-----BEGIN RSA PRIVATE KEY-----", "eyJh", ".", "𝒳", "𝒳y"]


def test_equal_to_plain_scan(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["secret=token: abcdefgh", None, "", "f" * 100_000, "token=" * 5000]
    texts += [f"{w} = \"{v}\"" for w in ("password", "api_key", "x") for v in ("12345", "123456")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = secrets.find_secrets(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [tuple(s) for s in r.secrets] == plain(r.text), r.text[:200]
    assert sum(len(r.secrets) for r in rows) > 500


def test_base_rules_as_stated(spark):
    """The least lengths inside the patterns find what the open patterns with a length test find."""
    rng = random.Random(6)
    parts = ["AKIA", "AKI", "A", "Z9", "QWERTY1234567", "0123456789", "deadbeefcafe", "f", "g", "_", " ", "-", "AKIA" + "B" * 16, "AKIA" + "B" * 15, "a" * 24, "a" * 23]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        want = sorted((m.start(), kind, m.end()) for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))
                      for m in re.finditer(pattern, r.text) if len(m[0]) >= least)
        assert sorted((s.start, s.kind, s.end) for s in r.secrets if s.kind in ("access", "hex")) == want


def test_long_runs_are_linear(spark):
    run = "eyJhbGci" * 150_000
    docs = spark.createDataFrame([(1, run, "x", 3), (2, f"a {run}.{run}.abc b", None, 4)], "doc_id long, text string, _hash string, _kinds int")
    rows = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert rows[1].secrets == [] and rows[1]["_hash"] == "x" and rows[2]["_kinds"] == 4
    assert [(s.kind, s.start, s.end) for s in rows[2].secrets] == [("signed", 2, 2 * len(run) + 7)]


def test_index_prunes(spark):
    docs = spark.createDataFrame([(0, "my password: hunter22", 0), (1, "pass the word", 1), (2, "AKIA" + "A" * 20, 2), (3, None, 3), (4, "AKIA" + "A" * 20, 2)], "doc_id long, text string, hash long")
    queries = {r.kind: trigram_query(r.pattern) for r in RULES if all(trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for s in q for g in s})
    rows = secrets.candidates(secrets.postings(docs, "text", grams, 3), grams, queries).collect()
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(text) h").collect()}
    assert {r.hash: set(r.kinds) for r in rows} == {hashes[0]: {"assign"}, hashes[2]: {"access"}}


def test_plan_has_no_python(spark, odd_documents):
    found = secrets.find_secrets(odd_documents, name="n_tokens")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    rows = found.collect()
    assert len(rows) == 9 and all(r.n_tokens == [] for r in rows) and found.columns == odd_documents.columns
    assert secrets.find_secrets(odd_documents.limit(0)).count() == 0


def test_digests(spark, tmp_path):
    spark.createDataFrame([(1, "é token: abcdef0 ghp_" + "a" * 40), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = secrets.op1(spark, str(tmp_path)).orderBy("doc_id").collect()
    # forty letters a are a hexadecimal run too
    base = "assign:2:16,hex:21:61"
    assert rows[0].n_assign == 1 and rows[0].n_hex == 1 and rows[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert rows[0].spans == "assign:2:16,hosted:17:61,hex:21:61" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[1].spans == ""
