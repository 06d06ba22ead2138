import hashlib
import random
import re

import pytest

from twinframe.llm import syncmers


def plain_places(hashes, runs, k, s):
    """Closed syncmers by their definition."""
    found = []
    for i in range(len(hashes) - k + 1):
        inner = runs[i:i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            found.append(i)
    return found


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["x" * 60, "é日"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", " \n", "a b c", "y" * 5000]


def test_anchors_are_closed_syncmers(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = syncmers.anchors(docs, "text", "anchors", "places").orderBy("doc_id").collect()
    split = [re.findall(syncmers.WORD, t or "") for t in texts]
    words = spark.createDataFrame(list(enumerate(split)), "doc_id long, words array<string>").selectExpr("doc_id", "transform(words, w -> xxhash64(w)) h")
    hashes = [r.h for r in words.orderBy("doc_id").collect()]
    pairs = spark.createDataFrame([(a, b) for h in hashes for a, b in zip(h, h[1:])], "a long, b long").distinct().selectExpr("a", "b", "xxhash64(a, b) h").collect()
    pair = {(r.a, r.b): r.h for r in pairs}
    for r, h in zip(rows, hashes):
        want = plain_places(h, [pair[x] for x in zip(h, h[1:])], syncmers.K, syncmers.S) if len(h) >= syncmers.K else [0][:len(h)]
        assert r.places == want and len(r.anchors) == len(want)


def test_order_edit_and_next(spark, texts):
    rng = random.Random(4)
    ids = rng.sample(range(-500, 5000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(7)
    rows = {r.doc_id: r for r in syncmers.edited_pairs(docs).collect()}
    assert len(rows) == len(texts)
    order = sorted(zip(ids, texts), reverse=True)
    prints = {r.doc_id: r.anchors for r in rows.values()}
    for (i, t), (j, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        cut = len(t) // 3
        assert rows[i].edited == t[:len(t) - cut] + n[:cut] and rows[i].n_chars == len(t) and rows[i].next_anchors == prints[j]


def plain_likeness(a, b):
    """By the definition: first places of shared anchors, matched where a gap to a neighbour is the same in both."""
    if not a and not b:
        return 1.0
    first = [{x: i for i, x in reversed(list(enumerate(t)))} for t in (a, b)]
    pairs = sorted((first[0][x], first[1][x]) for x in first[0].keys() & first[1].keys())
    gaps = [q[0] - p[0] == q[1] - p[1] for p, q in zip(pairs, pairs[1:])]
    matched = len(pairs) if len(pairs) < 2 else sum(x or y for x, y in zip([False] + gaps, gaps + [False]))
    return matched / (len(first[0]) + len(first[1]) - len(pairs))


def test_likeness(spark):
    rng = random.Random(8)
    lists = [[rng.randint(0, n) for _ in range(rng.randint(0, m))] for n, m in [(3, 6), (9, 12), (60, 40)] * 40]
    pairs = [(a, list(range(len(a))), b, list(range(len(b)))) for a, b in zip(lists, lists[3:] + lists[:3])]
    pairs += [(a, p, a[:2] + [77] + a[2:], list(range(len(a) + 1))) for a, p, _, _ in pairs]
    pairs += [([], [], [], []), ([1], [0], [], []), ([4, 4, 5], [0, 1, 2], [4, 4, 5], [0, 1, 2]), ([1, 2, 3], [0, 1, 2], [3, 2, 1], [0, 1, 2])]
    df = spark.createDataFrame(pairs, "a array<bigint>, ap array<int>, b array<bigint>, bp array<int>")
    rows = df.withColumn("x", syncmers.likeness(*map(syncmers.F.col, ("a", "ap", "b", "bp")))).collect()
    assert [r.x for r in rows] == [plain_likeness(r.a, r.b) for r in rows]
    assert [r.x for r in rows[-4:]] == [1.0, 0.0, 1.0, 0.0]
    assert spark.sql("select array(1L, 2L, 3L) a").select(syncmers.written(syncmers.F.col("a")).alias("w")).first().w == "000000010000000200000003"


def test_an_insertion_is_local(spark):
    """One letter in front of, or inside, a stretch without white space, and one word in a plain text, leave most matches."""
    rng = random.Random(9)
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz日本語文字列") for _ in range(5000))
    words = [f"w{rng.randint(0, 5000)}" for _ in range(1000)]
    pairs = [(run, "q" + run), (run, run[:2500] + "q" + run[2500:]), (" ".join(words), " ".join(["new", *words])),
             (" ".join(words), " ".join(words[:500] + ["new"] + words[500:])), (" ".join(words), " ".join(words[500:] + words[:500])), (run, " ".join(words))]
    df = syncmers.anchors(spark.createDataFrame(pairs, "a string, b string"), "a", "x", "xp")
    made = syncmers.anchors(df, "b", "y", "yp").select("b", syncmers.likeness(*map(syncmers.F.col, ("x", "xp", "y", "yp"))).alias("near"))
    found = {r.b: r.near for r in made.collect()}
    near = [found[b] for _, b in pairs]
    assert min(near[:4]) > 0.97 and 0.9 < near[4] and near[5] == 0.0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", 4, "r", 5.0)], "doc_id long, text string, _words int, _runs string, _at double")
    found = syncmers.anchors(docs, "text", "anchors")
    assert found.columns == [*docs.columns, "anchors"] and found.first()["_runs"] == "r"


def test_odd_rows(spark, odd_documents):
    found = syncmers.edited_pairs(odd_documents)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
    rows = found.collect()
    assert len(rows) == 9 and sum(r.doc_id == 5 for r in rows) == 2 and len({tuple(r.anchors) for r in rows if r.doc_id == 5}) == 1
    assert all(r.next_anchors is not None and r.edited is not None for r in rows)
    assert syncmers.edited_pairs(odd_documents.limit(0)).count() == 0
    one = syncmers.edited_pairs(odd_documents.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].next_anchors == one[0].anchors


def test_query(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in syncmers.op5(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        t, n = t or "", texts[i - 1 if i else len(texts) - 1] or ""
        cut = len(t) // 3
        assert rows[i].edited_sha256 == hashlib.sha256((t[:len(t) - cut] + n[:cut]).encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    near = [rows[i].near_edited - rows[i].near_next for i, t in enumerate(texts) if len((t or "").split()) > 30]
    assert sum(near) / len(near) > 0.3
