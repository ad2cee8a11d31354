"""What larger tables showed: rows that grow with questions times nodes."""

import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cairn.operators import retrieval as V
from cairn.operators import risk as R


def test_seeds_by_tokens_that_many_or_few_questions_ask_for(spark):
    names = [f"{d}/b{i % 9}/{w}_{x}_{i}.py" for i, (d, w, x) in enumerate((d, w, x) for d in ("api", "data", "x") for w in ("auth", "ring", "land") for x in ("hot", "cold", "in"))]
    nodes = [(n, n.split("/")[-1], n[0] == "x" and "other" or n.split("/")[0], "file" if i % 2 else "function") for i, n in enumerate(names)]
    asked = [("la and", None), ("auth in", None), ("auth in", "api"), ("the la in", None), ("la in", None), ("in auth la 7", "api"), ("ring_hot_3 in", None), ("zz", None), ("the in 12", "DATA"), ("the", None), ("", "api")]
    queries = [(i, t, h) for i, (t, h) in enumerate(asked)]
    every = {}
    for q, text, hint in queries:
        tokens = [t for t in dict.fromkeys(re.split(r"\W+", text)) if len(t) >= 2]
        for n, name, layer, kind in nodes:
            if any(t in n for t in tokens):
                every.setdefault(q, []).append((5 * sum(t in f"{n} {name} {layer}" for t in tokens) + 5 * (layer == (hint or "").lower()) + 0.5 * (kind == "file"), n))
    ns = spark.createDataFrame(nodes, "id string, name string, layer string, type string")
    qs = spark.createDataFrame(queries, "query_id int, text string, layer string")
    q, kinds, touched, _ = R._candidates(qs, ns, None)
    assert q.where("size(common) > 0 and size(rare) > 0").count() and touched.count()
    # nodes of the common tokens come once, not once a question
    assert kinds.count() <= len(nodes) < sum(map(len, every.values())) - touched.count()
    got = {(r.query_id, r.points): r.n for r in R.token_points(qs, ns).collect()}
    assert got == Counter((q, p) for q, found in every.items() for p, _ in found)
    for k in (1, 4, 100):
        best = {(r.query_id, r.id, r.points) for r in R.keyword_seeds(qs, ns, k).collect()}
        assert best == {(q, n, p) for q, found in every.items() for p, n in sorted(found, key=lambda x: (-x[0], x[1]))[:k]}


def test_reviews_of_what_hits_every_file_count_files_and_do_not_list_them(spark):
    files = [f"a/f{i:02}.py" for i in range(5)] + [f"b/test_{i:02}.py" for i in range(14)]
    nodes = spark.createDataFrame([(f, "file") for f in files] + [("m", "module")], "id string, type string")
    pr = spark.createDataFrame([(1, "a/f00.py"), (2, "b/test_00.py"), (3, "b/test_00.py"), (3, "a/f01.py"), (4, "m"), (5, "b/test_03.py"), (5, "a/f02.py")], "pr_id int, file string")
    whole = [(2, "b/test_00.py"), (3, "b/test_00.py"), (3, "a/f01.py"), (4, "m"), (5, "b/test_03.py")]
    near = [(1, "a/f01.py"), (1, "b/test_01.py"), (3, "m"), (5, "b/test_03.py"), (5, "a/f01.py"), (5, "x/spec")]
    listed = sorted({(p, f) for p, s in whole for f in files if f != s} | set(near))
    none = lambda schema: spark.createDataFrame([], schema)
    risks = spark.createDataFrame([(f, 10, "o", 0.1, 0) for f in [*files, "m"]], "file string, risk int, owner string, bus_risk double, incidents int")
    rest = (none("pr_id int, file string"), none("src string, dst string, violation_rule string"), none("pr_id int, person string, confidence double"))
    every = R.pr_review(pr, risks, spark.createDataFrame(listed, "pr_id int, id string"), *rest)
    counted = R.pr_review(pr, risks, spark.createDataFrame(near, "pr_id int, id string"), *rest, spark.createDataFrame(whole, "pr_id int, source string"), nodes.where("type = 'file'").select("id"))
    assert sorted(counted.collect()) == sorted(every.collect())
    assert {r.pr_id: r.affected for r in counted.collect()} == {1: 2, 2: 18, 3: 20, 4: 19, 5: 20}


def test_dense_search_returns_k_of_each_query_from_a_partition_whatever_its_batches(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties, some zero vectors
    ids = rng.permutation(300)
    asked = np.arange(0, 300, 20)
    sent = SimpleNamespace(value={4: (asked, V._unit(vectors[asked]))})
    score = np.round(V._unit(vectors[asked]) @ V._unit(vectors).T, 9)
    monkeypatch.setattr(V, "TILE", 15 * 7)
    for k in (1, 5, 400):
        batches = [pd.DataFrame({"id": ids[i : i + 50], "embedding": list(vectors[i : i + 50])}) for i in range(0, 300, 50)] + [pd.DataFrame({"id": [900, 901], "embedding": [None, [1.0]]})]
        got = pd.concat(V._best(sent, k)(batches))
        want = []
        for q, row in zip(asked, score):
            found = sorted((-s, i) for s, i in zip(row, ids) if s == s)[:k]
            want += [(q, i, -s) for s, i in found]
        assert sorted(map(tuple, got.itertuples(index=False))) == sorted(want)


def test_keyword_search_deals_out_no_row_per_query_and_candidate(spark):
    texts = [(i, " ".join(["alpha"] * (i % 3 + 1) + ["beta"] * (i % 2) + ["gamma"] * (i % 50 == 0))) for i in range(400)]
    chunks = spark.createDataFrame(texts, "id long, content string")
    queries = spark.createDataFrame([(q, t) for q, t in enumerate(["alpha", "beta alpha", "gamma alpha", "gamma beta", "delta alpha", ""] * 3)], "query_id long, text string")
    found = V.sparse_search(queries, chunks, 5)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    mean = sum(len(t.split()) for _, t in texts) / len(texts)
    for q in range(18):
        terms = ["alpha", "beta alpha", "gamma alpha", "gamma beta", "delta alpha", ""][q % 6].split()
        n = {t: sum(t in x.split() for _, x in texts) for t in terms}
        rows = []
        for i, x in texts:
            w = x.split()
            if terms and all(t in w for t in terms):
                rows.append((-round(sum(math.log(1 + (400 - n[t] + 0.5) / (n[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in sorted(terms)), 6), i))
        assert [i for _, i in sorted(got.get(q, []))] == [i for _, i in sorted(rows)[:5]]
    # parts give the best of a query only: k of each, or as many more as score the same but for rounding
    lists = V._rank_in_parts(queries.selectExpr("'' AS tenant_id", "query_id", "split(text, ' ') AS terms").where("text = 'alpha'"), V.postings(chunks).withColumn("tenant_id", F.lit("")), V.postings(chunks).groupBy("term").agg(F.count("*").alias("df")).withColumn("tenant_id", F.lit("")), spark.createDataFrame([("", 400, mean)], "tenant_id string, n_docs long, mean double"), 5, 1.2, 0.75)
    assert lists.count() <= 3 * 8 * 10 < 3 * 400
