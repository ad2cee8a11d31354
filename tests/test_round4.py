"""What larger tables showed: joins that Spark took for small, texts that begin with letters outside ASCII."""

import duckdb
from pyspark.sql import functions as F

from cairn.operators import text as T
from cairn.operators.insight import nodes_by_name
from cairn.operators.matching import contained
from cairn.operators.risk import blast_edges
from cairn.plans import ORACLES, QUERIES
from tests.oracle import rows


def joins(df):
    """The physical plan before any stage has run."""
    return df._jdf.queryExecution().sparkPlan().toString()


def sources(spark):
    body = "import os\nclass A:\n    def run(self):\n        self.stop()\n        helper(1)\n    def stop(self):\n        pass\ndef helper(x):\n    return x"
    return spark.createDataFrame([("a/x.py", body), ("a/y.py", "x = 1"), ("a/z.py", "def f(): g")], "path string, content string")


def test_lines_of_texts_are_never_broadcast(spark):
    files = sources(spark)
    symbols = T.extract_symbols(files)
    for df in (symbols, T.structure_edges(symbols), T.call_edges(files, symbols), T.chunk_code(files, symbols), T.chunk_all(files)):
        assert "BroadcastHashJoin" not in joins(df) and "BroadcastNestedLoopJoin" not in joins(df)
    assert {(r.name, r.start_line, r.end_line) for r in symbols.collect()} == {("A", 2, 7), ("run", 3, 5), ("stop", 6, 7), ("helper", 8, 9), ("f", 1, 1)}
    assert {(r.path, r.chunk_type) for r in T.chunk_all(files).collect()} == {("a/x.py", "class"), ("a/x.py", "function"), ("a/y.py", "plain"), ("a/z.py", "function")}


def test_keyword_fallback_of_texts_that_begin_with_other_letters(spark, sf, tmp_path):
    items = spark.createDataFrame([(0, "Ré the, eaure"), (1, "Éç in the"), (2, "ä"), (3, None)], "item_id long, text string")
    for t in ("benchmark", "documents"):
        (items.coalesce(1) if t == "benchmark" else spark.read.parquet(f"{sf}/{t}.parquet").limit(200).coalesce(1)).write.parquet(f"{tmp_path}/{t}.parquet")
    got = rows(QUERIES["R7_keyword_fallback"](spark, str(tmp_path)).toPandas())
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got and got == rows(con.sql(ORACLES["R7_keyword_fallback"]).df())


def test_runs_of_characters_are_not_broadcast_and_find_terms_of_all_lengths(spark):
    names = [f"api/b{i}/Core_part_{i}.py" for i in range(40)] + ["x", "ab", "abc", "aaaaaaaaaa", ""]
    texts = spark.createDataFrame([(n,) for n in names], "text string")
    terms = ["x", "ab", "abc", "part_1", "Core_part_12.py", "aaaaaaaa", "none of them", "", "/b3"]
    found = contained(spark.createDataFrame([(t,) for t in terms], "term string"), texts)
    assert {tuple(r) for r in found.collect()} == {(t, n) for t in terms for n in names if t and t in n}
    nodes = texts.select(F.col("text").alias("id"), F.col("text").alias("name"))
    asked = spark.createDataFrame([(1, "Core_"), (2, "ab")], "query_id long, term string")
    # only terms with their one run are sent anywhere
    assert joins(nodes_by_name(asked, nodes)).count("BroadcastHashJoin") <= 2


def test_edges_of_sources_that_hit_everything_are_not_shuffled_by_request(spark):
    files = spark.createDataFrame([(c,) for c in "abcd"], "id string")
    edges = spark.createDataFrame([("a", "b", "COVERS"), ("b", "c", "MAYBE_CALLS"), ("c", "d", "CALLS"), ("c", "d", "CALLS"), ("d", "z", "CALLS")], "src string, dst string, relation string")
    hit = spark.createDataFrame([(1, "b", 20), (1, "c", 50), (1, "z", 9)], "request_id int, id string, score int")
    whole = spark.createDataFrame([(2, "a"), (3, "d")], "request_id int, source string")
    found = blast_edges(hit, edges, whole, files)
    want = {(1, "b", "c", True, "MAYBE_CALLS", "medium"), (2, "b", "c", True, "MAYBE_CALLS", "high"), (2, "c", "d", False, "CALLS", "high"), (3, "a", "b", False, "Test Coverage", "high"), (3, "b", "c", True, "MAYBE_CALLS", "high")}
    got = [(r.request_id, r.src, r.dst, r.dashed, r.label, r.band) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert joins(found).count("BroadcastNestedLoopJoin") == 1
