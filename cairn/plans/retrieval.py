"""Queries on retrieval. Query texts and vectors come from the driver tables."""

from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.operators import insight as I
from cairn.operators import retrieval as R
from cairn.operators.dense_index import dense_search_indexed
from cairn.operators.keyword_index import KeywordIndex
from cairn.plans.registry import query

K = 10
# questions: forms filled with the first words of benchmark items
FORMS = [
    "where is %s defined", "what breaks if we change %s", "who is %s?", "call chain of %s", "how does the %s layer work",
    "what does this project about %s", "%s", "find user_%s_id and 'auth token'",
]
QUESTIONS = "SELECT item_id AS query_id, replace(CASE item_id % 8 " + " ".join(f"WHEN {i} THEN '{f.replace(chr(39), chr(39) * 2)}'" for i, f in enumerate(FORMS)) + " END, '%s', regexp_replace(split_part(text, ' ', 2), '[^a-zA-Z]', '', 'g')) AS text FROM benchmark"


def questions(fx):
    form = F.coalesce(*[F.when(F.col("item_id") % 8 == i, F.lit(f)) for i, f in enumerate(FORMS)])
    return fx.benchmark.select(F.col("item_id").alias("query_id"), F.replace(form, F.lit("%s"), F.regexp_replace(F.split("text", " ")[1], "[^a-zA-Z]", "")).alias("text"))


PERSON_SQL = "coalesce(" + ", ".join(f"CASE WHEN length(trim(regexp_extract(lower(text), '{p}', 1))) > 2 AND NOT starts_with(trim(regexp_extract(lower(text), '{p}', 1)), 'the ') THEN trim(regexp_extract(lower(text), '{p}', 1)) END" for p in R.PERSON) + ")"
_found = ["list_filter(list_transform(regexp_extract_all(text, '[\"'']([^\"'']+)[\"'']', 1), lambda s: trim(s)), lambda s: length(s) > 2)"]
_found += [f"list_filter(regexp_extract_all(text, '{p}', 1), lambda s: length(s) > 2)" for p in R.SYMBOL]
_found += ["list_filter(regexp_extract_all(text, '\\b([a-zA-Z_][a-zA-Z0-9_]*(?:_[a-zA-Z0-9_]+)+)\\b', 1), lambda s: length(s) > 5)"]
SYMBOLS_SQL = f"list_filter(list_concat({', '.join(_found)}), lambda s: lower(s) NOT IN ('the', 'selected', 'node', 'path', 'to'))"


def _any(words):
    return f"regexp_matches(lower(text), '{'|'.join(words)}')"


ROUTE = f"""CASE WHEN {PERSON_SQL} IS NOT NULL THEN 'person' WHEN {_any(R.IMPACT)} THEN 'impact' WHEN len({SYMBOLS_SQL}) > 0 OR {_any(R.LOOKUP)} THEN 'symbol_lookup'
 WHEN {_any(R.CALL_FLOW)} THEN 'call_flow' WHEN {_any(R.ARCHITECTURE)} THEN 'architecture' WHEN {_any(R.GENERAL)} THEN 'semantic_general' ELSE 'semantic' END"""


def _weight(i, default):
    return "CASE r " + " ".join(f"WHEN '{n}' THEN {w[i]}" + ("" if i == 0 else "::DOUBLE") for n, w in R.WEIGHTS.items()) + f" ELSE {default} END"


def routed_sql(source, k=10):
    return f"""routed AS (SELECT query_id, text, regexp_replace(r, '_general$', '') AS intent, CAST(greatest({k}, {_weight(0, k)}) AS INT) AS k,
 CAST({_weight(1, 0.8)} AS DOUBLE) AS graph_weight, CAST({_weight(2, 1.0)} AS DOUBLE) AS sparse_weight, CAST({_weight(3, 1.0)} AS DOUBLE) AS dense_weight FROM (SELECT *, {ROUTE} AS r FROM {source}))"""


ROUTED = routed_sql(f"({QUESTIONS})")


@query("R1_route_query", f"WITH {ROUTED} SELECT * FROM routed")
def _(fx):
    return R.route_query(questions(fx))


@query("R2_extract_symbols", f"""
SELECT query_id, array_to_string(list_filter(l, lambda s, i: list_position(list_transform(l, lambda z: lower(z)), lower(s)) = i), ',') AS symbols FROM (SELECT query_id, {SYMBOLS_SQL} AS l FROM ({QUESTIONS}))""")
def _(fx):
    return questions(fx).select("query_id", F.array_join(R.extract_symbols(F.col("text")), ",").alias("symbols"))


@query("R3_extract_person", f"SELECT query_id, {PERSON_SQL} AS person FROM ({QUESTIONS})")
def _(fx):
    return questions(fx).select("query_id", R.extract_person(F.col("text")).alias("person"))


SYN = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in R.SYNONYMS.items()) + ") s(key, words)"


@query("R4_expand_tokens", f"""
WITH q AS (SELECT file_key AS query_id, replace(replace(id, '/', ' '), '_', ' ') AS text FROM fx_files WHERE file_key % 5 = 0), t AS (SELECT query_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS tok FROM q),
w AS (SELECT DISTINCT query_id, unnest(words) AS word FROM t JOIN {SYN} ON key = tok)
SELECT query_id, string_agg(word, ',' ORDER BY word) AS words FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = w.query_id AND tok = word) GROUP BY 1""")
def _(fx):
    text = F.replace(F.replace("id", F.lit("/"), F.lit(" ")), F.lit("_"), F.lit(" "))
    out = fx.files.where("file_key % 5 = 0").select(F.col("file_key").alias("query_id"), F.array_join(F.array_sort(R.expand_tokens(text)), ",").alias("words"))
    return out.where("words <> ''")


DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
DENSE = f"""dense AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round({DOT('q.embedding', 'c.embedding')} / (sqrt({DOT('q.embedding', 'q.embedding')}) * sqrt({DOT('c.embedding', 'c.embedding')})), 9) AS score
 FROM embeddings c, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q), ranked_dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM dense QUALIFY rank <= {K})"""


def dense(fx, k=K):
    c = fx.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return R.dense_search(fx.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), c, k)


@query("R5_dense_search", f"WITH {DENSE} SELECT query_id, id, score, rank FROM ranked_dense")
def _(fx):
    return dense(fx)


@query("R5_indexed_search")
def _(fx):
    c = fx.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    q = fx.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense_search_indexed(q, c, K, fx.stages)


# keyword queries: two words from the middle of documents
KEYED = "SELECT doc_id AS query_id, array_to_string(string_split(replace(text, chr(10), ' '), ' ')[20:21], ' ') AS text FROM documents WHERE doc_id % 20 = 0"
SPLIT = "list_filter(string_split_regex(lower(%s), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2)"
CLEAN = "left(trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9_\\s\\-.:/]', ' ', 'g'), '\\s+', ' ', 'g')), 500)"
SPARSE = f"""kq AS ({KEYED}), w AS (SELECT query_id, list_distinct({SPLIT % CLEAN}) AS terms FROM kq),
wt AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM w), tf AS (SELECT term, id, count(*) AS tf FROM (SELECT doc_id AS id, unnest({SPLIT % 'text'}) AS term FROM documents) GROUP BY 1, 2),
ln AS (SELECT id, sum(tf) AS length FROM tf GROUP BY 1), whole AS (SELECT count(*) AS n_docs, avg(length) AS mean FROM ln), dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
full_ AS (SELECT query_id, id, max(n_terms) AS n_terms, count(*) AS n, sum(ln(1 + (n_docs - df + 5e-1) / (df + 5e-1)) * tf * 2.2e0 / (tf + 1.2e0 * (25e-2 + 75e-2 * length / mean))) AS s FROM wt JOIN tf USING (term) JOIN dfr USING (term) JOIN ln USING (id), whole GROUP BY 1, 2),
ranked_sparse AS (SELECT query_id, id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS INT) AS rank FROM full_ WHERE n = n_terms QUALIFY rank <= {K})"""


def keyed(fx):
    return fx.documents.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), 20, 2), " ").alias("text"))


def chunks(fx):
    return fx.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@query("R6_sparse_search", f"WITH {SPARSE} SELECT * FROM ranked_sparse")
def _(fx):
    return R.sparse_search(keyed(fx), chunks(fx), K, stages=fx.stages)


@query("R6_standing_index", f"WITH {SPARSE} SELECT * FROM ranked_sparse")
def _(fx):
    """The same answers from stored postings: a batch with stale texts and rows that go, then the changes."""
    index = KeywordIndex(fx.spark, fx.stages.path("keyword-index"))
    c = chunks(fx).withColumn("tenant_id", F.lit("t"))
    stale = F.when(F.col("id") % 7 == 0, F.concat("content", F.lit(" stale words"))).otherwise(F.col("content"))
    dead = c.where("id % 5 = 0").select("tenant_id", (-1 - F.col("id")).alias("id"), "content")
    index.update(1, c.where("id % 9 <> 0").withColumn("content", stale).unionByName(dead))
    index.update(2, c, dead)
    return index.search(keyed(fx).withColumn("tenant_id", F.lit("t")), K)


@query("R7_keyword_fallback", f"""
WITH q AS (SELECT query_id, ({SPLIT % CLEAN})[1] AS token FROM (SELECT item_id AS query_id, text FROM benchmark))
SELECT query_id, doc_id AS id, 5e-1 AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(text), doc_id) AS INT) AS rank FROM q JOIN documents ON contains(lower(text), token) QUALIFY rank <= 10""")
def _(fx):
    q = fx.benchmark.select(F.col("item_id").alias("query_id"), "text")
    none = fx.spark.createDataFrame([], "query_id long")
    return R.keyword_fallback(q, chunks(fx), none, K, fx.stages)


# questions over the code base: a file's name, an author, words of a document's text after two forms
HQ = """hq AS (SELECT doc_id AS query_id, CASE (doc_id // 20) % 5 WHEN 0 THEN 'where is ' || regexp_replace(regexp_replace(id, '^.*/', ''), '\\.py$', '') || ' defined' WHEN 1 THEN 'who is nation_' || (doc_id % 25) || '?'
 WHEN 2 THEN 'how does the architecture of ' || w || ' work' WHEN 3 THEN 'how is user auth done in ' || w ELSE w END AS text FROM (SELECT doc_id, coalesce(array_to_string(string_split(replace(text, chr(10), ' '), ' ')[20:21], ' '), '') AS w FROM documents WHERE doc_id % 20 = 0) JOIN fx_files ON file_key = doc_id)"""
# documents as chunks of files
CH = "ch AS (SELECT doc_id AS id, text AS content, id AS file FROM documents JOIN fx_files ON file_key = doc_id)"


def hashed_sql(name, source):
    """Vectors of embed_chunks as (id, b, n) and their lengths."""
    return f"""{name}_b AS (SELECT id, CAST(('0x' || left(md5(term), 8)) AS BIGINT) % 64 AS b, count(*) AS n FROM (SELECT id, unnest({SPLIT % 'content'}) AS term FROM {source}) GROUP BY 1, 2),
{name} AS (SELECT id, map_from_entries(list((b, n))) AS m, sqrt(sum(n * n)) AS len FROM {name}_b GROUP BY 1)"""


def hdense_sql(source="hq", name="hall", q="qv", chunks=True):
    """All scores (query_id, id, file, score) of chunks for the questions of ``source``."""
    return f"""{hashed_sql('cv', 'ch') + ',' if chunks else ''} {hashed_sql(q, f'(SELECT query_id AS id, text AS content FROM {source})')},
{name}_d AS (SELECT q.id AS query_id, c.id AS id, sum(q.n * c.n) AS dot FROM {q}_b q JOIN cv_b c ON q.b = c.b GROUP BY 1, 2),
{name} AS (SELECT q.id AS query_id, c.id, c.file, round(coalesce(dot, 0) / (q.len * c.len), 9) AS score FROM {q} q CROSS JOIN (SELECT cv.*, file FROM cv JOIN ch ON ch.id = cv.id) c LEFT JOIN {name}_d d ON d.query_id = q.id AND d.id = c.id)"""


def seeds_sql(scores, name):
    """Nodes of the 45 nearest chunks, the 15 nearest nodes."""
    return f"""{name}_b AS (SELECT query_id, file, max(score) AS score FROM (SELECT * FROM {scores} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 45) GROUP BY 1, 2),
{name}_s AS (SELECT query_id, file AS id, round_even(least(greatest((1 - score) / 1.5e0, 0), 1), 4) AS score FROM {name}_b),
{name} AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS INT) AS rank FROM {name}_s QUALIFY rank <= 15)"""


HDENSE = hdense_sql()


def hsparse_sql(files: bool):
    """Keyword hits over ch for hq, all of them, ranked."""
    near = "WHERE n = n_terms" + (" AND (nf.files IS NULL OR len(list_filter(nf.files, lambda f: contains(ch.file, f) OR contains(f, ch.file))) > 0)" if files else "")
    return f"""w AS (SELECT query_id, list_distinct({SPLIT % CLEAN}) AS terms, ({SPLIT % CLEAN})[1] AS first_term FROM hq),
wt AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM w), tf AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest({SPLIT % 'content'}) AS term FROM ch) GROUP BY 1, 2),
ln AS (SELECT id, sum(tf) AS length FROM tf GROUP BY 1), whole AS (SELECT count(*) AS n_docs, avg(length) AS mean FROM ln), dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
full_ AS (SELECT query_id, id, max(n_terms) AS n_terms, count(*) AS n, sum(ln(1 + (n_docs - df + 5e-1) / (df + 5e-1)) * tf * 2.2e0 / (tf + 1.2e0 * (25e-2 + 75e-2 * length / mean))) AS s FROM wt JOIN tf USING (term) JOIN dfr USING (term) JOIN ln USING (id), whole GROUP BY 1, 2),
hs AS (SELECT full_.query_id, full_.id, round(s, 6) AS score, row_number() OVER (PARTITION BY full_.query_id ORDER BY round(s, 6) DESC, full_.id) AS rank FROM full_ JOIN ch ON ch.id = full_.id {'LEFT JOIN nf ON nf.query_id = full_.query_id' if files else ''} {near})"""


# files of the nodes that a question names, and what the graph says
NAMED = f"""syms AS (SELECT DISTINCT query_id, unnest({SYMBOLS_SQL}) AS term FROM hq),
nm AS (SELECT query_id, id, min(CASE WHEN name = term THEN 1 WHEN id = term THEN 2 WHEN contains(lower(name), lower(term)) THEN 5 ELSE 6 END) AS tier FROM syms JOIN fx_nodes ON contains(lower(id), lower(term)) OR contains(lower(name), lower(term)) GROUP BY 1, 2),
nf AS (SELECT query_id, list(id ORDER BY id) AS files FROM (SELECT * FROM nm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, id) <= 20) GROUP BY 1)"""
LINKED = "lk AS (SELECT DISTINCT file, line FROM (SELECT src AS file, src || ' --[' || relation || ']--> ' || dst AS line FROM fx_edges UNION ALL SELECT dst, src || ' --[' || relation || ']--> ' || dst FROM fx_edges))"
WORKS = """roles AS (SELECT id, top_owner AS name, 1 AS role FROM fx_nodes UNION ALL SELECT id, last_author, 2 FROM fx_nodes UNION ALL SELECT file, author, 3 FROM fx_authors),
asked AS (SELECT query_id, {person} AS person FROM routed), works AS (SELECT person, r.id, min(role) AS role FROM roles r JOIN (SELECT DISTINCT person FROM asked WHERE person IS NOT NULL) p ON contains(lower(name), lower(person)) GROUP BY 1, 2),
work AS (SELECT person, w.id, CASE role WHEN 1 THEN 'OWNER ' WHEN 2 THEN 'LAST_AUTHOR ' ELSE 'COLLABORATOR ' END || w.id AS line FROM works w JOIN fx_nodes n ON n.id = w.id QUALIFY row_number() OVER (PARTITION BY person ORDER BY commit_count DESC, w.id) <= 50)""".replace("{person}", PERSON_SQL)


def graph_sql(anchors: str):
    """``gr`` (query_id, rank, key, content) for anchors (query_id, file, place)."""
    lines = lambda source, most: f"(SELECT query_id, string_agg(line, chr(10) ORDER BY line) AS content FROM (SELECT DISTINCT query_id, line, cap FROM {source} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY line) <= {most}) GROUP BY 1)"
    return f"""{LINKED}, {WORKS}, nq AS (SELECT query_id, unnest(files) AS file, unnest(range(0, len(files))) AS place FROM nf),
an AS (SELECT query_id, file, min(place) AS place FROM (SELECT * FROM nq UNION ALL SELECT query_id, file, place + 1048576 FROM {anchors}) GROUP BY 1, 2),
an10 AS (SELECT a.*, intent, row_number() OVER (PARTITION BY a.query_id ORDER BY place, file) AS nth FROM an a JOIN routed USING (query_id) QUALIFY nth <= 10),
l1 AS (SELECT DISTINCT query_id, line, 20 AS cap FROM nq JOIN lk USING (file)), l2 AS (SELECT DISTINCT query_id, line, CASE WHEN intent IN ('architecture', 'call_flow') THEN 50 ELSE 20 END AS cap FROM an10 JOIN lk USING (file)),
wl AS (SELECT DISTINCT query_id, line, 50 AS cap FROM asked JOIN work USING (person)),
parts AS (SELECT query_id, 0 AS part, place, file AS key, left(content, 8000) AS content FROM nq JOIN {lines('l1', 'cap')} USING (query_id)
 UNION ALL SELECT query_id, 1, 0, 'person:' || person, left(content, 8000) FROM asked JOIN {lines('wl', 'cap')} USING (query_id)
 UNION ALL SELECT query_id, 2, nth, 'graph:' || file, left(content, 6000) FROM an10 JOIN {lines('l2', 'cap')} USING (query_id)
 UNION ALL SELECT query_id, 3, 0, 'graph:overview', left(content, 8000) FROM routed ANTI JOIN an10 USING (query_id), (SELECT string_agg(line, chr(10) ORDER BY line) AS content FROM (SELECT DISTINCT line FROM (
  SELECT src || ' --[' || relation || ']--> ' || dst AS line FROM fx_edges WHERE src IN (SELECT id FROM fx_files ORDER BY id LIMIT 80) QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst, relation) <= 5))) WHERE intent IN ('architecture', 'semantic') AND content <> ''),
gr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, place, key) AS rank, key, content FROM parts QUALIFY rank <= 15)"""


def _docs(fx):
    return fx.documents.join(fx.files.select(F.col("file_key").alias("doc_id"), F.col("id").alias("file")), "doc_id")


def _questions(docs):
    word = F.coalesce(F.array_join(F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), 20, 2), " "), F.lit(""))
    form = F.floor(F.col("doc_id") / 20) % 5
    text = F.when(form == 0, F.concat(F.lit("where is "), F.regexp_replace(X.basename(F.col("file")), r"\.py$", ""), F.lit(" defined"))).when(form == 1, F.concat(F.lit("who is nation_"), (F.col("doc_id") % 25).cast("string"), F.lit("?"))).when(form == 2, F.concat(F.lit("how does the architecture of "), word, F.lit(" work"))).when(form == 3, F.concat(F.lit("how is user auth done in "), word)).otherwise(word)
    return docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), text.alias("text"))


def asked(fx):
    """Questions without vectors."""
    return fx.stages.keep(_questions(_docs(fx)))


def hybrid(fx):
    """Questions with vectors, and chunks with vectors, nodes and files."""
    docs = _docs(fx)
    q = _questions(docs)
    vectors = lambda df: R.embed_chunks(df)
    q = q.join(vectors(q.select(F.col("query_id").alias("id"), F.col("text").alias("content"))).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    c = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "file", F.col("file").alias("node"))
    c = c.join(vectors(c.select("id", "content")), "id")
    return fx.stages.keep(q), fx.stages.keep(c)


@query("R8_graph_search", f"""
WITH {HQ}, {routed_sql('hq')}, {NAMED}, {graph_sql('(SELECT NULL::BIGINT AS query_id, NULL::VARCHAR AS file, 0 AS place WHERE false)')} SELECT query_id, CAST(rank AS INT) AS rank, key, content FROM gr""")
def _(fx):
    q = asked(fx)  # no channel but the graph, so no vectors
    own, nodes = owned(fx), fx.written("nodes")
    routed = R.route_query(q).withColumn("person", R.extract_person(F.col("text")))
    matched = I.nodes_by_name(routed.select("query_id", F.explode(R.extract_symbols(F.col("text"))).alias("term")), nodes, 20)
    files = matched.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("files"))
    none = fx.spark.createDataFrame([], "query_id long, file string, place int")
    return R.graph_search(fx.stages.keep(routed.join(files, "query_id", "left")), none, nodes, fx.written("edges"), own)


def owned(fx):
    """Who worked on what: written once, before nodes, which read it too."""
    return fx.written("authors").select(F.col("file").alias("node"), "author")


FUSED = f"""WITH {HQ}, {CH}, {routed_sql('hq')}, {HDENSE}, {hsparse_sql(False)},
chan AS (SELECT query_id, 'dense' AS c, file AS key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hall QUALIFY rank <= 30 UNION ALL SELECT query_id, 'sparse', file, rank FROM hs JOIN ch ON ch.id = hs.id WHERE rank <= 30),
fused AS (SELECT query_id, key, round(sum(CASE c WHEN 'dense' THEN dense_weight ELSE sparse_weight END / (60 + rank)), 6) AS score FROM chan JOIN routed USING (query_id) GROUP BY 1, 2),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INT) AS rank FROM fused)"""


@query("R9_rrf", FUSED + " SELECT query_id, key, score, rank FROM fr")
def _(fx):
    q, c = hybrid(fx)
    return R.fused_seed_nodes(R.route_query(q), c.drop("file"), stages=fx.stages, k=1 << 30, hits=30).select("query_id", F.col("id").alias("key"), "score", "rank")


@query("R10_rerank", FUSED + " SELECT query_id, key, score, rank FROM fr WHERE rank <= 8")
def _(fx):
    q, c = hybrid(fx)
    return R.rerank(R.fused_seed_nodes(R.route_query(q), c, stages=fx.stages, hits=30).select("query_id", F.col("id").alias("key"), "score", "rank"))


@query("R13_fused_seed_nodes", FUSED + " SELECT query_id, key AS id, score, rank FROM fr WHERE rank <= 15")
def _(fx):
    q, c = hybrid(fx)
    return R.fused_seed_nodes(R.route_query(q), c, stages=fx.stages)


@query("R12_seed_nodes", f"WITH {HQ}, {CH}, {HDENSE}, {seeds_sql('hall', 'sd')} SELECT query_id, id, score, rank FROM sd")
def _(fx):
    q, c = hybrid(fx)
    return R.seed_nodes(q, c)


@query("E5_context_budget", """
SELECT source AS query_id, doc_id, CAST(running AS BIGINT) AS running FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 20000""")
def _(fx):
    rows = fx.documents.select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.col("text").alias("content"))
    return R.context_budget(rows, 20_000).select("query_id", F.col("rank").alias("doc_id"), "running")


@query("R11_hybrid_retrieve", f"""
WITH {HQ}, {CH}, {routed_sql('hq', 20)}, {NAMED}, {HDENSE}, {hsparse_sql(True)},
dw AS (SELECT h.*, k FROM hall h JOIN routed USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 2 * k),
de AS (SELECT query_id, id, file, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dw LEFT JOIN nf USING (query_id) WHERE files IS NULL OR len(list_filter(files, lambda f: contains(file, f) OR contains(f, file))) > 0 QUALIFY rank <= any_value(k) OVER (PARTITION BY query_id)),
sp AS (SELECT query_id, id, rank FROM hs JOIN routed USING (query_id) WHERE rank <= k),
fb AS (SELECT w.query_id, ch.id, row_number() OVER (PARTITION BY w.query_id ORDER BY length(content), ch.id) AS rank FROM (SELECT w.*, k FROM w ANTI JOIN sp USING (query_id) JOIN routed USING (query_id)) w JOIN ch ON contains(lower(content), first_term) LEFT JOIN nf ON nf.query_id = w.query_id
 WHERE nf.files IS NULL OR len(list_filter(nf.files, lambda f: contains(ch.file, f) OR contains(f, ch.file))) > 0 QUALIFY rank <= any_value(k) OVER (PARTITION BY w.query_id)),
{graph_sql('(SELECT query_id, file, min(rank) AS place FROM de GROUP BY 1, 2)')},
chan AS (SELECT query_id, 'd' AS c, file AS key, rank, content FROM (SELECT de.*, content FROM de JOIN ch USING (id)) UNION ALL SELECT query_id, 's', file, rank, content FROM (SELECT * FROM sp UNION ALL SELECT * FROM fb) x JOIN ch USING (id) UNION ALL SELECT query_id, 'g', key, rank, content FROM gr),
fz AS (SELECT query_id, key, round(sum(CASE c WHEN 'd' THEN dense_weight WHEN 's' THEN sparse_weight ELSE graph_weight END / (60 + rank)), 6) AS score, max(length(content)) AS chars FROM chan JOIN routed USING (query_id) GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM fz QUALIFY rank <= 8),
bu AS (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY rank) AS running FROM fr)
SELECT query_id, intent, CAST(rank AS INT) AS rank, key, score, CAST(chars AS INT) AS chars FROM bu JOIN routed USING (query_id) WHERE running <= 120000""")
def _(fx):
    fx.merge_files()
    q, c = hybrid(fx)
    own = owned(fx)
    rows = R.hybrid_retrieve(q, c, fx.written("nodes"), fx.written("edges"), own, fx.stages)
    return rows.select("query_id", "intent", "rank", "key", "score", F.length("content").alias("chars"))


ANSWERS = """SELECT file_key AS query_id, 'See `' || id || ':12` and (' || regexp_replace(id, '^.*/', 'src/') || ') or missing_mod.py:3; handler CoreThing uses missing_symbol' || CASE WHEN file_key % 3 = 0 THEN ' and `gone/away.ts`' ELSE '' END AS answer,
 'context: ' || CASE WHEN file_key % 4 = 0 THEN '' ELSE id END || ' handler code' AS context FROM fx_files"""


def answers(fx):
    extra = F.when(F.col("file_key") % 3 == 0, " and `gone/away.ts`").otherwise("")
    answer = F.concat(F.lit("See `"), "id", F.lit(":12` and ("), F.regexp_replace("id", "^.*/", "src/"), F.lit(") or missing_mod.py:3; handler CoreThing uses missing_symbol"), extra)
    return fx.files.select(F.col("file_key").alias("query_id"), answer.alias("answer"), F.concat(F.lit("context: "), F.when(F.col("file_key") % 4 == 0, "").otherwise(F.col("id")), F.lit(" handler code")).alias("context"))


@query("R15_verify_citations", f"""
WITH a AS (SELECT query_id, lower(context) AS c, lower(regexp_extract(answer, '`([^`:]+):12`', 1)) AS p, query_id % 3 = 0 AS more FROM ({ANSWERS})),
n AS (SELECT query_id, CASE WHEN more THEN 4 ELSE 3 END AS n_found, CASE WHEN contains(c, p) OR contains(c, regexp_replace(p, '^.*/', '')) THEN 2 ELSE 0 END AS n_verified FROM a)
SELECT query_id, n_found, n_verified, n_found - n_verified AS n_failed, n_found = n_verified OR (n_verified > 0 AND n_found - n_verified <= n_verified) AS passed FROM n""")
def _(fx):
    return R.verify_citations(answers(fx))


@query("R16_ungrounded_symbols", f"""
WITH s AS (SELECT query_id, context, unnest(list_distinct(regexp_extract_all(answer, '\\b([A-Z][a-zA-Z0-9_]*|[a-z_][a-z0-9_]{{3,}})\\b', 1))) AS s FROM ({ANSWERS})),
k AS (SELECT query_id, s FROM s WHERE length(s) > 3 AND lower(s) NOT IN ({', '.join(repr(x) for x in R.STOP)}) AND NOT contains(lower(context), lower(s)))
SELECT query_id, string_agg(s, ',' ORDER BY s) AS symbols FROM k GROUP BY 1""")
def _(fx):
    return R.ungrounded_symbols(answers(fx)).select("query_id", F.array_join("symbols", ",").alias("symbols"))


@query("R17_retrieval_benchmark", f"""
WITH {DENSE}, qr AS (SELECT q.vec_id AS query_id, c.vec_id AS id FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id % 20 = 0),
p AS (SELECT qr.query_id, count(*) AS n, min(rank) AS first, count(*) FILTER (WHERE rank <= 1) AS h1, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10 FROM qr LEFT JOIN ranked_dense d ON d.query_id = qr.query_id AND d.id = qr.id GROUP BY 1)
SELECT count(*) AS queries, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(h1 / n), 6) AS recall_1, round(avg(h5 / n), 6) AS recall_5, round(avg(h10 / n), 6) AS recall_10 FROM p""")
def _(fx):
    q = fx.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return R.retrieval_benchmark(dense(fx), q.join(fx.embeddings.select(F.col("vec_id").alias("id"), "label"), "label").select("query_id", "id"))


@query("R18_embed_chunks", f"""
WITH c AS (SELECT doc_id AS id, text AS content FROM documents), {hashed_sql('cv', 'c')}
SELECT id, CAST(b AS INT) AS bucket, round(coalesce(n, 0) / len, 9) AS value FROM cv CROSS JOIN range(64) r(b) LEFT JOIN cv_b USING (id, b)
UNION ALL SELECT doc_id, CAST(b AS INT), 0e0 FROM documents ANTI JOIN cv ON id = doc_id CROSS JOIN range(64) r(b)""")
def _(fx):
    v = R.embed_chunks(chunks(fx))
    return v.select("id", F.posexplode("embedding").alias("bucket", "value")).withColumn("value", F.round(F.col("value").cast("double"), 9))


@query("X2_search_code", f"""WITH {HQ}, {CH}, {HDENSE}, {hsparse_sql(False)}
SELECT query_id, 'dense' AS channel, CAST(rank AS INT) AS rank, x.id, left(content, 300) AS preview FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hall QUALIFY rank <= {K}) x JOIN ch USING (id)
UNION ALL SELECT query_id, 'sparse', CAST(rank AS INT), hs.id, left(content, 300) FROM hs JOIN ch ON ch.id = hs.id WHERE rank <= {K}""")
def _(fx):
    q, c = hybrid(fx)
    return R.search_code(q, c, K, fx.stages)


B_SQL = """
SELECT id, regexp_replace(id, '^[./]+', '') AS b1, id || '|' || replace(id, '/', chr(92)) AS b2, 'python' AS b3,
 regexp_matches(regexp_replace(id, '^.*/', ''), '^test_|_test\\.(py|go|rs)$|\\.test\\.|\\.spec\\.|tests?\\.java') OR starts_with(id, 'tests/') AS b4,
 CASE WHEN regexp_matches(regexp_replace(id, '^.*/', ''), '^test_') OR starts_with(id, 'tests/') THEN 'test' ELSE 'code' END AS b5, false AS b6,
 CASE split_part(id, '/', 1) WHEN 'api' THEN 'api' WHEN 'services' THEN 'service' WHEN 'models' THEN 'data' WHEN 'components' THEN 'ui' WHEN 'utils' THEN 'util' ELSE 'other' END AS b7,
 CASE WHEN regexp_matches(id, 'password|secret|token|api_key|jwt|credential') THEN 'AUTH' ELSE '' END AS b8, regexp_matches(name, 'route|endpoint|api|handler|controller') AS b9,
 CASE WHEN bus_risk*100 >= 75 THEN 'high' WHEN bus_risk*100 >= 40 THEN 'medium' WHEN bus_risk*100 >= 15 THEN 'moderate' ELSE 'low' END AS b12,
 'File in the ' || layer || ' layer: ' || name || '.' || CASE WHEN top_owner IS NOT NULL THEN ' Owned by ' || top_owner || '.' ELSE '' END || CASE WHEN bus_risk >= 5e-1 THEN ' High bus-factor risk.' ELSE '' END || CASE WHEN api_route THEN ' Exposes an API route.' ELSE '' END AS b14,
 id || '::' || name AS b16, CASE WHEN bus_risk*100 >= 80 THEN 'CRITICAL' WHEN bus_risk*100 >= 60 THEN 'HIGH' WHEN bus_risk*100 >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS b19,
 split_part(id, '/', 1) || '/' || split_part(id, '/', 2) AS b21, CASE WHEN bus_risk*100 >= 80 THEN 'failure' WHEN bus_risk*100 >= 60 THEN 'neutral' ELSE 'success' END AS b22 FROM fx_nodes"""


@query("B_path_and_risk_expressions", B_SQL)
def _(fx):
    c = F.col
    risk = c("bus_risk") * 100
    return fx.nodes.select(
        "id", X.normalize_path(c("id")).alias("b1"), F.array_join(X.path_variants(c("id")), "|").alias("b2"), X.detect_language(c("id")).alias("b3"),
        X.is_test_file(c("id")).alias("b4"), X.node_role(c("id")).alias("b5"), X.is_manifest(c("id")).alias("b6"), X.infer_layer(F.lit(None).cast("string"), c("id"), c("name"), c("type")).alias("b7"),
        F.array_join(X.sensitivity_tags(c("id")), ",").alias("b8"), X.is_api_route(c("name")).alias("b9"), X.risk_band(risk).alias("b12"),
        X.summary_line(c("type"), c("layer"), c("name"), c("top_owner"), c("bus_risk"), c("api_route")).alias("b14"),
        X.chunk_node_id(F.lit(""), c("id"), F.lit("function"), c("name")).alias("b16"), X.risk_level(risk).alias("b19"), X.zone(c("id")).alias("b21"),
        X.check_conclusion(X.risk_level(risk), F.lit(True)).alias("b22"),
    )


# names of all kinds, one for each file, with what they are: language, manifest, test, role
KINDS = [
    ("a.PY", "python", False, False, "code"), ("b.jsx", "jsx", False, False, "code"), ("api/c.tsx", "tsx", False, False, "api"), ("d.test.ts", "typescript", False, True, "test"), ("tests/E.java", "java", False, True, "test"),
    ("f.hpp", "cpp", False, False, "code"), ("g.h", "c", False, False, "code"), ("h_test.go", "go", False, True, "test"), ("services/i.rs", "rust", False, False, "backend"), ("j.kt", "kotlin", False, False, "code"),
    ("k.sv", "systemverilog", False, False, "code"), ("l.unknown", "unknown", False, False, "code"), ("noextension", "unknown", False, False, "code"), (".bashrc", "unknown", False, False, "code"), ("pages/m.js", "javascript", False, False, "frontend"),
    ("package.json", "unknown", True, False, "infrastructure"), ("Dockerfile.dev", "unknown", True, False, "infrastructure"), ("requirements-x.txt", "unknown", True, False, "infrastructure"), ("main.tf", "unknown", True, False, "infrastructure"),
    ("setup.py", "python", True, False, "infrastructure"), ("my_package.json", "unknown", False, False, "code"), ("dockerfile_notes", "unknown", False, False, "code"), ("__tests__/n.rb", "ruby", False, True, "test"), ("contest.py", "python", False, False, "code"),
]
_kinds = "(VALUES " + ", ".join(f"({i}, '{n}', '{lang}', {m}, {t}, '{r}')" for i, (n, lang, m, t, r) in enumerate(KINDS)) + ") k(i, name, language, manifest, test, role)"


@query("B3_B6_names_of_all_kinds", f"SELECT 'x' || file_key || '/' || name AS path, language, manifest, test, role FROM fx_files JOIN {_kinds} ON i = file_key % {len(KINDS)}")
def _(fx):
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), (F.col("file_key") % len(KINDS) + 1).cast("int"))
    path = F.concat(F.lit("x"), F.col("file_key").cast("string"), F.lit("/"), name)
    p = F.col("path")
    return fx.files.select(path.alias("path")).select("path", X.detect_language(p).alias("language"), X.is_manifest(p).alias("manifest"), X.is_test_file(p).alias("test"), X.node_role(p).alias("role"))


# a layer's own tag, under any name; folders and modules by the beginning of a part; files by any part
TAGS = [("API", "api"), ("utility", "util"), (" ui ", "ui"), ("unheard", "other"), (None, None)]
PLACES = [("folder", "x/models/y", "data"), ("module", "domain/z", "service"), ("file", "a/db/q.py", "data"), ("file", "src/app/t.tsx", "ui"), ("file", "my_api/s.py", "api"), ("file", "app/backend/models/u.py", "service"), ("file", "plain/w.py", "other"), ("folder", "lib/core/v", "service"), ("file", "", "util")]
_tags = "(VALUES " + ", ".join(f"({i}, {'NULL' if a is None else repr(a)}, {'NULL' if b is None else repr(b)})" for i, (a, b) in enumerate(TAGS)) + ") t(ti, tag, said)"
_places = "(VALUES " + ", ".join(f"({i}, {k!r}, {n!r}, {x!r})" for i, (k, n, x) in enumerate(PLACES)) + ") p(pi, kind, id, layer)"


@query("B7_layers_by_tag_and_place", f"SELECT file_key, coalesce(said, layer) AS layer FROM fx_files JOIN {_tags} ON ti = file_key % {len(TAGS)} JOIN {_places} ON pi = file_key % {len(PLACES)}")
def _(fx):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("file_key") % n + 1).cast("int"))
    kind, node = (pick([p[i] for p in PLACES], len(PLACES)) for i in (0, 1))
    return fx.files.select("file_key", X.infer_layer(pick([t[0] for t in TAGS], len(TAGS)), node, F.lit("utils/name"), kind).alias("layer"))


@query("B10_feature_name", """
SELECT DISTINCT msg, CASE WHEN regexp_matches(msg, '^(feat|feature|fix|chore|refactor)(\\([^)]*\\))?: ') THEN trim(regexp_replace(msg, '^[a-z]+(\\([^)]*\\))?:', '')) ELSE left(msg, 120) END AS feature FROM fx_commits""")
def _(fx):
    return fx.commits.select("msg", X.feature_name(F.col("msg")).alias("feature")).distinct()


@query("B15_teaching_nodes", """
SELECT id, layer, CASE layer WHEN 'api' THEN '#6366f1' WHEN 'service' THEN '#8b5cf6' WHEN 'data' THEN '#06b6d4' WHEN 'ui' THEN '#f59e0b' WHEN 'util' THEN '#64748b' ELSE '#475569' END AS colour, 12 AS val, coalesce(top_owner, 'None') AS owner FROM fx_nodes""")
def _(fx):
    colour = F.coalesce(*[F.when(F.col("layer") == k, v) for k, v in X.LAYER_COLOURS.items()])
    node = F.struct("id", "layer", colour.alias("colour"), F.lit(12).alias("val"), F.struct(F.coalesce("top_owner", F.lit("None")).alias("owner")).alias("ownership"))
    return fx.nodes.select(node.alias("n")).select("n.id", "n.layer", "n.colour", "n.val", "n.ownership.owner")


@query("B17_distance_score", "SELECT vec_id, round_even(least(greatest(abs(embedding[1]::DOUBLE) / 1.5e0, 0), 1), 4) AS score FROM embeddings")
def _(fx):
    return fx.embeddings.select("vec_id", X.distance_score(F.abs(F.col("embedding")[0].cast("double"))).alias("score"))


@query("B18_sanitize_query", f"SELECT doc_id, {CLEAN} AS q FROM documents")
def _(fx):
    return fx.documents.select("doc_id", X.sanitize_query(F.col("text")).alias("q"))


@query("B20_activity_message", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'Pushed 0 commit(s) to main' WHEN 'view' THEN 'Opened pull request: pull request' WHEN 'purchase' THEN 'Closed issue: issue' WHEN 'signup' THEN 'Created branch: dev' ELSE 'Watch in acme/shop' END AS message FROM events""")
def _(fx):
    kinds = {"click": ("PushEvent", '{"ref": "refs/heads/main"}'), "view": ("PullRequestEvent", '{"action": "opened"}'), "purchase": ("IssuesEvent", '{"action": "closed"}'), "signup": ("CreateEvent", '{"ref_type": "branch", "ref": "dev"}')}
    pick = lambda i, d: F.coalesce(*[F.when(F.col("event_type") == k, v[i]) for k, v in kinds.items()], F.lit(d))
    return fx.events.select("event_id", X.activity_message(pick(0, "WatchEvent"), pick(1, "{}"), F.lit("acme/shop")).alias("message"))


@query("B11_repo_slug", r"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'acme/p' || page_id END AS slug FROM pages")
def _(fx):
    url = F.when(F.col("page_id") % 2 != 0, F.col("url")).when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://github.com/acme/p"), F.col("page_id").cast("string"), F.lit(".git"))).otherwise(F.concat(F.lit("git@github.com:acme/p"), F.col("page_id").cast("string"), F.lit("/")))
    return fx.pages.select("page_id", X.repo_slug(url).alias("slug"))
