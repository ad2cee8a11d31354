"""The queries of the corpus operators: each applies its operator to a whole table. See ORACLES for their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import ann, decontaminate, embedding_dups, html_blocks, lm_scores, manifest, mixing, pii, quality, runs, simhash, substrings, token_counts
from cairn.llm.common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_blocks.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


def op3_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, radius=3)
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.describe(pii.find_spans(_table(spark, sf_dir, "documents")))


def op6_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty here, so that the query encodes every distinct text; a pipeline keeps one path."""
    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), cache, drops_space=True)


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores.score_documents(_table(spark, sf_dir, "documents"))
    return scores.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.describe(_table(spark, sf_dir, "documents"))


def op12_hyperplane_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.describe(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_adaptive_dimension_scan, op2_text_blocks, op3_covering_simhash, op4_sentence_spans, op5_contextual_pii, op6_neighbour_quality, op7_token_cache, op8_stupid_backoff, op9_positional_index, op10_temperature_mixing, op11_merkle_manifest, op12_hyperplane_dups, op13_suffix_tree_runs)}

_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

def _merkle_sql(levels: int = 8) -> str:
    """Both trees level by level, over 8 ** ``levels`` leaves at most; what is one node stays as it is."""

    def tree(name: str, key: str) -> list[str]:
        part, steps = f"{key}, " if key else "", []
        for k in range(levels):
            run = f"OVER (PARTITION BY {part}i // 8 ORDER BY i ROWS BETWEEN"
            before, after = f"string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING)", f"string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
            steps.append(f"{name}s{k} AS (SELECT *, coalesce({before}, '') AS l, coalesce({after}, '') AS r, count(*) OVER ({'PARTITION BY ' + key if key else ''}) > 1 AS up FROM {name}{k})")
            steps.append(f"{name}{k + 1} AS (SELECT {part}i // 8 AS i, CASE WHEN any_value(up) THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d FROM {name}s{k} GROUP BY {part}i // 8)")
        return steps

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"

    step = "xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), k // 8 + 1, 1)) ELSE 0 END)"
    crc = f"xor(list_reduce(range(0, 8 * length(CAST(doc_id AS VARCHAR))), lambda c, k: xor({step} >> 1, ({step} & 1) * 3988292384), CAST(4294967295 AS BIGINT)), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    nodes = [f"a{k}" for k in range(levels)] + [f"b{k}" for k in range(levels)]
    joins = [f"JOIN as{k} a{k} ON a{k}.g = f.g AND a{k}.i = f.i // {8**k} JOIN bs{k} b{k} ON b{k}.i = f.gi // {8**k}" for k in range(levels)]
    proof = ", ".join(f"CASE WHEN {x}.up THEN {x}.l || {x}.r ELSE '' END" for x in nodes)
    folds = ", ".join(f"CASE WHEN {x}.up THEN sha256({x}.l || x{k} || {x}.r) ELSE x{k} END AS x{k + 1}" for k, x in enumerate(nodes))
    steps = ",\n".join(
        [
            f"leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS d, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS seen FROM documents)",
            "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM leaves)",
            *tree("a", "g"),
            f"b0 AS (SELECT g, d, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM a{levels})",
            *tree("b", ""),
            f"f AS (SELECT a0.*, b0.i AS gi, b0.d AS subroot, (SELECT d FROM b{levels}) AS root FROM a0 JOIN b0 USING (g))",
            f"x AS (SELECT f.doc_id, f.d AS leaf, f.subroot, f.root, sha256(concat({proof})) AS proof_sha256, f.seen AS x0, {folds} FROM f {' '.join(joins)})",
        ]
    )
    last = f"x{len(nodes)}"
    return f"WITH {steps}\nSELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, {last} = root AS verified FROM x"


ORACLES = {
    "op8_stupid_backoff": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
b AS (SELECT doc_id, word AS w, coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY pos), ' start') AS v FROM t),
one AS (SELECT w, count(*) AS c1 FROM b GROUP BY w), ctx AS (SELECT v, count(*) AS cv FROM b GROUP BY v), two AS (SELECT v, w, count(*) AS c2 FROM b GROUP BY v, w),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE c2 >= 2) AS n_seen,
 sum(CASE WHEN c2 >= 2 THEN ln(c2) - ln(cv) ELSE ln(4e-1) + ln(c1) - ln((SELECT count(*) FROM b)) END) AS score
 FROM b JOIN one USING (w) JOIN ctx USING (v) JOIN two USING (v, w) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_seen, 0) AS n_seen, round(coalesce(score, 0), 4) AS log_score, round(score / n_words, 6) AS mean_log_score
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN s USING (doc_id)""",
    "op9_positional_index": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, n FROM occ JOIN win USING (n, phrase)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_merkle_manifest": _merkle_sql(),
    "op12_hyperplane_dups": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.b = v.r GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)""",
}
