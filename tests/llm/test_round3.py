"""Manifest, embedding duplicates and periodic runs against plain Python, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import ann, embedding_dups, html_blocks, lm_scores, manifest, runs, substrings
from cairn.llm.common import Workspace
from cairn.llm.queries import QUERIES

ODD = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank int, digest string, kept int, words string, start long, __read long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties of ids, columns with names that operators use."""
    long = "Lorem ipsum dolor sit amet. " * 5_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "", "s", 5), (4, long, "en", "s", len(long)), (5, "A b C", "en", None, 5), (5, "A b C", "en", None, 5), (5, "other", "en", "t", 5), (None, "No id", None, "t", 5), (None, "no ID", "de", "t", 5), (6, "ÀÉ ß \U0001f600 \x00 x", "é", "t", 9), (7, "a b " * 9, "\U0001f600", "t", 36), (0, "x " * 6, "z", "t", 12)]
    return spark.createDataFrame([(*r, "t", 1, "d", 2, "w", 3, 4) for r in rows], ODD)


# manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests):
    """(root, [siblings (left, right) of each leaf from below])."""
    level, places, paths = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        for path, i in zip(paths, places, strict=True):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            path.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        places = [i // 8 for i in places]
    return level[0], paths


def plain_manifest(table):
    langs = sorted({r["lang"] for r in table}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])), k) for k, r in enumerate(table) if r["lang"] == lang)
        trees[lang] = (own, *plain_tree([x[0][2] for x in own]))
    root, above = plain_tree([trees[x][1] for x in langs])
    out = []
    for lang, up in zip(langs, above, strict=True):
        own, subroot, paths = trees[lang]
        for ((_, _, leaf), k), path in zip(own, paths, strict=True):
            r, text = table[k], table[k]["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            now = plain_leaf(r, text)
            for left, right in path + up:
                now = sha(left + now + right)
            out.append((r["doc_id"], leaf, subroot, root, sha("".join(a + b for a, b in path + up)), now, now == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_on_odd_rows(odd):
    out = sorted((tuple(r[c] for c in COLUMNS) for r in manifest.describe(odd).collect()), key=str)
    assert out == plain_manifest([r.asDict() for r in odd.collect()])


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65, 513, 4097])
def test_manifest_of_any_size(spark, n):
    rows = [(i, f"Text {i % 7}", None if i % 3 else f"l{i % 11}", "s", 6) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = sorted((tuple(r[c] for c in COLUMNS) for r in manifest.describe(table).collect()), key=str)
    assert out == (plain_manifest([r.asDict() for r in table.collect()]) if n else [])


def test_manifest_of_equal_rows_and_many_groups(spark):
    same = spark.createDataFrame([(7, "T", "en", "s", 1)] * 700 + [(i, "U", f"g{i}", "s", 1) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = sorted((tuple(r[c] for c in COLUMNS) for r in manifest.describe(same).collect()), key=str)
    assert out == plain_manifest([r.asDict() for r in same.collect()])


# embedding duplicates


def plain_links(table, threshold=0.93):
    """[(n_links, component, kept)] of rows (id, group, vector)."""

    def sound(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(table)
    near = [set() for _ in range(n)]
    for a in range(n):
        for b in range(a):
            (_, g, v), (_, h, w) = table[a], table[b]
            if g is not None and g == h and sound(v) and sound(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[a].add(b), near[b].add(a)
    part = list(range(n))
    for a in range(n):
        if part[a] == a:
            todo = [a]
            while todo:
                for b in near[todo.pop()]:
                    if part[b] != a:
                        part[b] = a
                        todo.append(b)
    out = []
    for a in range(n):
        ids = [table[b][0] for b in range(n) if part[b] == part[a] and table[b][0] is not None]
        least = min(ids, default=None)
        out.append((table[a][0], len(near[a]), least, table[a][0] == least))
    return sorted(out, key=str)


def crowd(seed, n, dim=16):
    """Vectors around some centres, near the threshold of one another, copies, scaled copies and unrelated ones."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    out = []
    for i in range(n):
        kind = rng.integers(0, 6)
        v = centres[rng.integers(0, 4)] + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.3]) if kind < 4 else rng.standard_normal(dim)
        if kind == 0 and out:
            v = np.array(out[rng.integers(0, len(out))][2]) * (1 if i % 2 else 3)
        out.append((i, int(rng.integers(0, 2)), [float(np.float32(x)) for x in v]))
    return out


@pytest.mark.parametrize(("n", "tile", "kind"), [(300, 1024, "float"), (260, 16, "float"), (200, 7, "double")])
def test_links_equal_brute_force(spark, n, tile, kind):
    table = crowd(n, n)
    frame = spark.createDataFrame(table, f"vec_id long, label int, embedding array<{kind}>")
    out = embedding_dups.near_duplicates(frame, tile=tile)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_links(table)


def test_links_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [1.0, 2.0], [2.0, 4.0], None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [3.0], [-1.0, -2.0], [1e-40, 2e-40], [1e300, 2e300]]
    table = [(i, 1, v) for i, v in enumerate(vectors)] + [(50, None, [1.0, 2.0]), (None, 1, [1.0, 2.0]), (0, 1, [5.0, -3.0]), (3, 2, [1.0, 2.0]), (3, 2, [1.0, 2.0]), (None, 3, [1.0, 1.0]), (None, None, None)]
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in table], "vec_id long, label int, embedding array<double>, node int, code int, grp string")
    out = embedding_dups.near_duplicates(frame).collect()
    assert sorted((tuple(r) for r in out), key=str) == plain_links(table)
    assert embedding_dups.near_duplicates(frame.limit(0)).collect() == []


def test_tables_keep_the_miss_bound():
    for n in (0, 1, 500, 10_000, 10**6, 10**9):
        bits, tables = embedding_dups.table_shape(n, 0.93)
        agree = (1 - np.arccos(0.93) / np.pi) ** bits
        assert (1 - agree) ** tables <= embedding_dups.MISS and n / 2**bits <= embedding_dups.BUCKET


# periodic runs


def plain_runs(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            part = words[i : j + q]
            if size >= max(least, times * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_plain():
    rng = random.Random(7)
    for _ in range(1500):
        n, k = rng.randrange(60), rng.choice([1, 2, 2, 3, 5, 30])
        words = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange(n - a)
            for i in range(a, rng.randrange(a, n) + 1):
                words[i] = words[a + (i - a) % p]
        for least, times in ((6, 4), (1, 2), (4, 3)):
            assert [tuple(r) for r in runs.word_runs(words, least, times).tolist()] == plain_runs(words, least, times)


def test_extensions_equal_plain():
    rng = random.Random(3)
    for n in (1, 2, 40, 700):
        s = [1 + rng.randrange(2) for _ in range(n)]
        depths, at, rank = runs.SuffixTree(s).tour()
        i, j = np.array([(a, b) for a in range(n) for b in range(n) if a != b][:4000] or [(0, 1)]).T
        want = [next((k for k in range(n) if a + k >= n or b + k >= n or s[a + k] != s[b + k]), n) for a, b in zip(i, j, strict=True)]
        assert runs.Extensions(depths, at)(i, j).tolist() == want
        assert sorted(range(n + 1), key=lambda a: [*s, 0][a:]) == np.argsort(rank).tolist()


def plain_rows(table):
    out = []
    for doc_id, text in table:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = plain_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
        out.append((doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(lines), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_run_rows_equal_plain(spark, sf):
    table = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t if len(t) < 6000 else t[:6000]) for i, t in table]  # plain Python is quadratic
    frame = spark.createDataFrame(short, "doc_id long, text string")
    assert sorted((tuple(r) for r in runs.describe(frame).collect()), key=str) == plain_rows(short)
    assert QUERIES["op13_suffix_tree_runs"](spark, sf).count() == len(table)


def test_runs_of_odd_rows(odd):
    rows = odd.where("n_chars is null or n_chars < 1000")
    table = [(r["doc_id"], r["text"]) for r in rows.collect()]
    assert sorted((tuple(r) for r in runs.describe(rows).collect()), key=str) == plain_rows(table)
    long = runs.periodic_runs(odd.where("n_chars > 1000")).first()["__runs"]
    assert [tuple(r) for r in long["runs"]] == [(0, 25_000, 5)] and long["text"] == "Lorem ipsum dolor sit amet."
    assert runs.describe(odd.limit(0)).collect() == []


def test_periods_of_all_planted_kinds(spark):
    rng = random.Random(11)
    table = [(i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(90)))) for i in range(400)]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    out = runs.describe(frame)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_rows(table)
    assert out.where(F.col("n_runs") > 0).count() > 10


# earlier operators


def test_scores_of_text_ids(spark):
    texts = ["the cat sat on the mat", "the cat ran", None, "the dog sat on the mat"]
    by = [{r["doc_id"]: tuple(r)[1:] for r in lm_scores.score_documents(spark.createDataFrame([(name(i), t) for i, t in enumerate(texts)], f"doc_id {kind}, text string")).collect()} for name, kind in ((lambda i: i, "long"), (lambda i: f"d-{i}", "string"))]
    assert by[1] == {f"d-{i}": v for i, v in by[0].items()}
    shared = spark.createDataFrame([("a", "x y"), ("a", "x y"), (None, "x y z")], "doc_id string, text string")
    assert {(r["doc_id"], r["n_words"]) for r in lm_scores.score_documents(shared).collect()} == {("a", 4), (None, 3)}


def test_runs_of_stops_take_linear_time():
    for text in ("." * 400_000, "!?" * 200_000 + "x", "a. " * 100_000, "\n" * 200_000):
        assert "".join(text[a:b] for a, b in substrings.sentences(text)) == text


def test_run_hashes_tell_runs_apart():
    rng = random.Random(2)
    seen, back = {}, {}
    for _ in range(400):
        words = [rng.choice(["a", "b", "c.", "dd", "e\n", "f!"]) for _ in range(rng.randrange(120))]
        text = " ".join(words)
        own = text.split()
        hashes, starts, cuts = substrings.pieces(text)
        assert [text[i:].split()[0] for i in starts] == own
        first, end = substrings.runs(cuts, 5, 2)
        a, z = np.concatenate([[0], cuts])[first], cuts[end - 1]
        for i, j, key in zip(a, z, zip(*(h.tolist() for h in substrings.run_hashes(hashes, a, z)), strict=True), strict=True):
            assert j - i >= 5 and seen.setdefault(key, own[i:j]) == own[i:j]
            assert back.setdefault(tuple(own[i:j]), key) == key


def test_an_id_with_many_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    rows = [(0, (base + 1e-3 * rng.standard_normal(8)).tolist()) for _ in range(9)] + [(i, rng.standard_normal(8).tolist()) for i in range(1, 40)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=5).collect()
    assert len(out) == 9 * 5 and all(r["vec_id"] != 0 for r in out)


def test_pipeline_keeps_clashing_columns(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ("row", "__row", "score", "held_out", "predicted", "position", "epoch", "n_tokens", "block", "component_id", "fp", "key", "hash")
    table = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumns({c: F.lit(f"own {c}") for c in names})
    for name, stage in pipeline.STAGES[:-1]:
        out = Workspace(spark, "test").save(stage(spark, table, sf), "stage")
        assert out.columns == table.columns, name
        assert out.where(" or ".join(f"{c} is null or {c} <> 'own {c}'" for c in names)).count() == 0, name
    mixed = pipeline.mixture(spark, table, sf)
    assert set(table.columns) <= set(mixed.columns) and len(mixed.columns) == len(table.columns)
    assert mixed.where("position is null or cast(position as string) like 'own%'").count() == 0 < mixed.count()


def test_names_inside_attributes_and_links_around_blocks(spark):
    w = lambda n, x: " ".join([x] * n)
    pages = [
        (f'<article title="The hidden valley"><p>{w(30, "in")}</article>', w(30, "in")),
        (f'<main data-sidebar="hidden"><p>{w(30, "in")}</main>', w(30, "in")),
        (f'<article><p>{w(30, "in")}<p data-hidden=1>{w(20, "in")}<p hidden>{w(9, "out")}</article>', w(50, "in")),
        (f'<article><p>{w(30, "in")} see <a href="/hidden-valley">the valley</a> now</article>', w(30, "in") + " see the valley now"),
        (f'<nav><a>out</a></nav><article><h1>{w(5, "in")}</h1><p>{w(60, "in")}<section class="share-economy"><p>{w(60, "in")}</section></article><footer>{w(9, "out")}</footer>', w(125, "in")),
        (f'<main><div class="menu-of-the-day"><p>{w(40, "in")}<p>{w(33, "in")}</div></main><footer>{w(9, "out")}</footer>', w(73, "in")),
        (f'<article class="news alert-2024"><p>{w(50, "in")}</article><article class="news"><p>{w(60, "in")}</article>', w(110, "in")),
        (f'<div><h1>{w(6, "in")}</h1><p>{w(70, "in")}<p>{w(55, "in")}</div><div><a href=1><h3>{w(5, "out")}</h3><p>{w(26, "out")}</p></a></div><div><a href=2><h3>{w(5, "out")}</h3><p>{w(26, "out")}</p></a></div>', w(131, "in")),
        (f'<article><p>{w(50, "in")}<div class="social-share-buttons">{w(4, "out")}</div><p>{w(40, "in")}</article><div class="cookie-notice">{w(12, "out")}</div>', w(90, "in")),
        (f'<article><p>{w(40, "in")}<ul><li><a href=x>in in<li>in in in</ul><p>{w(40, "in")}</article>', w(85, "in")),
    ]
    frame = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "page_id long, html string")
    assert {r["page_id"]: r["text"] for r in html_blocks.extract_text(frame).collect()} == {i: t for i, (_, t) in enumerate(pages)}
