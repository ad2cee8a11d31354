"""The corpus operators against plain Python, and on nulls, empty and long texts, repeats and empty tables."""

import hashlib
import os
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import ann, decontaminate, html_blocks, lm_scores, mixing, pii, quality, simhash, substrings, token_counts
from cairn.llm.common import Workspace
from cairn.llm.components import connected_components
from cairn.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.oracle import same

EXTRA = "key string, fp string, pos int, a string, n int, id int, row int, position string, score string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with names that operators use."""
    long = "lorem ipsum dolor sit amet consectetur " * 20_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "en", "s", 5), (4, long, "en", "s", len(long)), (5, "one two three four. Five!", "en", None, 24), (5, "one two three four. Five!", "en", None, 24), (None, "no id here, mail x.y@z.org please", None, "t", 3), (6, "ÀÉ ß \U0001f600 ١٢٣ \x00 x", "de", "t", 9)]
    return spark.createDataFrame([(*r, "k", "f", 1, "a", 2, 3, 4, "p", "s") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], ORACLES[name])


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source) for i, t in enumerate(texts)], "doc_id long, text string, source string")


# simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(fps):
    """{id: smallest id reachable} over links of at most three bits."""
    ids, comp = list(fps), {}
    for i in sorted(ids):
        if i in comp:
            continue
        todo = [i]
        comp[i] = i
        while todo:
            x = todo.pop()
            for j in ids:
                if j not in comp and bin(fps[x] ^ fps[j]).count("1") <= 3:
                    comp[j] = i
                    todo.append(j)
    return comp


def test_simhash_equals_plain(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    comp = plain_components(fps)
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_covering_simhash"](spark, sf).collect()}
    assert out == {i: (f"{fps[i]:016x}", comp[i]) for i in texts}


@pytest.mark.parametrize("limit", [2, 8, 256])
def test_covering_links_find_all_pairs(spark, limit):
    rng = np.random.default_rng(limit)
    values = set()
    for centre in rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(25):
            x = centre
            for b in rng.integers(0, 9, rng.integers(0, 5)):  # few positions flip, so buckets get crowded
                x ^= 1 << int(b) * 7
            values.add(x)
    fps = {i: x for i, x in enumerate(sorted(values))}
    signed = {i: x - (1 << 64) if x >> 63 else x for i, x in fps.items()}
    frame = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    work = Workspace(spark, "test")
    links = simhash.fingerprint_links(frame, work, bucket_limit=limit)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 3).count() == 0
    parts = {r["node"]: r["component"] for r in connected_components(links, work).collect()}
    groups = {}
    for i, x in signed.items():
        groups.setdefault(parts.get(x, x), set()).add(i)
    want = {}
    for i, c in plain_components(fps).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_masks_cover_every_three_positions():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for i in range(0, 64, 3):
        for j in range(64):
            for k in range(j, 64):
                diff = (1 << i) | (1 << j) | (1 << k)
                assert any(not m & diff for m in masks)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    out = {r["node"]: r["component"] for r in connected_components(edges, Workspace(spark, "test")).collect()}
    assert {out[i] for i in range(1, 41)} == {0} and out[101] == 100


# decontamination


def plain_hits(text, items, size=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    w, hit, found = words(text), set(), set()
    for item, t in items.items():
        x = words(t)
        n = min(size, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


@pytest.mark.parametrize("bound", [0, 1000])
def test_decontamination_equals_plain(spark, odd, none, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", bound)
    items = {7: "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", 8: "One two", 9: None, 10: "", 11: "x", 12: "one TWO", 13: "the the the"}
    texts = ["Alpha beta, gamma delta epsilon zeta eta theta iota kappa", "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "one two one two", None, "", "the the the the", "alpha beta gamma", "x\x00x"]
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    out = decontaminate.decontaminate(docs(spark, texts), b, broadcast_terms=bound).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in out}
    assert got == {i: plain_hits(t, items) for i, t in enumerate(texts)}
    assert decontaminate.decontaminate(odd, b).count() == odd.count()
    assert decontaminate.decontaminate(none, b).count() == 0
    assert {r["n_hit"] for r in decontaminate.decontaminate(odd, b.limit(0)).collect()} == {0}


def test_proximity(spark):
    work = Workspace(spark, "test")
    v = spark.createDataFrame([("", 0), ("near", 1), ("far", 2)], "term string, term_id long")
    index = decontaminate.build_index(docs(spark, ["near x x far", "near x x x x x far", "far near far"]), v, work)
    out = decontaminate.proximity_matches(index, spark.createDataFrame([(1, 1, 2)], "pair_id int, a long, b long"), 3).collect()
    assert sorted((r["doc_id"], r["pos_a"], r["pos_b"]) for r in out) == [(0, 0, 3), (2, 1, 0), (2, 1, 2)]


# token counts


def test_token_counts_equal_the_library(spark, sf, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    cache = str(tmp_path / "cache")
    special = docs(spark, ["<|endoftext|> a <|ENDOFTEXT|>", "don't\x1cstop!\x1c!", "a b　c é", " " * 10, "İSTANBUL ΣΑΣ", None])
    for table in (spark.read.parquet(f"{sf}/documents.parquet"), odd, special):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        out = token_counts.count_tokens(table, path, cache, drops_space=True).collect()
        want = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in out) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in out)
    n = spark.read.parquet(cache).count()
    again = token_counts.count_tokens(special, path, cache, drops_space=True)
    assert again.count() == 6 and spark.read.parquet(cache).count() == n, "known digests are not encoded again"
    assert token_counts.count_tokens(none, path, cache, drops_space=True).count() == 0
    model = token_counts.count_tokens(special, tokenizer_path("piece_bpe_32k.model"), cache)
    assert model.where("n_tokens > 0").count() >= 4


# personal data


def test_base_spans_equal_plain():
    text = "x a.b+c@d-e.fg. 1.2.3.4.5 999.1.1.1 and 4111 1111-1111 1111 +1 (212) 555-0100 +12 4111111111111112 é 10.0.0.255 u@v"
    got = pii.base_spans(text)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in got] == [("email", "a.b+c@d-e.fg"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (212) 555-0100"), ("ip", "10.0.0.255")]
    assert pii.base_spans(None) == pii.base_spans("") == []


def test_bootstrap_finds_unseen_identifiers(spark, odd, none):
    seen = [f"Please call us at +1 212 555 01{i:02d} today for help" for i in range(12)]
    unseen = ["Please call us at 212-555-7788 today for help", "Room 212-555-7788 is closed", "paid 5551234567 in cash"]
    out = {r["doc_id"]: r for r in pii.describe(pii.find_spans(docs(spark, seen + unseen))).collect()}
    assert out[12]["spans"] == "phone:18:30" and out[12]["n_phone"] == 0
    assert out[13]["spans"] == out[14]["spans"] == "" and out[0]["spans"] == "phone:18:33"
    assert out[0]["base_sha256"] == hashlib.sha256(b"phone:18:33").hexdigest()
    assert pii.describe(pii.find_spans(odd)).count() == odd.count() and pii.find_spans(none).count() == 0
    clean = pii.redact(docs(spark, seen + unseen))
    assert clean.where("doc_id = 12").first()["text"] == "Please call us at [PHONE] today for help"
    assert clean.columns == ["doc_id", "text", "source"]
    assert pii.redact(odd).count() == odd.count() and pii.redact(odd).schema == odd.schema


# quality


def test_held_out_quality(spark, sf, odd, none):
    import zlib

    out = {r["doc_id"]: r for r in QUERIES["op6_neighbour_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(out[x["doc_id"]]["predicted"], x["quality"]) for x in labels if out[x["doc_id"]]["held_out"]]
    assert np.mean([p == q for p, q in held]) >= 0.9
    lab = spark.createDataFrame([(4, 1), (5, 0), (5, None), (99, 1), (None, 1)], "doc_id long, quality int")
    scored = quality.score_quality(odd, lab)
    assert scored.count() == odd.count() and scored.where("score is null").count() == 0
    assert quality.score_quality(none, lab).count() == 0
    assert {r["score"] for r in quality.score_quality(odd.drop("score"), lab.limit(0)).collect()} == {0.5}


def test_vote_is_exact():
    rng = np.random.default_rng(0)
    v, known, y = rng.standard_normal((20, 8)), rng.standard_normal((50, 8)), rng.integers(0, 2, 50).astype(float)
    v, known = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (v, known))
    got = quality.vote(v, known, y, 7, 2.0, 0.5)
    for row, g in zip(v, got, strict=True):
        c = known @ row
        top = np.argsort(-c)[:7]
        w = np.clip(c[top], 0, 1) ** 2
        assert g == pytest.approx(((w * y[top]).sum() + 0.25) / (w.sum() + 0.5))


# near neighbours


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[200:500] = x[0]  # a large group of copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2050, [0.0] * 24, 0), (2100, [float("nan")] * 24, 0), (2150, [1.0], 0), (2151, [-2.0], 0), (2250, [1.0, 2.0], 0), (None, x[3].tolist(), 0), (50, x[50].tolist(), 0), (2200, (x[7] * 1e30).tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")
    out = ann.nearest(table, F.col("vec_id") % 50 == 0).toPandas()
    ids = np.array([*range(1500), 2200])
    y = np.array([*x.astype(float), x[7].astype(float)])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = 0
    queries = [i for i in ids if i % 50 == 0]
    assert out[out["query_id"] == 2150][["vec_id", "score"]].values.tolist() == [[2151, -1.0]]
    out = out[out["query_id"] != 2150]
    assert sorted(out["query_id"].unique()) == queries
    for q in queries:
        s = y @ y[np.flatnonzero(ids == q)[0]]
        keep = ids != q
        order = np.lexsort((ids[keep], -np.round(s[keep], 12)))[:5]
        got = out[out["query_id"] == q].sort_values("rank")
        assert got["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(got["vec_id"])
        hit += len(set(got["vec_id"]) & set(ids[keep][order]))
    assert hit / (5 * len(queries)) >= 0.9
    assert out[out["query_id"] == 0].sort_values("rank")["vec_id"].tolist() == [200, 201, 202, 203, 204]
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(table.where("vec_id in (1, 2)"), F.lit(True)).count() == 2


def test_recall_on_the_table(spark):
    """All of the vectors at sf0.1 (sf0.001 in a quick run) against all products."""
    sf = os.environ.get("TEST_ANN_DIR", "/root/testdata/sf0.001")
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = QUERIES["op1_adaptive_dimension_scan"](spark, sf).toPandas()
    asked, hit = [i for i in ids if i % 50 == 0], 0
    for q in asked:
        s = x @ x[ids == q][0]
        true = [i for i in ids[np.lexsort((ids, -s))] if i != q][:5]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine["score"], [s[ids == i][0] for i in mine["vec_id"]], atol=1e-12)
        hit += len(set(true) & set(mine["vec_id"]))
    assert hit >= 0.9 * 5 * len(asked), hit / (5 * len(asked))


def test_huge_and_tiny_components_and_shared_ids(spark):
    big = 1.5e308
    rows = [(0, [big, big]), (1, [big, -big]), (2, [1e-320, 1e-320]), (3, [1.0, 1.0]), (4, [1.0, 0.0]), (4, [0.0, 1.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 4)).collect()
    got = [(r["vec_id"], round(r["score"], 6)) for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 0]
    assert got == [(2, 1.0), (3, 1.0), (4, 0.707107), (4, 0.707107), (1, 0.0)]
    assert all(np.isfinite(r["score"]) and r["vec_id"] != r["query_id"] for r in out)
    assert sum(r["query_id"] == 4 and r["rank"] == 1 for r in out) == 2, "each vector of a shared id asks by itself"


def test_scan_without_limits_is_exact():
    rng = np.random.default_rng(2)
    q, r = rng.standard_normal((5, 32)), rng.standard_normal((300, 32))
    at_q, at_r, d = ann.adaptive_scan(q, np.full(5, np.inf), r, 4, 8, 2.1)
    for i in range(5):
        full = ((r - q[i]) ** 2).sum(1)
        assert at_r[at_q == i].tolist() == np.argsort(full)[:4].tolist()
        assert np.allclose(d[at_q == i], np.sort(full)[:4])


# main text


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p><b>";</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div class="cookie-notice">We use cookies to improve things for you.</div><aside class=sidebar><p>Related reading that goes on for quite a while, in the side bar of this page.</aside>
<article><h1>A &amp; B</h1><p>First   par&#97;graph with <b>bold</b>ness and 1 &lt; 2.<br>Next line<p>Second, unclosed <i>one</i><div class="ad">Buy now, it is cheap and good</div><ul><li>item one<li>item <a href=x>two</a></ul>
<form><label>Mail</label><input name=q><button>Go</button></form></article><section id="comments"><p>Great article, thanks for sharing all of this with us here.</p></section><!-- x <p>no</p> --><footer>&copy; 2024 Site</footer></body>"""
MAIN = "A & B First paragraph with boldness and 1 < 2. Next line Second, unclosed one item one item two"


def test_main_text(spark, sf):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, None, ""), (4, "w", "plain words only, without any tag, and some more of them here"), (1, "u", PAGE), (5, "x", "<p>" * 3000 + "deep text of a page with some words in it" + "</p>")], "page_id long, text string, html string")
    out = html_blocks.extract_text(pages).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == 6 and got[1] == MAIN and got[2] == got[3] == ""
    assert got[4].startswith("plain words") and got[5].startswith("deep text")
    table = spark.read.parquet(f"{sf}/pages.parquet").collect()
    texts = {r["page_id"]: r["text"] for r in QUERIES["op2_text_blocks"](spark, sf).collect()}
    import html

    for r in table:  # these pages hold their article in one element
        body = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())
        assert " ".join(texts[r["page_id"]].split()) == want


# substring dedup


def test_repeated_passages(spark, odd, none):
    passage = "The quick brown fox jumps over the lazy dog near the river bank. It then went home to sleep for many hours. Nobody saw it leave the old barn that night. All was calm again until the sun rose over the wide and silent fields at last."
    texts = [f"Own start of one. {passage} Own end of it.", f"Different opening words.\n{passage}\nAnd more.", "Short. Short. Short. Short.", None, passage, "word " * 200]
    out = {r["doc_id"]: r for r in substrings.remove_repeats(docs(spark, texts)).collect()}
    assert out[0]["text"] == texts[0] and out[0]["n_removed"] == 0
    assert out[1]["text"] == "Different opening words.\nAnd more." and out[4]["text"] == ""
    assert out[2]["text"] == texts[2] and out[3]["text"] is None
    assert 0 < len(out[5]["text"]) < len(texts[5]), "a repeat inside a document goes, too"
    assert substrings.remove_repeats(odd).count() == odd.count() and substrings.remove_repeats(none).count() == 0


def test_repeats_equal_plain(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    seen, want = {}, {}
    for r in sorted(table.collect(), key=lambda r: r["doc_id"]):
        t = r["text"] or ""
        parts = substrings.sentences(t)
        assert "".join(t[a:b] for a, b in parts) == t
        gone, words = set(), [t[a:b].split() for a, b in parts]
        for i in range(len(parts)):
            j = next((j for j in range(i + 2, len(parts) + 1) if sum(map(len, words[i:j])) >= 25), None)
            if j and seen.setdefault(" ".join(w for x in words[i:j] for w in x), (r["doc_id"], i)) != (r["doc_id"], i):
                gone |= set(range(i, j))
        want[r["doc_id"]] = ("".join(t[a:b] for i, (a, b) in enumerate(parts) if i not in gone).rstrip() if gone else r["text"], len(gone))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substrings.remove_repeats(table).collect()}
    assert got == want


# language model


def plain_scores(texts, least=2, backoff=0.4):
    import math
    from collections import Counter

    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    one, context, two = Counter(), Counter(), Counter()
    for x in words.values():
        for v, w in zip(["<s>", *x], x):  # noqa: B905
            one[w] += 1
            context[v] += 1
            two[v, w] += 1
    total = sum(one.values())
    out = {}
    for i, x in words.items():
        s, seen = 0.0, 0
        for v, w in zip(["<s>", *x], x):  # noqa: B905
            if two[v, w] >= least:
                s, seen = s + math.log(two[v, w]) - math.log(context[v]), seen + 1
            else:
                s += math.log(backoff) + math.log(one[w]) - math.log(total)
        out[i] = (len(x), seen, s)
    return out


@pytest.mark.parametrize(("head", "size"), [(4, 300), (512, 200_000)])
def test_scores_equal_plain(spark, sf, odd, none, head, size):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_scores({r["doc_id"]: r["text"] for r in table.collect()})
    out = lm_scores.score_documents(table, dictionary_size=size, head=head, hot_share=0.001).collect()
    assert len(out) == len(want)
    for r in out:
        n, seen, s = want[r["doc_id"]]
        assert (r["n_words"], r["n_seen"]) == (n, seen) and r["log_score"] == pytest.approx(s, rel=1e-9)
    small = lm_scores.score_documents(odd, dictionary_size=size, head=head)
    assert small.count() == 7 and small.where("n_words = 0 and mean_log_score is null").count() == 3
    assert lm_scores.score_documents(none).count() == 0


# mixing


def test_mixture(spark, odd, none):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(n), s) for i, (s, n) in enumerate(zip(rng.choice(["a", "b", "c"], 3000, p=[0.9, 0.08, 0.02]), rng.integers(1, 40, 3000), strict=True))]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).assign(n=lambda d: d["text"].str.split().str.len())
    total = tokens["n"].sum()
    own = tokens.groupby("source")["n"].sum() / total
    for share, limit in ((0.9, None), (0.99, 3.0), (None, None)):
        out = mixing.mix_sources(table, entropy_share=share, max_repeats=limit, bucket_rows=100).toPandas()
        got = out.groupby("source")["n_tokens"].sum()
        w = got / got.sum()
        entropy = -(w * np.log(w)).sum() / np.log(3)
        repeats = (got / tokens.groupby("source")["n"].sum()).max()
        if share is None:
            assert np.allclose(w.sort_index(), own.sort_index(), atol=0.01)
        elif limit is None:
            assert abs(entropy - share) < 0.01
        else:
            assert repeats < limit + 0.1 and entropy > -(own * np.log(own)).sum() / np.log(3)
        assert abs(got.sum() - total) < 40 * 4
        # an epoch is a permutation: no document twice in one, and none in the next before the last is used up
        assert not out.duplicated(["doc_id", "epoch"]).any()
        for s, part in out.groupby("source"):
            full = set(tokens[tokens["source"] == s]["doc_id"])
            last = part["epoch"].max()
            assert all(set(part[part["epoch"] == e]["doc_id"]) == full for e in range(last))
            assert part.sort_values("position")["epoch"].is_monotonic_increasing
    one = mixing.mix_sources(odd)
    assert one.where("doc_id = 5").count() >= 2 and mixing.mix_sources(none).count() == 0
    assert one.where("source is null").count() >= 2


# pipeline


def test_pipeline_stages(spark, sf, odd, none):
    pipeline = pytest.importorskip("corpus_pipeline")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    data = table
    for name, stage in pipeline.STAGES:
        before = data
        data = stage(spark, data, sf).cache()
        if name != "mixing":
            assert data.columns == table.columns, name
        if name == "near_duplicates":
            near = simhash.near_duplicates(before).toPandas()
            assert sorted(r["doc_id"] for r in data.collect()) == sorted(near["component_id"].unique())
        if name == "decontamination":
            found = decontaminate.decontaminate(before, spark.read.parquet(f"{sf}/benchmark.parquet"))
            assert data.count() == found.where("not contaminated").count()
        if name == "pii":
            assert data.count() == before.count() and not any(pii.base_spans(r["text"]) for r in data.collect())
    assert data.count() > 0
    for rows in (odd.select(*table.columns), none.select(*table.columns)):
        for _, stage in pipeline.STAGES:
            rows = Workspace(spark, "test").save(stage(spark, rows, sf), "stage")
        assert rows.count() >= 0
