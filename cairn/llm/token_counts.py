"""Token counts through a cache keyed by content digest and tokenizer version."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Workspace, exists

CACHE = "digest binary, tokenizer string, n_tokens long"
#: Words whose counts a worker remembers (about 60 MB); beyond it words are encoded each time they come.
WORDS_KEPT = 400_000


@lru_cache(maxsize=4)
def _load(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: a changed file never reads counts of the old one."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def squeeze(text: Column) -> Column:
    """Runs of blanks, tabs and line ends to one blank, ends trimmed: for tokenizers that drop white space."""
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    drops_space: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Content is normalised and digested (SHA-256); digests that ``cache`` (a Parquet folder) lacks for this tokenizer
    file are encoded once each, however many rows carry them, and appended to it. ``drops_space`` says that the
    tokenizer drops white space and never joins what it separates (word_bpe): then white space is squeezed before
    digesting, and a text is counted word by word, with frequent words remembered; the sums are the library's own
    counts. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows come out as often as they went in; an empty
    table gives no rows; other columns are ignored. Texts are whole, without truncation.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = squeeze(text) if drops_space else text
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))

    def encode(batches):
        count, kept = _load(tokenizer), {}
        for b in batches:
            if not drops_space:
                yield pd.DataFrame({"digest": b["digest"], "tokenizer": version, "n_tokens": count(b["content"].tolist())})
                continue
            totals = []
            for words in (t.split(" ") for t in b["content"]):
                new = [w for w in dict.fromkeys(words) if w not in kept]
                fresh = dict(zip(new, count(new), strict=True)) if new else {}
                if len(kept) + len(fresh) <= WORDS_KEPT:
                    kept.update(fresh)
                    totals.append(sum(map(kept.__getitem__, words)))
                else:
                    totals.append(sum(kept[w] if w in kept else fresh[w] for w in words))
            yield pd.DataFrame({"digest": b["digest"], "tokenizer": version, "n_tokens": totals})

    misses = rows.select("digest", "content")
    if exists(spark, cache):
        known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
        misses = misses.join(known, "digest", "left_anti")
    misses.dropDuplicates(["digest"]).mapInPandas(encode, CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).dropDuplicates(["digest"])
    # written, so that a join on a digest that very many rows carry can be split
    counts = Workspace(spark, "token-counts").save(counts.select("digest", "n_tokens"), "counts")
    out = rows.drop("content").join(counts, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
