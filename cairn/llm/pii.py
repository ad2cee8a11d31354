"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Workspace

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match of the four groups can only begin where a run of digits does, as the run must end at the first full stop.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier: a token with an at sign, or with five digits and nothing but digits and joining marks.
CANDIDATE = re.compile(r"\+?\(?[0-9][0-9().:\-]{4,}")
AROUND = re.compile(r"[^\s@]*+")
#: Digit groups joined by single blanks, brackets, full stops or hyphens; no part of a longer number or of a time.
GROUPED = re.compile(r"(?<![0-9:.])(?:\+|(?<!\+))(?:1[\x20.-](?=\(?[0-9]{3}[)\x20.-]))?(?:\([0-9]{2,5}\)\x20?[0-9]{5,8}|\(?[0-9]{2,8}\)?(?:(?:[\x20.\-]|(?<=\)))\(?[0-9]{2,8}\)?)+)(?![0-9:])")
#: A token of so many digits is a whole identifier, to which blanks join nothing.
WHOLE = 10
WORD = re.compile(r"\S+")
SPAN = "array<struct<kind:int,start:int,stop:int>>"
#: Characters of context on either side in which neighbouring words are looked for.
REACH = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of an address, each at sign looked at once.

    What stands before the sign is all of its run of permitted characters that no earlier match has taken; whether the
    host that follows fits does not depend on where the run begins.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind. Leftmost non-overlapping per kind; failing matches are dropped."""
    if not text:
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    if not re.search("[0-9]", text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _fits(kind: int, value: str) -> bool:
    """Whether a token's form could be of the kind at all."""
    digits = sum(c in "0123456789" for c in value)
    if kind == 0:
        return "@" in value
    if "@" in value:
        return False
    return (kind == 1 and value.count(".") == 3 and digits >= 4) or (kind == 2 and 13 <= digits <= 19) or (kind == 3 and 7 <= digits <= 15)


class _Taken:
    """Disjoint stretches of a text, kept in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a


def _marked(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with an at sign, each run without blanks looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = AROUND.match(text, at + 1).end()
        if start < at and at + 1 < end:
            yield start, end
        done = end if start < at and at + 1 < end else at + 1
        at = text.find("@", done)


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what may be an identifier and overlaps no base span; digit groups written apart are one.

    Tokens with an at sign come before those of digits, and groups before both: what overlaps one taken is none.
    """
    out: list[tuple[int, int]] = []
    if not ("@" in text or re.search("[0-9]", text)):
        return out
    taken = _Taken([(a, b) for _, a, b in base])
    for m in GROUPED.finditer(text):
        a, b, value = m.start(), m.end(), m.group()
        parts = [sum(c in "0123456789" for c in t) for t in value.split(" ")]
        if len(parts) > 1 and max(parts) < WHOLE and 7 <= sum(parts) <= 19 and not taken.meets(a, b):
            out.append((a, b))
    for tokens in (_marked(text), (m.span() for m in CANDIDATE.finditer(text))):
        before = _Taken(out)
        for a, b in tokens:
            b = a + len(text[a:b].rstrip(".,:;!?)(-\"'"))
            if a < b and not taken.meets(a, b) and not before.meets(a, b):
                out.append((a, b))
    return out


def _mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """Base spans, and free candidates, with the lexical patterns that surround them.

    A pattern is two words before, or one before and one after, or two after, lower-cased, at most 40 characters a
    word. A free candidate overlaps no base span; its kinds are those that its form fits, none excluded by guess.
    """
    found = [(k, a, b) for k, a, b in base]
    found += [(-1, a, b) for a, b in _candidates(text, base)]
    out = []
    for kind, a, b in found:
        before = [w[-40:].lower() for w in WORD.findall(text[max(0, a - REACH) : a])[-2:]]
        after = [w[:40].lower() for w in WORD.findall(text[b : b + REACH])[:2]]
        patterns = ["< " + " ".join(before)] if len(before) == 2 else []
        patterns += [f"{before[-1]} <> {after[0]}"] if before and after else []
        patterns += ["> " + " ".join(after)] if len(after) == 2 else []
        value = text[a:b]
        kinds = [kind] if kind >= 0 else [k for k in range(len(KINDS)) if _fits(k, value)]
        if patterns and kinds:
            out.append((kind >= 0, kinds, a, b, value.lower(), patterns))
    return out


def _scan(docs: DataFrame, id_col: str, text_col: str, work: Workspace) -> DataFrame:
    """Per row: doc_id, key (a digest of the text), base spans and mentions; written once."""

    mention = "array<struct<seed:boolean,kinds:array<int>,start:int,stop:int,value:string,patterns:array<string>>>"

    @F.pandas_udf(f"base {SPAN}, mentions {mention}")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            base = [base_spans(t) for t in texts]
            yield pd.DataFrame({"base": base, "mentions": [_mentions(t, s) if t else [] for t, s in zip(texts, base, strict=True)]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), scan(F.col(text_col)).alias("found"))
    return work.save(rows.select("doc_id", "key", "found.base", "found.mentions"), "scanned")


def bootstrap(scanned: DataFrame, work: Workspace, rounds: int = 3, confident: float = 0.75, least_seeds: int = 3) -> DataFrame:
    """(kind, pattern) pairs of high confidence, scored on the graph of patterns and instances.

    Instances are distinct lower-cased values. A seed's score is 1 for its kind and 0 for others. In each round a
    pattern's confidence for a kind is the mean score of its instances for that kind, where two unscored ones are
    added as a prior; an unseen instance then gets the noisy-or of its patterns' confidences, halved so that it never
    counts as a seed. Patterns need ``least_seeds`` distinct seeds of the kind. All counts cover all documents.
    """
    m = scanned.select(F.explode("mentions").alias("m")).select("m.*")
    graph = m.select("seed", F.explode("kinds").alias("kind"), "value", "patterns").select("seed", "kind", "value", F.explode("patterns").alias("pattern"))
    graph = graph.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    # every instance of a pattern counts against each kind that the pattern has seeds of
    seeds = graph.where("seed").groupBy("kind", "pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least_seeds)
    seeds = work.save(seeds, "seeded")
    values = graph.groupBy("pattern", "value").agg(F.collect_set(F.when(F.col("seed"), F.col("kind"))).alias("seed_kinds"))
    edges = seeds.join(values, "pattern").select("kind", "pattern", "value", "seeds", F.array_contains("seed_kinds", F.col("kind")).alias("seed"), (F.size("seed_kinds") > 0).alias("known"))
    edges = work.save(edges, "edges")
    score = F.when(F.col("seed"), 1.0).when(F.col("known"), 0.0)
    edges = edges.withColumn("fixed", score)
    guess = None
    for k in range(rounds):
        now = edges.withColumn("score", F.coalesce("fixed", F.lit(0.0)))
        if guess is not None:
            now = edges.join(guess, ["kind", "value"], "left").withColumn("score", F.coalesce("fixed", "guess", F.lit(0.0)))
        scored = now.groupBy("kind", "pattern").agg((F.sum("score") / (F.count("*") + 2)).alias("confidence"), F.max("seeds").alias("seeds"))
        scored = work.save(scored, f"patterns-{k}")
        open_ = edges.where("not known").join(scored, ["kind", "pattern"])
        miss = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
        guess = open_.groupBy("kind", "value").agg(((1 - miss) / 2).alias("guess"))
    return scored.where(F.col("confidence") >= confident).select("kind", "pattern", "confidence")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, confident: float = 0.75, least_seeds: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (xxhash64 of the text), base and added spans (kind, start, stop).

    Added spans are candidates of fitting form next to a high-confidence pattern; they overlap no base span. Where
    patterns of several kinds fit one, the kind of the highest confidence wins, ties going to the kind listed first.
    The method's window is ``REACH`` characters on either side, 40 a word. Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows come out as often as they went
    in; an empty table gives no rows; other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "pii")
    scanned = _scan(docs, id_col, text_col, work)
    accepted = bootstrap(scanned, work, rounds, confident, least_seeds)
    m = scanned.select("doc_id", "key", F.explode("mentions").alias("m")).where("not m.seed")
    m = m.select("doc_id", "key", "m.start", "m.stop", F.explode("m.kinds").alias("kind"), "m.patterns")
    m = m.select("doc_id", "key", "kind", "start", "stop", F.explode("patterns").alias("pattern"))
    hit = m.join(accepted, ["kind", "pattern"]).groupBy("doc_id", "key", "start", "stop").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    added = hit.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "stop"))).alias("added"))
    added = work.save(added, "added")
    rows = scanned.select("doc_id", "key", "base")
    same = rows.doc_id.eqNullSafe(added.doc_id) & (rows.key == added.key)
    return rows.join(added, same, "left").select(rows.doc_id, rows.key, "base", F.coalesce("added", F.expr(f"cast(array() as {SPAN})")).alias("added"))


def _listed(spans, name):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), name("kind") + 1)
    return F.concat_ws(":", kind, name("start").cast("string"), name("stop").cast("string"))


def describe(spans: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans, as lists kind:start:end."""
    ordered = lambda c: F.array_join(F.transform(F.sort_array(F.transform(c, lambda s: F.struct(s["start"], s["kind"], s["stop"]))), lambda s: _listed(c, lambda f: s[f])), ",")
    def count(k: int):  # a second parameter of the inner function would be the position
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(ordered(F.col("base")), 256).alias("base_sha256"), ordered(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every base and added span replaced by its kind in square brackets; other columns unchanged.

    Spans that overlap are replaced as one, under the kind of the first.
    """
    spans = find_spans(docs, id_col, text_col, **options).where("size(base) + size(added) > 0")
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.concat("base", "added").alias("__spans")).dropDuplicates(["__id", "__key"])
    joined = docs.join(spans, docs[id_col].eqNullSafe(spans["__id"]) & (F.xxhash64(docs[text_col]) == spans["__key"]), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, spans, strict=True):
            if t is not None and found is not None and len(found):
                parts, at = [], 0
                for kind, start, stop in sorted(((s["kind"], s["start"], s["stop"]) for s in found), key=lambda s: (s[1], s[0])):
                    if start >= at:
                        parts += [t[at:start], f"[{KINDS[kind].upper()}]"]
                    at = max(at, stop)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    # texts without spans stay in the JVM
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut(F.when(F.col("__spans").isNotNull(), F.col(text_col)), F.col("__spans")))
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
