"""Source text to tables: structure, calls, imports, chunks and dependencies of ``files`` (path, content)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import basename, detect_language, dirname, is_manifest

# How each language names classes, functions and imports; a pattern's first group is the name.
STRUCTURE = {
    "python": {"class": r"^\s*class\s+(\w+)", "function": r"^\s*(?:async\s+)?def\s+(\w+)", "import": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"},
    "javascript": {"class": r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", "function": r"^\s*(?:export\s+)?(?:async\s+)?(?:function\s+)?(\w+)\s*[=\(]", "import": r"import\s+(?:.*\s+from\s+)?['\"]([^'\"]+)['\"]|require\s*\(['\"]([^'\"]+)['\"]"},
    "typescript": {"class": r"^\s*(?:export\s+)?(?:abstract\s+)?(?:public\s+)?class\s+(\w+)", "function": r"^\s*(?:export\s+)?(?:async\s+)?(?:function\s+)?(\w+)\s*[<\(:]", "import": r"import\s+(?:.*\s+from\s+)?['\"]([^'\"]+)['\"]"},
    "java": {"class": r"^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+)?(?:final\s+)?class\s+(\w+)", "function": r"^\s*(?:public\s+|private\s+|protected\s+)?(?:static\s+)?(?:[\w<>\[\]]+\s+)?(\w+)\s*\(", "import": r"import\s+(?:static\s+)?([\w.]+)"},
    "cpp": {"class": r"^\s*(?:class|struct)\s+(\w+)", "function": r"^\s*(?:[\w:<>\[\]]+\s+)?(\w+)\s*\(", "import": r"#include\s*[<\"]([^>\"]+)[>\"]"},
    "go": {"class": r"^\s*type\s+(\w+)", "function": r"^\s*func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", "import": r"import\s+['\"]([^'\"]+)['\"]"},
    "rust": {"class": r"^\s*(?:pub\s+)?struct\s+(\w+)", "function": r"^\s*(?:pub\s+)?fn\s+(\w+)\s*\(", "import": r"use\s+([\w:]+)"},
    "ruby": {"class": r"^\s*(?:class|module)\s+(\w+)", "function": r"^\s*def\s+(?:self\.)?(\w+)", "import": r"require\s+['\"]([^'\"]+)['\"]"},
}
NO_FUNCTION = ["if", "for", "while", "switch", "catch", "return", "else", "elif", "with", "print", "and", "or", "not", "in", "new", "await", "function", "class", "import", "from"]
NO_CALL = [*NO_FUNCTION, "def", "super", "len", "range", "self"]


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_no, line), numbered from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def _first(line: Column, pattern: str) -> Column:
    one = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    return F.coalesce(one, F.nullif(F.regexp_extract(line, pattern, 2), F.lit(""))) if pattern.count("(") - pattern.count("(?:") - pattern.count(r"\(") > 1 else one


def _pick(kind: str) -> Column:
    out = F.lit(None).cast("string")
    for language, patterns in STRUCTURE.items():
        also = F.col("language") == language if language != "javascript" else F.col("language").isin("javascript", "jsx")
        also = also if language != "typescript" else F.col("language").isin("typescript", "tsx")
        also = also if language != "cpp" else F.col("language").isin("cpp", "c")
        out = F.when(also, _first(F.col("line"), patterns[kind])).otherwise(out)
    return out


def extract_symbols(files: DataFrame) -> DataFrame:
    """(path, id, name, type, scope, start_line, end_line, indent) of classes and functions, found line by line.

    A function belongs to the class above it that is indented less, if any. A symbol ends before the next one at the
    same or a lower indent that follows it, else with its file.
    """
    split = F.split("content", "\n")
    lines = files.select("path", F.size(split).alias("last_line"), F.posexplode(split).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).withColumn("language", detect_language(F.col("path")))
    found = lines.withColumns({"class": _pick("class"), "function": _pick("function"), "indent": F.length(F.regexp_extract("line", r"^(\s*)", 1))})
    found = found.withColumn("function", F.when(~F.col("function").isin(*NO_FUNCTION), F.col("function")))
    s = found.where("class is not null or function is not null").select("path", "last_line", "line_no", "indent", F.coalesce("class", "function").alias("name"), F.when(F.col("class").isNotNull(), "class").otherwise("function").alias("type"))
    w = Window.partitionBy("path").orderBy("line_no")
    above = F.last(F.when(F.col("type") == "class", F.struct("name", "indent")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("c", above)
    scope = F.when((F.col("type") == "function") & (F.col("c.indent") < F.col("indent")), F.concat("path", F.lit("::"), "c.name")).otherwise(F.col("path"))
    # a file's symbols as one row, each with the next one at the same or a lower indent
    listed = F.sort_array(F.collect_list(F.struct("line_no", "indent", "name", "type", "scope")))
    s = s.withColumn("scope", scope).groupBy("path").agg(listed.alias("s"), F.max("last_line").alias("last_line"))
    s = s.select("path", "last_line", F.explode(F.arrays_zip("s", F.pandas_udf(_next_outer, "array<int>")(F.col("s.line_no"), F.col("s.indent")).alias("nxt"))).alias("x")).select("path", "last_line", "x.s.*", "x.nxt")
    return s.select("path", F.concat("scope", F.lit("::"), "name").alias("id"), "name", "type", "scope", F.col("line_no").alias("start_line"), F.coalesce(F.col("nxt") - 1, "last_line").alias("end_line"), "indent")


def _next_outer(lines: pd.Series, indents: pd.Series) -> pd.Series:
    """For each of a file's symbols, the line of the next one at the same or a lower indent; null: none."""
    out = []
    for line, indent in zip(lines, indents, strict=True):
        found: list[int | None] = [None] * len(line)
        open_: list[int] = []
        for i, x in enumerate(indent):
            while open_ and indent[open_[-1]] >= x:
                found[open_.pop()] = int(line[i])
            open_.append(i)
        out.append(found)
    return pd.Series(out)


def structure_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst, relation): DEFINES for classes and CONTAINS for functions."""
    return symbols.select(F.col("scope").alias("src"), F.col("id").alias("dst"), F.when(F.col("type") == "class", "DEFINES").otherwise("CONTAINS").alias("relation")).distinct()


def extract_imports(files: DataFrame) -> DataFrame:
    """(path, module, relation): IMPORTS; MAYBE_IMPORTS for wildcards, MAYBE_DEPENDS for importlib calls."""
    lines = lines_of(files).withColumn("language", detect_language(F.col("path")))
    star = F.col("line").rlike(r"^\s*from\s+[\w.]+\s+import\s+\*")
    dynamic = F.nullif(F.regexp_extract("line", r"importlib\.import_module\(\s*['\"]([^'\"]+)['\"]", 1), F.lit(""))
    both = F.array(F.struct(_pick("import").alias("module"), F.when(star, "MAYBE_IMPORTS").otherwise("IMPORTS").alias("relation")), F.struct(dynamic.alias("module"), F.lit("MAYBE_DEPENDS").alias("relation")))
    return lines.select("path", F.explode(both).alias("x")).select("path", "x.*").where("module is not null").distinct()


def call_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst): calls inside a function's lines of functions of the same file; ``self.x`` prefers the same class.

    Both sides are lines of texts, which Spark takes for smaller than they are, so they are merged, never broadcast.
    """
    f = symbols.where("type = 'function'").select("path", F.col("id").alias("src"), F.col("scope").alias("src_scope"), "start_line", "end_line")
    calls = lines_of(files).select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"((?:self\.)?\w+)\s*\("), F.lit(1))).alias("call"))
    calls = calls.select("path", "line_no", F.startswith("call", F.lit("self.")).alias("own"), F.regexp_replace("call", r"^self\.", "").alias("name")).where(~F.col("name").isin(*NO_CALL))
    t = symbols.where("type = 'function'").select("path", "name", F.col("id").alias("dst"), F.col("scope").alias("dst_scope"))
    rows = calls.join(t.hint("merge"), ["path", "name"]).join(f.hint("merge"), "path").where(F.col("line_no").between(F.col("start_line") + 1, F.col("end_line")) & (F.col("src") != F.col("dst")))
    rows = rows.withColumn("same", F.col("own") & (F.col("src_scope") == F.col("dst_scope")))
    best = F.max("same").over(Window.partitionBy("path", "line_no", "name", "src"))
    return rows.withColumn("best", best).where("not best or same").select("src", "dst").distinct()


def config_aliases(files: DataFrame) -> DataFrame:
    """(repo, alias, target): import prefixes that configuration files at the top of a repository stand for.

    From files (repo, path, content): the first target of each of ``compilerOptions.paths`` of tsconfig.json or
    jsconfig.json, wildcards cut, and the module of go.mod, which is the top. Targets are relative to the top; a
    configuration that does not parse gives none. Of several targets of an alias the smallest counts.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"/?\*$", ""), r"^\./", "")
    paths = F.from_json(F.get_json_object("content", "$.compilerOptions.paths"), "map<string,array<string>>")
    ts = files.where(F.col("path").isin("tsconfig.json", "jsconfig.json")).select("repo", F.explode(paths).alias("alias", "targets"))
    ts = ts.select("repo", plain(F.col("alias")).alias("alias"), plain(F.get("targets", F.lit(0))).alias("target"))
    go = files.where("path = 'go.mod'").select("repo", F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("alias"), F.lit("").alias("target"))
    every = ts.unionByName(go).where("alias <> '' and target is not null")
    return every.groupBy("repo", "alias").agg(F.min("target").alias("target"))


def _normal(steps: Column) -> Column:
    """Path parts without ``.`` and with each ``..`` taking the part before it; what leaves the top keeps its ``..``."""
    none = F.array().cast("array<string>")
    last = lambda acc: F.element_at(F.concat(F.array(F.lit("")), acc), -1)
    return F.aggregate(
        steps,
        none,
        lambda acc, p: F.when((p == ".") | (p == ""), acc).when((p == "..") & (F.size(acc) > 0) & (last(acc) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: tuple[tuple[str, str], ...] = (("@/", "src/"),), alias_table: DataFrame | None = None, fallback: bool = False) -> DataFrame:
    """(path, module, relation, target): the first candidate that is a file: alias, relative, dotted; with extension or index.

    With a column ``repo``, in ``imports``, ``files`` and the ``alias_table`` (repo, alias, target; see
    ``config_aliases``), each repository is resolved by itself; of its aliases that a module begins with the longest
    counts, and before them those of ``aliases``, which hold everywhere. A relative module goes up one folder for each
    ``../``; where it leaves the tree it is not resolved. With ``fallback``, a module that is no file gets the path that
    its language would give it: dots as folders and ``.py`` or ``.java``, and for JavaScript and TypeScript its own
    path, seen from the file if it is relative, and ``.js``.
    """
    m, folder = F.col("module"), dirname(F.col("path"))
    own = ["repo"] if "repo" in imports.columns else []
    rows = imports.select(*own, "path", "module", "relation")
    base = F.when(F.lit(False), m)
    for alias, to in aliases:
        base = base.when(F.startswith(m, F.lit(alias)), F.concat(F.lit(to), F.substring(m, len(alias) + 1, 1 << 30)))
    if alias_table is not None:
        heads = rows.select("repo", "module").distinct().select("repo", "module", F.explode(F.transform(F.sequence(F.lit(1), F.length(m)), lambda n: F.substring(m, F.lit(1), n))).alias("alias"))
        longest = heads.join(alias_table, ["repo", "alias"]).groupBy("repo", "module").agg(F.max_by(F.struct("alias", "target"), F.length("alias")).alias("__alias"))
        rows = rows.join(longest, ["repo", "module"], "left")
        named = F.concat_ws("/", F.nullif("__alias.target", F.lit("")), F.nullif(F.ltrim(F.substring(m, F.length("__alias.alias") + 1, F.lit(1 << 30)), F.lit("/")), F.lit("")))
        base = base.when(F.col("__alias").isNotNull(), F.array_join(_normal(F.split(named, "/")), "/"))
    relative = F.startswith(m, F.lit("./")) | F.startswith(m, F.lit("../"))
    steps = F.concat(F.filter(F.split(folder, "/"), lambda p: p != ""), F.split(m, "/"))
    base = base.when(relative, F.array_join(_normal(steps), "/"))
    base = base.otherwise(F.when(F.contains(m, F.lit("/")), m).otherwise(F.replace(m, F.lit("."), F.lit("/"))))
    ends = ["", ".py", ".ts", ".tsx", ".js", ".jsx", ".go", "/__init__.py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    rows = rows.select(*own, "path", "module", "relation", base.alias("base"))
    # a file is found under each base that it ends, by the first of the endings that lead to it
    t = F.col("target")
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("nth"), F.when(F.endswith(t, F.lit(e)), F.substring(t, F.lit(1), F.length(t) - len(e))).alias("base")) for n, e in enumerate(ends)]), lambda x: x["base"].isNotNull())
    known = files.select(*own, F.col("path").alias("target")).select(*own, "target", F.explode(found).alias("x")).select(*own, "target", "x.*")
    known = known.groupBy(*own, "base").agg(F.min(F.struct("nth", "target")).alias("m")).select(*own, "base", "m.target")
    hit = rows.join(known.hint("merge"), [*own, "base"]).select(*own, "path", "module", "relation", "target").distinct()
    if not fallback:
        return hit
    language = detect_language(F.col("path"))
    dots = F.replace(m, F.lit("."), F.lit("/"))
    guess = F.when(language == "python", F.concat(dots, F.lit(".py"))).when(language == "java", F.concat(dots, F.lit(".java")))
    guess = guess.when(language.isin("javascript", "jsx", "typescript", "tsx"), F.concat(F.when(relative, F.col("base")).otherwise(m), F.lit(".js")))
    left = rows.join(hit.select(*own, "path", "module", "relation"), [*own, "path", "module", "relation"], "left_anti")
    return hit.unionByName(left.select(*own, "path", "module", "relation", guess.alias("target")).where("target is not null").distinct())


def test_covers(files: DataFrame) -> DataFrame:
    """(src, dst): ``test_x`` and ``x_test`` files to the files named x with the same ending; many files may have a name."""
    name = basename(F.col("path"))
    tested = F.when(name.rlike(r"^test_"), F.regexp_replace(name, "^test_", "")).when(name.rlike(r"_test\.\w+$"), F.regexp_replace(name, r"_test(\.\w+)$", "$1"))
    t = files.select(F.col("path").alias("src"), tested.alias("name")).where("name is not null")
    return t.join(files.select(F.col("path").alias("dst"), name.alias("name")), "name").select("src", "dst")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ")) -> list[str]:
    """Windows of at most ``size`` characters that end at the last separator past their first third, where there is one."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = next((c + len(s) for s in separators if (c := text.rfind(s, at + size // 3, end)) >= 0), end)
            end = cut
        out.append(text[at:end])
        if end >= len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def _windows(size: int, overlap: int, separators: tuple[str, ...]):
    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in texts:
            yield pd.Series([split_text(t or "", size, overlap, separators) for t in b])

    return cut


def heading_windows(path: str, title: str, body: str, size: int, overlap: int) -> list[tuple[str, str]]:
    """(title with part, chunk) of a section: windows that with their header have at most ``size`` characters.

    A window ends after its last line end past a third of ``size``, if it has one there; the next one begins
    ``overlap`` characters before its end. All but a lone window say which part they are.
    """
    header = f"File: {path}\nDoc: {title}\n"
    out: list[tuple[str, str]] = []
    start, room = 0, max(1, size - len(header))
    while start < len(body):
        end = start + room
        if end < len(body) and (line := body.rfind("\n", start, end)) > start + size // 3:
            end = line + 1
        piece = body[start:end].strip()
        if piece:
            part = len(out) + 1
            suffix = f" (part {part})" if part > 1 or end < len(body) else ""
            out.append((title + suffix, f"{header}{suffix}\n{piece}"))
        if end >= len(body):
            break
        start = max(start + 1, end - overlap)
    return out


#: Sections whose chunks leave a task at once.
SECTIONS = 64


def chunk_markdown(docs: DataFrame, max_chars: int = 2000, overlap: float = 0.5) -> DataFrame:
    """(path, section, part, heading, content): a document's sections by heading, each cut in windows that overlap.

    A section begins with a heading of one to six ``#``; what stands before the first one is the Introduction. Chunks
    begin with their file and heading; ``overlap`` is a share of ``max_chars``. Sections of white space give none.
    """
    lines = docs.select("path", F.posexplode(F.split("content", "\r\n|[\n\r]")).alias("line_no", "line"))
    head = F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("h", head).withColumn("section", F.sum(F.when(F.col("h") != "", 1).otherwise(0)).over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    sections = rows.groupBy("path", "section").agg(F.max("h").alias("heading"), text.alias("content"))
    title = F.when(F.col("section") == 0, "Introduction").otherwise(F.col("heading"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, SECTIONS):  # chunks hold a text about twice, so they leave a few texts at a time
                rows = b.slice(start, SECTIONS).to_pylist()
                out = [(r["path"], r["section"], part, h, c) for r in rows for part, (h, c) in enumerate(heading_windows(r["path"], r["title"], r["content"].strip(), max_chars, int(max_chars * overlap)))]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["path", "section", "part", "heading", "content"])

    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    return sections.select("path", "section", title.alias("title"), "content").mapInArrow(cut, "path string, section long, part int, heading string, content string")


def chunk_code(files: DataFrame, symbols: DataFrame, max_chars: int = 2000, overlap: int = 150) -> DataFrame:
    """(path, symbol_id, chunk_type, part, content): a chunk a symbol with a header, and module chunks of the other lines.

    Lines and symbols are merged, as Spark takes lines of texts for smaller than they are and would broadcast them.
    """
    lines = lines_of(files)
    s = symbols.select(F.col("path").alias("of"), "id", "name", "type", "start_line", "end_line")
    inside = lines.join(s.hint("merge"), (F.col("path") == F.col("of")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    join = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    own = inside.groupBy("path", "id", "name", "type").agg(join.alias("body"))
    header = F.concat(F.lit("File: "), "path", F.lit("\n"), F.initcap("type"), F.lit(": "), "name", F.lit("\n"))
    own = own.select("path", F.col("id").alias("symbol_id"), F.col("type").alias("chunk_type"), F.concat(header, "body").alias("content"))
    free = lines.join(inside.select("path", "line_no").distinct().hint("merge"), ["path", "line_no"], "left_anti").groupBy("path").agg(join.alias("body")).where(F.length(F.trim("body")) > 20)
    free = free.select("path", F.lit(None).cast("string").alias("symbol_id"), F.lit("module").alias("chunk_type"), F.concat(F.lit("File: "), "path", F.lit("\n"), "body").alias("content"))
    every = own.unionByName(free)
    cut = _windows(max_chars, overlap, ("\n",))
    small = every.where(F.length("content") <= max_chars).withColumn("part", F.lit(0))
    large = every.where(F.length("content") > max_chars).select("path", "symbol_id", "chunk_type", F.posexplode(cut("content")).alias("part", "content"))
    return small.select("path", "symbol_id", "chunk_type", "part", "content").unionByName(large)


def chunk_plain(files: DataFrame, kind: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(path, symbol_id, chunk_type, part, content): header and body, cut at blank lines, lines or blanks."""
    head = "Manifest: " if kind == "manifest" else "File: "
    text = F.concat(F.lit(head), "path", F.lit("\n"), "content")
    cut = _windows(size, overlap, ("\n\n", "\n", " "))
    rows = files.where(F.trim("content") != "").select("path", F.posexplode(cut(text)).alias("part", "content"))
    return rows.select("path", F.lit(None).cast("string").alias("symbol_id"), F.lit(kind).alias("chunk_type"), "part", "content")


# Where to cut source text, the widest structure first; what follows for all languages.
SEPARATORS = {
    "python": ["\nclass ", "\ndef ", "\n\tdef "],
    "javascript": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault "],
    "typescript": ["\nenum ", "\ninterface ", "\nnamespace ", "\ntype ", "\nclass ", "\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault "],
    "java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase "],
    "cpp": ["\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase "],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase "],
    "rust": ["\nfn ", "\nconst ", "\nlet ", "\nif ", "\nwhile ", "\nfor ", "\nloop ", "\nmatch "],
    "ruby": ["\ndef ", "\nclass ", "\nif ", "\nunless ", "\nwhile ", "\nfor ", "\ndo ", "\nbegin ", "\nrescue "],
}
LAST_SEPARATORS = ["\n\n", "\n", " ", ""]
#: Languages that are cut as another one.
CUT_AS = {"jsx": "javascript", "tsx": "typescript", "c": "cpp"}


def split_recursive(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Chunks of at most ``size`` characters: cut at the first separator that occurs, what is still too long at the next.

    A separator stays with what follows it. Neighbouring pieces are put together as long as they fit; a chunk begins
    with the last pieces of the one before it, of ``overlap`` characters at most. White space around chunks goes.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    if sep:
        first, *others = text.split(sep)
        pieces = [p for p in (first, *(sep + o for o in others)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    held: deque[str] = deque()
    total = 0

    def flush() -> None:
        chunk = "".join(held).strip()
        if chunk:
            out.append(chunk)

    for p in pieces:
        if len(p) >= size and rest:  # to be cut further; nothing runs on over it
            flush()
            held.clear()
            total = 0
            out += split_recursive(p, size, overlap, rest)
            continue
        if total + len(p) > size:
            flush()
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.popleft())
        held.append(p)
        total += len(p)
    flush()
    return out


def chunk_fallback(files: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(path, symbol_id, chunk_type, part, content): recursive cuts by the separators of each file's language.

    Each chunk is headed by its file, which does not count. Files of white space give none.
    """

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in batches:
            yield pd.Series([split_recursive(t, size, overlap, SEPARATORS.get(CUT_AS.get(x, x), []) + LAST_SEPARATORS) for t, x in zip(texts, languages, strict=True)])

    rows = files.where(F.trim("content") != "").select("path", F.posexplode(cut("content", detect_language(F.col("path")))).alias("part", "text"))
    return rows.select("path", F.lit(None).cast("string").alias("symbol_id"), F.lit("plain").alias("chunk_type"), "part", F.concat(F.lit("File: "), "path", F.lit("\n"), "text").alias("content"))


def chunk_all(files: DataFrame) -> DataFrame:
    """Manifests, markdown and code each by their own rule, everything that gave no chunk by the plain one."""
    kind = F.when(is_manifest(F.col("path")), "manifest").when(F.lower("path").rlike(r"\.(md|markdown|rst)$"), "markdown").when(detect_language(F.col("path")) != "unknown", "code").otherwise("plain")
    f = files.withColumn("kind", kind)
    manifest = chunk_plain(f.where("kind = 'manifest'"), "manifest", 2000, 150)
    marked = chunk_markdown(f.where("kind = 'markdown'")).select("path", F.lit(None).cast("string").alias("symbol_id"), F.lit("doc").alias("chunk_type"), "part", "content")
    source = f.where("kind = 'code'")
    symbols = extract_symbols(source)
    code = chunk_code(source, symbols)
    # code gives no chunk only where it has no symbol and at most twenty characters
    few = source.where(F.length(F.trim("content")) <= 20)
    tiny = few.join(extract_symbols(few).select("path").distinct().hint("merge"), "path", "left_anti")
    rest = f.where("kind = 'plain'").unionByName(tiny)
    return manifest.unionByName(marked).unionByName(code).unionByName(chunk_fallback(rest))


# dependencies of manifests: (path, node, relation, target)
def _deps(rows: DataFrame, prefix: str, names: Column) -> DataFrame:
    return rows.select("path", F.explode(F.transform(names, lambda n: F.concat(F.lit(f"[{prefix}]:"), n))).alias("node"))


def npm_dependencies(files: DataFrame) -> DataFrame:
    f = files.where(basename(F.col("path")) == "package.json")
    keys = [F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", f"$.{k}"), "map<string,string>")), F.expr("cast(array() as array<string>)")) for k in ("dependencies", "devDependencies", "peerDependencies")]
    return _deps(f, "npm", F.array_distinct(F.concat(*keys)))


def pip_dependencies(files: DataFrame) -> DataFrame:
    f = files.where(F.lower(basename(F.col("path"))).rlike(r"^requirements.*\.txt$"))
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^[#-]"))
    names = F.filter(F.transform(lines, lambda x: F.lower(F.regexp_extract(x, r"^([^>=<!;\[@ ~]+)", 1))), lambda x: x != "")
    return _deps(f, "pip", F.array_distinct(names))


def pyproject_dependencies(files: DataFrame) -> DataFrame:
    lines = lines_of(files.where(basename(F.col("path")) == "pyproject.toml"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.nullif(F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*$", 1), F.lit("")), ignorenulls=True).over(w)
    key = F.last(F.nullif(F.regexp_extract("line", r"^\s*([\w-]+)\s*=", 1), F.lit("")), ignorenulls=True).over(w)
    rows = lines.withColumns({"section": section, "key": key})
    poetry = rows.where(F.col("section").rlike(r"^tool\.poetry\.(.*\.)?(dev-)?dependencies$")).select("path", F.regexp_extract("line", r"^\s*([\w.-]+)\s*=", 1).alias("name")).where("name not in ('', 'python')")
    listed = rows.where(((F.col("section") == "project") & (F.col("key") == "dependencies")) | (F.col("section") == "project.optional-dependencies"))
    listed = listed.select("path", F.explode(F.regexp_extract_all("line", F.lit("[\"']([A-Za-z0-9._-]+)[^\"']*[\"']"), F.lit(1))).alias("name"))
    return poetry.unionByName(listed).select("path", F.concat(F.lit("[pip]:"), F.lower("name")).alias("node")).distinct()


def go_dependencies(files: DataFrame) -> DataFrame:
    lines = lines_of(files.where(basename(F.col("path")) == "go.mod"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    flag = F.when(F.col("line").rlike(r"^\s*require\s*\("), 1).when(F.col("line").rlike(r"^\s*\)"), 0)
    inside = F.coalesce(F.last(flag, ignorenulls=True).over(w), F.lit(0))
    name = F.when(F.col("line").rlike(r"^\s*require\s+[^(\s]"), F.regexp_extract("line", r"^\s*require\s+(\S+)", 1)).when((F.col("inside") == 1) & ~F.col("line").rlike(r"^\s*(require|//)"), F.regexp_extract("line", r"^\s*(\S+)\s+v", 1))
    return lines.withColumn("inside", inside).select("path", name.alias("n")).where("n <> ''").select("path", F.concat(F.lit("[go]:"), "n").alias("node")).distinct()


def docker_dependencies(files: DataFrame) -> DataFrame:
    f = files.where(F.lower(basename(F.col("path"))).rlike(r"^dockerfile(\.\w+)?$"))
    images = F.filter(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?im)^\s*FROM\s+(?:--\S+\s+)?(\S+)"), F.lit(1))), lambda x: x != "scratch")
    return _deps(f, "docker", images)


def compose_dependencies(files: DataFrame) -> DataFrame:
    """Services and images of compose files; a service is a key two blanks in, below ``services:``."""
    lines = lines_of(files.where(F.lower(basename(F.col("path"))).rlike(r"^(docker-)?compose\.ya?ml$")))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.nullif(F.regexp_extract("line", r"^(\w[\w-]*):", 1), F.lit("")), ignorenulls=True).over(w)
    rows = lines.withColumn("top", top).where("top = 'services'")
    service = rows.select("path", F.regexp_extract("line", r"^  ([\w.-]+):\s*$", 1).alias("n")).where("n <> ''").select("path", F.concat(F.lit("[service]:"), "n").alias("node"))
    image = rows.select("path", F.regexp_extract("line", r"^\s+image:\s*[\"']?([^\s\"']+)", 1).alias("n")).where("n <> ''").select("path", F.concat(F.lit("[docker]:"), "n").alias("node"))
    return service.unionByName(image).distinct()


def prisma_models(files: DataFrame) -> DataFrame:
    """(path, node, target): models, and the models that their fields name (null: none)."""
    lines = lines_of(files.where(F.lower("path").endswith(".prisma")))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    model = F.last(F.when(F.col("line").rlike(r"^\s*model\s+\w+"), F.regexp_extract("line", r"^\s*model\s+(\w+)", 1)).when(F.col("line").rlike(r"^\s*}"), ""), ignorenulls=True).over(w)
    rows = lines.withColumn("model", model).where("model <> ''")
    names = rows.select("path", "model").distinct()
    fields = rows.select("path", "model", F.regexp_extract("line", r"^\s+\w+\s+(\w+)", 1).alias("t")).join(names.select("path", F.col("model").alias("t")), ["path", "t"], "left_semi")
    links = names.join(fields.where("t <> model").distinct(), ["path", "model"], "left")
    return links.select("path", F.concat(F.lit("[prisma]:"), "model").alias("node"), F.concat(F.lit("[prisma]:"), "t").alias("target"))


def terraform_resources(files: DataFrame) -> DataFrame:
    f = files.where(F.lower("path").rlike(r"\.tf$"))
    two = F.array_distinct(F.zip_with(*[F.regexp_extract_all("content", F.lit(r'(?m)^\s*resource\s+"(\w+)"\s+"([\w-]+)"'), F.lit(i)) for i in (1, 2)], lambda a, b: F.concat(a, F.lit("."), b)))
    return _deps(f, "tf", two)


def k8s_objects(files: DataFrame) -> DataFrame:
    """``[k8s]:namespace/Kind/name`` of the documents of a manifest, and ``[docker]:`` images."""
    f = files.where(F.lower("path").rlike(r"\.ya?ml$") & F.col("content").rlike(r"(?m)^kind:\s*\w"))
    d = f.select("path", F.explode(F.split("content", r"(?m)^---\s*$")).alias("d"))
    get = lambda p, default="": F.coalesce(F.nullif(F.regexp_extract("d", p, 1), F.lit("")), F.lit(default))
    kind, name, ns = get(r"(?m)^kind:\s*(\w+)"), get(r"(?m)^  name:\s*([\w.-]+)"), get(r"(?m)^  namespace:\s*([\w.-]+)", "default")
    objects = d.where((kind != "") & (name != "")).select("path", F.concat(F.lit("[k8s]:"), ns, F.lit("/"), kind, F.lit("/"), name).alias("node"))
    images = d.select("path", F.explode(F.regexp_extract_all("d", F.lit(r"(?m)^\s*-?\s*image:\s*[\"']?([^\s\"']+)"), F.lit(1))).alias("i")).select("path", F.concat(F.lit("[docker]:"), "i").alias("node"))
    return objects.unionByName(images).distinct()


def lock_dependencies(files: DataFrame) -> DataFrame:
    """(path, node): what the root package of a package-lock.json depends on."""
    f = files.where(basename(F.col("path")) == "package-lock.json")
    root = F.from_json(F.get_json_object("content", "$.packages"), "map<string,struct<dependencies:map<string,string>,devDependencies:map<string,string>>>")
    root = F.try_element_at(root, F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    return _deps(f, "npm", F.array_distinct(F.concat(*[F.coalesce(F.map_keys(root[k]), none) for k in ("dependencies", "devDependencies")])))


def compose_links(files: DataFrame) -> DataFrame:
    """(path, node, target): services that a compose file's service names below ``depends_on:``, as a list or as keys."""
    lines = lines_of(files.where(F.lower(basename(F.col("path"))).rlike(r"^(docker-)?compose\.ya?ml$")))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    got = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    top = F.last(got(r"^(\w[\w-]*):"), ignorenulls=True).over(w)
    service = F.last(F.when(F.col("line").rlike(r"^\w"), F.lit("")).otherwise(got(r"^  ([\w.-]+):\s*$")), ignorenulls=True).over(w)
    section = F.last(F.when(F.col("line").rlike(r"^  ([\w.-]+):\s*$"), F.lit("")).otherwise(got(r"^    ([\w.-]+):")), ignorenulls=True).over(w)
    rows = lines.withColumns({"top": top, "service": service, "section": section}).where("top = 'services' and service <> '' and section = 'depends_on'")
    inline = F.regexp_extract_all(F.regexp_extract("line", r"depends_on:\s*\[(.*)\]", 1), F.lit(r"([\w.-]+)"), F.lit(1))
    named = F.coalesce(got(r"^\s{6,}-\s*[\"']?([\w.-]+)"), got(r"^      ([\w.-]+):"))
    rows = rows.select("path", "service", F.explode(F.concat(inline, F.array_compact(F.array(named)))).alias("t"))
    return rows.select("path", F.concat(F.lit("[service]:"), "service").alias("node"), F.concat(F.lit("[service]:"), "t").alias("target")).distinct()


def dependency_edges(files: DataFrame) -> DataFrame:
    """(src, dst, relation): a manifest DEFINES services, models, resources and objects and DEPENDS_ON packages and images.

    Services depend on services, and models relate to models (RELATES_TO).
    """
    own = F.col("node").rlike(r"^\[(service|prisma|tf|k8s)\]")
    rows = dependencies(files).select(F.col("path").alias("src"), F.col("node").alias("dst"), F.when(own, "DEFINES").otherwise("DEPENDS_ON").alias("relation"))
    services = compose_links(files).select(F.col("node").alias("src"), F.col("target").alias("dst"), F.lit("DEPENDS_ON").alias("relation"))
    models = prisma_models(files).where("target is not null").select(F.col("node").alias("src"), F.col("target").alias("dst"), F.lit("RELATES_TO").alias("relation"))
    return rows.unionByName(services).unionByName(models).distinct()


def dependencies(files: DataFrame) -> DataFrame:
    """(path, node) over all kinds of manifests, each once."""
    parts = [npm_dependencies, lock_dependencies, pip_dependencies, pyproject_dependencies, go_dependencies, docker_dependencies, compose_dependencies, terraform_resources, k8s_objects]
    out = prisma_models(files).select("path", "node")
    for f in parts:
        out = out.unionByName(f(files))
    return out.distinct()


def http_call_edges(files: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(path, endpoint): URL literals in file text joined to endpoint paths, numbers and braces as one placeholder."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\?.*$", ""), r"/(\{[^/]*\}|\d+)(?=/|$)", "/*")
    urls = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\"'](?:https?://[^/\"']+)?(/[\w/{}.?=&-]+)[\"']"), F.lit(1)))).alias("url"))
    return urls.select("path", plain(F.col("url")).alias("key")).join(endpoints.select(F.col("path").alias("endpoint"), plain(F.col("path")).alias("key")), "key").select("path", "endpoint").distinct()
