"""Readers, writers and keyed merges of the code-base tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Stages:
    """Keeps steps of an iteration as tables in the folder that ``spark.checkpoint.dir`` names."""

    _local: dict[str, str] = {}

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            app = spark.sparkContext.applicationId
            base = self._local.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-")
            self._local[app] = base
        self.spark, self.base = spark, f"{base.rstrip('/')}/stages-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def close(self) -> None:
        """Frees what was written, once no DataFrame in use reads it."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


RELATIONS = {"IMPORTS": "DEPENDS_ON", "MAYBE_IMPORTS": "MAYBE_CALLS"}
# Folders that hold no source of one's own, and files known by their name.
IGNORED_DIRS = (
    ".git", "node_modules", "__pycache__", ".next", "dist", "build", "target", ".gradle", ".idea", ".vscode",
    ".pytest_cache", ".mypy_cache", "vendor", "venv", ".venv", "site-packages", "coverage", ".tox", ".terraform",
    "bower_components", "jspm_packages", ".cache", "out", ".output", ".nuxt", ".svelte-kit",
)
KEPT_HIDDEN_DIRS = (".github", ".circleci", ".gitlab")
SPECIAL_NAMES = (
    "Dockerfile", "build.sbt", "Makefile", "makefile", "GNUmakefile", "Jenkinsfile", "Vagrantfile", "Procfile", ".gitignore",
    ".gitattributes", ".dockerignore", ".editorconfig", "Gemfile", "go.sum", "go.mod", "schema.prisma", ".env.example",
)
# Extensions of text files.
EXTENSIONS = (
    ".py", ".pyw", ".pyi", ".pyx", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".java", ".kt", ".kts", ".scala",
    ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx", ".hh", ".cs", ".csx", ".go", ".rs", ".rb", ".rake", ".rbw",
    ".php", ".phtml", ".swift", ".m", ".mm", ".r", ".lua", ".pl", ".pm", ".t", ".sh", ".bash", ".zsh", ".fish",
    ".ksh", ".ps1", ".psm1", ".psd1", ".dart", ".elm", ".ex", ".exs", ".clj", ".cljs", ".hs", ".ml", ".mli", ".vim",
    ".lisp", ".cl", ".scm", ".rkt", ".jl", ".nim", ".cr", ".d", ".pas", ".p", ".pp", ".vb", ".vbs", ".v", ".sv",
    ".svh", ".html", ".htm", ".xhtml", ".css", ".scss", ".sass", ".less", ".styl", ".xml", ".xsl", ".xslt", ".vue",
    ".svelte", ".json", ".json5", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".mk", ".cmake",
    ".gradle", ".tf", ".hcl", ".tfvars", ".sql", ".graphql", ".gql", ".proto", ".md", ".markdown", ".mdown", ".mkdn",
    ".rst", ".txt", ".text", ".adoc", ".asciidoc", ".csv", ".tsv", ".env", ".lock",
)


def read_source_files(spark: SparkSession, path: str, extensions=EXTENSIONS, names=SPECIAL_NAMES, ignored=IGNORED_DIRS) -> DataFrame:
    """(path, content): text files below ``path`` by extension or name, outside ignored and hidden folders.

    Spark skips hidden folders; of these, ``KEPT_HIDDEN_DIRS`` at the top are read, too.
    """
    top = [f"{path.rstrip('/')}/{d}" for d in KEPT_HIDDEN_DIRS]
    at = [spark._jvm.org.apache.hadoop.fs.Path(d) for d in top]
    kept = [d for d, p in zip(top, at, strict=True) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([path, *kept])
    at = F.replace(F.regexp_replace("path", r"^\w+:/*", "/"), F.lit("\\"), F.lit("/"))
    root = path.split(":", 1)[-1].rstrip("/")
    root = "/" + root.lstrip("/")
    rows = rows.select(F.substring(at, len(root) + 2, 1 << 20).alias("path"), "content")
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(folders, lambda d: F.startswith(d, F.lit(".")) & ~d.isin(*KEPT_HIDDEN_DIRS))
    skipped = F.exists(folders, lambda d: d.isin(*ignored)) | hidden
    name = F.element_at(parts, -1)
    kept = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*extensions) | name.isin(*names) | name.rlike(r"^Dockerfile(\.\w+)?$")
    return rows.where(kept & ~skipped).select("path", F.decode("content", "UTF-8").alias("content"))


COMMIT_SCHEMA = "hash string, msg string, author string, date timestamp, files array<string>, branch string"


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Commit timeline from nested JSON lists, newest first."""
    return spark.read.schema(COMMIT_SCHEMA).option("multiLine", True).json(path).orderBy(F.desc("date"), "hash")


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], keep_old: tuple[str, ...] = (), empty_is_missing: tuple[str, ...] = ()) -> DataFrame:
    """Keyed merge: columns of ``batch`` overwrite, except that ``keep_old`` ones keep the old value where the new is
    null (or an empty string, for ``empty_is_missing``). A key that a batch repeats takes its greatest row."""
    values = [c for c in current.columns if c not in keys]
    newest = batch.groupBy(*keys).agg(F.max(F.struct(*values)).alias("__new"))
    old = current.select(*keys, F.struct(*values).alias("__old"))
    rows = old.join(newest, keys, "full_outer")

    def value(c: str):
        new, was = F.col(f"__new.{c}"), F.col(f"__old.{c}")
        if c in empty_is_missing:
            new = F.nullif(new, F.lit(""))
        kept = F.coalesce(new, was) if c in keep_old or c in empty_is_missing else new
        return F.when(F.col("__new").isNull(), was).otherwise(kept).alias(c)

    return rows.select(*keys, *map(value, values))


def upsert_edges(nodes: DataFrame, edges: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges and normalised ``batch`` edges whose two ends exist, each once."""
    relation = F.col("relation")
    for old, new in RELATIONS.items():
        relation = F.when(F.col("relation") == old, new).otherwise(relation)
    ids = nodes.select("id")
    new = batch.withColumn("relation", relation).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    columns = ["src", "dst", "relation"]
    return edges.select(*columns).unionByName(new.select(*columns)).distinct()


def wipe_tenant(table: DataFrame, tenant: str) -> DataFrame:
    return table.where(~F.col("tenant_id").eqNullSafe(tenant))


def write_by_tenant(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the tenants in ``df`` and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(path)


def set_repo_slug(nodes: DataFrame, slug: str) -> DataFrame:
    return nodes.withColumn("repo_full_name", F.when(F.col("type") == "file", F.lit(slug)).otherwise(F.col("repo_full_name")) if "repo_full_name" in nodes.columns else F.when(F.col("type") == "file", F.lit(slug)))


def clean_chunks(chunks: DataFrame, tenant: str, now) -> DataFrame:
    """Chunks as they are stored: without NUL characters, stamped with tenant and time."""
    return chunks.withColumns({"content": F.translate("content", "\u0000", ""), "tenant_id": F.lit(tenant), "created_at": now})


SCIP = "documents array<struct<relative_path:string,occurrences:array<struct<symbol:string,range:array<int>>>,symbols:array<struct<symbol:string,relationships:array<struct<symbol:string,type:string>>>>>>"


def read_symbol_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, relations) of a symbol-index JSON: (file, scip_symbol_id, name, line) and (src, dst, relation)."""
    docs = spark.read.schema(SCIP).option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")
    o = docs.select(F.col("relative_path").alias("file"), F.explode("occurrences").alias("o"))
    name = F.regexp_replace(F.element_at(F.split("o.symbol", "/"), -1), r"[.#()`]+$", "")
    symbols = o.where("o.symbol <> ''").select("file", F.col("o.symbol").alias("scip_symbol_id"), name.alias("name"), (F.col("o.range")[0] + 1).alias("line")).distinct()
    s = docs.select(F.explode("symbols").alias("s")).select("s.symbol", F.explode("s.relationships").alias("r"))
    relations = s.select(F.col("symbol").alias("src"), F.col("r.symbol").alias("dst"), F.upper(F.coalesce(F.nullif("r.type", F.lit("")), F.lit("REFERENCES"))).alias("relation"))
    return symbols, relations.distinct()


def merge_symbols(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds symbol nodes ``file::name``, merged with nodes of the same id, and the relations between them.

    A node keeps all its columns; its symbol id and first line become the symbol's.
    """
    new = symbols.groupBy(F.concat("file", F.lit("::"), "name").alias("id")).agg(F.min("name").alias("__name"), F.min("scip_symbol_id").alias("__scip"), F.min("line").alias("__line"))
    have = lambda c, kind: F.col(c) if c in nodes.columns else F.lit(None).cast(kind)
    own = {"name": F.coalesce(have("name", "string"), "__name"), "type": F.coalesce(have("type", "string"), F.lit("function")), "scip_symbol_id": F.coalesce("__scip", have("scip_symbol_id", "string")), "start_line": F.coalesce("__line", have("start_line", "int"))}
    merged = nodes.join(new, "id", "full_outer").withColumns(own).drop("__name", "__scip", "__line")
    ids = new.select("id", F.col("__scip").alias("scip"))
    links = relations.join(ids.select(F.col("scip").alias("src"), F.col("id").alias("a")), "src").join(ids.select(F.col("scip").alias("dst"), F.col("id").alias("b")), "dst")
    return merged, edges.select("src", "dst", "relation").unionByName(links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "relation")).distinct()


def append_telemetry(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def query_history(events: DataFrame, keep: int = 100) -> DataFrame:
    """Each tenant's newest ``keep`` queries (tenant_id, ts, query, answer), answers cut to 500 characters."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("ts"), "query"))
    return events.withColumn("nth", nth).where(F.col("nth") <= keep).withColumn("answer", F.substring("answer", 1, 500))


def read_openapi_endpoints(files: DataFrame, per_file: int = 40, max_files: int = 5, max_depth: int = 4) -> DataFrame:
    """(file, method, path) from openapi / swagger JSON among (path, content)."""
    found = files.where(F.lower("path").rlike(r"(openapi|swagger)[^/]*\.json$") & (F.size(F.split("path", "/")) <= max_depth)).orderBy("path").limit(max_files)
    paths = F.from_json(F.get_json_object("content", "$.paths"), "map<string,map<string,string>>")
    rows = found.select(F.col("path").alias("file"), F.explode(F.slice(F.array_sort(F.map_keys(paths)), 1, per_file)).alias("at"), paths.alias("p"))
    rows = rows.select("file", F.col("at").alias("path"), F.explode(F.map_keys(F.element_at("p", F.col("at")))).alias("method"))
    return rows.where(F.lower("method").isin("get", "post", "put", "delete", "patch", "options")).select("file", F.upper("method").alias("method"), "path")
