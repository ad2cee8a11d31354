"""Scalar rules on paths, names, messages and scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx",
    ".java": "java", ".kt": "kotlin", ".scala": "scala",
    ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".m": "objective-c", ".mm": "objective-cpp",
    ".r": "r", ".lua": "lua", ".pl": "perl", ".sh": "bash", ".bash": "bash",
    ".dart": "dart", ".elm": "elm", ".ex": "elixir", ".clj": "clojure",
    ".hs": "haskell", ".ml": "ocaml", ".vim": "vim", ".lisp": "lisp",
    ".jl": "julia", ".nim": "nim", ".cr": "crystal", ".d": "d",
    ".pas": "pascal", ".vb": "vb", ".v": "verilog", ".sv": "systemverilog",
}
MANIFESTS = (
    "package.json", "package-lock.json", "requirements.txt", "requirements-dev.txt", "requirements-prod.txt",
    "pyproject.toml", "go.mod", "go.sum", "schema.prisma", "docker-compose.yml", "docker-compose.yaml",
    "compose.yml", "compose.yaml", "kubernetes.yaml", "k8s.yaml", "deployment.yaml", "setup.py", "pom.xml",
    "build.gradle", "build.gradle.kts", "yarn.lock", "pnpm-lock.yaml", ".env", ".env.example", ".env.local",
)
# Path patterns of the layers, in the order in which they are tried, and the layers' other names.
LAYERS = {
    "api": ["api/", "apis/", "routes/", "route/", "controllers/", "controller/", "handlers/", "handler/", "endpoints/", "graphql/", "routers/", "router/"],
    "service": ["services/", "service/", "domain/", "usecases/", "use_cases/", "application/", "app/backend/", "core/"],
    "data": ["models/", "model/", "db/", "database/", "repositories/", "repository/", "repo/", "migrations/", "migration/", "schema/", "dal/"],
    "ui": ["frontend/", "ui/", "components/", "pages/", "views/", "src/app/", "widgets/", "screens/"],
    "util": ["utils/", "util/", "helpers/", "lib/", "common/", "shared/", "config/", "scripts/", "tools/"],
}
LAYER_NAMES = {"utility": "util"}
LAYER_COLOURS = {"api": "#6366f1", "service": "#8b5cf6", "data": "#06b6d4", "ui": "#f59e0b", "util": "#64748b", "other": "#475569"}
SENSITIVE = {
    "PII": "ssn|social_security|passport|dob|date_of_birth|personal_data|user_data|customer_data",
    "AUTH": "password|secret|token|api_key|jwt|auth_token|access_token|refresh_token|credential",
    "FINANCE": "credit_card|amount|balance|currency|payment|transaction|price|cost|revenue",
}


def normalize_path(path: Column, fold: bool = False) -> Column:
    out = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")
    return F.lower(out) if fold else out


def path_variants(path: Column) -> Column:
    return F.array_distinct(F.array(path, F.replace(path, F.lit("\\"), F.lit("/")), F.replace(path, F.lit("/"), F.lit("\\"))))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), r"/+$", "")


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty for names without one and for dotfiles."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def detect_language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("unknown"))


def is_test_file(path: Column) -> Column:
    name, folder = F.lower(basename(path)), F.lower(dirname(path))
    return (
        name.rlike(r"^test_|_test\.(py|go|rs)$|\.test\.|\.spec\.|tests?\.java")
        | folder.rlike("__tests?__")
        | F.arrays_overlap(F.split(folder, r"[/\\]"), F.array(F.lit("test"), F.lit("tests")))
    )


def is_manifest(path: Column) -> Column:
    name = F.lower(basename(path))
    return name.isin(*MANIFESTS) | name.rlike(r"^requirements.*\.txt$|^dockerfile(\.\w+)?$|.\.(tf|tfvars)$")


def node_role(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(is_manifest(path), "infrastructure")
        .when(is_test_file(path), "test")
        .when(p.rlike("/(api|routes|endpoints|controllers|handlers)/"), "api")
        .when(p.rlike("/(frontend|client|src/app|components|pages|views)/"), "frontend")
        .when(p.rlike("/(backend|server|app|services|models)/"), "backend")
        .otherwise("code")
    )


def infer_layer(layer: Column, node_id: Column, name: Column, kind: Column) -> Column:
    """A node's own layer by its id or name, ``other`` if it is no known one; without one, by patterns in its id.

    For a folder or module the patterns are first tried at the start of its id or after a slash, in all layers.
    """
    own = F.lower(F.trim(F.coalesce(layer, F.lit(""))))
    text = F.lower(F.replace(F.coalesce(F.nullif(node_id, F.lit("")), name, F.lit("")), F.lit("\\"), F.lit("/")))
    out = F.when(own.isin(*LAYER_COLOURS), own)
    for other, key in LAYER_NAMES.items():
        out = out.when(own == other, key)
    out = out.when(own != "", "other")
    any_of = lambda patterns: "|".join(p.replace(".", r"\.") for p in patterns)
    for key, patterns in LAYERS.items():
        out = out.when(F.lower(kind).isin("folder", "module") & text.rlike(f"(^|/)({any_of(patterns)})"), key)
    for key, patterns in LAYERS.items():
        out = out.when(text.rlike(any_of(patterns)), key)
    return out.otherwise("other")


def sensitivity_tags(text: Column) -> Column:
    tags = F.array(*[F.when(F.lower(text).rlike(p), tag) for tag, p in SENSITIVE.items()])
    return F.filter(tags, lambda t: t.isNotNull())


def risk_multiplier(text: Column) -> Column:
    return F.when(F.size(sensitivity_tags(text)) > 0, 3.0).otherwise(1.0)


def is_api_route(name: Column) -> Column:
    return F.lower(name).rlike("route|endpoint|api|handler|controller")


def feature_name(msg: Column) -> Column:
    line = F.trim(F.substring_index(F.coalesce(msg, F.lit("")), "\n", 1))
    found = F.trim(F.regexp_extract(line, r"(?i)^(?:feat|feature|fix|chore|refactor)(?:\([^)]*\))?:\s*(.+)", 1))
    return F.when(found != "", found).otherwise(F.substring(line, 1, 120))


def repo_slug(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"github\.com[:/]([^/\s]+/[^/\s]+?)(?:\.git)?/?$", 1), F.lit(""))


def risk_band(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 40, "medium").when(score >= 15, "moderate").otherwise("low")


def risk_colour(score: Column) -> Column:
    return F.when(score >= 75, "red").when(score >= 40, "amber").when(score >= 15, "blue").otherwise("green")


def risk_filter_band(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 40, "medium").otherwise("low")


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def check_conclusion(level: Column, blocking: Column) -> Column:
    return F.when((level == "CRITICAL") & blocking, "failure").when(level.isin("HIGH", "CRITICAL"), "neutral").otherwise("success")


def summary_line(kind: Column, layer: Column, name: Column, owner: Column, bus_risk: Column, api_route: Column) -> Column:
    return F.concat_ws(
        " ",
        F.concat(F.initcap(kind), F.lit(" in the "), layer, F.lit(" layer: "), name, F.lit(".")),
        F.when(owner.isNotNull() & ~owner.isin("None", "Unknown", ""), F.concat(F.lit("Owned by "), owner, F.lit("."))),
        F.when(bus_risk >= 0.5, "High bus-factor risk."),
        F.when(api_route, "Exposes an API route."),
    )


def chunk_node_id(symbol_id: Column, file: Column, chunk_type: Column, symbol: Column) -> Column:
    named = chunk_type.isin("function", "class") & (F.coalesce(symbol, F.lit("")) != "")
    return F.coalesce(F.nullif(symbol_id, F.lit("")), F.when(named, F.concat(file, F.lit("::"), symbol)), file)


def distance_score(d: Column) -> Column:
    return F.coalesce(F.bround(F.least(F.greatest(d / 1.5, F.lit(0.0)), F.lit(1.0)), 4), F.lit(0.5))


def sanitize_query(q: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(q, r"[^\w\s\-.:/]", " "), r"\s+", " ")), 1, 500)


def zone(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.concat_ws("/", parts[0], parts[1])).when(F.size(parts) == 2, parts[0]).otherwise("root")


def activity_message(kind: Column, payload: Column, repo: Column) -> Column:
    """Text for an event of a code host from its type, JSON payload and repository."""
    get = lambda path, default: F.coalesce(F.get_json_object(payload, path), F.lit(default))
    capital = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1000)))
    n = F.coalesce(F.json_array_length(F.get_json_object(payload, "$.commits")), F.lit(0))
    return (
        F.when(kind == "PushEvent", F.concat(F.lit("Pushed "), n.cast("string"), F.lit(" commit(s) to "), F.replace(get("$.ref", ""), F.lit("refs/heads/"), F.lit(""))))
        .when(kind == "PullRequestEvent", F.concat(capital(get("$.action", "")), F.lit(" pull request: "), get("$.pull_request.title", "pull request")))
        .when(kind == "IssuesEvent", F.concat(capital(get("$.action", "")), F.lit(" issue: "), get("$.issue.title", "issue")))
        .when(kind == "CreateEvent", F.concat(F.lit("Created "), get("$.ref_type", ""), F.lit(": "), get("$.ref", "")))
        .otherwise(F.concat(F.replace(kind, F.lit("Event"), F.lit("")), F.lit(" in "), repo))
    )


def ratio2(a: Column, b: Column) -> Column:
    """a / b to two digits, halves up, exactly: for whole a and b > 0."""
    return F.floor((200 * a + b) / (2 * b)).cast("double") / 100
