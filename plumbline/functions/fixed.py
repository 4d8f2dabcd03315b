"""Fixed values of the graph model: domains, aliases, patterns and tables that results depend on."""

from __future__ import annotations

# Node types by group.
NODE_TYPES = (
    "file",
    "function",
    "class",
    "module",
    "concept",
    "config",
    "document",
    "service",
    "table",
    "endpoint",
    "pipeline",
    "schema",
    "resource",
    "domain",
    "flow",
    "step",
    "article",
    "entity",
    "topic",
    "claim",
    "source",
)
FILE_LEVEL_TYPES = ("file", "config", "document", "service", "pipeline", "table", "schema", "resource", "endpoint")
NODE_CATEGORY = {
    "file": "code",
    "function": "code",
    "class": "code",
    "module": "code",
    "concept": "code",
    "config": "config",
    "document": "docs",
    "service": "infra",
    "resource": "infra",
    "pipeline": "infra",
    "table": "data",
    "endpoint": "data",
    "schema": "data",
    "domain": "domain",
    "flow": "domain",
    "step": "domain",
    "article": "knowledge",
    "entity": "knowledge",
    "topic": "knowledge",
    "claim": "knowledge",
    "source": "knowledge",
}
# Edge types by category.
EDGE_CATEGORIES = {
    "structural": ("imports", "exports", "contains", "inherits", "implements"),
    "behavioral": ("calls", "subscribes", "publishes", "middleware"),
    "data-flow": ("reads_from", "writes_to", "transforms", "validates"),
    "dependencies": ("depends_on", "tested_by", "configures"),
    "semantic": ("related", "similar_to"),
    "infrastructure": ("deploys", "serves", "provisions", "triggers", "migrates", "documents", "routes", "defines_schema"),
    "domain": ("contains_flow", "flow_step", "cross_domain"),
    "knowledge": ("cites", "contradicts", "builds_on", "exemplifies", "categorized_under", "authored_by"),
}
EDGE_TYPES = tuple(t for types in EDGE_CATEGORIES.values() for t in types)
EDGE_CATEGORY = {t: c for c, types in EDGE_CATEGORIES.items() for t in types}
# Spellings of node types, edge types, complexities and directions.
NODE_TYPE_ALIASES = {
    "func": "function",
    "fn": "function",
    "method": "function",
    "interface": "class",
    "struct": "class",
    "mod": "module",
    "pkg": "module",
    "package": "module",
    "container": "service",
    "deployment": "service",
    "pod": "service",
    "doc": "document",
    "readme": "document",
    "docs": "document",
    "job": "pipeline",
    "ci": "pipeline",
    "route": "endpoint",
    "api": "endpoint",
    "query": "endpoint",
    "mutation": "endpoint",
    "setting": "config",
    "env": "config",
    "configuration": "config",
    "infra": "resource",
    "infrastructure": "resource",
    "terraform": "resource",
    "migration": "table",
    "database": "table",
    "db": "table",
    "view": "table",
    "proto": "schema",
    "protobuf": "schema",
    "definition": "schema",
    "typedef": "schema",
    "business_domain": "domain",
    "business_flow": "flow",
    "business_process": "flow",
    "task": "step",
    "business_step": "step",
    "note": "article",
    "page": "article",
    "wiki_page": "article",
    "person": "entity",
    "actor": "entity",
    "organization": "entity",
    "tag": "topic",
    "category": "topic",
    "theme": "topic",
    "assertion": "claim",
    "decision": "claim",
    "thesis": "claim",
    "reference": "source",
    "raw": "source",
    "paper": "source",
}
EDGE_TYPE_ALIASES = {
    "extends": "inherits",
    "invokes": "calls",
    "invoke": "calls",
    "uses": "depends_on",
    "requires": "depends_on",
    "relates_to": "related",
    "related_to": "related",
    "similar": "similar_to",
    "import": "imports",
    "export": "exports",
    "contain": "contains",
    "publish": "publishes",
    "subscribe": "subscribes",
    "describes": "documents",
    "documented_by": "documents",
    "creates": "provisions",
    "exposes": "serves",
    "listens": "serves",
    "deploys_to": "deploys",
    "migrates_to": "migrates",
    "routes_to": "routes",
    "triggers_on": "triggers",
    "fires": "triggers",
    "defines": "defines_schema",
    "has_flow": "contains_flow",
    "next_step": "flow_step",
    "interacts_with": "cross_domain",
    "references": "cites",
    "cites_source": "cites",
    "conflicts_with": "contradicts",
    "disagrees_with": "contradicts",
    "refines": "builds_on",
    "elaborates": "builds_on",
    "illustrates": "exemplifies",
    "instance_of": "exemplifies",
    "example_of": "exemplifies",
    "belongs_to": "categorized_under",
    "tagged_with": "categorized_under",
    "written_by": "authored_by",
    "created_by": "authored_by",
}
COMPLEXITY_ALIASES = {
    "simple": ("simple", "low", "easy", "trivial", "basic"),
    "moderate": ("moderate", "medium", "intermediate", "mid", "average"),
    "complex": ("complex", "high", "hard", "difficult", "advanced"),
}
DIRECTION_ALIASES = {"to": "forward", "outbound": "forward", "from": "backward", "inbound": "backward", "both": "bidirectional", "mutual": "bidirectional"}
# Layers by path segment, in order of precedence; a segment also matches in the plural.
LAYER_PATTERNS = (
    ("API Layer", ("routes", "controller", "handler", "endpoint", "api")),
    ("Service Layer", ("service", "usecase", "use-case", "business")),
    ("Data Layer", ("model", "entity", "schema", "database", "db", "migration", "repository", "repo")),
    ("UI Layer", ("component", "view", "page", "screen", "layout", "widget", "ui")),
    ("Middleware Layer", ("middleware", "interceptor", "guard", "filter", "pipe")),
    ("External Services", ("client", "integration", "external", "sdk", "vendor", "adapter")),
    ("Background Tasks", ("worker", "job", "queue", "cron", "consumer", "processor", "scheduler", "background")),
    ("Utility Layer", ("util", "helper", "lib", "common", "shared")),
    ("Test Layer", ("test", "spec", "__test__", "__spec__", "__tests__", "__specs__")),
    ("Configuration Layer", ("config", "setting", "env")),
)
CORE_LAYER = "Core"
# Languages by extension and by file name.
LANGUAGE_EXTENSIONS = {
    "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "python": ("py", "pyi", "pyw"),
    "go": ("go",),
    "rust": ("rs",),
    "java": ("java",),
    "ruby": ("rb",),
    "php": ("php",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hxx", "hh"),
    "csharp": ("cs",),
    "env": ("env",),
    "ini": ("ini", "cfg"),
    "yaml": ("yaml", "yml"),
    "json": ("json",),
    "toml": ("toml",),
    "dockerfile": ("dockerfile",),
    "makefile": ("mk",),
    "markdown": ("md", "mdx"),
    "html": ("html", "htm"),
    "css": ("css", "scss", "sass", "less"),
    "shell": ("sh", "bash", "zsh"),
    "sql": ("sql",),
    "graphql": ("graphql", "gql"),
    "protobuf": ("proto",),
    "terraform": ("tf", "tfvars"),
}
LANGUAGE_FILENAMES = {
    "ruby": ("rakefile", "gemfile"),
    "env": (".env", ".env.local", ".env.example", ".env.production", ".env.development"),
    "dockerfile": ("dockerfile", "containerfile"),
    "makefile": ("makefile", "gnumakefile"),
}
LANGUAGE_ALIASES = {
    "typescript": ("ts", "tsx", "typescript"),
    "javascript": ("js", "jsx", "javascript", "mjs", "cjs"),
    "python": ("py", "python"),
    "go": ("go", "golang"),
    "rust": ("rs", "rust"),
    "java": ("java",),
    "ruby": ("rb", "ruby"),
    "php": ("php",),
    "c": ("c",),
    "cpp": ("cpp", "cxx", "cc", "c++", "hpp", "hxx", "h++"),
    "csharp": ("cs", "csharp", "c#"),
}
# File categories by name.
DOC_SUFFIXES = (".md", ".rst", ".txt")
DATA_SUFFIXES = (".json", ".yaml", ".yml", ".toml")
MANIFEST_NAMES = ("package.json", "tsconfig.json", "cargo.toml", "pyproject.toml", "pipfile", "go.mod", "go.sum", "gemfile", "rakefile", "dockerfile", "makefile", ".eslintrc", ".prettierrc")
CONFIG_NAMES = ("dockerfile", "makefile", "rakefile", "gemfile", ".gitignore", ".dockerignore", ".editorconfig")
# Node types of definitions by their kind.
DEFINITION_TYPES = {
    "table": ("table", "view", "index"),
    "schema": ("message", "type", "enum"),
    "resource": ("resource", "module"),
    "service": ("service", "deployment"),
    "pipeline": ("job", "stage", "target"),
    "endpoint": ("route", "query", "mutation"),
    "config": ("variable", "output"),
}
# Kinds of entry points by words of the path, in order.
ENTRY_TYPES = (("http", ("routes", "handlers", "controllers", "/api/")), ("cli", ("/cli", "commands")), ("event", ("worker", "queue", "consumer")), ("cron", ("cron", "scheduler")))
# Weights of derived edges.
WEIGHTS = {"contains": 1.0, "imports": 0.7, "calls": 0.8, "contains_flow": 1.0, "flow_step": 1.0, "cross_domain": 0.5, "categorized_under": 1.0, "cites": 0.8}
# Limits and thresholds.
PAGE_LIMIT, SEARCH_LIMIT, RANKED_LIMIT, POOL_LIMIT = 250, 25, 50, 200
FULL_THRESHOLD, BIG_GRAPH = 30, 50
SEARCH_WEIGHTS = {"name": 0.4, "tags": 0.3, "summary": 0.2, "language_notes": 0.1}
SEARCH_CUTOFF, SQUASH = 0.95, 64.0
PROMPT_CHARS, README_BYTES = 8000, 1024
