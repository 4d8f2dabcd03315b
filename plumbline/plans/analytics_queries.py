"""Queries of structural analytics: entry points, inventories, directory matrices, expected edges, panels, caches, fallbacks."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from plumbline.functions import fixed, scalars
from plumbline.functions.ids import basename, canonical_id_sql, canonical_path, is_reference
from plumbline.operators import build, graph, search
from plumbline.operators.skew import join_ends
from plumbline.plans.common import EDGES, MEMBERS, NODES, QUERY, edges_of, members_of, nodes_of, sql, trim_sql
from plumbline.plans.data_queries import _ALL, _DOMAIN, _SCORED
from plumbline.plans.graph_queries import _CHANGED, HUB, _rescanned, hub
from plumbline.sources.tables import table

Q: dict = {}
S: dict = {}

# File names that start programs, directories by pattern, and edges that nodes of a type should have.
ENTRY_NAMES = tuple(
    "index.ts index.js main.ts main.js app.ts app.js server.ts server.js mod.rs main.go main.py main.rs manage.py app.py wsgi.py asgi.py run.py __main__.py Application.java Main.java Program.cs config.ru index.php App.swift Application.kt main.cpp main.c".split()
)
DIRECTORY_LABELS = {
    "api": ("routes", "api", "controllers", "endpoints", "handlers", "serializers", "controller", "routers", "blueprints"),
    "service": ("services", "core", "lib", "domain", "logic", "signals", "internal", "composables", "mailers", "jobs", "channels"),
    "data": ("models", "db", "data", "persistence", "repository", "entities", "migrations", "entity", "sql", "database", "schema"),
    "ui": ("components", "views", "pages", "ui", "layouts", "screens"),
    "middleware": ("middleware", "plugins", "interceptors", "guards"),
    "utility": ("utils", "helpers", "common", "shared", "tools", "templatetags", "pkg"),
    "config": ("config", "constants", "env", "settings", "management", "commands"),
    "test": ("__tests__", "test", "tests", "spec", "specs"),
    "types": ("types", "interfaces", "schemas", "contracts", "dtos", "dto", "request", "response"),
    "hooks": ("hooks",),
    "state": ("store", "state", "reducers", "actions", "slices"),
    "assets": ("assets", "static", "public"),
    "entry": ("cmd", "bin"),
    "documentation": ("docs", "documentation", "wiki"),
    "infrastructure": ("deploy", "deployment", "infra", "infrastructure", "k8s", "kubernetes", "helm", "charts", "terraform", "tf", "docker"),
    "ci-cd": (".github", ".gitlab", ".circleci"),
}
EXPECTED_EDGES = {
    "document": ("documents",),
    "service": ("deploys", "depends_on"),
    "pipeline": ("triggers",),
    "table": ("migrates", "defines_schema"),
    "schema": ("defines_schema",),
    "domain": ("contains_flow",),
    "flow": ("flow_step",),
}
EDGE_LABELS = {"cites": ("cites",), "contradicts": ("contradicts", "refutes"), "builds_on": ("builds_on", "builds-on", "buildson"), "exemplifies": ("claims", "claim")}
LESSON_TITLES = (
    ("typescript", "generics", "Generics"),
    ("typescript", "type-narrowing", "Type narrowing"),
    ("javascript", "closures", "Closures"),
    ("javascript", "promises", "Promises"),
    ("python", "decorators", "Decorators"),
    ("python", "context-managers", "Context managers"),
    ("go", "interfaces", "Implicit interfaces"),
    ("go", "goroutines", "Goroutines and channels"),
    ("rust", "ownership", "Ownership and borrowing"),
    ("rust", "traits", "Traits"),
    ("java", "annotations", "Annotations"),
    ("ruby", "blocks", "Blocks and yield"),
)


def query(text: str | None = None, *parts: str):
    def register(f):
        Q[f.__name__] = f
        if text is not None:
            S[f.__name__] = sql(text, *parts) if parts else text
        return f

    return register


_NAMES = ", ".join(repr(x) for x in ENTRY_NAMES)
_EP = f"""fo AS (SELECT n.id, n.name, n.file_path, coalesce(o.k, 0) AS fan_out, coalesce(i.k, 0) AS fan_in FROM n
LEFT JOIN (SELECT source AS id, count(DISTINCT target) AS k FROM e GROUP BY 1) o USING (id) LEFT JOIN (SELECT target AS id, count(DISTINCT source) AS k FROM e GROUP BY 1) i USING (id) WHERE n.type = 'file'),
lim AS (SELECT quantile_disc(fan_out, 0.9) AS hi, quantile_disc(fan_in, 0.25) AS lo FROM fo),
ep AS (SELECT id, (CASE WHEN split_part(coalesce(file_path, ''), '/', -1) IN ({_NAMES}) THEN 3 ELSE 0 END) + (CASE WHEN file_path IS NOT NULL AND length(file_path) - length(replace(file_path, '/', '')) <= 1 THEN 1 ELSE 0 END)
+ (CASE WHEN fan_out > hi THEN 1 ELSE 0 END) + (CASE WHEN fan_in <= lo THEN 1 ELSE 0 END) AS score FROM fo, lim)"""


@query("SELECT id, score::BIGINT AS score FROM ep ORDER BY score DESC, id LIMIT 5", NODES, EDGES, _EP)
def entry_points(spark, d):
    """The five most likely entry points by name, depth, fan-out above the ninth decile and fan-in up to the first quartile."""
    e = edges_of(spark, d).select("source", "target").distinct()
    out, into = e.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("fan_out")), e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in"))
    fo = nodes_of(spark, d).where("type = 'file'").select("id", "file_path").join(out, "id", "left").join(into, "id", "left").fillna(0, ["fan_out", "fan_in"])
    lim = fo.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY fan_out)").alias("hi"), F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY fan_in)").alias("lo")).first()
    depth = F.length("file_path") - F.length(F.replace("file_path", F.lit("/"), F.lit("")))
    one = lambda c: F.when(c, 1).otherwise(0)
    named = F.when(basename(F.coalesce("file_path", F.lit(""))).isin(list(ENTRY_NAMES)), 3).otherwise(0)
    score = named + one(F.col("file_path").isNotNull() & (depth <= 1)) + one(F.col("fan_out") > (lim.hi or 0)) + one(F.col("fan_in") <= (lim.lo or 0))
    return fo.select("id", score.cast("bigint").alias("score")).orderBy(F.desc("score"), "id").limit(5)


_INVENTORY = {"documentation": ("document",), "infrastructure": ("service", "pipeline", "resource"), "data": ("table", "schema", "endpoint"), "configuration": ("config",)}


@query("SELECT id, CASE WHEN type = 'document' THEN 'documentation' WHEN type IN ('service', 'pipeline', 'resource') THEN 'infrastructure' WHEN type IN ('table', 'schema', 'endpoint') THEN 'data' ELSE 'configuration' END AS class FROM n WHERE type IN ('document', 'service', 'pipeline', 'resource', 'table', 'schema', 'endpoint', 'config')", NODES)
def noncode_inventory(spark, d):
    return nodes_of(spark, d).select("id", scalars.one_of(F.col("type"), _INVENTORY).alias("class")).where("class is not null")


_GROUPS = "g AS (SELECT id, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE 'root' END AS grp FROM n WHERE type = 'file' AND file_path IS NOT NULL), im AS (SELECT a.grp AS from_group, b.grp AS to_group, count(*) AS imports FROM e JOIN g a ON a.id = e.source JOIN g b ON b.id = e.target WHERE e.type = 'imports' GROUP BY 1, 2)"


def _matrix(spark, d):
    g = nodes_of(spark, d).where("type = 'file' and file_path is not null").select("id", F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise("root").alias("grp"))
    j = join_ends(edges_of(spark, d).where("type = 'imports'").select("source", "target"), g, {"grp": "from_group"}, {"grp": "to_group"})
    return j.groupBy("from_group", "to_group").agg(F.count("*").alias("imports"))


@query("SELECT x.from_group, x.to_group, x.imports, coalesce(y.imports, 0) AS back FROM im x LEFT JOIN im y ON y.from_group = x.to_group AND y.to_group = x.from_group WHERE x.from_group <> x.to_group", NODES, EDGES, _GROUPS)
def import_matrix(spark, d):
    m = _matrix(spark, d).where("from_group <> to_group")
    back = m.select(F.col("to_group").alias("from_group"), F.col("from_group").alias("to_group"), F.col("imports").alias("back"))
    return m.join(back, ["from_group", "to_group"], "left").fillna(0, ["back"])


@query("SELECT grp, round(sum(own)::DOUBLE / sum(every), 4) AS density FROM (SELECT from_group AS grp, CASE WHEN from_group = to_group THEN imports ELSE 0 END AS own, imports AS every FROM im UNION ALL SELECT to_group, 0, imports FROM im WHERE from_group <> to_group) GROUP BY grp", NODES, EDGES, _GROUPS)
def group_density(spark, d):
    """Imports within a directory, of all that touch it."""
    m = _matrix(spark, d)
    own = m.select(F.col("from_group").alias("grp"), F.when(F.col("from_group") == F.col("to_group"), F.col("imports")).otherwise(0).alias("own"), F.col("imports").alias("every"))
    into = m.where("from_group <> to_group").select(F.col("to_group").alias("grp"), F.lit(0).cast("bigint").alias("own"), F.col("imports").alias("every"))
    return own.unionByName(into).groupBy("grp").agg(F.round(F.sum("own") / F.sum("every"), 4).alias("density"))


_DL = "dl(segment, label) AS (VALUES " + ", ".join(f"('{s}', '{label}')" for label, ss in DIRECTORY_LABELS.items() for s in ss) + ")"


@query("SELECT label, count(DISTINCT id) AS files FROM (SELECT id, unnest(string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/')) AS segment FROM n WHERE type = 'file' AND file_path IS NOT NULL) JOIN dl USING (segment) GROUP BY 1", NODES, _DL)
def directory_patterns(spark, d):
    labels = spark.createDataFrame([(s, label) for label, ss in DIRECTORY_LABELS.items() for s in ss], "segment string, label string")
    rows = nodes_of(spark, d).where("type = 'file' and file_path is not null").select("id", F.explode(F.split(F.regexp_replace("file_path", "/?[^/]*$", ""), "/")).alias("segment"))
    return rows.join(F.broadcast(labels), "segment").groupBy("label").agg(F.countDistinct("id").alias("files"))


_FLAGS = {"has_dockerfile": r"(?:^|/)dockerfile[^/]*$", "has_compose": r"(?:^|/)docker-compose[^/]*$", "has_k8s": r"(?:^|/)(?:k8s|kubernetes|helm|charts)/", "has_terraform": r"\.tf(?:vars)?$", "has_ci": r"(?:^|/)(?:\.github/workflows/|\.gitlab-ci\.yml$|jenkinsfile$)", "has_migrations": r"(?:^|/)migrations/"}


@query("SELECT project, " + ", ".join(f"bool_or(regexp_matches(p, '{r}')) AS {k}" for k, r in _FLAGS.items()) + " FROM (SELECT project, lower(replace(path, '\\', '/')) AS p FROM source_files) GROUP BY project")
def deployment_flags(spark, d):
    p = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    return table(spark, d, "source_files").select("project", p.alias("p")).groupBy("project").agg(*[F.bool_or(F.col("p").rlike(r)).alias(k) for k, r in _FLAGS.items()])


_EXPECT = "ex(type, edge) AS (VALUES " + ", ".join(f"('{t}', '{e}')" for t, es in EXPECTED_EDGES.items() for e in es) + ")"


@query("SELECT id, type FROM n WHERE type IN (SELECT type FROM ex) AND NOT EXISTS (SELECT 1 FROM e JOIN ex ON ex.edge = e.type AND ex.type = n.type WHERE e.source = n.id OR e.target = n.id)", NODES, EDGES, _EXPECT)
def expected_edges_missing(spark, d):
    expect = spark.createDataFrame([(t, e) for t, es in EXPECTED_EDGES.items() for e in es], "type string, edge string")
    ends = edges_of(spark, d).select(F.col("type").alias("edge"), F.explode(F.array("source", "target")).alias("id")).distinct()
    typed = nodes_of(spark, d).where(F.col("type").isin(list(EXPECTED_EDGES))).select("id", "type")
    have = typed.join(ends, "id").join(F.broadcast(expect), ["type", "edge"], "left_semi").select("id").distinct()
    return typed.join(have, "id", "left_anti")


@query("SELECT DISTINCT a.fid AS source, b.fid AS target, 'imports' AS type, 0.7::DOUBLE AS weight FROM e JOIN own a ON a.id = e.source JOIN own b ON b.id = e.target WHERE e.type = 'calls' AND a.fid <> b.fid AND NOT EXISTS (SELECT 1 FROM e x WHERE x.type = 'imports' AND x.source = a.fid AND x.target = b.fid)", NODES, EDGES, "own AS (SELECT n.id, f.fid FROM n JOIN (SELECT project, file_path, min(id) AS fid FROM n WHERE type = 'file' AND file_path IS NOT NULL GROUP BY 1, 2) f USING (project, file_path))")
def import_gaps(spark, d):
    """Imports that calls between files imply and no edge has."""
    n = nodes_of(spark, d).where("file_path is not null")
    files = n.where("type = 'file'").groupBy("project", "file_path").agg(F.min("id").alias("fid"))
    own = n.join(files, ["project", "file_path"]).select("id", "fid")
    e = edges_of(spark, d)
    pairs = join_ends(e.where("type = 'calls'").select("source", "target"), own, {"fid": "a"}, {"fid": "b"}).where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()
    return pairs.join(e.where("type = 'imports'").select("source", "target"), ["source", "target"], "left_anti").select("source", "target", F.lit("imports").alias("type"), F.lit(0.7).alias("weight"))


@query("SELECT 'flow:' || file_path AS flow, name, round((row_number() OVER (PARTITION BY file_path ORDER BY name))::DOUBLE / (count(*) OVER (PARTITION BY file_path)), 4) AS weight FROM (SELECT DISTINCT file_path, name FROM sym)", NODES, _DOMAIN)
def flow_step_weights(spark, d):
    """Steps of a flow in order, as increasing weights up to 1."""
    n = nodes_of(spark, d)
    files = n.where("type = 'file' and file_path <> ''").select("file_path").distinct()
    steps = n.where("type in ('function', 'class')").join(files, "file_path", "left_semi").select("file_path", "name").distinct()
    w = Window.partitionBy("file_path")
    return steps.select(F.concat(F.lit("flow:"), "file_path").alias("flow"), "name", F.round(F.row_number().over(w.orderBy("name")) / F.count("*").over(w), 4).alias("weight"))


@query("SELECT (SELECT count(*) FROM n SEMI JOIN changed USING (id) WHERE complexity = 'complex') AS complex, (SELECT count(DISTINCT layer_id) FROM m SEMI JOIN changed USING (id)) AS layers, (SELECT count(*) FROM changed) AS changed", NODES, EDGES, MEMBERS, _CHANGED)
def risk_numbers(spark, d):
    b = graph.blast_radius(nodes_of(spark, d), edges_of(spark, d), _rescanned(spark, d))
    rows = b.changed.join(nodes_of(spark, d).select("id", "complexity"), "id").join(members_of(spark, d).select("id", "layer_id"), "id", "left")
    return rows.agg(F.count(F.when(F.col("complexity") == "complex", 1)).alias("complex"), F.countDistinct("layer_id").alias("layers"), F.count("*").alias("changed"))


@query("SELECT CASE WHEN source IN (SELECT id FROM hub) THEN target ELSE source END AS other, type, CASE WHEN type = 'contains' AND source IN (SELECT id FROM hub) THEN 'child' ELSE 'connection' END AS part FROM e WHERE source IN (SELECT id FROM hub) OR target IN (SELECT id FROM hub)", NODES, EDGES, HUB)
def node_panel(spark, d):
    h = hub(spark, d).first()
    c = h["id"] if h else ""
    own = F.col("source") == c
    rows = edges_of(spark, d).where(own | (F.col("target") == c))
    return rows.select(F.when(own, F.col("target")).otherwise(F.col("source")).alias("other"), "type", F.when(own & (F.col("type") == "contains"), "child").otherwise("connection").alias("part"))


@query("SELECT source, target, type, 'out' AS way FROM e WHERE source IN (SELECT id FROM hub) UNION ALL SELECT source, target, type, 'in' FROM e WHERE target IN (SELECT id FROM hub)", NODES, EDGES, HUB)
def incident_edges(spark, d):
    """Edges from and to a node; a self-loop is in both."""
    h = hub(spark, d).first()
    c = h["id"] if h else ""
    e = edges_of(spark, d).select("source", "target", "type")
    return e.where(F.col("source") == c).withColumn("way", F.lit("out")).unionByName(e.where(F.col("target") == c).withColumn("way", F.lit("in")))


@query("SELECT source, target, type FROM e WHERE source IN (SELECT id FROM n WHERE type IN ('article', 'topic')) AND target IN (SELECT id FROM n WHERE type IN ('article', 'topic'))", NODES, EDGES)
def knowledge_visible(spark, d):
    return graph.induced(edges_of(spark, d), nodes_of(spark, d).where(F.col("type").isin("article", "topic"))).select("source", "target", "type")


@query("SELECT DISTINCT layer, id FROM m", NODES, MEMBERS)
def layer_union(spark, d):
    """Members of layers of one name, each once, as rows."""
    return members_of(spark, d).select("layer", "id").distinct()


@query("SELECT domain, split_part(file_path, '/', -1) AS entity, count(*) AS flows FROM p GROUP BY ALL", NODES, _DOMAIN)
def domain_overview(spark, d):
    """Entities of domains, as rows with the number of flows of each."""
    files = nodes_of(spark, d).where("type = 'file' and file_path <> ''").select("file_path", scalars.top_level_domain(F.col("file_path")).alias("domain")).distinct()
    return files.groupBy("domain", basename(F.col("file_path")).alias("entity")).agg(F.count("*").alias("flows"))


@query("SELECT id, floor((row_number() OVER (ORDER BY id) - 1) / 32)::BIGINT AS batch FROM n", NODES)
def embed_batches(spark, d):
    return search.batches(nodes_of(spark, d).select("id"), "id", 32)


@query("SELECT kind, value, count(*) AS projects FROM (SELECT name, 'language' AS kind, unnest(languages) AS value FROM projects UNION ALL SELECT name, 'framework', unnest(frameworks) FROM projects) GROUP BY ALL")
def project_stack(spark, d):
    p = table(spark, d, "projects")
    rows = p.select(F.lit("language").alias("kind"), F.explode("languages").alias("value")).unionByName(p.select(F.lit("framework").alias("kind"), F.explode("frameworks").alias("value")))
    return rows.groupBy("kind", "value").agg(F.count("*").alias("projects"))


@query("SELECT l.project, l.lang AS language, x.concept, x.title FROM (SELECT DISTINCT name AS project, unnest(languages) AS lang FROM projects) l JOIN (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LESSON_TITLES) + ") x(language, concept, title) ON x.language = l.lang")
def language_lessons(spark, d):
    titles = spark.createDataFrame(LESSON_TITLES, "language string, concept string, title string")
    return table(spark, d, "projects").select(F.col("name").alias("project"), F.explode("languages").alias("language")).distinct().join(F.broadcast(titles), "language")


@query("SELECT id, degree, round(greatest(0.85, least(1.5, 0.85 + 0.03 * degree)), 4) AS scale FROM (SELECT unnest([source, target]) AS id, count(*) AS degree FROM e GROUP BY 1)", EDGES)
def node_scale(spark, d):
    deg = edges_of(spark, d).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return deg.select("id", "degree", F.round(F.greatest(F.lit(0.85), F.least(F.lit(1.5), 0.85 + 0.03 * F.col("degree"))), 4).alias("scale"))


@query("SELECT doc_id, total FROM (SELECT doc_id, sum(length(text)) OVER (ORDER BY doc_id)::BIGINT AS total FROM documents WHERE doc_kind = 'article' AND text <> '') WHERE total <= 12000")
def catalog_cap(spark, d):
    """Articles in order until their texts fill a catalog of 12,000 characters."""
    rows = table(spark, d, "documents").where("doc_kind = 'article' and text <> ''").select("doc_id", F.length("text").alias("n"))
    # Each text has a character at least, so the running sum of the first 12,001 is all that can matter: the window has a bounded input.
    firsts = rows.orderBy("doc_id").limit(12_001)
    return firsts.select("doc_id", F.sum("n").over(Window.orderBy("doc_id")).alias("total")).where("total <= 12000")


@query("SELECT a.request_id FROM summary_requests a WHERE content IS NOT NULL AND EXISTS (SELECT 1 FROM summary_requests b WHERE b.project_name = a.project_name AND b.path = a.path AND b.content = a.content AND (b.requested_at < a.requested_at OR (b.requested_at = a.requested_at AND b.request_id < a.request_id)))")
def reply_cache_hits(spark, d):
    """Requests that an earlier one with the same file and content has answered."""
    rows = table(spark, d, "summary_requests").where("content is not null").select("request_id", "project_name", "path", scalars.text_hash(F.col("content")).alias("hash"), F.struct("requested_at", "request_id").alias("at"))
    first = rows.groupBy("project_name", "path", "hash").agg(F.min("at").alias("first"))
    return rows.join(first, ["project_name", "path", "hash"]).where(F.col("at") > F.col("first")).select("request_id")


@query("SELECT id, score FROM sc WHERE score < 0.4 ORDER BY score, id LIMIT 50", NODES, _SCORED)
def search_client(spark, d):
    return search.ranked_search(nodes_of(spark, d), QUERY, cutoff=0.4)


@query(f"SELECT id, min(score) AS score FROM (SELECT id, score FROM (SELECT id, score FROM sc WHERE score < 0.4 ORDER BY score, id LIMIT 50) UNION ALL SELECT id, score FROM (SELECT id, score FROM sc WHERE score < 0.95 AND id IN (SELECT id FROM n WHERE {_ALL} ORDER BY id LIMIT 200) ORDER BY score, id LIMIT 25)) GROUP BY id", NODES, _SCORED)
def search_hybrid(spark, d):
    n = nodes_of(spark, d)
    return search.ranked_search(n, QUERY, cutoff=0.4).unionByName(search.pooled_search(n, QUERY)).groupBy("id").agg(F.min("score").alias("score"))


@query("SELECT id, CASE WHEN length(t) > 500 THEN 1 ELSE 0 END + CASE WHEN length(t) > 100 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, '[\\x00-\\x1f\\x7f]') THEN 1 ELSE 0 END + 1 AS fallbacks FROM (SELECT id, text AS t FROM nt)", NODES, "nt AS (SELECT id, CASE WHEN t = '' THEN 'node:' || id ELSE t END AS text FROM (SELECT id, concat_ws(' :: ', nullif(" + trim_sql("name") + ", ''), nullif(" + trim_sql("summary") + ", ''), nullif(" + trim_sql("array_to_string(tags, ',')") + ", '')) AS t FROM n))")
def embed_fallbacks(spark, d):
    """Number of shorter texts that a node's text falls back to when a provider rejects it."""
    t = scalars.node_text(F.col("id"), F.col("name"), F.col("summary"), F.col("tags"))
    return nodes_of(spark, d).select("id", F.size(scalars.fallback_texts(F.col("id"), t)).alias("fallbacks"))


@query("SELECT pos, CASE WHEN l IN ('cites') THEN 'cites' WHEN l IN ('contradicts', 'refutes') THEN 'contradicts' WHEN l IN ('builds_on', 'builds-on', 'buildson') THEN 'builds_on' WHEN l IN ('claims', 'claim') THEN 'exemplifies' END AS mapped FROM (SELECT pos, lower(trim(type)) AS l FROM edges)")
def reply_edge_labels(spark, d):
    return table(spark, d, "edges").select("pos", scalars.one_of(F.lower(F.trim("type")), EDGE_LABELS).alias("mapped"))


@query("SELECT project, path, file_id FROM (SELECT project, regexp_replace(replace(regexp_replace(path, '^\\s+|\\s+$', '', 'g'), '\\', '/'), '^(?:\\./)+', '') AS path, file_id, row_number() OVER (PARTITION BY project, regexp_replace(replace(regexp_replace(path, '^\\s+|\\s+$', '', 'g'), '\\', '/'), '^(?:\\./)+', '') ORDER BY scanned_at DESC, file_id DESC) AS rn FROM source_files) WHERE rn = 1")
def latest_scans(spark, d):
    rows = table(spark, d, "source_files").select("project", canonical_path(F.col("path")).alias("path"), "file_id", "scanned_at")
    return rows.groupBy("project", "path").agg(F.max(F.struct("scanned_at", "file_id")).alias("m")).select("project", "path", "m.file_id")


@query()
def hashed_embeddings(spark, d):
    """Texts of nodes as unit vectors of hashed words: the deterministic provider."""
    t = scalars.node_text(F.col("id"), F.col("name"), F.col("summary"), F.col("tags"))
    return nodes_of(spark, d).select("id", embed(t).alias("vector"))


def embed(text, dim: int = 64):
    """A text as a unit vector of hashed words."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode("utf-8", "replace"))
                out[i, h % dim] += 1.0 if h >> 16 & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list(out / np.where(norm > 0, norm, 1)))

    return run(text)


@query()
def knowledge_topics(spark, d):
    arts = build.articles(table(spark, d, "documents"))
    return arts.where("category is not null").groupBy(scalars.slugify(F.col("category")).alias("topic")).agg(F.count("*").alias("articles"))


@query("SELECT id, prio FROM (SELECT id, 0 AS prio, pos FROM n WHERE file_path || ':' || name IN (SELECT file_path || ':' || name FROM n SEMI JOIN hub USING (id)) UNION ALL SELECT id, 1, pos FROM n WHERE file_path IN (SELECT file_path FROM n SEMI JOIN hub USING (id))) ORDER BY prio, pos LIMIT 1", NODES, "hub AS (SELECT min(id) AS id FROM n WHERE type = 'function' AND file_path IS NOT NULL)")
def point_lookup(spark, d):
    """A component by ``path:symbol``, else the first node of the path."""
    n = nodes_of(spark, d)
    row = n.where("type = 'function' and file_path is not null").orderBy("id").select("file_path", "name").first()
    path, name = (row["file_path"], row["name"]) if row else (None, None)
    exact = n.where((F.col("file_path") == path) & (F.col("name") == name)).select("id", F.lit(0).alias("prio"), "pos")
    return exact.unionByName(n.where(F.col("file_path") == path).select("id", F.lit(1).alias("prio"), "pos")).orderBy("prio", "pos").limit(1).select("id", "prio")


@query("SELECT layer_id, count(*) AS hits FROM m JOIN (SELECT id FROM sc WHERE score < 0.95 ORDER BY score, id LIMIT 50) USING (id) GROUP BY 1", NODES, MEMBERS, _SCORED)
def search_hits_per_layer(spark, d):
    hits = search.ranked_search(nodes_of(spark, d), QUERY)
    return members_of(spark, d).join(F.broadcast(hits), "id").groupBy("layer_id").agg(F.count("*").alias("hits"))


@query("SELECT (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM ce GROUP BY source, target, type))::BIGINT AS duplicates, (SELECT count(*) FROM e WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n)) AS dangling", NODES, EDGES, f"ce AS (SELECT {canonical_id_sql('source')} AS source, {canonical_id_sql('target')} AS target, type FROM edges WHERE {trim_sql('source')} <> '' AND {trim_sql('target')} <> '')")
def merge_statistics(spark, d):
    """Repeated edges, and edges that miss a node."""
    raw = table(spark, d, "edges").where(is_reference(F.col("source")) & is_reference(F.col("target"))).agg(F.count("*").alias("n")).first()["n"]
    e, n = edges_of(spark, d), nodes_of(spark, d)
    whole = graph.induced(e, n).count()
    kept = e.count()
    return spark.createDataFrame([(raw - kept, kept - whole)], "duplicates bigint, dangling bigint")


@query("SELECT id, CASE WHEN type = 'concept' THEN 'concept' WHEN complexity = 'complex' THEN 'hotspot' ELSE 'file' END AS part FROM n WHERE type IN ('concept', 'file') OR complexity = 'complex'", NODES)
def guide_rows(spark, d):
    """What the onboarding guide lists."""
    part = F.when(F.col("type") == "concept", "concept").when(F.col("complexity") == "complex", "hotspot").otherwise("file")
    return nodes_of(spark, d).where(F.col("type").isin("concept", "file") | (F.col("complexity") == "complex")).select("id", part.alias("part"))


@query("SELECT DISTINCT CASE WHEN a.type = 'article' THEN e.source ELSE e.target END AS article, CASE WHEN a.type = 'article' THEN e.target ELSE e.source END AS related, e.type FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE 'article' IN (a.type, b.type)", NODES, EDGES)
def related_articles(spark, d):
    j = join_ends(edges_of(spark, d).select("source", "target", "type"), nodes_of(spark, d).select("id", "type"), {"type": "ta"}, {"type": "tb"})
    own = F.col("ta") == "article"
    return j.where(own | (F.col("tb") == "article")).select(F.when(own, F.col("source")).otherwise(F.col("target")).alias("article"), F.when(own, F.col("target")).otherwise(F.col("source")).alias("related"), "type").distinct()


@query("SELECT id, name FROM n WHERE type IN (" + ", ".join(f"'{t}'" for t, c in fixed.NODE_CATEGORY.items() if c == "infra") + ")", NODES)
def category_filter(spark, d):
    return nodes_of(spark, d).where(F.col("type").isin([t for t, c in fixed.NODE_CATEGORY.items() if c == "infra"])).select("id", "name")


QUERIES, ORACLE = Q, S
