"""Queries of building, merging, validation, search, scalars, incremental analysis and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import fixed, scalars
from plumbline.functions.ids import canonical_id, canonical_id_sql, canonical_path, dirname, is_reference, squeeze
from plumbline.operators import build, incremental, quality, search
from plumbline.plans.common import EDGES, MEMBERS, NODES, QUERY, case_sql, edges_of, members_of, nodes_of, sql, trim_sql
from plumbline.sources.tables import table
from plumbline.streaming import changes

Q: dict = {}
S: dict = {}


def query(text: str | None = None, *parts: str):
    def register(f):
        Q[f.__name__] = f
        if text is not None:
            S[f.__name__] = sql(text, *parts) if parts else text
        return f

    return register


# --- building ------------------------------------------------------------------------------------------------------------------------

_TLD = r"(CASE WHEN len(string_split(ltrim(replace(P, '\', '/'), '/'), '/')) < 2 THEN 'root' WHEN split_part(ltrim(replace(P, '\', '/'), '/'), '/', 1) IN ('src', 'lib', 'app') THEN split_part(ltrim(replace(P, '\', '/'), '/'), '/', 2) ELSE split_part(ltrim(replace(P, '\', '/'), '/'), '/', 1) END)"


def _tld(c: str) -> str:
    return _TLD.replace("P", c)


_DOMAIN = f"f AS (SELECT id, file_path, {_tld('file_path')} AS domain FROM n WHERE type = 'file' AND file_path <> ''), p AS (SELECT DISTINCT file_path, domain FROM f), sym AS (SELECT n.file_path, n.name, p.domain FROM n JOIN p USING (file_path) WHERE n.type IN ('function', 'class'))"


@query("SELECT 'domain:' || domain AS id, count(*) AS files FROM f GROUP BY domain", NODES, _DOMAIN)
def domains(spark, d):
    return build.domain_graph(nodes_of(spark, d), edges_of(spark, d)).nodes.where("type = 'domain'").select("id", F.col("parts").alias("files"))


@query(
    r"SELECT source, target, type, weight::DOUBLE AS weight FROM (SELECT 'domain:' || domain AS source, 'flow:' || file_path AS target, 'contains_flow' AS type, 1.0 AS weight FROM p UNION SELECT 'flow:' || file_path, 'step:' || domain || ':' || file_path || ':' || regexp_replace(lower(name), '\s', '-', 'g'), 'flow_step', 1.0 FROM sym UNION SELECT 'domain:' || a.domain, 'domain:' || b.domain, 'cross_domain', 0.5 FROM e JOIN f a ON a.id = e.source JOIN f b ON b.id = e.target WHERE e.type = 'imports' AND a.domain <> b.domain)",
    NODES,
    EDGES,
    _DOMAIN,
)
def domain_edges(spark, d):
    return build.domain_graph(nodes_of(spark, d), edges_of(spark, d)).edges


@query()
def knowledge_articles(spark, d):
    arts = build.articles(table(spark, d, "documents"))
    return arts.select("doc_id", "title", "slug", "summary", "category", F.array_join("links", "|").alias("links"))


@query()
def knowledge_edges(spark, d):
    return build.knowledge_graph(build.articles(table(spark, d, "documents")))


@query()
def knowledge_backlinks(spark, d):
    return build.backlinks(build.knowledge_graph(build.articles(table(spark, d, "documents"))))


_IDS = f"raw AS (SELECT pos, id AS raw, {{}} AS id FROM nodes WHERE {trim_sql('id')} <> '')"
_NORM = [
    _IDS.format(canonical_id_sql("id")),
    "k AS (SELECT DISTINCT id FROM raw)",
    f"x AS (SELECT pos, source AS rs, target AS rt, {canonical_id_sql('source')} AS source, {canonical_id_sql('target')} AS target, type FROM edges)",
    "y AS (SELECT x.*, a.id AS sid, b.id AS tid FROM x LEFT JOIN k a ON a.id = x.source LEFT JOIN k b ON b.id = x.target)",
]


@query("SELECT source, target, type, min(pos) AS pos FROM y WHERE sid IS NOT NULL AND tid IS NOT NULL GROUP BY ALL", *_NORM)
def normalise_edges(spark, d):
    return build.normalise(table(spark, d, "nodes"), table(spark, d, "edges")).edges


@query(
    "SELECT (SELECT count(*) FILTER (raw <> id) FROM raw) AS ids_fixed, (SELECT count(*) FROM raw) AS node_rows, count(*) FILTER (sid IS NULL) AS missing_source, count(*) FILTER (sid IS NOT NULL AND tid IS NULL) AS missing_target, count(*) FILTER (rs IS DISTINCT FROM source OR rt IS DISTINCT FROM target) AS edges_rewritten FROM y",
    *_NORM,
)
def normalise_statistics(spark, d):
    return build.normalise(table(spark, d, "nodes"), table(spark, d, "edges")).statistics


_MID = r"(CASE WHEN contains(X, ':') THEN lower(split_part(X, ':', 1)) || replace(substr(X, length(split_part(X, ':', 1)) + 1), '\', '/') ELSE replace(X, '\', '/') END)"


def _mid(c: str) -> str:
    return _MID.replace("X", trim_sql(c))


def _last(c: str) -> str:
    return f"arg_max({c}, pos) FILTER ({trim_sql(c)} <> '') AS {c}"


_MERGED = f"mr AS (SELECT {trim_sql('id')} AS raw, any_value({_mid('id')}) AS id, arg_min(type, pos) AS type, {_last('name')}, {_last('summary')}, {_last('file_path')}, {_last('complexity')}, count(*) AS rows, flatten(list(coalesce(tags, []) ORDER BY pos)) AS l FROM nodes WHERE {trim_sql('id')} <> '' GROUP BY 1), mm AS (SELECT *, sum(rows) OVER (PARTITION BY id)::BIGINT AS every FROM mr QUALIFY row_number() OVER (PARTITION BY id ORDER BY strlen(coalesce(summary, '')) DESC, raw) = 1)"


@query("SELECT id, type, name, summary, file_path, complexity, every AS rows FROM mm", _MERGED)
def merge_nodes(spark, d):
    return build.merge_nodes(table(spark, d, "nodes")).drop("tags")


@query("SELECT id, array_to_string(list_filter(l, lambda t, i: t IS NOT NULL AND list_position(l, t) = i), ',') AS tags FROM mm", _MERGED)
def merge_tags(spark, d):
    return build.merge_nodes(table(spark, d, "nodes")).select("id", "tags")


@query(
    f"SELECT source, target, type, round(w, 4) AS weight, pos, rows FROM (SELECT *, count(*) OVER (PARTITION BY source, target, type) AS rows, row_number() OVER (PARTITION BY source, target, type ORDER BY w DESC, pos) AS rn FROM (SELECT {_mid('source')} AS source, {_mid('target')} AS target, type, pos, CASE WHEN weight IS NULL OR weight::VARCHAR LIKE '%nan%' THEN -1.0 ELSE weight::DOUBLE END AS w FROM edges WHERE {trim_sql('source')} <> '' AND {trim_sql('target')} <> '')) WHERE rn = 1"
)
def merge_edges(spark, d):
    return build.merge_edges(table(spark, d, "edges")).withColumn("weight", F.round("weight", 4))


@query("SELECT max(analyzed_at) AS analyzed_at, max(git_commit_hash) AS git_commit_hash FROM projects")
def merge_project_meta(spark, d):
    return table(spark, d, "projects").agg(F.max("analyzed_at").alias("analyzed_at"), F.max("git_commit_hash").alias("git_commit_hash"))


# --- validation ----------------------------------------------------------------------------------------------------------------------

_CN = f"cn AS (SELECT {canonical_id_sql('id')} AS id, pos, type, summary, tags FROM nodes WHERE {trim_sql('id')} <> '')"
_CE = f"ce AS (SELECT pos, {canonical_id_sql('source')} AS source, {canonical_id_sql('target')} AS target, weight::DOUBLE AS weight FROM edges WHERE {trim_sql('source')} <> '' AND {trim_sql('target')} <> '')"
_ISSUES = f"""iss AS (
SELECT 'error' AS severity, 'MISSING_SOURCE_NODE' AS code, NULL AS node_id, pos::VARCHAR || ':' || source || '->' || target AS edge_id FROM ce WHERE source NOT IN (SELECT id FROM cn)
UNION ALL SELECT 'error', 'MISSING_TARGET_NODE', NULL, pos::VARCHAR || ':' || source || '->' || target FROM ce WHERE target NOT IN (SELECT id FROM cn)
UNION ALL SELECT 'error', 'INVALID_EDGE_WEIGHT', NULL, pos::VARCHAR || ':' || source || '->' || target FROM ce WHERE weight IS NULL OR weight::VARCHAR LIKE '%nan%' OR weight < 0 OR weight > 1
UNION ALL SELECT 'error', 'DUPLICATE_NODE_ID', id, NULL FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM cn) WHERE rn > 1
UNION ALL SELECT 'warning', 'MISSING_TAGS', id, NULL FROM cn WHERE coalesce(len(tags), 0) = 0
UNION ALL SELECT 'warning', 'MISSING_SUMMARY', id, NULL FROM cn WHERE coalesce({trim_sql('summary')}, '') = ''
UNION ALL SELECT 'warning', 'NODE_IN_MULTIPLE_LAYERS', id, NULL FROM m GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'warning', 'FILE_NODE_NOT_IN_LAYER', id, NULL FROM cn WHERE type IN ({', '.join(repr(t) for t in fixed.FILE_LEVEL_TYPES)}) AND id NOT IN (SELECT id FROM m)
UNION ALL SELECT 'warning', 'ORPHAN_NODE', id, NULL FROM cn WHERE id NOT IN (SELECT source FROM ce UNION ALL SELECT target FROM ce)
UNION ALL SELECT 'error', 'LAYER_MISSING_NODE', id, NULL FROM m WHERE id NOT IN (SELECT id FROM cn))"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes").where(is_reference(F.col("id"))).select(canonical_id(F.col("id")).alias("id"), "pos", "type", "summary", "tags")
    edges = table(spark, d, "edges").where(is_reference(F.col("source")) & is_reference(F.col("target"))).select("pos", canonical_id(F.col("source")).alias("source"), canonical_id(F.col("target")).alias("target"), "weight")
    return quality.validate(nodes, edges, members_of(spark, d))


@query("SELECT severity, code, node_id, edge_id FROM iss", NODES, MEMBERS, _CN, _CE, _ISSUES)
def validation_issues(spark, d):
    return _issues(spark, d)


@query("SELECT severity, code, count(*) AS issues FROM iss GROUP BY ALL", NODES, MEMBERS, _CN, _CE, _ISSUES)
def validation_summary(spark, d):
    return quality.summary(_issues(spark, d))


@query("SELECT 'warning' AS severity, 'SELF_LOOP' AS code, source AS node_id, NULL AS edge_id FROM e WHERE source = target UNION ALL SELECT 'warning', 'TYPE_PREFIX_MISMATCH', id, NULL FROM n WHERE contains(id, ':') AND split_part(id, ':', 1) <> type", NODES, EDGES)
def validation_extra(spark, d):
    return quality.extra_checks(nodes_of(spark, d), edges_of(spark, d))


@query(
    f"SELECT id, CASE WHEN t IN ({', '.join(repr(x) for x in fixed.NODE_TYPES)}) THEN t ELSE 'file' END AS type, name, CASE WHEN {trim_sql('coalesce(summary, chr(32))')} <> '' THEN summary ELSE name END AS summary, coalesce({case_sql('lower(' + trim_sql('complexity') + ')', fixed.COMPLEXITY_ALIASES)}, 'moderate') AS complexity FROM (SELECT *, {case_sql('lower(' + trim_sql('type') + ')', fixed.NODE_TYPE_ALIASES, 'lower(' + trim_sql('type') + ')')} AS t FROM n WHERE {trim_sql('name')} <> '')",
    NODES,
)
def lenient_nodes(spark, d):
    return quality.lenient_nodes(nodes_of(spark, d))


@query(
    f"SELECT pos, source, target, k AS type, coalesce(direction, 'forward') AS direction, round(CASE WHEN weight IS NULL OR weight::VARCHAR LIKE '%nan%' THEN 0.5 ELSE greatest(0.0, least(1.0, weight)) END, 4) AS weight FROM (SELECT *, {case_sql('lower(type)', fixed.EDGE_TYPE_ALIASES, 'lower(type)')} AS k FROM e) WHERE k IN ({', '.join(repr(x) for x in fixed.EDGE_TYPES)}) AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)",
    NODES,
    EDGES,
)
def lenient_edges(spark, d):
    return quality.lenient_edges(edges_of(spark, d), nodes_of(spark, d)).withColumn("weight", F.round("weight", 4))


# --- search --------------------------------------------------------------------------------------------------------------------------

_TOKENS = QUERY.split()
_FIELD = {"name": "lower(coalesce(name, ''))", "tags": "lower(array_to_string(tags, ' '))", "summary": "lower(coalesce(summary, ''))", "language_notes": "lower(coalesce(language_notes, ''))"}
_ALL = " AND ".join(f"(contains({_FIELD['name']}, '{t}') OR contains({_FIELD['summary']}, '{t}') OR contains({_FIELD['tags']}, '{t}'))" for t in _TOKENS)


def _score(token: str) -> str:
    n = 16.0 * len(token)
    parts = []
    for f, w in fixed.SEARCH_WEIGHTS.items():
        held = f"length(regexp_extract({_FIELD[f]}, '(?s){search.subsequence(token)}', 0))"
        apart = f"CASE WHEN {held} > 0 THEN greatest(0.0, {n - 2 + len(token)} - {held}) ELSE 0.0 END"
        raw = f"(CASE WHEN {_FIELD[f]} = '{token}' THEN {n + 16} WHEN starts_with({_FIELD[f]}, '{token}') THEN {n + 8} WHEN contains({_FIELD[f]}, '{token}') THEN {n} ELSE {apart} END)::DOUBLE"
        parts.append(f"{w}::DOUBLE * (CASE WHEN {raw} <= 0 THEN 0.0 ELSE {raw} / ({raw} + 64.0::DOUBLE) END)")
    return "(" + " + ".join(parts) + ")"


_SCORED = f"sc AS (SELECT id, type, round(1 - greatest({', '.join(_score(t) for t in _TOKENS)}), 6) AS score FROM n)"


@query(f"SELECT id, name, type FROM n WHERE {_ALL}", NODES)
def search_token_and(spark, d):
    return search.token_search(nodes_of(spark, d), QUERY)


@query("SELECT id, score FROM sc WHERE score < 0.95 ORDER BY score, id LIMIT 50", NODES, _SCORED)
def search_ranked(spark, d):
    return search.ranked_search(nodes_of(spark, d), QUERY)


@query("SELECT id, score FROM sc WHERE score < 0.95 AND type = 'function' ORDER BY score, id LIMIT 25", NODES, _SCORED)
def search_ranked_type(spark, d):
    return search.ranked_search(nodes_of(spark, d), QUERY, 25, "function")


@query(f"SELECT id, score FROM sc WHERE score < 0.95 AND id IN (SELECT id FROM n WHERE {_ALL} ORDER BY id LIMIT 200) ORDER BY score, id LIMIT 25", NODES, _SCORED)
def search_pooled(spark, d):
    return search.pooled_search(nodes_of(spark, d), QUERY)


@query(f"SELECT DISTINCT id FROM (SELECT id FROM h UNION ALL SELECT target FROM e WHERE source IN (SELECT id FROM h) UNION ALL SELECT source FROM e WHERE target IN (SELECT id FROM h)) SEMI JOIN n USING (id)", NODES, EDGES, f"h AS (SELECT id FROM n WHERE {_ALL})")
def chat_context(spark, d):
    n = nodes_of(spark, d)
    return search.expand_hits(search.token_search(n, QUERY), edges_of(spark, d), n)


@query("SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10")
def vector_top10(spark, d):
    v = table(spark, d, "embeddings")
    return search.vector_top(v, v.where("vec_id = 0").select(F.col("embedding").alias("v")), 10)


@query("SELECT vec_id, round(1 - distance, 6) AS similarity FROM (SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10)")
def semantic_search(spark, d):
    return vector_top10(spark, d).select("vec_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


# --- scalars -------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT id, complexity, coalesce({case_sql('lower(' + trim_sql('complexity') + ')', fixed.COMPLEXITY_ALIASES)}, CASE WHEN try_cast({trim_sql('complexity')} AS DOUBLE) < 1 THEN 'moderate' WHEN try_cast({trim_sql('complexity')} AS DOUBLE) <= 3 THEN 'simple' WHEN try_cast({trim_sql('complexity')} AS DOUBLE) <= 6 THEN 'moderate' WHEN try_cast({trim_sql('complexity')} AS DOUBLE) > 6 THEN 'complex' END, 'moderate') AS bucket FROM n", NODES)
def scalar_complexity(spark, d):
    return nodes_of(spark, d).select("id", "complexity", scalars.normalize_complexity(F.col("complexity")).alias("bucket"))


@query(f"SELECT pos, {canonical_id_sql('id')} AS canonical, {_mid('id')} AS merged FROM nodes")
def scalar_ids(spark, d):
    return table(spark, d, "nodes").select("pos", canonical_id(F.col("id")).alias("canonical"), scalars.merge_id(squeeze(F.col("id"))).alias("merged"))


_EXT = r"lower(regexp_extract(replace(path, '\', '/'), '\.([^./]+)$', 1))"
_BASE = r"split_part(replace(path, '\', '/'), '/', -1)"
_LOWP = "lower(path)"
_LOWB = "split_part(lower(path), '/', -1)"
_CAT = f"CASE WHEN {' OR '.join(f'ends_with({_LOWP}, {s!r})' for s in fixed.DOC_SUFFIXES)} THEN 'doc' WHEN {' OR '.join(f'ends_with({_LOWP}, {s!r})' for s in fixed.DATA_SUFFIXES)} THEN CASE WHEN {_LOWB} IN ({', '.join(repr(x) for x in fixed.MANIFEST_NAMES)}) THEN 'config' ELSE 'data' END WHEN contains({_LOWP}, '/test/') OR contains({_LOWP}, '/tests/') OR contains({_LOWP}, '/__tests__/') OR contains({_LOWB}, 'test') OR contains({_LOWB}, 'spec') THEN 'test' WHEN {_LOWB} IN ({', '.join(repr(x) for x in fixed.CONFIG_NAMES)}) THEN 'config' ELSE 'source' END"


@query(f"SELECT file_id, coalesce({case_sql('lower(' + _BASE + ')', fixed.LANGUAGE_FILENAMES)}, {case_sql(_EXT, fixed.LANGUAGE_EXTENSIONS)}) AS detected, {case_sql('lower(language)', fixed.LANGUAGE_ALIASES)} AS canonical, {_CAT} AS category FROM source_files")
def scalar_languages(spark, d):
    return table(spark, d, "source_files").select(
        "file_id", scalars.language_of(F.col("path")).alias("detected"), scalars.canonical_language(F.col("language")).alias("canonical"), scalars.file_category(F.col("path")).alias("category")
    )


_ENTRY = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(p), {w!r})' for w in words)} THEN '{k}'" for k, words in fixed.ENTRY_TYPES) + " END"


@query(f"SELECT p AS path, {_tld('p')} AS domain, {_ENTRY} AS entry_type, regexp_replace(p, '/?[^/]*$', '') AS directory FROM (SELECT DISTINCT regexp_replace(replace(path, '\\', '/'), '^(?:\\./)+', '') AS p FROM source_files)")
def scalar_paths(spark, d):
    paths = table(spark, d, "source_files").select(canonical_path(F.col("path")).alias("path")).distinct()
    return paths.select("path", scalars.top_level_domain(F.col("path")).alias("domain"), scalars.entry_type(F.col("path")).alias("entry_type"), dirname(F.col("path")).alias("directory"))


_NT = f"nt AS (SELECT id, CASE WHEN t = '' THEN 'node:' || id ELSE t END AS text FROM (SELECT id, concat_ws(' :: ', nullif({trim_sql('name')}, ''), nullif({trim_sql('summary')}, ''), nullif({trim_sql(chr(39).join(['array_to_string(tags, ', ',', ')']))}, '')) AS t FROM n))"


@query("SELECT id, sha256(text) AS hash FROM nt", NODES, _NT)
def node_text_hash(spark, d):
    return nodes_of(spark, d).select("id", scalars.text_hash(scalars.node_text(F.col("id"), F.col("name"), F.col("summary"), F.col("tags"))).alias("hash"))


@query("SELECT file_id, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END AS lines, len(list_filter(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')) AS filled FROM source_files WHERE content IS NOT NULL")
def line_counts(spark, d):
    c = F.col("content")
    return table(spark, d, "source_files").where("content is not null").select("file_id", scalars.line_count(c).alias("lines"), scalars.filled_lines(c).alias("filled"))


@query("SELECT file_id, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS excerpt FROM source_files WHERE content IS NOT NULL")
def source_slice(spark, d):
    return table(spark, d, "source_files").where("content is not null").select("file_id", F.array_join(F.slice(F.split("content", "\n"), 2, 3), "\n").alias("excerpt"))


@query("SELECT request_id, CASE WHEN length(content) > 8000 THEN substr(content, 1, 8000) || chr(10) || '[... truncated ...]' ELSE content END AS prompt FROM summary_requests WHERE content IS NOT NULL")
def summary_prompts(spark, d):
    return table(spark, d, "summary_requests").where("content is not null").select("request_id", scalars.trim_for_prompt(F.col("content"), fixed.PROMPT_CHARS).alias("prompt"))


@query("SELECT project, CASE WHEN sum(l) < 5000 THEN 'small' WHEN sum(l) < 50000 THEN 'medium' ELSE 'large' END AS size FROM (SELECT project, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END AS l FROM source_files WHERE content IS NOT NULL) GROUP BY 1")
def project_sizes(spark, d):
    rows = table(spark, d, "source_files").where("content is not null").groupBy("project").agg(F.sum(scalars.line_count(F.col("content"))).alias("l"))
    return rows.select("project", scalars.size_bucket(F.col("l")).alias("size"))


@query(f"SELECT project, {_CAT} AS category, count(*) AS files FROM source_files GROUP BY ALL")
def project_categories(spark, d):
    return table(spark, d, "source_files").groupBy("project", scalars.file_category(F.col("path")).alias("category")).agg(F.count("*").alias("files"))


@query(f"SELECT project, array_to_string(list_sort(list(DISTINCT l)), ',') AS languages FROM (SELECT project, coalesce({case_sql('lower(' + _BASE + ')', fixed.LANGUAGE_FILENAMES)}, {case_sql(_EXT, fixed.LANGUAGE_EXTENSIONS)}) AS l FROM source_files) WHERE l IS NOT NULL GROUP BY 1")
def project_languages(spark, d):
    rows = table(spark, d, "source_files").select("project", scalars.language_of(F.col("path")).alias("l")).where("l is not null")
    return rows.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("l")), ",").alias("languages"))


@query("SELECT name, CASE WHEN git_commit_hash IS NULL THEN 'no_graph' WHEN git_commit_hash = (SELECT max(git_commit_hash) FROM projects) THEN 'fresh' ELSE 'stale' END AS status FROM projects")
def staleness_status(spark, d):
    p = table(spark, d, "projects")
    head = p.agg(F.max("git_commit_hash")).first()[0]
    return p.select("name", scalars.staleness(F.col("git_commit_hash"), F.lit(head)).alias("status"))


# --- incremental ---------------------------------------------------------------------------------------------------------------------

_SNAP = r"b AS (SELECT project, regexp_replace(replace(regexp_replace(path, '^\s+|\s+$', '', 'g'), '\', '/'), '^(?:\./)+', '') AS path, sha256(arg_min(content, {scanned_at, file_id})) AS was, sha256(arg_max(content, {scanned_at, file_id})) AS now, count(*) AS n FROM source_files WHERE content IS NOT NULL GROUP BY 1, 2), ch AS (SELECT project, path, CASE WHEN n = 1 THEN 'new' WHEN was <> now THEN 'changed' ELSE 'same' END AS change FROM b)".replace(
    "{scanned_at, file_id}", "struct_pack(a := scanned_at, b := file_id)"
)


@query("SELECT project, path, change FROM ch", _SNAP)
def file_changes(spark, d):
    return incremental.changes(*incremental.snapshots(table(spark, d, "source_files")))


@query(
    f"SELECT c.project, c.changed, c.new, c.deleted, coalesce(s.nodes, 0) AS nodes, coalesce(f.dirs, 0) AS new_directories, CASE WHEN changed + new + deleted = 0 THEN 'SKIP' WHEN changed + new + deleted > {fixed.FULL_THRESHOLD} OR (coalesce(s.nodes, 0) >= {fixed.BIG_GRAPH} AND 2 * (changed + new + deleted) > coalesce(s.nodes, 0)) THEN 'FULL' WHEN coalesce(f.dirs, 0) > 0 THEN 'ARCHITECTURE' ELSE 'PARTIAL' END AS action FROM (SELECT project, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'new') AS new, 0::BIGINT AS deleted FROM ch GROUP BY 1) c LEFT JOIN (SELECT project, count(*) AS nodes FROM n GROUP BY 1) s USING (project) LEFT JOIN (SELECT project, count(*) AS dirs FROM (SELECT DISTINCT project, regexp_replace(path, '/?[^/]*$', '') AS dir FROM ch WHERE change = 'new') a WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.change <> 'new' AND ch.project = a.project AND regexp_replace(ch.path, '/?[^/]*$', '') = a.dir) GROUP BY 1) f USING (project)",
    NODES,
    _SNAP,
)
def change_plan(spark, d):
    changed = incremental.changes(*incremental.snapshots(table(spark, d, "source_files")))
    return incremental.plan(changed, nodes_of(spark, d))


@query("SELECT e.source, e.target, e.type FROM e SEMI JOIN kept a ON a.id = e.source WHERE e.target IN (SELECT id FROM kept)", NODES, EDGES, _SNAP, "kept AS (SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM ch WHERE change = 'changed' AND ch.project = n.project AND ch.path = n.file_path))")
def partial_update(spark, d):
    changed = incremental.changes(*incremental.snapshots(table(spark, d, "source_files"))).where("change = 'changed'").select("project", F.col("path").alias("file_path"))
    return incremental.drop_paths(nodes_of(spark, d), edges_of(spark, d), changed)[1].select("source", "target", "type")


@query("SELECT node_id, model, updated_at FROM (SELECT node_id, model, max(updated_at) AS updated_at FROM node_vectors GROUP BY 1, 2)")
def embedding_upsert(spark, d):
    v = table(spark, d, "node_vectors").select("node_id", "model", "updated_at")
    return incremental.upsert(v, v, ["node_id", "model"], "updated_at")


@query("SELECT model, count(*) AS vectors, count(DISTINCT node_id) AS nodes FROM node_vectors GROUP BY 1")
def embedding_counts(spark, d):
    return table(spark, d, "node_vectors").groupBy("model").agg(F.count("*").alias("vectors"), F.countDistinct("node_id").alias("nodes"))


@query(f"SELECT v.vec_id FROM node_vectors v WHERE {canonical_id_sql('v.node_id')} NOT IN (SELECT {canonical_id_sql('id')} FROM node_tombstones)")
def embedding_forget(spark, d):
    v = table(spark, d, "node_vectors").select("vec_id", canonical_id(F.col("node_id")).alias("id"))
    return incremental.forget(v, table(spark, d, "node_tombstones").select(canonical_id(F.col("id")).alias("id")), ["id"]).select("vec_id")


@query("SELECT c.node_id, 'm' AS model, c.hash AS text_hash FROM (SELECT id AS node_id, sha256(text) AS hash FROM nt) c LEFT JOIN (SELECT node_id, max(text_hash) AS stored FROM node_vectors WHERE model = 'lumen-64' GROUP BY 1) s USING (node_id) WHERE s.stored IS NULL OR s.stored <> c.hash", NODES, _NT)
def embed_work(spark, d):
    now = node_text_hash(spark, d).select(F.col("id").alias("node_id"), F.lit("m").alias("model"), F.col("hash").alias("text_hash"))
    stored = table(spark, d, "node_vectors").where("model = 'lumen-64'").groupBy("node_id").agg(F.max("text_hash").alias("text_hash")).withColumn("model", F.lit("m"))
    return incremental.embed_work(now, stored)


# --- streams, as batches -------------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS changes FROM events GROUP BY ALL")
def change_volume(spark, d):
    return changes.volume(table(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "changes")


@query(
    "SELECT event_type, min(ts) AS session_start, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_type, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY event_type ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY event_type, s"
)
def debounce_sessions(spark, d):
    return changes.sessions(table(spark, d, "events")).select("event_type", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "events")


QUERIES, ORACLE = Q, S
