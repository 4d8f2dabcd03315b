"""Queries over the graph views: filters, joins, aggregates, traversals, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.scalars import one_of
from plumbline.operators import graph, layers
from plumbline.operators.skew import join_ends
from plumbline.plans.common import EDGES, LAYER_A, LAYER_B, MEMBERS, NODES, case_sql, edges_of, members_of, nodes_of, sql

Q: dict = {}
S: dict = {}
#: Columns of an edge in results.
EDGE = ("source", "target", "type")


def query(text: str | None = None, *parts: str):
    """Register a query under its function's name, with its oracle."""

    def register(f):
        Q[f.__name__] = f
        if text is not None:
            S[f.__name__] = sql(text, *parts) if parts else text
        return f

    return register


def _category(c) -> F.Column:
    return one_of(c, fixed.EDGE_CATEGORIES)


def hub(spark: SparkSession, d: str) -> DataFrame:
    """The node of the highest degree, of several the smallest id: one row."""
    return degrees(spark, d).join(nodes_of(spark, d).select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(1).select("id")


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(spark, d).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


HUB = "hub AS (SELECT id FROM (SELECT unnest([source, target]) AS id FROM e) SEMI JOIN n USING (id) GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)"


@query("SELECT id, type, name, file_path, complexity FROM n", NODES)
def graph_nodes(spark, d):
    return nodes_of(spark, d).select("id", "type", "name", "file_path", "complexity")


@query("SELECT source, target, type, coalesce(direction, 'forward') AS direction FROM e", EDGES)
def graph_edges(spark, d):
    return edges_of(spark, d).select(*EDGE, F.coalesce("direction", F.lit("forward")).alias("direction"))


@query("SELECT source, target, type FROM e SEMI JOIN n ON e.source = n.id WHERE target IN (SELECT id FROM n)", NODES, EDGES)
def bulk_load_edges(spark, d):
    return graph.induced(edges_of(spark, d), nodes_of(spark, d)).select(*EDGE)


@query("SELECT kind, count(*) AS edges FROM e GROUP BY kind", EDGES)
def kind_slots(spark, d):
    return edges_of(spark, d).groupBy("kind").agg(F.count("*").alias("edges"))


@query("SELECT id, name FROM n WHERE id IN (SELECT id FROM m WHERE layer_id = 'layer:data-layer') AND type = 'file' AND (contains(lower(name), 'ledger') OR contains(lower(coalesce(summary, '')), 'ledger') OR len(list_filter(tags, lambda t: contains(lower(t), 'ledger'))) > 0)", NODES, MEMBERS)
def node_list_filtered(spark, d):
    low = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("ledger")
    rows = nodes_of(spark, d).where("type = 'file'").join(members_of(spark, d).where(F.col("layer_id") == LAYER_A).select("id"), "id", "left_semi")
    return rows.where(low("name") | low("summary") | F.exists("tags", lambda t: F.coalesce(F.lower(t).contains("ledger"), F.lit(False)))).select("id", "name")


@query("SELECT pos, id, (SELECT count(*) FROM n WHERE type = 'function') AS total FROM n WHERE type = 'function' ORDER BY pos LIMIT 250 OFFSET 50", NODES)
def node_list_page(spark, d):
    rows = nodes_of(spark, d).where("type = 'function'")
    total = rows.count()
    return rows.select("pos", "id", F.lit(total).alias("total")).orderBy("pos").offset(50).limit(fixed.PAGE_LIMIT)


@query("SELECT source, target FROM e WHERE type = 'calls' AND target IN (SELECT id FROM hub)", NODES, EDGES, HUB)
def edge_list_filtered(spark, d):
    return edges_of(spark, d).where("type = 'calls'").join(F.broadcast(hub(spark, d).withColumnRenamed("id", "target")), "target", "left_semi").select("source", "target")


@query("SELECT id, type, name FROM n WHERE id IN (SELECT id FROM hub)", NODES, EDGES, HUB)
def node_by_id(spark, d):
    return nodes_of(spark, d).join(F.broadcast(hub(spark, d)), "id", "left_semi").select("id", "type", "name")


@query("SELECT id, type, complexity FROM n WHERE type IN ('file', 'class') AND complexity IN ('simple', 'complex')", NODES)
def facet_filter_nodes(spark, d):
    return nodes_of(spark, d).where(F.col("type").isin("file", "class") & F.col("complexity").isin("simple", "complex")).select("id", "type", "complexity")


@query(
    f"SELECT source, target, type FROM e WHERE {case_sql('type', fixed.EDGE_CATEGORIES)} IN ('structural', 'behavioral') AND source IN (SELECT id FROM n WHERE type IN ('file', 'class')) AND target IN (SELECT id FROM n WHERE type IN ('file', 'class'))",
    NODES,
    EDGES,
)
def facet_filter_edges(spark, d):
    seen = nodes_of(spark, d).where(F.col("type").isin("file", "class"))
    return graph.induced(edges_of(spark, d).where(_category(F.col("type")).isin("structural", "behavioral")), seen).select(*EDGE)


@query("SELECT source, target, type FROM e WHERE source IN (SELECT id FROM n WHERE type NOT IN ('function', 'class')) AND target IN (SELECT id FROM n WHERE type NOT IN ('function', 'class'))", NODES, EDGES)
def persona_nontechnical(spark, d):
    return graph.induced(edges_of(spark, d), nodes_of(spark, d).where(~F.col("type").isin("function", "class"))).select(*EDGE)


@query("SELECT e.source, e.target, e.type, CASE WHEN s.id IS NULL THEN 'missing_source' ELSE 'missing_target' END AS reason FROM e LEFT JOIN n s ON s.id = e.source LEFT JOIN n t ON t.id = e.target WHERE s.id IS NULL OR t.id IS NULL", NODES, EDGES)
def dangling_reasons(spark, d):
    j = join_ends(edges_of(spark, d).select(*EDGE), nodes_of(spark, d).select("id", F.lit(1).alias("here")), {"here": "s"}, {"here": "t"}, "left")
    return j.where("s is null or t is null").select(*EDGE, F.when(F.col("s").isNull(), "missing_source").otherwise("missing_target").alias("reason"))


@query("SELECT e.source, e.target, e.type, coalesce(s.name, e.source) AS source_name, coalesce(t.name, e.target) AS target_name FROM e LEFT JOIN n s ON s.id = e.source LEFT JOIN n t ON t.id = e.target", NODES, EDGES)
def edge_names(spark, d):
    j = join_ends(edges_of(spark, d).select(*EDGE), nodes_of(spark, d).select("id", "name"), {"name": "sn"}, {"name": "tn"}, "left")
    return j.select(*EDGE, F.coalesce("sn", "source").alias("source_name"), F.coalesce("tn", "target").alias("target_name"))


@query("SELECT type, count(*) AS nodes FROM n GROUP BY type", NODES)
def node_type_counts(spark, d):
    return nodes_of(spark, d).groupBy("type").agg(F.count("*").alias("nodes"))


@query("SELECT type, count(*) AS edges FROM e GROUP BY type", EDGES)
def edge_type_counts(spark, d):
    return edges_of(spark, d).groupBy("type").agg(F.count("*").alias("edges"))


@query(f"SELECT {case_sql('type', fixed.EDGE_CATEGORIES)} AS category, count(*) AS edges FROM e GROUP BY 1", EDGES)
def edge_category_counts(spark, d):
    return edges_of(spark, d).groupBy(_category(F.col("type")).alias("category")).agg(F.count("*").alias("edges"))


@query(f"SELECT {case_sql('type', fixed.NODE_CATEGORY)} AS category, count(*) AS nodes FROM n GROUP BY 1", NODES)
def category_rollup(spark, d):
    by_category: dict[str, tuple[str, ...]] = {}
    for t, c in fixed.NODE_CATEGORY.items():
        by_category[c] = (*by_category.get(c, ()), t)
    return nodes_of(spark, d).groupBy(one_of(F.col("type"), by_category).alias("category")).agg(F.count("*").alias("nodes"))


@query("SELECT count(*) FILTER (complexity = 'simple') AS simple, count(*) FILTER (complexity = 'moderate') AS moderate, count(*) FILTER (complexity = 'complex') AS complex FROM n", NODES)
def complexity_histogram(spark, d):
    return nodes_of(spark, d).agg(*[F.count(F.when(F.col("complexity") == c, 1)).alias(c) for c in fixed.COMPLEXITY_ALIASES])


@query("SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, round(2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM n), 1) AS average", NODES, EDGES)
def graph_totals(spark, d):
    both = nodes_of(spark, d).select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges_of(spark, d).select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges")).withColumn("average", F.round(2.0 * F.col("edges") / F.col("nodes"), 1))


@query("SELECT id, count(*) AS degree FROM (SELECT unnest([source, target]) AS id FROM e) GROUP BY id ORDER BY degree DESC, id LIMIT 5", EDGES)
def degree_top(spark, d):
    return degrees(spark, d).orderBy(F.desc("degree"), "id").limit(5)


@query("SELECT id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM (SELECT target AS id, count(DISTINCT source) AS fan_in FROM e GROUP BY 1) FULL JOIN (SELECT source AS id, count(DISTINCT target) AS fan_out FROM e GROUP BY 1) USING (id) ORDER BY coalesce(fan_in, 0) DESC, id LIMIT 20", EDGES)
def fan_in_out_top(spark, d):
    e = edges_of(spark, d).select("source", "target").distinct()
    fan_in, fan_out = e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in")), e.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("fan_out"))
    both = fan_in.join(fan_out, "id", "full_outer").fillna(0, ["fan_in", "fan_out"])
    return both.orderBy(F.desc("fan_in"), "id").limit(20)


@query("SELECT a.type AS from_type, b.type AS to_type, e.type AS edge_type, count(*) AS edges FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target GROUP BY ALL", NODES, EDGES)
def type_matrix(spark, d):
    e = edges_of(spark, d).select("source", "target", F.col("type").alias("edge_type"))
    j = join_ends(e, nodes_of(spark, d).select("id", "type"), {"type": "from_type"}, {"type": "to_type"})
    return j.groupBy("from_type", "to_type", "edge_type").agg(F.count("*").alias("edges"))


@query("SELECT round(count(*) FILTER (length(trim(coalesce(summary, ''))) > 0)::DOUBLE / count(*), 4) AS documented FROM n WHERE type IN ('file', 'function', 'class')", NODES)
def doc_coverage(spark, d):
    rows = nodes_of(spark, d).where(F.col("type").isin("file", "function", "class"))
    return rows.agg(F.round(F.count(F.when(F.length(F.trim(F.coalesce("summary", F.lit("")))) > 0, 1)) / F.count("*"), 4).alias("documented"))


# --- layers --------------------------------------------------------------------------------------------------------------------------


@query("SELECT id, layer_id, layer FROM m", NODES, MEMBERS)
def layer_detect(spark, d):
    return members_of(spark, d)


@query(
    "SELECT layer_id, layer, count(*) AS members, CASE WHEN avg((complexity = 'complex')::INT) > 0.3 THEN 'complex' WHEN sum((coalesce(complexity, '') = 'moderate')::INT) / count(*) > 0.3 THEN 'moderate' ELSE 'simple' END AS complexity FROM m JOIN (SELECT id, coalesce(complexity, '') AS complexity FROM n) USING (id) GROUP BY ALL",
    NODES,
    MEMBERS,
)
def layer_complexity(spark, d):
    return layers.layer_table(members_of(spark, d), nodes_of(spark, d))


_LE = "le AS (SELECT least(a.layer_id, b.layer_id) AS layer_a, greatest(a.layer_id, b.layer_id) AS layer_b, count(*) AS edges, array_to_string(list_sort(list(DISTINCT e.type)), ',') AS types FROM e JOIN m a ON a.id = e.source JOIN m b ON b.id = e.target WHERE a.layer_id <> b.layer_id GROUP BY 1, 2)"


@query("SELECT * FROM le", NODES, EDGES, MEMBERS, _LE)
def layer_edge_aggregation(spark, d):
    return layers.layer_edges(members_of(spark, d), edges_of(spark, d))


@query(f"SELECT CASE WHEN layer_a = '{LAYER_A}' THEN layer_b ELSE layer_a END AS layer_id, sum(edges)::BIGINT AS edges FROM le WHERE '{LAYER_A}' IN (layer_a, layer_b) GROUP BY 1", NODES, EDGES, MEMBERS, _LE)
def portals(spark, d):
    return layers.portals(members_of(spark, d), edges_of(spark, d), LAYER_A)


@query(f"SELECT DISTINCT unnest([source, target]) AS id FROM e JOIN m a ON a.id = e.source JOIN m b ON b.id = e.target WHERE (a.layer_id = '{LAYER_A}' AND b.layer_id = '{LAYER_B}') OR (a.layer_id = '{LAYER_B}' AND b.layer_id = '{LAYER_A}')", NODES, EDGES, MEMBERS)
def cross_layer_nodes(spark, d):
    return layers.cross_layer_nodes(members_of(spark, d), edges_of(spark, d), LAYER_A, LAYER_B)


@query("SELECT id, CASE WHEN starts_with(coalesce(file_path, ''), 'src/api/') OR contains(coalesce(file_path, ''), '/src/api/') THEN 'API' WHEN starts_with(coalesce(file_path, ''), 'lib/') OR contains(coalesce(file_path, ''), '/lib/') THEN 'Libraries' ELSE 'Other' END AS layer FROM n WHERE type = 'file'", NODES)
def layer_patterns_apply(spark, d):
    return layers.apply_patterns(nodes_of(spark, d), [("API", ["src/api/"]), ("Libraries", ["lib/"])])


@query(f"SELECT DISTINCT id FROM (SELECT id FROM m WHERE layer_id = '{LAYER_A}' UNION ALL SELECT target FROM e WHERE type = 'contains' AND source IN (SELECT id FROM m WHERE layer_id = '{LAYER_A}')) SEMI JOIN n USING (id)", NODES, EDGES, MEMBERS)
def layer_drilldown(spark, d):
    own = members_of(spark, d).where(F.col("layer_id") == LAYER_A).select("id")
    held = edges_of(spark, d).where("type = 'contains'").join(own.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    return own.unionByName(held).distinct().join(nodes_of(spark, d).select("id"), "id", "left_semi")


# --- traversals ----------------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT id, 1 AS depth FROM (SELECT target AS id FROM e WHERE source IN (SELECT id FROM hub) UNION ALL SELECT source FROM e WHERE target IN (SELECT id FROM hub)) SEMI JOIN n USING (id) WHERE id NOT IN (SELECT id FROM hub)", NODES, EDGES, HUB)
def neighbors_1(spark, d):
    return graph.neighbours(nodes_of(spark, d), edges_of(spark, d), hub(spark, d), 1).nodes.select("id", "depth")


_RING = "und AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), w AS (SELECT id, min(depth) AS depth FROM (SELECT id, 0 AS depth FROM hub UNION ALL SELECT b, 1 FROM und JOIN hub ON a = id UNION ALL SELECT y.b, 2 FROM und x JOIN hub ON x.a = id JOIN und y ON y.a = x.b) GROUP BY id)"


@query("SELECT id, depth FROM w SEMI JOIN n USING (id) WHERE depth > 0", NODES, EDGES, HUB, _RING)
def neighbors_2(spark, d):
    return graph.neighbours(nodes_of(spark, d), edges_of(spark, d), hub(spark, d), 2).nodes.select("id", "depth")


@query("SELECT source, target, type FROM e WHERE source IN (SELECT id FROM w WHERE depth < 2) OR target IN (SELECT id FROM w WHERE depth < 2)", NODES, EDGES, HUB, _RING)
def neighbor_edges_2(spark, d):
    return graph.neighbours(nodes_of(spark, d), edges_of(spark, d), hub(spark, d), 2).edges.select(*EDGE)


@query("SELECT target, type FROM e WHERE source IN (SELECT id FROM hub)", NODES, EDGES, HUB)
def outgoing(spark, d):
    row = hub(spark, d).first()
    return graph.outgoing(edges_of(spark, d), row["id"] if row else "")


@query("SELECT id, CASE min(rank) WHEN 0 THEN 'target' WHEN 1 THEN 'child' ELSE 'connected' END AS role FROM (SELECT id, 0 AS rank FROM hub UNION ALL SELECT id, 1 FROM kids UNION ALL SELECT unnest([source, target]), 2 FROM e WHERE source IN (SELECT id FROM inn) OR target IN (SELECT id FROM inn)) SEMI JOIN n USING (id) GROUP BY id", NODES, EDGES, HUB, "kids AS (SELECT target AS id FROM e WHERE type = 'contains' AND source IN (SELECT id FROM hub)), inn AS (SELECT id FROM hub UNION SELECT id FROM kids)")
def explain(spark, d):
    row = hub(spark, d).first()
    return graph.explain(nodes_of(spark, d), edges_of(spark, d), row["id"] if row else "").nodes


_ENDS = "ends AS (SELECT id, row_number() OVER (ORDER BY degree DESC, id) AS rn FROM (SELECT id, count(*) AS degree FROM (SELECT unnest([source, target]) AS id FROM e) GROUP BY id) SEMI JOIN n USING (id) ORDER BY rn LIMIT 2), und AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e)"


@query("SELECT 1", NODES)
def shortest_path(spark, d):
    """The path between the two most linked nodes."""
    ends = [r["id"] for r in degrees(spark, d).join(nodes_of(spark, d).select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(2).collect()]
    path = graph.shortest_path(edges_of(spark, d), *ends) if len(ends) == 2 else []
    return spark.createDataFrame([(i, p) for i, p in enumerate(path)], "step int, id string")


@query("SELECT 1", NODES)
def topological_levels(spark, d):
    return graph.topological_levels(nodes_of(spark, d), edges_of(spark, d).where("type = 'imports'"))


@query("SELECT id, min(depth) AS depth FROM bfs GROUP BY id", NODES, EDGES, HUB, "RECURSIVE_PLACEHOLDER")
def import_reach(spark, d):
    """What the most linked node reaches over imports and calls."""
    return graph.reach(edges_of(spark, d), hub(spark, d), ("imports", "calls"))


# The distances to the goal, then from the start on always the smallest id that is one nearer to it.
S["shortest_path"] = "WITH RECURSIVE " + ",\n".join([NODES, EDGES, _ENDS, "far(id, depth) AS (SELECT id, 0 FROM ends WHERE rn = 2 UNION SELECT b, depth + 1 FROM far JOIN und ON a = id WHERE depth < 12), dist AS (SELECT id, min(depth) AS depth FROM far GROUP BY id), walk(step, id, rest) AS (SELECT 0, id, depth FROM dist WHERE id IN (SELECT id FROM ends WHERE rn = 1) UNION ALL SELECT w.step + 1, (SELECT min(und.b) FROM und JOIN dist ON dist.id = und.b WHERE und.a = w.id AND dist.depth = w.rest - 1), w.rest - 1 FROM walk w WHERE w.rest > 0)"]) + " SELECT step::INT AS step, id FROM walk"
# Walks of up to 60 steps from every node: the longest that ends at a node is its level, unless a cycle makes walks of any length.
S["topological_levels"] = "WITH RECURSIVE " + ",\n".join([NODES, EDGES, "u AS (SELECT DISTINCT source, target FROM e WHERE type = 'imports' AND source <> target AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)), w(id, depth) AS (SELECT id, 0 FROM n UNION SELECT target, depth + 1 FROM w JOIN u ON source = id WHERE depth < 60)"]) + " SELECT id, CASE WHEN max(depth) < 60 THEN max(depth) END AS level FROM w GROUP BY id"
S["import_reach"] = "WITH RECURSIVE " + ",\n".join([NODES, EDGES, HUB, "step AS (SELECT DISTINCT source, target FROM e WHERE type IN ('imports', 'calls')), bfs(id, depth) AS (SELECT id, 0 FROM hub UNION SELECT target, depth + 1 FROM bfs JOIN step ON source = id WHERE depth < 60)"]) + " SELECT id, min(depth) AS depth FROM bfs GROUP BY id"

_CHANGED = "paths AS (SELECT DISTINCT regexp_replace(replace(path, '\\', '/'), '^(?:\\./)+', '') AS file_path FROM source_files GROUP BY 1, project HAVING count(*) > 1), own AS (SELECT id FROM n SEMI JOIN paths USING (file_path)), changed AS (SELECT DISTINCT id FROM (SELECT id FROM own UNION ALL SELECT target FROM e WHERE type = 'contains' AND source IN (SELECT id FROM own)) SEMI JOIN n USING (id))"


def _rescanned(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.functions.ids import canonical_path
    from plumbline.sources.tables import table

    rows = table(spark, d, "source_files").groupBy("project", canonical_path(F.col("path")).alias("file_path")).count().where("count > 1")
    return rows.select("file_path").distinct()


@query("SELECT id FROM changed", NODES, EDGES, _CHANGED)
def diff_changed(spark, d):
    return graph.blast_radius(nodes_of(spark, d), edges_of(spark, d), _rescanned(spark, d)).changed


@query("SELECT DISTINCT id FROM (SELECT unnest([source, target]) AS id FROM e WHERE source IN (SELECT id FROM changed) OR target IN (SELECT id FROM changed)) SEMI JOIN n USING (id) WHERE id NOT IN (SELECT id FROM changed)", NODES, EDGES, _CHANGED)
def diff_affected(spark, d):
    return graph.blast_radius(nodes_of(spark, d), edges_of(spark, d), _rescanned(spark, d)).affected


@query("SELECT file_path FROM paths ANTI JOIN (SELECT file_path FROM n WHERE file_path IS NOT NULL) USING (file_path)", NODES, EDGES, _CHANGED)
def diff_unmapped(spark, d):
    return graph.blast_radius(nodes_of(spark, d), edges_of(spark, d), _rescanned(spark, d)).unmapped


@query("SELECT source, target, type, round(weight, 4) AS weight FROM e WHERE type = 'flow_step' ORDER BY weight, source, target", EDGES)
def flow_step_order(spark, d):
    return edges_of(spark, d).where("type = 'flow_step'").select(*EDGE, F.round("weight", 4).alias("weight")).orderBy("weight", "source", "target")


@query("SELECT a.source AS a, a.target AS b FROM p a JOIN p b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target", EDGES, "p AS (SELECT DISTINCT source, target FROM e WHERE type IN ('imports', 'calls'))")
def mutual_pairs(spark, d):
    p = edges_of(spark, d).where("type in ('imports', 'calls')").select("source", "target").distinct()
    q = p.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return p.join(q, ["source", "target"]).where("source < target").select(F.col("source").alias("a"), F.col("target").alias("b"))


@query("SELECT CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^([^/]+)/', 1) ELSE 'root' END AS directory, count(*) AS files FROM n WHERE type = 'file' AND file_path IS NOT NULL GROUP BY 1", NODES)
def directory_groups(spark, d):
    top = F.when(F.col("file_path").contains("/"), F.substring_index("file_path", "/", 1)).otherwise("root")
    return nodes_of(spark, d).where("type = 'file' and file_path is not null").groupBy(top.alias("directory")).agg(F.count("*").alias("files"))


@query("SELECT DISTINCT m.id, 'untagged' AS tags, 'moderate' AS complexity, 'No summary available' AS summary FROM (SELECT unnest([source, target]) AS id FROM e) m ANTI JOIN n USING (id)", NODES, EDGES)
def recover_dangling(spark, d):
    ends = edges_of(spark, d).select(F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes_of(spark, d).select("id"), "id", "left_anti")
    return ends.select("id", F.lit("untagged").alias("tags"), F.lit("moderate").alias("complexity"), F.lit("No summary available").alias("summary"))


QUERIES, ORACLE = Q, S
