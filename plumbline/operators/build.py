"""Derived graphs: domains, knowledge articles, tours; normalisation and merging of graphs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.ids import basename, canonical_id, is_reference, squeeze
from plumbline.operators.search import batches
from plumbline.operators.skew import join_ends
from plumbline.session import cut_lineage
from plumbline.functions.scalars import body, entry_type, first_paragraph, merge_id, slug, slugify, title_of, top_level_domain, wikilinks


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def domain_graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Domains by top directory, a flow per file and a step per function or class of it, with contains_flow, flow_step and cross_domain edges."""
    files = nodes.where("type = 'file' and file_path is not null and file_path <> ''").select("id", "file_path", top_level_domain(F.col("file_path")).alias("domain"))
    domains = files.groupBy("domain").agg(F.count("*").alias("files")).select(
        F.concat(F.lit("domain:"), "domain").alias("id"), F.lit("domain").alias("type"), F.col("domain").alias("name"), F.lit(None).cast("string").alias("entry_type"), F.col("files").alias("parts")
    )
    paths = files.select("file_path", "domain").distinct()
    flows = paths.select(F.concat(F.lit("flow:"), "file_path").alias("id"), F.lit("flow").alias("type"), basename(F.col("file_path")).alias("name"), entry_type(F.col("file_path")).alias("entry_type"), F.lit(0).cast("bigint").alias("parts"))
    symbols = nodes.where("type in ('function', 'class')").select("file_path", "name").join(paths, "file_path")
    step_id = F.concat(F.lit("step:"), "domain", F.lit(":"), "file_path", F.lit(":"), slug(F.col("name")))
    steps = symbols.select(step_id.alias("id"), F.lit("step").alias("type"), "name", F.lit(None).cast("string").alias("entry_type"), F.lit(0).cast("bigint").alias("parts")).groupBy("id", "type", "entry_type", "parts").agg(F.min("name").alias("name"))
    all_nodes = domains.unionByName(flows).unionByName(steps)
    flow_edges = paths.select(F.concat(F.lit("domain:"), "domain").alias("source"), F.concat(F.lit("flow:"), "file_path").alias("target"), F.lit("contains_flow").alias("type"), F.lit(fixed.WEIGHTS["contains_flow"]).alias("weight"))
    step_edges = symbols.select(F.concat(F.lit("flow:"), "file_path").alias("source"), step_id.alias("target"), F.lit("flow_step").alias("type"), F.lit(fixed.WEIGHTS["flow_step"]).alias("weight"))
    a = files.select(F.col("id").alias("source"), F.col("domain").alias("da"))
    b = files.select(F.col("id").alias("target"), F.col("domain").alias("db"))
    across = edges.where("type = 'imports'").join(a, "source").join(b, "target").where("da <> db")
    cross = across.select(F.concat(F.lit("domain:"), "da").alias("source"), F.concat(F.lit("domain:"), "db").alias("target"), F.lit("cross_domain").alias("type"), F.lit(fixed.WEIGHTS["cross_domain"]).alias("weight"))
    return Graph(all_nodes, flow_edges.unionByName(step_edges).unionByName(cross).distinct())


def articles(docs: DataFrame) -> DataFrame:
    """(doc_id, slug, title, summary, links, category) of texts as wiki articles; the first heading or the id names them. Null texts give no row."""
    stem = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    title = title_of(F.col("text"), stem)
    category = F.regexp_extract(F.col("text"), r"^---\n(?s:.*?)\n?category:[ \t]*([^\n]*)", 1)
    return docs.where("text is not null").select(
        "doc_id", "source", title.alias("title"), slug(title).alias("slug"), first_paragraph(F.col("text")).alias("summary"), wikilinks(body(F.col("text"))).alias("links"), F.when(squeeze(category) != "", squeeze(category)).alias("category")
    )


def knowledge_graph(arts: DataFrame) -> DataFrame:
    """Edges (source, target, type, weight) of articles: cites by wikilink (slug first, else title) and categorized_under by category. Articles of one
    slug are one node; links to no article give no edge."""
    nodes = arts.groupBy("slug").agg(F.min("title").alias("title"))
    titles = nodes.groupBy(F.lower("title").alias("key")).agg(F.min("slug").alias("by_title"))
    links = arts.select("slug", F.explode("links").alias("link")).distinct()
    slugs = nodes.select(F.col("slug").alias("by_slug"))
    hit = links.join(slugs, slug(F.col("link")) == F.col("by_slug"), "left").join(titles, F.lower("link") == F.col("key"), "left")
    cites = hit.select(F.col("slug").alias("a"), F.coalesce("by_slug", "by_title").alias("b")).where("b is not null and a <> b").distinct()
    cited = cites.select(F.concat(F.lit("article:"), "a").alias("source"), F.concat(F.lit("article:"), "b").alias("target"), F.lit("cites").alias("type"), F.lit(fixed.WEIGHTS["cites"]).alias("weight"))
    topics = arts.where("category is not null").select(F.concat(F.lit("article:"), "slug").alias("source"), F.concat(F.lit("topic:"), slugify(F.col("category"))).alias("target"), F.lit("categorized_under").alias("type"), F.lit(fixed.WEIGHTS["categorized_under"]).alias("weight"))
    return cited.unionByName(topics).distinct()


def backlinks(cites: DataFrame) -> DataFrame:
    """(id, source): a row per link to an article, so that a much-cited one needs no row of its own size."""
    return cites.where("type = 'cites'").select(F.col("target").alias("id"), "source")


def tour_nodes(levels: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(step, title, rank, id): the tour as a row per node. Steps are the layers in order of their first node (by level, then id; nodes on cycles last), then
    ``Supporting Components`` for nodes of no layer, then ``Key Concepts``. Without layers, steps of three nodes each in that order. rank orders a step's nodes."""
    order = F.struct(F.coalesce("level", F.lit(1 << 30)).alias("level"), "id")
    concepts = nodes.where("type = 'concept'").select(F.lit("Key Concepts").alias("title"), F.lit(2).alias("part"), F.struct(F.lit(0).alias("level"), "id").alias("rank"), "id")
    if members.isEmpty():
        flat = batches(levels.select("id", order.alias("rank")), "rank", 3)
        title = F.concat(F.lit("Step "), (F.col("batch") + 1).cast("string"), F.lit(": Code Walkthrough"))
        walked = flat.select((F.col("batch") + 1).cast("int").alias("step"), title.alias("title"), "rank", "id")
        count = walked.agg(F.coalesce(F.max("step"), F.lit(0)).alias("n")).first()["n"]
        return walked.unionByName(concepts.select(F.lit(count + 1).alias("step"), "title", "rank", "id"))
    placed = levels.join(members.select("id", "layer"), "id", "left")
    rows = placed.select(F.coalesce("layer", F.lit("Supporting Components")).alias("title"), F.when(F.col("layer").isNull(), 1).otherwise(0).alias("part"), order.alias("rank"), "id")
    rows = cut_lineage(rows.unionByName(concepts))
    # The window runs over the titles, which are as many as the layers.
    steps = rows.groupBy("part", "title").agg(F.min("rank").alias("first")).select("part", "title", F.row_number().over(Window.orderBy("part", "first", "title")).alias("step"))
    return rows.join(F.broadcast(steps), ["part", "title"]).select("step", "title", "rank", "id")


def tour(levels: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(step, title, nodes): tour_nodes()'s steps with the numbers of their nodes."""
    return tour_nodes(levels, members, nodes).groupBy("step", "title").agg(F.count("*").alias("nodes"))


class Normalised(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    statistics: DataFrame


def normalise(nodes: DataFrame, edges: DataFrame) -> Normalised:
    """Canonical ids, the last row of each node, rewritten endpoints, no dangling and no repeated edges; statistics of what was done."""
    raw = nodes.where(is_reference(F.col("id"))).select("pos", F.col("id").alias("raw"), canonical_id(F.col("id")).alias("id"), "type", "name", "complexity")
    kept = raw.groupBy("id").agg(F.max_by(F.struct("pos", "type", "name", "complexity"), "pos").alias("r")).select("id", "r.*")
    ends = edges.select("pos", F.col("source").alias("rs"), F.col("target").alias("rt"), canonical_id(F.col("source")).alias("source"), canonical_id(F.col("target")).alias("target"), "type")
    marked = join_ends(ends, kept.select("id", F.lit(1).alias("here")), {"here": "has_source"}, {"here": "has_target"}, "left")
    fine = marked.where("has_source = 1 and has_target = 1")
    first = fine.groupBy("source", "target", "type").agg(F.min("pos").alias("pos"))
    counts = marked.agg(
        F.sum(F.when(F.col("has_source").isNull(), 1).otherwise(0)).alias("missing_source"),
        F.sum(F.when(F.col("has_source").isNotNull() & F.col("has_target").isNull(), 1).otherwise(0)).alias("missing_target"),
        F.sum(F.when(~F.col("rs").eqNullSafe(F.col("source")) | ~F.col("rt").eqNullSafe(F.col("target")), 1).otherwise(0)).alias("edges_rewritten"),
    )
    ids = raw.agg(F.sum((F.col("raw") != F.col("id")).cast("int")).alias("ids_fixed"), F.count("*").alias("node_rows"))
    return Normalised(kept, first, ids.join(F.broadcast(counts)))


def merge_nodes(nodes: DataFrame, order: str = "pos") -> DataFrame:
    """Rows of one id merged field by field: the last non-blank value by ``order``, tags in order of appearance without repetition; the first type stays.
    Of ids that only differ in spelling the one with the longest summary (in bytes) stays whole, of equally long ones the smallest; ``rows`` counts those of all."""

    def last(c: str):
        return F.max_by(F.when(squeeze(F.col(c)) != "", F.col(c)), F.when(squeeze(F.col(c)) != "", F.col(order))).alias(c)

    rows = nodes.where(is_reference(F.col("id"))).withColumn("raw", squeeze(F.col("id")))
    merged = rows.groupBy("raw").agg(F.min_by("type", order).alias("type"), last("name"), last("summary"), last("file_path"), last("complexity"), F.count("*").alias("rows"))
    size = F.struct((-F.octet_length(F.coalesce("summary", F.lit("")))).alias("n"), F.col("raw").alias("r"))
    kept = merged.withColumn("id", merge_id(F.col("raw"))).groupBy("id").agg(F.min_by(F.struct("raw", "type", "name", "summary", "file_path", "complexity"), size).alias("k"), F.sum("rows").alias("rows"))
    kept = kept.select("id", "k.*", "rows")
    # Tags are reduced to their first place before a list is made, so a list is as long as its different tags, not as the rows.
    tags = rows.select("raw", order, F.posexplode("tags").alias("i", "tag")).where("tag is not null").groupBy("raw", "tag").agg(F.min(F.struct(order, "i")).alias("at"))
    lists = tags.groupBy("raw").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "tag"))), lambda x: x["tag"]), ",").alias("tags"))
    return kept.join(lists, "raw", "left").drop("raw").fillna("", ["tags"])


def merge_edges(edges: DataFrame) -> DataFrame:
    """The heaviest edge of each (source, target, type), the first of equal ones; NaN and null weights count least."""
    w = F.col("weight").cast("double")
    rows = edges.where(is_reference(F.col("source")) & is_reference(F.col("target"))).select(merge_id(squeeze(F.col("source"))).alias("source"), merge_id(squeeze(F.col("target"))).alias("target"), "type", F.when(w.isNull() | F.isnan(w), -1.0).otherwise(w).alias("w"), "pos")
    return rows.groupBy("source", "target", "type").agg(F.max(F.struct("w", (-F.col("pos")).alias("neg"))).alias("b"), F.count("*").alias("rows")).select("source", "target", "type", F.col("b.w").alias("weight"), (-F.col("b.neg")).alias("pos"), "rows")
