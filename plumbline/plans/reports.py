"""Text reports over small results: diff, explanation, onboarding guide, chat context. What is rendered is limited, the queries are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import Blast, Neighbourhood

#: Rows of a section of a report.
SHOWN = 50


def _bullets(rows: list[str]) -> str:
    return "\n".join(f"- {r}" for r in rows) if rows else "- none"


def _names(nodes: DataFrame, ids: DataFrame) -> list[str]:
    rows = nodes.join(ids.select("id"), "id", "left_semi").orderBy("id").limit(SHOWN).select("name", "type", "summary").collect()
    return [f"{r.name} ({r.type}): {r.summary or ''}".rstrip(": ") for r in rows]


def risk_flags(changed: DataFrame, affected: DataFrame, unmapped: DataFrame, nodes: DataFrame, members: DataFrame) -> list[str]:
    """What makes a change risky; a low risk if nothing does."""
    c = nodes.join(changed.select("id"), "id", "left_semi").agg(F.count(F.when(F.col("complexity") == "complex", 1))).first()[0]
    layers = members.join(changed.select("id"), "id", "left_semi").select("layer_id").distinct().count()
    a, u = affected.count(), unmapped.count()
    flags = [
        f"{c} complex components changed" if c else "",
        f"changes span {layers} layers" if layers > 1 else "",
        f"{a} components affected" if a > 5 else "",
        f"{u} files are in no graph" if u else "",
    ]
    return [f for f in flags if f] or ["low risk"]


def diff_report(blast: Blast, nodes: DataFrame, members: DataFrame) -> str:
    flags = risk_flags(blast.changed, blast.affected, blast.unmapped, nodes, members)
    unmapped = [r[0] for r in blast.unmapped.orderBy("file_path").limit(SHOWN).collect()]
    return "\n\n".join(
        ["# Change report", "## Changed\n" + _bullets(_names(nodes, blast.changed)), "## Affected\n" + _bullets(_names(nodes, blast.affected)), "## Not in the graph\n" + _bullets(unmapped), "## Risk\n" + _bullets(flags)]
    )


def explain_report(around: Neighbourhood, nodes: DataFrame) -> str:
    parts = [f"## {title}\n" + _bullets(_names(nodes, around.nodes.where(F.col("role") == role))) for role, title in (("target", "Component"), ("child", "Contains"), ("connected", "Connected"))]
    links = around.edges.where("type <> 'contains'").orderBy("source", "target", "type").limit(SHOWN).collect()
    return "\n\n".join(["# Explanation", *parts, "## Relations\n" + _bullets([f"{r.source} {r.type} {r.target}" for r in links])])


def onboarding(nodes: DataFrame, members: DataFrame, tour: DataFrame) -> str:
    layers = members.groupBy("layer").agg(F.count("*").alias("n")).orderBy("layer").collect()
    steps = tour.orderBy("step").limit(SHOWN).collect()
    hot = nodes.where("complexity = 'complex'").select("id")
    return "\n\n".join(
        [
            "# Guide",
            "## Architecture\n" + _bullets([f"{r.layer}: {r.n} files" for r in layers]),
            "## Concepts\n" + _bullets(_names(nodes, nodes.where("type = 'concept'").select("id"))),
            "## Tour\n" + _bullets([f"{r.step}. {r.title} ({r.nodes})" for r in steps]),
            "## Hotspots\n" + _bullets(_names(nodes, hot)),
        ]
    )


def chat_prompt(question: str, hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> str:
    from plumbline.operators.graph import induced

    links = induced(edges, hits).orderBy("source", "target", "type").limit(SHOWN).collect()
    return "\n\n".join(["## Components\n" + _bullets(_names(nodes, hits)), "## Relations\n" + _bullets([f"{r.source} {r.type} {r.target}" for r in links]), f"## Question\n{question}"])
