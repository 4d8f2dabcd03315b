"""Scalar functions as column expressions; built-ins only, so they stay in whole-stage codegen. Nulls give null unless said otherwise."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.ids import TYPE_PREFIXES, basename, extension, squeeze


NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "plumbline.invalid")


def one_of(c: Column, table: dict[str, tuple[str, ...]], default: Column | None = None) -> Column:
    """The key of ``table`` whose values hold ``c``."""
    out = F.lit(None).cast("string") if default is None else default
    for key, values in reversed(table.items()):
        out = F.when(c.isin(list(values)), key).otherwise(out)
    return out


def alias_of(c: Column, aliases: dict[str, str]) -> Column:
    """``c`` in lower case, replaced by what it is an alias of."""
    low = F.lower(squeeze(c))
    by_target: dict[str, list[str]] = {}
    for a, t in aliases.items():
        by_target.setdefault(t, []).append(a)
    return one_of(low, {t: tuple(a) for t, a in by_target.items()}, low)


def normalize_complexity(c: Column) -> Column:
    """simple, moderate or complex from a word or a number; moderate for anything else, also null. Numbers of at least 1: up to 3 simple, up to 6 moderate."""
    word = F.lower(squeeze(c))
    number = word.try_cast("double")
    by_number = F.when(F.isnan(number) | (F.abs(number) == float("inf")) | (number < 1), "moderate").when(number <= 3, "simple").when(number <= 6, "moderate").otherwise("complex")
    return F.coalesce(one_of(word, fixed.COMPLEXITY_ALIASES), F.when(number.isNotNull(), by_number), F.lit("moderate"))


def infer_type(node_id: Column) -> Column:
    """The type that an id's prefix names, else ``file``."""
    prefix = F.substring_index(node_id, ":", 1)
    return F.when(node_id.contains(":") & prefix.isin([p for p in TYPE_PREFIXES if p != "func"]), prefix).when(prefix == "func", "function").otherwise("file")


def merge_id(c: Column) -> Column:
    """Id with a lower-case prefix and forward slashes, as graphs are merged."""
    head = F.substring_index(c, ":", 1)
    rest = F.replace(F.substring(c, F.length(head) + 1, F.length(c)), F.lit("\\"), F.lit("/"))
    return F.when(c.contains(":"), F.concat(F.lower(head), rest)).otherwise(F.replace(c, F.lit("\\"), F.lit("/")))


def slug(c: Column) -> Column:
    """Lower case, each white space a dash."""
    return F.regexp_replace(F.lower(c), r"\s", "-")


def slugify(c: Column) -> Column:
    """Lower case, each character that is neither letter, digit nor dash a dash."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}-]", "-")


def layer_id(name: Column) -> Column:
    return F.concat(F.lit("layer:"), slug(name))


def definition_type(kind: Column) -> Column:
    """Node type of a definition's kind, else concept."""
    return one_of(kind, fixed.DEFINITION_TYPES, F.lit("concept"))


def top_level_domain(path: Column) -> Column:
    """First directory of a path, or the second below src, lib and app; ``root`` for files at the top."""
    parts = F.split(F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")), "/")
    return F.when(F.size(parts) < 2, "root").when(parts[0].isin("src", "lib", "app"), parts[1]).otherwise(parts[0])


def entry_type(path: Column) -> Column:
    """Kind of entry point that a path suggests, or null."""
    low = F.lower(path)
    out = F.lit(None).cast("string")
    for kind, words in reversed(fixed.ENTRY_TYPES):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, kind).otherwise(out)
    return out


def language_of(path: Column) -> Column:
    """Language by file name, then by extension."""
    name = F.lower(basename(F.replace(path, F.lit("\\"), F.lit("/"))))
    return F.coalesce(one_of(name, fixed.LANGUAGE_FILENAMES), one_of(extension(path), fixed.LANGUAGE_EXTENSIONS))


def canonical_language(c: Column) -> Column:
    return one_of(F.lower(c), fixed.LANGUAGE_ALIASES)


def file_category(path: Column) -> Column:
    """doc, config, data, test or source."""
    low = F.lower(path)
    name = basename(low)

    def ends(suffixes: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for s in suffixes:
            out = out | low.endswith(s)
        return out

    test = low.contains("/test/") | low.contains("/tests/") | low.contains("/__tests__/") | name.contains("test") | name.contains("spec")
    return (
        F.when(ends(fixed.DOC_SUFFIXES), "doc")
        .when(ends(fixed.DATA_SUFFIXES), F.when(name.isin(list(fixed.MANIFEST_NAMES)), "config").otherwise("data"))
        .when(test, "test")
        .when(name.isin(list(fixed.CONFIG_NAMES)), "config")
        .otherwise("source")
    )


def size_bucket(lines: Column) -> Column:
    return F.when(lines < 5_000, "small").when(lines < 50_000, "medium").otherwise("large")


def line_count(text: Column) -> Column:
    """Lines of a text; a final line end opens no further line."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0))


def filled_lines(text: Column) -> Column:
    """Lines of a text that hold more than white space."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: squeeze(x) != ""))


def frontmatter(text: Column) -> Column:
    """The block between leading ``---`` lines, or null."""
    got = F.regexp_extract(text, r"^﻿?---\n((?s:.*?))\n---(?:\n|$)", 1)
    return F.when(got != "", got)


def body(text: Column) -> Column:
    """The text behind its front matter."""
    return F.regexp_replace(text, r"^﻿?(?:---\n(?s:.*?)\n---(?:\n|$))?", "")


def heading_title(text: Column) -> Column:
    """The first first-level heading of the body, or null."""
    got = F.regexp_extract(F.concat(F.lit("\n"), body(text)), r"\n# ([^\n]*)", 1)
    return F.when(squeeze(got) != "", squeeze(got))


def title_of(text: Column, stem: Column) -> Column:
    """Title by front matter, first heading, or file stem."""
    named = F.regexp_extract(F.concat(F.lit("\n"), frontmatter(text)), r"\ntitle:[ \t]*([^\n]*)", 1)
    named = F.when(squeeze(named) != "", F.trim(squeeze(named), F.lit("\"'")))
    return F.coalesce(named, heading_title(text), stem)


def wikilinks(text: Column) -> Column:
    """Targets of ``[[target|label]]`` in order, trimmed, without empty ones."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]\n]*)\]\]"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: squeeze(F.substring_index(x, "|", 1))), lambda x: x != "")


def first_paragraph(text: Column) -> Column:
    """First paragraph of the body without headings, its lines joined; longer than 280 characters it is cut to 277 and dots."""
    lines = F.transform(F.split(body(text), "\n"), squeeze)
    kept = F.filter(lines, lambda x: ~x.startswith("#"))
    start = F.regexp_replace(F.array_join(kept, "\n"), r"^\n+", "")
    joined = F.replace(F.substring_index(start, "\n\n", 1), F.lit("\n"), F.lit(" "))
    return F.when(F.length(joined) > 280, F.concat(F.substring(joined, 1, 277), F.lit("..."))).otherwise(joined)


def node_text(node_id: Column, name: Column, summary: Column, tags: Column) -> Column:
    """Text of a node for embedding: name, summary and tags; ``node:`` and the id where all are blank."""

    def filled(c: Column) -> Column:
        return F.when(squeeze(c) != "", squeeze(c))

    text = F.concat_ws(" :: ", filled(name), filled(summary), filled(F.array_join(tags, ",")))
    return F.when(text == "", F.concat(F.lit("node:"), node_id)).otherwise(text)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def prompt_hash(system: Column, user: Column) -> Column:
    """Hash of both parts with their lengths, so that no two pairs meet."""
    return F.sha2(F.concat(F.lit("sys"), F.octet_length(system), F.lit(":"), system, F.lit("usr"), F.octet_length(user), F.lit(":"), user), 256)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 for different lengths; the norms' product is at least 1e-12."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(F.size(a) != F.size(b), 1.0).otherwise(1 - _dot(a, b) / F.greatest(norm, F.lit(1e-12)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the common leading part; 0 for a zero norm."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when(norm == 0, 0.0).otherwise(_dot(x, y) / norm)


def squash(raw: Column) -> Column:
    """A raw score in [0, 1)."""
    return F.when(raw <= 0, 0.0).otherwise(raw / (raw + fixed.SQUASH))


def trim_for_prompt(text: Column, n: int) -> Column:
    """At most ``n`` characters, with a mark where the text is cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("\n[... truncated ...]"))).otherwise(text)


def sanitize_identifier(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_-]", "_"), 1, 255)


def staleness(graph_hash: Column, head: Column) -> Column:
    """no_graph, no_git, fresh or stale."""
    return F.when(graph_hash.isNull(), "no_graph").when(head.isNull(), "no_git").when(graph_hash == head, "fresh").otherwise("stale")


def retry_delay(attempt: Column, base_ms: int = 500, cap_ms: int = 30_000) -> Column:
    """Delay before a further attempt, without jitter."""
    return F.least(F.lit(float(cap_ms)), base_ms * F.pow(F.lit(2.0), attempt - 1))


def retryable(status: Column) -> Column:
    return status.isin(408, 429) | status.between(500, 599)


def clamp_weight(c: Column, default: float = 0.5) -> Column:
    """A weight as a double in [0, 1]; null and NaN give ``default``."""
    w = c.try_cast("double")
    return F.when(w.isNull() | F.isnan(w), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)))


def salvage_json_array(reply: Column, schema: str) -> Column:
    """The JSON array of a reply that may stand in a code fence or in prose; null where there is none."""
    inner = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    return F.from_json(F.when(inner != "", inner), schema)


def parse_type(value: str | None, domain: tuple[str, ...]) -> str | None:
    """A type of ``domain`` in any case, or None, which turns a filter off."""
    low = (value or "").strip().lower()
    return low if low in domain else None


def uuid_for_key(key: Column) -> Column:
    """A version-5 UUID of a business key in this library's name space."""

    @F.pandas_udf("string")
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else str(uuid.uuid5(NAMESPACE, k)))

    return run(key)


def iso_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fallback_texts(node_id: Column, text: Column) -> Column:
    """Shorter texts for a provider that rejects ``text``: without control characters, its first 500 and 100 characters, the id."""
    clean = F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")
    return F.array_compact(F.array(F.when((clean != "") & (clean != text), clean), F.when(F.length(text) > 500, F.substring(text, 1, 500)), F.when(F.length(text) > 100, F.substring(text, 1, 100)), F.concat(F.lit("node:"), node_id)))
