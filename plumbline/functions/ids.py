"""Identifier and path expressions; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.fixed import NODE_TYPES

#: The type prefixes of node ids: the node types, and ``func`` for function.
TYPE_PREFIXES = tuple(x for t in NODE_TYPES for x in ((t, "func") if t == "function" else (t,)))
_P = "|".join(TYPE_PREFIXES)

#: Foreign segments, then one or more type prefixes, of which the last counts. RE2 and Java read it alike.
PEEL = rf"^(?:[^:]+:)*?(?:(?i:{_P}):)*((?i:{_P})):((?s:.*))$"


def squeeze(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def is_reference(c: Column) -> Column:
    """Whether an id is neither null nor blank; cheaper than comparing its canonical form."""
    return c.isNotNull() & (squeeze(c) != "")


def canonical_id(c: Column) -> Column:
    """The canonical spelling of a node id: trimmed, one lower-case type prefix (``function`` for ``func``), nothing before
    it, forward slashes. Null stays null; a blank id gives the empty string; an id without a type prefix keeps its text.

    Only ids that are not canonical already meet the pattern, which backtracks; the test for that compares two segments."""
    s = F.replace(squeeze(c), F.lit("\\"), F.lit("/"))
    known = [p for p in TYPE_PREFIXES if p != "func"]
    second = F.lower(F.substring_index(F.substring_index(c, ":", 2), ":", -1))
    plain = F.substring_index(c, ":", 1).isin(known) & c.contains(":") & ~second.isin(list(TYPE_PREFIXES))
    prefix = F.lower(F.regexp_extract(s, PEEL, 1))
    peeled = F.concat(F.when(prefix == "func", "function").otherwise(prefix), F.lit(":"), F.regexp_extract(s, PEEL, 2))
    return F.when(plain, s).when(F.regexp_extract(s, PEEL, 1) == "", s).otherwise(peeled)


def canonical_id_sql(c: str) -> str:
    """The same for DuckDB."""
    s = rf"replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\', '/')"
    p = f"lower(regexp_extract({s}, '{PEEL}', 1))"
    return f"(CASE WHEN {c} IS NULL THEN NULL WHEN {p} = '' THEN {s} ELSE (CASE WHEN {p} = 'func' THEN 'function' ELSE {p} END) || ':' || regexp_extract({s}, '{PEEL}', 2) END)"


def canonical_path(c: Column) -> Column:
    """A path with forward slashes and without leading ``./``."""
    return F.regexp_replace(F.regexp_replace(squeeze(c), r"\\", "/"), r"^(?:\./)+", "")


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def dirname(c: Column) -> Column:
    return F.regexp_replace(c, r"/?[^/]*$", "")


def extension(c: Column) -> Column:
    """Lower-case extension of the file name, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(c, r"\\", "/"), r"\.([^./]+)$", 1))
