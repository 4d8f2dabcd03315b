"""Structure of source and configuration files as rows (group, kind, name, detail, line), by declarative line rules and a few readers.

A language is a list of rules; ``register`` adds or replaces one, as plug-ins do. Unknown languages raise."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import spread


@dataclass(frozen=True)
class Item:
    group: str  # definition, step, service, endpoint, resource, section, import, function, class, export
    kind: str
    name: str
    detail: str
    line: int


@dataclass(frozen=True)
class Rule:
    """A line that matches ``pattern`` is an item of ``group``. Groups of the pattern: name, and optionally kind and detail."""

    group: str
    pattern: re.Pattern
    kind: str = ""

    def read(self, line: str, number: int) -> Iterator[Item]:
        m = self.pattern.match(line)
        if m:
            got = m.groupdict()
            yield Item(self.group, (got.get("kind") or self.kind).lower(), got["name"].strip(), (got.get("detail") or "").strip().rstrip(",").rstrip(), number)


def _rules(*rows: tuple[str, str, str]) -> list[Rule]:
    return [Rule(group, re.compile(pattern), kind) for group, kind, pattern in rows]


_SQL = r"(?i)\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:TEMP|TEMPORARY|UNIQUE|MATERIALIZED)\s+)*(?P<kind>TABLE|VIEW|INDEX)\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?[\"`\[]?(?P<name>[\w.]+)"
_LINE_RULES: dict[str, list[Rule]] = {
    "sql": _rules(("definition", "", _SQL)),
    "shell": _rules(
        ("definition", "function", r"\s*function\s+(?P<name>[\w-]+)"),
        ("definition", "function", r"\s*(?P<name>[\w-]+)\(\)"),
        ("import", "source", r"\s*(?:source|\.)\s+[\"']?(?P<name>[^\s\"']+)"),
    ),
    "terraform": _rules(
        ("resource", "", r"\s*resource\s+\"(?P<kind>[^\"]+)\"\s+\"(?P<name>[^\"]+)\""),
        ("definition", "", r"\s*(?P<kind>variable|output)\s+\"(?P<name>[^\"]+)\""),
    ),
    "javascript": _rules(
        ("function", "function", r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^>]*>)?\((?P<detail>[^)]*)"),
        ("function", "function", r"\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?\((?P<detail>[^)]*)\)[^=]*=>"),
        ("class", "class", r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)"),
        ("import", "import", r"\s*import\s+(?:type\s+)?(?P<detail>[^\"']*?)(?:\s*from\s*)?[\"'](?P<name>[^\"']+)[\"']"),
        ("export", "export", r"\s*export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\s*\*?|class|const|let|var|interface|type|enum)\s+(?P<name>[\w$]+)"),
    ),
    "go": _rules(
        ("function", "function", r"func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<detail>[^)]*)"),
        ("class", "struct", r"type\s+(?P<name>\w+)\s+(?:struct|interface)\b"),
        ("import", "import", r"\s*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<name>[^\"]+)\"\s*$"),
        ("export", "export", r"(?:func\s+(?:\([^)]*\)\s*)?|type\s+|var\s+|const\s+)(?P<name>[A-Z]\w*)"),
    ),
    "rust": _rules(
        ("function", "function", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<detail>[^)]*)"),
        ("class", "type", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(?P<name>\w+)"),
        ("import", "use", r"\s*(?:pub\s+)?use\s+(?P<name>[^;]+);"),
        ("export", "export", r"\s*pub\s+(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:fn|struct|enum|trait|mod|const|static|type)\s+(?P<name>\w+)"),
    ),
    "java": _rules(
        ("class", "class", r"\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+(?P<name>\w+)"),
        ("function", "method", r"\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)+(?:<[^>]*>\s*)?[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*\((?P<detail>[^)]*)\)\s*(?:throws [\w., ]+)?[{;]"),
        ("import", "import", r"\s*import\s+(?:static\s+)?(?P<name>[\w.*]+)\s*;"),
        ("export", "export", r"\s*public\s+(?:(?:static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+(?P<name>\w+)"),
    ),
}
_LINE_RULES["typescript"] = [*_LINE_RULES["javascript"], *_rules(("class", "interface", r"\s*(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>[\w$]+)"))]

Reader = Callable[[str], Iterator[Item]]
_READERS: dict[str, Reader] = {}


def register(language: str, reader: Reader) -> None:
    """Read ``language`` with ``reader`` from now on."""
    _READERS[language] = reader


def _reader(language: str) -> Callable[[Reader], Reader]:
    def add(f: Reader) -> Reader:
        register(language, f)
        return f

    return add


def _lines(text: str) -> Iterator[tuple[int, str]]:
    yield from enumerate(text.lstrip("﻿").split("\n"), 1)


# A Dockerfile is a sequence of instructions, each a word and its arguments; a Makefile one of assignments and rules. What each gives is a row here:
# the form of the logical line, and how its parts become items.
_NAMED = Callable[[re.Match, int, int], Iterator[Item]]
_LINE_FORMS: dict[str, list[tuple[re.Pattern, _NAMED]]] = {
    "dockerfile": [
        (re.compile(r"(?i)\s*FROM(?:\s+--\S+)*(?:\s+(?P<image>\S+)(?:\s+AS\s+(?P<name>\S+))?)?"), lambda m, n, nth: iter([Item("service", "stage", m["name"] or f"stage-{nth}", m["image"] or "", n)])),
        (re.compile(r"(?i)\s*(?P<word>RUN|CMD|ENTRYPOINT)\b\s*(?P<rest>(?P<first>\S*).*?)\s*$"), lambda m, n, nth: iter([Item("step", m["word"].lower(), f"{m['word'].lower()}: {m['first']}" if m["first"] else f"{m['word'].upper()}-{n}", m["rest"], n)])),
        (re.compile(r"(?i)\s*EXPOSE\s+(?P<rest>.*\S)"), lambda m, n, nth: (Item("endpoint", "EXPOSE", port.partition("/")[0], "", n) for port in m["rest"].split())),
        (re.compile(r"(?i)\s*(?P<word>COPY|ADD)\s+(?P<rest>.*\S)"), lambda m, n, nth: iter([Item("resource", m["word"].lower(), m["rest"], "", n)])),
    ],
    "makefile": [
        (re.compile(r"(?=[\t#]|\s*(?:#|$))"), lambda m, n, nth: iter(())),
        (re.compile(r" *(?P<name>[^:=?+#\s][^:=?+#]*?)\s*(?:[:?+]?=)"), lambda m, n, nth: iter([Item("definition", "variable", m["name"], "", n)])),
        (re.compile(r"\s*(?P<targets>[^:]*?)\s*:\s*(?P<needs>.*?)\s*$"), lambda m, n, nth: (Item("step", "target", f"{t} <- {m['needs']}" if m["needs"] else t, m["needs"], n) for t in m["targets"].split())),
    ],
}


def _formed(language: str, text: str) -> Iterator[Item]:
    """Items of a text by the forms of its lines; the first form that fits counts. ``nth`` numbers the lines of one form from 1."""
    nth: dict[int, int] = {}
    for n, line in _lines(text):
        for i, (form, give) in enumerate(_LINE_FORMS[language]):
            if m := form.match(line):
                nth[i] = nth.get(i, 0) + 1
                yield from give(m, n, nth[i])
                break


@_reader("dockerfile")
def _dockerfile(text: str) -> Iterator[Item]:
    yield from _formed("dockerfile", re.sub(r"\\\r?\n", " ", text))


@_reader("makefile")
def _makefile(text: str) -> Iterator[Item]:
    yield from _formed("makefile", text)


@_reader("env")
def _env(text: str) -> Iterator[Item]:
    for n, line in _lines(text):
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*)$", line.rstrip("\r"))
        if m:
            q = re.match(r"([\"'])(.*?)\1", m[2])
            yield Item("definition", "variable", m[1], q[2] if q else m[2].split(" #")[0].strip(), n)


@_reader("ini")
def _ini(text: str) -> Iterator[Item]:
    yield from _sections(text, "#;")


@_reader("toml")
def _toml(text: str) -> Iterator[Item]:
    yield from _sections(text, "#")


def _sections(text: str, comments: str) -> Iterator[Item]:
    section = ""
    for n, raw in _lines(text):
        line = raw.strip()
        if not line or line[0] in comments:
            continue
        m = re.match(r"\[\[?\s*([^\]]+?)\s*\]\]?", line)
        if m:
            section = m[1]
            yield Item("definition", "section", section, "", n)
            continue
        m = re.match(r"((?:\"[^\"]*\"|'[^']*'|[^=\"'])+?)\s*=\s*(.*)$", line)
        if m:
            yield Item("definition", "variable", m[1].strip("\"' "), f"{section}|{m[2].strip()}", n)


@_reader("yaml")
def _yaml(text: str) -> Iterator[Item]:
    starts = [n for n, line in _lines(text) if re.match(r"---(?:\s|$)", line)]
    if len(starts) > 1 or starts and any(line.strip() and not line.startswith(("#", "%")) for n, line in _lines(text) if n < starts[0]):
        for i, n in enumerate(starts, 1):
            yield Item("definition", "document", f"document-{i}", "", n)
    for n, line in _lines(text):
        m = re.match(r"([^\s#\-\[\]{}:\"'][^:#]*?|\"[^\"]*\"|'[^']*')\s*:(?:\s|$)", line)
        if m:
            yield Item("definition", "section", m[1].strip("\"'"), "", n)


@_reader("json")
def _json(text: str) -> Iterator[Item]:
    try:
        top = json.loads(text.lstrip("﻿"))
    except ValueError:
        return
    if not isinstance(top, dict):
        return
    line_of: dict[str, int] = {}  # the lines of top-level keys, and of the paths below "paths"
    depth, line, holder = 0, 1, ""
    for m in re.finditer(r"\"((?:[^\"\\]|\\.)*)\"(\s*:)?|[{}\[\]\n]", text):
        if m[0] == "\n":
            line += 1
        elif m[0] in ("{", "["):
            depth += 1
        elif m[0] in ("}", "]"):
            depth -= 1
        else:
            if m[2] and (depth == 1 or depth == 2 and holder == "paths"):
                line_of.setdefault(m[1], line)
                holder = m[1] if depth == 1 else holder
            line += m[0].count("\n")
    for key in top:
        yield Item("definition", "section", key, "", line_of.get(key, 1))
    if "openapi" in top or "swagger" in top:
        for path, methods in (top.get("paths") or {}).items():
            verbs = [v.upper() for v in methods if v in ("get", "post", "put", "delete", "patch", "head", "options")] if isinstance(methods, dict) else []
            for verb in verbs or [""]:
                yield Item("endpoint", verb, path, "", line_of.get(path, 1))


@_reader("markdown")
def _markdown(text: str) -> Iterator[Item]:
    fence = False
    heads: list[tuple[int, str, int]] = []
    last = 0
    for n, line in _lines(text):
        last = n
        if line.lstrip().startswith("```"):
            fence = not fence
        m = None if fence else re.match(r"(#{1,6})\s+(.*\S)", line)
        if m:
            heads.append((len(m[1]), m[2].rstrip("# "), n))
    for i, (level, name, n) in enumerate(heads):
        end = next((b - 1 for lv, _, b in heads[i + 1 :] if lv <= level), last)
        yield Item("section", str(level), name, str(end), n)


def _plain_code(text: str) -> str:
    """Text with block and line comments blanked; lines stay."""
    text = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    return re.sub(r"//[^\n]*", "", text)


@_reader("protobuf")
def _protobuf(text: str) -> Iterator[Item]:
    depth = 0
    for n, line in _lines(_plain_code(text)):
        m = re.match(r"\s*(message|enum|service)\s+(\w+)", line) if depth == 0 else None
        if m:
            yield Item("definition", m[1], m[2], "", n)
        depth = max(0, depth + line.count("{") - line.count("}"))


@_reader("graphql")
def _graphql(text: str) -> Iterator[Item]:
    depth, root = 0, ""
    for n, raw in _lines(text):
        line = raw.partition("#")[0].strip()
        if depth == 0:
            m = re.match(r"(?:extend\s+)?(type|input|enum|union|interface|scalar)\s+(\w+)", line)
            if m:
                yield Item("definition", m[1], m[2], "", n)
                root = m[2] if m[2] in ("Query", "Mutation", "Subscription") else ""
        elif depth == 1 and root:
            m = re.match(r"(\w+)\s*[(:]", line)
            if m:
                yield Item("endpoint", root, f"{root}.{m[1]}", "", n)
        depth = max(0, depth + line.count("{") - line.count("}"))


@_reader("terraform")
def _terraform(text: str) -> Iterator[Item]:
    for n, line in _lines(text):
        for rule in _LINE_RULES["terraform"]:
            yield from rule.read(line, n)
        m = re.match(r"\s*data\s+\"([^\"]+)\"\s+\"([^\"]+)\"", line)
        if m:
            yield Item("definition", "data", f"{m[1]}.{m[2]}", "", n)


@_reader("python")
def _python(text: str) -> Iterator[Item]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            a = node.args
            names = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]] + [x.arg for x in (a.vararg, a.kwarg) if x]
            yield Item("function", "function", node.name, ",".join(names), node.lineno)
        elif isinstance(node, ast.ClassDef):
            methods = sorted(x.name for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef))
            yield Item("class", "class", node.name, ",".join(methods), node.lineno)
        elif isinstance(node, ast.Import):
            for x in node.names:
                yield Item("import", "import", x.name, "", node.lineno)
        elif isinstance(node, ast.ImportFrom):
            yield Item("import", "from", "." * node.level + (node.module or ""), ",".join(sorted(x.name for x in node.names)), node.lineno)
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and not node.name.startswith("_"):
            yield Item("export", "export", node.name, "", node.lineno)


def languages() -> set[str]:
    return set(_READERS) | set(_LINE_RULES)


def analyze(language: str, text: str | None) -> list[Item]:
    """Items of a text; null texts have none, unknown languages raise."""
    if language not in _READERS and language not in _LINE_RULES:
        raise ValueError(f"no parser for {language}")
    if text is None:
        return []
    if language in _READERS:
        return list(_READERS[language](text))
    out = []
    for n, line in _lines(text):
        if line.count("(") > line.count(")"):  # a signature may go on over lines: they are read as one, up to its closing bracket
            line = _whole_signature(text, n, line)
        for rule in _LINE_RULES[language]:
            hit = list(rule.read(line, n))
            out += hit
            if hit and rule.group == "definition":
                break
    return out


@lru_cache(maxsize=4)
def _split(text: str) -> list[str]:
    return text.lstrip("\ufeff").split("\n")


def _whole_signature(text: str, number: int, line: str) -> str:
    """Line ``number`` with those behind it that its open bracket needs; the line alone where it is no signature."""
    if not _SIGNATURE.match(line):
        return line
    lines, parts = _split(text), [line]
    depth = line.count("(") - line.count(")")
    while depth > 0 and number < len(lines):
        parts.append(lines[number].strip())
        depth += lines[number].count("(") - lines[number].count(")")
        number += 1
    return " ".join(parts) if depth <= 0 else line


_SIGNATURE = re.compile(r"\s*(?:[\w<>\[\],.?@\"()]+\s+)*(?:function|func|fn|def|class|const|let|var|public|private|protected|static)\b[^=;]*\(")


def call_graph(text: str) -> list[tuple[str, str, int]]:
    """(caller, callee, line) of Python calls; the caller is the nearest enclosing function, ``<top>`` outside any."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple[str, str, int]] = []

    def walk(node: ast.AST, caller: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if name:
                    out.append((caller, name, child.lineno))
            walk(child, child.name if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef) else caller)

    walk(tree, "<top>")
    return out


def extract(files: DataFrame, key: str, language: Column, content: str) -> DataFrame:
    """(key, group, kind, name, detail, line): the items of every file; languages without a parser and null contents give no rows. Narrow."""
    known = languages()
    schema = files.select(key).schema.simpleString()[len("struct<") : -1] + ",group string,kind string,name string,detail string,line int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i.group, i.kind, i.name, i.detail, i.line) for k, lang, text in pdf.itertuples(index=False, name=None) for i in analyze(lang, text)]
            yield pd.DataFrame(rows, columns=[key, "group", "kind", "name", "detail", "line"])

    rows = files.select(key, language.alias("lang"), content).where(F.col("lang").isin(sorted(known)) & F.col(content).isNotNull())
    return spread(rows).mapInPandas(run, schema)


def _flat(detail: Column) -> Column:
    """Parameters without what stands in brackets of their types and defaults, three levels deep, so that commas part parameters only."""
    for _ in range(3):
        detail = F.regexp_replace(detail, r"<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\}|\([^()]*\)", "_")
    return detail


def structural_hash(items: DataFrame, key: str) -> DataFrame:
    """(key, structure): a hash of functions with their arity and whether they are exported, classes, imports, exports, sections and definitions,
    whatever their order and lines."""
    exported = items.where("`group` = 'export'").select(key, "name").distinct().withColumn("public", F.lit("1"))
    arity = F.when(F.trim("detail") == "", 0).otherwise(F.size(F.split(_flat(F.col("detail")), ",")))
    marked = items.join(exported, [key, "name"], "left")
    text = (
        F.when(F.col("group") == "function", F.concat_ws(":", F.lit("f"), "name", arity.cast("string"), F.coalesce("public", F.lit("0"))))
        .when(F.col("group") == "class", F.concat_ws(":", F.lit("c"), "name", "detail"))
        .when(F.col("group") == "import", F.concat_ws(":", F.lit("i"), "name"))
        .otherwise(F.concat_ws(":", "group", "kind", "name"))
    )
    return marked.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("structure"))


def classify_change(old_text: Column, new_text: Column, old_structure: Column, new_structure: Column) -> Column:
    """none for equal texts, cosmetic for equal structures, else structural."""
    return F.when(old_text.eqNullSafe(new_text), "none").when(old_structure.eqNullSafe(new_structure), "cosmetic").otherwise("structural")


# Frameworks with the words and manifests that show them.
FRAMEWORKS = (
    ("react", ('"react"', "from 'react'", 'from "react"'), ("package.json",)),
    ("vue", ('"vue"', "from 'vue'", 'from "vue"'), ("package.json",)),
    ("next", ('"next"', "from 'next/", 'from "next/'), ("package.json",)),
    ("express", ('"express"', "require('express')", "from 'express'"), ("package.json",)),
    ("flask", ("Flask", "flask", "from flask"), ("requirements.txt", "pyproject.toml", "pipfile")),
    ("django", ("Django", "django", "from django"), ("requirements.txt", "pyproject.toml", "pipfile")),
    ("fastapi", ("fastapi", "from fastapi"), ("requirements.txt", "pyproject.toml", "pipfile")),
    ("rails", ("rails", "Rails"), ("gemfile",)),
    ("spring", ("org.springframework", "spring-boot"), ("pom.xml", "build.gradle", "build.gradle.kts")),
    ("gin", ("github.com/gin-gonic/gin",), ("go.mod",)),
    ("actix", ("actix-web", "actix_web"), ("cargo.toml",)),
    ("axum", ("axum",), ("cargo.toml",)),
    ("rocket", ("rocket",), ("cargo.toml",)),
)


def frameworks_in_manifests(files: DataFrame) -> DataFrame:
    """(project, framework) by manifest name and the words in it."""
    name = F.lower(F.substring_index(F.regexp_replace("path", r"\\", "/"), "/", -1))
    found = F.array(*[F.when(name.isin(list(m)) & _any(F.col("content"), words), f) for f, words, m in FRAMEWORKS])
    return files.where("content is not null").select("project", F.explode(F.array_compact(found)).alias("framework")).distinct()


def frameworks_in_imports(imports: DataFrame) -> DataFrame:
    """(file_id, framework) by words in imported names."""
    found = F.array(*[F.when(_any(F.col("name"), tuple(w.strip("\"'") for w in words)), f) for f, words, _ in FRAMEWORKS])
    return imports.select("file_id", F.explode(F.array_compact(found)).alias("framework")).distinct()


def _any(c: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit
