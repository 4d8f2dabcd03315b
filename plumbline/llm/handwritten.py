"""Generated, minified, vendored and data files among source files, so that hand-written source remains.

1. Vendored: an inverted index of line hashes over distinct contents; every posting list, however long, links its contents to one holder (a star, so a list
   of any length costs its length), and exact containment is computed for the holder with the most links. Contents that no star explains though other projects
   hold enough of their lines are compared with all holders of their rarest lines. Known libraries are compared whole.
2. Remaining files: token-composition rules on the text itself. Paths alone decide nothing: names are often misleading."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ids import canonical_path
from plumbline.operators.skew import hot_keys, join_unique
from plumbline.session import cut_lineage, spread

# How tools mark their output in a comment. The weaker phrases must begin it: further on they mostly speak of something else.
_GENERATED = re.compile(
    r"(?i)^\W*(?:generated (?:from|by|with|using) \S+|auto-?generated\b|automatically (?:generated|produced|created|written)\b|(?:machine|auto)[- ](?:generated|written)\b)"
    r"|\bcode generated by\b|@generated\b|<auto-?generated\b|\bauto-?generated (?:file|code)\b|\bthis (?:\w+ ){0,2}(?:file|module|code|header|source|class) (?:was|is|has been) (?:auto(?:matically)?[- ]?)?(?:generated|produced|created|written) (?:by|from|with|using)\b"
    r"|\b(?:do not|don't) (?:edit|modify)\b.{0,40}\b(?:run|regenerate|instead|generated|by hand|manually)\b|\bchanges will be (?:lost|overwritten)\b"
)
_HAND = re.compile(r"(?i)\bedited by hand\b|\bhand-?written\b|\bwrites? the\b|\bthat generated\b")
#: Words of which a mark or banner holds at least one; only texts with one are read by tokens for their comments.
_MARKED = re.compile(r"(?i)generated|automatically|machine[- ]written|auto[- ]written|changes will be|(?:do not|don't) (?:edit|modify)|@licen[cs]e|@preserve|\blicen[cs]ed?\b|\(c\)|©|\bcopyright\b|\btoolkit\b|\bauthors\b|\bcontributors\b|released under|\bcopy\b|\bcopied\b|\bupstream\b")
#: The words of ``_MARKED`` in lower case, to be sought as plain text, which costs a fraction of a pattern without case: those that count wherever they stand,
#: and the beginnings of those that count as whole words, which are then read by their pattern.
_ANYWHERE = ("generated", "automatically", "machine-written", "machine written", "auto-written", "auto written", "changes will be", "do not edit", "do not modify", "don't edit", "don't modify", "@license", "@licence", "@preserve", "(c)", "©", "released under")
_BEGINNINGS = ("licen", "copy", "copied", "toolkit", "authors", "contributors", "upstream")
_WHOLE = re.compile(r"\b(?:licen[cs]ed?|copyright|toolkit|authors|contributors|copy|copied|upstream)\b")
_QUOTED = r"\"\"\".*?(?:\"\"\"|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_SLASHED = re.compile(r"(//[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))|" + _QUOTED + r"|`(?:[^`\\]|\\.)*`", re.S)
_HASHED = re.compile(r"(#[^\n]*)|" + _QUOTED, re.S)
_DASHED = re.compile(r"(--[^\n]*|;[^\n]*|#[^\n]*|//[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))|" + _QUOTED, re.S)
_SIGN = re.compile(r"(?:\s|//|/\*|\*/?|<!--|--|[#!;])*")
# Banners of published packages: a licence tag, or a version together with words of a release.
_LICENCE_TAG = re.compile(r"(?i)@(?:license|licence|preserve)\s+\S+")
_RELEASE = re.compile(r"(?i)(?=.*\bv?\d+\.\d+\.\d+\b)(?=.*(?:\blicen[cs]ed?\b|\(c\)|©|\bcopyright\b|\btoolkit\b|\bauthors\b|\bcontributors\b|\breleased under\b))")
_LOCAL_COPY = re.compile(r"(?i)\b(?:local|vendored|verbatim) copy\b|\bcopied (?:verbatim )?from\b|\bin step with upstream\b|\bupstream (?:version|source)\b")
_TRANSPILED = re.compile(r"\"__esModule\"|'__esModule'|\bvar __\w+ = \(this && this\.__\w+\)|\b_interopRequire\w+\(|\b__webpack_require__\b|\bexports\.\w+ = void 0;|\(0, \w+\.\w+\)\(")
_TRANSPILED_WORDS = ("__esModule", "var __", "_interopRequire", "__webpack_require__", "exports.", "(0, ")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F_]+|\d[\d_.]*(?:[eE][-+]?\d+)?)[a-zA-Z0-9]{0,3}")
_SERIAL = re.compile(r"(\d(?<=[A-Za-z_]\d)\d{0,4})_?\b")
_LOCKED = re.compile(r"^\s*[\"']?(?:version|resolved|integrity|checksum|sha\d+|hash|resolution|dependencies|requires|lockVersion|lockfileVersion|source)[\"']?\s*[:= ]", re.M)
_LOCK_NAME = re.compile(r"(?i)(?:^|/)[\w.-]*(?:lock|shrinkwrap|\.sum)[\w.-]*$")
CONFIG = frozenset(("json", "yaml", "yml", "toml", "env", "ini"))

#: Contents are compared by lines of at least this many characters; shorter ones say nothing about their origin.
LINE_CHARS = 9
#: Library lines and suspected files are broadcast up to these numbers (some MB), and shuffled beyond them.
BROADCAST_LINES, BROADCAST_IDS = 500_000, 1_000_000
#: Lines of all hot contents that are broadcast together (8 bytes each), pairs from which on a content is hot, and parts of its pairs beyond.
HOT_LINES, HOT_PAIRS, SALTS = 4_000_000, 20_000, 64
#: Holders of one frequent line that are met at once.
PART = 20_000


def comments(text: str, ext: str) -> Iterator[tuple[str, bool]]:
    """(line, leading) of every line of every comment of the whole text, without its signs. Strings are read as tokens, so that nothing in them is a comment;
    leading are comments that no code stands before (a literal alone, as a directive or docstring, is none)."""
    pattern = _HASHED if ext in ("py", "pyi", "toml", "yaml", "yml", "rb", "sh", "env") else _SLASHED if ext in ("js", "mjs", "cjs", "jsx", "ts", "tsx", "mts", "cts", "go", "rs", "java", "c", "h", "cpp", "cs", "php", "swift", "kt") else _DASHED
    at, leading = 0, True
    for m in pattern.finditer(text):
        leading = leading and not text[at : m.start()].strip(" \t\r\n;\ufeff")
        at = m.end()
        if m[1] is not None:
            for line in m[1].split("\n"):
                yield line[_SIGN.match(line).end() :], leading


def marked(text: str) -> bool:
    """Whether ``_MARKED`` is found in the text, by its words as plain text."""
    if not text.isascii() and any(c in text for c in "İıſ"):  # a pattern without case takes these as i and s, lower() does not
        return _MARKED.search(text) is not None
    low = text.lower()
    return any(w in low for w in _ANYWHERE) or any(w in low for w in _BEGINNINGS) and _WHOLE.search(low) is not None


def stated(text: str, ext: str) -> str | None:
    """``generated`` or ``vendored`` by what a comment of the text says; None if none does."""
    if not marked(text):
        return None
    for line, leading in comments(text, ext):
        if _GENERATED.search(line) and not _HAND.search(line):
            return "generated"
        if leading and (_LICENCE_TAG.search(line) or _RELEASE.search(line) or _LOCAL_COPY.search(line)):
            return "vendored"
    return None


def composition(text: str, path: str) -> str | None:
    """Why a file is not hand-written, judged by its own text: ``generated``, ``vendored``, ``minified``, ``data``; None otherwise."""
    ext = path.rpartition(".")[2].lower()
    if (why := stated(text, ext)) is not None:
        return why
    lines = text.count("\n") + 1
    if ext in CONFIG:
        marks = len(_LOCKED.findall(text))
        if marks >= 4 and marks >= (0.3 if _LOCK_NAME.search(path) else 0.4) * (lines - text.count("}")):
            return "generated"
        return None
    if ext in ("js", "mjs", "cjs", "jsx", "ts") and any(w in text for w in _TRANSPILED_WORDS) and _TRANSPILED.search(text):
        return "generated"
    # Literal tables: more than four of five tokens are literals, or three quarters of the text are opaque ones.
    digits = sum(map(text.count, "0123456789"))
    quotes = text.count('"') + text.count("'")
    if digits + quotes * 8 > 0.1 * len(text):
        strings = _STRING.findall(text)
        rest = _STRING.sub(" ", text)
        numbers, names = len(_NUMBER.findall(rest)), len(_NAME.findall(rest))
        opaque = [s for s in strings if " " not in s]
        if numbers + len(opaque) >= 24 and numbers + len(opaque) > 4 * names:
            return "data"
        if (len(opaque) >= 10 or max(map(len, opaque), default=0) > 200) and sum(map(len, opaque)) > 0.75 * len(text):
            return "data"
    # Minified: many statements to a line, nearly no space between tokens.
    if text.count(";") + text.count(",") > 3 * lines or len(text) > 160 * lines:
        bare = _STRING.sub('""', text)
        blank = sum(map(bare.count, " \t\n"))
        if len(bare) > 200 and len(bare) > 60 * lines and blank < 0.13 * len(bare) and bare.count(";") + bare.count("}") > 2 * lines:
            return "minified"
    # Serial members: names numbered 1, 2, 3 ... through most of the file, as only tools write them.
    if digits > 0.004 * len(text):
        seen = {int(m) for m in _SERIAL.findall(text)}
        top = 0
        while top + 1 in seen:
            top += 1
        if top >= 3:
            marked = sum(1 for line in text.split("\n") if _SERIAL.search(line))
            filled = sum(1 for line in text.split("\n") if len(line.strip()) > 4)
            if marked >= 6 and marked >= 0.4 * filled and top >= 0.1 * marked:
                return "generated"
    return None


def line_hashes(content: Column) -> Column:
    """Distinct hashes of the content's trimmed lines of at least LINE_CHARS characters."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.trim(x, F.lit(" \t\r\x0b\f")))
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= LINE_CHARS), lambda x: F.xxhash64(x)))


class _Places(NamedTuple):
    """Contents numbered without gaps; a content's place is its project's number in the bits from ``shift`` on, and its own below."""

    sets: DataFrame
    shift: int

    def project(self, place: str) -> Column:
        return F.shiftright(F.col(place), self.shift)


def _numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` (materialised) with a number without gaps, and how many there are; only the counts of partitions are collected."""
    df = df.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r["_part"]: r["count"] for r in df.groupBy("_part").count().collect()}
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    return df.withColumn(name, F.lit(before or [0])[F.col("_part")] + F.col("_n")).drop("_part", "_n"), total


def _places(sets: DataFrame) -> _Places:
    """``sets`` (copy, project, last, lines; materialised) with a place each: different contents have different places, and different projects different
    numbers, however many there are, so that the smallest and largest places of several contents differ in project if any two do."""
    projects, many = _numbered(cut_lineage(sets.select("project").distinct()), "_project")
    placed, total = _numbered(sets, "_own")
    shift = max(1, total.bit_length())
    if many.bit_length() + shift > 62:
        raise ValueError("more contents and projects than 62 bits can number")
    placed = join_unique(placed, projects, "project", "left", hot_keys(placed, "project", total)) if many > BROADCAST_IDS else placed.join(F.broadcast(projects), "project")
    return _Places(cut_lineage(placed.select("copy", "last", "project", F.shiftleft(F.col("_project"), shift).bitwiseOR(F.col("_own")).alias("place"), "lines")), shift)


def _star(flat: DataFrame, salt: int, places: _Places) -> DataFrame:
    """(line, low, high) of the lines that two projects hold: the first and the last of their holders' places, which differ in project, in an order that depends on ``salt``."""
    mask = F.lit((salt * 0x9E3779B97F4A7C15) % (1 << 62))
    at = F.col("place").bitwiseXOR(mask)
    stats = flat.groupBy("line").agg(F.min(at).alias("low"), F.max(at).alias("high")).select("line", F.col("low").bitwiseXOR(mask).alias("low"), F.col("high").bitwiseXOR(mask).alias("high"))
    return stats.where(places.project("low") != places.project("high"))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _containment(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(copy, place, containment) of exact containment for pairs (place, other). Contents that many others are compared with are the centres of hot groups:
    their lines are broadcast as far as HOT_LINES reaches, and repeated for SALTS parts of their pairs beyond it."""
    pairs = cut_lineage(pairs)
    a, b = sets.select("copy", "place", F.col("lines").alias("a")), sets.select(F.col("place").alias("other"), F.col("lines").alias("b"))
    share = (F.size(F.array_intersect("a", "b")) / F.size("a")).alias("containment")
    left = pairs.join(a, "place")
    hot = hot_keys(pairs, "other", pairs.count(), least=HOT_PAIRS)
    if not hot:
        return left.join(b, "other").select("copy", "place", share)
    sizes, held, sent, salted = {r[0]: r[1] for r in b.where(F.col("other").isin(hot)).select("other", F.size("b")).collect()}, 0, [], []  # at most HOT_KEYS rows
    for x in sorted(hot, key=lambda x: sizes.get(x, 0)):
        held += sizes.get(x, 0)
        (sent if held <= HOT_LINES else salted).append(x)
    out = left.where(~F.col("other").isin(hot)).join(b.where(~F.col("other").isin(hot)), "other").select("copy", "place", share)
    if sent:
        out = out.unionByName(left.where(F.col("other").isin(sent)).join(F.broadcast(b.where(F.col("other").isin(sent))), "other").select("copy", "place", share))
    if salted:
        one = left.where(F.col("other").isin(salted)).withColumn("salt", (F.abs(F.xxhash64("place")) % SALTS).cast("int"))
        two = b.where(F.col("other").isin(salted)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.unionByName(one.join(two, ["other", "salt"]).select("copy", "place", share))
    return out


def _across(places: _Places, across: float, held: int) -> DataFrame:
    """(copy, place, containment) of contents that one of another project contains to the share ``across``; none is lost, however frequent its lines are.

    1. A content can only be contained so far if other projects hold that share of its lines at all. The others are not followed.
    2. Star: all lines of a content link it to one holder each, the most frequent one of these is compared exactly. This explains most members of a
       large group at linear cost; it is repeated with other ranks while it explains a tenth of what is open.
    3. What is left is compared with every content that holds one of its rarest lines: of more than ``1 - across`` of its lines, one is in any container.
       Lines are split where they are frequent, and pairs that share several are one."""
    sets = places.sets
    flat = mine = sets.select("place", F.explode("lines").alias("line"))
    sizes = sets.select("place", F.size("lines").alias("size"))
    hot = hot_keys(flat, "line", held)
    found, salt = None, 0
    while True:
        linked = join_unique(mine, _star(flat, salt, places), "line", "inner", hot)
        other = F.when(places.project("place") != places.project("low"), F.col("low")).otherwise(F.col("high"))
        links = linked.groupBy("place", other.alias("other")).agg(F.count("*").alias("shared")).groupBy("place")
        best = links.agg(F.sum("shared").alias("shared"), F.max_by("other", F.struct("shared", "other")).alias("other")).join(sizes, "place").where(F.col("shared") >= across * F.col("size") - 1e-9)
        best = cut_lineage(best.select("place", "other"))
        got = cut_lineage(_containment(best, sets).where(F.col("containment") >= across))
        explained = got.count()
        found = got if found is None else found.unionByName(got)
        left = cut_lineage(best.join(got, "place", "left_anti").select("place"))
        if left.isEmpty():
            return found
        # Only the lines that open contents hold matter from here on.
        mine = cut_lineage(sets.join(_small(left, BROADCAST_IDS), "place", "left_semi").select("place", F.explode("lines").alias("line")))
        flat = cut_lineage(flat.join(_small(cut_lineage(mine.select("line").distinct()), BROADCAST_LINES), "line", "left_semi"))
        if explained < 0.1 * (explained + left.count()):
            break
        salt += 1
    df = flat.groupBy("line").agg(F.count("*").alias("df"))
    ranked = mine.join(df, "line").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("df", "line"))).alias("all"))
    some = F.slice("all", F.lit(1), F.size("all") - F.ceil(across * F.size("all") - 1e-9).cast("int") + 1)
    # A line's holders are cut into parts by their place, each part is met by the line's askers: no part of a frequent line is larger than some PART rows.
    rarest = ranked.select("place", F.explode(some).alias("x")).select("place", F.col("x.line").alias("line"), F.explode(F.sequence(F.lit(0), (F.col("x.df") / PART).cast("int"))).alias("part"))
    spot = F.abs(F.xxhash64("place")) % (1 + (F.col("df") / PART).cast("bigint"))
    holders = join_unique(flat, df, "line", "inner", hot).select(F.col("place").alias("other"), "line", spot.cast("int").alias("part"))
    pairs = rarest.join(holders, ["line", "part"]).where(places.project("place") != places.project("other")).select("place", "other").distinct()
    return found.unionByName(_containment(pairs, sets).where(F.col("containment") >= across))


def vendored(files: DataFrame, libraries: DataFrame, least: float = 0.5, across: float = 0.8, least_lines: int = 4) -> DataFrame:
    """(copy, containment) of contents whose lines are a library's to the share ``least``, or those of a content in another project to the share ``across``.

    files: (copy, project, content) with copy the content's hash. Equal contents are compared once. Contents that two projects hold unchanged count
    as contained in each other whole. Hashes travel, never texts."""
    once = files.select("copy", F.coalesce("project", F.lit("")).alias("project"), line_hashes(F.col("content")).alias("lines")).groupBy("copy").agg(F.min("project").alias("project"), F.max("project").alias("last"), F.first("lines").alias("lines"))
    places = _places(cut_lineage(once.where(F.size("lines") >= least_lines)))
    sets = places.sets
    held = sets.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    sizes = sets.select("copy", F.size("lines").alias("size"))
    known = libraries.where("content is not null").select("lib_id", F.explode(line_hashes(F.col("content"))).alias("line"))
    if known.count() <= BROADCAST_LINES:
        known = F.broadcast(known)
    by_library = sets.select("copy", F.explode("lines").alias("line")).join(known, "line").groupBy("copy", "lib_id").agg(F.count("*").alias("shared")).join(sizes, "copy")
    by_library = by_library.groupBy("copy").agg(F.max(F.col("shared") / F.col("size")).alias("containment")).where(F.col("containment") >= least)
    exact = _across(places, across, held).select("copy", "containment")
    whole = sets.where(F.col("project") != F.col("last")).select("copy", F.lit(1.0).alias("containment"))
    found = by_library.unionByName(exact).unionByName(whole)
    return found.groupBy("copy").agg(F.max("containment").alias("containment"))


def classify(files: DataFrame, libraries: DataFrame, parses=None) -> DataFrame:
    """(file_id, reason, containment) for every row of ``files`` (file_id, project, path, content) that is not hand-written; reason is one of
    ``generated``, ``minified``, ``vendored``, ``data``.

    ``parses(path, content)`` may exclude files that are not valid in their language: they are broken rather than generated. Null and empty contents give
    no row, a null path or project counts as an empty one; later scans and copies of a file are rows of their own. Long files are read whole, where they are: only hashes and reasons are shuffled."""
    rows = files.where("content is not null and content <> ''").select("file_id", "project", F.coalesce(canonical_path(F.col("path")), F.lit("")).alias("path"), "content", F.xxhash64("content", F.lit(11)).alias("copy"))
    code = ~F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*CONFIG)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file_id, copy, path, content in pdf.itertuples(index=False, name=None):
                why = composition(content, path)
                out.append((file_id, copy, why, why is None or parses is None or parses(path, content)))
            yield pd.DataFrame(out, columns=["file_id", "copy", "reason", "fine"])

    judged = spread(rows.select("file_id", "copy", "path", "content")).mapInPandas(judge, "file_id bigint, copy bigint, reason string, fine boolean")
    judged = cut_lineage(judged)
    copies = vendored(rows.where(code).select("copy", "project", "content"), libraries)
    joined = join_unique(judged, copies, "copy", "left", hot_keys(judged, "copy", judged.count()))
    joined = cut_lineage(joined.where("reason is not null or containment is not null").select("file_id", "reason", "fine", "containment"))
    own = joined.where("reason is not null and fine").select("file_id", "reason", "containment")
    suspects = joined.where("reason is null").select("file_id", "containment")
    if suspects.count() <= BROADCAST_IDS:
        suspects = F.broadcast(suspects)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, "vendored", share) for i, p, c, share in pdf[["file_id", "path", "content", "containment"]].itertuples(index=False, name=None) if parses is None or parses(p, c)]
            yield pd.DataFrame(rows, columns=["file_id", "reason", "containment"])

    taken = rows.select("file_id", "path", "content").join(suspects, "file_id").mapInPandas(check, "file_id bigint, reason string, containment double")
    return own.unionByName(taken)
