"""Source files that do not parse in the language that their path implies.

A file is lexed, its brackets (and indented blocks) are matched, and each content is recognised by generalised LL over a graph-structured
stack (gll, grammars), for the start symbols of all dialects of its extension at once. Expressions inside templates, formatted strings and elements are
recognised likewise. A file that every dialect of its extension rejects is flagged."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import grammars
from plumbline.llm.gll import Grammar
from plumbline.session import spread

# Extensions and the dialects that a file with one may be in.
EXTENSIONS = {
    "py": ("python",),
    "pyi": ("python",),
    "js": ("javascript",),
    "mjs": ("javascript",),
    "cjs": ("javascript", "javascript:Script"),
    "jsx": ("javascript",),
    "ts": ("typescript",),
    "tsx": ("typescript+jsx",),
    "mts": ("typescript",),
    "cts": ("typescript",),
    "go": ("go",),
    "rs": ("rust",),
    "java": ("java",),
    "json": ("json",),
    "yaml": ("yaml",),
    "yml": ("yaml",),
    "toml": ("toml",),
    "d.ts": ("typescript", "typescript:Ambient"),
    "d.mts": ("typescript", "typescript:Ambient"),
    "d.cts": ("typescript", "typescript:Ambient"),
}

_OPEN = {"(": "P", "[": "B", "{": "C"}
_CLOSE = {")": "P", "]": "B", "}": "C"}
# Space and comments are taken possessively, and every text ends with a mark: else what closes a text could be read again as something else.
_SPACE = r"(?:[^\S\n]+|//[^\n]*|/\*.*?\*/|\ufeff)*+"
_WORD = r"[^\W\d]\w*"
_DQ = r"\"(?:[^\"\\\n]|\\(?:\r\n|.))*\""
_SQ = r"'(?:[^'\\\n]|\\(?:\r\n|.))*'"

_ECMA = re.compile(
    _SPACE
    + r"(\n|(?:[^\W\d]|[$#])[\w$]*|"
    + _DQ
    + "|"
    + _SQ
    + r"|`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"
    + r"|(?:(?<=[(,=:\[!&|?{};\n+])|(?<=[(,=:\[!&|?{};+] )|(?<==>)|(?<==> )|(?<=return )|(?<=case )|(?<=typeof ))/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    + r"|\.?\d(?:[\w.]|(?<=[eE])[+-](?=\d))*|=>|===|!==|==|!=|<<=|<<|<=|\+\+|--|\*\*=|\*\*|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\.\.\.|[+\-*/%&|^]=|.)",
    re.S,
)
_GO = re.compile(
    _SPACE + r"(\n|" + _WORD + "|" + _DQ + r"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,9}?)'|\.?\d(?:[\w.]|(?<=[eEpP])[+-](?=\d))*|:=|\.\.\.|&\^=|<<=|>>=|&\^|<<|>>|<-|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|.)",
    re.S,
)
_RUST = re.compile(
    r"(?:\s+|//[^\n]*|/\*.*?\*/|\ufeff|#!(?!\s*\[)[^\n]*)*+"
    + r"(b?r(#*)\".*?\"\2|[bc]?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\[^\n]{1,10}?)'|'[^\W\d]\w*(?!')|r#"
    + _WORD
    + "|"
    + _WORD
    + r"|\d\w*(?:\.(?![.\w])|\.\d\w*)?(?:(?<=[eE])[+-]\d\w*)?|::|->|=>|\.\.=|\.\.\.|\.\.|<<=|>>=|&&|\|\||[=!<>+\-*/%&|^]=|.)",
    re.S,
)
_JAVA = re.compile(
    r"(?:\s+|//[^\n]*|/\*.*?\*/|\ufeff)*+(\"\"\"(?:[^\\]|\\.)*?\"\"\"|" + _DQ + r"|'(?:[^'\\\n]|\\[^\n]{1,6}?)'|non-sealed\b|(?:[^\W\d]|\$)[\w$]*|\.?\d(?:[\w.]|(?<=[eEpP])[+-](?=\d))*|->|::|\.\.\.|<<=|>>>=|>>=|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|.)",
    re.S,
)
_PYTHON = re.compile(
    r"(?:[ \t\f\r]+|\\\r?\n|\ufeff|#[^\n]*)*+"
    + r"((?:\n(?:[ \t\f\r]*(?:#[^\n]*)?(?=\n))*)+[ \t\f]*|(?:[rRbBuUfFtT]{0,3})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"
    + r"\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\n]|\\(?:\r\n|.))*')|"
    + _WORD
    + r"|(?:\.\d|\d)(?:[\w.]|(?<=[eE])[+-](?=\d))*|:=|->|\.\.\.|\*\*=|//=|>>=|<<=|\*\*|//|>>|<<|[=!<>+\-*/%@&|^]=|.)",
    re.S,
)
_JSON = re.compile(r"[ \t\r\n]*+(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[a-z]+|[^ \t\r\n])")
_FORMATTED = re.compile(r"(?<!\w)[rR]?[fFtT][rR]?[\"']")
_PY_FIELD = re.compile(r"(?<!\w)[a-zA-Z]{0,2}(?:\"\"\"|\'\'\'|\"|')|#[^\n]*|!=|[()\[\]{}!:]")
_TOML = re.compile(r"(?:[ \t\r]+|#[^\n]*|\ufeff)*+(\n|\"\"\"(?:[^\\]|\\.)*?\"{3,5}|'''.*?'{3,5}|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|[^\s\[\]{},=#\"']+|.)", re.S)
_TOML_VALUE = re.compile(
    r"(?:true|false|[+-]?(?:inf|nan)|0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?"
    r"|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?)"
)
_TOML_KEY = re.compile(r"\.?[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.?|\.")
_PY_NUMBER = re.compile(r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|0(?:_?0)*|[1-9](?:_?\d)*|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])")
#: A pattern that begins a line, and the blanks before it: an operator hardly stands there.
_LINE_REGEX = re.compile(r"\n[ \t]+(?=/[^/*\s][^\n]*/[a-z]*[,.;)\]\s])")
#: What can hold a template's sign without beginning one.
_ECMA_OPAQUE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?:(?<=[(,=:\[!&|?{};\n+])|(?<=[(,=:\[!&|?{};+] )|(?<=return ))/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|`", re.S)
_PY_OPAQUE = re.compile(r"#[^\n]*|(?<!\w)([a-zA-Z]{0,2})(\"\"\"|\'\'\'|\"|')")


def _language(dialect: str) -> str:
    return dialect.partition("+")[0].partition(":")[0]


class Rejected(Exception):
    """The text is not valid in the language."""


class Parser:
    """Lexer and grammar of one language; keeps what it has recognised."""

    def __init__(self, language: str) -> None:
        self.g: Grammar = grammars.build(language)
        self.language = language
        self.known: dict[tuple[str, tuple[str, ...]], bool] = {}
        g = self.g
        self.start = g.number["Module" if "Module" in g.number else "File"]
        self.kinds = {t: i for t, i in g.terminals.items() if not (t.isupper() and len(t) > 1 and t.isalpha())}
        self.classes = {t: i for t, i in g.terminals.items() if t.isupper() and t.isalpha()}
        word = {t for t in self.kinds if t[0].isalpha()}
        self.nl = self.classes.get("NL", -1)
        if language in ("javascript", "typescript", "typescript+jsx"):
            self.ending = {self.classes[c] for c in ("ID", "NUM", "STR", "TEMPLATE", "REGEX", "JSX", "PRIVATE")}
            operators = word - set("typeof void delete await in instanceof new else do case extends export default import const let var throw yield of as from satisfies keyof infer".split())
            self.ending |= {self.kinds[w] for w in operators} | {self.kinds["++"], self.kinds["--"], self.kinds["of"], self.kinds["as"], self.kinds["from"]}
            if language != "javascript":
                self.ending |= {self.kinds[t] for t in (">", "void", "const")}  # these may end a type or ``as const``; behind operators the grammar skips line ends
            self.going_on = {t for t in self.kinds if not t[0].isalpha() and t not in ("++", "--", "!", "~", "@", "...", "'") and t != "}"} | {"else", "catch", "finally", "instanceof", "in", "(", "[", "{", ")", "]", "satisfies"}
        elif language == "go":
            self.ending = {self.classes[c] for c in ("ID", "NUM", "STR", "RUNE")} | {self.kinds[w] for w in ("break", "continue", "fallthrough", "return", "++", "--")}

    def accepts(self, text: str, starts: tuple[str, ...] = ()) -> bool:
        """Whether ``text`` derives from one of the nonterminals ``starts``, by default the language's own; all are recognised on one stack."""
        if 4 * len(text) + 500 > sys.getrecursionlimit():  # no nesting is deeper than its text is long
            sys.setrecursionlimit(4 * len(text) + 2_000)
        numbers = [self.g.number[n] for n in starts] or [self.start]
        try:
            tokens = getattr(self, f"_{_language(self.language)}")(text)
        except Rejected:
            return False
        mask = self.g.content("TOP" + ",".join(starts), tokens, numbers)
        return any(mask >> x & 1 for x in numbers)

    def _embedded(self, text: str, starts: tuple[str, ...]) -> None:
        """Reject what is no expression inside a template, formatted string or element."""
        got = self.known.get((text, starts))
        if got is None:
            got = self.accepts(text, starts)
            if len(self.known) < 50_000:  # a memo only
                self.known[text, starts] = got
        if not got:
            raise Rejected

    def _close(self, stack: list, kind: str) -> int:
        """Symbol of the group that ends here, of ``kind``."""
        opened, tokens = stack.pop()
        if opened != kind or not stack:
            raise Rejected
        mask = self.g.content(kind, tokens)
        if not mask:
            raise Rejected
        return self.g.symbol(kind, mask)

    def _grouped(self, tokens: Iterator[str], kind_of: Callable[[str], int]) -> list[int]:
        stack: list[tuple[str, list[int]]] = [("", [])]
        out = stack[0][1]
        known = self.kinds
        for t in tokens:
            if t in _OPEN:
                out = []
                stack.append((_OPEN[t], out))
            elif t in _CLOSE:
                symbol = self._close(stack, _CLOSE[t])
                out = stack[-1][1]
                out.append(symbol)
            else:
                k = known.get(t)
                out.append(kind_of(t) if k is None else k)
        if len(stack) != 1:
            raise Rejected
        return out

    def _javascript(self, text: str) -> list[int]:
        if text.startswith("#!"):
            text = text[text.find("\n") + 1 :] if "\n" in text else ""
        text = _LINE_REGEX.sub("\n", text)
        if "${" in text:
            text = self._templates(text)
        text = self._jsx(text) if self.language != "typescript" and "<" in text and re.search(r"(?:[(=?:,{}&|]|return)\s*<[A-Za-z>]", text) else text
        stack: list[tuple[str, list[int]]] = [("", [])]
        out = stack[0][1]
        known, ending, going_on, nl, base = self.kinds, self.ending, self.going_on, self.nl, self.g.base
        fresh = False
        for t in _ECMA.findall(text + "\n"):
            if t == "\n":
                fresh = True
                continue
            if t == "}" or fresh and t not in going_on:
                # A statement may end here: at a line's end or before a closing brace, behind a token that can end one.
                if stack[-1][0] in ("", "C") and out and (out[-1] >= base or out[-1] in ending):
                    out.append(nl)
            fresh = False
            if t in _OPEN:
                out = []
                stack.append((_OPEN[t], out))
            elif t in _CLOSE:
                symbol = self._close(stack, _CLOSE[t])
                out = stack[-1][1]
                out.append(symbol)
            else:
                k = known.get(t)
                out.append(self._ecma_kind(t) if k is None else k)
        if len(stack) != 1:
            raise Rejected
        if out and (out[-1] >= base or out[-1] in ending):
            out.append(nl)
        return out

    _typescript = _javascript

    def _templates(self, text: str) -> str:
        """Text with every template that holds expressions replaced by a plain one; the expressions, or in types the types, are recognised."""
        out, at, pos = [], 0, 0
        while m := _ECMA_OPAQUE.search(text, pos):
            pos = m.end()
            if m[0] == "`":
                end = self._template(text, pos)
                out += [text[at : m.start()], "`t`"]
                at = pos = end
        return "".join([*out, text[at:]])

    def _template(self, text: str, at: int) -> int:
        """End of the template whose contents begin at ``at``."""
        starts = ("Expr",) if self.language == "javascript" else ("Expr", "TypeIn")
        while m := _TEMPLATE_PART.search(text, at):
            at = m.end()
            if m[0] == "`":
                return at
            if m[0] == "${":
                end = self._braced(text, at)
                self._embedded(text[at : end - 1], starts)
                at = end
        raise Rejected

    def _braced(self, text: str, at: int) -> int:
        """End of the braces whose contents begin at ``at``."""
        depth = 1
        while m := _BRACED_PART.search(text, at):
            at = m.end()
            if m[0] == "`":
                at = self._template(text, at)
            elif m[0] in "{}":
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    return at
        raise Rejected

    def _jsx(self, text: str) -> str:
        """Text with every JSX element replaced by one mark; what stands in its braces is recognised. Unbalanced elements stay, and are rejected."""
        out, at = [], 0
        for m in re.finditer(r"(?:[(=?:,{}&|>]|return)\s*(?=<[A-Za-z>])", text):
            if m.end() < at:
                continue
            end = self._element(text, m.end())
            if end is not None:
                out += [text[at : m.end()], "\ue000"]
                at = end
        return "".join([*out, text[at:]])

    def _held(self, text: str, at: int, attribute: bool) -> int | None:
        """End of the braces that open at ``at`` inside an element, whose contents must be an expression, a spread, or (of children) nothing."""
        end = _braces(text, at)
        if end is None:
            return None
        inner = _ECMA_COMMENT.sub(" ", text[at + 1 : end - 1]).strip()
        if not inner:
            return None if attribute else end
        try:
            self._embedded(inner.removeprefix("..."), ("Expr",))
        except Rejected:  # no element: what stands here may be a comparison or a type
            return None
        return end

    def _element(self, text: str, at: int) -> int | None:
        """End of the JSX element that begins at ``at``, or None."""
        open_tags: list[str] = []
        while at < len(text):
            m = _TAG_NAME.match(text, at)
            if m is None:
                return None
            name, at = m[1] or "", m.end()
            while at < len(text) and text[at] != ">" and not text.startswith("/>", at):
                if text[at] == "{":
                    end = self._held(text, at, True)
                    if end is None:
                        return None
                    at = end
                elif a := _ATTRIBUTE.match(text, at):
                    at = a.end()
                else:
                    return None
            if text.startswith("/>", at):
                at += 2
            else:
                at += 1
                open_tags.append(name)
            while True:
                if not open_tags:
                    return at
                nxt = re.compile(r"[<{]").search(text, at)
                if nxt is None:
                    return None
                at = nxt.start()
                if text[at] == "{":
                    end = self._held(text, at, False)
                    if end is None:
                        return None
                    at = end
                    continue
                c = re.compile(r"</\s*([\w.:-]*)\s*>").match(text, at)
                if c is None:
                    break
                if c[1] != open_tags.pop():
                    return None
                at = c.end()
        return None

    def _ecma_kind(self, t: str) -> int:
        c = t[0]
        if c == "#":
            return self._class("PRIVATE", len(t) > 1)
        if c.isalpha() or c in "_$":
            return self.classes["ID"]
        if c.isdigit() or c == "." and len(t) > 1:
            return self.classes["NUM"]
        if c in "\"'":
            return self._class("STR", len(t) > 1)
        if c == "`":
            return self._class("TEMPLATE", len(t) > 1)
        if c == "/" and len(t) > 2:
            return self.classes["REGEX"]
        if c == "\ue000":
            return self.classes["JSX"]
        raise Rejected

    def _class(self, name: str, fine: bool) -> int:
        if not fine:
            raise Rejected
        return self.classes[name]

    def _go(self, text: str) -> list[int]:
        semi, ending, base = self.kinds[";"], self.ending, self.g.base
        stack: list[tuple[str, list[int]]] = [("", [])]
        out = stack[0][1]
        known = self.kinds
        tokens = _GO.findall(text + "\n")
        for t in tokens:
            if t == "\n":
                if out and (out[-1] in ending or out[-1] >= base):
                    out.append(semi)
            elif t in _OPEN:
                out = []
                stack.append((_OPEN[t], out))
            elif t in _CLOSE:
                symbol = self._close(stack, _CLOSE[t])
                out = stack[-1][1]
                out.append(symbol)
            else:
                k = known.get(t)
                if k is None:
                    c = t[0]
                    if c.isalpha() or c == "_":
                        k = self.classes["ID"]
                    elif c.isdigit() or c == ".":
                        k = self.classes["NUM"]
                    elif c in "\"`":
                        k = self._class("STR", len(t) > 1)
                    elif c == "'":
                        k = self._class("RUNE", len(t) > 2)
                    else:
                        raise Rejected
                out.append(k)
        if len(stack) != 1:
            raise Rejected
        return out

    def _rust(self, text: str) -> list[int]:
        return self._grouped([t[0] for t in _RUST.findall(text + "\n\0")][:-1], self._rust_kind)

    def _rust_kind(self, t: str) -> int:
        c = t[0]
        if t[-1] == '"':
            return self._class("STR", len(t) > 1)
        if c == "'" or t[:2] == "b'":
            if t[-1] == "'" and len(t) > 2:
                return self.classes["CHAR"]
            return self._class("LIFETIME", len(t) > 1)
        if c.isalpha() or c == "_":
            return self.classes["ID"]
        return self._class("NUM", c.isdigit())

    def _java(self, text: str) -> list[int]:
        return self._grouped(_JAVA.findall(text + "\n\0")[:-1], self._java_kind)

    def _java_kind(self, t: str) -> int:
        c = t[0]
        if c == '"':
            return self._class("STR", len(t) > 1)
        if c == "'":
            return self._class("CHAR", len(t) > 2)
        if c.isalpha() or c in "_$":
            return self.classes["ID"]
        return self._class("NUM", c.isdigit() or c == "." and len(t) > 1)

    def _formatted(self, text: str) -> str:
        """Text with every formatted string replaced by a plain one; the expressions in it are recognised, and may hold strings of the same quotes."""
        out, at, pos = [], 0, 0
        while m := _PY_OPAQUE.search(text, pos):
            pos = m.end()
            if m[2] is None:
                continue
            prefix = m[1].lower()
            if set(prefix) & set("ft") and not set(prefix) - set("ftr"):
                end = self._fstring(text, pos, m[2], 0)
                out += [text[at : m.start()], "''"]
                at = pos = end
            else:
                pos = self._plain(text, pos, m[2])
        return "".join([*out, text[at:]])

    def _plain(self, text: str, at: int, quote: str) -> int:
        """End of the plain string whose contents begin at ``at``; of a broken one, where it breaks off."""
        for m in re.compile(r"\\.|" + quote + ("" if len(quote) == 3 else r"|\n"), re.S).finditer(text, at):
            if m[0][0] != "\\":
                return m.end() if m[0] == quote else m.start()
        return len(text)

    def _fstring(self, text: str, at: int, quote: str, inner: int) -> int:
        """End of the formatted string whose contents begin at ``at``, or with ``inner`` of a format in it, which ends before its closing brace."""
        parts = re.compile(r"\\N\{[^}\n]*\}|\\[^{}]|" + quote + r"|[{}]" + ("" if len(quote) == 3 else r"|\n"), re.S)
        while m := parts.search(text, at):
            t, at = m[0], m.end()
            if t == quote:
                if inner:
                    raise Rejected
                return at
            if t == "\n":
                raise Rejected
            if t == "{":
                if not inner and text.startswith("{", at):
                    at += 1
                else:
                    at = self._field(text, at, quote, inner + 1)
            elif t == "}":
                if inner:
                    return at - 1
                if not text.startswith("}", at):
                    raise Rejected
                at += 1
        raise Rejected

    def _field(self, text: str, at: int, quote: str, inner: int) -> int:
        """End of the replacement field whose contents begin at ``at``."""
        begin, depth, remark = at, 0, None
        while m := _PY_FIELD.search(text, at):
            t, at = m[0], m.end()
            if t[0] == "#":
                remark = m
                continue
            if t[-1] in "\"'":
                prefix = t.rstrip("\"'").lower()
                mark = t[len(prefix) :]
                at = self._fstring(text, at, mark, 0) if set(prefix) & set("ft") else self._plain(text, at, mark)
            elif t in "([{":
                depth += 1
            elif t in ")]" or t == "}" and depth:
                depth -= 1
            elif depth or t == "!=":
                continue
            else:
                last = remark is not None and not text[remark.end() : m.start()].strip()
                inside = text[begin : remark.start() if last else m.start()].rstrip()
                if inside.endswith("=") and inside[-2:-1] not in "=!<>":
                    inside = inside[:-1]
                if not inside.strip():
                    raise Rejected
                self._embedded("(" + inside + "\n)\n", ("File",))
                if t == "!":
                    c = re.compile(r"[rsa]\s*(?=[:}])").match(text, at)
                    if c is None:
                        raise Rejected
                    t, at = text[c.end()], c.end() + 1
                if t == ":":
                    at = self._fstring(text, at, quote, inner) + 1
                return at
        raise Rejected

    def _python(self, text: str) -> list[int]:
        if _FORMATTED.search(text):
            text = self._formatted(text)
        nl, known, base = self.nl, self.kinds, self.g.base
        stack: list[tuple[str, list[int]]] = [("", [])]
        indents = [0]
        out = stack[0][1]
        depth = 0
        tokens = _PYTHON.findall("\n" + text + "\n")
        for t in tokens:
            if t[0] == "\n":
                if depth:
                    continue
                if out and out[-1] != nl and not (out[-1] >= base and self.g.groups[out[-1] - base][0] == "I"):
                    out.append(nl)
                lead = t[t.rfind("\n") + 1 :]
                width = len(lead.expandtabs(8)) if "\t" in lead else len(lead)
                pending = width
            else:
                if pending >= 0:
                    # The first token of a logical line: open or close indented blocks.
                    if pending > indents[-1]:
                        indents.append(pending)
                        out = []
                        stack.append(("I", out))
                    while pending < indents[-1]:
                        indents.pop()
                        symbol = self._close(stack, "I")
                        out = stack[-1][1]
                        out.append(symbol)
                    if pending != indents[-1]:
                        raise Rejected
                    pending = -1
                if t in _OPEN:
                    out = []
                    stack.append((_OPEN[t], out))
                    depth += 1
                elif t in _CLOSE:
                    symbol = self._close(stack, _CLOSE[t])
                    out = stack[-1][1]
                    out.append(symbol)
                    depth -= 1
                else:
                    k = known.get(t)
                    out.append(self._python_kind(t) if k is None else k)
        while len(indents) > 1:
            indents.pop()
            symbol = self._close(stack, "I")
            out = stack[-1][1]
            out.append(symbol)
        if len(stack) != 1:
            raise Rejected
        return out

    def _python_kind(self, t: str) -> int:
        c = t[0]
        if t[-1] in "\"'":
            return self._class("STR", len(t) > 1)
        if c.isalpha() or c == "_":
            return self.classes["ID"]
        return self._class("NUM", _PY_NUMBER.fullmatch(t) is not None)

    def _json(self, text: str) -> list[int]:
        return self._grouped(_JSON.findall(text), self._json_kind)

    def _json_kind(self, t: str) -> int:
        if t[0] == '"':
            return self._class("STR", len(t) > 1)
        return self._class("NUM", t[-1].isdigit() and (t[0].isdigit() or t[0] == "-"))

    def _toml(self, text: str) -> list[int]:
        stack: list[tuple[str, list[int]]] = [("", [])]
        values = [False]  # whether values, not keys, are read in this group
        out, expect = stack[0][1], False
        equal, comma, dot = self.kinds["="], self.kinds[","], self.kinds["."]
        tokens = _TOML.findall(text + "\n")
        for t in tokens:
            if t in _OPEN and t != "(":
                out = []
                stack.append((_OPEN[t], out))
                values.append(t == "[" and (expect or values[-1]))
                expect = values[-1]
            elif t in _CLOSE and t != ")":
                symbol = self._close(stack, _CLOSE[t])
                values.pop()
                out = stack[-1][1]
                out.append(symbol)
                expect = values[-1]
            elif t == "\n":
                out.append(self.nl)
                expect = values[-1]
            elif t == "=":
                out.append(equal)
                expect = True
            elif t == ",":
                out.append(comma)
                expect = values[-1]
            elif t[0] in "\"'":
                if len(t) < 2:
                    raise Rejected
                out.append(self.classes["LONG" if t[:3] in ('"""', "'''") and len(t) >= 6 and expect else "STR"])
                expect = False or values[-1]
            elif expect:
                if not _TOML_VALUE.fullmatch(t):
                    raise Rejected
                # A date and a time may be apart.
                out.append(self.classes["VALUE"])
                expect = values[-1]
            else:
                if not _TOML_KEY.fullmatch(t):
                    raise Rejected
                parts = re.findall(r"\.|[^.]+", t)
                out += [dot if x == "." else self.classes["KEY"] for x in parts]
        if len(stack) != 1:
            raise Rejected
        return out

    def _yaml(self, text: str) -> list[int]:
        return _Yaml(self, text).tokens()


_YAML_KEY = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s]))(?:[^\s:#]|:(?=[^\s])|(?<=\S)#|[ \t]+(?=[^\s#:])|[ \t]+:(?=\S))*|\?[ \t]+\S.*?)[ \t]*:(?=\s|$)")
_YAML_SCALAR = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#:])|[ \t]+:(?=\S))*")
_YAML_FLOW = re.compile(r"\s*(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[\[\]{},]|:(?=[\s,\[\]{}]|$)|[&*!][^\s,\[\]{}]*|\?(?=\s)|(?:[^\s,\[\]{}#&*!|>'\"%@`:]|:(?=[^\s,\[\]{}]))(?:[^\s,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s,\[\]{}#:]))*|#[^\n]*|.)", re.S)
_YAML_BLOCK = re.compile(r"[|>](?:[1-9]?[+-]?|[+-][1-9])[ \t]*(?:[ \t]#.*)?$")
_YAML_PROP = re.compile(r"([&!][^\s,\[\]{}]*)(?:[ \t]+|$)")


class _Yaml:
    """Block structure of a YAML text as tokens; an indented block is one group."""

    def __init__(self, parser: Parser, text: str) -> None:
        self.p, self.g, self.c = parser, parser.g, parser.classes
        self.lines = text.lstrip("\ufeff").replace("\r\n", "\n").split("\n")
        self.i = 0

    def tokens(self) -> list[int]:
        out: list[int] = []
        while (got := self._peek()) is not None:
            indent, body = got
            if body == "---" or body.startswith("--- "):
                out.append(self.c["MARK"])
                self._replace(4, body[4:]) if body[4:].strip() and not body[4:].lstrip().startswith("#") else self._skip()
            elif body == "...":
                self._skip()
            elif body.startswith("%") and not out:
                self._skip()
            else:
                out += self._node(indent)
        return out

    def _skip(self) -> None:
        self.i += 1

    def _peek(self) -> tuple[int, str] | None:
        """Indent and text of the next line that holds something."""
        while self.i < len(self.lines):
            line = self.lines[self.i]
            body = line.lstrip(" ")
            bare = body.strip()
            if bare and not bare.startswith("#"):
                if body.startswith("\t"):
                    raise Rejected
                return len(line) - len(body), body.rstrip()
            self.i += 1
        return None

    def _replace(self, indent: int, body: str) -> None:
        """Put the rest of a line in its place, as a line of its own indent."""
        self.lines[self.i] = " " * (indent + len(body) - len(body.lstrip(" "))) + body.lstrip(" ")

    def _node(self, indent: int) -> list[int]:
        """Tokens of all entries at exactly ``indent``; the first line is at it."""
        out: list[int] = []
        while (got := self._peek()) is not None and got[0] == indent:
            body = got[1]
            if indent == 0 and (body == "..." or body == "---" or body.startswith("--- ")):
                break
            if body == "-" or body.startswith(("- ", "-\t")):
                out.append(self.c["DASH"])
                rest = body[1:]
                if rest.strip() and not rest.lstrip().startswith("#"):
                    inner = rest.lstrip()
                    if _YAML_KEY.match(inner) or inner == "-" or inner.startswith("- "):
                        self._replace(indent + 1, rest)
                        out.append(self._inner(indent))
                        continue
                    out += self._value(rest, indent)
                else:
                    self._skip()
                    out += self._below(indent, False)
                continue
            m = _YAML_KEY.match(body)
            if m:
                out.append(self.c["KEY"])
                rest = body[m.end() :]
                if rest.strip() and not rest.lstrip().startswith("#"):
                    out += self._value(rest, indent)
                else:
                    self._skip()
                    out += self._below(indent, True)
                continue
            out += self._value(body, indent - 1)
        if (got := self._peek()) is not None and got[0] > indent:
            raise Rejected
        return out

    def _inner(self, indent: int) -> int:
        got = self._peek()
        tokens = self._node(got[0])
        mask = self.g.content("I", tokens)
        if not mask:
            raise Rejected
        return self.g.symbol("I", mask)

    def _below(self, indent: int, key: bool) -> list[int]:
        """The block below an entry without a value on its line. Below a key, a sequence may stand at the key's own indent."""
        got = self._peek()
        if got is None or got[0] <= indent:
            return []
        return [self._inner(indent)]

    def _value(self, rest: str, indent: int) -> list[int]:
        """Tokens of a value that begins on this line; consumes its lines."""
        out: list[int] = []
        rest = rest.strip()
        while m := _YAML_PROP.match(rest):
            out.append(self.c["ANCHOR" if rest[0] == "&" else "TAG"])
            rest = rest[m.end() :]
        if not rest or rest.startswith("#"):
            self._skip()
            return out + self._below(indent, True)
        if rest[0] == "*":
            self._skip()
            if not re.fullmatch(r"\*[^\s,\[\]{}]+(?:\s+#.*)?", rest):
                raise Rejected
            return [*out, self.c["ALIAS"]]
        if rest[0] in "|>":
            if not _YAML_BLOCK.match(rest):
                raise Rejected
            self._skip()
            while self.i < len(self.lines):
                line = self.lines[self.i]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                    break
                self._skip()
            return [*out, self.c["TEXT"]]
        if rest[0] in "\"'":
            return out + self._quoted(rest, indent)
        if rest[0] in "[{":
            return out + self._flow(rest)
        m = _YAML_SCALAR.match(rest)
        if m is None:
            raise Rejected
        tail = rest[m.end() :].strip()
        if tail and not tail.startswith("#"):
            raise Rejected
        self._skip()
        # A plain value goes on in deeper lines that are no entries themselves.
        while (got := self._peek()) is not None and got[0] > indent and not tail:
            more = got[1]
            if _YAML_KEY.match(more):
                raise Rejected
            m = re.match(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#:])|[ \t]+:(?=\S))*", more)
            tail = more[m.end() :].strip()
            if tail and not tail.startswith("#"):
                raise Rejected
            self._skip()
        return [*out, self.c["SCALAR"]]

    def _quoted(self, rest: str, indent: int) -> list[int]:
        pattern = re.compile(r"\"(?:[^\"\\]|\\.)*\"" if rest[0] == '"' else r"'(?:[^']|'')*'", re.S)
        whole = rest
        while (m := pattern.match(whole)) is None:
            self._skip()
            if self.i >= len(self.lines) or self.lines[self.i].startswith(("---", "...")):
                raise Rejected
            whole += "\n" + self.lines[self.i]
        self._skip()
        tail = whole[m.end() :].strip()
        if tail and not tail.startswith("#"):
            raise Rejected
        return [self.c["STR"]]

    def _flow(self, rest: str) -> list[int]:
        """Tokens of a flow collection, which may go on over lines."""
        stack: list[tuple[str, list[int]]] = [("", [])]
        whole = rest
        while True:
            stack, at, done = [("", [])], 0, False
            for m in _YAML_FLOW.finditer(whole):
                t = m[1]
                if t[0] == "#":
                    continue
                if t in "[{":
                    stack.append((_OPEN[t], []))
                elif t in "]}":
                    symbol = self.p._close(stack, _CLOSE[t])
                    stack[-1][1].append(symbol)
                    if len(stack) == 1:
                        at, done = m.end(), True
                        break
                elif t in (",", ":", "?"):
                    stack[-1][1].append(self.p.kinds[t])
                elif t[0] in "\"'":
                    if len(t) < 2:
                        break
                    stack[-1][1].append(self.c["STR"])
                elif t[0] in "&!*":
                    stack[-1][1].append(self.c["ALIAS" if t[0] == "*" else "ANCHOR" if t[0] == "&" else "TAG"])
                elif t.isspace():
                    continue
                else:
                    if t[0] in "|>%@`":
                        raise Rejected
                    stack[-1][1].append(self.c["SCALAR"])
            if done:
                break
            self._skip()
            if self.i >= len(self.lines):
                raise Rejected
            whole += "\n" + self.lines[self.i]
        self._skip()
        tail = whole[at:].strip()
        if tail and not tail.startswith("#"):
            raise Rejected
        return stack[0][1]


_TEMPLATE_PART = re.compile(r"\\.|`|\$\{", re.S)
_BRACED_PART = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[`{}]", re.S)
_ECMA_COMMENT = re.compile(r"(?<!:)//[^\n]*|/\*.*?\*/", re.S)
_ATTRIBUTE = re.compile(r"\s+|[\w:.-]+|=|\"[^\"]*\"|'[^']*'")
_TAG_NAME = re.compile(r"<([A-Za-z][\w.:-]*)?")


def _braces(text: str, at: int) -> int | None:
    """End of the braces that open at ``at``."""
    depth = 0
    for m in re.compile(r"[{}]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`").finditer(text, at):
        depth += (m[0] == "{") - (m[0] == "}")
        if not depth:
            return m.end()
    return None


@lru_cache(maxsize=None)
def parser(language: str) -> Parser:
    return Parser(language)


def parses(path: str, content: str | None) -> bool:
    """Whether ``content`` is valid in a dialect of the language that the path's extension implies; True for other extensions and null contents. The dialects
    of one grammar are recognised together."""
    if content is None:
        return True
    dialects = _dialects(path)
    if not dialects:
        return True
    grammar = dialects[0].partition(":")[0]
    extra = tuple(d.partition(":")[2] for d in dialects[1:])
    own = parser(grammar)
    return own.accepts(content, (own.g.names[own.start], *extra) if extra else ())


def _dialects(path: str) -> tuple[str, ...]:
    name = path.replace("\\", "/").rpartition("/")[2].lower()
    ext = name.rpartition(".")[2]
    return EXTENSIONS.get(f"d.{ext}" if name.endswith(f".d.{ext}") else ext, ())


def find_broken(files: DataFrame) -> DataFrame:
    """(file_id, project, language) of the rows of ``files`` (file_id, project, path, content) whose content does not parse in the language of their
    extension. Null contents and unknown extensions give no rows, empty files only where the language forbids them. Narrow (a few small files are spread over the cores first); files are read whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, project, implied(p)) for i, project, p, c in pdf.itertuples(index=False, name=None) if not parses(p, c)]
            yield pd.DataFrame(rows, columns=["file_id", "project", "language"])

    return spread(files.where("content is not null and path is not null").select("file_id", "project", "path", "content")).mapInPandas(run, "file_id bigint, project string, language string")


def implied(path: str) -> str | None:
    """The language that a path's extension implies."""
    dialects = _dialects(path)
    return _language(dialects[0]) if dialects else None


def rates(files: DataFrame, broken: DataFrame) -> DataFrame:
    """Files with content, broken ones and their rate per project and implied language."""
    ext = F.lower(F.regexp_extract(F.regexp_replace("path", r"\\", "/"), r"\.([^./]+)$", 1))
    language = F.coalesce(*[F.when(ext.isin([e for e, d in EXTENSIONS.items() if _language(d[0]) == name]), name) for name in dict.fromkeys(_language(d[0]) for d in EXTENSIONS.values())])
    every = files.where("content is not null").select("project", language.alias("language")).where("language is not null").groupBy("project", "language").agg(F.count("*").alias("files"))
    bad = broken.groupBy("project", "language").agg(F.count("*").alias("broken"))
    out = every.join(bad, ["project", "language"], "left").withColumn("broken", F.coalesce("broken", F.lit(0)))
    return out.withColumn("rate", F.col("broken") / F.col("files"))
