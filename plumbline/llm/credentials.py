"""Credentials embedded in source code: their places, and texts with the values replaced.

Method: the text is read by a lexer (strings with prefixes and escapes, comments, identifiers, numbers, signs; brackets are matched over lines). A literal
is flagged when it is assigned or passed to a credential-named identifier, key, header or setter and is no placeholder. What is no code - settings without
quotes, addresses, headers, prose, key blocks - is found by patterns, as are issued keys by their own shape. Only the contents of the literal
are replaced; quotes, escapes, schemes and user names stay as they are, so the surrounding code still parses."""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from plumbline.session import spread

MASK = "REDACTED"

# Words that make an identifier a credential, and last words that make it something about one.
STRONG = frozenset("password passwd pwd pass passphrase secret token apikey authtoken accesskey secretkey credential credentials cred creds".split())
WEAK = frozenset("key auth authorization session bearer master pat dsn conn connection storage account broker salt signature sig jwt cookie pem login webhook hook".split())
ABOUT = frozenset(
    "hint label help file path url uri name env id uuid count digest checksum hash sha256 md5 length len ttl expiry expires type kind field prompt message text title table policy rule rotation integrity commit build rev revision version format regex pattern placeholder example description public".split()
)
LOGIN = frozenset("login signin connectas connect authenticate setpassword setcredentials basicauth auth setsecret withpassword signinas opensession newsession createsession".split())

_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_LINE = re.compile(r"^[ \t#-]*(?:export[ \t]+|set[ \t]+)?([\w.-]+)(?:=|:[ \t]+)(?=[^\s\"'`=])", re.M)
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:-[A-Za-z_][\w$]*)*")
#: Comments are tokens whose contents are read in turn; quotes behind a letter are apostrophes, those of lifetimes no quotes.
_TOKEN = re.compile(
    r"(?P<S>(?:(?<![\w$])(?:[bBuUfFcCL@$]|[bBfFcC]?[rR]|[rR][bBfF])?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'\'\'(?:[^\\]|\\.)*?'\'\'|(?<![&<])'(?:[^'\\\n]|\\.)*')|(?:[bBuUfFcCL@$]|[bBfFcC]?[rR]|[rR][bBfF])?\"(?:[^\"\\\n]|\\.)*\")|b?r(?P<H>#+)\".*?\"(?P=H)|`[^`\n]*`)"
    r"|(?P<C>(?<!:)//[^\n]*|/\*.*?\*/|(?<!\S)#(?![\[\w!])[^\n]*|<!--.*?-->)|(?P<I>[A-Za-z_$][\w$]*(?:-[A-Za-z_][\w$]*)*)|(?P<D>\d[\w.]*)"
    r"|(?P<N>\n)|(?P<O>:=|===?|!==?|=>|<=|>=|=~|->|::|\|\|=?|\?\?=?|&&|\?:|\?=|\+=|[^\s\w])",
    re.S,
)
_ASSIGNING = frozenset(("=", ":=", "=>", ":", "+=", "||=", "??=", "?="))
_INSTEAD = frozenset(("||", "??", "?:", "or"))
#: Calls and conversions that keep the literal's value, by the first or last name of their path.
_KEEPING = frozenset("String str string bytes bytearray byte rune u8 Some Ok Just Secret SecretString SecretStr Buffer Optional Cow Box Arc Rc OsString Zeroizing Sensitive new from of valueOf ofNullable Owned Borrowed to_string into".split())
#: Keys that say nothing of their own: the key of the group that they are in names them.
_GENERIC = frozenset("value val data raw plain plaintext content default current".split())
_FOLDED = re.compile(r"^([ \t]*(?:-[ \t]+)?)[\"']?([\w.-]+)[\"']?:[ \t]*[|>][-+\d]*[ \t]*(?:#[^\n]*)?\n(?:[ \t]*\n)*([ \t]+)(\S+)[ \t]*$", re.M)
_SETTERS = frozenset(("set", "with", "use"))
_ASKING = frozenset(("get", "getenv", "env", "getproperty", "getordefault", "setdefault", "default", "lookup", "option", "envor", "getenvor", "getstring", "config"))
_BLANKS = re.compile(r"^[ \t]*([\w.-]+)[ \t]+=[ \t]*(?=[^\s\"'`=])|^[ \t]*([\w.-]+)=[ \t]+(?=[^\s\"'`=])", re.M)
_SHAPE = re.compile(
    r"\bAKIA[0-9A-Z]{16}\b|\bASIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}|\bgithub_pat_\w{30,}|\bglpat-[\w-]{18,}|\bnpm_[A-Za-z0-9]{30,}|\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|\bxox[abprs]-[\w-]{10,}|\bAIza[\w-]{30,}"
    r"|\beyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}|\bkey-[0-9A-Za-z]{24,}\b|\bpypi-[\w-]{40,}|\bSG\.[\w-]{20,}\.[\w-]{20,}"
)
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s\"'`<>\\]+")
_USERINFO = re.compile(r"://[^\s:/@?#]*:([^\s/?#]*(?:[/?#][^\s/@]*)?)@")
_QUERY = re.compile(r"[?&;]([\w.-]+)=([^&\s\"'#;]*)")
_HOOK = re.compile(r"://(?:hooks\.[^/\s]+/services/|[^/\s]+/(?:api/)?webhooks?/)([\w/-]{16,})")
_HEADER = re.compile(r"\b(Basic|Bearer|[Tt]oken) +([A-Za-z0-9+/._~=-]{12,})")
_ACCOUNT = re.compile(r"(?i)\b(?:AccountKey|SharedAccessKey|SharedSecret|Password|Pwd)=([^;\"'\s]+)")
_FLAG = re.compile(r"(?<!\w)--?(?:password|passwd|pass|secret|token|api-?key|auth-token|access-key)(?:[ =])([^\s\"'`\\]+)")
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_BODY = re.compile(r"[\sA-Za-z0-9+/=\\:,.-]*")
_LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
#: Unquoted values are read only where a line is a setting, as in environment files and YAML.
_SETTING = re.compile(r"[ \t#-]*(?:export[ \t]+|set[ \t]+)?[\w.-]+(?:=|:[ \t]+)")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]]+(?![^\s#,;])")
_NOTE = re.compile(r"(?i)\b(?:login|log in|credentials?|creds|account|password)\b[ \t]*(?:is|are|for \w+)?[ \t]*[:=][ \t]*[\w.@-]+[ \t]*(?:/|:|\|)[ \t]*([^\s\"'`,;]+)")
_PROSE = re.compile(r"(?i)\b(?:token|password|passwd|secret|passphrase|api[ -]?key|access[ -]?key)[ \t]+(?:was|is|are|still|now)[ \t]+(?:still |now )?[\"'`]?([^\s\"'`,;]+)")
_PLACEHOLDER = re.compile(
    r"^$|\$\{|\{\{|^\$[\w(]|^<[^>]*>?$|^%\(|^%[\w]+%$|^(?i:env)[:.(]|^(?i:file|vault|ssm|secrets?|op|arn)[:.]|^\.{0,2}/|^[*x•.#_?-]+$|^\*+|\*{4,}|[xX]{6,}"
    r"|^(?i:todo|tbd|fixme)|^(?i:none|null|nil|undefined|true|false|test)$|^(?:process\.env|os\.environ|getenv)|EXAMPLE(?![a-z])"
)
# Words by which a value says that it is none.
_STAND = "your|example|dummy|sample|placeholder|redacted|replace|insert|change[-_. ]?me"
_STANDS = re.compile(rf"(?i)(?:^|[^a-z0-9])(?:{_STAND})(?:$|[^a-z0-9])")
_STANDS_IN = re.compile(rf"(?i)(?=.*(?:{_STAND}))[^\W\d]+(?:[-_. ]*[^\W\d]+)*[-_. ]*\d*!?")
_HASHREF = re.compile(r"^(?:sha\d+|md5)[-:]")


def words(identifier: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(identifier)]


def entropy(value: str) -> float:
    """Bits per character of ``value``."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def placeholder(value: str) -> bool:
    """Whether a value is a stand-in: a mask, a reference, or words that say so, alone or apart from the rest; not where such a word is a part of something random."""
    return bool(_PLACEHOLDER.search(value) or _STANDS.search(value) or _STANDS_IN.fullmatch(value))


def usable(value: str, strict: bool = False, quoted: bool = False) -> bool:
    """Whether a literal can be a credential: no placeholder, mask, reference, digest mark, number or ordinary words. strict: it must
    look issued, for identifiers that only hint at a credential. quoted: eight digits or more can be one, unless they are in a row or alike."""
    v = value.strip()
    if len(v) < 6 or placeholder(v) or _HASHREF.match(v) or any(c.isspace() for c in v):
        return False
    letters, digits = sum(c.isalpha() for c in v), sum(c.isdigit() for c in v)
    if digits == len(v) and quoted and not strict:
        steps = {ord(b) - ord(a) for a, b in zip(v, v[1:])}
        return 8 <= digits < 20 and len(set(v)) > 3 and not steps <= {1, -9} and not steps <= {-1, 9}
    if not letters or digits == len(v):
        return False
    other = len(v) - letters - digits
    if strict:
        return len(v) >= 16 and digits > 0 and entropy(v) >= 3.0
    if digits:
        return True
    # No digit: ordinary words, also joined ones, are no values; letters whose case changes within two or three, and several signs, are.
    flips = sum(a.islower() != b.islower() for a, b in zip(v, v[1:]) if a.isalpha() and b.isalpha())
    if letters >= 8 and flips >= 3 and letters < 3.6 * len(_WORD.findall(v)):
        return True
    return other > 0 and not re.fullmatch(r"[\w./:-]+", v)


@lru_cache(maxsize=200_000)
def grade(identifier: str) -> int:
    """2: a credential's name; 1: only with a value that looks issued; 0: none."""
    w = words(identifier)
    if not w or w[-1] in ABOUT or "public" in w or "".join(w[-2:]) in ABOUT:
        return 0
    if any(x in STRONG for x in w[-2:]) or "".join(w[-2:]) in STRONG or w[-1] == "key" and any(x in ("api", "access", "secret", "private", "signing", "encryption", "shared", "deploy", "login", "auth") for x in w):
        return 2
    return 1 if w[-1] in WEAK else 0


class _Code:
    """Tokens of a stretch of text, without blanks: kinds, starts, ends; brackets are matched over lines. Comments and strings that hold quotes are codes of their own.

    The stretch begins at ``begin`` and ends with its statement: at the first line end, not before ``until``, at which no bracket is open and nothing goes on."""

    def __init__(self, text: str, begin: int, until: int, end: int) -> None:
        self.text = text
        self.kind: list[str] = []
        self.at: list[int] = []
        self.end: list[int] = []
        self.inner: list[tuple[int, int]] = []
        depth, last, blocks = 0, "", []
        self.stop = end
        for m in _TOKEN.finditer(text, begin, end):
            k = m.lastgroup
            a, b = m.span()
            if k == "N":
                if depth <= 0 and a >= until and last not in _GOING_ON and not _GOES_ON.match(text, b):
                    self.stop = b
                    break
            elif k == "O":
                t = m[0]
                if t in "([" or t == "{" and (last in _GOING_ON or last == ""):
                    depth += 1
                    blocks.append(True)
                elif t == "{":  # a block of statements is none of a value's brackets
                    blocks.append(False)
                elif t in ")]}":
                    depth -= blocks.pop() if blocks else depth > 0
                last = t
            elif k == "C":
                self.inner.append((a + 1, b))
            elif k == "I":
                last = m[0]
            else:
                if k == "H":
                    k = "S"
                if k == "S" and b - a > 12 and _NESTED.search(text, a + 1, b - 1):
                    self.inner.append((a + len(text[a:b]) - len(text[a:b].lstrip("bBrRuUfFcCL@$#\"'`")), b - 1))
                last = "0"
            self.kind.append(k)
            self.at.append(a)
            self.end.append(b)
        self.n = len(self.kind)
        self.match: dict[int, int] = {}
        self.outer: dict[int, int] | None = None
        stack: list[int] = []
        for i, k in enumerate(self.kind):
            if k == "O" and self.end[i] - self.at[i] == 1:
                c = text[self.at[i]]
                if c in "([{":
                    stack.append(i)
                elif c in ")]}" and stack:
                    self.match[stack.pop()] = i

    def of(self, i: int) -> str:
        return self.text[self.at[i] : self.end[i]] if 0 <= i < self.n else ""

    def skip(self, i: int, lines: bool = True) -> int:
        """The next token that is no comment, line end or line continuation."""
        while i < self.n and (self.kind[i] == "C" or self.kind[i] == "N" and lines or self.of(i) == "\\" and i + 1 < self.n and self.kind[i + 1] == "N"):
            i += 2 if self.of(i) == "\\" else 1
        return i

    def contents(self, i: int) -> tuple[int, int]:
        """Start and end of what a string token holds."""
        a, b = self.at[i], self.end[i]
        while self.text[a] not in "\"'`":
            a += 1
        q = self.text[a]
        if self.text[b - 1] == "#":
            return a + 1, self.text.rfind('"', a, b)
        return (a + 3, b - 3) if b - a >= 6 and self.text.startswith(q * 3, a) else (a + 1, b - 1)

    def name(self, i: int) -> str | None:
        """The name that a token gives: an identifier, or a string that can be a key."""
        if self.kind[i] == "I":
            return self.of(i)
        if self.kind[i] == "S" and self.end[i] - self.at[i] < 80:
            a, b = self.contents(i)
            got = self.text[a:b]
            return got.rpartition(".")[2] if _KEY.fullmatch(got) else None
        return None

    def sign(self, i: int) -> int:
        """The token behind the sign by which the name at ``i`` is assigned, over its index bracket and its type; -1 if there is none."""
        j = i + 1
        while j < self.n and self.of(j) in ("]", "?", "!") :
            j += 1
        t = self.of(j)
        if t == ":" or t == "?:":
            k = self._type(self.skip(j + 1, False))
            return k + 1 if self.of(k) in ("=", ":=") and k > j + 1 else j + 1
        if t in _ASSIGNING:
            return j + 1
        if j < self.n and (self.kind[j] == "I" or t in ("*", "[")) and self.kind[i] == "I":  # a type between the name and its sign
            k = self._type(j)
            if self.of(k) in ("=", ":=") and self.kind[j] != "N":
                return k + 1
            if self.of(i - 1) in ("define",) and self.kind[j] == "S":
                return j
        if self.of(i - 1) == "define" and j < self.n and self.kind[j] == "S":
            return j
        if j < self.n and self.kind[j] == "N":  # a sign may begin the next line
            k = self.skip(j)
            return k + 1 if self.of(k) in ("=", ":=") else -1
        return -1

    def _type(self, i: int) -> int:
        """The token behind a type that begins at ``i``: names, paths, arguments, references, alternatives."""
        while i < self.n:
            t = self.of(i)
            if t in ("[", "<", "("):
                if t == "<":
                    depth, j = 0, i
                    while j < self.n and self.kind[j] != "N":
                        depth += (self.of(j) == "<") - (self.of(j) == ">")
                        j += 1
                        if not depth:
                            break
                    i = j
                else:
                    i = self.match.get(i, self.n) + 1
            elif self.kind[i] == "I" and t not in _INSTEAD or t in (".", "::", "&", "*", "|", "?", "'"):
                i += 1
            else:
                return i
        return i

    def literal(self, i: int) -> int:
        """The string token that an expression at ``i`` gives, through calls and conversions that keep its value; -1 if it gives none."""
        i = self.skip(i)
        while i < self.n:
            t = self.of(i)
            if self.kind[i] == "S":
                return i
            if t in ("(", "&", "*", "new", "await"):
                i = self.skip(i + 1)
            elif t == "[" and self.of(i + 1) == "]":
                i += 2
            elif self.kind[i] == "I":
                first = last = t
                j = i + 1
                while self.of(j) in (".", "::") and j + 1 < self.n and self.kind[j + 1] == "I":
                    last = self.of(j + 1)
                    j += 2
                if self.of(j) != "(" or not (first in _KEEPING or last in _KEEPING):
                    return -1
                i = self.skip(j + 1)
            else:
                return -1
        return -1

    def instead(self, i: int) -> int:
        """The string token that stands in for a missing value in the expression at ``i``; -1 if none does."""
        i = self.skip(i)
        while i < self.n:
            t = self.of(i)
            if t in _INSTEAD:
                return self.literal(i + 1)
            if t in ("(", "[") and i in self.match:
                i = self.match[i] + 1
                continue
            if self.kind[i] == "N" and self.of(self.skip(i)) not in _INSTEAD or t in (";", ",", ")", "]", "}", "{", "=", "=>", "?", ":"):
                return -1
            i += 1
        return -1

    def key(self, i: int) -> str | None:
        """The key of the group of braces that token ``i`` is in."""
        if self.outer is None:
            self.outer = {}
            for a, b in sorted(self.match.items()):
                if self.of(a) == "{":
                    for x in range(a + 1, b):
                        self.outer[x] = a
        a = self.outer.get(i)
        if a is None:
            return None
        j = a - 1
        while j >= 0 and (self.kind[j] in "NC" or self.of(j) in (":", "=", "=>", ":=", "]")):
            j -= 1
        return self.name(j) if j >= 0 and j < a - 1 else None

    def arguments(self, i: int) -> list[tuple[int, int]]:
        """First token and the one behind the last of each argument of the call whose bracket is token ``i``."""
        end = self.match.get(i)
        if end is None:
            return []
        out, begin, j = [], i + 1, i + 1
        while j < end:
            if self.of(j) in ("(", "[", "{") and j in self.match:
                j = self.match[j]
            elif self.of(j) == ",":
                out.append((begin, j))
                begin = j + 1
            j += 1
        return [*out, (begin, end)] if self.skip(begin) < end else out

    def given(self, argument: tuple[int, int]) -> tuple[int, int] | None:
        """Contents of the literal that an argument is, or None if it is something else."""
        i = self.literal(argument[0])
        if i < 0 or i >= argument[1]:
            return None
        rest = "".join(self.of(j) for j in range(i + 1, argument[1]) if self.kind[j] not in "NC")
        return self.contents(i) if re.fullmatch(r"(?:\.\w+\(\)|\))*", rest) else None


_KEY = re.compile(r"[\w.$-]+(?: [\w-]+){0,2}")
#: Strings that are worth reading as code: quotes behind a sign.
_NESTED = re.compile(r"[:=(,][ \t]*\\?[\"'`]|=>|\n")


def _assigned(code: _Code) -> Iterator[tuple[int, int, int]]:
    """(string token, grade, token of the name) of literals assigned to credential-named identifiers and keys."""
    for i, k in enumerate(code.kind):
        if k != "I" and k != "S":
            continue
        name = code.name(i)
        if not name:
            continue
        g = grade(name)
        generic = not g and name.lower() in _GENERIC
        if not g and not generic or code.of(i - 1) == "?" and code.of(i - 2) != "\n":
            continue
        if generic:
            holder = code.key(i)
            g = grade(holder) if holder else 0
            if not g:
                continue
        j = code.sign(i)
        if j < 0:
            continue
        lit = code.literal(j)
        if lit < 0:
            lit = code.instead(j)
        if lit >= 0:
            yield lit, g


def _passed(code: _Code) -> Iterator[tuple[int, int]]:
    """Contents of literals passed to a credential's setter or a login, or beside a credential's name."""
    for i in range(code.n - 1):
        if code.kind[i] != "I" or code.of(i + 1) != "(":
            continue
        name = code.of(i)
        callee = words(name)
        if not callee:
            continue
        whole = "".join(callee)
        setter = grade(name) == 2 and (callee[0] in _SETTERS and len(callee) > 1 or whole in ("password", "passwd", "passphrase", "apikey", "accesskey", "secretkey"))
        beside = callee[-1] in ("header", "headers", "set", "put", "add", "param", "property", "config", "password", "secret", "token", "key")
        asking = whole in _ASKING or callee[-1] in ("env", "default")
        if not (setter or beside or asking or whole in LOGIN):
            continue
        args = code.arguments(i + 1)
        given = [code.given(a) for a in args]
        last = given[-1] if given else None
        if setter and last and usable(code.text[slice(*last)], quoted=True):
            yield last
        elif whole in LOGIN and len(args) >= 2 and last and usable(code.text[slice(*last)], quoted=True):
            yield last
        elif (beside or asking) and len(args) == 2 and all(given) and (g := grade(code.text[slice(*given[0])])) and usable(code.text[slice(*given[1])], strict=g < 2):
            yield given[1]


_GOING_ON = frozenset(("=", ":=", "(", "[", ",", "+", "||", "??", "?:", "or", "=>", ":", "{", "return", "\\", "+=", "||=", "??=", "&&", "."))
_GOES_ON = re.compile(r"\s*(?:=|:=|\|\||\?\?|\+|or\b|\?:|\.\w)")
_OPENING = re.compile(r"[(,=][ \t]*(?://[^\n]*)?\Z")


@lru_cache(maxsize=200_000)
def _telling(word: str) -> bool:
    """Whether an identifier or key can make a literal a credential."""
    return grade(word) > 0 or "".join(words(word)) in LOGIN


def _statements(text: str, begin: int, end: int) -> Iterator[_Code]:
    """The statements of the text in which a credential's name stands, by tokens from the first line of each on."""
    done = begin
    for m in _IDENTIFIER.finditer(text, begin, end):
        if m.start() < done or not _telling(m[0]):
            continue
        line = max(done, text.rfind("\n", begin, m.start()) + 1)
        while line > done and _OPENING.search(text, max(done, text.rfind("\n", begin, line - 1) + 1), line - 1):
            line = max(done, text.rfind("\n", begin, line - 1) + 1)
        code = _Code(text, line, m.end(), end)
        done = max(code.stop, m.end())
        yield code


def _coded(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Contents of literals assigned or passed to credentials, by tokens; also in comments and in strings that hold code."""
    for code in _statements(text, begin, end):
        yield from _flagged(text, code)


def _flagged(text: str, code: _Code) -> Iterator[tuple[int, int]]:
    for lit, g in _assigned(code):
        spans = [code.contents(lit)]
        j = code.skip(lit + 1)
        while (code.of(j) == "+" or code.kind[j : j + 1] == ["S"]) and (n := j if code.kind[j] == "S" else code.skip(j + 1)) < code.n and code.kind[n] == "S" and code.of(code.skip(n + 1)) not in (":", "="):
            spans.append(code.contents(n))
            j = code.skip(n + 1)
        whole = "".join(text[a:b] for a, b in spans)
        # Addresses and connection strings hold their secrets in a part, which has its own rules.
        if "://" not in whole and not re.match(r"\w+=[^;]*;", whole) and usable(whole, strict=g < 2, quoted=True):
            yield from spans
    yield from _passed(code)
    for a, b in code.inner:
        yield from _coded(text, a, b)


def _bare(text: str, at: int) -> tuple[int, int] | None:
    """The unquoted value that begins at ``at`` on a line that is a setting; it ends at white space or the line's end."""
    line = text[text.rfind("\n", 0, at) + 1 : at]
    m = _BARE.match(text, at) if _SETTING.fullmatch(line) else None
    if m is None:
        return None
    end = text.find("\n", m.end())
    rest = text[m.end() : end if end >= 0 else len(text)].strip()
    # Bare words are values only in configuration: nothing but a comment may follow them.
    return m.span() if not rest or rest.startswith("#") else None


def _basic(value: str) -> bool:
    try:
        raw = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("latin-1")
    except (binascii.Error, ValueError):
        return False
    user, colon, password = raw.partition(":")
    return bool(colon) and len(password) >= 4 and raw.isprintable() and not placeholder(password)


def _spans(text: str) -> Iterator[tuple[int, int]]:
    if "-----BEGIN" in text:
        for m in _BLOCK.finditer(text):
            e = _BLOCK_END.search(text, m.end())
            nxt = _BLOCK.search(text, m.end())
            end = e.start() if e and not (nxt and nxt.start() < e.start()) else _KEY_BODY.match(text, m.end()).end()
            body = text[m.end() : end]
            if len(re.findall(r"[A-Za-z0-9+/=]", re.sub(r"\\n", "", body))) >= 40 and not re.search(r"\.\.\.|\$\{|\{\{|<[a-z]", body):
                yield m.start(), end
    for m in _SHAPE.finditer(text):
        if not re.search(r"(?i)example|x{8,}", m[0]):
            yield m.span()
    if "://" in text:
        for u in _URL.finditer(text):
            url, base = u[0], u.start()
            m = _USERINFO.search(url)
            if m and not placeholder(m[1]) and not re.fullmatch(r"(?i)password|pass|pwd|secret|token", m[1]):
                yield base + m.start(1), base + m.end(1)
            h = _HOOK.search(url)
            if h and any(c.isdigit() for c in h[1]) and not placeholder(h[1]):
                yield base + h.start(1), base + h.end(1)
            for m in _QUERY.finditer(url):
                if (g := grade(m[1])) and words(m[1])[0] not in ("page", "next", "cursor", "csrf", "sync") and usable(m[2], strict=g < 2):
                    yield base + m.start(2), base + m.end(2)
    for m in _HEADER.finditer(text):
        if _basic(m[2]) if m[1] == "Basic" else usable(m[2], strict=m[1] != "Bearer"):
            yield m.span(2)
    if "=" in text:
        for m in _ACCOUNT.finditer(text):
            line = text.rfind("\n", 0, m.start()) + 1
            if ";" in text[line : m.start()] + text[m.end() : m.end() + 1] and usable(m[1]):
                yield m.span(1)
    for m in _BLANKS.finditer(text):
        name = m[1] or m[2]
        value = _BARE.match(text, m.end())
        # Behind a blank, names and calls are code; what no name can be is a setting's value.
        if value and grade(name.rpartition(".")[2]) == 2 and not re.fullmatch(r"[A-Za-z_$][\w$.:]*|[\w$.]+[-+*/%&|<>][\w$.]+", value[0]) and usable(value[0]):
            rest = text[value.end() : text.find("\n", value.end()) if "\n" in text[value.end() :] else len(text)].strip()
            if not rest or rest[0] in "#;" and len(rest) > 1:
                yield value.span()
    yield from _coded(text, 0, len(text))
    for m in _LINE.finditer(text):
        if (g := grade(m[1].rpartition(".")[2])) and (span := _bare(text, m.end())):
            value = text[slice(*span)]
            if "://" not in value and not re.match(r"\w+=[^;]*;", value) and usable(value, strict=g < 2):
                yield span
    for m in _FOLDED.finditer(text):
        if len(m[3]) > len(m[1]) and (g := grade(m[2].rpartition(".")[2])) and usable(m[4], strict=g < 2):
            yield m.span(4)
    for m in _NOTE.finditer(text):
        if usable(m[1]):
            yield m.span(1)
    for m in _PROSE.finditer(text):
        if usable(m[1].rstrip(".)"), strict=len(m[1]) < 40 and m[1].isalpha()):
            yield m.start(1), m.start(1) + len(m[1].rstrip(".)"))
    if "--" in text:
        for m in _FLAG.finditer(text):
            if usable(m[1]):
                yield m.span(1)


def credential_spans(text: str | None) -> list[tuple[int, int]]:
    """Non-overlapping (start, end) of credential values in ``text``, in order. Null and empty texts have none."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(_spans(text))):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(text: str | None, spans: list[tuple[int, int]] | None = None) -> str | None:
    """``text`` with every credential value replaced by MASK and all else unchanged; null stays null. A private key keeps its BEGIN line's marks."""
    if not text:
        return text
    parts, at = [], 0
    for a, b in credential_spans(text) if spans is None else spans:
        head = _BLOCK.match(text, a)
        parts += [text[at:a], head[0] if head else "", MASK]
        at = b
    return "".join([*parts, text[at:]])


def find_credentials(df: DataFrame, key: list[str], content: str) -> DataFrame:
    """One row per line of ``content`` on which a credential's value begins: the ``key`` columns, line_no (from 1, lines end at LF) and n (values on it).

    Narrow (a few small files are spread over the cores first): each text is read whole and once. Null and empty contents give no rows; repeated rows give repeated results;
    other columns are ignored, whatever their names."""
    schema = df.select(*key).schema.simpleString()[len("struct<") : -1] + ",line_no:bigint,n:bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *k, text in pdf.itertuples(index=False, name=None):
                lines: Counter = Counter()
                line, at = 1, 0
                for a, _ in credential_spans(text):
                    line, at = line + text.count("\n", at, a), a
                    lines[line] += 1
                rows += [(*k, line, n) for line, n in lines.items()]
            yield pd.DataFrame(rows, columns=[*key, "line_no", "n"])

    return spread(df.select(*key, content).where(f"{content} is not null")).mapInPandas(run, schema)


def redact_column(df: DataFrame, key: list[str], content: str) -> DataFrame:
    """The ``key`` columns, ``content`` with the values replaced, and redactions (their number). One row per input row; nulls stay null."""
    schema = df.select(*key).schema.simpleString()[len("struct<") : -1] + f",{content}:string,redactions:bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [credential_spans(t) for t in pdf[content]]
            yield pdf.assign(**{content: [redact(t, s) for t, s in zip(pdf[content], spans)], "redactions": [len(s) for s in spans]})

    return spread(df.select(*key, content)).mapInPandas(run, schema)
