"""Generalised LL recognition over a graph-structured stack, for grammars with regular right-hand sides and bracketed groups.

A grammar is text: ``Name = regular expression of symbols``. Symbols are quoted literals, token classes in capitals, nonterminals, and groups
``P[X] B[X] C[X] I[X]``: parentheses, brackets, braces or an indented block whose content derives X. Brackets are matched first, so each
group's content is recognised on its own, for all nonterminals it may be in all dialects at once, on one shared stack; equal contents are
recognised once per process."""

from __future__ import annotations

import re
from collections import defaultdict

_SYMBOL = re.compile(r"\s*(?:'([^']+)'|([PBCI])\[(\w+)\]|(@?\w+)|([|()*+?]))")

_SET = re.compile(r"(?<!')@\w+")


class _Fragments:
    """Thompson construction: states with epsilon moves."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.moves: list[list[tuple[tuple, int]]] = []

    def new(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1


class Grammar:
    """A compiled grammar. ``chunked`` names nonterminals of which concatenations are again such. They are cut behind the terminals ``ends`` and behind
    blocks, unless one of ``joins`` follows; a cut in the wrong place costs time only, as the whole is then recognised in one piece."""

    def __init__(self, text: str, classes: tuple[str, ...], chunked: tuple[str, ...] = (), ends: tuple[str, ...] = (), joins: tuple[str, ...] = ()) -> None:
        self.terminals: dict[str, int] = {}
        for c in classes:
            self.terminals[c] = len(self.terminals)
        rules: dict[str, str] = {}
        sets: dict[str, str] = {}
        for line in re.sub(r"\n[ \t]+", " ", text.strip()).split("\n"):
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            name, _, body = line.partition(" = ")
            (sets if name.strip().startswith("@") else rules)[name.strip()] = body.strip()
        self.names = list(rules)
        number = {n: i for i, n in enumerate(self.names)}
        self._sets = sets
        self.contents: dict[str, list[int]] = defaultdict(list)
        self.start: list[int] = []
        self.accept: list[bool] = []
        self.term: list[dict[int, int]] = []
        self.group: list[list[tuple[tuple[str, int], int]]] = []
        self.call: list[list[tuple[int, int]]] = []
        for body in rules.values():
            self.start.append(self._compile(body, number))
        for kind in self.contents:
            self.contents[kind] = sorted(set(self.contents[kind]))
        self._first()
        self.chunked = sum(1 << number[n] for n in chunked)
        self.ends = {self.terminals[e] for e in ends}
        self.number = number
        self.joins = {self.terminals[t] for t in joins if t in self.terminals}
        self.openers = {i for t, i in self.terminals.items() if (t[0].isalpha() or t in "@#") and t not in joins}
        self.colon = self.terminals.get(":", -1)
        self._masks: dict[tuple[str, int], int] = {}
        self.groups: list[tuple[str, int]] = []
        self.base = 1 << 16
        self._starts: dict[tuple[int, int], bool] = {}
        self._known: dict[tuple, int] = {}

    def terminal(self, name: str) -> int:
        return self.terminals.setdefault(name, len(self.terminals))

    def _compile(self, body: str, number: dict[str, int]) -> int:
        """Compile one right-hand side to deterministic states; returns the first."""
        toks, at = [], 0
        body = self._expand(body)
        while at < len(body.rstrip()):
            m = _SYMBOL.match(body, at)
            if m is None:
                raise ValueError(f"grammar: {body[at : at + 40]!r}")
            at = m.end()
            if m[1] is not None:
                toks.append(("t", self.terminal(m[1])))
            elif m[2]:
                self.contents[m[2]].append(number[m[3]])
                toks.append(("g", (m[2], number[m[3]])))
            elif m[4]:
                toks.append(("n", number[m[4]]) if m[4] in number else ("t", self.terminals[m[4]]))
            else:
                toks.append(m[5])
        f = _Fragments()
        pos = 0

        def alt() -> tuple[int, int]:
            nonlocal pos
            a, z = f.new(), f.new()
            while True:
                s, e = seq()
                f.eps[a].append(s)
                f.eps[e].append(z)
                if pos < len(toks) and toks[pos] == "|":
                    pos += 1
                    continue
                return a, z

        def seq() -> tuple[int, int]:
            nonlocal pos
            a = z = f.new()
            while pos < len(toks) and toks[pos] not in ("|", ")"):
                if toks[pos] == "(":
                    pos += 1
                    s, e = alt()
                    pos += 1
                else:
                    s, e = f.new(), f.new()
                    f.moves[s].append((toks[pos], e))
                    pos += 1
                if pos < len(toks) and toks[pos] in ("*", "+", "?"):
                    op = toks[pos]
                    pos += 1
                    s2, e2 = f.new(), f.new()
                    f.eps[s2].append(s)
                    f.eps[e].append(e2)
                    if op in "*+":
                        f.eps[e].append(s)
                    if op in "*?":
                        f.eps[s2].append(e2)
                    s, e = s2, e2
                f.eps[z].append(s)
                z = e
            return a, z

        first, last = alt()

        def closure(states: frozenset[int]) -> frozenset[int]:
            out, todo = set(states), list(states)
            while todo:
                for x in f.eps[todo.pop()]:
                    if x not in out:
                        out.add(x)
                        todo.append(x)
            return frozenset(out)

        ids: dict[frozenset[int], int] = {}
        todo = []

        def state(s: frozenset[int]) -> int:
            if s not in ids:
                ids[s] = len(self.accept)
                self.accept.append(last in s)
                self.term.append({})
                self.group.append([])
                self.call.append([])
                todo.append(s)
            return ids[s]

        start = state(closure(frozenset([first])))
        while todo:
            s = todo.pop()
            by: dict[tuple, set[int]] = defaultdict(set)
            for x in s:
                for label, y in f.moves[x]:
                    by[label].add(y)
            for (kind, what), ys in by.items():
                y = state(closure(frozenset(ys)))
                if kind == "t":
                    self.term[ids[s]][what] = y
                elif kind == "g":
                    self.group[ids[s]].append((what, y))
                else:
                    self.call[ids[s]].append((what, y))
        return start

    def _expand(self, body: str) -> str:
        while _SET.search(body):
            body = _SET.sub(lambda m: f"( {self._sets[m[0]]} )", body)
        return body

    def _first(self) -> None:
        """Terminals and groups that each nonterminal can begin with, and whether it can be empty."""
        n = len(self.names)
        self.nullable = [False] * n
        self.first_t: list[set[int]] = [set() for _ in range(n)]
        self.first_g: list[set[tuple[str, int]]] = [set() for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for i in range(n):
                seen, todo = set(), [self.start[i]]
                before = (self.nullable[i], len(self.first_t[i]), len(self.first_g[i]))
                while todo:
                    s = todo.pop()
                    if s in seen:
                        continue
                    seen.add(s)
                    self.nullable[i] |= self.accept[s]
                    self.first_t[i] |= set(self.term[s])
                    self.first_g[i] |= {g for g, _ in self.group[s]}
                    for c, y in self.call[s]:
                        self.first_t[i] |= self.first_t[c]
                        self.first_g[i] |= self.first_g[c]
                        if self.nullable[c]:
                            todo.append(y)
                changed |= before != (self.nullable[i], len(self.first_t[i]), len(self.first_g[i]))

    def _begins(self, nonterminal: int, token: int) -> bool:
        key = (nonterminal, token)
        got = self._starts.get(key)
        if got is None:
            if token >= self.base:
                kind, mask = self.groups[token - self.base]
                got = any(k == kind and mask >> x & 1 for k, x in self.first_g[nonterminal])
            else:
                got = token in self.first_t[nonterminal]
            self._starts[key] = got
        return got

    def symbol(self, kind: str, mask: int) -> int:
        """The token that stands for a group of ``kind`` whose content derives the nonterminals of ``mask``."""
        key = (kind, mask)
        if key not in self._masks:
            self._masks[key] = self.base + len(self.groups)
            self.groups.append(key)
        return self._masks[key]

    def recognise(self, tokens: tuple[int, ...], starts: list[int]) -> int:
        """Mask of those ``starts`` that derive the whole of ``tokens``."""
        n, accepted = len(tokens), 0
        roots = {}
        nodes: dict[int, list] = {}
        now: list[tuple[int, list]] = []
        for s in starts:
            if self.nullable[s] or n and self._begins(s, tokens[0]):
                node = [s, [], -1]  # nonterminal, edges, the last position at which it ended
                nodes[s] = node
                roots[id(node)] = s
                now.append((self.start[s], node))
        for pos in range(n + 1):
            token = tokens[pos] if pos < n else -1
            following: list[tuple[int, list]] = []
            ahead: set[tuple[int, int]] = set()
            seen = {(s, id(d)) for s, d in now}
            while now:
                state, node = now.pop()
                if self.accept[state]:
                    if pos == n and id(node) in roots:
                        accepted |= 1 << roots[id(node)]
                    node[2] = pos
                    for ret, parent in node[1]:
                        if (ret, id(parent)) not in seen:
                            seen.add((ret, id(parent)))
                            now.append((ret, parent))
                if pos < n:
                    y = self.term[state].get(token)
                    if y is not None and (y, id(node)) not in ahead:
                        ahead.add((y, id(node)))
                        following.append((y, node))
                    if token >= self.base and self.group[state]:
                        kind, mask = self.groups[token - self.base]
                        for (k, x), y in self.group[state]:
                            if k == kind and mask >> x & 1 and (y, id(node)) not in ahead:
                                ahead.add((y, id(node)))
                                following.append((y, node))
                for callee, ret in self.call[state]:
                    if not (self.nullable[callee] or pos < n and self._begins(callee, token)):
                        continue
                    sub = nodes.get(callee)
                    if sub is None:
                        sub = nodes[callee] = [callee, [], -1]
                        key = (self.start[callee], id(sub))
                        if key not in seen:
                            seen.add(key)
                            now.append((self.start[callee], sub))
                    if not any(r == ret and p is node for r, p in sub[1]):
                        sub[1].append((ret, node))
                        if sub[2] == pos and (ret, id(node)) not in seen:
                            seen.add((ret, id(node)))
                            now.append((ret, node))
            now, nodes = following, {}
            if not now:
                break
        return accepted

    def content(self, kind: str, tokens: list[int], starts: list[int] | None = None) -> int:
        """Mask of the nonterminals that a group's content derives. Long contents are first tried in chunks, which repeat among files."""
        key = (kind, *tokens)
        got = self._known.get(key)
        if got is not None:
            return got
        starts = self.contents[kind] if starts is None else starts
        mask = 0
        if self.chunked and len(tokens) > 6:
            mask, chunk, cuts, last = self.chunked, [], 0, len(tokens) - 1
            for i, t in enumerate(tokens):
                chunk.append(t)
                if i == last:
                    break
                if t in self.ends and (i == 0 or tokens[i - 1] != self.colon) or t >= self.base and self.groups[t - self.base][0] in "CI":
                    if tokens[i + 1] not in self.openers and t not in self.ends or tokens[i + 1] in self.joins:
                        continue
                    cuts += 1
                    mask &= self._piece(kind, tuple(chunk), starts)
                    chunk = []
                    if not mask:
                        break
            mask = mask & self._piece(kind, tuple(chunk), starts) if mask and cuts else 0
        if mask:  # what is no concatenation is tried on the whole; it mostly ends at the first tokens
            others = [x for x in starts if not self.chunked >> x & 1]
            mask |= self.recognise(tuple(tokens), others) if others else 0
        else:
            mask = self._piece(kind, tuple(tokens), starts)
        if len(tokens) <= 40:
            self._keep(key, mask)
        return mask

    def _piece(self, kind: str, tokens: tuple[int, ...], starts: list[int]) -> int:
        key = ("piece", kind, *tokens)
        got = self._known.get(key)
        if got is None:
            got = self.recognise(tokens, starts)
            if len(tokens) <= 60:
                self._keep(key, got)
        return got

    def _keep(self, key: tuple, mask: int) -> None:
        if len(self._known) > 400_000:  # a memo only: what is dropped is recognised again
            self._known.clear()
        self._known[key] = mask
