"""A small SQL reader for lineage: statements, targets, sources, and where each output column comes from.

It reads tokens, not a grammar, so the dialects' differences that do not matter for lineage do not
matter here. A text whose first word starts no known statement is left to the regular expressions in
`metaloom.operators.sqltext`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`|\[[A-Za-z_][^\]]*\])|(?P<num>\d+(?:\.\d+)?)|(?P<word>[^\W\d][\w$#]*)|(?P<op>\|\||<=|>=|<>|!=|:=|.)""",
    re.S,
)
#: Words that end a table reference, so are no alias (fixed values).
_STOP = frozenset(
    "where group order having limit union intersect except minus join inner left right full cross outer natural on using set values select from window qualify when then else end as "
    "lateral pivot unpivot tablesample fetch offset for returning into with connect start sort cluster distribute".split()
)
#: Function names by kind of expression (fixed values).
KINDS = {
    "aggregate": "sum count avg min max stddev stddev_pop stddev_samp variance var_pop var_samp median mode listagg string_agg group_concat array_agg collect_list collect_set any_value first last approx_count_distinct percentile_cont percentile_disc count_if",
    "coalesce": "coalesce nvl ifnull nvl2 nullif isnull",
    "string": "concat concat_ws upper lower substr substring trim ltrim rtrim replace lpad rpad left right initcap reverse split split_part length instr locate translate",
    "regex": "regexp_replace regexp_extract regexp_substr regexp_like regexp_instr rlike",
    "json": "json_extract json_value json_query get_json_object json_object json_array to_json from_json parse_json",
    "explode": "explode posexplode flatten unnest inline explode_outer stack",
}
_KIND = {f: k for k, names in KINDS.items() for f in names.split()}
#: Trust in a column's origin by kind of expression (fixed values).
TRUST = {"column": 0.95, "aggregate": 0.85, "window": 0.8, "coalesce": 0.8, "pivot": 0.8, "case": 0.75, "string": 0.75, "regex": 0.75, "json": 0.75, "lateral": 0.75, "arithmetic": 0.7, "explode": 0.7, "function": 0.7, "subquery": 0.6, "constant": 0.5}
#: Trust in a statement's lineage by its type (fixed values).
STATEMENT_TRUST = {"CREATE_VIEW": 0.95, "CREATE_TABLE": 0.95, "CTAS": 0.9, "INSERT": 0.9, "MERGE": 0.9, "UPDATE": 0.85, "DELETE": 0.8, "SELECT": 0.7}
WINDOWS = frozenset("row_number rank dense_rank ntile lag lead first_value last_value nth_value cume_dist percent_rank".split())


@dataclass
class Statement:
    kind: str
    target: str | None = None
    sources: list[str] = field(default_factory=list)
    #: (target column, source table, source column, kind of expression, trust)
    columns: list[tuple[str | None, str | None, str | None, str, float]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def complexity(self) -> float:
        c = self.counts
        parts = (("join", 0.1, 0.3), ("subquery", 0.1, 0.3), ("cte", 0.1, 0.2), ("aggregate", 0.05, 0.2), ("union", 0.1, 0.2), ("case", 0.05, 0.1), ("pivot", 0.1, 0.15), ("unpivot", 0.1, 0.15), ("lateral", 0.1, 0.15))
        return round(min(1.0, 0.1 + sum(min(cap, each * c.get(k, 0)) for k, each, cap in parts)), 4)

    @property
    def trust(self) -> float:
        return STATEMENT_TRUST.get(self.kind, 0.8)


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) without comments and blanks; quoted names lose their quotes and count as words."""
    out = []
    for m in _TOKEN.finditer(text):
        k, v = m.lastgroup, m.group()
        if k == "skip":
            continue
        if k == "quoted":
            k, v = "name", v[1:-1]
        out.append((k, v))
    return out


class _Reader:
    def __init__(self, toks: list[tuple[str, str]]):
        self.t = toks
        self.low = [v.lower() if k == "word" else "" for k, v in toks]
        self.n = len(toks)

    def op(self, i: int) -> str:
        return self.t[i][1] if i < self.n and self.t[i][0] == "op" else ""

    def name(self, i: int) -> tuple[str | None, int]:
        """A dotted name at i and the place after it."""
        if i >= self.n or self.t[i][0] not in ("word", "name"):
            return None, i
        parts = [self.t[i][1]]
        i += 1
        while self.op(i) == "." and i + 1 < self.n and self.t[i + 1][0] in ("word", "name"):
            parts.append(self.t[i + 1][1])
            i += 2
        return ".".join(parts), i

    def close(self, i: int) -> int:
        """The place of the bracket that closes the one at i."""
        depth = 0
        while i < self.n:
            o = self.op(i)
            depth += (o == "(") - (o == ")")
            if depth == 0 and o == ")":
                return i
            i += 1
        return self.n

    def find(self, words: tuple[str, ...], i: int, end: int) -> int:
        """The first of the words at this depth, else end."""
        depth = 0
        while i < end:
            o = self.op(i)
            depth += (o == "(") - (o == ")")
            if depth == 0 and self.low[i] in words:
                return i
            if depth < 0:
                return i
            i += 1
        return end

    def items(self, i: int, end: int) -> list[tuple[int, int]]:
        """The parts between commas at this depth."""
        out, start, depth = [], i, 0
        for j in range(i, end):
            o = self.op(j)
            depth += (o == "(") - (o == ")")
            if o == "," and depth == 0:
                out.append((start, j))
                start = j + 1
        if start < end:
            out.append((start, end))
        return out


def _tables(r: _Reader, i: int, end: int) -> tuple[list[tuple[str, str | None]], int]:
    """Tables named in FROM, JOIN, USING and comma lists, at any depth, as (name, alias); CTE names and
    functions such as EXTRACT(x FROM y) are no tables."""
    ctes, out, n_ctes = set(), [], 0
    for j in range(i, end - 2):
        if r.low[j + 1] == "as" and r.op(j + 2) == "(" and r.t[j][0] in ("word", "name") and (r.low[j - 1] in ("with", "recursive") if j > i else False or r.op(j - 1) == ","):
            ctes.add(r.t[j][1].lower())
            n_ctes += 1
        elif r.op(j - 1) == "," and j > i and r.low[j + 1] == "as" and r.op(j + 2) == "(" and r.low[min(j + 3, r.n - 1)] in ("select", "with"):
            ctes.add(r.t[j][1].lower())
            n_ctes += 1
    calls = []
    for j in range(i, end):
        if r.op(j) == "(":
            calls.append(j > i and r.low[j - 1] in ("extract", "trim", "substring", "overlay", "position"))
        elif r.op(j) == ")" and calls:
            calls.pop()
        w = r.low[j]
        if w not in ("from", "join", "using") or (calls and calls[-1]) or (w == "from" and j > i and r.low[j - 1] == "distinct"):
            continue
        if w == "using" and r.op(j + 1) == "(" and r.low[min(j + 2, r.n - 1)] not in ("select", "with"):
            continue
        k = j + 1
        while k < end:
            while k < end and r.low[k] in ("lateral", "only", "table") and r.op(k + 1) != ".":
                k += 1
            if r.op(k) == "(":
                k = r.close(k) + 1
                found = None
            else:
                found, k = r.name(k)
                if found is None:
                    break
                if r.op(k) == "(":  # a table function
                    k = r.close(k) + 1
                    found = None
            if k < end and r.low[k] == "as":
                k += 1
            alias = None
            if k < end and r.t[k][0] in ("word", "name") and r.low[k] not in _STOP:
                alias = r.t[k][1]
                k += 1
            if found and found.lower() not in ctes:
                out.append((found, alias))
            if w == "from" and r.op(k) == ",":
                k += 1
                continue
            break
    return out, n_ctes


def _expression(r: _Reader, i: int, end: int) -> tuple[str, str | None, str | None]:
    """(kind, qualifier, column) of an expression: the first column it reads."""
    qualifier = column = None
    j = i
    funcs, arithmetic, has_case, has_over, has_select = [], False, False, False, False
    while j < end:
        k, v = r.t[j]
        w = r.low[j]
        if w == "case":
            has_case = True
        elif w == "over":
            has_over = True
        elif w == "select":
            has_select = True
        elif k == "op" and v in ("+", "-", "*", "/", "%", "||"):
            arithmetic = arithmetic or j > i
        if k in ("word", "name") and w not in _RESERVED:
            name, nxt = r.name(j)
            if r.op(nxt) == "(" and k == "word":
                funcs.append(name.lower())
                j = nxt
                continue
            if column is None and not (k == "word" and w in _RESERVED):
                head, _, last = name.rpartition(".")
                qualifier, column = head or None, last
            j = nxt
            continue
        j += 1
    if has_select:
        kind = "subquery"
    elif has_over or (funcs and funcs[0] in WINDOWS):
        kind = "window"
    elif any(f in KINDS["aggregate"].split() for f in funcs):
        kind = "aggregate"
    elif has_case:
        kind = "case"
    elif funcs:
        kind = _KIND.get(funcs[0], "function")
    elif arithmetic:
        kind = "arithmetic"
    else:
        kind = "column" if column else "constant"
    return kind, qualifier, column


_RESERVED = _STOP | frozenset("case and or not is null in like between distinct all true false asc desc by over partition rows range current row unbounded preceding following exists cast interval date timestamp create replace view table insert update delete merge".split())


def _outputs(r: _Reader, i: int, end: int, names: list[str] | None, alias: dict[str, str], only: str | None):
    """Column lineage of the select list that starts at i (the word select)."""
    stop = r.find(("from", "into", "where", "union", "except", "intersect", "group", "order"), i + 1, end)
    start = i + 1
    if start < end and r.low[start] in ("distinct", "all"):
        start += 1
    out = []
    for n, (a, b) in enumerate(r.items(start, stop)):
        name, e = None, b
        if b - a >= 2 and r.t[b - 1][0] in ("word", "name"):
            if r.low[b - 2] == "as":
                name, e = r.t[b - 1][1], b - 2
            elif r.op(b - 2) != "." and r.low[b - 1] not in _RESERVED and (r.t[b - 2][0] in ("word", "name", "num", "text") or r.op(b - 2) == ")"):
                name, e = r.t[b - 1][1], b - 1
        if e - a == 1 and r.op(a) == "*" or (e - a >= 3 and r.op(e - 1) == "*" and r.op(e - 2) == "."):
            q = None if e - a == 1 else r.t[a][1]
            out.append(("*", alias.get(q.lower(), q) if q else only, "*", "column", TRUST["column"]))
            continue
        kind, q, c = _expression(r, a, e)
        target = names[n] if names and n < len(names) else name or c
        table = alias.get(q.lower(), q) if q else only if c else None
        out.append((target, table, c, kind, TRUST[kind]))
    return out


def parse(toks: list[tuple[str, str]]) -> Statement | None:
    """One statement, or None if its first word starts none."""
    r = _Reader(toks)
    if not r.n:
        return None
    first, i, names, target, kind = r.low[0], 0, None, None, None
    if first == "create":
        i = 1
        while i < r.n and r.low[i] in ("or", "replace", "temporary", "temp", "global", "local", "materialized", "force", "editionable", "external", "unlogged"):
            i += 1
        if i >= r.n or r.low[i] not in ("view", "table"):
            return None
        what = r.low[i]
        i += 1
        while i < r.n and r.low[i] in ("if", "not", "exists"):
            i += 1
        target, i = r.name(i)
        if target is None:
            return None
        body = r.find(("select", "with"), i, r.n)
        if r.op(i) == "(":
            inner = r.close(i)
            if body >= r.n and r.low[min(i + 1, r.n - 1)] in ("select", "with"):
                body = i + 1
            elif what == "view" or body < r.n:
                names = [r.t[a][1] for a, _ in r.items(i + 1, inner)]
        kind = "CREATE_VIEW" if what == "view" else "CTAS" if body < r.n else "CREATE_TABLE"
        i = body
    elif first == "insert":
        i = 1
        while i < r.n and r.low[i] in ("into", "overwrite", "table", "ignore", "all"):
            i += 1
        target, i = r.name(i)
        if target is None:
            return None
        if r.op(i) == "(" and r.low[min(i + 1, r.n - 1)] not in ("select", "with"):
            end = r.close(i)
            names = [r.t[b - 1][1] for _, b in r.items(i + 1, end)]
            i = end + 1
        i, kind = r.find(("select", "with", "values"), i, r.n), "INSERT"
    elif first in ("update", "delete", "merge"):
        i = 1
        while i < r.n and r.low[i] in ("from", "into", "only"):
            i += 1
        target, i = r.name(i)
        if target is None:
            return None
        kind = first.upper()
    elif first in ("select", "with"):
        kind = "SELECT"
    else:
        return None
    tables, n_ctes = _tables(r, i if kind not in ("SELECT",) else 0, r.n)
    alias = {}
    for name, a in tables:
        alias.setdefault((a or name.rpartition(".")[2]).lower(), name)
        alias.setdefault(name.lower(), name)
    sources = list(dict.fromkeys(n for n, _ in tables))
    s = Statement(kind, target, sources)
    only = sources[0] if len(sources) == 1 else None
    if kind in ("CREATE_VIEW", "CTAS", "INSERT", "SELECT"):
        start = i
        if start < r.n and r.low[start] == "with":
            start = r.find(("select",), start, r.n)
        if start < r.n and r.low[start] == "select":
            s.columns = _outputs(r, start, r.n, names, alias, only)
    elif kind in ("UPDATE", "MERGE"):
        own = {target.lower(): target}
        j = i
        if j < r.n and r.low[j] == "as":
            j += 1
        if j < r.n and r.t[j][0] in ("word", "name") and r.low[j] not in _STOP:
            own[r.low[j] or r.t[j][1].lower()] = target
        alias = own | alias
        j = 0
        while j < r.n:
            j = next((k for k in range(j, r.n) if r.low[k] == "set"), r.n)
            end = r.find(("where", "when", "from"), j + 1, r.n)
            for a, b in r.items(j + 1, end):
                name, k = r.name(a)
                if name and r.op(k) == "=":
                    e, q, c = _expression(r, k + 1, b)
                    s.columns.append((name.rpartition(".")[2], alias.get(q.lower(), q) if q else target if c else None, c, e, TRUST[e]))
            j = end
    low = r.low
    fn = [low[k] for k in range(r.n - 1) if r.op(k + 1) == "("]
    s.counts = {
        "join": low.count("join"), "subquery": sum(1 for k in range(r.n - 1) if r.op(k) == "(" and low[k + 1] == "select") - n_ctes, "cte": n_ctes,
        "aggregate": sum(f in KINDS["aggregate"].split() for f in fn), "union": sum(low.count(w) for w in ("union", "intersect", "except", "minus")), "case": low.count("case"),
        "pivot": low.count("pivot"), "unpivot": low.count("unpivot"), "lateral": low.count("lateral"), "window": low.count("over"),
    }
    return s


def statements(text: str | None) -> list[Statement]:
    """The statements of a text that could be read, in order; semicolons separate them."""
    out, part = [], []
    for t in [*tokens(text or ""), ("op", ";")]:
        if t == ("op", ";"):
            s = parse(part)
            if s is not None:
                out.append(s)
            part = []
        else:
            part.append(t)
    return out
