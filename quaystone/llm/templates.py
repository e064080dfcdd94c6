"""A small template language, compiled to Python closures.

    {{ expression }}                                  writes a value
    {% for x in expression %} ... {% endfor %}        loop.first and loop.index (from 1) inside
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}          marks what a model is to learn

Expressions: strings, integers, true, false, none, names, x.key, x[e], (e), not, ==, !=, ~ (joins as text), +, and, or,
and filters (e | name). The sandbox: values are only read as items of mappings and lists, never as attributes, nothing
is called but the filters given to compile_template, and loops run over what they are given. Missing items are none,
which is written as nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_WORD = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|~+.()\[\]=]))""", re.S)


class TemplateError(ValueError):
    pass


def _tokens(code: str) -> list[tuple[str, str]]:
    out, at = [], 0
    code = code.rstrip()
    while at < len(code):
        m = _WORD.match(code, at)
        if not m:
            raise TemplateError(f"can't read {code[at:]!r}")
        out.append((("text", "number", "name", "sign")[m.lastindex - 1], m[m.lastindex]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent; trees are tuples: ("const", v), ("name", n), ("item", a, b), ("filter", n, a), (operator, a, b)."""

    def __init__(self, code: str, filters: Mapping[str, Callable]):
        self.tokens, self.i, self.filters = _tokens(code), 0, filters

    def whole(self):
        tree = self.any_of()
        if self.i < len(self.tokens):
            raise TemplateError(f"what is {self.tokens[self.i][1]!r}?")
        return tree

    def see(self, *words: str) -> str | None:
        if self.i < len(self.tokens) and self.tokens[self.i][0] != "text" and self.tokens[self.i][1] in words:
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def need(self, word: str) -> None:
        if not self.see(word):
            raise TemplateError(f"{word!r} is missing")

    def binary(self, below, *signs):
        tree = below()
        while sign := self.see(*signs):
            tree = fold((sign, tree, below()))
        return tree

    def any_of(self):
        return self.binary(self.all_of, "or")

    def all_of(self):
        return self.binary(self.negated, "and")

    def negated(self):
        return fold(("not", self.negated())) if self.see("not") else self.compared()

    def compared(self):
        return self.binary(self.joined, "==", "!=")

    def joined(self):
        return self.binary(self.filtered, "~", "+")

    def filtered(self):
        tree = self.single()
        while self.see("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            tree = fold(("filter", name, tree), self.filters)
        return tree

    def name(self) -> str:
        if self.i >= len(self.tokens) or self.tokens[self.i][0] != "name":
            raise TemplateError("a name is missing")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def single(self):
        if self.see("("):
            tree = self.any_of()
            self.need(")")
        elif self.i >= len(self.tokens):
            raise TemplateError("a value is missing")
        else:
            kind, word = self.tokens[self.i]
            self.i += 1
            if kind == "text":
                tree = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1], flags=re.S))
            elif kind == "number":
                tree = ("const", int(word))
            elif kind == "name":
                tree = ("const", {"true": True, "false": False, "none": None}[word]) if word in ("true", "false", "none") else ("name", word)
            else:
                raise TemplateError(f"what is {word!r}?")
        while sign := self.see(".", "["):
            if sign == ".":
                tree = ("item", tree, ("const", self.name()))
            else:
                tree = ("item", tree, self.any_of())
                self.need("]")
        return tree


def _text(v) -> str:
    return "" if v is None else str(v)


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def _item(a, b):
    if isinstance(a, Mapping):
        return a.get(b)
    if isinstance(a, (list, tuple)) and isinstance(b, int):
        return a[b] if -len(a) <= b < len(a) else None
    return None


def fold(tree, filters: Mapping[str, Callable] | None = None):
    """A constant in place of an operator or filter on constants."""
    if tree[0] == "not" and tree[1][0] == "const":
        return ("const", not tree[1][1])
    if tree[0] == "filter" and tree[2][0] == "const":
        return ("const", filters[tree[1]](tree[2][1]))
    if tree[0] in OPERATORS and tree[1][0] == tree[2][0] == "const":
        return ("const", OPERATORS[tree[0]](tree[1][1], tree[2][1]))
    return tree


def parse_template(source: str, filters: Mapping[str, Callable]) -> list:
    """The statement tree, with constants folded and neighbouring texts joined."""
    pieces, at = _TAGS.split(source), 0
    expression = lambda code: _Expression(code, filters).whole()

    def block(*ends: str) -> tuple[list, str]:
        nonlocal at
        out: list = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                tree = expression(piece[2:-2])
                out.append(("text", _text(tree[1])) if tree[0] == "const" else ("write", tree))
            elif piece.startswith("{%"):
                code = piece[2:-2].strip()
                word, _, rest = code.partition(" ")
                if word in ends:
                    return joined(out), code
                if word == "for":
                    if not (m := re.fullmatch(r"(\w+)\s+in\s+(.*)", rest.strip(), re.S)):
                        raise TemplateError(f"can't read {code!r}")
                    body, _ = block("endfor")
                    out.append(("for", m[1], expression(m[2]), body))
                elif word == "if":
                    out += choice(expression(rest))
                elif word == "set":
                    name, _, value = rest.partition("=")
                    out.append(("set", name.strip(), expression(value)))
                elif word == "generation":
                    body, _ = block("endgeneration")
                    out.append(("generation", body))
                else:
                    raise TemplateError(f"no statement {code!r}")
            elif piece:
                out.append(("text", piece))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return joined(out), ""

    def choice(condition) -> list:
        body, end = block("elif", "else", "endif")
        other: list = []
        if end.startswith("elif"):
            other = choice(expression(end[4:]))
        elif end == "else":
            other, _ = block("endif")
        if condition[0] == "const":
            return body if condition[1] else other
        return [("if", condition, body, other)]

    return block()[0]


def joined(nodes: list) -> list:
    out: list = []
    for node in nodes:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)
    return out


def _value(tree, filters) -> Callable:
    """A closure from the variables to the value."""
    kind = tree[0]
    if kind == "const":
        return lambda env, v=tree[1]: v
    if kind == "name":
        return lambda env, n=tree[1]: env.get(n)
    if kind == "item":
        a, b = _value(tree[1], filters), _value(tree[2], filters)
        if tree[2][0] == "const":
            return lambda env, k=tree[2][1]: _item(a(env), k)
        return lambda env: _item(a(env), b(env))
    if kind == "filter":
        f, a = filters[tree[1]], _value(tree[2], filters)
        return lambda env: f(a(env))
    a = _value(tree[1], filters)
    if kind == "not":
        return lambda env: not a(env)
    b = _value(tree[2], filters)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    op = OPERATORS[kind]
    return lambda env: op(a(env), b(env))


def _body(nodes: list, filters) -> Callable:
    """A closure that takes the variables and a sink with write(text), begin() and end()."""
    steps = [_step(n, filters) for n in nodes]

    def run(env, sink):
        for step in steps:
            step(env, sink)

    return steps[0] if len(steps) == 1 else run


def _step(node, filters) -> Callable:
    kind = node[0]
    if kind == "text":
        return lambda env, sink, t=node[1]: sink.write(t)
    if kind == "write":
        value = _value(node[1], filters)
        return lambda env, sink: sink.write(_text(value(env)))
    if kind == "set":
        name, value = node[1], _value(node[2], filters)

        def put(env, sink):
            env[name] = value(env)

        return put
    if kind == "if":
        test, yes, no = _value(node[1], filters), _body(node[2], filters), _body(node[3], filters)
        return lambda env, sink: (yes if test(env) else no)(env, sink)
    if kind == "generation":
        inner = _body(node[1], filters)

        def marked(env, sink):
            sink.begin()
            inner(env, sink)
            sink.end()

        return marked
    name, many, body = node[1], _value(node[2], filters), _body(node[3], filters)

    def loop(env, sink):
        inner = dict(env)
        for i, inner[name] in enumerate(many(env) or (), 1):
            inner["loop"] = {"first": i == 1, "index": i}
            body(inner, sink)

    return loop


def compile_template(source: str, filters: Mapping[str, Callable]) -> Callable:
    """render(variables, sink). Loops pull their rows one by one, so that long ones needn't be in memory."""
    body = _body(parse_template(source, filters), filters)
    return lambda variables, sink: body(dict(variables), sink)
