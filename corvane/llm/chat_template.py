"""Chat formatting with a compiler for a sandboxed template language.

A template is parsed to a syntax tree, constants are folded, and the rest is
turned into Python closures that render a conversation and note the spans of
``{% generation %}`` blocks (what a model is trained to produce).

The language: ``{{ expression }}``, ``{% for x in e if t %} .. {% else %} ..
{% endfor %}`` with ``loop``, ``if / elif / else``, ``set``, ``generation``,
``{# comments #}`` and white-space control by ``-``. Expressions have literals,
lists, dictionaries, ``. [] + - * / // % ~``, comparisons, ``in``, ``and or
not``, ``a if b else c``, tests (``is defined`` ...), filters and a few string
methods; no macros, ``break``, ``continue`` or powers. Strings, texts and loops
have bounds (``MOST``, ``LONGEST``, ``ROUNDS``). There is no way to Python's attributes, modules or functions: a dot
reads a key of a dictionary, methods and filters come from two fixed tables.

Defined results: messages are ordered by turn, then role, then text, nulls
first; repeated rows are repeated messages; a null role is "unknown", a null
text is empty; rows with a null id are one conversation of their own; an empty
table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import col
from corvane.llm._vector import column

CHATML = (
    "{%- for message in messages -%}"
    "{{ '<|im_start|>' ~ message.role ~ '\\n' }}"
    "{%- if message.role == 'assistant' -%}"
    "{% generation %}{{ message.content ~ '<|im_end|>' }}{% endgeneration %}{{ '\\n' }}"
    "{%- else -%}{{ message.content ~ '<|im_end|>' ~ '\\n' }}{%- endif -%}"
    "{%- endfor -%}"
    "{%- if add_generation_prompt -%}{{ '<|im_start|>assistant\\n' }}{%- endif -%}"
)
#: The longest ``range`` and the longest repeated string a template may make.
MOST = 100_000
#: The longest string an expression may make and the longest text, and the most
#: rounds of all loops; a conversation beyond them is an error, never cut.
LONGEST, ROUNDS = 1 << 28, 10_000_000


class TemplateError(ValueError):
    """A template that can't be parsed, or that fails or refuses to render."""


class Undefined:
    def __str__(self) -> str:
        return ""

    def __bool__(self) -> bool:
        return False

    def __iter__(self):
        return iter(())

    def __eq__(self, other) -> bool:
        return isinstance(other, Undefined)

    __hash__ = None


UNDEFINED = Undefined()


@dataclass(frozen=True)
class Node:
    kind: str
    parts: tuple = ()


def const(value: Any) -> Node:
    return Node("const", (value,))


_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>//|==|!=|<=|>=|[-+*/%~<>=.,:|()\[\]{}]))""", re.S)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_BODY = r"""((?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"])*?)"""  # tags end outside of strings
_PIECE = re.compile(rf"\{{%(-?){_BODY}(-?)%\}}|\{{\{{(-?){_BODY}(-?)\}}\}}|\{{#(-?)(.*?)(-?)#\}}", re.S)


def _scan(source: str) -> list[tuple[str, str]]:
    """Text, expression and statement pieces with white space taken off."""
    out: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _PIECE.finditer(source):
        text = source[at : m.start()]
        kind = "%" if m[2] is not None else "{" if m[5] is not None else "#"
        left, body, right = {"%": m.group(1, 2, 3), "{": m.group(4, 5, 6), "#": m.group(7, 8, 9)}[kind]
        text = text.lstrip() if strip else text
        text = text.rstrip() if left else text
        out.append(("text", text))
        if kind != "#":
            out.append((kind, body.strip()))
        at, strip = m.end(), bool(right)
    tail = source[at:]
    if re.search(r"\{[{%#]", tail):
        raise TemplateError("a tag isn't closed")
    out.append(("text", tail.lstrip() if strip else tail))
    return [(k, t) for k, t in out if k != "text" or t]


class _Expression:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at : at + 10]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, not {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"not a permitted name: {value!r}")
        self.at += 1
        return value

    def done(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")

    def parse(self) -> Node:
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.parse() if self.take("else") else const(UNDEFINED)
            return Node("choose", (test, value, other))
        return value

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = Node("or", (left, self.both()))
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = Node("and", (left, self.negated()))
        return left

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        left = self.joined()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                left = Node("binary", (op, left, self.joined()))
            elif self.peek()[1] == "not" and self.at + 1 < len(self.items) and self.items[self.at + 1][1] == "in":
                self.at += 2
                left = Node("not", (Node("binary", ("in", left, self.joined())),))
            elif self.take("is"):
                no = self.take("not")
                test = Node("test", (self.name(), left))
                left = Node("not", (test,)) if no else test
            else:
                return left

    def joined(self) -> Node:
        left = self.sum()
        while self.take("~"):
            left = Node("binary", ("~", left, self.sum()))
        return left

    def sum(self) -> Node:
        left = self.product()
        while op := self.take("+", "-"):
            left = Node("binary", (op, left, self.product()))
        return left

    def product(self) -> Node:
        left = self.signed()
        while op := self.take("*", "/", "//", "%"):
            left = Node("binary", (op, left, self.signed()))
        return left

    def signed(self) -> Node:
        return Node("minus", (self.signed(),)) if self.take("-") else self.reached()

    def reached(self) -> Node:
        value = self.atom()
        while True:
            if self.take("."):
                name = self.name()
                value = Node("method", (name, value, self.arguments())) if self.take("(") else Node("key", (value, const(name)))
            elif self.take("["):
                value = self.subscript(value)
            elif self.take("|"):
                name = self.name()
                value = Node("filter", (name, value, self.arguments() if self.take("(") else ()))
            else:
                return value

    def subscript(self, value: Node) -> Node:
        ends: list[Node] = []
        begin = const(None) if self.peek()[1] == ":" else self.parse()
        if self.take("]"):
            return Node("key", (value, begin))
        while self.take(":"):
            ends.append(const(None) if self.peek()[1] in (":", "]") else self.parse())
        self.need("]")
        return Node("slice", (value, begin, *ends[:2], *[const(None)] * (2 - len(ends))))

    def arguments(self) -> tuple[Node, ...]:
        out = []
        while not self.take(")"):
            if self.at + 1 < len(self.items) and self.items[self.at + 1] == ("op", "="):
                name = self.name()
                self.need("=")
                out.append(Node("named", (name, self.parse())))
            else:
                out.append(self.parse())
            if not self.take(",") and self.peek()[1] != ")":
                raise TemplateError("expected , or )")
        return tuple(out)

    def atom(self) -> Node:
        kind, value = self.peek()
        if kind == "number":
            self.at += 1
            return const(float(value) if "." in value else int(value))
        if kind == "string":
            self.at += 1
            return const(re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[0]), value[1:-1], flags=re.S))
        if self.take("("):
            inner = self.parse()
            self.need(")")
            return inner
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.parse())
                self.take(",")
            return Node("list", tuple(items))
        if self.take("{"):
            pairs = []
            while not self.take("}"):
                key = self.parse()
                self.need(":")
                pairs.append((key, self.parse()))
                self.take(",")
            return Node("dict", tuple(pairs))
        name = self.name()
        if name.lower() in ("true", "false", "none"):
            return const({"true": True, "false": False, "none": None}[name.lower()])
        return Node("call", (name, self.arguments())) if self.take("(") else Node("name", (name,))


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces, at = _scan(source), 0

    def body(ends: tuple[str, ...]) -> tuple[Node, str, str]:
        nonlocal at
        out: list[Node] = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                out.append(Node("text", (text,)))
                continue
            if kind == "{":
                e = _Expression(text)
                out.append(Node("print", (e.parse(),)))
                e.done()
                continue
            word, rest = (*text.split(None, 1), "", "")[:2]
            if word in ends:
                return Node("body", tuple(out)), word, rest
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z]\w*(?:\s*,\s*[A-Za-z]\w*)?)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"not a loop: {text!r}")
                names = tuple(re.split(r"\s*,\s*", m[1]))
                e = _Expression(m[2])
                over = e.either()
                test = e.parse() if e.take("if") else const(True)
                e.done()
                inner, word, _ = body(("endfor", "else"))
                other = body(("endfor",))[0] if word == "else" else Node("body")
                out.append(Node("for", (names, over, test, inner, other)))
            elif word == "if":
                out.append(branch(rest))
            elif word == "set":
                m = re.fullmatch(r"\s*([A-Za-z]\w*)(?:\.([A-Za-z]\w*))?\s*=(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"not an assignment: {text!r}")
                e = _Expression(m[3])
                out.append(Node("set", (m[1], m[2], e.parse())))
                e.done()
            elif word == "generation":
                out.append(Node("generation", (body(("endgeneration",))[0],)))
            else:
                raise TemplateError(f"unknown statement {word!r}")
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return Node("body", tuple(out)), "", ""

    def branch(condition: str) -> Node:
        e = _Expression(condition)
        test = e.parse()
        e.done()
        yes, word, rest = body(("endif", "else", "elif"))
        no = branch(rest) if word == "elif" else body(("endif",))[0] if word == "else" else Node("body")
        return Node("if", (test, yes, no))

    return body(())[0]


def _text(x: Any) -> str:
    return x if isinstance(x, str) else "" if x is UNDEFINED else str(x)


def _key(x: Any, k: Any) -> Any:
    if isinstance(x, dict):
        return x.get(k, UNDEFINED)
    if isinstance(x, (list, str, tuple)) and isinstance(k, int):
        return x[k] if -len(x) <= k < len(x) else UNDEFINED
    return UNDEFINED


def _joined(a: Any, b: Any) -> Any:
    if isinstance(a, (str, list)) and isinstance(b, (str, list)) and len(a) + len(b) > LONGEST:
        raise TemplateError("a string is too long")
    return a + b


def _times(a: Any, b: Any) -> Any:
    size = (len(a) if isinstance(a, (str, list)) else 1) * (b if isinstance(b, int) and isinstance(a, (str, list)) else 1)
    if isinstance(b, (str, list)) or size > MOST:
        raise TemplateError("a product is too long")
    return a * b


def _range(*args: int) -> list[int]:
    r = range(*args)
    if len(r) > MOST:
        raise TemplateError("a range is too long")
    return list(r)


def _refuse(message: Any = "") -> None:
    raise TemplateError(_text(message))


BINARY: dict[str, Callable] = {"+": _joined, "-": operator.sub, "*": _times, "/": operator.truediv, "//": operator.floordiv, "%": lambda a, b: operator.mod(a, b) if not isinstance(a, str) else _refuse("% formats nothing"), "~": lambda a, b: _joined(_text(a), _text(b)), "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b}
FILTERS: dict[str, Callable] = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "title": lambda x: _text(x).title(), "capitalize": lambda x: _text(x).capitalize(), "length": lambda x: 0 if x is UNDEFINED else len(x), "count": len, "string": _text, "int": lambda x: int(x), "default": lambda x, y="": y if x is UNDEFINED else x, "join": lambda x, y="": _text(y).join(map(_text, x)), "replace": lambda x, a, b: _text(x).replace(a, b), "tojson": lambda x: json.dumps(x, ensure_ascii=False), "first": lambda x: _key(list(x), 0), "last": lambda x: _key(list(x), -1), "reverse": lambda x: x[::-1], "list": list, "items": lambda x: [list(p) for p in x.items()]}
METHODS: dict[str, Callable] = {"strip": lambda x, *a: x.strip(*a), "lstrip": lambda x, *a: x.lstrip(*a), "rstrip": lambda x, *a: x.rstrip(*a), "upper": lambda x: x.upper(), "lower": lambda x: x.lower(), "startswith": lambda x, y: x.startswith(y), "endswith": lambda x, y: x.endswith(y), "split": lambda x, *a: x.split(*a), "replace": lambda x, a, b: x.replace(a, b)}
TESTS: dict[str, Callable] = {"defined": lambda x: x is not UNDEFINED, "undefined": lambda x: x is UNDEFINED, "none": lambda x: x is None, "string": lambda x: isinstance(x, str), "mapping": lambda x: isinstance(x, dict), "iterable": lambda x: isinstance(x, (list, str, dict)), "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool), "odd": lambda x: x % 2 == 1, "even": lambda x: x % 2 == 0}
_CALLS: dict[str, Callable] = {"raise_exception": _refuse, "range": _range}


def fold(node: Any) -> Any:
    """The tree with constant expressions computed and texts joined."""
    if isinstance(node, tuple):
        return tuple(fold(x) for x in node)
    if not isinstance(node, Node) or node.kind in ("const", "text", "name"):
        return node
    parts = fold(node.parts)
    node = Node(node.kind, parts)
    fixed = lambda xs: all(isinstance(x, Node) and x.kind == "const" for x in xs)
    if node.kind == "body":
        flat: list[Node] = []
        for x in parts:
            own = x.parts if x.kind == "body" else (x,)
            for y in own:
                if y.kind == "print" and y.parts[0].kind == "const":
                    y = Node("text", (_text(y.parts[0].parts[0]),))
                if y.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", (flat[-1].parts[0] + y.parts[0],))
                else:
                    flat.append(y)
        return Node("body", tuple(flat))
    if node.kind == "if" and parts[0].kind == "const":
        return parts[1] if parts[0].parts[0] else parts[2]
    if node.kind == "choose" and parts[0].kind == "const":
        return parts[1] if parts[0].parts[0] else parts[2]
    if node.kind in ("and", "or") and parts[0].kind == "const":
        return parts[1] if bool(parts[0].parts[0]) == (node.kind == "and") else parts[0]
    pure = node.kind in ("not", "minus", "key", "slice") and fixed(parts) or node.kind == "binary" and fixed(parts[1:]) or node.kind in ("filter", "method") and fixed((parts[1], *parts[2])) or node.kind == "test" and fixed(parts[1:])
    if pure:
        try:
            return const(_expression(node)({}))
        except Exception:  # it shall fail when it is reached, not before
            return node
    return node


def _call(f: Callable, args: tuple[Node, ...]) -> Callable:
    plain = [_expression(a) for a in args if a.kind != "named"]
    named = {a.parts[0]: _expression(a.parts[1]) for a in args if a.kind == "named"}
    return lambda env: f(*[a(env) for a in plain], **{k: v(env) for k, v in named.items()})


def _expression(node: Node) -> Callable[[dict], Any]:
    kind, p = node.kind, node.parts
    if kind == "const":
        return lambda env, v=p[0]: v
    if kind == "name":
        return lambda env, n=p[0]: env.get(n, UNDEFINED)
    if kind == "list":
        items = [_expression(x) for x in p]
        return lambda env: [x(env) for x in items]
    if kind == "dict":
        pairs = [(_expression(k), _expression(v)) for k, v in p]
        return lambda env: {k(env): v(env) for k, v in pairs}
    if kind in ("and", "or"):
        a, b = map(_expression, p)
        return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))
    if kind == "not":
        a = _expression(p[0])
        return lambda env: not a(env)
    if kind == "minus":
        a = _expression(p[0])
        return lambda env: -a(env)
    if kind == "choose":
        t, a, b = map(_expression, p)
        return lambda env: a(env) if t(env) else b(env)
    if kind == "binary":
        f, a, b = BINARY[p[0]], _expression(p[1]), _expression(p[2])
        return lambda env: f(a(env), b(env))
    if kind == "key":
        a, k = map(_expression, p)
        return lambda env: _key(a(env), k(env))
    if kind == "slice":
        a, i, j, k = map(_expression, p)
        return lambda env: a(env)[i(env) : j(env) : k(env)]
    if kind == "test":
        if p[0] not in TESTS:
            raise TemplateError(f"unknown test {p[0]!r}")
        f, a = TESTS[p[0]], _expression(p[1])
        return lambda env: f(a(env))
    if kind in ("filter", "method"):
        table = FILTERS if kind == "filter" else METHODS
        if p[0] not in table:
            raise TemplateError(f"unknown {kind} {p[0]!r}")
        inner = _call(table[p[0]], (p[1], *p[2]))
        if kind == "filter":
            return inner
        own = _expression(p[1])

        def method(env):
            if not isinstance(own(env), str):
                raise TemplateError(f"{p[0]} is a method of strings")
            return inner(env)

        return method
    if kind == "call":
        if p[0] == "namespace":
            return _call(lambda **k: dict(k), p[1])
        if p[0] not in _CALLS:
            raise TemplateError(f"unknown function {p[0]!r}")
        return _call(_CALLS[p[0]], p[1])
    raise TemplateError(f"not an expression: {kind}")


class _Out:
    def __init__(self):
        self.parts: list[str] = []
        self.size = self.rounds = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)
        if self.size > LONGEST:
            raise TemplateError("the text is too long")

    def step(self) -> None:
        self.rounds += 1
        if self.rounds > ROUNDS:
            raise TemplateError("loops go on for too long")


def _statement(node: Node) -> Callable[[dict, _Out], None]:
    kind, p = node.kind, node.parts
    if kind == "text":
        return lambda env, out, t=p[0]: out.write(t)
    if kind == "print":
        e = _expression(p[0])
        return lambda env, out: out.write(_text(e(env)))
    if kind == "body":
        steps = [_statement(x) for x in p]

        def run(env, out):
            for s in steps:
                s(env, out)

        return run
    if kind == "if":
        t, yes, no = _expression(p[0]), _statement(p[1]), _statement(p[2])
        return lambda env, out: yes(env, out) if t(env) else no(env, out)
    if kind == "set":
        name, field, e = p[0], p[1], _expression(p[2])

        def assign(env, out):
            if field is None:
                env[name] = e(env)
            elif isinstance(env.get(name), dict):
                env[name][field] = e(env)
            else:
                raise TemplateError(f"{name} isn't a namespace")

        return assign
    if kind == "generation":
        inner = _statement(p[0])

        def mark(env, out):
            begin = out.size
            inner(env, out)
            out.spans.append((begin, out.size))

        return mark
    if kind == "for":
        names, over, test, inner, other = p[0], _expression(p[1]), _expression(p[2]), _statement(p[3]), _statement(p[4])

        def bound(env, x):
            own = dict(env)  # names set inside a loop end with its round
            own.update(zip(names, x, strict=True) if len(names) > 1 else [(names[0], x)])
            return own

        def loop(env, out):
            items = [x for x in over(env) if test(bound(env, x))]
            if not items:
                other(env, out)
            for i, x in enumerate(items):
                out.step()
                own = bound(env, x)
                own["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items), "previtem": items[i - 1] if i else UNDEFINED, "nextitem": items[i + 1] if i + 1 < len(items) else UNDEFINED}
                inner(own, out)

        return loop
    raise TemplateError(f"not a statement: {kind}")


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function from variables to the rendered text and the generated spans."""
    run = _statement(fold(parse(source)))

    def render(**variables):
        out = _Out()
        try:
            run(dict(variables), out)
        except TemplateError:
            raise
        except Exception as e:
            raise TemplateError(f"{type(e).__name__}: {e}") from e
        return "".join(out.parts), out.spans

    return render


def format_chats(conversations: DataFrame, template: str = CHATML, ident: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **variables: Any) -> DataFrame:
    """conv_id, text, n_messages, spans ("begin-end,...") and generated_chars."""
    compile_template(template)  # fails here rather than in a task
    message = F.struct(col(conversations, turn).alias("turn"), col(conversations, role).alias("role"), col(conversations, text).alias("text"))
    chats = conversations.select(col(conversations, ident).cast("long").alias("conv_id"), message.alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    chats = chats.select("conv_id", F.transform("m", lambda x: x["role"]).alias("roles"), F.transform("m", lambda x: x["text"]).alias("texts"))

    def run(batches):
        render = compile_template(template)
        for batch in batches:
            done = []
            for roles, texts in zip(column(batch, "roles").to_pylist(), column(batch, "texts").to_pylist(), strict=True):
                messages = [{"role": "unknown" if r is None else r, "content": t or ""} for r, t in zip(roles, texts, strict=True)]
                out, spans = render(messages=messages, **variables)
                done.append((out, len(messages), ",".join(f"{a}-{b}" for a, b in spans), sum(b - a for a, b in spans)))
            if done:
                out, n, spans, chars = zip(*done, strict=True)
                yield pa.record_batch({"conv_id": column(batch, "conv_id"), "text": pa.array(out, pa.string()), "n_messages": pa.array(n, pa.int64()), "spans": pa.array(spans, pa.string()), "generated_chars": pa.array(chars, pa.int64())})

    return chats.mapInArrow(run, "conv_id long, text string, n_messages long, spans string, generated_chars long")
