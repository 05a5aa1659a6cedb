"""Chat formatting by a small template compiler.

A template is text with {{ expressions }} and the blocks for / if / elif / else /
generation. It is parsed into a syntax tree, constants are folded, and closures
are generated that render a conversation and note which code points lie in
generation blocks (the loss mask). The language is sandboxed: names come from the
rendered values, attributes only look up keys of dicts, nothing can be called but
the filters given to the compiler.

Control strings inside texts are escaped reversibly: a backslash is doubled, and
backslash and dot go behind the first character of a control string. So markers in
the output come from the template alone, and turns can be read back.

Null roles and texts count as empty. Turns are ordered by turn, role and text, so
ties and repeated rows have one order; rows with a null conversation id form one
conversation. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed control strings of common chat formats, besides this template's own.
CONTROLS = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|end|>{% endfor %}"
)


class TemplateError(ValueError):
    pass


# ---- syntax tree -------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, body)
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~|.<>()\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = Op("or", (node, self.both()))
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = Op("and", (node, self.negated()))
        return node

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        while op := self.take(*_COMPARE):
            node = Op(op, (node, self.joined()))
        return node

    def joined(self):
        node = self.filtered()
        while op := self.take("+", "~", "-"):
            node = Op(op, (node, self.filtered()))
        return node

    def filtered(self):
        node = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name":
                raise TemplateError("a filter needs a name")
            self.at += 1
            node = Filter(name, node)
        return node

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            node = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        elif kind == "int":
            node = Const(int(value))
        elif kind == "name":
            node = Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        elif value == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("( isn't closed")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while mark := self.take(".", "["):
            if mark == ".":
                kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name":
                    raise TemplateError("an attribute needs a name")
                self.at += 1
                node = Get(node, Const(value))
            else:
                node = Get(node, self.either())
                if not self.take("]"):
                    raise TemplateError("[ isn't closed")
        return node


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of statements."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        pieces.append(("value", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    pos = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal pos
        out = []
        while pos < len(pieces):
            kind, value = pieces[pos]
            pos += 1
            if kind == "text":
                out.append(Emit(Const(value)))
                continue
            if kind == "value":
                out.append(Emit(_Expression(value).whole()))
                continue
            word = value.split(None, 1)[0] if value else ""
            if word in ends:
                return tuple(out), value
            if word == "for" and (m := re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", value, re.S)):
                inner, _ = body("endfor")
                out.append(For(m[1], _Expression(m[2]).whole(), inner))
            elif word == "if":
                arms, other, tag = [], (), value
                while tag.split(None, 1)[0] in ("if", "elif"):
                    condition = _Expression(tag.split(None, 1)[1]).whole()
                    inner, tag = body("elif", "else", "endif")
                    arms.append((condition, inner))
                if tag == "else":
                    other, tag = body("endif")
                out.append(If(tuple(arms), other))
            elif word == "generation":
                inner, _ = body("endgeneration")
                out.append(Generation(inner))
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    return body()[0]


# ---- constant folding ----------------------------------------------------------


def fold(node, filters: dict[str, Callable]):
    """The same tree with constant parts computed and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for n in node:
            n = fold(n, filters)
            if isinstance(n, If) and all(isinstance(c, Const) for c, _ in n.arms):
                inner = next((b for c, b in n.arms if c.value), n.other)
            else:
                inner = (n,)
            for x in inner:
                if isinstance(x, Emit) and isinstance(x.value, Const):
                    text = _shown(x.value.value)
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        text = out.pop().value.value + text
                    x = Emit(Const(text))
                    if not text:
                        continue
                out.append(x)
        return tuple(out)
    if isinstance(node, Emit):
        return Emit(fold(node.value, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        arms = tuple((c, fold(b, filters)) for c, b in ((fold(c, filters), b) for c, b in node.arms) if not (isinstance(c, Const) and not c.value))
        return If(arms, fold(node.other, filters)) if arms else If(((Const(True), fold(node.other, filters)),), ())
    if isinstance(node, Op):
        node = Op(node.op, tuple(fold(a, filters) for a in node.args))
        return Const(expression(node, filters)({})) if all(isinstance(a, Const) for a in node.args) else node
    if isinstance(node, Filter):
        node = Filter(node.name, fold(node.of, filters))
        return Const(expression(node, filters)({})) if isinstance(node.of, Const) else node
    if isinstance(node, Get):
        return Get(fold(node.of, filters), fold(node.key, filters))
    return node


# ---- closures --------------------------------------------------------------------


def _shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def expression(node, filters: dict[str, Callable]) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def look(env):
            if name not in env:
                raise TemplateError(f"{name} isn't defined")
            return env[name]

        return look
    if isinstance(node, Get):
        of, key = expression(node.of, filters), expression(node.key, filters)

        def get(env):
            thing, k = of(env), key(env)
            if isinstance(thing, dict):
                return thing.get(k)
            if isinstance(thing, (list, tuple)) and isinstance(k, int):
                return thing[k] if -len(thing) <= k < len(thing) else None
            raise TemplateError(f"{type(thing).__name__} has no parts")

        return get
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        f, of = filters[node.name], expression(node.of, filters)
        return lambda env: f(of(env))
    args = [expression(a, filters) for a in node.args]
    if node.op == "not":
        return lambda env: not args[0](env)
    a, b = args
    if node.op == "and":
        return lambda env: a(env) and b(env)
    if node.op == "or":
        return lambda env: a(env) or b(env)
    if node.op == "~":
        return lambda env: _shown(a(env)) + _shown(b(env))
    if node.op == "+":
        return lambda env: a(env) + b(env)
    if node.op == "-":
        return lambda env: a(env) - b(env)
    compare = _COMPARE[node.op]
    return lambda env: compare(a(env), b(env))


class _Output:
    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def statements(nodes: tuple, filters: dict[str, Callable]) -> Callable[[dict, _Output], None]:
    steps = [_statement(n, filters) for n in nodes]

    def run(env, out):
        for step in steps:
            step(env, out)

    return steps[0] if len(steps) == 1 else run


def _statement(node, filters):
    if isinstance(node, Emit):
        if isinstance(node.value, Const):
            text = _shown(node.value.value)
            return lambda env, out: out.add(text)
        value = expression(node.value, filters)
        return lambda env, out: out.add(_shown(value(env)))
    if isinstance(node, For):
        over, body, name = expression(node.over, filters), statements(node.body, filters), node.name

        def loop(env, out):
            items = list(over(env))
            for i, item in enumerate(items):
                body({**env, name: item, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}}, out)

        return loop
    if isinstance(node, If):
        arms = [(expression(c, filters), statements(b, filters)) for c, b in node.arms]
        other = statements(node.other, filters)

        def choose(env, out):
            for condition, body in arms:
                if condition(env):
                    return body(env, out)
            other(env, out)

        return choose
    body = statements(node.body, filters)

    def generate(env, out):
        start = out.length
        body(env, out)
        out.spans.append((start, out.length))

    return generate


def escaper(controls: Iterable[str] = CONTROLS) -> Callable[[object], str]:
    found = re.compile("|".join([r"\\", *(re.escape(c) for c in sorted(controls, key=len, reverse=True))]))
    swap = lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\." + m[0][1:]
    return lambda value: found.sub(swap, _shown(value))


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "" if m[1] == "." else m[1], text)


class Template:
    """A compiled template; render gives the text and its loss spans."""

    def __init__(self, source: str = TEMPLATE, controls: Iterable[str] = CONTROLS):
        filters = {"escape": escaper(controls), "trim": lambda v: _shown(v).strip(), "upper": lambda v: _shown(v).upper(), "lower": lambda v: _shown(v).lower(), "length": len}
        self.tree = fold(parse(source), filters)
        self._run = statements(self.tree, filters)

    def render(self, messages: list[dict], **values) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        self._run({**values, "messages": messages}, out)
        return "".join(out.parts), out.spans


_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in the output of TEMPLATE."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, spans) of rows (conv_id, turn, role, text); spans are
    start and end of each stretch under the loss mask, in code points."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))

    def run(batches):
        compiled = Template(template)
        for batch in batches:
            done = [compiled.render(m) for m in batch.column("messages").to_pylist()]
            spans = pa.array([[p for s in x[1] for p in s] for x in done], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([x[0] for x in done], pa.string()), spans], ["conv_id", "formatted", "spans"])

    return rows.groupBy("conv_id").agg(turns.alias("messages")).mapInArrow(run, "conv_id long, formatted string, spans array<long>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations."""

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist()):
                turns = read_back(text)
                under = "".join(unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2]))
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((len(turns), sha(told), len(under), sha(under), len(text)))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds: its texts look like control strings.
ADDED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def digests_sql() -> str:
    """The digests as DuckDB SQL over the table conversations."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    extra = lambda c: " + ".join([f"length({c}) - length(replace({c}, '\\', ''))", *(f"2 * ((length({c}) - length(replace({c}, {quote(k)}, ''))) // {len(k)})" for k in CONTROLS)])
    added = " UNION ALL ".join(f"SELECT {i}, {t}, {quote(r)}, {quote(x)}" for i, t, r, x in ADDED)
    marks = len("<|turn|><|text|><|end|>")
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {added})),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
sum({marks} + length(role) + length(text) + {extra("role")} + {extra("text")}) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
