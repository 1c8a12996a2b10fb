"""Chat formatting by a template compiler.

The template language has text, ``{{ expression }}``, ``{% if %}``, ``{% elif %}``,
``{% else %}``, ``{% for x in expression %}``, ``{% set x = expression %}`` and
``{% generation %}``. A dash inside a tag's brace, ``{%-`` or ``-%}``, takes away the
white space of the template on that side. A template is parsed into a syntax tree, constant parts are
folded, and the tree becomes Python closures. It is sandboxed: an expression
reaches only the names it is given, items of dicts and lists, the loop's counters
and the filters below; there are no calls, no attributes and no assignments
outside the template.

What stands between ``{% generation %}`` and ``{% endgeneration %}`` is a span of
the loss mask, in code points of the output.

Control strings inside texts are escaped by a backslash after their first
character, so that none stands whole in an escaped text, and backslashes by
another before them; a formatted conversation can be read back whatever its texts
hold. Operators and filters on values that they don't take raise TemplateError,
when the template is compiled if the values are constants."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import arrow_map

#: The strings with which the template below marks turns.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<ROLE>>", "<</ROLE>>")

#: Each turn with its role; what an assistant says is under the loss mask.
TEMPLATE = (
    "{% for m in messages %}"
    "<s><<ROLE>>{{ m['role'] | escape }}<</ROLE>>"
    "{% if m['role'] == 'assistant' %}{% generation %}{{ m['text'] | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m['text'] | escape }}[/INST]{% endif %}"
    "</s>"
    "{% endfor %}"
)

_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_MARK = re.compile(r"\\.|" + "|".join(f"({re.escape(c)})" for c in CONTROL), re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(), "length": len, "string": str,
}


class TemplateError(ValueError):
    pass


# --- expressions: a tree of tuples, (kind, ...) ---

_LEX = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+%~|()\[\].<>]))", re.S)
_WORDS = {"and", "or", "not", "in", "true", "false", "none"}
_STRING = {"n": "\n", "t": "\t", "r": "\r"}


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """Precedence climbing over the lexed source."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-", "~"), ("%",))

    def __init__(self, source: str):
        self.lexed, self.at = _lex(source), 0
        self.tree = self.level(0)
        if self.lexed[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.lexed[self.at][1]!r} in {source!r}")

    def take(self, *values: str) -> str | None:
        kind, value = self.lexed[self.at]
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing before {self.lexed[self.at][1]!r}")

    def name(self) -> str:
        kind, value = self.lexed[self.at]
        if kind != "name" or value in _WORDS:
            raise TemplateError(f"a name is missing before {value!r}")
        self.at += 1
        return value

    def level(self, n: int):
        if n == len(self.LEVELS):
            return self.unary()
        if n == 2 and self.take("not"):
            return fold(("not", self.level(2)))
        tree = self.level(n + 1)
        while op := self.take(*self.LEVELS[n]):
            tree = fold((op, tree, self.level(n + 1)))
        return tree

    def unary(self):
        kind, value = self.lexed[self.at]
        self.at += 1
        if kind == "num":
            tree = ("const", int(value))
        elif kind == "str":
            tree = ("const", re.sub(r"\\(.)", lambda m: _STRING.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif value == "(":
            tree = self.level(0)
            self.need(")")
        elif value in ("true", "false", "none"):
            tree = ("const", {"true": True, "false": False, "none": None}[value])
        elif kind == "name" and value not in _WORDS:
            tree = ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while op := self.take("[", ".", "|"):
            if op == "[":
                tree = fold(("item", tree, self.level(0)))
                self.need("]")
            elif op == ".":
                tree = fold(("item", tree, ("const", self.name())))
            else:
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"there is no filter {name}")
                tree = fold(("filter", tree, name))
        return tree


def _item(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"{type(of).__name__} has no items by {type(key).__name__}")


_TWO = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b,
    "-": lambda a, b: a - b, "%": lambda a, b: a % b if isinstance(a, int) else None, "~": lambda a, b: f"{a}{b}",
    "item": _item,
}


def _checked(f: Callable, name: str) -> Callable:
    """``f`` with unlike operands as an error of the template's."""
    def run(*values):
        try:
            return f(*values)
        except (TypeError, ZeroDivisionError) as e:
            raise TemplateError(f"{name} doesn't take {', '.join(type(v).__name__ for v in values)}: {e}") from None

    return run


def fold(tree):
    """A node whose operands are all constants is its value."""
    if tree[0] in ("const", "name") or any(isinstance(x, tuple) and x[0] != "const" for x in tree[1:]):
        return tree
    return ("const", closure(tree)({}))


def closure(tree) -> Callable[[dict], object]:
    kind, *of = tree
    if kind == "const":
        value = of[0]
        return lambda names: value
    if kind == "name":
        name = of[0]
        return lambda names: names.get(name)
    a = closure(of[0])
    if kind == "not":
        return lambda names: not a(names)
    if kind == "filter":
        f = _checked(FILTERS[of[1]], of[1])
        return lambda names: f(a(names))
    b = closure(of[1])
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    f = _checked(_TWO[kind], kind)
    return lambda names: f(a(names), b(names))


# --- statements ---

_TAG = re.compile(r"(?:\{%(-?)\s*(.*?)\s*(-?)%\}|\{\{(-?)(.*?)(-?)\}\})", re.S)


@dataclass
class _Cursor:
    parts: list[tuple[str, str]]
    at: int = 0


def parse(template: str) -> list:
    """The statements: ("text", s), ("put", expression), ("if", [(test, body)]),
    ("for", name, expression, body), ("set", name, expression), ("mask", body)."""
    parts, at, trim = [], 0, False
    for m in _TAG.finditer(template):
        text = template[at : m.start()]
        text = text.lstrip() if trim else text
        parts.append(("text", text.rstrip() if m[1] or m[4] else text))
        parts.append(("tag", m[2]) if m[2] is not None else ("put", m[5]))
        at, trim = m.end(), bool(m[3] or m[6])
    parts.append(("text", template[at:].lstrip() if trim else template[at:]))
    cursor = _Cursor([p for p in parts if p[0] != "text" or p[1]])
    body, end = _body(cursor, ())
    return body


def _body(cursor: _Cursor, ends: tuple[str, ...]) -> tuple[list, str]:
    out: list = []
    while cursor.at < len(cursor.parts):
        kind, value = cursor.parts[cursor.at]
        cursor.at += 1
        if kind == "text":
            _add(out, ("text", value))
            continue
        if kind == "put":
            tree = _Expression(value).tree
            _add(out, ("text", _shown(tree[1])) if tree[0] == "const" else ("put", tree))
            continue
        word, _, rest = value.partition(" ")
        if word in ends:
            return out, value
        if word == "if":
            branches, test = [], _Expression(rest).tree
            while True:
                inner, end = _body(cursor, ("elif", "else", "endif"))
                branches.append((test, inner))
                if end == "endif":
                    break
                test = ("const", True) if end == "else" else _Expression(end.partition(" ")[2]).tree
            _branch(out, branches)
        elif word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*) in (.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            inner, _ = _body(cursor, ("endfor",))
            out.append(("for", m[1], _Expression(m[2]).tree, inner))
        elif word == "set":
            name, _, source = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError(f"set {rest}")
            out.append(("set", name.strip(), _Expression(source).tree))
        elif word == "generation":
            inner, _ = _body(cursor, ("endgeneration",))
            out.append(("mask", inner))
        else:
            raise TemplateError(f"unknown tag {value!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return out, ""


def _add(out: list, part: tuple) -> None:
    """Neighbouring texts are one."""
    if part[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + part[1])
    elif part != ("text", ""):
        out.append(part)


def _branch(out: list, branches: list) -> None:
    """Constant tests choose now."""
    kept = []
    for test, body in branches:
        if test[0] != "const":
            kept.append((test, body))
        elif test[1]:
            kept.append((test, body))
            break
    if kept and kept[0][0][0] == "const":
        for part in kept[0][1]:
            _add(out, part)
    elif kept:
        out.append(("if", kept))


def _shown(value) -> str:
    return "" if value is None else str(value)


class _Out:
    """What has been rendered: pieces, their length, and the mask's spans."""

    __slots__ = ("pieces", "size", "spans")

    def __init__(self):
        self.pieces, self.size, self.spans = [], 0, []

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def _run(body: list) -> Callable[[dict, _Out], None]:
    steps = [_step(s) for s in body]

    def run(names, out):
        for s in steps:
            s(names, out)

    return steps[0] if len(steps) == 1 else run


def _step(statement: tuple) -> Callable[[dict, _Out], None]:
    kind, *of = statement
    if kind == "text":
        text = of[0]
        return lambda names, out: out.put(text)
    if kind == "put":
        value = closure(of[0])
        return lambda names, out: out.put(_shown(value(names)))
    if kind == "set":
        name, value = of[0], closure(of[1])
        return lambda names, out: names.__setitem__(name, value(names))
    if kind == "mask":
        inner = _run(of[0])

        def mask(names, out):
            start = out.size
            inner(names, out)
            out.spans.append((start, out.size))

        return mask
    if kind == "if":
        branches = [(closure(t), _run(b)) for t, b in of[0]]

        def choose(names, out):
            for test, body in branches:
                if test(names):
                    return body(names, out)

        return choose
    name, values, inner = of[0], closure(of[1]), _run(of[2])

    def loop(names, out):
        own = dict(names)
        items = values(names) or ()
        if not isinstance(items, (list, tuple, str, dict)):
            raise TemplateError(f"for doesn't take {type(items).__name__}")
        for i, x in enumerate(items):
            own[name] = x
            own["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i + 1 == len(items), "length": len(items)}
            inner(own, out)

    return loop


def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from names to the rendered text and the mask's spans."""
    run = _run(parse(template) or [("text", "")])

    def render(names: dict):
        out = _Out()
        run(dict(names), out)
        return "".join(out.pieces), out.spans

    return render


def read_turns(formatted: str) -> list[tuple[str | None, str]]:
    """The turns of a conversation that ``TEMPLATE`` formatted: role and text. What
    another template made is read by the marks it has: a turn for each end mark,
    with what stands since the last turn or mark as text where no text is marked,
    and no turns without end marks."""
    turns, role, text, start = [], None, None, 0
    for m in _MARK.finditer(formatted):
        mark = m[0]
        if mark[0] == "\\":
            continue
        if mark == "<<ROLE>>" or mark == "[INST]":
            start = m.end()
        elif mark == "<</ROLE>>":
            role, start = unescape(formatted[start : m.start()]), m.end()
            text = None
        elif mark == "[/INST]":
            text = unescape(formatted[start : m.start()])
        elif mark == "</s>":
            turns.append((role, unescape(formatted[start : m.start()]) if text is None else text))
            role, text, start = None, None, m.end()
    return turns


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """A row for each conv_id: ``formatted``, and ``spans``, the start and end of
    each stretch under the loss mask, in code points.

    Turns go by turn (null first), then role and text, so ties have one order;
    repeated rows are repeated turns. Null texts and roles are empty; rows with
    a null conv_id are one conversation. An empty table gives no rows. Columns
    other than conv_id, turn, role and text don't matter. A conversation is one
    value, so it has to fit in memory."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    schema = grouped.select("conv_id", F.lit("").alias("formatted"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).schema

    def make():
        render = compile_template(template)

        def step(cols):
            got = [render({"messages": turns}) for turns in cols["turns"]]
            return {"conv_id": cols["conv_id"], "formatted": [g[0] for g in got], "spans": [[{"start": s, "end": e} for s, e in g[1]] for g in got]}

        return step

    return arrow_map(grouped, make, schema, 256)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts out of what ``format_conversations`` returned with
    ``TEMPLATE``: conv_id, ``turns`` (role, text), ``loss`` (unescaped texts)."""
    rows = formatted.select("conv_id", "formatted", "spans")
    schema = rows.select("conv_id", F.array().cast("array<struct<role:string,text:string>>").alias("turns"), F.array().cast("array<string>").alias("loss"), F.lit(0).cast("long").alias("formatted_chars")).schema

    def make():
        def step(cols):
            return {
                "conv_id": cols["conv_id"],
                "turns": [[{"role": r, "text": t} for r, t in read_turns(f)] for f in cols["formatted"]],
                "loss": [[unescape(f[s["start"] : s["end"]]) for s in spans] for f, spans in zip(cols["formatted"], cols["spans"])],
                "formatted_chars": [len(f) for f in cols["formatted"]],
            }

        return step

    return arrow_map(rows, make, schema, 256)
