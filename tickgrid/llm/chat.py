"""Chat formatting with a compiled, sandboxed template language.

A template is parsed into a small syntax tree, constants are folded, and the tree is
turned into Python closures. There is no way to call, import or reach an attribute from
a template: it knows text, names of the turn and loop, string literals, ``+``, ``==``,
``and``, ``or``, ``not``, the filters ``escape`` and ``trim``, ``if``, one kind of
``for`` and the ``generation`` block that marks what a model is to learn.

    {{ expression }}   {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% for turn in turns %}..{% endfor %}   {% generation %}..{% endgeneration %}
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

#: Marks each turn; the escape filter keeps its control strings out of roles and texts.
TEMPLATE = (
    "{% for turn in turns %}"
    "<turn {{ turn.role | escape }}>"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)

_ESCAPED = re.compile(r"[\\<>]")
_BACK = re.compile(r"\\(.)", re.S)
#: A turn as TEMPLATE writes it.
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    r"""Put a backslash before ``\``, ``<`` and ``>``, so that no control string can occur."""
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip}

# --- syntax tree ---------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: str | bool


@dataclass(frozen=True)
class Name:
    path: str


@dataclass(frozen=True)
class Apply:
    """An operator or filter on expressions."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class Branch:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Loop:
    variable: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_][\w.]*)|(==|!=|[+|()]))")


@dataclass
class _Expression:
    """Recursive descent over: or, and, not, comparison, sum, filter."""

    source: str
    tokens: list[tuple[str, str]] = field(default_factory=list)

    def parse(self) -> object:
        at, text = 0, self.source.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            kind = "text" if m[1] else "name" if m[2] else "sign"
            self.tokens.append((kind, m[1] or m[2] or m[3]))
            at = m.end()
        tree = self._either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r} in {self.source!r}")
        return tree

    def _next(self, *values: str) -> str | None:
        if self.tokens and self.tokens[0][0] != "text" and self.tokens[0][1] in values:
            return self.tokens.pop(0)[1]
        return None

    def _chain(self, part: Callable[[], object], *ops: str) -> object:
        tree = part()
        while op := self._next(*ops):
            tree = Apply(op, (tree, part()))
        return tree

    def _either(self) -> object:
        return self._chain(lambda: self._chain(self._negated, "and"), "or")

    def _negated(self) -> object:
        return Apply("not", (self._negated(),)) if self._next("not") else self._chain(lambda: self._chain(self._filtered, "+"), "==", "!=")

    def _filtered(self) -> object:
        tree = self._atom()
        while self._next("|"):
            kind, name = self.tokens.pop(0) if self.tokens else ("", "")
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            tree = Apply(name, (tree,))
        return tree

    def _atom(self) -> object:
        if self._next("("):
            tree = self._either()
            if not self._next(")"):
                raise TemplateError("missing )")
            return tree
        if not self.tokens:
            raise TemplateError(f"incomplete expression {self.source!r}")
        kind, value = self.tokens.pop(0)
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return Const(value == "true") if value in ("true", "false") else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """Template source -> syntax tree."""
    items: list[tuple[str, str]] = []
    at = 0
    for m in _TAGS.finditer(source):
        items += [("text", source[at : m.start()])] * (m.start() > at) + [("value", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    items += [("text", source[at:])] * (at < len(source))

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nodes: list[object] = []
        while items:
            kind, value = items.pop(0)
            word, _, rest = value.partition(" ")
            if kind == "text":
                nodes.append(Emit(Const(value)))
            elif kind == "value":
                nodes.append(Emit(_Expression(value).parse()))
            elif word in ends:
                return tuple(nodes), value
            elif word == "if":
                nodes.append(branch(rest))
            elif word == "for" and (m := re.fullmatch(r"(\w+) in turns", rest.strip())):
                nodes.append(Loop(m[1], block(("endfor",))[0]))
            elif word == "generation":
                nodes.append(Generation(block(("endgeneration",))[0]))
            else:
                raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(nodes), ""

    def branch(test: str) -> Branch:
        yes, end = block(("elif", "else", "endif"))
        no: tuple = ()
        if end.startswith("elif"):
            no = (branch(end[4:]),)
        elif end == "else":
            no = block(("endif",))[0]
        return Branch(_Expression(test).parse(), yes, no)

    return block(())[0]


_OPERATORS: dict[str, Callable] = {"+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a, **FILTERS}


def fold(tree: object) -> object:
    """Evaluate what holds only constants, drop dead branches and join neighbouring texts."""
    if isinstance(tree, Apply):
        args = tuple(map(fold, tree.args))
        return Const(_OPERATORS[tree.op](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Apply(tree.op, args)
    if isinstance(tree, Emit):
        return Emit(fold(tree.value))
    if isinstance(tree, Branch):
        return Branch(fold(tree.test), fold(tree.yes), fold(tree.no))
    if isinstance(tree, Loop):
        return Loop(tree.variable, fold(tree.body))
    if isinstance(tree, Generation):
        return Generation(fold(tree.body))
    if isinstance(tree, tuple):
        out: list[object] = []
        for node in map(fold, tree):
            if isinstance(node, Branch) and isinstance(node.test, Const):
                nodes = node.yes if node.test.value else node.no
            else:
                nodes = (node,)
            for n in nodes:
                if isinstance(n, Emit) and isinstance(n.value, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    out[-1] = Emit(Const(out[-1].value.value + n.value.value))
                else:
                    out.append(n)
        return tuple(out)
    return tree


# --- closures --------------------------------------------------------------------

#: A rendered piece of a conversation: (number of the turn or -1, text, whether it is under the loss mask).
Piece = tuple[int, str, bool]


def _value(tree: object) -> Callable[[dict], object]:
    if isinstance(tree, Const):
        return lambda scope, v=tree.value: v
    if isinstance(tree, Name):
        def look(scope: dict, path: str = tree.path) -> object:
            if path not in scope:
                raise TemplateError(f"unknown name {path!r}")
            return scope[path]
        return look
    args, op = tuple(map(_value, tree.args)), tree.op
    if op in ("and", "or"):  # the second only where needed
        return lambda scope: args[1](scope) if bool(first := args[0](scope)) == (op == "and") else first
    f = _OPERATORS[op]
    return lambda scope: f(*(a(scope) for a in args))


def _is_test(tree: object, names: frozenset[str], place: str) -> bool:
    """Whether an expression is a test and not a text; unknown names and mixed types raise."""
    if isinstance(tree, Const):
        return isinstance(tree.value, bool)
    if isinstance(tree, Name):
        if tree.path not in names:
            raise TemplateError(f"unknown name {tree.path!r} {place}")
        return tree.path == "loop.first"
    kinds = [_is_test(a, names, place) for a in tree.args]
    if tree.op in ("and", "or"):
        if kinds[0] != kinds[1]:
            raise TemplateError(f"{tree.op!r} of a test and a text {place}")
        return kinds[0]
    if tree.op in ("+", *FILTERS) and any(kinds):
        raise TemplateError(f"{tree.op!r} needs texts {place}")
    return tree.op in ("==", "!=", "not")


def check(tree: tuple, names: frozenset[str] = frozenset(), inside: bool = False) -> int:
    """Raise for unknown names, tests put out as text and loops within loops; the number of loops."""
    n = 0
    for node in tree:
        if isinstance(node, Emit):
            if _is_test(node.value, names, "in an output"):
                raise TemplateError("a test cannot be put out as text")
        elif isinstance(node, Branch):
            _is_test(node.test, names, "in a test")
            n += check(node.yes, names, inside) + check(node.no, names, inside)
        elif isinstance(node, Generation):
            n += check(node.body, names, inside)
        elif inside:
            raise TemplateError("a loop over turns inside another")
        else:
            check(node.body, names | {f"{node.variable}.role", f"{node.variable}.text", "loop.first"}, True)
            n += 1
    return n


def _render(tree: tuple, learnt: bool = False) -> Callable[[dict, Iterator], Iterator[Piece]]:
    steps = []
    for node in tree:
        if isinstance(node, Emit):
            def step(scope, turns, f=_value(node.value)):
                yield scope["#"], f(scope), learnt
        elif isinstance(node, Branch):
            def step(scope, turns, test=_value(node.test), yes=_render(node.yes, learnt), no=_render(node.no, learnt)):
                yield from (yes if test(scope) else no)(scope, turns)
        elif isinstance(node, Generation):
            def step(scope, turns, body=_render(node.body, True)):
                yield from body(scope, turns)
        else:
            def step(scope, turns, body=_render(node.body, learnt), name=node.variable):
                for i, (role, text) in enumerate(turns):
                    own = scope | {"#": i, f"{name}.role": role, f"{name}.text": text, "loop.first": i == 0}
                    yield from body(own, turns)
        steps.append(step)

    def run(scope: dict, turns: Iterator) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, turns)

    return run


def compile_template(source: str) -> Callable[[Iterator[tuple[str, str]]], Iterator[Piece]]:
    """A function from an iterator of (role, text) to rendered pieces.

    It holds one turn at a time; a template with several loops holds a conversation's turns,
    since each loop goes over all of them. Faults in the template raise here.
    """
    tree = parse(source)
    loops = check(tree)
    run = _render(fold(tree))
    return lambda turns: run({"#": -1}, turns if loops < 2 else list(turns))


# --- Spark -------------------------------------------------------------------------

PIECES = "conv_id long, turn_no long, start long, formatted string, loss_starts array<long>, loss_ends array<long>"


def _conversations(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Sorted rows -> (conv_id, its rows), streaming across batches."""
    rows = (r for f in frames for r in zip(f["conv_id"].astype(object).where(f["conv_id"].notna(), None), *(f[c] for c in f.columns if c != "conv_id")))
    return groupby(rows, key=lambda r: r[0])


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> the formatted text, one row per turn.

    ``start`` is the row's place in the conversation's whole text, in code points; the
    loss spans count from the row's own start. Text before or after the turns comes with
    the first row and as a last row. Rows go by turn, then role, then text (nulls first),
    so repeated rows are turns of their own; null roles and texts are empty; rows with a
    null conv_id form one conversation. A conversation is streamed turn by turn through
    one task, so its length is bounded by no memory. Other columns are ignored.
    """
    compile_template(template)  # errors show on the driver

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        out: list[tuple] = []
        size = 0
        for conv, rows in _conversations(frames):
            conv = None if conv is None else int(conv)
            turns = ((role or "", text or "") for _, _, role, text in rows)
            at, number, text, starts, ends = 0, 0, [], [], []
            length = 0
            for no, piece, learnt in render(turns):
                if no != number and no != 0 and text:
                    out.append((conv, number, at, "".join(text), starts, ends))
                    size += length
                    at, length, text, starts, ends = at + length, 0, [], [], []
                    if size > 4_000_000:
                        yield pd.DataFrame(out, columns=PIECE_NAMES)
                        out, size = [], 0
                number = no
                if learnt and piece:
                    starts.append(length)
                    ends.append(length + len(piece))
                text.append(piece)
                length += len(piece)
            out.append((conv, number, at, "".join(text), starts, ends))
            size += length
        yield pd.DataFrame(out, columns=PIECE_NAMES)

    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInPandas(run, PIECES)


PIECE_NAMES = ["conv_id", "turn_no", "start", "formatted", "loss_starts", "loss_ends"]


def digests(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations (of TEMPLATE, in the order they were made) back into digests.

    Roles and texts come from parsing the output, losses from its loss spans.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for conv, rows in _conversations(frames):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = total = 0
            for _, _, _, text, starts, ends in rows:
                total += len(text)
                at = 0
                while m := _TURN.match(text, at):
                    n += 1
                    at = m.end()
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if at != len(text):
                    raise ValueError(f"conversation {conv} cannot be read back at {at}")
                for a, b in zip(starts, ends):
                    learnt = unescape(text[a:b])
                    chars += len(learnt)
                    loss.update(learnt.encode())
            out.append((None if conv is None else int(conv), n, turns.hexdigest(), chars, loss.hexdigest(), total))
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
