r"""Chat formatting with compiled templates.

A template is text with ``{{ expression }}`` and the blocks ``{% for x in xs %}``, ``{% if c %}``,
``{% elif c %}``, ``{% else %}``, ``{% set x = e %}`` and ``{% generation %}``, each closed by its ``end...``.
Expressions know literals, names, ``a.b``, ``a['b']``, ``+``, comparisons, ``and or not``, ``a if c else b``
and named filters. There is no call, no attribute of Python objects and no loop but ``for``, so a template can
reach nothing but the values it is given. It is parsed to a syntax tree, constant parts are folded, and the
tree becomes Python closures that append (piece, in_generation) to a list.

Texts are escaped before they meet the markers: a backslash is doubled, and one is put before every ``#`` that follows
another and inside every end mark, so no control string survives in a text, however many ``#`` stand in a row, and
:func:`unescape` gives the text back exactly.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings; none of them stands inside an escaped text.
END = "</turn>"
CONTROLS = ("###", END)
_BREAK = re.compile(rf"#(?=#)|{END[0]}(?={END[1:]})")
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | title | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)


def escape(text: str) -> str:
    return _BREAK.sub(r"\g<0>\\", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:").replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def title(role: str) -> str:
    """Upper-case the first letter of a plain lower-case role; others get a mark that :func:`untitle` undoes."""
    return role[0].upper() + role[1:] if re.fullmatch("[a-z]+", role) else f"={role}"


def untitle(role: str) -> str:
    return role[1:] if role.startswith("=") else role[0].lower() + role[1:]


FILTERS: dict[str, Callable] = {"escape": escape, "escape_role": escape_role, "title": title, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}
_OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "+": operator.add}


class TemplateError(ValueError):
    pass


# Parsing: tuples (kind, ...) are the nodes of the tree.


class _Expression:
    _token = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>+.|\[\]()]))")

    def __init__(self, text: str):
        self.items, at = [], 0
        text = text.strip()
        while at < len(text):
            m = self._token.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "str" and self.items[self.at][1] in words

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.items):
            raise TemplateError("an expression ends early")
        self.at += 1
        return self.items[self.at - 1]

    def need(self, word: str) -> None:
        if self.take()[1] != word:
            raise TemplateError(f"expected {word!r}")

    def whole(self) -> tuple:
        node = self.choice()
        if self.at != len(self.items):
            raise TemplateError(f"left over: {self.items[self.at:]}")
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.peek("if"):
            self.take()
            test = self.either()
            self.need("else")
            return ("choose", test, node, self.choice())
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        node = self.sum()
        if self.peek("==", "!=", "<", "<=", ">", ">="):
            return ("op", self.take()[1], node, self.sum())
        return node

    def sum(self) -> tuple:
        node = self.filtered()
        while self.peek("+"):
            self.take()
            node = ("op", "+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.value()
        while self.peek("|", ".", "["):
            mark = self.take()[1]
            if mark == "[":
                node = ("get", node, self.choice())
                self.need("]")
                continue
            kind, name = self.take()
            if kind != "name":
                raise TemplateError(f"expected a name after {mark!r}")
            if mark == "|" and name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = ("filter", name, node) if mark == "|" else ("get", node, ("const", name))
        return node

    def value(self) -> tuple:
        kind, word = self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "num":
            return ("const", int(word))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[word.lower()]) if word.lower() in ("true", "false", "none") else ("name", word)
        if word == "(":
            node = self.choice()
            self.need(")")
            return node
        raise TemplateError(f"unexpected {word!r}")


def parse(template: str) -> list[tuple]:
    """The syntax tree of a template."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    top: list[tuple] = []
    stack: list[tuple[str, list, tuple]] = [("", top, ())]
    for part in parts:
        body = stack[-1][1]
        if part.startswith("{{"):
            body.append(("out", _Expression(part[2:-2]).whole()))
            continue
        if not part.startswith("{%"):
            if part:
                body.append(("out", ("const", part)))
            continue
        word, _, rest = part[2:-2].strip().partition(" ")
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"cannot read {part!r}")
            node = ("for", m[1], _Expression(m[2]).whole(), [])
            body.append(node)
            stack.append(("for", node[3], node))
        elif word == "if":
            node = ("if", [(_Expression(rest).whole(), [])])
            body.append(node)
            stack.append(("if", node[1][-1][1], node))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            node = stack.pop()[2]
            node[1].append((_Expression(rest).whole() if word == "elif" else ("const", True), []))
            stack.append(("if", node[1][-1][1], node))
        elif word == "set":
            name, _, value = rest.partition("=")
            if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"cannot read {part!r}")
            body.append(("set", name.strip(), _Expression(value).whole()))
        elif word == "generation":
            node = ("generation", [])
            body.append(node)
            stack.append(("generation", node[1], node))
        elif word == f"end{stack[-1][0]}" and stack[-1][0]:
            stack.pop()
        else:
            raise TemplateError(f"unexpected {part!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is not closed")
    return top


def fold(node: tuple) -> tuple:
    """An expression with its constant parts worked out."""
    if node[0] in ("const", "name"):
        return node
    new = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    if new[0] in ("and", "or", "choose") and new[1][0] == "const":
        if new[0] == "choose":
            return new[2] if new[1][1] else new[3]
        return new[2] if bool(new[1][1]) == (new[0] == "and") else new[1]
    if all(x[0] == "const" for x in new if isinstance(x, tuple)):
        return ("const", _value(new)({}))
    return new


def fold_body(body: list[tuple]) -> list[tuple]:
    """A body with folded expressions, decided branches taken and neighbouring constant text joined."""
    out: list[tuple] = []

    def put(node: tuple) -> None:
        if node[0] == "out" and node[1][0] == "const" and out and out[-1][0] == "out" and out[-1][1][0] == "const":
            out[-1] = ("out", ("const", _text(out[-1][1][1]) + _text(node[1][1])))
        else:
            out.append(node)

    for node in body:
        kind = node[0]
        if kind == "out":
            put(("out", fold(node[1])))
        elif kind == "set":
            put(("set", node[1], fold(node[2])))
        elif kind == "for":
            put(("for", node[1], fold(node[2]), fold_body(node[3])))
        elif kind == "generation":
            put(("generation", fold_body(node[1])))
        else:
            arms = []
            for test, inner in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_body(inner)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    put(x)
            elif arms:
                put(("if", arms))
    return out


# Closures: an expression is values -> value, a body is (values, pieces, in_generation) -> None.


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda _, v=node[1]: v
    if kind == "name":
        return lambda values, n=node[1]: values.get(n)
    if kind == "not":
        a = _value(node[1])
        return lambda values: not a(values)
    if kind == "filter":
        f, a = FILTERS[node[1]], _value(node[2])
        return lambda values: f(_text(a(values)))
    if kind == "op":
        f, a, b = _OPS[node[1]], _value(node[2]), _value(node[3])
        return lambda values: f(a(values), b(values))
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda values: a(values) and b(values)
    if kind == "or":
        return lambda values: a(values) or b(values)
    if kind == "choose":
        c = _value(node[3])
        return lambda values: b(values) if a(values) else c(values)

    def get(values: dict) -> object:
        box, key = a(values), b(values)
        if isinstance(box, dict):
            return box.get(key)
        return box[key] if isinstance(box, list) and isinstance(key, int) and -len(box) <= key < len(box) else None

    return get


def _body(nodes: list[tuple]) -> Callable[[dict, list, bool], None]:
    steps = [_step(n) for n in nodes]

    def run(values: dict, pieces: list, on: bool) -> None:
        for step in steps:
            step(values, pieces, on)

    return run


def _step(node: tuple) -> Callable[[dict, list, bool], None]:
    kind = node[0]
    if kind == "out":
        if node[1][0] == "const":
            return lambda values, pieces, on, t=_text(node[1][1]): pieces.append((t, on))
        v = _value(node[1])
        return lambda values, pieces, on: pieces.append((_text(v(values)), on))
    if kind == "set":
        v = _value(node[2])
        return lambda values, pieces, on, n=node[1]: values.__setitem__(n, v(values))
    if kind == "generation":
        inner = _body(node[1])
        return lambda values, pieces, on: inner(values, pieces, True)
    if kind == "if":
        arms = [(_value(t), _body(b)) for t, b in node[1]]

        def branch(values: dict, pieces: list, on: bool) -> None:
            for test, inner in arms:
                if test(values):
                    inner(values, pieces, on)
                    return

        return branch
    items, inner, name = _value(node[2]), _body(node[3]), node[1]

    def loop(values: dict, pieces: list, on: bool) -> None:
        rows = items(values)
        rows = rows if isinstance(rows, list) else []
        for i, item in enumerate(rows):
            inner({**values, name: item, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(rows) - 1, "length": len(rows)}}, pieces, on)

    return loop


def compile_template(template: str = TEMPLATE) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (dicts with role and text) to the formatted string and its loss spans [start, end)."""
    run = _body(fold_body(parse(template)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        pieces: list[tuple[str, bool]] = []
        run({"messages": messages}, pieces, False)
        spans, at = [], 0
        for text, on in pieces:
            if on:
                spans.append((at, at + len(text)))
            at += len(text)
        return "".join(t for t, _ in pieces), spans

    return render


_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a string made with :data:`TEMPLATE`."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = formatted.find(f"{END}\n", head.end()) if head else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((untitle(unescape(head[1])), unescape(formatted[head.end() : end])))
        at = end + len(END) + 1
    return turns


FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"
_FORMATTED = pa.schema({"conv_id": pa.int64(), "formatted": pa.string(), "loss_spans": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))})


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, loss_spans) for each conversation; spans count code points.

    Rows are dealt by conv_id and sorted by turn, then role and text, which settles ties; nulls come first
    and null roles and texts are empty. Rows with a null conv_id form one conversation, repeated rows repeat
    the turn, an empty table gives an empty result, other columns are ignored. A task streams over its sorted
    rows and holds one conversation at a time.
    """
    rows = (
        turns.select(F.col("conv_id").cast("long"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)

        def done(conv: int | None, messages: list[dict]) -> dict:
            text, spans = render(messages)
            return {"conv_id": conv, "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]}

        conv, messages = None, []
        for batch in batches:
            out = []
            for c, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if messages and c != conv:
                    out.append(done(conv, messages))
                    messages = []
                conv = c
                messages.append({"role": role, "text": text})
            if out:
                yield pa.RecordBatch.from_pylist(out, _FORMATTED)
        if messages:
            yield pa.RecordBatch.from_pylist([done(conv, messages)], _FORMATTED)

    return rows.mapInArrow(run, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and the text under the loss mask, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, row, strict=True)) for row in out], _DIGEST)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGEST = pa.schema({"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()})
