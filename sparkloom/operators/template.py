"""A small template engine for models' own chat templates: the part of the Jinja language that they use.

Blocks for, if and set, expressions with filters and tests; ``trim_blocks`` and ``lstrip_blocks`` are on.
Values can be read but not changed, and only the methods in ``METHODS`` can be called.  What isn't known
raises ``TemplateError`` when the template is compiled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

METHODS = {
    str: {"strip", "lstrip", "rstrip", "split", "startswith", "endswith", "upper", "lower", "title", "capitalize", "replace", "join"},
    dict: {"items", "keys", "values", "get"},
}


class TemplateError(ValueError):
    """The template can't be compiled, or raised an error itself."""


class Undefined:
    """The value of a name that isn't there: false, empty, and printed as nothing."""

    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""

    def __iter__(self):
        return iter(())

    def __len__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Undefined)

    __hash__ = object.__hash__


NOTHING = Undefined()


class Namespace(dict):
    """What ``namespace()`` gives: the one value whose fields a template may set."""


def _json(value, **_) -> str:
    return json.dumps(value, ensure_ascii=False)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: str(v).strip(),
    "length": len,
    "count": len,
    "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(),
    "title": lambda v: str(v).title(),
    "capitalize": lambda v: str(v).capitalize(),
    "join": lambda v, glue="": str(glue).join(map(_text, v)),
    "default": lambda v, other="", falsy=False: other if isinstance(v, Undefined) or (falsy and not v) else v,
    "first": lambda v: next(iter(v), NOTHING),
    "last": lambda v: list(v)[-1] if len(list(v)) else NOTHING,
    "replace": lambda v, old, new: str(v).replace(old, new),
    "list": list,
    "items": lambda v: list(v.items()),
    "reverse": lambda v: v[::-1],
    "string": lambda v: _text(v),
    "int": lambda v, other=0: int(v) if str(v).lstrip("-").isdigit() else other,
    "abs": abs,
    "safe": lambda v: v,
    "tojson": _json,
}
TESTS: dict[str, Callable] = {
    "defined": lambda v: not isinstance(v, Undefined),
    "undefined": lambda v: isinstance(v, Undefined),
    "none": lambda v: v is None,
    "string": lambda v: isinstance(v, str),
    "mapping": lambda v: isinstance(v, dict),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "iterable": lambda v: isinstance(v, (str, list, tuple, dict)),
    "sequence": lambda v: isinstance(v, (str, list, tuple, dict)),
    "true": lambda v: v is True,
    "false": lambda v: v is False,
    "odd": lambda v: v % 2 == 1,
    "even": lambda v: v % 2 == 0,
    "equalto": lambda v, other: v == other,
    "eq": lambda v, other: v == other,
    "in": lambda v, others: v in others,
}
FILTERS["d"] = FILTERS["default"]


def _text(value) -> str:
    return "" if isinstance(value, Undefined) else "None" if value is None else str(value)


_PIECE = re.compile(r"(\{%-?|\{\{-?|\{#-?)(.*?)(-?%\}|-?\}\}|-?#\})", re.S)
_LEX = re.compile(r"""\s*(?:(?P<number>\d+\.\d+|\d+)|(?P<name>[A-Za-z_]\w*)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<op>//|\*\*|==|!=|<=|>=|[-+*/%~<>=()\[\]{},.:|]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
Value = Callable[["Scope"], object]
Action = Callable[["Scope", list], None]


class Scope:
    """Names, innermost block first."""

    def __init__(self, values: dict) -> None:
        self.levels = [values]

    def get(self, name: str):
        for level in reversed(self.levels):
            if name in level:
                return level[name]
        return NOTHING


def _read(value, key):
    """A field or an item; nothing where there is none."""
    if isinstance(key, str) and not isinstance(value, dict):
        for kind, names in METHODS.items():
            if isinstance(value, kind) and key in names:
                return getattr(value, key)
        return NOTHING
    if isinstance(value, dict) and key not in value:
        return getattr(value, key) if key in METHODS[dict] else NOTHING
    try:
        return value[key]
    except (KeyError, IndexError, TypeError):
        return NOTHING


class _Parser:
    """Expressions, by descent along their precedence."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _LEX.match(source, at)
            if m is None:
                raise TemplateError(f"unexpected text in a template: {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> bool:
        found = self.peek(*wanted)
        self.at += found
        return found

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"a template lacks {wanted!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a template lacks a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in a template")

    def expression(self) -> Value:
        value = self.any_of()
        while self.take("if"):
            condition = self.any_of()
            other = self.expression() if self.take("else") else (lambda s: NOTHING)
            value = (lambda v, c, o: lambda s: v(s) if c(s) else o(s))(value, condition, other)
        return value

    def any_of(self) -> Value:
        value = self.all_of()
        while self.take("or"):
            value = (lambda a, b: lambda s: a(s) or b(s))(value, self.all_of())
        return value

    def all_of(self) -> Value:
        value = self.negated()
        while self.take("and"):
            value = (lambda a, b: lambda s: a(s) and b(s))(value, self.negated())
        return value

    def negated(self) -> Value:
        if self.take("not"):
            inner = self.negated()
            return lambda s: not inner(s)
        return self.compared()

    def compared(self) -> Value:
        compare = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
        value = self.chain(("+", "-"))
        while True:
            sign = next((x for x in compare if self.take(x)), None)
            if sign:
                value = (lambda f, a, b: lambda s: f(a(s), b(s)))(compare[sign], value, self.chain(("+", "-")))
            elif self.take("in"):
                value = (lambda a, b: lambda s: a(s) in b(s))(value, self.chain(("+", "-")))
            elif self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                value = (lambda a, b: lambda s: a(s) not in b(s))(value, self.chain(("+", "-")))
            elif self.take("is"):
                value = self.tested(value)
            else:
                return value

    def tested(self, value: Value) -> Value:
        wrong = self.take("not")
        name = self.name()
        if name not in TESTS:
            raise TemplateError(f"unknown test in a template: {name}")
        more: list[Value] = []
        if name in ("equalto", "eq", "in"):
            if self.take("("):
                more = [self.expression()]
                self.need(")")
            else:
                more = [self.postfix()]
        test = TESTS[name]
        return lambda s: bool(test(value(s), *[m(s) for m in more])) != wrong

    def chain(self, signs: tuple[str, ...]) -> Value:
        lower = {("+", "-"): ("~",), ("~",): ("*", "/", "//", "%")}.get(signs)
        inner = (lambda: self.chain(lower)) if lower else self.signed
        apply = {
            "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: _text(a) + _text(b), "*": lambda a, b: a * b,
            "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": lambda a, b: a % b,
        }
        value = inner()
        while True:
            sign = next((x for x in signs if self.take(x)), None)
            if sign is None:
                return value
            value = (lambda f, a, b: lambda s: f(a(s), b(s)))(apply[sign], value, inner())

    def signed(self) -> Value:
        if self.take("-"):
            inner = self.signed()
            return lambda s: -inner(s)
        return self.postfix()

    def arguments(self) -> tuple[list[Value], dict[str, Value]]:
        plain, named = [], {}
        while not self.take(")"):
            if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("op", "="):
                name = self.name()
                self.need("=")
                named[name] = self.expression()
            else:
                plain.append(self.expression())
            if not self.take(",") and not self.peek(")"):
                raise TemplateError("a template lacks ')'")
        return plain, named

    def postfix(self) -> Value:
        value = self.primary()
        while True:
            if self.take("."):
                value = (lambda v, k: lambda s: _read(v(s), k))(value, self.name())
            elif self.take("["):
                value = self.item(value)
            elif self.take("("):
                plain, named = self.arguments()

                def call(s, f=value, plain=plain, named=named):
                    made = f(s)
                    if not callable(made):
                        raise TemplateError("a template calls something that isn't a function")
                    return made(*[p(s) for p in plain], **{k: n(s) for k, n in named.items()})

                value = call
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter in a template: {name}")
                plain, named = self.arguments() if self.take("(") else ([], {})
                value = (lambda f, v, p, n: lambda s: f(v(s), *[x(s) for x in p], **{k: x(s) for k, x in n.items()}))(FILTERS[name], value, plain, named)
            else:
                return value

    def item(self, value: Value) -> Value:
        parts: list[Value | None] = [None]
        while not self.take("]"):
            if self.take(":"):
                parts.append(None)
            else:
                parts[-1] = self.expression()
                if not self.peek(":", "]"):
                    raise TemplateError("a template lacks ']'")
        if len(parts) == 1:
            key = parts[0]
            return lambda s: _read(value(s), key(s))
        return lambda s: value(s)[slice(*[p(s) if p else None for p in parts])]

    def primary(self) -> Value:
        if self.at >= len(self.tokens):
            raise TemplateError("a template lacks a value")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            number = float(text) if "." in text else int(text)
            return lambda s: number
        if kind == "string":
            word = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m.group(1), m.group(1)), text[1:-1], flags=re.S)
            while self.at < len(self.tokens) and self.tokens[self.at][0] == "string":
                word += re.sub(r"\\(.)", lambda m: _ESCAPES.get(m.group(1), m.group(1)), self.tokens[self.at][1][1:-1], flags=re.S)
                self.at += 1
            return lambda s: word
        if kind == "name":
            known = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
            return (lambda s: known[text]) if text in known else (lambda s: s.get(text))
        if text == "(":
            values = [self.expression()]
            many = False
            while self.take(","):
                many = True
                if not self.peek(")"):
                    values.append(self.expression())
            self.need(")")
            return (lambda s: tuple(v(s) for v in values)) if many else values[0]
        if text == "[":
            values = []
            while not self.take("]"):
                values.append(self.expression())
                if not self.take(",") and not self.peek("]"):
                    raise TemplateError("a template lacks ']'")
            return lambda s: [v(s) for v in values]
        if text == "{":
            pairs = []
            while not self.take("}"):
                key = self.expression()
                self.need(":")
                pairs.append((key, self.expression()))
                if not self.take(",") and not self.peek("}"):
                    raise TemplateError("a template lacks '}'")
            return lambda s: {k(s): v(s) for k, v in pairs}
        raise TemplateError(f"unexpected {text!r} in a template")


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, text): "text", "block" and "print" pieces, white space around tags taken off."""
    out: list[tuple[str, str]] = []
    last, strip, newline = 0, False, False
    for m in _PIECE.finditer(source):
        text = source[last : m.start()]
        if strip:
            text = text.lstrip()
        elif newline and text.startswith("\n"):
            text = text[1:]
        if m.group(1).endswith("-"):
            text = text.rstrip()
        elif m.group(1) != "{{":
            line = text.rfind("\n") + 1
            if not text[line:].strip() and (line or last == 0 or newline or strip):
                text = text[:line]
        out.append(("text", text))
        if not m.group(1).startswith("{#"):
            out.append(("print" if m.group(1).startswith("{{") else "block", m.group(2).strip()))
        strip, newline, last = m.group(3).startswith("-"), not m.group(3).endswith("}}"), m.end()
    text = source[last:]
    if any(x in text for x in ("{{", "{%", "{#")):
        raise TemplateError("a template doesn't close one of its tags")
    out.append(("text", text.lstrip() if strip else text[1:] if newline and text.startswith("\n") else text))
    return [(k, t) for k, t in out if t or k != "text"]


class Template:
    """A compiled template."""

    def __init__(self, source: str) -> None:
        self.pieces = _pieces(source[:-1] if source.endswith("\n") else source)
        self.at = 0
        self.body = self._body(())
        if self.at < len(self.pieces):
            raise TemplateError(f"unexpected block in a template: {self.pieces[self.at][1]!r}")

    def _body(self, ends: tuple[str, ...]) -> list[Action]:
        """Actions up to a block of one of the given names, which stays."""
        actions: list[Action] = []
        while self.at < len(self.pieces):
            kind, text = self.pieces[self.at]
            if kind == "text":
                actions.append((lambda t: lambda s, out: out.append(t))(text))
            elif kind == "print":
                actions.append((lambda v: lambda s, out: out.append(_text(v(s))))(self._value(text)))
            else:
                name = text.split(None, 1)[0] if text else ""
                if name in ends:
                    return actions
                self.at += 1
                rest = text[len(name) :]
                if name == "for":
                    actions.append(self._for(rest))
                elif name == "if":
                    actions.append(self._if(rest))
                elif name == "set":
                    actions.append(self._set(rest))
                elif name not in ("generation", "endgeneration"):
                    raise TemplateError(f"unknown block in a template: {name!r}")
                continue
            self.at += 1
        if ends:
            raise TemplateError(f"a template lacks {ends[-1]!r}")
        return actions

    @staticmethod
    def _value(text: str) -> Value:
        parser = _Parser(text)
        value = parser.expression()
        parser.end()
        return value

    def _if(self, rest: str) -> Action:
        branches: list[tuple[Value, list[Action]]] = []
        condition: Value = self._value(rest)
        while True:
            body = self._body(("elif", "else", "endif"))
            branches.append((condition, body))
            text = self.pieces[self.at][1]
            self.at += 1
            if text == "endif":
                break
            condition = self._value(text[4:]) if text.startswith("elif") else (lambda s: True)

        def run(s: Scope, out: list) -> None:
            for test, body in branches:
                if test(s):
                    for action in body:
                        action(s, out)
                    return

        return run

    def _for(self, rest: str) -> Action:
        parser = _Parser(rest)
        names = [parser.name()]
        while parser.take(","):
            names.append(parser.name())
        parser.need("in")
        values = parser.any_of()
        keep = parser.expression() if parser.take("if") else None
        parser.end()
        body = self._body(("else", "endfor"))
        other: list[Action] = []
        if self.pieces[self.at][1] == "else":
            self.at += 1
            other = self._body(("endfor",))
        self.at += 1

        def bind(item) -> dict:
            return {names[0]: item} if len(names) == 1 else dict(zip(names, item, strict=True))

        def run(s: Scope, out: list) -> None:
            items = list(values(s))
            if keep is not None:
                kept = []
                for item in items:
                    s.levels.append(bind(item))
                    if keep(s):
                        kept.append(item)
                    s.levels.pop()
                items = kept
            for i, item in enumerate(items):
                loop = {
                    "index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items), "revindex": len(items) - i,
                    "revindex0": len(items) - i - 1, "previtem": items[i - 1] if i else NOTHING, "nextitem": items[i + 1] if i + 1 < len(items) else NOTHING,
                }
                s.levels.append(bind(item) | {"loop": loop})
                for action in body:
                    action(s, out)
                s.levels.pop()
            if not items:
                for action in other:
                    action(s, out)

        return run

    def _set(self, rest: str) -> Action:
        parser = _Parser(rest)
        name, field = parser.name(), None
        if parser.take("."):
            field = parser.name()
        parser.need("=")
        value = parser.expression()
        parser.end()

        def run(s: Scope, out: list) -> None:
            if field is None:
                s.levels[-1][name] = value(s)
                return
            space = s.get(name)
            if not isinstance(space, Namespace):
                raise TemplateError("a template may set fields of a namespace alone")
            space[field] = value(s)

        return run

    def render(self, **values) -> str:
        """The template's text for the given names."""

        def fail(message: str):
            raise TemplateError(str(message))

        known = {"raise_exception": fail, "namespace": lambda **fields: Namespace(fields), "range": lambda *n: list(range(*n)), "dict": lambda **fields: fields}
        scope, out = Scope(known | values), []
        for action in self.body:
            action(scope, out)
        return "".join(out)
