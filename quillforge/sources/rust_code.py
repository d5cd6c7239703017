"""Rust source as rows, by an own tokeniser and a walk over items, statements and expressions.

It reads what the measures need and no more: items, function headers, blocks, and in expressions
the keywords, calls, closures and patterns. Macro bodies are taken as plain tokens, so what a macro
would expand to is not seen. A file whose brackets do not match has parse_error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from quillforge.sources.python_code import count_lines

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*)|(?P<comment>/\*)|(?P<raw>b?c?r(?P<hash>\#*)")|(?P<str>[bc]?"(?:\\.|[^"\\])*")|(?P<char>b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\])')|(?P<life>'[A-Za-z_]\w*)"""
    r"""|(?P<id>r\#[A-Za-z_]\w*|[^\W\d]\w*)|(?P<num>\d[\w]*(?:\.\d[\w]*)?(?:[eE][+-]?\d+)?)|(?P<op>::|->|=>|\.\.=|\.\.\.|\.\.|&&|\|\||<<=|>>=|[-+*/%^&|=!<>]=|.)""",
    re.DOTALL | re.VERBOSE,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_ITEMS = {"fn", "struct", "enum", "union", "trait", "impl", "mod", "use", "type", "static", "macro_rules", "extern"}
_PREFIX = {"pub", "unsafe", "async", "const", "default", "extern"}
# Path roots that name no module of the tree, and the standard crates.
LOCAL_ROOTS = {"self", "super", "crate"}
STANDARD = {"std", "core", "alloc", "proc_macro", "test"}


class RustError(ValueError):
    pass


class Token:
    __slots__ = ("end", "kind", "line", "text")

    def __init__(self, text: str, kind: str, line: int):
        self.text, self.kind, self.line, self.end = text, kind, line, -1


def tokenize(source: str) -> list[Token]:
    """Tokens without comments; an opening bracket knows its closing one's index."""
    out: list[Token] = []
    stack: list[int] = []
    at, line = 0, 1
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, stop = m.lastgroup, m.end()
        if m["comment"]:
            depth, stop = 1, at + 2
            while depth:
                n = re.compile(r"/\*|\*/").search(source, stop)
                if n is None:
                    raise RustError("a comment is not closed")
                depth += 1 if n[0] == "/*" else -1
                stop = n.end()
        elif m["raw"]:
            close = source.find('"' + m["hash"], stop)
            if close < 0:
                raise RustError("a raw string is not closed")
            stop = close + 1 + len(m["hash"])
            out.append(Token(source[at:stop], "str", line))
        elif not m["space"]:
            kind = "str" if kind == "hash" else kind
            token = Token(m[0], kind, line)
            if kind == "op" and token.text in _OPEN:
                stack.append(len(out))
            elif kind == "op" and token.text in _CLOSE:
                if not stack or out[stack[-1]].text != _CLOSE[token.text]:
                    raise RustError(f"line {line}: brackets do not match")
                out[stack.pop()].end = len(out)
            out.append(token)
        line += source.count("\n", at, stop)
        at = stop
    if stack:
        raise RustError("a bracket is not closed")
    return out


def _skip_angles(t: list[Token], at: int, stop: int) -> int:
    """Past generic arguments that start at `<`."""
    depth = 0
    while at < stop:
        text = t[at].text
        depth += {"<": 1, ">": -1, "<<": 2, ">>": -2}.get(text, 0)
        at = t[at].end + 1 if t[at].end > 0 else at + 1
        if depth <= 0:
            return at
    return at


def _find(t: list[Token], at: int, stop: int, wanted: set[str]) -> int:
    """The next wanted token outside brackets, or stop."""
    while at < stop and t[at].text not in wanted:
        at = t[at].end + 1 if t[at].end > 0 else at + 1
    return at


class Item:
    def __init__(self, kind: str, name: str, line: int, attributes: list[list[str]], public: bool):
        self.kind, self.name, self.line, self.attributes, self.public = kind, name, line, attributes, public
        self.header: tuple[int, int] = (0, 0)
        self.body: tuple[int, int] | None = None
        self.end_line = line
        self.children: list[Item] = []
        self.trait: str | None = None


def _attribute_end(t: list[Token], at: int) -> int:
    at += 2 if t[at + 1].text == "!" else 1
    return t[at].end + 1


def items(t: list[Token], at: int, stop: int) -> Iterator[Item]:
    """Items of a module, an impl or a trait body."""
    while at < stop:
        attributes: list[list[str]] = []
        while at < stop and t[at].text == "#":
            end = _attribute_end(t, at)
            attributes.append([x.text for x in t[at:end]])
            at = end
        if at >= stop:
            return
        first, public = at, False
        while at < stop and t[at].text in _PREFIX and not (t[at].text == "const" and at + 1 < stop and t[at + 1].kind == "id" and t[at + 1].text not in _PREFIX | {"fn"}):
            public |= t[at].text == "pub"
            at += 1
            if at < stop and (t[at].text == "(" or t[at].kind == "str"):
                at = t[at].end + 1 if t[at].text == "(" else at + 1
        if at >= stop:
            return
        word = t[at].text
        if word in ("fn", "struct", "enum", "union", "trait", "mod", "macro_rules") and at + 1 < stop:
            name_at = at + (2 if word == "macro_rules" else 1)
            item = Item(word, t[name_at].text, t[first].line, attributes, public)
        elif word == "impl":
            name_at, item = at, Item(word, "", t[first].line, attributes, public)
        else:
            end = _find(t, at, stop, {";"} if word != "{" else set())
            if word == "{":  # an extern block
                end = t[at].end
            item = Item("use" if word == "use" else "other", "", t[first].line, attributes, public)
            item.header = (at + 1, end)
            item.end_line = t[min(end, stop - 1)].line
            yield item
            at = end + 1
            continue
        brace = _find(t, name_at + 1 if word != "impl" else at + 1, stop, {"{", ";"})
        item.header = (name_at + (word != "impl"), brace)
        if brace < stop and t[brace].text == "{":
            item.body = (brace + 1, t[brace].end)
            at = t[brace].end + 1
        else:
            at = brace + 1
        item.end_line = t[min(at, stop) - 1].line
        if word == "impl":
            item.name, item.trait = _impl_names(t, *item.header)
        if item.body and word in ("impl", "trait", "mod"):
            item.children = list(items(t, *item.body))
        yield item


def _last_segment(t: list[Token], at: int, stop: int) -> str:
    """The last name of a path, outside its generic arguments."""
    name = ""
    while at < stop:
        if t[at].text == "<":
            at = _skip_angles(t, at, stop)
            continue
        if t[at].kind == "id" and t[at].text not in ("dyn", "mut", "for", "where"):
            name = t[at].text
        at += 1
    return name


def _impl_names(t: list[Token], at: int, stop: int) -> tuple[str, str | None]:
    at += 1 if t[at].text == "impl" else 0
    if at < stop and t[at].text == "<":
        at = _skip_angles(t, at, stop)
    stop = _find(t, at, stop, {"where"})
    middle = next((k for k in range(at, stop) if t[k].text == "for"), None)
    if middle is None:
        return _last_segment(t, at, stop), None
    return _last_segment(t, middle + 1, stop), _last_segment(t, at, middle)


def is_test_only(attributes: list[list[str]]) -> bool:
    """`cfg(... test ...)` under an even number of `not`."""
    for words in attributes:
        if "cfg" not in words:
            continue
        depths: list[bool] = []
        negated = False
        for k, w in enumerate(words):
            if w == "(":
                depths.append(words[k - 1] == "not")
                negated ^= depths[-1]
            elif w == ")" and depths:
                negated ^= depths.pop()
            elif w == "test" and not negated and words[k - 1] != "=":
                return True
    return False


def is_test(attributes: list[list[str]]) -> bool:
    return any(words[2:-1][-1:] == ["test"] or words[2:3] == ["test"] for words in attributes)


def use_leaves(t: list[Token], at: int, stop: int) -> int:
    """Names that a `use` brings in; a glob is one."""
    leaves, k = 0, at
    while k < stop:
        if t[k].text == "{":
            inner, start = t[k].end, k + 1
            while start < inner:
                end = _find(t, start, inner, {","})
                leaves += use_leaves(t, start, end)
                start = end + 1
            return leaves
        k += 1
    return int(stop > at)


class _Walk:
    """Counts of one function body."""

    def __init__(self, t: list[Token]):
        self.t = t
        self.statements = self.branches = self.returns = self.calls = self.locals = self.depth = self.closures = 0

    def block(self, at: int, stop: int, depth: int, closures: int) -> None:
        t = self.t
        while at < stop:
            while at < stop and t[at].text == "#":
                at = _attribute_end(t, at)
            if at >= stop:
                return
            if t[at].text == ";":
                at += 1
                continue
            k = at
            while k < stop and t[k].text in _PREFIX:
                k += 1
                if k < stop and t[k].kind == "str":
                    k += 1
            word = t[k].text if k < stop else ""
            if word == "use":
                at = _find(t, k, stop, {";"}) + 1
                continue
            if word in _ITEMS and not (word == "union" and t[k + 1].kind != "id") and (word != "macro_rules" or t[k + 1].text == "!"):
                self.statements += 1
                end = _find(t, k, stop, {"{", ";"})
                at = (t[end].end if end < stop and t[end].text == "{" else end) + 1
                continue
            self.statements += 1
            if t[at].text == "let":
                equals = _find(t, at, stop, {"=", ";"})
                self.pattern(at + 1, _find(t, at + 1, equals, {":"}))
                end = _find(t, equals, stop, {";"})
                self.expression(equals, end, depth, closures)
                at = end + 1
                continue
            end = self._statement_end(at, stop)
            self.expression(at, end, depth, closures)
            at = end + (end < stop and t[end].text == ";")

    def _statement_end(self, at: int, stop: int) -> int:
        """A block expression ends with its last block unless something is applied to it."""
        t = self.t
        start = at + 2 if t[at].kind == "life" and at + 1 < stop and t[at + 1].text == ":" else at
        if start < stop and t[start].text in ("if", "match", "while", "for", "loop", "unsafe", "{"):
            end = _find(t, start, stop, {"{"})
            end = t[end].end + 1 if end < stop else stop
            while end < stop and t[end].text == "else":
                brace = _find(t, end, stop, {"{"})
                end = t[brace].end + 1 if brace < stop else stop
            if end >= stop or t[end].text not in (".", "?"):
                return end
        return _find(t, at, stop, {";"})

    def pattern(self, at: int, stop: int) -> None:
        """Names bound by a pattern: lower-case identifiers that are no path, call or field name."""
        t = self.t
        for k in range(at, stop):
            x = t[k]
            if x.kind == "id" and x.text not in ("mut", "ref", "_", "box") and not x.text[0].isupper() and (k + 1 >= len(t) or t[k + 1].text not in ("::", "(", "{", ":", "!")) and (k == at or t[k - 1].text != "::"):
                self.locals += 1

    def expression(self, at: int, stop: int, depth: int, closures: int) -> None:
        t = self.t
        kind = ""  # the keyword that owns the next brace
        own = 0
        while at < stop:
            x = t[at]
            if x.text in ("if", "match", "while", "for", "loop") and x.kind == "id" and not (x.text == "for" and at + 1 < stop and t[at + 1].text == "<"):
                self.branches += x.text == "if"
                kind, own = x.text, depth + 1
                self.depth = max(self.depth, own)
            elif x.text == "else":
                kind, own = "else", depth + 1
                if at + 1 < stop and t[at + 1].text == "if":  # the rest of the chain lies inside this one
                    self.branches += 1
                    depth += 1
                    kind, own = "if", depth + 1
                    self.depth = max(self.depth, own)
                    at += 1
            elif x.text in ("unsafe", "async", "=>") or (x.text == "move" and at + 1 < stop and t[at + 1].text == "{"):
                kind, own = "block", depth
            elif x.text == "return":
                self.returns += 1
            elif x.text in ("|", "||") and (at == 0 or t[at - 1].text in ("(", ",", "=", "=>", "{", "move", "return", ";", "||", "&&", ":", "[")):
                close = at
                if x.text == "|":
                    close = _find(t, at + 1, stop, {"|"})
                self.closures = max(self.closures, closures + 1)
                end = _find(t, close + 1, stop, {",", ";"})
                body = close + 1
                if body < stop and t[body].text == "->":
                    body = _find(t, body, stop, {"{"})
                if body < stop and t[body].text == "{":
                    self.block(body + 1, t[body].end, depth, closures + 1)
                    at = t[body].end + 1
                else:
                    self.expression(body, end, depth, closures + 1)
                    at = end
                continue
            elif x.text == "(" and at > 0:
                before = t[at - 1]
                callee = (before.kind == "id" and before.text not in ("if", "match", "while", "in", "return", "let", "as", "mut", "for", "loop", "else", "move", "unsafe", "break")) or before.text in (")", "]") or (before.text == ">" and self._turbofish(at - 1))
                self.calls += callee and not (before.kind == "id" and at > 1 and t[at - 2].text == "fn")
                self.expression(at + 1, x.end, depth, closures)
                at = x.end + 1
                continue
            elif x.text == "[":
                self.expression(at + 1, x.end, depth, closures)
                at = x.end + 1
                continue
            elif x.text == "!" and at > 0 and t[at - 1].kind == "id" and at + 1 < stop and t[at + 1].text in _OPEN:
                at = t[at + 1].end + 1  # a macro
                continue
            elif x.text == "{":
                if kind == "match":
                    self.arms(at + 1, x.end, own, closures)
                elif kind or at == 0 or t[at - 1].text in (";", "{", "}", "=", "(", ","):
                    self.block(at + 1, x.end, own if kind in ("if", "while", "for", "loop", "else") else depth, closures)
                else:
                    self.expression(at + 1, x.end, depth, closures)
                kind = ""
                at = x.end + 1
                continue
            at += 1

    def _turbofish(self, at: int) -> bool:
        depth = 0
        while at >= 0:
            depth += {">": 1, ">>": 2, "<": -1}.get(self.t[at].text, 0)
            if depth <= 0:
                return at > 0 and self.t[at - 1].text == "::"
            at -= 1
        return False

    def arms(self, at: int, stop: int, depth: int, closures: int) -> None:
        t = self.t
        while at < stop:
            arrow = _find(t, at, stop, {"=>"})
            guard = _find(t, at, arrow, {"if"})
            if guard < arrow:
                self.expression(guard + 1, arrow, depth, closures)
            body = arrow + 1
            if body < stop and t[body].text == "{":
                self.block(body + 1, t[body].end, depth, closures)
                at = t[body].end + 1
                at += at < stop and t[at].text == ","
            else:
                end = _find(t, body, stop, {","})
                self.expression(body, end, depth, closures)
                at = end + 1


def _arguments(t: list[Token], item: Item) -> tuple[int, int]:
    """(arguments without the receiver, those of type bool)."""
    at, stop = item.header
    if at < stop and t[at].text == "<":
        at = _skip_angles(t, at, stop)
    if at >= stop or t[at].text != "(":
        return 0, 0
    total = flags = 0
    start, end = at + 1, t[at].end
    while start < end:
        depth, comma = 0, start
        while comma < end and (t[comma].text != "," or depth > 0):
            depth += {"<": 1, ">": -1, ">>": -2}.get(t[comma].text, 0)
            comma = t[comma].end + 1 if t[comma].end > 0 else comma + 1
        words = [x.text for x in t[start:comma]]
        if words and not (words[-1] == "self" or ("self" in words[:4] and ":" not in words[: words.index("self")] and words[0] in ("self", "&", "mut"))):
            total += 1
            flags += words[-2:] == [":", "bool"]
        start = comma + 1
    return total, flags


def function_measures(t: list[Token], item: Item) -> dict[str, int]:
    walk = _Walk(t)
    if item.body:
        walk.block(*item.body, 0, 0)
    arguments, flags = _arguments(t, item)
    return {
        "statements_per_function": walk.statements,
        "arguments_per_function": arguments,
        "max_indentation_depth": walk.depth,
        "nested_function_depth": walk.closures,
        "returns_per_function": walk.returns,
        "branches_per_function": walk.branches,
        "local_variables_per_function": walk.locals,
        "boolean_parameters": flags,
        "annotations_per_function": sum(words[2:3] != ["doc"] for words in item.attributes),
        "calls_per_function": walk.calls,
    }


def read(source: str) -> tuple[list[Token], list[Item]] | None:
    try:
        t = tokenize(source)
        return t, list(items(t, 0, len(t)))
    except (RustError, IndexError, ValueError, RecursionError):
        return None


def units(path: str, source: str) -> Iterator[dict]:
    found = read(source)
    lines = count_lines(source)
    stem = path.rsplit("/", 1)[-1].removesuffix(".rs")
    module = {"kind": "module", "name": stem, "owner": None, "line": 1, "end_line": max(1, lines), "inside_class": False, "lines_per_file": lines}
    if found is None:
        yield module | {"parse_error": True}
        return
    t, top = found
    total = {"interface_types_per_file": 0, "concrete_types_per_file": 0, "functions_per_file": 0, "imported_names_per_file": 0, "statements_per_file": 0}
    rows: list[dict] = []

    def visit(members: list[Item]) -> None:
        for item in members:
            row = {"name": item.name, "owner": None, "line": item.line, "end_line": item.end_line, "inside_class": False}
            if item.kind == "trait":
                total["interface_types_per_file"] += 1
            elif item.kind in ("struct", "enum", "union"):
                total["concrete_types_per_file"] += 1
                if item.kind != "union":
                    rows.append(row | {"kind": "class"})
            elif item.kind == "use" and not item.public:
                total["imported_names_per_file"] += use_leaves(t, *item.header)
            elif item.kind == "fn":
                measures = function_measures(t, item)
                total["functions_per_file"] += 1
                total["statements_per_file"] += measures["statements_per_function"]
                rows.append(row | {"kind": "function"} | measures)
            elif item.kind == "impl":
                methods = [m for m in item.children if m.kind == "fn"]
                rows.append(row | {"kind": "impl", "methods_per_class": len(methods)})
                for m in methods:
                    measures = function_measures(t, m)
                    total["functions_per_file"] += 1
                    total["statements_per_file"] += measures["statements_per_function"]
                    kind = "trait_impl_method" if item.trait else "method"
                    rows.append({"kind": kind, "name": m.name, "owner": item.name, "line": m.line, "end_line": m.end_line, "inside_class": True} | measures)
            elif item.kind == "mod" and item.body and not is_test_only(item.attributes):
                rows.append(row | {"kind": "module"})
                visit(item.children)

    visit(top)
    if stem in ("lib", "mod"):
        del total["imported_names_per_file"]
    yield module | total
    yield from rows


def imports(source: str) -> list[tuple[str, str]]:
    """(name, kind): first parts of `use` paths, declared child modules, included files."""
    found = read(source)
    out: dict[tuple[str, str], None] = {}

    def roots(t: list[Token], at: int, stop: int) -> Iterator[str]:
        while at < stop and (t[at].text in LOCAL_ROOTS or t[at].text == "::"):
            at += 1
        if at < stop and t[at].text == "{":
            start, end = at + 1, t[at].end
            while start < end:
                comma = _find(t, start, end, {","})
                yield from roots(t, start, comma)
                start = comma + 1
        elif at < stop and t[at].kind == "id":
            yield t[at].text

    def visit(t: list[Token], members: list[Item]) -> None:
        for item in members:
            if item.kind == "use":
                out.update(((name, "use"), None) for name in roots(t, *item.header))
            elif item.kind == "mod":
                if item.body is None:
                    out[item.name, "mod"] = None
                visit(t, item.children)

    if found:
        visit(*found)
        t = found[0]
        for k in range(len(t) - 3):
            if t[k].text == "include" and t[k + 1].text == "!" and t[k + 3].kind == "str" and t[k + 3].text.endswith('.rs"'):
                out[t[k + 3].text.strip('"').rsplit("/", 1)[-1].removesuffix(".rs"), "mod"] = None
    return list(out)


def _functions(members: list[Item], owner: str | None = None, tests: bool = True) -> Iterator[tuple[Item, str | None, Item | None]]:
    for item in members:
        if item.kind == "fn":
            yield item, owner, None
        elif item.kind == "impl":
            yield from ((m, item.name, item) for m in item.children if m.kind == "fn" and (tests or not is_test_only(item.attributes)))
        elif item.kind == "mod" and (tests or not is_test_only(item.attributes)):
            yield from _functions(item.children, owner, tests)


def chunks(source: str) -> Iterator[dict]:
    """Functions, methods and inline modules, whole lines, those of test modules too."""
    found = read(source)
    lines = source.splitlines(keepends=True)

    def text(item: Item) -> dict:
        return {"name": item.name, "start_line": item.line, "end_line": item.end_line, "text": "".join(lines[item.line - 1 : item.end_line])}

    def modules(members: list[Item]) -> Iterator[Item]:
        for item in members:
            if item.kind == "mod" and item.body:
                yield item
                yield from modules(item.children)

    if found:
        for item, _, _ in _functions(found[1]):
            yield text(item)
        yield from map(text, modules(found[1]))


def definitions(source: str) -> Iterator[dict]:
    """Functions, methods and types that tests could cover."""
    found = read(source)
    if not found:
        return

    def visit(members: list[Item]) -> Iterator[dict]:
        for item in members:
            if is_test_only(item.attributes):
                continue
            if item.kind in ("struct", "enum") and not item.name.startswith("_"):
                yield {"name": item.name, "kind": "class", "line": item.line, "owner": None}
            elif item.kind == "mod":
                yield from visit(item.children)

    yield from visit(found[1])
    for item, owner, block in _functions(found[1], tests=False):
        if not item.name.startswith("_") and not is_test(item.attributes) and not (block and is_test_only(block.attributes)):
            kind = "function" if owner is None else "trait_impl_method" if block and block.trait else "method"
            yield {"name": item.name, "kind": kind, "line": item.line, "owner": owner}


def _mentions(t: list[Token], at: int, stop: int) -> set[str]:
    return {x.text for x in t[at:stop] if x.kind == "id" and x.text not in STANDARD | LOCAL_ROOTS | {"let", "mut", "fn", "if", "else", "match", "for", "in", "while", "loop", "return", "use", "pub", "as", "move", "ref", "true", "false"}}


def references(source: str) -> set[str]:
    found = read(source)
    return _mentions(found[0], 0, len(found[0])) if found else set()


def test_usages(source: str) -> Iterator[tuple[str, str]]:
    """(test, name): `#[test]` functions, with the inline modules that hold them."""
    found = read(source)

    def visit(t: list[Token], members: list[Item], prefix: str) -> Iterator[tuple[str, str]]:
        for item in members:
            if item.kind == "fn" and item.body and is_test(item.attributes):
                yield from ((prefix + item.name, ref) for ref in sorted(_mentions(t, *item.body)))
            elif item.kind == "mod":
                yield from visit(t, item.children, f"{prefix}{item.name}::")

    if found:
        yield from visit(*found, "")


def bindings(source: str) -> Iterator[tuple[str, str]]:
    return iter(())


def uses_test_framework(source: str) -> bool:
    return False
