"""Where a Python name is defined and referred to, as byte ranges, from the syntax tree.

Receivers of attributes are resolved from the tree: self and cls to the class around them, super()
to its first base, a capitalised name to itself, and a variable to what the function around it
assigns or annotates it as."""

from __future__ import annotations

import ast
from collections.abc import Iterator

_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
# Generic types whose first argument stands for the value.
WRAPPERS = {"Optional", "List", "list", "Sequence", "Iterable", "Iterator", "Set", "set", "Tuple", "tuple", "Type", "type", "Annotated", "Final", "ClassVar", "Awaitable", "Union"}


class Source:
    def __init__(self, text: str):
        self.data = text.encode()
        self.tree = ast.parse(text)
        self.starts = [0]
        for line in self.data.split(b"\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def name_after(self, start: int, name: str) -> int:
        return self.data.index(name.encode(), start)


def _annotation(node: ast.expr | None) -> str | None:
    """The class an annotation names, if it starts with a capital."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            node = ast.parse(node.value, mode="eval").body
        except SyntaxError:
            return None
    if isinstance(node, ast.Subscript):
        outer = node.value.attr if isinstance(node.value, ast.Attribute) else getattr(node.value, "id", "")
        if outer in WRAPPERS:
            inner = node.slice.elts[0] if isinstance(node.slice, ast.Tuple) and node.slice.elts else node.slice
            return _annotation(inner)
        node = node.value
    if isinstance(node, ast.BinOp):
        return _annotation(node.left)
    name = node.attr if isinstance(node, ast.Attribute) else getattr(node, "id", None)
    return name if name and name[0].isupper() else None


def classes(tree: ast.Module) -> dict[str, list[str]]:
    """Class names with their bases' last names."""
    last = lambda b: b.attr if isinstance(b, ast.Attribute) else getattr(b, "id", "")
    return {n.name: [last(b) for b in n.bases] for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}


def definitions(source: Source) -> Iterator[dict]:
    """name, owner, and the bytes of the name and of the whole (with decorators for functions)."""

    def below(node: ast.AST, owner: str | None, top: bool) -> Iterator[dict]:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (*_FUNCTION, ast.ClassDef)):
                start = source.at(n.lineno, n.col_offset)
                at = source.name_after(start + (5 if isinstance(n, ast.ClassDef) else 3), n.name)
                first = n.decorator_list[0] if n.decorator_list and isinstance(n, _FUNCTION) else None
                whole = source.at(first.lineno, first.col_offset) - 1 if first else start
                yield {"name": n.name, "owner": owner, "start": at, "end": at + len(n.name.encode()), "line": n.lineno, "whole": (whole, source.at(n.end_lineno, n.end_col_offset)), "top": top}
                yield from below(n, n.name if isinstance(n, ast.ClassDef) else None, False)
            else:
                yield from below(n, owner, top)

    yield from below(source.tree, None, True)


def references(source: Source, name: str) -> Iterator[dict]:
    """kind (call, import or method), bytes, line, and the receiver's class for methods."""

    def typed(function: ast.AST | None, variable: str) -> str | None:
        found = None
        if function is not None:
            for a in [*function.args.posonlyargs, *function.args.args, *function.args.kwonlyargs]:
                if a.arg == variable and a.annotation is not None:
                    found = _annotation(a.annotation)
        for n in ast.walk(function or source.tree):
            if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and n.target.id == variable:
                found = _annotation(n.annotation)
            pairs = [(t, n.value) for t in n.targets] if isinstance(n, ast.Assign) else [(n.target, n.value)] if isinstance(n, ast.NamedExpr) else []
            for target, value in pairs:
                if isinstance(target, ast.Name) and target.id == variable and isinstance(value, ast.Call):
                    found = _annotation(value.func) or found
        return found

    def receiver(node: ast.expr, owner: str | None, bases: list[str], function: ast.AST | None) -> str | None:
        if isinstance(node, ast.Name):
            if node.id in ("self", "cls"):
                return owner
            return node.id if node.id[:1].isupper() else typed(function, node.id)
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name) and node.func.id == "super":
                return bases[0] if bases else None
            return _annotation(node.func)
        return None

    def below(node: ast.AST, owner: str | None, bases: list[str], function: ast.AST | None) -> Iterator[dict]:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.ClassDef):
                yield from below(n, n.name, [b.attr if isinstance(b, ast.Attribute) else getattr(b, "id", "") for b in n.bases], function)
                continue
            if isinstance(n, ast.Name) and n.id == name:
                start = source.at(n.lineno, n.col_offset)
                yield {"kind": "call", "start": start, "end": start + len(name.encode()), "line": n.lineno, "receiver": None}
            elif isinstance(n, ast.Attribute) and n.attr == name:
                end = source.at(n.end_lineno, n.end_col_offset)
                yield {"kind": "method", "start": end - len(name.encode()), "end": end, "line": n.end_lineno, "receiver": receiver(n.value, owner, bases, function)}
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                for a in n.names:
                    if isinstance(n, ast.ImportFrom) and a.name == name:
                        start = source.at(a.lineno, a.col_offset)
                        yield {"kind": "import", "start": start, "end": start + len(name.encode()), "line": a.lineno, "receiver": None}
            elif isinstance(n, (ast.Global, ast.Nonlocal)) and name in n.names:
                start = source.name_after(source.at(n.lineno, n.col_offset) + 6, name)
                yield {"kind": "call", "start": start, "end": start + len(name.encode()), "line": n.lineno, "receiver": None}
            yield from below(n, owner, bases, n if isinstance(n, _FUNCTION) else function)

    yield from below(source.tree, None, [], None)
