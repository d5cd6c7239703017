"""Python source as rows: units with measures, imports, chunks, definitions and references.

One pass of the standard parser over a file makes all rows of one kind. A file that does not parse is
taken block by block: what parses by itself is kept in its place, and a class keeps its sound members.
Its `module` unit has parse_error.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

# Base classes that make a class an interface.
INTERFACES = {"Protocol", "ABC", "ABCMeta"}
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPE = (*_FUNCTION, ast.ClassDef)
_LOOP = (ast.For, ast.AsyncFor, ast.While)
_BLOCK = (ast.If, *_LOOP, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match)
MEASURES = (
    "statements_per_function", "arguments_per_function", "positional_args", "keyword_only_args", "max_indentation_depth",
    "nested_function_depth", "returns_per_function", "return_values_per_function", "branches_per_function",
    "local_variables_per_function", "statements_per_try_block", "boolean_parameters", "annotations_per_function",
    "calls_per_function", "methods_per_class", "statements_per_file", "lines_per_file", "functions_per_file",
    "interface_types_per_file", "concrete_types_per_file", "imported_names_per_file",
)


def count_lines(source: str) -> int:
    return source.count("\n") + (bool(source) and not source.endswith("\n"))


def _bodies(node: ast.AST) -> Iterator[tuple[list[ast.stmt], bool]]:
    """Statement lists of a block; True if the list stands in a clause of its own (else, except, case)."""
    yield getattr(node, "body", []), False
    if isinstance(node, ast.Match):
        for case in node.cases:
            yield case.body, True
    for handler in getattr(node, "handlers", []):
        yield handler.body, True
    yield getattr(node, "orelse", []), True
    yield getattr(node, "finalbody", []), True


def _is_elif(node: ast.AST, body: list[ast.stmt]) -> bool:
    """An `elif` is an `if` alone in the other branch, in the same column as its `if`."""
    return isinstance(node, ast.If) and len(body) == 1 and isinstance(body[0], ast.If) and body is node.orelse and body[0].col_offset == node.col_offset


def _counted(statement: ast.stmt) -> bool:
    return not isinstance(statement, (ast.Import, ast.ImportFrom, *_SCOPE))


def statements(body: list[ast.stmt]) -> int:
    """Statements without imports and definitions; nested definitions are not entered, `elif` is no statement."""
    total = 0
    for s in body:
        if isinstance(s, _SCOPE):
            continue
        total += _counted(s)
        if isinstance(s, _BLOCK):
            for inner, _ in _bodies(s):
                total += statements(inner) - _is_elif(s, inner)
    return total


def _depth(body: list[ast.stmt], at: int) -> int:
    most = at
    for s in body:
        if isinstance(s, _BLOCK):
            most = max(most, at + 1)
            for inner, clause in _bodies(s):
                if not inner:
                    continue
                if _is_elif(s, inner):
                    for deep, branch in _bodies(inner[0]):
                        most = max(most, _depth(deep, at + 2) if deep else at)
                else:
                    most = max(most, _depth(inner, at + 1 + clause))
    return most


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """All nodes below, without those of nested functions and classes."""
    todo = list(ast.iter_child_nodes(node))
    while todo:
        at = todo.pop()
        if isinstance(at, _SCOPE):
            continue
        yield at
        todo += ast.iter_child_nodes(at)


def _body_nodes(function: ast.AST) -> Iterator[ast.AST]:
    for s in function.body:
        if not isinstance(s, _SCOPE):
            yield s
            yield from _own(s)


def _targets(target: ast.expr) -> Iterator[str]:
    if isinstance(target, ast.Name):
        yield target.id
    elif isinstance(target, ast.Tuple):
        for item in target.elts:
            yield from _targets(item)


def _locals(nodes: list[ast.AST]) -> set[str]:
    found: set[str] = set()
    for n in nodes:
        for target in n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, (ast.AugAssign, ast.AnnAssign)) else []:
            found.update(_targets(target))
    return found


def _nesting(node: ast.AST) -> int:
    """Functions inside functions, the deepest."""
    return max((_nesting(n) + isinstance(n, _FUNCTION) for n in ast.iter_child_nodes(node)), default=0)


def _parameters(args: ast.arguments) -> tuple[int, int, int]:
    """(positional, keyword-only, with a True or False default); self and cls do not count."""
    named = [a for a in [*args.posonlyargs, *args.args] if a.arg not in ("self", "cls")]
    only = [a for a in args.kwonlyargs if a.arg not in ("self", "cls")]
    flags = sum(isinstance(d, ast.Constant) and d.value in (True, False) and isinstance(d.value, bool) for d in [*args.defaults, *args.kw_defaults] if d is not None)
    return len(named) + (args.vararg is not None), len(only), flags


def function_measures(node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict[str, int]:
    nodes = list(_body_nodes(node))
    positional, only, flags = _parameters(node.args)
    returns = [n for n in nodes if isinstance(n, ast.Return)]
    tries = [statements(n.body) for n in nodes if isinstance(n, (ast.Try, ast.TryStar))]
    return {
        "statements_per_function": statements(node.body),
        "arguments_per_function": positional + only,
        "positional_args": positional,
        "keyword_only_args": only,
        "max_indentation_depth": _depth(node.body, 1),
        "nested_function_depth": _nesting(node),
        "returns_per_function": len(returns),
        "return_values_per_function": max((0 if r.value is None else len(r.value.elts) if isinstance(r.value, ast.Tuple) else 1 for r in returns), default=0),
        "branches_per_function": sum(isinstance(n, (ast.If, ast.match_case)) for n in nodes),
        "local_variables_per_function": len(_locals(nodes)),
        "statements_per_try_block": max(tries, default=0),
        "boolean_parameters": flags,
        "annotations_per_function": len(node.decorator_list),
        "calls_per_function": sum(isinstance(n, ast.Call) for n in nodes),
    }


def _guarded(node: ast.AST) -> bool:
    """`if TYPE_CHECKING`, by name or attribute."""
    return isinstance(node, ast.If) and ((isinstance(node.test, ast.Name) and node.test.id == "TYPE_CHECKING") or (isinstance(node.test, ast.Attribute) and node.test.attr == "TYPE_CHECKING"))


def imported_names(tree: ast.AST) -> set[str]:
    """Names that imports bind anywhere outside `if TYPE_CHECKING`."""
    found: set[str] = set()
    todo: list[ast.AST] = [tree]
    while todo:
        node = todo.pop()
        if _guarded(node):
            continue
        if isinstance(node, ast.Import):
            found.update(a.asname or a.name.split(".")[0] for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            found.update(a.asname or a.name for a in node.names)
        todo += ast.iter_child_nodes(node)
    return found


def _interface(node: ast.ClassDef) -> bool:
    words = {n.id if isinstance(n, ast.Name) else n.attr for part in [*node.bases, *(k.value for k in node.keywords)] for n in ast.walk(part) if isinstance(n, (ast.Name, ast.Attribute))}
    return bool(words & INTERFACES)


def _whole(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


#: Lines that go on with the block before them.
_GOES_ON = re.compile(r"[)\]}]|(?:elif|else|except|finally)\b")


def _blocks(lines: list[str], first: int, last: int) -> list[tuple[int, int]]:
    """Line ranges of the statements at the least indentation of lines[first:last]; decorators stay with what they decorate."""
    filled = [k for k in range(first, last) if lines[k].strip() and not lines[k].lstrip().startswith("#")]
    if not filled:
        return []
    width = lambda k: len(lines[k]) - len(lines[k].lstrip())
    least = min(map(width, filled))
    starts, decorated = [], False
    for k in filled:
        if width(k) == least and not _GOES_ON.match(lines[k].lstrip()):
            if not decorated:
                starts.append(k)
            decorated = lines[k].lstrip().startswith("@")
    return list(zip(starts, [*starts[1:], last], strict=True))


def _sound(lines: list[str], first: int, last: int) -> list[tuple[int, int]]:
    """Line ranges that parse, without the blocks inside that do not."""
    kept = []
    for a, b in _blocks(lines, first, last):
        pad = len(lines[a]) - len(lines[a].lstrip())
        if _whole("if 1:\n" * bool(pad) + "".join(lines[a:b])) is not None:
            kept.append((a, b))
            continue
        head = next((k for k in range(a, b) if not lines[k].lstrip().startswith("@")), a)
        if lines[head].lstrip().startswith("class ") and lines[head].rstrip().endswith(":"):
            inner = _sound(lines, head + 1, b)
            kept += [(a, head + 1), *inner] if inner else []
    return kept


def parse(source: str) -> ast.Module | None:
    """The tree of a file, or of those blocks of it that parse; None if none does."""
    if (tree := _whole(source)) is not None:
        return tree
    lines = source.splitlines(keepends=True)
    kept = {k for a, b in _sound(lines, 0, len(lines)) for k in range(a, b)}
    if not kept:
        return None
    return _whole("".join(line if k in kept else "\n" for k, line in enumerate(lines)))


def units(path: str, source: str) -> Iterator[dict]:
    """The module, and every function and class, with their measures; nested ones too."""
    tree = parse(source)
    name = path.rsplit("/", 1)[-1].removesuffix(".py")
    module = {"kind": "module", "name": name, "owner": None, "line": 1, "end_line": max(1, count_lines(source)), "inside_class": False, "lines_per_file": count_lines(source)}
    if _whole(source) is None:
        module["parse_error"] = True
    if tree is None:
        yield module
        return
    defs = [n for n in ast.walk(tree) if isinstance(n, _FUNCTION)]
    classes = [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]
    top = [f for n in tree.body for f in ([n] if isinstance(n, _FUNCTION) else n.body if isinstance(n, ast.ClassDef) else []) if isinstance(f, _FUNCTION)]
    module |= {
        "statements_per_file": sum(statements(f.body) for f in top),
        "functions_per_file": len(defs),
        "interface_types_per_file": sum(map(_interface, classes)),
        "concrete_types_per_file": sum(not _interface(c) for c in classes),
    }
    if name != "__init__":
        module["imported_names_per_file"] = len(imported_names(tree))
    yield module

    def below(node: ast.AST, owner: str | None, direct: bool) -> Iterator[dict]:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, _FUNCTION):
                yield {"kind": "method" if direct else "function", "name": n.name, "owner": owner if direct else None, "line": n.lineno, "end_line": n.end_lineno, "inside_class": direct} | function_measures(n)
                yield from below(n, None, False)
            elif isinstance(n, ast.ClassDef):
                methods = sum(isinstance(x, _FUNCTION) for x in ast.walk(n))
                yield {"kind": "class", "name": n.name, "owner": None, "line": n.lineno, "end_line": n.end_lineno, "inside_class": False, "methods_per_class": methods}
                yield from below(n, n.name, True)
            else:
                yield from below(n, owner, direct and isinstance(node, ast.ClassDef))

    yield from below(tree, None, False)


def cyclomatic(node: ast.AST) -> int:
    """One, and one for each decision below the node."""
    decisions = (ast.If, *_LOOP, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.match_case, ast.BoolOp, ast.IfExp, ast.comprehension, ast.Assert)
    return 1 + sum(isinstance(n, decisions) for n in ast.walk(node) if n is not node)


def complexities(source: str) -> Iterator[tuple[str, int]]:
    tree = parse(source)
    yield from ((n.name, cyclomatic(n)) for n in (ast.walk(tree) if tree else ()) if isinstance(n, _FUNCTION))


def imports(source: str) -> list[str]:
    """Imported module texts, those under TYPE_CHECKING and in functions too; relative ones without their dots."""
    tree = parse(source)
    found: dict[str, None] = {}
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Import):
            found.update((a.name, None) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            base = node.module or ""
            if base:
                found[base] = None
            found.update((f"{base}.{a.name}" if base else a.name, None) for a in node.names if a.name != "*")
        elif isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            f = node.func
            if (isinstance(f, ast.Name) and f.id == "__import__") or (isinstance(f, ast.Attribute) and f.attr == "import_module" and isinstance(f.value, ast.Name) and f.value.id == "importlib"):
                found[node.args[0].value.lstrip(".")] = None
    return [x for x in found if x]


def chunks(source: str) -> Iterator[dict]:
    """Bodies of all functions as text, with the lines of the whole function."""
    tree = parse(source)
    lines = source.splitlines(keepends=True)
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, _FUNCTION):
            first, last = n.body[0], n.body[-1]
            body = "".join(lines[first.lineno - 1 : last.end_lineno])
            yield {"name": n.name, "start_line": n.lineno, "end_line": n.end_lineno, "text": body}


def _abstract(node: ast.AST) -> bool:
    return any((isinstance(d, ast.Name) and d.id == "abstractmethod") or (isinstance(d, ast.Attribute) and d.attr == "abstractmethod") for d in node.decorator_list)


def definitions(source: str) -> Iterator[dict]:
    """What tests could cover: public functions, methods and classes, not inside functions."""
    tree = parse(source)

    def public(name: str) -> bool:
        return (not name.startswith("_") or name == "__init__") and not name.startswith("test_")

    def below(body: list[ast.stmt], owner: str | None) -> Iterator[dict]:
        for n in body:
            if isinstance(n, _FUNCTION):
                if public(n.name) and not _abstract(n):
                    yield {"name": n.name, "kind": "method" if owner else "function", "line": n.lineno, "owner": owner}
            elif isinstance(n, ast.ClassDef):
                if any((isinstance(b, ast.Name) and b.id == "Protocol") or (isinstance(b, ast.Attribute) and b.attr == "Protocol") for b in n.bases):
                    continue
                if public(n.name):
                    yield {"name": n.name, "kind": "class", "line": n.lineno, "owner": None}
                yield from below(n.body, n.name)
            elif isinstance(n, _BLOCK):
                for inner, _ in _bodies(n):
                    yield from below(inner, owner)

    yield from below(tree.body if tree else [], None)


def mentioned(node: ast.AST) -> set[str]:
    """Every identifier and attribute below."""
    found: set[str] = set()
    for n in ast.walk(node):
        if isinstance(n, ast.Name):
            found.add(n.id)
        elif isinstance(n, ast.Attribute):
            found.add(n.attr)
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            for a in n.names:
                found.update(a.name.split("."))
    return found


def test_usages(source: str) -> Iterator[tuple[str, str]]:
    """(test, name): test functions, and methods of Test classes as Class::method."""
    tree = parse(source)
    for n in tree.body if tree else ():
        if isinstance(n, _FUNCTION) and n.name.startswith("test_"):
            yield from ((n.name, ref) for ref in sorted(mentioned(n)))
        elif isinstance(n, ast.ClassDef) and n.name.startswith("Test"):
            for m in n.body:
                if isinstance(m, _FUNCTION) and m.name.startswith("test_"):
                    yield from ((f"{n.name}::{m.name}", ref) for ref in sorted(mentioned(m)))


def references(source: str) -> set[str]:
    tree = parse(source)
    return mentioned(tree) if tree else set()


def bindings(source: str) -> Iterator[tuple[str, str]]:
    """(module, name) of `from module import name`."""
    tree = parse(source)
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, ast.ImportFrom) and n.module:
            yield from ((n.module, a.name) for a in n.names)


def uses_test_framework(source: str) -> bool:
    """An import of pytest or unittest, and a test function or class."""
    tree = parse(source)
    nodes = list(ast.walk(tree)) if tree else []
    imported = any((isinstance(n, ast.Import) and any(a.name.split(".")[0] in ("pytest", "unittest") for a in n.names)) or (isinstance(n, ast.ImportFrom) and (n.module or "").split(".")[0] in ("pytest", "unittest")) for n in nodes)
    return imported and any((isinstance(n, _FUNCTION) and n.name.startswith("test_")) or (isinstance(n, ast.ClassDef) and n.name.startswith("Test")) for n in nodes)
