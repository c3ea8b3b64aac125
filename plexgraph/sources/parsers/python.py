"""Python sources by the standard library's parser."""

from __future__ import annotations

import ast

BUILTIN_TYPES = set(
    """Any Callable ClassVar Dict Final FrozenSet Generator Iterable Iterator List Literal Mapping None Optional Sequence Set Tuple Type Union
bool bytes complex dict float frozenset int list object set str tuple type""".split()
)


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}".lstrip(".")
    if isinstance(node, (ast.Call, ast.Subscript)):
        return _dotted(node.func if isinstance(node, ast.Call) else node.value)
    return ""


def _outer_types(node: ast.AST | None) -> list[str]:
    """Names of an annotation: the outer one of a subscript, each side of a union."""
    if isinstance(node, ast.BinOp):
        return _outer_types(node.left) + _outer_types(node.right)
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return _outer_types(ast.parse(node.value, mode="eval").body)
        except SyntaxError:
            return []
    name = _dotted(node).rsplit(".", 1)[-1] if node is not None else ""
    if name == "Optional" and isinstance(node, ast.Subscript):
        return _outer_types(node.slice)
    return [name] if name and name not in BUILTIN_TYPES else []


class _Reader(ast.NodeVisitor):
    def __init__(self, content: str):
        self.lines = content.splitlines(keepends=True)
        self.out: dict[str, list] = {k: [] for k in ("symbols", "imports", "calls", "type_refs", "heritage", "exports", "variable_types")}
        self.owner: list[tuple[str, str]] = []  # kind and name of what is around

    def _symbol(self, node, kind: str, signature: str, class_name: str) -> None:
        text = "".join(self.lines[node.lineno - 1 : node.end_lineno]).rstrip("\n")
        decorators = [_dotted(d) for d in node.decorator_list]
        self.out["symbols"].append({"name": node.name, "kind": kind, "start_line": node.lineno, "end_line": node.end_lineno, "content": text, "signature": signature, "class_name": class_name, "decorators": [d for d in decorators if d]})

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._symbol(node, "class", f"class {node.name}", "")
        for base in node.bases:
            if name := _dotted(base).rsplit(".", 1)[-1]:
                self.out["heritage"].append({"class_name": node.name, "kind": "extends", "parent_name": name})
        self._inside("class", node.name, [*node.decorator_list, *node.bases, *[k.value for k in node.keywords], *node.body])

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        in_class = bool(self.owner) and self.owner[-1][0] == "class"
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        signature = f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({ast.unparse(node.args)}){returns}"
        self._symbol(node, "method" if in_class else "function", signature, self.owner[-1][1] if in_class else "")
        a = node.args
        for arg in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]:
            for name in _outer_types(arg.annotation):
                self.out["type_refs"].append({"name": name, "kind": "param", "line": arg.lineno, "param_name": arg.arg})
                self.out["variable_types"].append({"var_name": arg.arg, "type_name": name, "line": arg.lineno})
        for name in _outer_types(node.returns):
            self.out["type_refs"].append({"name": name, "kind": "return", "line": node.lineno, "param_name": ""})
        self._inside("function", node.name, [*node.decorator_list, *a.defaults, *[d for d in a.kw_defaults if d], *node.body])

    visit_AsyncFunctionDef = visit_FunctionDef

    def _inside(self, kind: str, name: str, children: list) -> None:
        self.owner.append((kind, name))
        for child in children:
            self.visit(child)
        self.owner.pop()

    def visit_Import(self, node: ast.Import) -> None:
        for n in node.names:
            self.out["imports"].append({"module": n.name, "names": [], "is_relative": False, "alias": n.asname or ""})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.out["imports"].append({"module": module, "names": [n.name for n in node.names], "is_relative": node.level > 0, "alias": ""})

    def visit_Call(self, node: ast.Call) -> None:
        name = _dotted(node.func)
        if isinstance(node.func, (ast.Name, ast.Attribute)) and name:
            receiver, _, last = name.rpartition(".")
            given = [x.id for x in [*node.args, *[k.value for k in node.keywords]] if isinstance(x, ast.Name)]
            self.out["calls"].append({"name": last, "line": node.lineno, "receiver": receiver, "arguments": given, "is_weak_ref": False})
        self.generic_visit(node)

    def _reference(self, node: ast.AST | None) -> None:
        for x in node.elts if isinstance(node, ast.Tuple) else [node]:
            if isinstance(x, (ast.Name, ast.Attribute)) and (name := _dotted(x)):
                receiver, _, last = name.rpartition(".")
                self.out["calls"].append({"name": last, "line": x.lineno, "receiver": receiver, "arguments": [], "is_weak_ref": False})

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        self._reference(node.type)
        self.generic_visit(node)

    def visit_Raise(self, node: ast.Raise) -> None:
        self._reference(node.exc)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        for name in _outer_types(node.annotation):
            target = _dotted(node.target)
            self.out["type_refs"].append({"name": name, "kind": "variable", "line": node.lineno, "param_name": ""})
            self.out["variable_types"].append({"var_name": target, "type_name": name, "line": node.lineno})
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name) and t.id == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)):
                self.out["exports"] += [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
            elif isinstance(node.value, ast.Call) and (name := _dotted(node.value.func).rsplit(".", 1)[-1])[:1].isupper() and (var := _dotted(t)):
                self.out["variable_types"].append({"var_name": var, "type_name": name, "line": node.lineno})
        self.generic_visit(node)


def parse(content: str) -> dict[str, list]:
    reader = _Reader(content)
    reader.visit(ast.parse(content))
    return reader.out
