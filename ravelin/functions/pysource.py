"""Findings in the syntax of Python sources: calls, and names that are put together from pieces.

An abstract interpreter over constants: one pass over the statements collects what names,
attributes, items and functions without arguments are worth, a second one asks of every
expression what text it makes. Unknown parts make the whole unknown; nothing is executed.
"""

from __future__ import annotations

import ast
import re
import string
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions.kinds import FOUND, FOUND_ARROW
from ravelin.functions.payloads import decode, payloads

NAMES = {"eval": "EXEC-002", "exec": "EXEC-002", "system": "EXEC-002", "popen": "EXEC-002", "getattr": "EXEC-006", "__import__": "EXEC-006"}
RUNS = frozenset(["eval", "exec", "os.system", "os.popen", *("os." + f for f in "execl execv execvp execvpe spawnl spawnle spawnlp spawnlpe".split())])
LOADS = frozenset("cloudpickle.loads dill.loads marshal.load marshal.loads pickle.load pickle.loads shelve.open yaml.unsafe_load".split())
IMPORTS = frozenset("__import__ builtins.__import__ importlib.__import__ importlib.import_module".split())
SENSITIVE = frozenset("__builtins__ builtins code codeop ctypes importlib os shutil socket subprocess sys".split())
RUNNERS = frozenset("subprocess." + f for f in "Popen call check_call check_output run".split())
TOOLS, NC_FLAGS = frozenset("curl nc ncat netcat wget".split()), frozenset("-c -e -k -l -p -u -z".split())
REF_CALLS = frozenset("Popen call check_call check_output eval exec popen run system".split())
CLIMB, ESCAPE = frozenset("__base__ __bases__ __class__ __mro__ __subclasses__".split()), frozenset("__builtins__ __code__ __getattr__ __globals__ __import__".split())
STARS = {"os": "system popen execl execv execvp execvpe spawnl spawnle spawnlp spawnlpe", "subprocess": "run call check_call check_output Popen", "pickle": "load loads", "importlib": "import_module", "socket": "getaddrinfo"}
ROT = {"rot13", "rot_13", "rot-13"}
DEPTH, SIZE, ITEMS = 50, 10_000, 1_000
SEVERITY = {"EXEC-002": "critical", "EXEC-006": "high", "EXEC-007": "critical", "EXEC-011": "high", "EXFIL-006": "critical", "EXFIL-008": "critical", "OBFS-001": "high", "AST-PARSE": "info", "AST-DEPTH": "info"}
CATEGORY = {"EXFIL-006": "data-exfiltration", "EXFIL-008": "data-exfiltration", "OBFS-001": "obfuscation", "AST-PARSE": "analysis", "AST-DEPTH": "analysis"}

Row = tuple[str, str, int | None, str, str]  # rule, severity, line, matched, description


class Unknown(Exception):
    """The value of an expression can't be told."""


#: A placeholder of %-format, or a percent sign that is meant.
_PLACE = re.compile(r"%(?:%|[-#0 +]*\d*(?:\.\d+)?[diouxXeEfFgGcrsa])")


def filled(text: str, values: list[object]) -> str:
    """%-format by any placeholder for as many values: a text takes its place whatever the placeholder is for."""
    found = [m[0] for m in _PLACE.finditer(text) if m[0] != "%%"]
    if len(found) != len(values) or not all(isinstance(v, (str, int)) for v in values):
        raise Unknown
    left = iter(values)

    def one(m: re.Match) -> str:
        if m[0] == "%%":
            return "%"
        v = next(left)
        return v if isinstance(v, str) else m[0] % v

    return _PLACE.sub(one, text)


def literal(node: ast.expr) -> bool:
    """A number as it is written, with or without a sign."""
    return isinstance(node, ast.Constant) or (isinstance(node, ast.UnaryOp) and isinstance(node.operand, ast.Constant))


class Source:
    def __init__(self, tree: ast.Module):
        self.tree = tree
        self.alias = dict(self._imports(tree.body))
        self.values: dict[str, dict[object, object]] = {}
        self.refs: dict[tuple[str, str], str] = {}
        self.returns: dict[str, ast.expr] = {}
        self.scopes: dict[int, str] = {}
        self.classes: dict[str, str] = {}
        self._mark(tree, "", "")
        self._collect(tree.body, "", {})

    # --- names ------------------------------------------------------------

    def _imports(self, body: list[ast.stmt]) -> Iterator[tuple[str, str]]:
        for s in body:
            if isinstance(s, ast.Import):
                for a in s.names:
                    yield (a.asname, a.name) if a.asname else (a.name.split(".")[0], a.name.split(".")[0])
            elif isinstance(s, ast.ImportFrom) and s.module:
                for a in s.names:
                    if a.name == "*":
                        yield from ((n, f"{s.module}.{n}") for n in STARS.get(s.module, "").split())
                    else:
                        yield a.asname or a.name, f"{s.module}.{a.name}"
            elif isinstance(s, ast.Try):
                yield from self._imports([*s.body, *(x for h in s.handlers for x in h.body), *s.orelse, *s.finalbody])

    def call_name(self, call: ast.AST) -> str | None:
        return self.dotted(call.func) if isinstance(call, ast.Call) else None

    def dotted(self, node: ast.AST) -> str | None:
        parts: list[str] = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name):
            return None
        return ".".join([self.alias.get(node.id, node.id), *reversed(parts)])

    def _mark(self, node: ast.AST, scope: str, owner: str) -> None:
        """Scope and class of every node."""
        todo = [(node, scope, owner)]
        while todo:
            at, scope, owner = todo.pop()
            self.scopes[id(at)] = scope
            inside = scope
            if isinstance(at, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inside = f"{scope}.{at.name}" if scope else at.name
                self.classes[inside] = owner
            elif isinstance(at, ast.ClassDef):
                inside = owner = f"{scope}.{at.name}" if scope else at.name
                self.classes[inside] = inside
            else:
                inside = scope
            for child in ast.iter_child_nodes(at):
                outer = isinstance(at, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and child in at.decorator_list
                todo.append((child, scope if outer else inside, owner))

    # --- first pass: what names are worth ---------------------------------

    def _collect(self, body: list[ast.stmt], scope: str, route: dict[str, str]) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = f"{scope}.{s.name}" if scope else s.name
                self._returning(s, inner)
                self._collect(s.body, inner, {})
                continue
            if isinstance(s, ast.ClassDef):
                self._collect(s.body, f"{scope}.{s.name}" if scope else s.name, {})
                continue
            if isinstance(s, ast.Global):
                route.update(dict.fromkeys(s.names, ""))
            elif isinstance(s, ast.Nonlocal):
                for n in s.names:
                    outer = scope.rpartition(".")[0]
                    while outer and n not in self.values.get(outer, {}):
                        outer = outer.rpartition(".")[0]
                    route[n] = outer
            changes: list[ast.Call] = []
            for node in self._own(s):
                if isinstance(node, ast.NamedExpr):
                    self._assign(node.target, node.value, scope, route)
                elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name):
                    changes.append(node)
            # what is assigned is worth what it was before it is taken out
            late = isinstance(s, (ast.Assign, ast.AnnAssign))
            for node in () if late else changes:
                self._mutate(node, scope, route)
            if isinstance(s, ast.Assign):
                for t in s.targets:
                    self._assign(t, s.value, scope, route)
            elif isinstance(s, ast.AnnAssign) and s.value is not None:
                self._assign(s.target, s.value, scope, route)
            elif isinstance(s, ast.AugAssign):
                load = ast.copy_location(ast.BinOp(self._loaded(s.target), s.op, s.value), s)
                self._assign(s.target, load, scope, route)
            elif isinstance(s, (ast.For, ast.AsyncFor)):
                self._loop(s, scope, route)
            for node in changes if late else ():
                self._mutate(node, scope, route)
            for field in ("body", "orelse", "finalbody"):
                if isinstance(getattr(s, field, None), list) and not isinstance(s, (ast.For, ast.AsyncFor)):
                    self._collect(getattr(s, field), scope, route)
            for h in (*getattr(s, "handlers", ()), *getattr(s, "cases", ())):
                self._collect(h.body, scope, route)

    @staticmethod
    def _loaded(target: ast.expr) -> ast.expr:
        return ast.parse(ast.unparse(target), mode="eval").body

    @staticmethod
    def _own(statement: ast.stmt) -> Iterator[ast.AST]:
        """Expressions of a statement, without those of statements in it."""
        todo: list[ast.AST] = [c for c in ast.iter_child_nodes(statement) if isinstance(c, ast.expr)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in ast.iter_child_nodes(node) if not isinstance(c, ast.Lambda)]

    def _table(self, name: str, scope: str, route: dict[str, str]) -> dict[object, object]:
        return self.values.setdefault(route.get(name, scope), {})

    def _assign(self, target: ast.expr, value: ast.expr, scope: str, route: dict[str, str]) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            if isinstance(value, (ast.Tuple, ast.List)) and len(value.elts) == len(target.elts):
                for t, v in zip(target.elts, value.elts, strict=True):
                    self._assign(t, v, scope, route)
            return
        try:
            worth: object = self.value(value, scope)
        except (Unknown, RecursionError):
            worth = Unknown
        if isinstance(target, ast.Name):
            table = self._table(target.id, scope, route)
            at = (route.get(target.id, scope), target.id)
            module = self._module(value, scope)
            if module is not None:
                self.refs[at] = module
            elif isinstance(value, ast.Call):
                self.refs.pop(at, None)
            if worth is Unknown:
                table.pop(target.id, None)
            else:
                table[target.id] = worth
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name):
            owner = self.classes.get(scope) if target.value.id == "self" else None
            if owner and worth is not Unknown:
                self.values.setdefault(owner, {})[target.attr] = worth
        elif isinstance(target, ast.Subscript) and isinstance(target.value, ast.Name):
            table = self._table(target.value.id, scope, route)
            try:
                key, held = self.value(target.slice, scope), self.lookup(target.value.id, scope)
                if isinstance(held, dict):
                    if worth is Unknown:
                        held.pop(key, None)
                    else:
                        held[key] = worth
                elif isinstance(held, list) and isinstance(key, int) and -len(held) <= key < len(held) and worth is not Unknown:
                    held[key] = worth
            except (Unknown, TypeError):
                table.pop(target.value.id, None)

    def _mutate(self, call: ast.Call, scope: str, route: dict[str, str]) -> None:
        name, how = call.func.value.id, call.func.attr
        if how not in ("append", "clear", "extend", "insert", "pop", "remove", "reverse", "setdefault", "sort", "update"):
            return
        try:
            held = self.lookup(name, scope)
        except Unknown:
            return
        if not isinstance(held, (list, dict)):
            return
        try:
            args = [self.value(a, scope) for a in call.args]
            if how == "update" and isinstance(held, dict):
                # keywords are passed over
                held.update(*args)
            elif isinstance(held, list) and how in ("append", "extend"):
                getattr(held, how)(*args)
                if len(held) > SIZE:
                    raise Unknown
            elif isinstance(held, list) and how == "reverse":
                held.reverse()
            elif how == "pop":
                if isinstance(held, dict) and args:
                    held.pop(args[0], None)
                else:
                    held.pop(*args)
            else:
                raise Unknown
        except (Unknown, TypeError, ValueError, IndexError):
            for table in self.values.values():
                if table.get(name) is held:
                    table.pop(name)

    def _loop(self, s: ast.For | ast.AsyncFor, scope: str, route: dict[str, str]) -> None:
        """A loop over known items that adds to a text is run; any other is read once."""
        one = s.body[0] if len(s.body) == 1 else None
        if isinstance(one, ast.AugAssign) and isinstance(s.target, ast.Name) and isinstance(one.target, ast.Name):
            try:
                items = list(self.value(s.iter, scope))
                if len(items) > ITEMS:
                    raise Unknown
                for item in items:
                    self.values.setdefault(scope, {})[s.target.id] = item
                    self._collect(s.body, scope, route)
                return
            except (Unknown, TypeError):
                pass
        self._collect([*s.body, *s.orelse], scope, route)

    def _returning(self, f: ast.FunctionDef | ast.AsyncFunctionDef, name: str) -> None:
        """A function all of whose returns are worth the same, whose last statement returns."""
        found: list[ast.Return] = []
        todo: list[ast.AST] = list(f.body)
        while todo:
            node = todo.pop()
            if isinstance(node, ast.Return):
                found.append(node)
            elif not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                todo += ast.iter_child_nodes(node)
        if found and all(r.value is not None for r in found) and self._ends(f.body):
            if len({ast.dump(r.value) for r in found}) == 1:
                self.returns[name] = found[0].value

    def _ends(self, body: list[ast.stmt]) -> bool:
        last = body[-1] if body else None
        if isinstance(last, (ast.Return, ast.Raise)):
            return True
        if isinstance(last, ast.If):
            return bool(last.orelse) and self._ends(last.body) and self._ends(last.orelse)
        if isinstance(last, ast.With):
            return self._ends(last.body)
        return isinstance(last, ast.Try) and self._ends(last.body) and all(self._ends(h.body) for h in last.handlers)

    def _module(self, node: ast.expr, scope: str) -> str | None:
        """The module that a call imports, or module.attribute that getattr takes of one."""
        name = self.call_name(node)
        try:
            if name in IMPORTS and node.args:
                module = self.value(node.args[0], scope)
                return module if isinstance(module, str) else None
            if name == "getattr" and len(node.args) >= 2 and (of := self.ref(node.args[0], scope)):
                attr = self.value(node.args[1], scope)
                return f"{of}.{attr}" if attr in REF_CALLS else None
        except Unknown:
            pass
        return self.ref(node, scope) if isinstance(node, ast.Name) else None

    def ref(self, node: ast.expr, scope: str) -> str | None:
        if isinstance(node, ast.Call):
            return self._module(node, scope)
        if isinstance(node, ast.Name):
            while True:
                if (scope, node.id) in self.refs:
                    return self.refs[scope, node.id]
                if not scope:
                    return None
                scope = scope.rpartition(".")[0]
        return None

    def lookup(self, name: str, scope: str) -> object:
        while True:
            table = self.values.get(scope, {})
            if name in table:
                return table[name]
            if not scope:
                raise Unknown
            scope = scope.rpartition(".")[0]

    # --- what expressions are worth ----------------------------------------

    def value(self, node: ast.expr, scope: str | None, local: dict[str, object] | None = None, depth: int = 0) -> object:
        if depth > DEPTH:
            raise Unknown
        worth = self._value(node, scope, local or {}, depth + 1)
        if isinstance(worth, (str, bytes, list, tuple)) and len(worth) > SIZE:
            raise Unknown
        return worth

    def _value(self, node: ast.expr, scope: str | None, local: dict[str, object], depth: int) -> object:
        go = lambda n, more=None: self.value(n, scope, {**local, **(more or {})}, depth)
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            if node.id in local:
                return local[node.id]
            if scope is None:
                raise Unknown
            return self.lookup(node.id, scope)
        if isinstance(node, ast.NamedExpr):
            return go(node.value)
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            out: list[object] = []
            for e in node.elts:
                out += list(go(e.value)) if isinstance(e, ast.Starred) else [go(e)]
            return tuple(out) if isinstance(node, ast.Tuple) else out
        if isinstance(node, ast.Dict):
            if any(k is None for k in node.keys):
                raise Unknown
            held: dict[object, object] = {}
            for k, v in zip(node.keys, node.values, strict=True):
                try:
                    held[go(k)] = go(v)
                except (Unknown, TypeError):
                    continue
            return held
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            inner = go(node.operand)
            if isinstance(inner, (int, float)):
                return -inner
        if isinstance(node, ast.BinOp):
            return self._binary(node.op, go(node.left), go(node.right))
        if isinstance(node, ast.JoinedStr):
            return "".join(self._formatted(v, go) for v in node.values)
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and scope is not None:
            owner = self.classes.get(scope) if node.value.id == "self" else node.value.id
            table = self.values.get(owner or "", {}) if owner in self.classes else {}
            if node.attr in table:
                return table[node.attr]
        if isinstance(node, ast.Subscript):
            held = go(node.value)
            try:
                if isinstance(node.slice, ast.Slice):
                    if not all(p is None or literal(p) for p in (node.slice.lower, node.slice.upper, node.slice.step)):
                        raise Unknown
                    return held[slice(*(None if p is None else go(p) for p in (node.slice.lower, node.slice.upper, node.slice.step)))]
                return held[go(node.slice)]
            except (TypeError, KeyError, IndexError, ValueError) as e:
                raise Unknown from e
        if isinstance(node, (ast.ListComp, ast.GeneratorExp)):
            return list(self._comprehended(node.elt, list(node.generators), scope, local, depth))
        if isinstance(node, ast.Call):
            return self._called(node, scope, local, depth)
        raise Unknown

    @staticmethod
    def _binary(op: ast.operator, a: object, b: object) -> object:
        try:
            if isinstance(op, ast.Add) and type(a) is type(b) and isinstance(a, (str, bytes, int, list, tuple)):
                return a + b
            if isinstance(op, ast.Mod) and isinstance(a, str) and not isinstance(b, dict):
                return filled(a, list(b) if isinstance(b, (list, tuple)) else [b])
            if isinstance(op, ast.Mod) and isinstance(a, (str, int)):
                return a % b
            if isinstance(op, ast.Mult) and isinstance(b, int) and (isinstance(a, int) or (isinstance(a, (str, bytes, list)) and b <= ITEMS)):
                return a * b
            if isinstance(op, ast.Sub) and isinstance(a, int) and isinstance(b, int):
                return a - b
            if isinstance(op, ast.BitXor) and isinstance(a, int) and isinstance(b, int):
                return a ^ b
            if isinstance(op, ast.BitOr) and isinstance(a, dict) and isinstance(b, dict):
                return a | b
        except (TypeError, ValueError, KeyError, OverflowError, MemoryError) as e:
            raise Unknown from e
        raise Unknown

    @staticmethod
    def _formatted(part: ast.expr, go) -> str:
        if isinstance(part, ast.Constant):
            return str(part.value)
        inner = go(part.value)
        # conversions and paddings don't hide a name
        text = str(inner) if part.conversion in (-1, 115, 114, 97) and isinstance(inner, (str, int)) else None
        if text is None:
            raise Unknown
        if part.format_spec is not None and isinstance(inner, int):
            try:
                return format(inner, go(part.format_spec))
            except (ValueError, TypeError) as e:
                raise Unknown from e
        return text

    def _comprehended(self, elt: ast.expr, rest: list[ast.comprehension], scope: str | None, local: dict[str, object], depth: int) -> Iterator[object]:
        if not rest:
            yield self.value(elt, scope, local, depth)
            return
        first = rest[0]
        if first.ifs or len(rest) > 2 or not isinstance(first.target, ast.Name):
            raise Unknown
        items = self.value(first.iter, scope, local, depth)
        if not isinstance(items, (str, bytes, list, tuple)) or len(items) > ITEMS:
            raise Unknown
        for item in items:
            yield from self._comprehended(elt, rest[1:], scope, {**local, first.target.id: item}, depth)

    def _called(self, node: ast.Call, scope: str | None, local: dict[str, object], depth: int) -> object:
        go = lambda n: self.value(n, scope, local, depth)
        name = self.dotted(node.func)
        args = node.args
        try:
            if name == "chr" and len(args) == 1:
                return chr(go(args[0]))
            if name == "ord" and len(args) == 1:
                return ord(go(args[0]))
            if name in ("list", "tuple") and len(args) == 1:
                return list(go(args[0]))
            if name == "reversed" and len(args) == 1:
                return list(go(args[0]))[::-1]
            if name in ("bytes", "bytearray") and args:
                inner = go(args[0])
                return inner.encode() if isinstance(inner, str) else bytes(inner) if not isinstance(inner, int) else self._unknown()
            if name in ("bytes.fromhex", "bytearray.fromhex") and args:
                return bytes.fromhex(go(args[0]))
            if name == "str" and args:
                inner = go(args[0])
                return inner.decode("utf-8", "replace") if isinstance(inner, bytes) and len(args) > 1 else str(inner) if isinstance(inner, (str, int)) else self._unknown()
            if name == "codecs.decode" and args:
                inner, how = go(args[0]), go(args[1]) if len(args) > 1 else "utf-8"
                return inner.decode(how, "replace") if isinstance(inner, bytes) else self._unknown()
            if name == "map" and len(args) == 2:
                items = list(go(args[1]))
                if len(items) > SIZE:
                    raise Unknown
                if isinstance(args[0], ast.Lambda):
                    return [self._lambda(args[0], [i], scope, local, depth) for i in items]
                by = {"chr": chr, "str": str, "ord": ord}.get(self.dotted(args[0]) or "")
                return [by(i) for i in items] if by else self._unknown()
            if name == "functools.reduce" and len(args) in (2, 3):
                items = list(go(args[1]))
                if len(args) == 3:
                    items = [go(args[2]), *items]
                plus = self.dotted(args[0])
                out = items[0]
                for i in items[1:]:
                    out = self._binary(ast.Add(), out, i) if plus in ("operator.add", "operator.concat") else self._lambda(args[0], [out, i], scope, local, depth)
                return out
            if isinstance(node.func, ast.Attribute):
                method = node.func.attr
                if isinstance(node.func.value, ast.Name) and node.func.value.id in ("self", "cls") and scope is not None:
                    owner = self.classes.get(scope)
                    if owner and f"{owner}.{method}" in self.returns:
                        return self.value(self.returns[f"{owner}.{method}"], f"{owner}.{method}", None, depth)
                held = go(node.func.value)
                if isinstance(held, str):
                    return self._method(held, method, node, go)
                if isinstance(held, bytes) and method == "decode":
                    return held.decode(go(args[0]) if args else "utf-8", "replace")
                if isinstance(held, dict) and method in ("get", "pop") and args:
                    key = go(args[0])
                    return held[key] if key in held else go(args[1])
                if isinstance(held, list) and method == "pop" and len(args) <= 1:
                    return held[go(args[0])] if args else held[-1]
            if isinstance(node.func, ast.Name) and scope is not None and not args and not node.keywords:
                at = scope
                while True:
                    full = f"{at}.{node.func.id}" if at else node.func.id
                    if full in self.returns:
                        return self.value(self.returns[full], full, None, depth)
                    if not at:
                        break
                    at = at.rpartition(".")[0]
        except (TypeError, ValueError, AttributeError, IndexError, KeyError, LookupError, OverflowError) as e:
            raise Unknown from e
        raise Unknown

    @staticmethod
    def _unknown() -> object:
        raise Unknown

    def _lambda(self, f: ast.expr, args: list[object], scope: str | None, local: dict[str, object], depth: int) -> object:
        if not isinstance(f, ast.Lambda) or len(f.args.args) != len(args):
            raise Unknown
        return self.value(f.body, scope, {**local, **{a.arg: v for a, v in zip(f.args.args, args, strict=True)}}, depth)

    def _method(self, held: str, method: str, node: ast.Call, go) -> object:
        if method == "join" and len(node.args) == 1:
            return held.join(go(node.args[0]))
        if method in ("replace", "lower", "upper", "strip", "lstrip", "rstrip", "title", "capitalize", "swapcase", "casefold", "removeprefix", "removesuffix", "encode", "split"):
            return getattr(held, method)(*(go(a) for a in node.args))
        if method == "format":
            fields = [f for _, f, _, _ in string.Formatter().parse(held) if f is not None]
            kinds = {"" if f == "" else "place" if f.isdigit() else "name" for f in fields}
            if any(re.search(r"[.\[]", f) for f in fields) or len(kinds) > 1 or not isinstance(node.func.value, ast.Constant):
                raise Unknown
            return held.format(*(go(a) for a in node.args), **{k.arg: go(k.value) for k in node.keywords if k.arg})
        if method == "format_map" and len(node.args) == 1:
            return held.format_map(go(node.args[0]))
        raise Unknown

    # --- second pass: findings ---------------------------------------------

    def findings(self) -> Iterator[Row]:
        nodes = list(ast.walk(self.tree))
        inner: set[int] = set()
        for n in nodes:
            if isinstance(n, ast.Call):
                yield from self._calls(n)
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield from self._decorators(n)
            if isinstance(n, ast.Attribute):
                yield from self._dunders(n, inner)
            yield from self._literal(n)
        yield from self._pieces(nodes)
        for n in nodes:
            if isinstance(n, ast.Call):
                yield from self._options(n)
        for n in nodes:
            if isinstance(n, ast.Call):
                yield from self._indirect(n)
        for n in nodes:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and rotates(n):
                yield "OBFS-001", "high", n.lineno, f"def {n.name}", "A function turns letters by a fixed number"

    def _calls(self, n: ast.Call) -> Iterator[Row]:
        name = self.dotted(n.func)
        key = {k.arg: k.value for k in n.keywords if k.arg}
        if name in RUNS:
            yield "EXEC-002", "critical", n.lineno, f"{name}(", f"A call of {name} runs code"
        elif name and name.startswith("subprocess.") and isinstance(key.get("shell"), ast.Constant) and key["shell"].value is True:
            yield "EXEC-002", "critical", n.lineno, f"{name}(shell=True)", "A command runs in a shell"
        if name in IMPORTS:
            yield "EXEC-006", "high", n.lineno, f"{name}(", f"A call of {name} chooses a module"
        loader = key.get("Loader", n.args[1] if len(n.args) > 1 else None)
        safe = loader is not None and (self.dotted(loader) or "").rpartition(".")[2] in ("SafeLoader", "CSafeLoader")
        if name in LOADS or (name == "yaml.load" and not safe):
            yield "EXEC-007", "critical", n.lineno, f"{name}(", f"A call of {name} makes objects of untrusted bytes"
        if name == "getattr" and len(n.args) >= 2:
            made = self._text(n.args[1], None)
            if made in NAMES:
                yield "EXEC-006", "high", n.lineno, f"getattr(..., '{made}')", f"getattr takes {made}"
        if isinstance(n.func, ast.Attribute) and self.call_name(n.func.value) in IMPORTS and n.func.attr in REF_CALLS:
            yield "EXEC-002", "critical", n.lineno, f"{self.call_name(n.func.value)}(...).{n.func.attr}(", "A module is imported and called at once"
        yield from self._rotations(n, name)
        if name in RUNNERS and n.args and isinstance(n.args[0], ast.List) and n.args[0].elts:
            words = [e.value if isinstance(e, ast.Constant) and isinstance(e.value, str) else None for e in n.args[0].elts]
            tool = (words[0] or "").rpartition("/")[2]
            if tool in TOOLS and (tool != "nc" or NC_FLAGS & set(words[1:])):
                yield "EXFIL-008", "critical", n.lineno, f"{name}(['{words[0]}', ...])", f"{tool} is run by {name}"
        if name == "socket.getaddrinfo" and n.args and not (isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str)):
            yield "EXFIL-006", "critical", n.lineno, f"{name}(<dynamic>, ...)", "A host name is made from data"

    def _rotations(self, n: ast.Call, name: str | None) -> Iterator[Row]:
        said = lambda e: e.value.lower() if isinstance(e, ast.Constant) and isinstance(e.value, str) else ""
        how = ""
        if name in ("codecs.decode", "codecs.encode") and len(n.args) > 1:
            how = said(n.args[1])
        elif name in ("codecs.decode", "codecs.encode"):
            how = next((said(k.value) for k in n.keywords if k.arg == "encoding"), "")
        elif name in ("codecs.lookup", "codecs.getencoder", "codecs.getdecoder") and n.args:
            how = said(n.args[0])
        elif isinstance(n.func, ast.Attribute) and n.func.attr in ("encode", "decode") and n.args:
            how = said(n.args[0])
        if how in ROT:
            yield "OBFS-001", "high", n.lineno, f"{name or n.func.attr}(..., '{how}')", "Text is turned by 13 letters"
        if (name == "str.maketrans" or name == "maketrans") and len(n.args) >= 2:
            a, b = self._text(n.args[0], None), self._text(n.args[1], None)
            if a and b and len(a) == len(b) and set(string.ascii_letters.lower()) <= set(a.lower()) and all(turned(x) == y for x, y in zip(a, b, strict=True) if x.isascii() and x.isalpha()):
                yield "OBFS-001", "high", n.lineno, "str.maketrans(<rot13>)", "A table turns letters by 13"

    def _decorators(self, n: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) -> Iterator[Row]:
        for d in n.decorator_list:
            name = self.dotted(d)
            base, _, last = (name or "").rpartition(".")
            if last in NAMES and (base in ("builtins", "__builtins__") or not base):
                yield NAMES[last], SEVERITY[NAMES[last]], d.lineno, f"@{last} decorator", f"{last} is applied as a decorator"

    def _dunders(self, n: ast.Attribute, inner: set[int]) -> Iterator[Row]:
        if id(n) in inner or n.attr not in CLIMB | ESCAPE:
            return
        chain, at = [], n
        while isinstance(at, (ast.Attribute, ast.Subscript, ast.Call)):
            if isinstance(at, ast.Attribute):
                if at.attr in CLIMB | ESCAPE:
                    chain.append((at.attr, id(at)))
                elif not (len(at.attr) > 4 and at.attr.startswith("__") and at.attr.endswith("__")):
                    break
            at = at.func if isinstance(at, ast.Call) else at.value
        if len(chain) >= 2:
            inner.update(i for _, i in chain[1:])
            out = any(a in ESCAPE for a, _ in chain)
            yield "EXEC-011", "critical" if out else "high", n.lineno, ".".join(a for a, _ in reversed(chain)), "A chain of dunder attributes" + (" leads to code" if out else "")

    def _text(self, node: ast.AST, scope: str | None) -> str | None:
        try:
            made = self.value(node, scope)
        except (Unknown, TypeError, ValueError):
            return None
        return made if isinstance(made, str) else None

    def _literal(self, n: ast.AST) -> Iterator[Row]:
        plain = isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add)
        plain = plain or (isinstance(n, ast.Call) and (self.dotted(n.func) == "chr" or (isinstance(n.func, ast.Attribute) and n.func.attr in ("join", "decode"))))
        if plain and (made := self._text(n, None)) in NAMES:
            yield "EXEC-002", "critical", n.lineno, f"string evasion building '{made}'", f"Literals make {made}"

    def _pieces(self, nodes: list[ast.AST]) -> Iterator[Row]:
        """Texts put together from variables and calls; what is part of a match isn't one itself."""
        used: set[int] = set()
        for n in nodes:
            if id(n) in used or not isinstance(n, (ast.BinOp, ast.JoinedStr, ast.Call, ast.Subscript)):
                continue
            scope = self.scopes.get(id(n), "")
            row = self._dispatch(n, scope) if isinstance(n, ast.Subscript) else None
            if row is None and isinstance(n, ast.BinOp) and not isinstance(n.op, (ast.Add, ast.Mod)):
                continue
            made = self._text(n, scope) if row is None else None
            if made is not None:
                row = self._assembled(n, made)
            if row is not None:
                used.update(id(c) for c in ast.walk(n) if c is not n)
                yield row

    def _assembled(self, n: ast.AST, made: str) -> Row | None:
        if made in NAMES:
            rule = NAMES[made]
            return rule, SEVERITY[rule], n.lineno, f"split variable evasion building '{made}'", f"Pieces make {made}"
        for _, kind, text in payloads(made):
            plain = decode(kind, text)
            for name in NAMES:
                if plain is not None and re.search(rf"\b{re.escape(name)}\b", plain):
                    return "EXEC-002", "critical", n.lineno, f"split encoded evasion: decoded '{name}'", f"Pieces make a text that decodes to {name}"
        return None

    def _dispatch(self, n: ast.Subscript, scope: str) -> Row | None:
        key, base = self._text(n.slice, scope), n.value
        if key not in NAMES:
            return None
        if isinstance(base, ast.Subscript):
            base = base.value
        named = self.call_name(base) in ("globals", "locals", "vars") or (isinstance(base, ast.Attribute) and base.attr == "__dict__")
        if not named:
            return None
        return NAMES[key], SEVERITY[NAMES[key]], n.lineno, f"dynamic dispatch ['{key}']", f"{key} is taken from a name space"

    def _options(self, n: ast.Call) -> Iterator[Row]:
        name = self.dotted(n.func) or ""
        if not name.startswith("subprocess."):
            return
        for k in n.keywords:
            if k.arg is None:
                try:
                    held = self.value(k.value, self.scopes.get(id(n), ""))
                except Unknown:
                    continue
                if isinstance(held, dict) and held.get("shell"):
                    yield "EXEC-002", "critical", n.lineno, f"{name}(**{{'shell': ...}})", "A command runs in a shell by unpacked options"

    def _indirect(self, n: ast.Call) -> Iterator[Row]:
        scope = self.scopes.get(id(n), "")
        if self.dotted(n.func) == "getattr" and len(n.args) >= 2 and isinstance(n.args[1], ast.Name):
            made = self._text(n.args[1], scope)
            if made in NAMES:
                yield "EXEC-006", "high", n.lineno, f"getattr(..., {n.args[1].id}='{made}')", f"getattr takes {made} by a variable"
            elif made is None:
                of = n.args[0].value if isinstance(n.args[0], ast.Attribute) else n.args[0]
                module = self.alias.get(of.id, of.id) if isinstance(of, ast.Name) else None
                if module in SENSITIVE:
                    yield "EXEC-006", "medium", n.lineno, f"getattr({module}, {n.args[1].id})", f"getattr on {module} by an unknown name"
        f = n.func
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and (of := self.ref(f.value, scope)) and f.attr in REF_CALLS:
            yield "EXEC-002", "critical", n.lineno, f"{of}.{f.attr}(", "A module that was imported at run time is called"
        elif isinstance(f, ast.Call) and self.dotted(f.func) == "getattr" and (of := self._module(f, scope)):
            yield "EXEC-002", "critical", n.lineno, f"{of}(", "What getattr takes of a module is called"
        elif isinstance(f, ast.Name) and (of := self.ref(f, scope)) and "." in of and of.rpartition(".")[2] in REF_CALLS:
            yield "EXEC-002", "critical", n.lineno, f"{of}(", "What getattr took of a module is called"


def turned(c: str) -> str:
    base = 65 if c.isupper() else 97
    return chr((ord(c) - base + 13) % 26 + base)


def rotates(f: ast.FunctionDef | ast.AsyncFunctionDef) -> bool:
    """Whether a function has chr, ord and a remainder by 26, for capitals and small letters: rotation by any number."""
    calls = {n.func.id for n in ast.walk(f) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    numbers = {n.value for n in ast.walk(f) if isinstance(n, ast.Constant) and isinstance(n.value, int)}
    texts = {n.value for n in ast.walk(f) if isinstance(n, ast.Constant) and isinstance(n.value, str)}
    wraps = any(isinstance(n, ast.BinOp) and isinstance(n.op, ast.Mod) and isinstance(n.right, ast.Constant) and n.right.value == 26 for n in ast.walk(f))
    cases = ({65, 97} <= numbers) or ({"a", "A"} <= texts) or ({97} <= numbers and "A" in texts) or ({65} <= numbers and "a" in texts)
    return {"chr", "ord"} <= calls and wraps and cases


def analyze(text: str) -> list[Row]:
    """The findings of a source; one that can't be read or is too deep says so itself."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [("AST-PARSE", "info", None, "", "The source can't be parsed")]
    rows: list[Row] = []
    try:
        for row in Source(tree).findings():
            rows.append(row)
    except RecursionError:
        rows.append(("AST-DEPTH", "info", None, "", "The source is nested too deeply"))
    return rows


def analyzed(text: str) -> list[dict]:
    """The findings of a source with their fields by name."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return [
            {"ord": i, "rule_id": rule, "severity": severity, "category": CATEGORY.get(rule, "malicious-code"), "line": line, "matched_text": matched, "description": said, "recommendation": "Write it plainly or remove it"}
            for i, (rule, severity, line, matched, said) in enumerate(analyze(text))
        ]


@F.arrow_udf(FOUND)
def _analyzed(texts: pa.Array) -> pa.Array:
    return pa.array([analyzed(t) if t is not None else [] for t in texts.to_pylist()], FOUND_ARROW)


def analyze_column(text: Column | str) -> Column:
    """array<struct> column: findings of Python sources; empty for null."""
    return _analyzed(text)
