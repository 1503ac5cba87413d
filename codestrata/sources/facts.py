"""One job that parses files into facts: a tagged row for each syntax node, definition, import, use, call, base, export or failure."""

from __future__ import annotations

import ast
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = (
    "tag string, repo string, path string, nid int, scope int, kind string, name string, module string, asname string, level int, line int, col int, end_line int, end_col int,"
    " fn_path array<int>, nest_cog int, nest_all int, bool_n int, n_params int, is_top boolean, decorated boolean, annotated boolean, role string, attr string, args array<string>, text string,"
    " scopes array<int>, name_line int, name_col int, mod_col int, mod_end int, returns string, snippet string, parent int, last int, near int, places int, caller string"
)
TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
SCHEMA = pa.schema([(name, TYPES[kind]) for name, kind in (f.split() for f in FIELDS.split(","))])
TAGS = ("file", "node", "def", "param", "base", "export", "import", "use", "attr", "call", "body", "typed", "failure")
#: Tags that are told only where they are asked for: written names (rows of tag use) without those read, and calls by what they may lead to.
FEWER = ("write", "called")
#: Node kinds that add to cognitive complexity by their depth, and those that nest.
COG = ("If", "While", "For", "AsyncFor", "ExceptHandler")
NEST = (*COG, "With", "AsyncWith", "Try")
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
SCOPES = (*FUNCTIONS, *COMPREHENSIONS, ast.ClassDef, ast.Module, ast.Lambda)
PLAIN = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)
#: Node types with nothing below them, and of each type the fields that may hold other nodes than PLAIN ones.
LEAVES = frozenset((ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal))
SAYING = ("id", "ctx", "op", "ops", "attr", "kind", "level", "module", "asname", "conversion", "is_async", "simple", "type_comment", "rest", "kwd_attrs", "tag")
INNER = {t: tuple(f for f in t._fields if f not in SAYING) for t in vars(ast).values() if isinstance(t, type) and issubclass(t, ast.AST) and not issubclass(t, ast.Constant)}
#: Node types that bind or declare names, and those whose children lie in other scopes or roles than they do themselves.
NOTED = frozenset((*FUNCTIONS, ast.ClassDef, ast.Global, ast.Nonlocal, ast.Name, ast.ExceptHandler, ast.MatchAs, ast.MatchStar, ast.arg, ast.alias))
APART = frozenset((*SCOPES, ast.NamedExpr, ast.arguments, ast.comprehension, ast.TypeAlias, ast.AnnAssign))
#: Node types that facts of these tags come from, besides the file itself; all tell of a "node".
BINDING = (*FUNCTIONS, ast.ClassDef, ast.Lambda, ast.Assign, ast.AnnAssign)
TOLD = {
    "def": BINDING, "param": (*FUNCTIONS, ast.Lambda), "base": (ast.ClassDef,), "export": (ast.Assign, ast.AnnAssign), "import": (ast.Import, ast.ImportFrom), "body": FUNCTIONS,
    "use": (*FUNCTIONS, ast.ClassDef, ast.TypeAlias, ast.Name, ast.Constant, ast.ExceptHandler, ast.MatchAs, ast.MatchStar, ast.MatchMapping), "attr": (ast.Constant, ast.Attribute), "call": (ast.Call,), "typed": BINDING,
    "write": (*FUNCTIONS, ast.ClassDef, ast.TypeAlias, ast.Name, ast.ExceptHandler, ast.MatchAs, ast.MatchStar, ast.MatchMapping), "called": (ast.Call,),
}
TELLING = frozenset(kind for kinds in TOLD.values() for kind in kinds)
#: Tags of what binds names.
BINDS = frozenset(("def", "param", "use", "write", "import"))
FROM = re.compile(r"from\s*(\.[.\w]*|(?<=\s)[.\w]+)(?=\s+import\b)")
HEAD = re.compile(r"(?:async\s+)?def\s+|class\s+")


def module_name(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    parts = parts[1:] if parts[0] in ("src", "lib") and len(parts) > 1 else parts
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def _failure(error: Exception) -> dict:
    return {"tag": "failure", "text": str(getattr(error, "msg", None) or error), "line": max(0, (getattr(error, "lineno", 1) or 1) - 1), "col": max(0, (getattr(error, "offset", 1) or 1) - 1)}


def file_facts(repo: str, path: str, content: str, tags: tuple[str, ...] = TAGS) -> list[dict]:
    """Facts of one file, of the tags asked for; lines and columns are 0-based and columns count characters. A file that can't
    be parsed, or whose syntax is too deep to walk, gives one failure and nothing else.

    scopes: the scopes whose names a use sees, from the inside out; a class's own names are seen in its body only, and a name
    declared global is seen at the top only. scope: the one that a definition, parameter, import or written name is bound in
    (for names declared global or nonlocal, and for := within comprehensions, not the one around it). Modules, functions,
    classes, lambdas and comprehensions are scopes by their nid, and so are type parameters (by -2 - nid of what has them).
    Nodes are numbered from the top as they are met, so what is within a node has the numbers after its own up to `last`.
    called: a call within a function (caller: its name) by a name, or by an attribute `name` of what `text` says.
    """
    base = {"repo": repo, "path": path, "module": module_name(path)}
    try:
        if content is None:
            raise ValueError("no content")
        return _Reader(base, content, frozenset(tags)).rows()
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError) as e:
        return [base | _failure(e)] if "failure" in tags else []


class _Source:
    """Lines of a text, and columns in characters for the parser's columns in bytes."""

    def __init__(self, content: str) -> None:
        self.lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.ascii = content.isascii()
        self.tables: dict[int, list[int]] = {}

    def column(self, line: int, col: int) -> int:
        """line from 1."""
        if self.ascii:
            return col
        text = self.lines[line - 1] if 0 < line <= len(self.lines) else ""
        if text.isascii():
            return col
        if line not in self.tables:
            self.tables[line] = [k for k, c in enumerate(text) for _ in range(len(c.encode(errors="surrogatepass")))] + [len(text)]
        table = self.tables[line]
        return table[min(col, len(table) - 1)]

    def start(self, node) -> tuple[int, int]:
        return node.lineno - 1, self.column(node.lineno, node.col_offset)

    def end(self, node) -> tuple[int, int]:
        return node.end_lineno - 1, self.column(node.end_lineno, node.end_col_offset)

    def between(self, at: tuple[int, int], to: tuple[int, int]) -> str:
        if at[0] == to[0]:
            return self.lines[at[0]][at[1] : to[1]]
        return "\n".join([self.lines[at[0]][at[1] :], *self.lines[at[0] + 1 : to[0]], self.lines[to[0]][: to[1]]])

    def text(self, node) -> str:
        """What a node says; dotted names without blanks, other code as written."""
        return dotted(node) or self.between(self.start(node), self.end(node))

    def find(self, pattern: str, at: tuple[int, int], to: tuple[int, int], last: bool = False) -> tuple[int, int] | None:
        """Where the first (or last) match's group 1 begins."""
        found = list(re.finditer(pattern, self.between(at, to)))
        if not found:
            return None
        before = self.between(at, to)[: found[-last].start(1)]
        return (at[0] + before.count("\n"), len(before) - before.rfind("\n") - 1) if "\n" in before else (at[0], at[1] + len(before))


def dotted(node) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def shape(nodes: list) -> str:
    """The syntax of nodes with variables and parameters blanked; walks with a stack, so depth does not matter."""
    out, stack = [], list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, ast.Name):
            out.append(f"Name {type(x.ctx).__name__} ")
        elif isinstance(x, ast.arg):
            out.append("arg ")
        elif isinstance(x, list):
            stack += ["]", *reversed(x), "["]
        elif isinstance(x, ast.AST):
            stack += [")", *(y for field, value in reversed(list(ast.iter_fields(x))) for y in (value if isinstance(value, (ast.AST, list)) else _told(value), field + "=")), type(x).__name__ + "("]
        else:
            out.append(_told(x))
    return "".join(out)


def _told(value) -> str:
    return (hex(value) if isinstance(value, int) and abs(value) > 1 << 64 else repr(value)) + " "


class _Reader:
    """Two walks over a file's syntax: the first finds every node's scope and what each scope binds, the second tells the facts."""

    def __init__(self, base: dict, content: str, wanted: frozenset[str]) -> None:
        self.base, self.wanted, self.source, self.out = base, wanted, _Source(content), []
        self.tree = ast.parse(content)
        self.classes: set[int] = set()
        self.comprehensions: set[int] = set()
        self.sees: dict[int, tuple[int, ...]] = {}
        self.global_: dict[int, set[str]] = {}
        self.nonlocal_: dict[int, set[str]] = {}
        self.binds: dict[int, set[str]] = {}
        self.outside: dict[int, tuple] = {}
        self.values: set[int] = set()

    def rows(self) -> list[dict]:
        self.visits = visits = self.walk()
        self.last = last = list(range(len(visits)))
        for nid in range(len(visits) - 1, 0, -1):
            parent = visits[nid][2]
            if last[nid] > last[parent]:
                last[parent] = last[nid]
        told, every = frozenset(kind for tag in self.wanted for kind in TOLD.get(tag, ())), "node" in self.wanted
        for visit in visits:
            # of constants only those in annotations tell something
            if every or not visit[0] or type(visit[1]) in told and (visit[8] == "annotation" or type(visit[1]) is not ast.Constant):
                self.tell(*visit)
        return self.out

    def walk(self) -> list[tuple]:
        """(nid, node, parent nid, scope, scopes seen, functions around, nesting of two kinds, place in its statement)"""
        stack: list[tuple] = [(self.tree, -1, -1, (), (), 0, 0, "")]
        visits: list[tuple] = []
        while stack:
            visit = stack.pop()
            node, parent, scope, seen, fns, cog, all_, role = visit
            nid, t = len(visits), type(node)
            visits.append((nid, *visit))
            if t is ast.Name:
                if type(node.ctx) is not ast.Load:
                    self.note(node, scope)
                continue
            if t in NOTED:
                self.note(node, scope)
            if t in LEAVES:
                continue
            if t not in APART or t is ast.arguments and not node.defaults and not node.kw_defaults:
                if t is ast.Subscript:
                    self.values.update(id(x) for x in self.said(node))
                tail = (nid, scope, seen, fns, cog + (t.__name__ in COG), all_ + (t.__name__ in NEST), "annotation" if role == "annotation" or t is ast.arg else "")
                children = []
                for field in INNER[t]:
                    value = getattr(node, field, None)
                    if type(value) is list:
                        children += [(x, *tail) for x in value if isinstance(x, ast.AST)]
                    elif t is ast.Call and field == "func":
                        children.append((value, *tail[:-1], tail[-1] or "call"))
                    elif isinstance(value, ast.AST):
                        children.append((value, *tail))
                children.reverse()
                stack += children
                continue
            kind = t.__name__
            is_function, is_class = isinstance(node, FUNCTIONS), isinstance(node, ast.ClassDef)
            # what is in a class's functions, classes and comprehensions does not see the class's own names
            around = seen[1:] if seen and seen[0] in self.classes else seen
            typed = getattr(node, "type_params", None)
            types = ((-2 - nid, *seen), -2 - nid) if typed else (seen, scope)
            if typed:
                self.sees[-2 - nid] = types[0]
            if isinstance(node, SCOPES):
                inner_scope, inner = nid, (nid, *(types[0] if typed and not around != seen else (-2 - nid, *around) if typed else around))
                self.sees[nid] = inner
            else:
                inner_scope, inner = scope, seen
            if is_class:
                self.classes.add(nid)
            if isinstance(node, COMPREHENSIONS):
                self.comprehensions.add(nid)
                self.outside[id(node.generators[0])] = (scope, seen)
            if isinstance(node, (*FUNCTIONS, ast.Lambda)):
                self.outside[id(node.args)] = (scope, seen)
            out = self.outside.get(id(node))
            inner_cog, inner_all = cog + (kind in COG), all_ + (kind in NEST)
            children = []
            for field, value in ast.iter_fields(node):
                said = "decorator" if field == "decorator_list" else "annotation" if field in ("annotation", "returns") or role == "annotation" else "base" if is_class and field == "bases" else ""
                if field == "body" and isinstance(node, SCOPES) or isinstance(node, COMPREHENSIONS):
                    own = inner_scope, inner
                elif isinstance(node, ast.NamedExpr) and field == "target":
                    own = next((x for x in (scope, *seen) if x not in self.comprehensions), scope), seen  # binds in what is around a comprehension
                elif out and (field in ("defaults", "kw_defaults") or isinstance(node, ast.comprehension) and field == "iter"):
                    own = out  # read outside of what they belong to, like decorators
                elif typed and field != "decorator_list" and not (isinstance(node, ast.TypeAlias) and field == "name"):
                    own = types[1], types[0]
                else:
                    own = scope, seen
                children += [(x, nid, *own, (*fns, nid) if is_function else fns, inner_cog, inner_all, said) for x in (value if isinstance(value, list) else [value]) if isinstance(x, ast.AST) and not isinstance(x, PLAIN)]
            stack.extend(reversed(children))
        return visits

    def note(self, node, scope: int) -> None:
        """What a node binds or declares in its scope, as far as nonlocal names need it."""
        if isinstance(node, ast.Global):
            self.global_.setdefault(scope, set()).update(node.names)
        elif isinstance(node, ast.Nonlocal):
            self.nonlocal_.setdefault(scope, set()).update(node.names)
        elif isinstance(node, ast.Name) and not isinstance(node.ctx, ast.Load):
            self.binds.setdefault(scope, set()).add(node.id)
        elif isinstance(node, (*FUNCTIONS, ast.ClassDef)) or isinstance(node, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and node.name:
            self.binds.setdefault(scope, set()).add(node.name)
        elif isinstance(node, ast.arg):
            self.binds.setdefault(scope, set()).add(node.arg)
        elif isinstance(node, ast.alias):
            self.binds.setdefault(scope, set()).add(node.asname or node.name.split(".")[0])

    def home(self, name: str, scope: int) -> int:
        """The scope that a name written in `scope` belongs to."""
        if name in self.global_.get(scope, ()):
            return 0
        if name in self.nonlocal_.get(scope, ()):
            for s in self.sees.get(scope, ())[1:]:
                if s > 0 and s not in self.classes and name in self.binds.get(s, ()) and name not in self.nonlocal_.get(s, ()):
                    return s
        return scope

    def visible(self, name: str, seen: tuple[int, ...]) -> list[int]:
        for k, s in enumerate(seen if self.global_ else ()):
            if name in self.global_.get(s, ()):
                return [*seen[:k], 0]
        return list(seen)

    def add(self, tag: str, row: dict, **more) -> None:
        if tag in self.wanted:
            self.out.append({**row, "tag": "use" if tag == "write" else tag, **more})

    def write(self, row: dict, name: str, scope: int, seen: tuple[int, ...], at: tuple[int, int], role: str, name_at: tuple[int, int] | None = None) -> None:
        """at: where the binding is; name_at: where its name is, if that is elsewhere."""
        where = name_at or at
        self.add("use" if "use" in self.wanted else "write", {**row, "line": at[0], "col": at[1]}, name=name, kind="write", role=role, scope=self.home(name, scope), scopes=list(seen), name_line=where[0], name_col=where[1])

    @staticmethod
    def said(node: ast.Subscript) -> list:
        """The parts of a subscript that are values even in an annotation: all of Literal's, and Annotated's but for the first."""
        head = (dotted(node.value) or "").rpartition(".")[2]
        parts = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        return parts if head == "Literal" else parts[1:] if head == "Annotated" else []

    def quoted(self, node) -> tuple[ast.AST, _Source, tuple[int, int]] | None:
        """The expression in a string of an annotation, its own source and where that begins; only plain strings of one line."""
        if not isinstance(node.value, str) or "\n" in node.value or self.source.text(node)[1:-1] != node.value:
            return None
        try:
            at = self.source.start(node)
            return ast.parse(node.value, mode="eval").body, _Source(node.value), (at[0], at[1] + 1)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None

    def types(self, node) -> list[tuple[ast.AST, int, int]]:
        """The names in an annotation, and where they are (of m.C, where C is); names in strings included, values left out."""
        out, stack = [], [(node, self.source, (0, 0))]
        while stack:
            x, source, at = stack.pop()
            if isinstance(x, ast.Name) or dotted(x):
                line, col = source.start(x) if isinstance(x, ast.Name) else source.end(x)
                col -= 0 if isinstance(x, ast.Name) else len(x.attr)
                out.append((x, at[0] + line, at[1] + col))
            elif isinstance(x, ast.Constant):
                inner = self.quoted(x) if source is self.source else None
                stack += [inner] if inner else []
            else:
                left_out = self.said(x) if isinstance(x, ast.Subscript) else ()
                inside = [x.value, *(x.slice.elts if isinstance(x.slice, ast.Tuple) else [x.slice])] if isinstance(x, ast.Subscript) else list(ast.iter_child_nodes(x))
                stack += [(y, source, at) for y in reversed(inside) if y not in left_out]
        return out

    def name_at(self, node) -> dict:
        """The place of the name that an expression ends with: of f, and of the f of m.f."""
        if isinstance(node, ast.Name):
            line, col = self.source.start(node)
        elif isinstance(node, ast.Attribute):
            line, col = self.source.end(node)
            col -= len(node.attr)
        else:
            return {}
        return {"name_line": line, "name_col": col}

    def typed(self, row: dict, name: str, annotation, at: tuple[int, int]) -> None:
        """A row for each name in the annotation of what is at a place: line and col are that place, name_line and name_col the name's."""
        if annotation is not None and "typed" in self.wanted:
            for x, line, col in self.types(annotation):
                self.add("typed", {**row, "line": at[0], "col": at[1]}, name=name, attr=dotted(x), text=self.source.text(annotation), name_line=line, name_col=col)

    def tell(self, nid, node, parent, scope, seen, fns, cog, all_, role) -> None:
        source, wanted, t = self.source, self.wanted, type(node)
        if t is ast.Name and type(node.ctx) is ast.Load and "use" not in wanted and "node" not in wanted:
            return
        if hasattr(node, "lineno"):
            start, end = ((node.lineno - 1, node.col_offset), (node.end_lineno - 1, node.end_col_offset)) if source.ascii else (source.start(node), source.end(node))
        else:
            start, end = (0, 0), (len(source.lines) - 1, 0)
        row = {**self.base, "nid": nid, "parent": parent, "last": self.last[nid], "scope": scope, "is_top": parent == 0, "line": start[0], "col": start[1], "end_line": end[0], "end_col": end[1]}
        is_function, is_class = t in FUNCTIONS, t is ast.ClassDef
        a = node.args if is_function or t is ast.Lambda else None
        params = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])] if a else []
        if nid == 0:
            self.add("file", row)
        if "node" in wanted:
            name = getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None)
            caught = node.type.id if isinstance(node, ast.ExceptHandler) and isinstance(node.type, ast.Name) else None
            self.add("node", row, kind=t.__name__, name=name if isinstance(name, str) else None, fn_path=list(fns), nest_cog=cog, nest_all=all_, bool_n=len(node.values) if isinstance(node, ast.BoolOp) else None, n_params=len(params) if is_function else None, role=role, attr=caught)
        if t is ast.Name:
            if type(node.ctx) is ast.Load:
                self.add("use", row, name=node.id, kind="read", role=role, scopes=self.visible(node.id, seen), name_line=start[0], name_col=start[1])
            else:
                self.write(row, node.id, scope, seen, start, role)
            return
        if t not in TELLING:
            return
        if is_function or is_class:
            head = HEAD.match(source.lines[node.lineno - 1], row["col"])
            names = [p.arg for p in params]
            returns = source.text(node.returns) if is_function and node.returns else None
            self.add("def", row, scope=self.home(node.name, scope), kind="class" if is_class else "function", name=node.name, decorated=bool(node.decorator_list), annotated=returns is not None, n_params=len(params), attr=", ".join(names), args=names, returns=returns, name_line=row["line"], name_col=head.end() if head else row["col"], scopes=[nid])
            if is_function and "body" in wanted:
                self.add("body", row, name=node.name, text=shape(node.body))
            for b in getattr(node, "bases", []):
                named = b.value if isinstance(b, ast.Subscript) else b  # Base[T] is a Base
                self.add("base", row, name=node.name, attr=source.text(b), **self.name_at(named))
        for p in getattr(node, "type_params", None) or ():
            at = source.start(p)
            stars = len(re.match(r"\**\s*", source.lines[at[0]][at[1] :])[0])
            self.write(row, p.name, -2 - nid, (), (at[0], at[1] + stars), "type")
        if a:
            own = 1 if is_function and params and params[0].arg in ("self", "cls") and params[0] in (*a.posonlyargs[:1], *a.args[:1]) else 0
            counted = [p for k, p in enumerate([*a.posonlyargs, *a.args, *a.kwonlyargs]) if k >= own] if is_function else []
            for p in params:
                at = source.start(p)
                self.add("param", {**row, "scope": nid}, name=p.arg, annotated=p.annotation is not None, attr=source.text(p.annotation) if p.annotation else None, role="" if p in counted else "uncounted", name_line=at[0], name_col=at[1])
                self.typed(row, p.arg, p.annotation, at)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            first = next((t for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name)), None)
            if first is not None:
                at = source.start(first)
                self.add("def", row, scope=self.home(first.id, scope), kind="variable", name=first.id, decorated=False, annotated=isinstance(node, ast.AnnAssign), returns=source.text(node.annotation) if isinstance(node, ast.AnnAssign) else None, name_line=at[0], name_col=at[1])
                self.typed(row, first.id, getattr(node, "annotation", None), at)
                if first.id == "__all__" and parent == 0 and isinstance(node.value, (ast.List, ast.Tuple)):
                    self.add("export", row, name=None)  # says that there is a list, though it may be empty
                    for x in node.value.elts:
                        if isinstance(x, ast.Constant) and isinstance(x.value, str):
                            at = source.start(x)
                            plain = source.text(x)[1:-1] == x.value
                            self.add("export", row, name=x.value, name_line=at[0] if plain else None, name_col=at[1] + 1 if plain else None)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            is_from = isinstance(node, ast.ImportFrom)
            named = FROM.match(source.lines[node.lineno - 1], row["col"]) if is_from else None
            for x in node.names:
                bound, at = x.asname or (x.name if is_from else x.name.split(".")[0]), source.start(x)
                self.add("import", row, scope=self.home(bound, scope), text=(node.module or "") if is_from else x.name, name=x.name if is_from else None, asname=bound, level=(node.level or 0) if is_from else 0, kind="from" if is_from else "import", role="" if x.asname is None else "renamed", name_line=at[0], name_col=at[1], mod_col=named.start(1) if named else None, mod_end=named.end(1) if named else None)
        elif isinstance(node, ast.Constant) and role == "annotation" and isinstance(node.value, str) and id(node) not in self.values and self.wanted & {"use", "attr"}:
            # names in strings are read where the annotation is
            for x, line, col in self.types(node):
                first = x
                while isinstance(first, ast.Attribute):
                    first = first.value
                here = {**row, "line": line, "col": col if x is first else col + len(x.attr) - len(dotted(x))}
                self.add("use", here, name=first.id, kind="read", role=role, text="quoted", scopes=self.visible(first.id, seen), name_line=line, name_col=here["col"])
                if x is not first:
                    self.add("attr", here, name=x.attr, text=dotted(x.value), kind="read", role=role, scopes=self.visible(first.id, seen), name_line=line, name_col=col)
        elif isinstance(node, ast.ExceptHandler) and node.name:
            at = source.find(rf"\bas\s+({re.escape(node.name)})\b", source.end(node.type), source.start(node.body[0])) if node.type else None
            self.write(row, node.name, scope, seen, start, "handler", at)
        elif isinstance(node, (ast.MatchAs, ast.MatchStar)) and node.name:
            self.write(row, node.name, scope, seen, (end[0], end[1] - len(node.name)), "capture")
        elif isinstance(node, ast.MatchMapping) and node.rest:
            self.write(row, node.rest, scope, seen, source.find(rf"\*\*\s*({re.escape(node.rest)})\b", start, end, last=True) or start, "capture")
        elif isinstance(node, ast.Attribute) and "attr" in wanted and isinstance(node.value, (ast.Name, ast.Attribute)):
            self.add("attr", row, name=node.attr, text=source.text(node.value), kind="read" if isinstance(node.ctx, ast.Load) else "write", role=role, scopes=self.visible((dotted(node) or "").partition(".")[0], seen), name_line=row["end_line"], name_col=row["end_col"] - len(node.attr))
        elif isinstance(node, ast.Call):
            f = node.func
            member = isinstance(f, ast.Attribute) and isinstance(f.value, (ast.Name, ast.Attribute))
            if "called" in wanted and fns and (member or isinstance(f, ast.Name)):
                head = (dotted(f) or "").partition(".")[0]
                self.add("called", row, name=f.attr if member else f.id, text=source.text(f.value) if member else None, caller=self.visits[fns[-1]][1].name, scopes=self.visible(head, seen))
            if "call" not in wanted:
                return
            shown = [source.text(x) for x in node.args] + [f"{k.arg}={source.text(k.value)}" if k.arg else f"**{source.text(k.value)}" for k in node.keywords]
            self.add("call", row, **self.name_at(f), kind="plain" if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else "", name=f.id if isinstance(f, ast.Name) else None, text=source.text(f.value) if isinstance(f, ast.Attribute) else None, attr=f.attr if isinstance(f, ast.Attribute) else None, args=shown, fn_path=list(fns), scopes=list(seen), snippet=source.lines[node.lineno - 1].strip())


def _bound(rows: list[dict]) -> None:
    """Tells of a file's rows, which are all there: places on the first one that binds a name in a scope, and near on those that read
    one. kind of a called name, or of an attribute's first: function, if the file's own function is called by its name, import, or star, which
    may bring it; other calls lead to no function that is known, and have none."""
    first: dict[tuple, tuple] = {}
    at: dict[tuple, set] = {}
    for r in rows:
        tag, name = r["tag"], r.get("name")
        if tag == "use" and r["kind"] == "write":
            place = r["line"], r["col"], "write"
        elif tag == "param" or tag == "def" and r["kind"] != "variable" or tag == "import" and name != "*":
            place = r["name_line"], r["name_col"], tag
        else:
            continue
        key = r["scope"], r["asname"] if tag == "import" else name
        at.setdefault(key, set()).add(place)
        if key not in first or place < first[key][0]:
            first[key] = place, r
    for key, (_, r) in first.items():
        r["places"] = len(at[key])
    star = any(r["tag"] == "import" and r["name"] == "*" for r in rows)
    for r in rows:
        tag = r["tag"]
        if tag in ("attr", "called") or tag == "use" and r["kind"] == "read":
            name, scopes = r["name"] if tag == "use" or r["text"] is None else r["text"].split(".", 1)[0], r["scopes"]
            r["near"] = near = next((s for s in scopes if (s, name) in first), 0 if 0 in scopes else None)
            if tag == "called":
                by = first.get((near, name), (None, None))[1]
                own = by is not None and by["tag"] == "def" and by["kind"] == "function" and r["text"] is None
                r["kind"] = "function" if own else "import" if by is not None and by["tag"] == "import" else "star" if by is None and star and near == 0 else None


def _outer(rows: list[dict]) -> list[dict]:
    """A file's rows that links between files need; the file's own row only if there is no other."""
    inner = lambda r: r["scope"] != 0 and (r["tag"] in ("def", "param") or r["tag"] == "use" and r["kind"] == "write")
    kept = [r for r in rows if r["tag"] == "failure" or not (r.get("kind") is None if r["tag"] == "called" else r["tag"] == "file" or inner(r))]
    return kept or [r for r in rows if r["tag"] == "file"]


#: Repos that one row of facts names at most on its way out of a task.
TOGETHER = 16


def extract_facts(files: DataFrame, tags: tuple[str, ...] = TAGS, share: int = 1 << 20, columns: tuple[str, ...] | None = None, outer: bool = False) -> DataFrame:
    """The facts of files (repo, path, content) of the tags asked for, in Arrow batches of bounded size. Store them before using them twice.
    columns: those to give, if not all; what only other columns need is not gathered. outer: only what links between files need, so no
    names that are bound within functions and classes, imports apart, no called ones that lead to no function, and a file's own row only
    where it has no other.

    near: the nearest scope of `scopes` that binds the name in the file itself, or else the top, which may get it from a star.
    places: of the first row that binds a name in a scope, the number of places that do. Both go by the tags asked for, so
    names are resolved with all that bind (def, param, use, import).

    Parsing is the dear part, so files are dealt to tasks of about `share` characters each, and to all cores at least, and a file
    that lies in several repos at one path with one content is parsed once.
    """
    fields = {name: kind for name, kind in (f.split() for f in FIELDS.split(","))}
    if unknown := set(tags) - {*TAGS, *FEWER} | set(columns or ()) - set(fields):
        raise ValueError(f"unknown tags or columns {sorted(unknown)}")
    columns = tuple(f for f in fields if columns is None or f in columns)
    inner = tuple(c for c in columns if c != "repo")
    size = files.select(F.sum(F.length("content"))).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, size // share)

    def run(batches):
        rows: list[dict] = []
        for batch in batches:
            for path, content, repos in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "repos"))):
                found = file_facts(None, path, content, tags)
                if BINDS.intersection(tags):
                    _bound(found)
                if outer:
                    found = _outer(found)
                repos = [r["repo"] for r in repos]
                for k in range(0, len(repos), TOGETHER):
                    some = repos[k : k + TOGETHER]
                    rows += [{**r, "repo": some} for r in found] if k else found
                    if not k:
                        for r in found:
                            r["repo"] = some
                    while len(rows) >= 20_000:
                        yield _batch(rows[:20_000], inner)
                        rows = rows[20_000:]
        if rows:
            yield _batch(rows, inner)

    dealt = files.select("repo", "path", "content").repartition(tasks, "path", "content").groupBy("path", "content").agg(F.collect_list(F.struct("repo")).alias("repos"))
    told = dealt.mapInArrow(run, ", ".join(["repos array<string>", *[f"{c} {fields[c]}" for c in inner]]))
    return told.select(*[F.explode("repos").alias("repo") if c == "repo" else c for c in columns] if "repo" in columns else [F.explode("repos").alias("_repo"), *columns]).select(*columns)


def _batch(rows: list[dict], columns: tuple[str, ...]) -> pa.RecordBatch:
    """Rows as a batch, by tag; columns that no row of a tag has are not gathered. A row's repos come first."""
    by_tag: dict[str, list[dict]] = {}
    for r in rows:
        by_tag.setdefault(r["tag"], []).append(r)
    groups = [(group, set().union(*group)) for group in by_tag.values()]
    column = lambda key, kind: pa.concat_arrays([pa.array([r.get(key) for r in group], kind) if key in has else pa.nulls(len(group), kind) for group, has in groups])
    kinds = {"repos": pa.list_(pa.string()), **{c: SCHEMA.field(c).type for c in columns}}
    return pa.RecordBatch.from_arrays([column("repo" if name == "repos" else name, kind) for name, kind in kinds.items()], schema=pa.schema(list(kinds.items())))


def of(facts: DataFrame, tag: str) -> DataFrame:
    return facts.filter(F.col("tag") == tag)


def syntax_errors(facts: DataFrame) -> DataFrame:
    return of(facts, "failure").select("repo", "path", "line", "col", F.col("text").alias("message"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
