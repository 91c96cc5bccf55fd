"""Column functions of changed files: line hunks (difflib) and static facts of Python sources (ast), both in Arrow batches."""

from __future__ import annotations

import ast
import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Function name -> category and the modules it counts from; builtins that execute text.
CALLS = {
    "system": ("process", ("os",)),
    "popen": ("process", ("os",)),
    "Popen": ("process", ("subprocess",)),
    "run": ("process", ("subprocess",)),
    "call": ("process", ("subprocess",)),
    "check_output": ("process", ("subprocess",)),
    "check_call": ("process", ("subprocess",)),
    "urlopen": ("network", ("urllib", "urllib.request")),
    "Request": ("network", ("urllib", "urllib.request")),
    "urlretrieve": ("network", ("urllib", "urllib.request")),
    "get": ("network", ("requests", "httpx", "urllib3", "aiohttp", "http.client")),
    "post": ("network", ("requests", "httpx", "urllib3", "aiohttp", "http.client")),
    "request": ("network", ("requests", "httpx", "urllib3", "aiohttp", "http.client")),
    "socket": ("network", ("socket",)),
    "b64decode": ("decode", ("base64",)),
    "urlsafe_b64decode": ("decode", ("base64",)),
    "b16decode": ("decode", ("base64",)),
    "b32decode": ("decode", ("base64",)),
    "a85decode": ("decode", ("base64",)),
    "unhexlify": ("decode", ("binascii",)),
    "decompress": ("decode", ("zlib", "gzip", "bz2", "lzma")),
    "loads": ("decode", ("pickle", "marshal", "dill")),
    "load": ("decode", ("pickle", "marshal", "dill")),
    "getenv": ("credential", ("os",)),
    "expanduser": ("credential", ("os.path", "posixpath")),
}
EXECUTORS = ("exec", "eval", "compile", "__import__")
PYTHON = (".py", ".pyx", ".pyi")

HUNKS = "array<struct<old_from: int, old_to: int, new_from: int, new_to: int, removed: array<string>, added: array<string>>>"
FACTS = "struct<syntax_error: boolean, modules: array<string>, categories: array<string>, names: array<string>, autoexec: array<string>>"


def _lines(content: bytes | None) -> list[str]:
    return (content or b"").decode("utf-8", "replace").splitlines()


def line_hunks(old: bytes | None, new: bytes | None) -> list[dict]:
    """Changed runs of lines, 0-based and half open; a missing side counts as empty."""
    a, b = _lines(old), _lines(new)
    return [{"old_from": i, "old_to": j, "new_from": k, "new_to": n, "removed": a[i:j], "added": b[k:n]} for tag, i, j, k, n in difflib.SequenceMatcher(None, a, b).get_opcodes() if tag != "equal"]


def hunks(old: str, new: str) -> Column:
    """line_hunks of two binary columns."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([line_hunks(x, y) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, HUNKS)(old, new)


def _origins(tree: ast.AST) -> dict[str, str]:
    out: dict[str, str] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out |= {(x.asname or x.name.split(".")[0]): x.name for x in n.names}
        elif isinstance(n, ast.ImportFrom):  # a name from the package itself hides one from elsewhere
            out |= {(x.asname or x.name): n.module or "" for x in n.names}
    return out


def _resolve(call: ast.Call, origins: dict[str, str]) -> tuple[str, str] | None:
    """(name, category) of a call that counts."""
    parts, f = [], call.func
    while isinstance(f, ast.Attribute):
        parts.append(f.attr)
        f = f.value
    if not isinstance(f, ast.Name):
        return None
    if not parts:
        if f.id in EXECUTORS:
            return f.id, "exec"
        name, origin = f.id, origins.get(f.id)
    else:
        name, origin = parts[0], ".".join([origins.get(f.id, ""), *parts[:0:-1]])
    category, modules = CALLS.get(name, ("", ()))
    return (name, category) if origin in modules else None


def _at_import(tree: ast.Module) -> list[ast.Call]:
    """Calls outside functions and, one call deep, those inside the module's functions that are called there by name."""
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    own = {n.name: n for n in tree.body if isinstance(n, functions)}
    out, todo = [], list(tree.body)
    while todo:
        n = todo.pop()
        if isinstance(n, (*functions, ast.Lambda)):
            continue
        if isinstance(n, ast.Call):
            out.append(n)
        todo.extend(ast.iter_child_nodes(n))
    entered = {c.func.id for c in out if isinstance(c.func, ast.Name)} & own.keys()
    return out + [c for f in entered for c in ast.walk(own[f]) if isinstance(c, ast.Call)]


def file_facts(path: str | None, content: bytes | None, added: set[int]) -> dict:
    """Facts of one changed file; only calls that touch an added line (1-based) count."""
    none = {"syntax_error": False, "modules": [], "categories": [], "names": [], "autoexec": []}
    if not content or not (path or "").endswith(PYTHON):
        return none
    try:
        tree = ast.parse(content.decode("utf-8", "replace"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return none | {"syntax_error": True}
    origins = _origins(tree)
    touched = lambda c: any(i in added for i in range(c.lineno, (c.end_lineno or c.lineno) + 1))
    found = lambda calls: [r for c in calls if touched(c) and (r := _resolve(c, origins))]
    calls = found(n for n in ast.walk(tree) if isinstance(n, ast.Call))
    return {"syntax_error": False, "modules": sorted(set(origins.values()) - {""}), "categories": sorted({c for _, c in calls}), "names": sorted({n for n, _ in calls}), "autoexec": sorted({c for _, c in found(_at_import(tree))})}


def facts(path: str, content: str, lines: str) -> Column:
    """file_facts of columns: path, binary content, array of added line numbers."""

    def run(p: pd.Series, c: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [file_facts(x, y, set(() if z is None else z)) for x, y, z in zip(p, c, n, strict=True)]
        return pd.DataFrame(rows, columns=["syntax_error", "modules", "categories", "names", "autoexec"])

    return F.pandas_udf(run, FACTS)(path, content, lines)
