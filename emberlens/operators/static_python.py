"""Python sources: one parse for each file emits facts, and rules are relations over the facts.

Facts: file, kind, name, line, loop (depth of loops around it within its function), is_async (directly in an async function),
scope (qualified function name), detail. A file that does not parse gives one fact of kind ``unparsed``, so coverage stays explicit.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import suffixed

SCHEMA = "file string, kind string, name string, line int, loop int, is_async boolean, scope string, detail string"
# Calls that block, and calls that set something up.
BLOCKING = (
    "time.sleep", "os.system", "urllib.request.urlopen", "subprocess.run", "subprocess.call", "subprocess.check_call", "subprocess.check_output",
    "sqlite3.connect", "psycopg2.connect", "pymysql.connect", *(f"{lib}.{verb}" for lib in ("requests", "httpx") for verb in ("get", "post", "put", "delete", "patch", "head", "request")),
)
SETUP = ("re.compile", "sqlite3.connect", "boto3.client", "boto3.resource", "boto3.Session", "requests.Session", "psycopg2.connect")
MUTABLE = (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp)
DATABASE = ("psycopg2", "sqlite3", "pymysql", "MySQLdb", "pyodbc", "cx_Oracle")
HEAVY = ("pandas", "numpy", "scipy", "torch", "tensorflow", "sklearn", "matplotlib", "boto3", "cv2")
LLM_CALLS = ("messages.create", "completions.create", "responses.create", "invoke_model", "converse")
TOKEN_CAPS = ("max_tokens", "max_completion_tokens", "max_output_tokens", "inferenceConfig", "body")
LOG_METHODS = ("debug", "info", "warning", "error", "exception", "critical", "log")


PURE = ("len", "sorted", "min", "max", "sum", "abs", "set", "tuple", "math.sqrt", "math.log", "math.floor", "math.ceil")
LIMITERS = ("limit", "first", "one", "one_or_none", "count", "exists", "iterator", "paginate", "yield_per", "fetchone", "fetchmany", "aggregate")
TEST_LIBRARIES = ("pytest", "unittest", "mock", "hypothesis", "json", "os", "re", "sys", "time", "datetime", "pathlib", "math", "random")
ROUTES = ("route", "get", "post", "put", "delete", "patch")
STRUCTURED = ("structlog", "pythonjsonlogger", "loguru", "aws_lambda_powertools")
TOP_TIER = "(?i)opus|gpt-4(?!o-mini)|gpt-5(?!-mini|-nano)|o1(?!-mini)|-pro(-|$)|ultra"


def _reads(node: ast.AST, name: str) -> bool:
    return any(isinstance(x, ast.Name) and x.id == name and not isinstance(x.ctx, ast.Store) for x in ast.walk(node))


def _stored(node: ast.stmt) -> str:
    """The name that a plain assignment binds."""
    return node.targets[0].id if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) else ""


def _always_sets(body: list[ast.stmt], name: str) -> bool:
    """Whether straight-line statements bind the name before they read it."""
    for s in body:
        if _stored(s) == name and not _reads(s.value, name):
            return True
        if _reads(s, name) or not isinstance(s, (ast.Assign, ast.Expr, ast.AnnAssign)):
            return False
    return False


class _Facts(ast.NodeVisitor):
    def __init__(self, file: str) -> None:
        self.file, self.rows, self.names = file, [], {}
        self.scope, self.loop, self.is_async, self.closing = [], 0, False, False
        self.in_class, self.shared, self.bound, self.handler, self.sliced = False, set(), [], False, False

    def add(self, kind: str, name: str, node: ast.AST, detail: str = "") -> None:
        self.rows.append((self.file, kind, name, getattr(node, "lineno", 0), self.loop, self.is_async, ".".join(self.scope), detail))

    def dotted(self, node: ast.AST) -> str:
        """The imported name of a callee, empty where it isn't a plain chain of names."""
        parts: list[str] = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name):
            return "." + parts[0] if parts else ""
        return ".".join([self.names.get(node.id, node.id), *reversed(parts)])

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            self.add("import", a.asname or a.name.split(".")[0], node, a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.names[a.asname or a.name] = f"{node.module or ''}.{a.name}"
            self.add("import", a.asname or a.name, node, f"{node.module or ''}.{a.name}")

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        for d in [*node.args.defaults, *filter(None, node.args.kw_defaults)]:
            if isinstance(d, MUTABLE) or isinstance(d, ast.Call) and isinstance(d.func, ast.Name) and d.func.id in ("list", "dict", "set"):
                self.add("mutable_default", node.name, d)
            self.visit(d)
        for d in node.decorator_list:
            self.visit(d)
        self.add("function", node.name, node, str(sum(isinstance(x, ast.stmt) for x in ast.walk(node)) - 1))
        for d in node.decorator_list:
            called = d.func if isinstance(d, ast.Call) else d
            self.add("decorated", self.dotted(called), node, node.name)
        routed = any(isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTES for d in node.decorator_list)
        kept = self.loop, self.is_async, self.in_class, self.shared, self.bound, self.handler
        self.loop, self.is_async, self.in_class, self.bound = 0, isinstance(node, ast.AsyncFunctionDef), False, []
        self.handler = routed or node.name in ("handler", "lambda_handler")
        inner = [x for x in ast.walk(node) if x is not node and isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.Global, ast.Nonlocal))]
        self.shared = {y.id for x in inner for y in ast.walk(x) if isinstance(y, ast.Name)} | {n for x in inner if isinstance(x, (ast.Global, ast.Nonlocal)) for n in x.names}
        self.scope.append(node.name)
        self.block(node.body)
        self.scope.pop()
        self.loop, self.is_async, self.in_class, self.shared, self.bound, self.handler = kept

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.scope.append(node.name)
        kept, self.in_class = self.in_class, True
        self.generic_visit(node)
        self.in_class = kept
        self.scope.pop()

    def visit_Lambda(self, node: ast.Lambda) -> None:
        kept, self.loop, self.is_async = (self.loop, self.is_async), 0, False
        self.generic_visit(node)
        self.loop, self.is_async = kept

    def stores(self, body: list[ast.stmt]) -> None:
        """Stores that the same block overwrites before any read, in functions without closures over the name."""
        for i, s in enumerate(body):
            name = _stored(s)
            if not name or name in self.shared:
                continue
            start = isinstance(s.value, ast.Constant) or isinstance(s.value, (ast.List, ast.Dict, ast.Tuple)) and not ast.dump(s.value).count("Load")
            for later in body[i + 1 :]:
                if _stored(later) == name and not _reads(later.value, name):
                    self.add("overwritten_start" if start else "overwritten", name, s)
                elif isinstance(later, ast.If) and not _reads(later.test, name) and later.orelse and _always_sets(later.body, name) and _always_sets(later.orelse, name):
                    self.add("overwritten_start" if start else "overwritten", name, s)
                elif isinstance(later, (ast.Assign, ast.Expr, ast.AnnAssign)) and not _reads(later, name):
                    continue
                break

    def block(self, body: list[ast.stmt]) -> None:
        ended = False
        if self.scope and not self.in_class:
            self.stores(body)
        for s in body:
            if ended:
                self.add("unreachable", type(s).__name__, s)
                ended = False
            self.visit(s)
            ended = isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue))

    def looped(self, node: ast.For | ast.AsyncFor | ast.While) -> None:
        if isinstance(node, ast.While):
            self.visit(node.test)
        else:
            self.visit(node.iter)
            it = node.iter
            if isinstance(it, ast.Call) and self.dotted(it.func) == "range" and len(it.args) == 1 and isinstance(it.args[0], ast.Call) and self.dotted(it.args[0].func) == "len":
                self.add("range_len", "range(len())", node)
            if isinstance(it, ast.Call) and isinstance(it.func, ast.Attribute) and it.func.attr in ("iterrows", "itertuples"):
                self.add("frame_loop", it.func.attr, node)
        jumps = any(isinstance(x, (ast.Break, ast.Return, ast.Raise)) for x in ast.walk(node))
        only = node.body[0] if len(node.body) == 1 else None
        if isinstance(node, ast.For) and not jumps and isinstance(only, ast.If) and not only.orelse and all(_stored(x) and isinstance(x.value, ast.Constant) for x in only.body):
            self.add("no_early_exit", _stored(only.body[0]), node)
        # what the loop binds, or may change through a method, an item or an argument
        changed = {x.id for x in ast.walk(node) if isinstance(x, ast.Name) and not isinstance(x.ctx, ast.Load)}
        changed |= {x.value.id for x in ast.walk(node) if isinstance(x, (ast.Attribute, ast.Subscript)) and isinstance(x.value, ast.Name) and (isinstance(x, ast.Attribute) or not isinstance(x.ctx, ast.Load))}
        changed |= {a.id for x in ast.walk(node) if isinstance(x, ast.Call) and self.dotted(x.func) not in PURE for a in x.args if isinstance(a, ast.Name)}
        self.bound.append(changed)
        self.loop += 1
        self.block(node.body)
        self.loop -= 1
        self.bound.pop()
        self.block(node.orelse)

    visit_For = visit_AsyncFor = visit_While = looped

    def visit_If(self, node: ast.If) -> None:
        self.visit(node.test)
        if isinstance(node.test, ast.Constant) and not node.test.value and node.body:
            self.add("unreachable", "If", node.body[0])
        if node.orelse and [ast.dump(s) for s in node.body] == [ast.dump(s) for s in node.orelse]:
            self.add("identical_branches", "if", node)
        self.block(node.body)
        self.block(node.orelse)

    def visit_With(self, node: ast.With | ast.AsyncWith) -> None:
        for item in node.items:
            kept, self.closing = self.closing, True
            self.visit(item.context_expr)
            self.closing = kept
        self.block(node.body)

    visit_AsyncWith = visit_With

    def visit_Call(self, node: ast.Call) -> None:
        name = self.dotted(node.func)
        method = node.func.attr if isinstance(node.func, ast.Attribute) else ""
        self.add("call", name, node, method)
        if self.bound and name in PURE and node.args and all(isinstance(a, ast.Name) and not any(a.id in b for b in self.bound) for a in node.args) and not node.keywords:
            self.add("invariant_call", ast.unparse(node), node)
        if name in ("any", "all", "next") and node.args and isinstance(node.args[0], ast.ListComp):
            self.add("eager", name, node)
        chain, links = node.func, []
        while isinstance(chain, (ast.Attribute, ast.Call, ast.Subscript)):
            links += [chain.attr] if isinstance(chain, ast.Attribute) else []
            chain = chain.func if isinstance(chain, ast.Call) else chain.value
        if method in ("all", "fetchall") and {"query", "objects", "scalars", "execute"} & set(links) and not set(LIMITERS) & set(links) and " limit " not in ast.unparse(node).lower() and not self.sliced:
            self.add("whole_read", method, node)
        keys = {k.arg: k.value for k in node.keywords}
        if name.endswith(LLM_CALLS) or method in LLM_CALLS:
            value = lambda k: keys[k].value if k in keys and isinstance(keys[k], ast.Constant) else None
            cap = next((value(k) for k in TOKEN_CAPS[:3] if isinstance(value(k), int)), 0)
            sent = keys.get("messages")
            self.add("llm_detail", name, node, "|".join([str(value("model") or ""), str(cap), "stream" if value("stream") else "", "handler" if self.handler else "", sent.id if isinstance(sent, ast.Name) else "", "tools" if "tools" in keys else ""]))
        if name.endswith("run_in_executor") or name == "asyncio.to_thread":
            done = node.args[1] if name.endswith("run_in_executor") and len(node.args) > 1 else node.args[0] if node.args else None
            if isinstance(done, ast.Name) and done.id in ("len", "str", "int", "bool", "float", "dict", "list") or isinstance(done, ast.Lambda) and isinstance(done.body, (ast.Constant, ast.Name, ast.Attribute)):
                self.add("executor_hop", name, node)
        if method == "append" and isinstance(node.func.value, ast.Name):
            self.add("grown", node.func.value.id, node)
        if name.endswith(LLM_CALLS) or method in LLM_CALLS:
            keywords = [k.arg or "**" for k in node.keywords]
            tools = next((len(k.value.elts) for k in node.keywords if k.arg == "tools" and isinstance(k.value, ast.List)), 0)
            self.add("llm_call", name, node, ",".join([*keywords, f"#{tools}"]))
        if method in ("execute", "executemany") and node.args:
            text = node.args[0]
            first = text.values[0] if isinstance(text, ast.JoinedStr) and text.values else text
            if isinstance(first, ast.Constant) and isinstance(first.value, str):
                self.add("sql", method, node, first.value if first is text else first.value + " ?")
        if name == "open" and not self.closing:
            self.add("open", name, node)
        if method in ("pop", "insert") and node.args and isinstance(node.args[0], ast.Constant) and node.args[0].value == 0:
            self.add("front_change", method, node)
        if method == "apply" and any(k.arg == "axis" and isinstance(k.value, ast.Constant) and k.value.value in (1, "columns") for k in node.keywords):
            self.add("frame_loop", "apply", node)
        if method in LOG_METHODS and node.args and (isinstance(node.args[0], ast.JoinedStr) or isinstance(node.args[0], ast.BinOp) and isinstance(node.args[0].op, ast.Mod) or isinstance(node.args[0], ast.Call) and isinstance(node.args[0].func, ast.Attribute) and node.args[0].func.attr == "format"):
            self.add("eager_log", method, node)
        if method.startswith("assert") and len(node.args) >= 2 and ast.dump(node.args[0]) == ast.dump(node.args[1]):
            self.add("redundant_assert", method, node)
        self.generic_visit(node)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        value = node.value
        text = isinstance(value, ast.JoinedStr) or isinstance(value, ast.Constant) and isinstance(value.value, str) or isinstance(value, ast.Call) and self.dotted(value.func) == "str"
        if isinstance(node.op, ast.Add) and text and isinstance(node.target, ast.Name):
            self.add("string_add", node.target.id, node)
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        if len(node.targets) == 1 and ast.dump(node.targets[0]).replace("Store", "Load") == ast.dump(node.value):
            self.add("self_assignment", ast.unparse(node.value), node)
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.add("read", node.id, node)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        first = isinstance(node.slice, ast.Constant) and node.slice.value == 0
        prefix = isinstance(node.slice, ast.Slice) and node.slice.lower is None and node.slice.upper is not None
        made = isinstance(node.value, ast.ListComp) or isinstance(node.value, ast.Call) and self.dotted(node.value.func) in ("list", "sorted")
        if (first or prefix) and made:
            self.add("eager", "prefix", node)
        if isinstance(node.slice, ast.Slice) and isinstance(node.value, ast.Name):
            self.add("cut", node.value.id, node)
        kept, self.sliced = self.sliced, isinstance(node.slice, ast.Slice)
        self.generic_visit(node)
        self.sliced = kept

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if isinstance(node.value, ast.Name) and node.value.id == "self":
            self.add("self_set" if isinstance(node.ctx, ast.Store) else "self_read", node.attr, node)
        if node.attr == "usage":
            self.add("usage", "usage", node)
        self.generic_visit(node)

    def visit_Compare(self, node: ast.Compare) -> None:
        if any(isinstance(o, (ast.In, ast.NotIn)) for o in node.ops) and isinstance(node.comparators[0], (ast.List, ast.Tuple)) and len(node.comparators[0].elts) > 8:
            self.add("list_membership", str(len(node.comparators[0].elts)), node)
        self.generic_visit(node)

    def visit_Assert(self, node: ast.Assert) -> None:
        self.add("assert", "assert", node, "message" if node.msg else "")
        if isinstance(node.test, ast.Compare):
            sides = [node.test.left, *node.test.comparators]
            if any(isinstance(x, ast.Call) and self.dotted(x.func) in ("str", "repr") for x in sides):
                self.add("sensitive_assert", "assert", node)
            if any(isinstance(x, ast.Constant) and type(x.value) in (int, float) and x.value not in (-1, 0, 1, 2, 10, 100) for x in sides):
                self.add("magic_assert", "assert", node)
        test = ast.dump(node.test)
        self.add("assertion", test if len(test) <= 200 else test[:200] + hashlib.sha256(test.encode("utf-8", "surrogatepass")).hexdigest(), node)
        if isinstance(node.test, ast.Constant) or isinstance(node.test, ast.Compare) and len(node.test.comparators) == 1 and ast.dump(node.test.left) == ast.dump(node.test.comparators[0]):
            self.add("redundant_assert", "assert", node)
        self.generic_visit(node)


def file_facts(path: str, text: str) -> list[tuple]:
    visitor = _Facts(path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [(path, "unparsed", "", 0, 0, False, "", "")]
    visitor.block(tree.body)
    return [*visitor.rows, (path, "parsed", "", 0, 0, False, "", "")]


def facts(files: DataFrame) -> DataFrame:
    """Facts of ``files`` (path, text), in Arrow batches."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = zip(*file_facts(path or "", text or ""), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _rule(check: str, where: Column, confidence: str = "medium") -> tuple[str, Column, str]:
    return check, where, confidence


def single_fact_rules() -> list[tuple[str, Column, str]]:
    """Rules that one fact decides: check, condition, confidence."""
    kind, loop, name = F.col("kind"), F.col("loop") > 0, F.col("name")
    test = F.col("file").rlike("(^|/)tests?(/|_)|_test[.]py$")
    model, cap = F.split("detail", "[|]")[0], F.try_to_number(F.try_element_at(F.split("detail", "[|]"), F.lit(2)), F.lit("999999"))
    return [
        _rule("CODE-C1.1", kind == "unreachable", "high"), _rule("CODE-C1.2", kind == "self_assignment", "high"), _rule("CODE-C1.3", kind == "identical_branches", "high"),
        _rule("CODE-C1.2", kind == "overwritten", "high"), _rule("CODE-C1.6", kind == "overwritten_start"), _rule("CODE-C3.2", kind == "invariant_call"), _rule("CODE-C3.5", kind == "no_early_exit"),
        _rule("CODE-C3.6", kind == "eager"), _rule("CODE-RT.2", kind == "executor_hop"), _rule("DB-23", kind == "whole_read", "low"),
        _rule("LLM-08", (kind == "llm_detail") & model.rlike(TOP_TIER) & (cap > 0) & (cap <= 256) & ~F.col("detail").contains("|tools")),
        _rule("LLM-16", (kind == "llm_detail") & F.col("detail").contains("|handler|") & ~F.col("detail").contains("|stream|") & ((cap == 0) | (cap > 256))),
        _rule("CODE-C3.1", kind == "range_len"), _rule("CODE-C3.3", (kind == "call") & name.isin(*SETUP) & loop), _rule("CODE-C3.7", (kind == "front_change") & loop),
        _rule("CODE-C5.1", (kind == "list_membership") & loop), _rule("CODE-C6.6", kind == "open"), _rule("CODE-C6.7", kind == "mutable_default", "high"),
        _rule("CODE-C10.4", (kind == "string_add") & loop), _rule("CODE-C11.4", (kind == "call") & name.isin(*BLOCKING) & F.col("is_async"), "high"),
        _rule("PY-02", (kind == "front_change") & loop), _rule("PY-03", kind == "frame_loop"), _rule("PY-04", (kind == "string_add") & loop),
        _rule("PY-07", (kind == "call") & name.isin(*BLOCKING) & F.col("is_async"), "high"), _rule("PY-08", kind == "open"), _rule("PY-09", kind == "mutable_default", "high"),
        _rule("OBS-02", kind == "eager_log"), _rule("OBS-03", (kind == "call") & F.col("detail").isin(*LOG_METHODS) & loop), _rule("TST-10", kind == "redundant_assert", "high"),
        _rule("TST-12", (kind == "call") & (name == "time.sleep") & test), _rule("TST-07", (kind == "function") & test & name.startswith("test") & (F.try_to_number("detail", F.lit("999999")) > 30)),
        _rule("DB-09", (kind == "sql") & loop & F.col("detail").rlike("(?i)^[ \t\r\n]*(select|with)")), _rule("DB-13", (kind == "sql") & loop & (name == "execute") & F.col("detail").rlike("(?i)^[ \t\r\n]*(insert|update|delete)")),
        _rule("DB-14", (kind == "sql") & F.col("detail").rlike("(?i)select[ \t\r\n]+([a-z_0-9]+[.])?[*]") & ~F.col("detail").rlike("(?i)exists[ \t\r\n]*[(][ \t\r\n]*select|insert[ \t\r\n]+into"), "high"),
        _rule("DB-39", (kind == "sql") & F.col("detail").rlike("(?i)[ \t\r\n]offset[ \t\r\n]+([1-9][0-9]{2,}|[^0-9 \t\r\n])")),
        _rule("DB-41", (kind == "call") & F.col("is_async") & F.split("name", "[.]")[0].isin(*DATABASE), "high"),
        _rule("LLM-07", (kind == "llm_call") & ~F.arrays_overlap(F.split("detail", ","), F.array(*map(F.lit, (*TOKEN_CAPS, "**"))))),
        _rule("LLM-15", (kind == "llm_call") & (F.regexp_extract("detail", "#([0-9]+)$", 1).cast("int") > 20), "high"),
        _rule("LLM-11", (kind == "llm_call") & loop, "low"), _rule("TST-04", (kind == "magic_assert") & test, "low"), _rule("TST-08", (kind == "sensitive_assert") & test),
        _rule("TST-09", (kind == "assert") & test & loop),
    ]


def hits(table: DataFrame) -> DataFrame:
    """check_id, file, scope, line, anchor, identity and confidence of every hit."""
    columns = ["file", "scope", "line", F.concat_ws(":", "scope", "kind", "name").alias("anchor")]
    arms = [F.when(where, F.struct(F.lit(check).alias("check_id"), F.lit(sure).alias("confidence"))) for check, where, sure in single_fact_rules()]
    single = table.select(*columns, F.explode(F.filter(F.array(*arms), lambda x: x.isNotNull())).alias("r")).select("r.check_id", "file", "scope", "line", "anchor", "r.confidence")
    imports = table.where("kind = 'import'")
    reads = table.where("kind = 'read'").select("file", "name").distinct()
    unused = imports.where(~F.col("detail").startswith("__future__")).join(reads, ["file", "name"], "left_anti").where(~F.col("file").endswith("__init__.py"))
    unused = unused.select(F.lit("CODE-C1.1").alias("check_id"), *columns, F.lit("medium").alias("confidence"))
    heavy = unused.join(table.where("kind = 'import'").select("file", "line", "detail"), ["file", "line"]).where(F.split("detail", "[.]")[0].isin(*HEAVY))
    heavy = heavy.select(F.lit("PY-10").alias("check_id"), "file", "scope", "line", "anchor", "confidence").distinct()
    twice = table.where("kind = 'assertion'").groupBy("file", "scope", "name").agg(F.count("*").alias("n"), F.min("line").alias("line")).where("n > 1")
    twice = twice.select(F.lit("TST-05").alias("check_id"), "file", "scope", "line", F.concat_ws(":", "scope", F.lit("assertion"), F.sha2("name", 256)).alias("anchor"), F.lit("medium").alias("confidence"))
    tests = table.where((F.col("kind") == "function") & F.col("name").startswith("test")).select("file", F.concat_ws(".", F.nullif("scope", F.lit("")), "name").alias("scope"), "line", "name")
    asserted = table.where("kind = 'assert' OR (kind = 'call' AND (detail LIKE 'assert%' OR name LIKE '%raises'))").groupBy("file", "scope").agg(F.count_if((F.col("kind") == "assert") & (F.col("detail") == "")).alias("bare"))
    own = tests.join(asserted, ["file", "scope"], "left").select("file", "scope", "line", F.concat_ws(":", "scope", F.lit("test"), "name").alias("anchor"), "bare")
    unknown = own.where("bare IS NULL").select(F.lit("TST-06").alias("check_id"), "file", "scope", "line", "anchor", F.lit("medium").alias("confidence"))
    roulette = own.where("bare >= 2").select(F.lit("TST-01").alias("check_id"), "file", "scope", "line", "anchor", F.lit("low").alias("confidence"))
    more = None
    for check, sure, rows in relations(table):
        part = rows.select(F.lit(check).alias("check_id"), "file", "scope", "line", F.concat_ws(":", "scope", "name").alias("anchor"), F.lit(sure).alias("confidence"))
        more = part if more is None else more.unionByName(part)
    single = single.unionByName(more)
    every = single.unionByName(unused).unionByName(heavy).unionByName(twice).unionByName(unknown).unionByName(roulette)
    n = F.row_number().over(Window.partitionBy("check_id", "file", "anchor").orderBy("line"))
    return every.withColumn("identity", suffixed(F.col("anchor"), n))


def relations(table: DataFrame) -> list[tuple[str, str, DataFrame]]:
    """Rules that several facts decide: check, confidence, and rows (file, scope, line, name)."""
    row = ("file", "scope", "line", "name")
    of = lambda *kinds: table.where(F.col("kind").isin(*kinds))
    full = F.concat_ws(".", F.nullif("scope", F.lit("")), "name")
    tests = of("function").where(F.col("name").startswith("test") & F.col("file").rlike("(^|/)tests?(/|_)|_test[.]py$")).select("file", full.alias("scope"), "line", F.col("name").alias("test"))
    root = F.split("name", "[.]")[0]
    called = of("call").select("file", "scope", "name").distinct().where(~root.isin(*TEST_LIBRARIES) & (root != ""))
    imported = of("import").select("file", F.col("detail").alias("name")).distinct()
    production = called.join(imported, ["file", "name"], "left_semi")
    per_test = production.join(tests.select("file", "scope"), ["file", "scope"], "left_semi").groupBy("file", "scope").agg(F.count("*").alias("targets"), F.min("name").alias("target"))
    alone = per_test.where("targets = 1")
    shared = alone.groupBy("file", "target").agg(F.count("*").alias("users")).where("users > 1")
    lazy = alone.join(shared, ["file", "target"]).join(tests, ["file", "scope"]).groupBy("file", F.col("target").alias("name")).agg(F.min_by("scope", "line").alias("scope"), F.min("line").alias("line"))
    eager = per_test.where("targets > 4").join(tests, ["file", "scope"]).select("file", "scope", "line", F.col("test").alias("name"))
    owner = F.regexp_replace("scope", "[.][^.]+$", "")
    fields = of("self_set").where(F.col("scope").rlike("[.](setUp|setup_method)$")).groupBy("file", owner.alias("owner"), "name").agg(F.min("scope").alias("scope"), F.min("line").alias("line"))
    methods = tests.select("file", owner.alias("owner"), F.col("scope").alias("test_scope"))
    read = of("self_read").select("file", F.col("scope").alias("test_scope"), "name").distinct()
    general = fields.join(methods, ["file", "owner"]).join(read, ["file", "test_scope", "name"], "left_anti").select(*row).distinct()
    logs = of("call").where(F.col("detail").isin(*LOG_METHODS) & F.split("name", "[.]")[0].isin("log", "logger", "logging"))
    structured = of("import").where(F.split("detail", "[.]")[0].isin(*STRUCTURED)).select(F.lit(1).alias("any")).limit(1)
    # one marker in any file speaks for all of them
    unstructured = logs.groupBy("file").agg(F.min("line").alias("line")).select("file", F.lit("").alias("scope"), "line", F.lit("unstructured").alias("name")).join(structured, F.lit(True), "left_anti")
    usage = of("usage").select(F.lit(1).alias("any")).limit(1)
    unmeasured = of("llm_detail").select(*row).join(usage, F.lit(True), "left_anti")
    cached = of("decorated").where(F.col("name").isin("functools.lru_cache", "functools.cache")).select("file", full_of("detail").alias("scope"), F.col("line").alias("at"))
    forever = of("llm_detail").join(cached, ["file", "scope"]).select("file", "scope", F.col("at").alias("line"), "name")
    sent = of("llm_detail").where("loop > 0").withColumn("history", F.split("detail", "[|]")[4]).where("history <> ''")
    grown = of("grown").where("loop > 0").select("file", "scope", F.col("name").alias("history")).distinct()
    cut = of("cut").select("file", "scope", F.col("name").alias("history")).distinct()
    endless = sent.join(grown, ["file", "scope", "history"], "left_semi").join(cut, ["file", "scope", "history"], "left_anti").select(*row)
    return [("TST-02", "low", lazy.select(*row)), ("TST-03", "medium", eager), ("TST-11", "low", general), ("OBS-04", "medium", unstructured), ("LLM-09", "low", unmeasured), ("LLM-13", "medium", forever), ("LLM-14", "medium", endless)]


def full_of(name: str) -> Column:
    """The scope inside a function, from the scope that it stands in."""
    return F.concat_ws(".", F.nullif("scope", F.lit("")), F.col(name))


def suppressed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` (check_id, file, line, ...) without those whose line says ``# noqa``, alone or with their check among its codes."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\r\n|[\r\n]")).alias("_at", "_line")).where(F.col("_line").rlike("(?i)#[ ]*noqa"))
    codes = F.upper(F.regexp_extract("_line", "(?i)#[ ]*noqa[ ]*:[ ]*([A-Za-z0-9., -]+)", 1))
    marks = lines.select("file", (F.col("_at") + 1).alias("line"), F.split(codes, "[, ]+").alias("_codes"), (codes == "").alias("_all"))
    hit = F.col("_all") | F.array_contains("_codes", F.upper("check_id"))
    kept = rows.join(marks, ["file", "line"], "left").where(~F.coalesce(hit, F.lit(False)))
    return kept.select(*rows.columns)


def coverage(table: DataFrame) -> DataFrame:
    """Every file, evaluated or omitted with a reason."""
    return table.where("kind IN ('parsed', 'unparsed')").select("file", F.when(F.col("kind") == "parsed", "evaluated").otherwise("omitted").alias("status"), F.when(F.col("kind") == "unparsed", "does not parse").alias("reason"))


def unused_left_joins(table: DataFrame) -> DataFrame:
    """DB-29: LEFT JOIN aliases that a statement's other parts never name; statements with subqueries or * are not judged."""
    sql = table.where("kind = 'sql'").select("file", "scope", "line", F.regexp_replace("detail", "[ \t\r\n]+", " ").alias("q"))
    plain = sql.where(~F.col("q").rlike("(?i)[(] *select|^with |[*]| union "))
    joins = plain.select("*", F.explode(F.regexp_extract_all("q", F.lit("(?i)(left (?:outer )?join [a-z_0-9.]+ (?:as )?[a-z_0-9]+ on .*?)(?= left | inner | join | where | group | order | limit |$)"), F.lit(1))).alias("clause"))
    named = joins.withColumn("alias", F.lower(F.regexp_extract("clause", "(?i)join [a-z_0-9.]+ (?:as )?([a-z_0-9]+) on ", 1)))
    rest = F.replace(F.lower("q"), F.lower("clause"), F.lit(" "))
    left = named.where(~rest.contains(F.concat("alias", F.lit("."))))
    return left.select(F.lit("DB-29").alias("check_id"), "file", "scope", "line", F.concat_ws(":", F.lit("left-join"), "alias").alias("identity"))
