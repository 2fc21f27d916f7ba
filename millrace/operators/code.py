"""Python source to symbols, edges and chunks. Parsing happens once, in Arrow batches; names are resolved by joins."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import chunk_id, head, module_fqn, unresolved
from millrace.operators.text import line_windows
from millrace.sources.files import MAX_BYTES

PARSED = (
    "repo string, path string, module string, status string, "
    "defs array<struct<fqn:string,kind:string,start:int,end:int>>, "
    "edges array<struct<kind:string,src:string,dst:string,line:int>>, "
    "bindings array<struct<name:string,target:string,ordinal:int>>, "
    "chunks array<struct<symbol:string,parent:string,start:int,end:int,text:string,header:boolean>>"
)


#: How many top-level pieces may make one statement where a file is damaged, as a long string or bracket does.
MOST_PIECES = 20
_GOES_ON = re.compile(r"[)\]}]|(?:elif|else|except|finally)\b")


def partial_tree(text: str) -> ast.Module:
    """The top-level statements of a damaged file that parse by themselves, at their places."""
    lines = text.split("\n")
    starts = [i for i, x in enumerate(lines) if x and not x[0].isspace() and x[0] != "#" and not _GOES_ON.match(x)]
    cuts, body, k = [*starts, len(lines)], [], 0
    while k < len(starts):
        for z in range(k + 1, min(k + 1 + MOST_PIECES, len(cuts))):
            try:
                part = ast.parse("\n".join(lines[cuts[k] : cuts[z]]))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
            ast.increment_lineno(part, cuts[k])
            body += part.body
            k = z
            break
        else:
            k += 1
    return ast.Module(body=body, type_ignores=[])


class _Visitor:
    def __init__(self, source: str, module: str):
        self.source, self.module, self.lines = source, module, source.split("\n")
        self.defs, self.edges, self.bindings, self.chunks = [], [], [], []

    def start_of(self, node) -> int:
        return min([node.lineno, *[d.lineno for d in node.decorator_list]])

    def join(self, *parts: str) -> str:
        return ".".join(p for p in parts if p)

    def run(self, tree: ast.Module):
        self.defs.append({"fqn": self.module, "kind": "module", "start": 1, "end": max(1, len(self.source.splitlines()))})
        for node in tree.body:
            self.chunk(node)
        self.walk(tree.body, [])

    def chunk(self, node):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            self.add_chunk(node.name, None, self.start_of(node), node.end_lineno, False)
        elif isinstance(node, ast.ClassDef):
            a = self.start_of(node)
            first = node.body[0]
            z = max(a, (self.start_of(first) if hasattr(first, "decorator_list") else first.lineno) - 1)
            self.add_chunk(node.name, None, a, z, True)
            for m in node.body:
                if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef):
                    self.add_chunk(m.name, node.name, self.start_of(m), m.end_lineno, False)

    def add_chunk(self, symbol, parent, a, z, header):
        text = "\n".join(self.lines[a - 1 : z])
        if text.strip():
            self.chunks.append({"symbol": symbol, "parent": parent, "start": a, "end": z, "text": text, "header": header})

    def src(self, scope: list[str]) -> str:
        return self.join(self.module, *scope) or "<anonymous>"

    def callee(self, f) -> str | None:
        return ast.get_source_segment(self.source, f) if isinstance(f, ast.Name | ast.Attribute) else None

    def walk(self, body: list, scope: list[str]):
        for node in body:
            self.visit(node, scope)

    def visit(self, node, scope: list[str]):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            inner = [*scope, node.name]
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if scope else "function"
            self.defs.append({"fqn": self.join(self.module, *inner), "kind": kind, "start": self.start_of(node), "end": node.end_lineno})
            if isinstance(node, ast.ClassDef):
                for b in node.bases:
                    if isinstance(b, ast.Name | ast.Attribute):
                        self.edges.append({"kind": "inherit", "src": self.src(inner), "dst": self.callee(b), "line": node.lineno})
            self.walk(node.body, inner)
            return
        if isinstance(node, ast.Import):
            for a in node.names:
                self.edges.append({"kind": "import", "src": self.module or "<anonymous>", "dst": a.name, "line": node.lineno})
                self.bindings.append({"name": a.asname or a.name.split(".")[0], "target": a.name, "ordinal": len(self.bindings)})
            return
        if isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            self.edges.append({"kind": "import", "src": self.module or "<anonymous>", "dst": base, "line": node.lineno})
            for a in node.names:
                if a.name != "*":
                    self.bindings.append({"name": a.asname or a.name, "target": f"{base}.{a.name}", "ordinal": len(self.bindings)})
            return
        if isinstance(node, ast.Call):
            name = self.callee(node.func)
            if name:
                self.edges.append({"kind": "call", "src": self.src(scope), "dst": name, "line": node.lineno})
        for child in ast.iter_child_nodes(node):
            self.visit(child, scope)


def parse_python(files: DataFrame) -> DataFrame:
    """`PARSED` for files (repo, path, text): status `ok`, `parse_error` (syntax, or more than `MAX_BYTES`) or `unsupported`. Of a file
    with errors the top-level statements that parse by themselves are taken. A null text counts as empty."""

    def run(batches):
        for b in batches:
            out = []
            for repo, path, text, module, lang in zip(*(b.column(c).to_pylist() for c in ("repo", "path", "text", "module", "lang"))):
                row = {"repo": repo, "path": path, "module": module, "status": "ok", "defs": [], "edges": [], "bindings": [], "chunks": []}
                if lang != "python":
                    row["status"] = "unsupported"
                elif text is not None and len(text.encode()) > MAX_BYTES:
                    row["status"] = "parse_error"
                else:
                    v = _Visitor(text or "", module)
                    try:
                        tree = ast.parse(text or "")
                    except (SyntaxError, ValueError, RecursionError, MemoryError):
                        row["status"], tree = "parse_error", partial_tree(text)
                    try:
                        v.run(tree)
                        row |= {"defs": v.defs, "edges": v.edges, "bindings": v.bindings, "chunks": v.chunks}
                    except RecursionError:  # too deep to be walked
                        row["status"] = "parse_error"
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_PARSED_ARROW)

    from millrace.functions.scalars import language_of

    keyed = files.select("repo", "path", "text", module_fqn(F.col("path")).alias("module"), language_of(F.col("path")).alias("lang"))
    return keyed.where("lang is not null").mapInArrow(run, PARSED)


_S, _I = pa.string(), pa.int32()
_PARSED_ARROW = pa.schema(
    [
        ("repo", _S),
        ("path", _S),
        ("module", _S),
        ("status", _S),
        ("defs", pa.list_(pa.struct([("fqn", _S), ("kind", _S), ("start", _I), ("end", _I)]))),
        ("edges", pa.list_(pa.struct([("kind", _S), ("src", _S), ("dst", _S), ("line", _I)]))),
        ("bindings", pa.list_(pa.struct([("name", _S), ("target", _S), ("ordinal", _I)]))),
        ("chunks", pa.list_(pa.struct([("symbol", _S), ("parent", _S), ("start", _I), ("end", _I), ("text", _S), ("header", pa.bool_())]))),
    ]
)


def nodes_of(parsed: DataFrame) -> DataFrame:
    d = parsed.select("repo", "path", F.explode("defs").alias("d"))
    return d.select("d.fqn", "d.kind", F.lit("python").alias("language"), "repo", "path", F.col("d.start").alias("start_line"), F.col("d.end").alias("end_line"))


def resolve(parsed: DataFrame) -> DataFrame:
    """Edges (repo, src, dst, kind, src_path, src_line, weight): `references` and `definitions`, repeated ones as weight."""
    return weighed(references(parsed).unionByName(definitions(nodes_of(parsed))))


def weighed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo", "src", "dst", "kind", "src_line").agg(F.count("*").alias("weight"), F.min("src_path").alias("src_path"))


def definitions(nodes: DataFrame) -> DataFrame:
    """Definition edges out of the whole table of symbols, so that packages whose files did not change keep theirs."""
    p = nodes.select(F.col("fqn").alias("p_fqn"), F.col("repo").alias("p_repo")).distinct()
    up = nodes.where(F.col("fqn").contains(".")).withColumn("up", F.regexp_replace("fqn", r"\.[^.]*$", ""))
    defs = up.join(p, (F.col("up") == F.col("p_fqn")) & F.col("repo").eqNullSafe(F.col("p_repo")))
    return defs.select("repo", F.col("up").alias("src"), F.col("fqn").alias("dst"), F.lit("def").alias("kind"), F.col("path").alias("src_path"), F.col("start_line").alias("src_line"))


def references(parsed: DataFrame) -> DataFrame:
    """Import, call and inherit edges, one row each, with names resolved by joins within their file.

    A name's head is looked up among its file's own top-level definitions and imports, the last import winning; self.x and
    cls.x among the methods of the enclosing class; what is not found becomes <unresolved:name>.
    """
    own = parsed.select("repo", "path", "module", F.explode("defs").alias("d")).where("d.kind in ('class', 'function')")
    own = own.select("repo", "path", F.expr("substring(d.fqn, length(module) + if(module = '', 1, 2))").alias("name"), F.col("d.fqn").alias("target"), F.lit(-1).alias("ordinal"))
    own = own.where(~F.col("name").contains("."))
    bound = parsed.select("repo", "path", F.explode("bindings").alias("b")).select("repo", "path", "b.name", "b.target", "b.ordinal")
    table = own.unionByName(bound).groupBy("repo", "path", "name").agg(F.max_by("target", "ordinal").alias("target"))
    table = table.select(F.col("repo").alias("t_repo"), F.col("path").alias("t_path"), "name", "target")
    e = parsed.select("repo", "path", F.explode("edges").alias("e")).select("repo", "path", "e.kind", "e.src", "e.dst", "e.line")
    imports = e.where("kind = 'import'").select("repo", "src", "dst", "kind", F.col("path").alias("src_path"), F.col("line").alias("src_line"))
    rest = e.where("kind <> 'import'")
    selfish = F.col("dst").rlike(r"^(self|cls)\.")
    methods = parsed.select(F.col("repo").alias("m_repo"), F.col("path").alias("m_path"), F.explode("defs").alias("d")).where("d.kind = 'method'").select("m_repo", "m_path", F.col("d.fqn").alias("m_fqn")).distinct()
    want = F.concat(F.regexp_replace("src", r"\.[^.]*$", ""), F.lit("."), F.regexp_replace("dst", r"^(self|cls)\.", ""))
    mine = rest.where(selfish).withColumn("want", want)
    mine = mine.join(methods, (mine.repo.eqNullSafe(methods.m_repo)) & (mine.path == methods.m_path) & (mine.want == methods.m_fqn) & ~F.regexp_replace("dst", r"^(self|cls)\.", "").contains("."), "left")
    mine = mine.select("repo", "src", F.coalesce("m_fqn", unresolved(F.col("dst"))).alias("dst"), "kind", F.col("path").alias("src_path"), F.col("line").alias("src_line"))
    other = rest.where(~selfish).withColumn("head", head(F.col("dst")))
    other = other.join(table, other.repo.eqNullSafe(F.col("t_repo")) & (other.path == F.col("t_path")) & (F.col("head") == F.col("name")), "left")
    tail = F.expr("substring(dst, length(head) + 1)")
    other = other.select("repo", "src", F.coalesce(F.concat("target", tail), unresolved(F.col("dst"))).alias("dst"), "kind", F.col("path").alias("src_path"), F.col("line").alias("src_line"))
    return imports.unionByName(mine).unionByName(other)


def chunks_of(parsed: DataFrame, size: int = 80, overlap: int = 4) -> DataFrame:
    """Chunks with ids: functions, methods and class headers; long bodies in overlapping windows, headers whole."""
    c = parsed.select("repo", "path", F.explode("chunks").alias("c")).select("repo", "path", "c.symbol", "c.parent", F.col("c.start").alias("at"), F.col("c.end").alias("till"), "c.text", "c.header")
    c = c.withColumn("key", F.struct("repo", "path", "symbol", "parent", "at"))
    w = line_windows(c.where("not header").select("key", "text"), "key", "text", size, overlap)
    cut = w.select("key.repo", "key.path", "key.symbol", F.col("key.parent").alias("parent_symbol"), (F.col("key.at") + F.col("start_line") - 1).alias("start_line"), (F.col("key.at") + F.col("end_line") - 1).alias("end_line"), "text")
    heads = c.where("header").select("repo", "path", "symbol", F.col("parent").alias("parent_symbol"), F.col("at").alias("start_line"), F.col("till").alias("end_line"), "text")
    out = cut.unionByName(heads)
    return out.withColumn("chunk_id", chunk_id(F.col("repo"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text")))
