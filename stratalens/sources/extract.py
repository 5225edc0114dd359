"""Source files to syntax facts, in one pass over ``files(path, source)``.

Every file is parsed once.  ``syn`` has a row for each node, comment, suppression
directive and parse failure; edges, directives and failures are selections of it.
Offsets and columns count bytes of UTF-8; lines and columns start at 1.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.runtime import prepare
from stratalens.sources.typescript import FUNCTIONS, Node, SyntaxFailure, parse

SCHEMA = "path string, node_id long, parent_id long, kind string, name string, start int, end int, line int, column int, anc array<string>, stmt_index int, exported boolean, attrs map<string,string>"
_ARROW = pa.schema([
    ("path", pa.string()), ("node_id", pa.int64()), ("parent_id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
    ("line", pa.int32()), ("column", pa.int32()), ("anc", pa.list_(pa.string())), ("stmt_index", pa.int32()), ("exported", pa.bool_()), ("attrs", pa.map_(pa.string(), pa.string())),
])
DIRECTIVE = re.compile(r"//\s*lint-ignore-(file|next-line|line)\b(.*)")
_FUNCTION_VALUES = ("arrow", "function_expr")


class Places:
    """Character offsets to byte offsets, lines and byte columns."""

    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.text, self.plain = text, text.isascii()
        self.bytes = [0]
        if not self.plain:
            for a, b in zip(self.starts, self.starts[1:]):
                self.bytes.append(self.bytes[-1] + len(text[a:b].encode()))

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def byte(self, at: int) -> int:
        if self.plain:
            return at
        i = self.line(at) - 1
        return self.bytes[i] + len(self.text[self.starts[i] : at].encode())

    def column(self, at: int) -> int:
        i = self.line(at) - 1
        return len(self.text[self.starts[i] : at].encode()) + 1


def dotted(n: Node) -> str:
    """``a.b.c`` for plain member chains, ``a[]`` for an index, else empty."""
    parts: list[str] = []
    while n.kind in ("member", "index", "non_null", "paren"):
        if n.kind == "member":
            parts.append("." + n.name)
        elif n.kind == "index":
            parts.append("[]")
        n = n.children[0]
    return n.name + "".join(reversed(parts)) if n.kind == "id" else "this" + "".join(reversed(parts)) if n.kind == "this" else ""


def _root(n: Node) -> Node:
    while n.kind in ("member", "index", "call", "non_null", "paren", "tagged"):
        n = n.children[0]
    return n


def _walk_own(n: Node) -> Iterator[Node]:
    """Nodes below ``n`` without those of nested functions and classes."""
    for c in n.children:
        yield c
        if c.kind not in FUNCTIONS and c.kind not in ("class", "class_expr"):
            yield from _walk_own(c)


def _details(n: Node, stack: list[Node], text: str) -> dict[str, object]:
    """What rules need of a node beyond its own attributes."""
    up = stack[-1] if stack else None
    out: dict[str, object] = {}
    if n.kind in ("call", "new"):
        out["callee"] = dotted(n.children[0])
        out["callee_start"] = n.children[0].start
        if n.kind == "call" and n.children[0].kind == "member" and n.children[0].name == "then":
            inner = n.children[0].children[0]
            before = inner.kind == "call" and inner.children[0].kind == "member" and inner.children[0].name == "then"
            after = up is not None and up.kind == "member" and up.name == "then" and len(stack) > 1 and stack[-2].kind == "call"
            out |= {"then": True, "chained": before or after}
        out["args"] = len([c for c in n.children[1:] if not c.kind.startswith("t_")])
    elif n.kind in ("member", "index"):
        out["path"] = dotted(n)
        out["outermost"] = up is None or up.kind not in ("member", "index", "non_null") or up.children[0] is not n
    elif n.kind in ("return", "arrow"):
        depth_ = 0
        for a, b in zip(reversed([*stack, n]), reversed(stack)):
            if a.kind in FUNCTIONS:
                depth_ += 1
                if b.kind == "new" and b.name == "Promise" and len(b.children) > 1 and a is next((c for c in b.children[1:] if not c.kind.startswith("t_")), None):
                    out["executor_depth"] = depth_
                    break
    elif n.kind == "try":
        for c in n.children:
            if c.kind == "catch":
                body = list(_walk_own(c))
                loud = any(b.kind == "throw" or b.kind == "return" and b.attrs["valued"] or b.kind == "call" and dotted(b.children[0]).startswith("console.") for b in body)
                out["silent"] = not loud
    elif n.kind in ("number", "string"):
        sign = ""
        holder, child, rest = up, n, stack[:-1]
        if holder is not None and holder.kind == "unary" and holder.attrs["op"] in "+-":
            sign = holder.attrs["op"].replace("+", "")
            child, holder, rest = holder, rest[-1] if rest else None, rest[:-1]
        kinds = [s.kind for s in stack]
        exempt = (
            holder is not None
            and (
                holder.kind == "declarator" and holder.attrs["decl"] == "const"
                or holder.kind in ("call", "new") and dotted(holder.children[0]) == "Array"
            )
            or "enum_member" in kinds
            or "jsx_attr" in kinds
            or any(k.startswith("t_") for k in kinds)
        )
        out |= {"exempt": exempt, "value": sign + (n.name or "").replace("_", "").rstrip("n")}
        if n.kind == "number":
            raw = (n.name or "0").replace("_", "").rstrip("n")
            try:
                out["number"] = float(int(raw, 0)) if raw[:2].lower() in ("0x", "0o", "0b") else float(raw)
                if sign:
                    out["number"] = -out["number"]
            except ValueError:
                pass
    elif n.kind == "declarator":
        init = n.children[1] if len(n.children) > 1 else None
        out["function_valued"] = init is not None and init.kind in _FUNCTION_VALUES
        out["from_console"] = init is not None and init.kind == "id" and init.name == "console"
    elif n.kind == "binding" and up is not None and up.kind == "pattern" and len(stack) > 1 and stack[-2].kind == "declarator":
        init = stack[-2].children[1] if len(stack[-2].children) > 1 else None
        out["from_console"] = init is not None and init.kind == "id" and init.name == "console"
    elif n.kind == "non_null":
        out["root"] = _root(n).kind
    if n.kind in FUNCTIONS:
        out["has_return"] = bool(n.attrs.get("return_type"))
        out["is_init"] = up is not None and up.kind == "declarator"
        if out["is_init"]:
            out |= {"bound_name": up.name or "", "bound_start": up.children[0].start, "decl": up.attrs["decl"]}
        out["typed_binding"] = up is not None and up.kind == "declarator" and bool(up.attrs.get("type"))
    if n.kind == "param" and n.attrs.get("type"):
        t = next((c for c in n.children if c.kind.startswith("t_")), None)
        out["mutable_array"] = t is not None and (t.kind == "t_array" or t.kind == "t_ref" and t.name == "Array")
        if t is not None:
            out["type_start"] = t.start
    if n.kind in ("member", "call", "index") and (n.attrs.get("optional") or any(x.attrs.get("optional") for x in _chain(n))):
        out["optional_chain"] = True
    return out


def _chain(n: Node) -> Iterator[Node]:
    while n.kind in ("member", "index", "call", "non_null"):
        yield n
        n = n.children[0]


def _text(v: object) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


def facts(path: str, text: str) -> Iterator[tuple]:
    """Rows of ``syn`` for one file."""
    places = Places(text)
    ids = 0

    def row(kind, name, start, end, parent=None, anc=(), stmt=None, exported=False, attrs=None):
        nonlocal ids
        ids += 1
        a = [(k, _text(v)) for k, v in (attrs or {}).items() if v is not None and not k.endswith("_start")]
        for k, v in (attrs or {}).items():
            if k.endswith("_start"):
                a += [(k, str(places.byte(v))), (k[:-6] + "_line", str(places.line(v))), (k[:-6] + "_column", str(places.column(v)))]
        return path, ids, parent, kind, name, places.byte(start), places.byte(end), places.line(start), places.column(start), list(anc), stmt, exported, a

    try:
        program, comments = parse(text, path)
    except SyntaxFailure as e:
        yield row("failure", str(e), e.at, e.at)
        return
    except RecursionError:
        yield row("failure", "nested too deeply", 0, 0)
        return
    seen_lines: set[int] = set()
    for start, end in sorted(comments.items()):
        body = text[start:end]
        line = places.line(start)
        yield row("comment", body, start, end, attrs={"doc": body.startswith("/**") or body.startswith("///"), "directive": bool(DIRECTIVE.match(body))})
        m = DIRECTIVE.match(body)
        if m and line not in seen_lines:
            rules = [r for r in re.split(r"[,\s]+", m[2]) if r]
            yield row("directive", m[1].replace("-", "_"), start, end, attrs={"rules": ",".join(rules)})
        seen_lines.add(line)
    todo: list[tuple[Node, list[Node], list[str], int | None, int | None, bool]] = []
    for i, s in reversed(list(enumerate(program.children))):
        todo.append((s, [], [], None, i, False))
    while todo:
        n, stack, anc, parent, stmt, shown = todo.pop()
        up = stack[-1].kind if stack else ""
        exported = up in ("export", "export_default") or shown and (up == "variables" or up == "declarator" and n.kind in _FUNCTION_VALUES)
        yield row(n.kind, n.name, n.start, n.end, parent, anc, stmt, exported, n.attrs | _details(n, stack, text) | {"top": not stack or len(stack) == 1 and up in ("export", "export_default")} | ({} if stack else {"last_line": places.line(n.end - 1)}))
        me = ids
        for c in reversed(n.children):
            todo.append((c, [*stack, n], [*anc, n.kind], me, stmt, exported and n.kind in ("variables", "declarator") or n.kind in ("export", "export_default")))


def syntax(files: DataFrame) -> DataFrame:
    """``syn`` for ``files(path, source)``; a null source counts as empty."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 5000))
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.extend(facts(path, text or ""))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return files.select("path", "source").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def edges(syn: DataFrame) -> DataFrame:
    """Import edges in order of appearance."""
    kind = F.when(F.col("kind") == "import", "import").when(F.col("kind") == "dynamic_import", "dynamic_import").otherwise("re_export")
    rows = syn.where(F.col("kind").isin("import", "export_from", "export_all", "dynamic_import") & (F.col("name") != ""))
    return rows.select(F.col("path").alias("source"), F.col("name").alias("specifier"), kind.alias("kind"), "start", "end", "line", "column")


def directives(syn: DataFrame) -> DataFrame:
    rules = F.filter(F.split(F.col("attrs")["rules"], ","), lambda r: r != "")
    return syn.where("kind = 'directive'").select("path", F.col("name").alias("kind"), "line", rules.alias("rules"))


def failures(syn: DataFrame) -> DataFrame:
    return syn.where("kind = 'failure'").select(F.col("path").alias("file"), F.col("name").alias("message"), "start", "end")
