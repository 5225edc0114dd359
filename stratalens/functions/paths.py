"""Column expressions over normalized, root-relative paths."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that make a directory's public face; fixed values.
BARRELS = ("index.ts", "index.tsx")
#: Modules of the runtime that sorting treats as built in; fixed values.
BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "dns", "domain",
    "events", "fs", "http", "http2", "https", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring",
    "readline", "stream", "string_decoder", "timers", "tls", "tty", "url", "util", "zlib",
)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of it."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"(?<=.)\.([^.]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def normalize(path: Column) -> Column:
    """Lexical: ``.`` and empty parts go, ``..`` takes the part before it; at the
    root it takes nothing."""

    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 0, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(F.array_append(kept, part))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """All directories above ``path``, nearest first, the root (empty) last."""
    parts = F.split(path, "/")
    return F.reverse(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def is_source(path: Column) -> Column:
    return path.rlike(r"\.tsx?$")


def is_barrel(path: Column) -> Column:
    return base_name(path).isin(*BARRELS)


def is_test(path: Column) -> Column:
    return path.rlike(r"\.(test|spec)\.tsx?$|(^|/)__tests__/")


def under(path: Column, scope: str) -> Column:
    """Component-wise prefix."""
    return (path == scope) | path.startswith(scope.rstrip("/") + "/") if scope else F.lit(True)


def in_domain(path: Column, folders: Sequence[str], suffixes: Sequence[str]) -> Column:
    """Any component is a folder, or the name ends with a suffix."""
    hit = F.lit(False)
    if folders:
        hit = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))
    for s in suffixes:
        hit = hit | base_name(path).endswith(s)
    return hit


def is_entry(path: Column, names: Sequence[str]) -> Column:
    """The stem is an entry, or the name ends with an entry that starts with
    a dot."""
    hit = F.lit(False)
    for n in names:
        hit = hit | (base_name(path).endswith(n) if n.startswith(".") else stem(path) == n)
    return hit


def layer_of(path: Column, layers: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> Column:
    """P5: index of the layer ``(name, folders, suffixes)``; the longest folder
    that is a window of components wins, earlier layers win ties; suffixes count
    only for layers without folders, least of all."""
    scored = []
    for i, (_, folders, suffixes) in enumerate(layers):
        score = F.lit(None).cast("int")
        for f in sorted(folders, key=len):
            score = F.when(F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{f.strip('/')}/"), len(f)).otherwise(score)
        if not folders:
            score = F.when(in_domain(path, (), suffixes), 0)
        scored.append(F.when(score.isNotNull(), F.struct(score.alias("score"), F.lit(-i).alias("back"))))
    best = F.array_max(F.filter(F.array(*scored), lambda x: x.isNotNull()))
    return -best["back"]


def upward_depth(specifier: Column) -> Column:
    """Leading ``..`` parts; ``./../x`` has none."""
    return F.size(F.filter(F.split(F.regexp_extract(specifier, r"^((?:\.\./|\.\.$)*)", 1), "/"), lambda p: p == ".."))


def specifier_class(specifier: Column, internal: Column | None = None) -> Column:
    """The group that import sorting puts a specifier in."""
    name = F.split(F.regexp_replace(specifier, "^node:", ""), "/")[0]
    return (
        F.when(specifier.startswith("node:") | name.isin(*BUILTINS), "builtin")
        .when(internal if internal is not None else F.lit(False), "internal")
        .when(specifier.rlike(r"^\.\.(/|$)"), "parent")
        .when(specifier.rlike(r"^\.(/(index(\.tsx?)?)?)?$"), "index")
        .when(specifier.startswith("./"), "sibling")
        .otherwise("external")
    )


def glob_regex(glob: str) -> str:
    """A whole-path regex; ``*`` and ``?`` stay within a part, ``**`` does not."""
    out, i, depth_ = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        elif c == "{":
            depth_ += 1
            out.append("(?:")
        elif c == "}" and depth_:
            depth_ -= 1
            out.append(")")
        elif c == "," and depth_:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    if depth_:
        raise ValueError(f"unclosed group in glob {glob!r}")
    return "^" + "".join(out) + "$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    """The whole path matches one of the globs."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


def edit_distance(a: str, b: str) -> int:
    """Optimal string alignment: swaps of neighbours count one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]
