"""Sources of a project: files, directories, changed files, aliases, packages,
baselines and run history (SURVEY S1-S11, K8, K9)."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import paths

BASELINE = "file string, line int, column int, rule string, message string, subject string"
HISTORY = "timestamp string, files long, violations long, errors long, warnings long, infos long, health_score long"


def read_tree(spark: SparkSession, root: str, scope: str = "", include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """``files(path, source)`` of all TypeScript files below
    ``root``.  The driver lists names only; Spark reads the contents.  Hidden
    paths, which Spark leaves out, are named to it; empty files have no rows
    there and get an empty source."""
    names = []
    for at, subs, found in os.walk(root):
        subs.sort()
        rel = os.path.relpath(at, root).replace(os.sep, "/")
        names += [n if rel == "." else f"{rel}/{n}" for n in found if n.endswith((".ts", ".tsx"))]
    base = root.rstrip("/") + "/"
    hidden = [n for n in names if any(p[0] in "._" for p in n.split("/"))]
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ts,tsx}").load(root)]
    parts += [spark.read.format("binaryFile").load([base + n for n in hidden])] if hidden else []
    raw = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    at = F.locate(base, F.col("path"))
    texts = raw.select(F.substring(F.col("path"), at + len(base), F.length("path")).alias("path"), F.decode("content", "UTF-8").alias("source")).dropDuplicates(["path"])
    files = spark.createDataFrame([(n,) for n in sorted(names)], "path string").where(paths.under(F.col("path"), scope))
    if include:
        files = files.where(paths.matches_any(F.col("path"), include))
    if exclude:
        files = files.where(~paths.matches_any(F.col("path"), exclude))
    return files.join(texts, "path", "left").select("path", F.coalesce("source", F.lit("")).alias("source"))


def directories(files: DataFrame) -> DataFrame:
    """S7 from files alone: directories without any file are not known here;
    ``list_directories`` knows them."""
    p = F.col("path")
    blank = F.trim(F.regexp_replace(F.coalesce("source", F.lit("")), r"(?s)/\*.*?\*/|//[^\n]*|\s", "")) == ""
    own = files.select(paths.parent(p).alias("dir"), "path", F.when(paths.is_barrel(p), blank).alias("empty"))
    own = own.groupBy("dir").agg(F.sort_array(F.collect_list("path")).alias("source_files"), F.collect_list("empty").alias("barrels_empty"))
    every = files.select(F.explode(paths.ancestors(p)).alias("path")).distinct()
    subs = every.where("path <> ''").select(paths.parent(p).alias("dir"), "path").groupBy("dir").agg(F.sort_array(F.collect_list("path")).alias("subdirectories"))
    none = F.array().cast("array<string>")
    rows = every.join(own, F.col("path") == own["dir"], "left").drop("dir").join(subs, F.col("path") == subs["dir"], "left")
    return rows.select("path", paths.depth(p).alias("depth"), F.coalesce("source_files", none).alias("source_files"), F.coalesce("subdirectories", none).alias("subdirectories"), F.coalesce("barrels_empty", F.array().cast("array<boolean>")).alias("barrels_empty"))


def list_directories(spark: SparkSession, root: str, ignored: tuple[str, ...]) -> DataFrame:
    """S7 by a recursive listing of a local tree, with empty directories."""
    rows = []
    for at, subs, names in os.walk(root):
        subs[:] = sorted(s for s in subs if s not in ignored)
        rel = os.path.relpath(at, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        join = lambda n, rel=rel: f"{rel}/{n}" if rel else n
        sources = sorted(n for n in names if n.endswith((".ts", ".tsx")))
        blank = []
        for n in sources:
            if n in paths.BARRELS:
                with open(os.path.join(at, n), encoding="utf-8", errors="replace") as f:
                    blank.append(not re.sub(r"(?s)/\*.*?\*/|//[^\n]*|\s", "", f.read()))
        rows.append((rel, len(rel.split("/")) if rel else 0, [join(n) for n in sources], [join(s) for s in subs], blank))
    return spark.createDataFrame(rows, "path string, depth int, source_files array<string>, subdirectories array<string>, barrels_empty array<boolean>")


def changed_files(spark: SparkSession, root: str, selection: str = "working-tree", since: str | None = None) -> DataFrame:
    """S3: changed TypeScript files; renames by their new path, deletions left
    out, untracked files with the working tree and unstaged changes."""
    args = {"working-tree": ["HEAD"], "staged": ["--cached"], "unstaged": [], "range": [since or ""]}[selection]
    if selection == "range" and not re.fullmatch(r"[\w./~^@-]+(\.\.\.?[\w./~^@-]*)?", since or "") or (since or "").startswith("-"):
        raise ValueError(f"not a revision range: {since!r}")
    git = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True, text=True).stdout
    found = set()
    for line in git("diff", "--name-status", "-M", "--relative", *args, "--").splitlines():
        parts = line.split("\t")
        if parts[0][0] != "D":
            found.add(parts[-1])
    if selection in ("working-tree", "unstaged"):
        found |= set(git("ls-files", "--others", "--exclude-standard").splitlines())
    return spark.createDataFrame([(p,) for p in sorted(found) if p.endswith((".ts", ".tsx"))], "path string")


def tsconfig(spark: SparkSession, text: str) -> tuple[DataFrame, list[str], list[str]]:
    """Aliases ``(pattern, target, rank)``, include and exclude globs; a
    pattern without an extension stands for all below it."""
    conf = json.loads(text)
    options = conf.get("compilerOptions", {})
    base = options.get("baseUrl", ".")
    rows = [(p, os.path.normpath(os.path.join(base, t)).replace(os.sep, "/") if "*" not in t else f"{base}/{t}", i) for p, ts in sorted(options.get("paths", {}).items()) for i, t in enumerate(ts)]
    wide = lambda g: g if re.search(r"[*?]|\.[^/]+$", g) else g.rstrip("/") + "/**/*"
    norm = lambda gs: [wide(g.removeprefix("./")) for g in gs]
    return spark.createDataFrame(rows, "pattern string, target string, rank int"), norm(conf.get("include", [])), norm(conf.get("exclude", []))


def _entry_points(exports: object, prefix: str = "") -> list[tuple[str, str]]:
    """``(subpath, file)`` of an exports field in any of its shapes."""
    if isinstance(exports, str):
        return [(prefix, exports)]
    if isinstance(exports, list):
        return [x for e in exports[:1] for x in _entry_points(e, prefix)]
    if isinstance(exports, dict):
        if any(k.startswith(".") for k in exports):
            return [x for k, v in exports.items() for x in _entry_points(v, k.removeprefix(".").lstrip("/"))]
        for k in ("types", "import", "default", "require"):
            if k in exports:
                return _entry_points(exports[k], prefix)
        return [x for v in list(exports.values())[:1] for x in _entry_points(v, prefix)]
    return []


#: Endings and index files that an entry point is tried with, in order.  Fixed values.
ENTRY_EXTENSIONS = ("ts", "tsx", "js", "mjs", "cjs", "jsx")
ENTRY_INDEXES = ("index.ts", "index.tsx", "index.js")


def probe_entry(root: str, path: str) -> str:
    """The file that an entry point stands for, or the path itself."""
    stem = os.path.splitext(path)[0]
    tries = [f"{stem}.{e}" for e in ENTRY_EXTENSIONS] + [f"{path}/{i}" for i in ENTRY_INDEXES]
    return next((p for p in tries if os.path.isfile(os.path.join(root, p))), path)


def workspace(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``packages(name, directory)`` and ``entries(package, subpath, path)``
    from the root's workspaces; ``!`` globs exclude."""
    def load(path):
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    globs: list[str] = []
    manifest = os.path.join(root, "package.json")
    if os.path.exists(manifest):
        found = load(manifest).get("workspaces", [])
        globs = found.get("packages", []) if isinstance(found, dict) else found
    listed = os.path.join(root, "pnpm-workspace.yaml")
    if not globs and os.path.exists(listed):
        with open(listed, encoding="utf-8") as f:
            globs = re.findall(r"^\s*-\s*['\"]?([^'\"\n#]+?)['\"]?\s*$", f.read(), re.M)
    packages, entries = [], []
    for at, subs, names in os.walk(root):
        subs[:] = [s for s in subs if s not in ("node_modules", ".git")]
        rel = os.path.relpath(at, root).replace(os.sep, "/")
        hit = lambda g, rel=rel: re.match(paths.glob_regex(g.strip("./").rstrip("/")), rel) or fnmatch.fnmatch(rel, g.rstrip("/")) and "/" not in g
        if "package.json" in names and any(hit(g) for g in globs if g[0] != "!") and not any(hit(g[1:]) for g in globs if g[0] == "!"):
            m = load(os.path.join(at, "package.json"))
            if m.get("name"):
                packages.append((m["name"], rel))
                points = _entry_points(m["exports"]) if "exports" in m else [("", m[k]) for k in ("types", "module", "main") if k in m] or [("", "index.ts"), ("", "src/index.ts")]
                entries += [(m["name"], sub, probe_entry(root, os.path.normpath(f"{rel}/{p}").replace(os.sep, "/"))) for sub, p in points]
    return spark.createDataFrame(sorted(packages, key=lambda p: p[1], reverse=True), "name string, directory string"), spark.createDataFrame(entries, "package string, subpath string, path string")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """S8."""
    raw = spark.read.schema(f"version int, violations array<struct<{', '.join(c.replace(' ', ': ') for c in BASELINE.split(', '))}>>").json(path, multiLine=True)
    return raw.select(F.inline("violations")).distinct()


def write_baseline(baseline: DataFrame, path: str) -> None:
    """K8, L4: one JSON document, sorted and without repeats."""
    rows = baseline.distinct().orderBy("file", "line", "column", "rule", "message", "subject").toLocalIterator()
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"version": 1, "violations": [r.asDict() for r in rows]}, f, indent=2)
        f.write("\n")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Malformed lines are skipped."""
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path)


def append_history(summary: DataFrame, path: str) -> None:
    """K9: one row a run, stamped in UTC with milliseconds."""
    total = F.col("n_error") + F.col("n_warn") + F.col("n_info")
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    row = summary.select(stamp.alias("timestamp"), F.col("n_files").alias("files"), total.alias("violations"), F.col("n_error").alias("errors"), F.col("n_warn").alias("warnings"), F.col("n_info").alias("infos"), "health_score")
    row.write.mode("append").json(path)
