"""The 64 structural rules as queries from facts to violations.

A rule is a function of ``Facts`` that returns rows of one violation schema.  All
rules stay in the JVM; Python ran once, in the extractor.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalens.functions import paths
from stratalens.operators import cache, graph, post, resolve
from stratalens.runtime import materialize
from stratalens.sources import extract
from stratalens.sources.typescript import LOOPS

COLUMNS = ("file", "start", "end", "line", "column", "rule", "message", "severity", "detail", "subject")

#: Rule, category, default severity, message.  Fixed values.
CATALOGUE = (
    ("boolean-prefix", "hygiene", "info", "Boolean should start with one of the configured prefixes."),
    ("component-file-only-components", "domain", "warn", "Component files must only export components. Move utilities, types, and hooks to separate files."),
    ("directory-must-have-barrel", "files", "warn", "Non-leaf directories must expose an index.ts barrel."),
    ("entry-file-no-logic", "domain", "warn", "Entry files should delegate logic. Move implementation to dedicated modules."),
    ("explicit-return-type", "hygiene", "warn", "Exported functions must have an explicit return type."),
    ("hook-no-jsx", "domain", "warn", "Hook files should not contain JSX. Extract UI into a separate component."),
    ("hook-prefix", "domain", "info", "Hook function name must start with one of the configured prefixes."),
    ("layer-boundaries", "imports", "off", "Import crosses a layer boundary against the defined layer order."),
    ("max-directory-depth", "files", "warn", "Directory nesting depth exceeds the configured limit."),
    ("max-file-exports", "exports", "warn", "Split this file or reduce its public surface area."),
    ("max-function-params", "exports", "warn", "Function has too many parameters. Consider using an object parameter instead."),
    ("max-items-per-directory", "files", "warn", "Directory exceeds the maximum number of items. Consider sub-grouping."),
    ("min-items-per-directory", "files", "warn", "Directory has too few source items. Consider merging with a sibling or removing."),
    ("no-abbreviations", "hygiene", "info", "Avoid abbreviations in identifiers."),
    ("no-anemic-domain", "domain", "warn", "Domain has too few files. Consider flattening into a parent or sibling directory."),
    ("no-any", "typescript", "warn", "Avoid using `any`. Use a more specific type or `unknown` instead."),
    ("no-await-in-loop", "hygiene", "warn", "Avoid await inside loops; use Promise.all or extract to a separate async function."),
    ("no-barrel-chain", "exports", "info", "Barrel files cannot re-export from other barrel files."),
    ("no-barrel-files", "exports", "info", "Avoid barrel files; import directly from the source module."),
    ("no-circular-import", "imports", "error", "Circular import chain detected."),
    ("no-comments", "hygiene", "info", "Remove implementation comments or convert them to allowed documentation."),
    ("no-console", "hygiene", "warn", "Disallow console statements outside allowed file patterns."),
    ("no-debugger", "hygiene", "error", "Remove debugger statements before committing code."),
    ("no-default-export", "exports", "info", "Use named exports so imports stay explicit and refactorable."),
    ("no-dump-files", "files", "warn", "Generic file names like utils.ts, helpers.ts, and types.ts hide intent and become dumping grounds."),
    ("no-duplicate-file-names", "files", "warn", "Duplicate file names across directories are confusing in stack traces."),
    ("no-empty-directories", "files", "warn", "Remove directories with no source files or only empty barrel files."),
    ("no-empty-domain", "domain", "warn", "Domain folder contains only barrel files with no real source. Add implementation or remove."),
    ("no-empty-interface", "typescript", "error", "Use a type alias instead of an empty interface."),
    ("no-enums", "typescript", "info", "Use union types or const objects instead of enums."),
    ("no-eval", "hygiene", "error", "Disallow eval() and new Function() as they execute arbitrary code."),
    ("no-export-star", "exports", "warn", "Avoid export * because it hides the public API shape. Use explicit named re-exports."),
    ("no-focused-test", "hygiene", "error", "Disallow focused tests (describe.only, it.only, test.only)."),
    ("no-god-domain", "domain", "warn", "Domain has too many files. Consider splitting into sub-domains."),
    ("no-inline-types", "domain", "info", "Move exported contracts to a colocated type file or accepted types folder."),
    ("no-interface", "typescript", "info", "Use a type alias instead of an interface."),
    ("no-large-file", "files", "warn", "Split this file into focused modules."),
    ("no-logic-in-barrel", "exports", "warn", "Keep barrel files limited to re-exports."),
    ("no-logic-in-domain", "domain", "warn", "Keep domain files free of logic. Move implementation to feature or service files."),
    ("no-magic-numbers", "typescript", "info", "No magic numbers. Extract numeric literals to named constants."),
    ("no-mutable-exports", "exports", "error", "Only export const, never export let."),
    ("no-namespace", "typescript", "error", "Use ES modules instead of TypeScript namespaces."),
    ("no-nested-functions", "hygiene", "warn", "Function is nested too deeply. Extract it to a top-level or module-scope declaration."),
    ("no-non-null-assertion", "typescript", "error", "Avoid non-null assertions. Use proper null checks or optional chaining instead."),
    ("no-orphan-files", "imports", "warn", "File is not imported by any other file in the project."),
    ("no-package-cycle", "imports", "error", "Package dependency cycle detected."),
    ("no-private-package-import", "imports", "warn", "Import from another package's internal file is not allowed."),
    ("no-process-env", "typescript", "warn", "Use the config module instead of direct process.env access."),
    ("no-promise-executor-return", "hygiene", "warn", "Return values from Promise executors cannot be handled; use resolve() or reject() instead."),
    ("no-restricted-imports", "imports", "warn", "Import from a restricted package or path."),
    ("no-side-effect-imports", "imports", "info", "Avoid side-effect imports; import named bindings or types instead."),
    ("no-silent-catch", "hygiene", "error", "Catch blocks must log, rethrow, or return a typed fallback."),
    ("no-skipped-test", "hygiene", "error", "Disallow skipped tests (describe.skip, it.skip, test.skip)."),
    ("no-test-code-in-production", "imports", "error", "Disallow test code (describe, it, test, expect, test library imports) outside test files."),
    ("no-test-import", "imports", "error", "Production code may not import test files."),
    ("no-then-chain", "hygiene", "info", "Prefer async/await over .then() chains."),
    ("no-type-assertion", "typescript", "warn", "Avoid type assertions. Use type narrowing or `satisfies` instead."),
    ("no-unnecessary-type-assertion", "typescript", "warn", "Unnecessary type assertion: the expression is already typed as the asserted type."),
    ("no-unsafe-optional-chaining", "typescript", "warn", "Unsafe optional chaining on a non-nullable expression. Remove the `?.` or use a nullable type."),
    ("no-upward-import", "imports", "warn", "Replace upward relative imports with local or project-root imports."),
    ("prefer-readonly", "hygiene", "warn", "Array parameter in exported function should use `readonly` to prevent accidental mutation."),
    ("prefer-satisfies", "typescript", "info", "Prefer 'satisfies' over 'as' for type validation without changing the inferred type."),
    ("sort-exports", "exports", "info", "Export declarations should be sorted by exported name."),
    ("sort-imports", "imports", "info", "Import declarations should be sorted by module specifier."),
)
#: Rules with a fix, contradictions, ignored folders, and names of test code.  Fixed values.
FIXABLE = (
    "no-any", "no-debugger", "no-empty-interface", "no-focused-test", "no-non-null-assertion", "no-process-env", "no-skipped-test", "prefer-readonly",
    "prefer-satisfies", "sort-exports", "sort-imports",
)
CONFLICTS = {"no-barrel-files": ["directory-must-have-barrel"], "directory-must-have-barrel": ["no-barrel-files"]}
IGNORED_DIRS = ("node_modules", ".git", ".vscode", ".idea", "dist", "build", "out", ".next", ".svelte-kit", "target")
TEST_GLOBALS = ("describe", "it", "test", "expect", "beforeEach", "afterEach", "beforeAll", "afterAll")
TEST_LIBRARIES = ("jest", "vitest", "mocha", "@testing-library", "@jest", "@vitest", "chai", "sinon", "cypress", "playwright", "@playwright/test")
#: Options of rules and their defaults.  Fixed values.
OPTIONS: dict[str, dict[str, Any]] = {
    "boolean-prefix": {"prefixes": ["is", "has", "can"], "ignore-constants": False},
    "directory-must-have-barrel": {"barrel-names": list(paths.BARRELS)},
    "entry-file-no-logic": {"entry-files": ["main", "app", "layout", "page"]},
    "explicit-return-type": {"include-arrow-functions": True, "include-class-methods": False, "include-private": False, "ignore-when-inferred": False},
    "hook-prefix": {"prefixes": ["use"]},
    "max-directory-depth": {"max-depth": 5, "ignore-dirs": []},
    "max-file-exports": {"max-exports": 10, "count-default": True},
    "max-function-params": {"max-params": 3},
    "max-items-per-directory": {"max-items": 20, "ignore-dirs": [], "count-folders": False},
    "min-items-per-directory": {"min-items": 3, "ignore-dirs": [], "count-folders": False},
    "no-abbreviations": {"extra-abbreviations": [], "allow-abbreviations": [], "abbreviation-patterns": [], "ignore-properties": False, "ignore-destructured": False},
    "no-anemic-domain": {"max-files": 1, "ignore-dirs": []},
    "no-any": {"allowed-folders": [], "allow-in-types": False, "allow-explicit-any-in": []},
    "no-barrel-files": {"barrel-names": list(paths.BARRELS)},
    "no-circular-import": {"report-all-nodes": False},
    "no-comments": {"allow-doc-comments": True},
    "no-console": {"allow-patterns": []},
    "no-default-export": {"components-only": False},
    "no-dump-files": {"extra-names": []},
    "no-duplicate-file-names": {"ignore-names": []},
    "no-empty-directories": {"ignore-dirs": []},
    "no-empty-domain": {"ignore-dirs": []},
    "no-god-domain": {"max-files": 20, "ignore-dirs": []},
    "no-interface": {"allow-declaration-merging": True},
    "no-large-file": {"max-lines": 500},
    "no-logic-in-barrel": {"barrel-names": list(paths.BARRELS)},
    "no-magic-numbers": {"allowed-numbers": [], "allowed-strings": [], "enforce-strings": False},
    "no-nested-functions": {"max-depth": 2, "contexts": ["function", "arrow", "class-method", "object-method"]},
    "no-orphan-files": {"entry-files": ["main", "app", "layout", "page"]},
    "no-restricted-imports": {"restricted": []},
    "no-then-chain": {"allow-single": True},
    "no-upward-import": {"max-depth": 0, "allow-patterns": []},
    "sort-exports": {"newlines-between": "ignore"},
    "sort-imports": {"newlines-between": "ignore", "internal-patterns": [], "groups": ["builtin", "external", "internal", "parent", "sibling", "index"]},
}
#: Folders and file suffixes of the six domains.  Fixed values.
DOMAINS: dict[str, tuple[list[str], list[str]]] = {
    "hooks": (["hooks"], [".hook.ts", ".hooks.ts"]),
    "components": (["components"], [".component.tsx", ".components.tsx"]),
    "types": (["types"], [".type.ts", ".types.ts"]),
    "constants": (["constants"], [".constant.ts", ".constants.ts"]),
    "tests": (["tests"], [".test.ts", ".tests.ts"]),
    "generated": (["generated", "__generated__"], [".generated.ts", ".generated.tsx"]),
}


@dataclass
class Config:
    severity: dict[str, str] = field(default_factory=dict)
    options: dict[str, dict[str, Any]] = field(default_factory=dict)
    domains: dict[str, tuple[list[str], list[str]]] = field(default_factory=lambda: dict(DOMAINS))
    layers: list[tuple[str, list[str], list[str]]] = field(default_factory=list)

    def level(self, rule: str) -> str:
        return self.severity.get(rule, next(c[2] for c in CATALOGUE if c[0] == rule))

    def get(self, rule: str, option: str) -> Any:
        return self.options.get(rule, {}).get(option, OPTIONS[rule][option])

    def domain(self, name: str, path: str = "path") -> Column:
        return paths.in_domain(F.col(path), *self.domains[name])


class Facts:
    """Facts of one tree; what several rules need is written out once."""

    def __init__(self, files: DataFrame, config: Config | None = None, aliases: DataFrame | None = None, packages: DataFrame | None = None, entries: DataFrame | None = None, dirs: DataFrame | None = None, cache: str | None = None):
        self.spark: SparkSession = files.sparkSession
        self.config = config or Config()
        self.files = files
        self.aliases, self.packages, self.entries, self._dirs = aliases, packages, entries, dirs
        self.cache = cache

    @cached_property
    def sources(self) -> DataFrame:
        return self.files.where(paths.is_source(F.col("path")))

    @cached_property
    def syn(self) -> DataFrame:
        return cache.syntax(self.sources, self.cache)

    @cached_property
    def edges(self) -> DataFrame:
        """Resolved edges of files that parsed."""
        make = self.spark.createDataFrame
        aliases = self.aliases or make([], "pattern string, target string, rank int")
        packages = self.packages or make([], "name string, directory string")
        entries = self.entries or make([], "package string, subpath string, path string")
        return materialize(resolve.resolve(extract.edges(self.syn), self.sources.select("path"), aliases, packages, entries), "edges")

    @cached_property
    def resolved(self) -> DataFrame:
        return self.edges.where("target is not null")

    @cached_property
    def inner(self) -> DataFrame:
        """Edges between scanned files."""
        known = self.sources.select(F.col("path").alias("target"))
        return self.resolved.join(known, "target", "left_semi")

    @cached_property
    def members(self) -> DataFrame:
        return graph.cyclic_nodes(self.inner, graph.scc(self.inner))

    @cached_property
    def owners(self) -> DataFrame:
        packages = self.packages or self.spark.createDataFrame([], "name string, directory string")
        found = resolve.nearest(self.sources.select("path"), packages, "directory", "name", "package")
        return materialize(found.where("package is not null").select("path", "package"), "owners")

    @cached_property
    def dirs(self) -> DataFrame:
        """``(path, depth, source_files, subdirectories, barrels_empty)``; from a
        listing if one was given (it knows empty directories), else from files."""
        if self._dirs is not None:
            return self._dirs
        from stratalens.sources.project import directories

        return materialize(directories(self.sources), "dirs")

    def where(self, *kinds: str) -> DataFrame:
        return self.syn.where(F.col("kind").isin(*kinds))


Rule = Callable[[Facts], DataFrame]
RULES: dict[str, Rule] = {}


def rule(name: str):
    def add(fn: Rule) -> Rule:
        RULES[name] = fn
        return fn

    return add


def _a(key: str) -> Column:
    return F.col("attrs")[key]


def _is(key: str) -> Column:
    return F.coalesce(_a(key) == "true", F.lit(False))


def _rows(f: Facts, name: str, rows: DataFrame, file="path", detail=None, subject=None, message=None, severity=None, place=("start", "end", "line", "column")) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else (c if isinstance(c, Column) else F.lit(c))
    spot = [F.lit(None).cast("int") if p is None else (p if isinstance(p, Column) else F.col(p)).cast("int") for p in place]
    told = message if message is not None else next(c[3] for c in CATALOGUE if c[0] == name)
    return rows.select(
        F.col(file).alias("file"),
        *[s.alias(a) for s, a in zip(spot, ("start", "end", "line", "column"))],
        F.lit(name).alias("rule"),
        text(told).alias("message"),
        F.lit(severity or f.config.level(name)).alias("severity"),
        text(detail).alias("detail"),
        text(subject).alias("subject"),
    )


def _named(prefix: str) -> tuple[Column, ...]:
    """A place that the extractor stored under ``<prefix>_*``."""
    return _a(f"{prefix}_start").cast("int"), F.lit(None).cast("int"), _a(f"{prefix}_line").cast("int"), _a(f"{prefix}_column").cast("int")


def _first_line() -> tuple[Column, ...]:
    return tuple(F.lit(x) for x in (0, 0, 1, 1))


NOWHERE = (None, None, None, None)


def BASE(column: str = "path") -> Column:
    return paths.base_name(F.col(column))


# -- graph rules


@rule("no-upward-import")
def no_upward_import(f: Facts) -> DataFrame:
    deep = paths.upward_depth(F.col("specifier")) > f.config.get("no-upward-import", "max-depth")
    rows = f.edges.where(deep & ~paths.matches_any(F.col("source"), f.config.get("no-upward-import", "allow-patterns")))
    return _rows(f, "no-upward-import", rows, "source", subject=F.col("specifier"))


@rule("layer-boundaries")
def layer_boundaries(f: Facts) -> DataFrame:
    layers = f.config.layers
    names = F.array(*[F.lit(n) for n, _, _ in layers]) if layers else F.array().cast("array<string>")
    rows = f.resolved.withColumn("a", paths.layer_of(F.col("source"), layers) if layers else F.lit(None).cast("int")).withColumn("b", paths.layer_of(F.col("target"), layers) if layers else F.lit(None).cast("int")).where("b < a")
    detail = F.concat(F.lit("Layer "), F.get(names, F.col("a")), F.lit(" may not import from layer "), F.get(names, F.col("b")))
    return _rows(f, "layer-boundaries", rows, "source", detail, F.col("specifier"))


@rule("no-test-import")
def no_test_import(f: Facts) -> DataFrame:
    rows = f.inner.where(f.config.domain("tests", "target") & ~f.config.domain("tests", "source"))
    return _rows(f, "no-test-import", rows, "source", F.concat(F.lit("imports `"), F.col("specifier"), F.lit("`")), F.col("specifier"))


@rule("no-barrel-chain")
def no_barrel_chain(f: Facts) -> DataFrame:
    rows = f.inner.where((F.col("kind") == "re_export") & paths.is_barrel(F.col("source")) & paths.is_barrel(F.col("target")))
    return _rows(f, "no-barrel-chain", rows, "source", subject=F.col("specifier"))


@rule("no-circular-import")
def no_circular_import(f: Facts) -> DataFrame:
    """One finding for each cycle, at the first import of its smallest file into
    the next; with ``report-all-nodes`` one for each file, at its first import
    that stays in the cycle's component."""
    cycles = materialize(graph.witnesses(f.inner, f.members), "cycles")
    named = F.array_join(F.transform("cycle", lambda p: F.element_at(F.split(p, "/"), -1)), " -> ")
    if f.config.get("no-circular-import", "report-all-nodes"):
        own = f.members.select(F.col("node").alias("source"), "component")
        other = f.members.select(F.col("node").alias("target"), F.col("component").alias("c2"))
        rows = f.inner.join(own, "source").join(other, "target").where("component = c2").join(cycles, "component")
    else:
        rows = f.inner.join(cycles, (F.col("source") == F.col("component")) & (F.col("target") == F.get("cycle", F.lit(1))))
    rows = graph.first_edge_into(rows, ["source"], ["start"])
    return _rows(f, "no-circular-import", rows, "source", named, F.col("specifier"))


@rule("no-orphan-files")
def no_orphan_files(f: Facts) -> DataFrame:
    entry = F.lower(paths.stem(F.col("path"))).isin(*f.config.get("no-orphan-files", "entry-files"))
    rows = graph.orphans(f.sources.select("path"), f.edges, f.config.domain("tests") | entry)
    return _rows(f, "no-orphan-files", rows, "file", place=_first_line())


def _packaged(f: Facts) -> DataFrame:
    a, b = f.owners.select(F.col("path").alias("source"), F.col("package").alias("from_package")), f.owners.select(F.col("path").alias("target"), F.col("package").alias("to_package"))
    return f.resolved.join(a, "source").join(b, "target").where("from_package <> to_package")


@rule("no-private-package-import")
def no_private_package_import(f: Facts) -> DataFrame:
    public = (f.entries or f.spark.createDataFrame([], "package string, subpath string, path string")).select(F.col("package").alias("to_package"), F.col("path").alias("target")).distinct()
    rows = _packaged(f).join(public, ["to_package", "target"], "left_anti")
    return _rows(f, "no-private-package-import", rows, "source", F.concat(F.lit("`"), F.col("target"), F.lit("` is not a public entry point of "), F.col("to_package")), F.col("specifier"))


@rule("no-package-cycle")
def no_package_cycle(f: Facts) -> DataFrame:
    pairs = _packaged(f)
    between = pairs.select(F.col("from_package").alias("source"), F.col("to_package").alias("target")).distinct()
    members = graph.cyclic_nodes(between)
    cycles = graph.witnesses(between, members).withColumn("text", F.array_join("cycle", " -> "))
    inside = members.select(F.col("node").alias("from_package"), "component").join(cycles.select("component", "text"), "component")
    other = members.select(F.col("node").alias("to_package"), F.col("component").alias("c2"))
    rows = pairs.join(inside, "from_package").join(other, "to_package").where("component = c2")
    return _rows(f, "no-package-cycle", graph.first_edge_into(rows, ["source", "to_package"], ["start"]), "source", F.col("text"), F.col("specifier"))


# -- directory rules


def _dirs(f: Facts, name: str) -> DataFrame:
    ignored = [*IGNORED_DIRS, *f.config.get(name, "ignore-dirs")] if "ignore-dirs" in OPTIONS.get(name, {}) else list(IGNORED_DIRS)
    return f.dirs.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ignored))))


def _files_in() -> Column:
    return F.size("source_files")


@rule("no-empty-directories")
def no_empty_directories(f: Facts) -> DataFrame:
    leaf = F.size("subdirectories") == 0
    only_empty = (_files_in() > 0) & (F.size("barrels_empty") == _files_in()) & F.forall("barrels_empty", lambda x: x)
    return _rows(f, "no-empty-directories", _dirs(f, "no-empty-directories").where(leaf & ((_files_in() == 0) | only_empty)), place=NOWHERE)


@rule("directory-must-have-barrel")
def directory_must_have_barrel(f: Facts) -> DataFrame:
    names = F.array(*map(F.lit, f.config.get("directory-must-have-barrel", "barrel-names")))
    own = F.transform("source_files", lambda p: F.element_at(F.split(p, "/"), -1))
    rows = _dirs(f, "directory-must-have-barrel").where((F.size("subdirectories") > 0) & ~F.arrays_overlap(own, names))
    return _rows(f, "directory-must-have-barrel", rows, detail="Directory contains child folders but no index.ts.", place=NOWHERE)


def _items(f: Facts, name: str) -> Column:
    return _files_in() + (F.size("subdirectories") if f.config.get(name, "count-folders") else 0)


@rule("max-items-per-directory")
def max_items_per_directory(f: Facts) -> DataFrame:
    n, most = _items(f, "max-items-per-directory"), f.config.get("max-items-per-directory", "max-items")
    return _rows(f, "max-items-per-directory", _dirs(f, "max-items-per-directory").where(n > most), detail=F.format_string(f"%d items exceed the maximum of {most}.", n), place=NOWHERE)


@rule("min-items-per-directory")
def min_items_per_directory(f: Facts) -> DataFrame:
    n, least = _items(f, "min-items-per-directory"), f.config.get("min-items-per-directory", "min-items")
    return _rows(f, "min-items-per-directory", _dirs(f, "min-items-per-directory").where((n > 0) & (n < least)), detail=F.format_string(f"%d items are below the minimum of {least}.", n), place=NOWHERE)


@rule("max-directory-depth")
def max_directory_depth(f: Facts) -> DataFrame:
    """Subdirectories are always warnings, files have the configured level."""
    most = f.config.get("max-directory-depth", "max-depth")
    deep = _dirs(f, "max-directory-depth").where(F.col("depth") + 1 > most)
    detail = F.format_string(f"Depth %d exceeds maximum of {most}.", F.col("depth") + 1)
    subs = _rows(f, "max-directory-depth", deep.withColumn("p", F.explode("subdirectories")), "p", detail, severity="warn", place=NOWHERE)
    return subs.unionByName(_rows(f, "max-directory-depth", deep.withColumn("p", F.explode("source_files")), "p", detail, place=NOWHERE))


@rule("no-empty-domain")
def no_empty_domain(f: Facts) -> DataFrame:
    return _rows(f, "no-empty-domain", _dirs(f, "no-empty-domain").where((_files_in() > 0) & (F.size("barrels_empty") == _files_in())), place=NOWHERE)


@rule("no-anemic-domain")
def no_anemic_domain(f: Facts) -> DataFrame:
    most = f.config.get("no-anemic-domain", "max-files")
    rows = _dirs(f, "no-anemic-domain").where((_files_in() > 0) & (_files_in() <= most))
    unit = F.when(_files_in() == 1, "file").otherwise("files")
    return _rows(f, "no-anemic-domain", rows, detail=F.format_string("Domain has %d %s.", _files_in(), unit), place=NOWHERE)


@rule("no-god-domain")
def no_god_domain(f: Facts) -> DataFrame:
    most = f.config.get("no-god-domain", "max-files")
    return _rows(f, "no-god-domain", _dirs(f, "no-god-domain").where(_files_in() > most), detail=F.format_string(f"Domain has %d files; the maximum is {most}.", _files_in()), place=NOWHERE)


# -- file-set and text rules


@rule("no-duplicate-file-names")
def no_duplicate_file_names(f: Facts) -> DataFrame:
    ignored = f.config.get("no-duplicate-file-names", "ignore-names")
    rows = post.duplicate_names(f.sources.select("path")).where(~F.col("name").isin(*ignored) if ignored else F.lit(True))
    return _rows(f, "no-duplicate-file-names", rows, "file", F.concat(F.lit("Also exists at: "), F.col("other")), place=NOWHERE)


@rule("no-dump-files")
def no_dump_files(f: Facts) -> DataFrame:
    names = [n.lower() for n in ("utils", "helpers", "types", *f.config.get("no-dump-files", "extra-names"))]
    return _rows(f, "no-dump-files", f.sources.where(F.lower(paths.stem(F.col("path"))).isin(*names)), place=_first_line())


@rule("no-large-file")
def no_large_file(f: Facts) -> DataFrame:
    """Lines as read: a final line break adds none.  Reported at the end."""
    most = f.config.get("no-large-file", "max-lines")
    lines = F.split(F.coalesce("source", F.lit("")), "\n", -1)
    last = F.element_at(lines, -1)
    n = F.size(lines) - F.when(last == "", 1).otherwise(0)
    size = F.octet_length(F.coalesce("source", F.lit("")))
    rows = f.sources.withColumn("n", n).withColumn("size", size).withColumn("ll", F.size(lines)).withColumn("lc", F.octet_length(last) + 1).where(F.col("n") > most)
    return _rows(f, "no-large-file", rows, detail=F.format_string(f"File has %d lines; the maximum is {most}.", F.col("n")), place=(F.col("size"), F.col("size"), F.col("ll"), F.col("lc")))


# -- import and export shape


@rule("no-side-effect-imports")
def no_side_effect_imports(f: Facts) -> DataFrame:
    rows = f.where("import").where(_is("side_effect"))
    return _rows(f, "no-side-effect-imports", rows, detail=F.concat(F.lit('"'), F.col("name"), F.lit('" is imported only for side effects')), subject=F.col("name"))


@rule("no-restricted-imports")
def no_restricted_imports(f: Facts) -> DataFrame:
    """``restricted``: patterns as text, or dicts of pattern, named, message."""
    names = F.split(F.coalesce(_a("names"), F.lit("")), ",")
    best = F.lit(None).cast("string")
    for p in reversed([{"pattern": p} if isinstance(p, str) else p for p in f.config.get("no-restricted-imports", "restricted")]):
        text = p["pattern"]
        hit = F.col("name").rlike(paths.glob_regex(text)) if any(c in text for c in "*?[") else (F.col("name") == text) | F.col("name").startswith(text + "/")
        if p.get("named"):
            hit = hit & F.arrays_overlap(names, F.array(*map(F.lit, p["named"])))
        tail = f": {p['message']}" if p.get("message") else ""
        best = F.when(hit, F.concat(F.lit('"'), F.col("name"), F.lit(f'" matches a restricted pattern{tail}'))).otherwise(best)
    rows = f.where("import", "export_from", "export_all").withColumn("hit", best).where("hit is not null")
    return _rows(f, "no-restricted-imports", rows, detail=F.col("hit"), subject=F.col("name"))


@rule("no-test-code-in-production")
def no_test_code_in_production(f: Facts) -> DataFrame:
    code = f.syn.where(~f.config.domain("tests"))
    calls = code.where((F.col("kind") == "call") & _a("callee").isin(*TEST_GLOBALS))
    library = reduce(lambda a, b: a | b, [(F.col("name") == x) | F.col("name").startswith(x + "/") for x in TEST_LIBRARIES])
    imports = code.where((F.col("kind") == "import") & library)
    tell = lambda what, c: F.concat(F.lit(f"{what} `"), c, F.lit("`"))
    a = _rows(f, "no-test-code-in-production", calls, detail=tell("test global", _a("callee")), subject=_a("callee"))
    return a.unionByName(_rows(f, "no-test-code-in-production", imports, detail=tell("test library import", F.col("name")), subject=F.col("name")))


def _sorted_runs(f: Facts, kinds: tuple[str, ...], key: Column) -> DataFrame:
    """Top-level statements of a kind with their contiguous run (``run``), their
    blank-line group (``grp``) and their place in both."""
    top = f.syn.where(F.col("parent_id").isNull() & ~F.col("kind").isin("comment", "directive", "failure"))
    w = W.partitionBy("path").orderBy("stmt_index")
    mine = F.col("kind").isin(*kinds)
    last = _a("last_line").cast("int")
    rows = top.withColumn("mine", mine).withColumn("last", last).withColumn("run", F.sum(F.when(mine & F.lag("mine", 1, False).over(w), 0).otherwise(1)).over(w))
    rows = rows.where("mine").withColumn("key", F.lower(key))
    r = W.partitionBy("path", "run").orderBy("stmt_index")
    return rows.withColumn("grp", F.sum(F.when(F.col("line") - F.lag("last").over(r) > 1, 1).otherwise(0)).over(r))


def _disorder(rows: DataFrame, bucket: Column) -> DataFrame:
    """Within each run, rows whose stable order by bucket and key differs
    from where they stand."""
    here, there = W.partitionBy("path", "run").orderBy("stmt_index"), W.partitionBy("path", "run").orderBy("bucket", "key", "stmt_index")
    return rows.withColumn("bucket", bucket).withColumn("at", F.row_number().over(here)).withColumn("due", F.row_number().over(there)).where("at <> due")


def _out_of_order(rows: DataFrame) -> DataFrame:
    """The later of two neighbours of a blank-line group in wrong order."""
    w = W.partitionBy("path", "run", "grp").orderBy("stmt_index")
    return rows.withColumn("before", F.lag("key").over(w)).where("before > key")


def _newlines(f: Facts, name: str, rows: DataFrame, bucket: Column, noun: str) -> DataFrame | None:
    """Blank lines between neighbours, asked for or forbidden."""
    mode = f.config.get(name, "newlines-between")
    w = W.partitionBy("path", "run").orderBy("stmt_index")
    pairs = rows.withColumn("bucket", bucket).withColumn("gap", F.lead("grp").over(w) > F.col("grp")).withColumn("nb", F.lead("bucket").over(w)).where("nb is not null")
    spot = (F.col("end"), F.col("end"), F.col("line"), F.col("column"))
    if mode == "never":
        return _rows(f, name, pairs.where("gap"), message=f"{noun} declarations should not be separated by a blank line.", place=spot)
    if mode == "always":
        return _rows(f, name, pairs.where("not gap and nb <> bucket"), message=f"{noun} groups should be separated by a blank line.", place=spot)
    return None


def _import_rows(f: Facts) -> tuple[DataFrame, Column]:
    """Imports in their runs, and the group that each belongs to."""
    order = f.config.get("sort-imports", "groups")
    internal = paths.matches_any(F.col("name"), f.config.get("sort-imports", "internal-patterns"))
    kind = paths.specifier_class(F.col("name"), internal)
    bucket = reduce(lambda acc, ig: F.when(kind == ig[1], ig[0]).otherwise(acc), enumerate(order), F.lit(len(order)))
    return _sorted_runs(f, ("import",), F.col("name")), bucket


def _export_rows(f: Facts) -> DataFrame:
    """A default export sorts first, ``export *`` by its module."""
    first = F.split(F.coalesce(_a("exported"), F.lit("")), ",")[0]
    key = F.when(F.col("kind") == "export_default", "").when(F.col("kind") == "export_all", F.col("name")).when(F.col("kind").isin("export_names", "export_from"), first).otherwise(F.coalesce("name", F.lit("")))
    return _sorted_runs(f, ("export", "export_default", "export_all", "export_names", "export_from"), key)


def sorted_statements(f: Facts) -> dict[str, tuple[DataFrame, Column, list[str]]]:
    """For each sorting rule its statements, what they sort by, and the columns
    of what is sorted together."""
    imports, bucket = _import_rows(f)
    grouped = bool(f.config.options.get("sort-imports", {}).get("groups"))
    by = F.concat(F.lpad(bucket.cast("string"), 3, "0"), F.lit("\x00"), F.col("key")) if grouped else F.col("key")
    return {"sort-imports": (imports, by, ["run"] if grouped else ["run", "grp"]), "sort-exports": (_export_rows(f), F.col("key"), ["run", "grp"])}


@rule("sort-imports")
def sort_imports(f: Facts) -> DataFrame:
    rows, bucket = _import_rows(f)
    bad = _disorder(rows, bucket) if f.config.options.get("sort-imports", {}).get("groups") else _out_of_order(rows)
    out = _rows(f, "sort-imports", bad, subject=F.col("name"))
    more = _newlines(f, "sort-imports", rows, bucket, "Import")
    return out.unionByName(more) if more is not None else out


@rule("sort-exports")
def sort_exports(f: Facts) -> DataFrame:
    rows = _export_rows(f)
    out = _rows(f, "sort-exports", _out_of_order(rows), subject=F.col("key"))
    more = _newlines(f, "sort-exports", rows, F.col("kind"), "Export")
    return out.unionByName(more) if more is not None else out


@rule("no-default-export")
def no_default_export(f: Facts) -> DataFrame:
    named = (F.col("kind").isin("export_names", "export_from")) & F.array_contains(F.split(F.coalesce(_a("exported"), F.lit("")), ","), "default")
    rows = f.syn.where((F.col("kind") == "export_default") | named)
    if f.config.get("no-default-export", "components-only"):
        rows = rows.where(f.config.domain("components"))
        return _rows(f, "no-default-export", rows, message="Components must use named exports so imports stay explicit and refactorable.")
    return _rows(f, "no-default-export", rows)


@rule("no-export-star")
def no_export_star(f: Facts) -> DataFrame:
    return _rows(f, "no-export-star", f.where("export_all").where(_a("alias") == ""), subject=F.col("name"))


@rule("no-mutable-exports")
def no_mutable_exports(f: Facts) -> DataFrame:
    return _rows(f, "no-mutable-exports", f.where("export").where(_a("decl").isin("let", "var")), subject=F.col("name"))


@rule("max-file-exports")
def max_file_exports(f: Facts) -> DataFrame:
    most = f.config.get("max-file-exports", "max-exports")
    kinds = ["export", "export_names", "export_from", "export_all"] + ["export_default"] * bool(f.config.get("max-file-exports", "count-default"))
    weight = F.coalesce(_a("weight").cast("int"), F.lit(1))
    rows = f.where(*kinds).groupBy("path").agg(F.sum(weight).alias("n")).where(F.col("n") > most)
    return _rows(f, "max-file-exports", rows, detail=F.format_string(f"File has %d exports; the maximum is {most}.", F.col("n")), place=_first_line())


@rule("no-barrel-files")
def no_barrel_files(f: Facts) -> DataFrame:
    barrels = f.sources.where(BASE().isin(*f.config.get("no-barrel-files", "barrel-names"))).select("path")
    return _rows(f, "no-barrel-files", barrels.join(f.where("export_from", "export_all").select("path"), "path", "left_semi"), place=NOWHERE)


@rule("no-logic-in-barrel")
def no_logic_in_barrel(f: Facts) -> DataFrame:
    """The first statement that re-exports nothing; imports are logic too."""
    top = f.syn.where(F.col("parent_id").isNull() & BASE().isin(*f.config.get("no-logic-in-barrel", "barrel-names")))
    rows = top.where(~F.col("kind").isin("export_from", "export_all", "comment", "directive", "failure"))
    first = rows.groupBy("path").agg(F.min_by(F.struct("start", "end", "line", "column"), "start").alias("s")).select("path", "s.*")
    return _rows(f, "no-logic-in-barrel", first)


@rule("max-function-params")
def max_function_params(f: Facts) -> DataFrame:
    most = f.config.get("max-function-params", "max-params")
    n = _a("n_params").cast("int")
    rows = f.where("function", "function_expr", "arrow", "method", "object_method", "constructor").where((n > most) & ~_is("overload"))
    spot = tuple(F.coalesce(a, F.col(b)) for a, b in zip(_named("name"), ("start", "end", "line", "column")))
    return _rows(f, "max-function-params", rows, detail=F.format_string(f"Function has %d parameters; the maximum is {most}.", n), subject=F.col("name"), place=spot)


def _exported_functions(f: Facts, *kinds: str) -> DataFrame:
    return f.where(*kinds).where("exported")


@rule("prefer-readonly")
def prefer_readonly(f: Facts) -> DataFrame:
    owners = _exported_functions(f, "function", "arrow", "function_expr").select("path", F.col("node_id").alias("owner"), F.coalesce("name", _a("bound_name")).alias("fn"))
    rows = f.where("param").where(_is("mutable_array")).join(owners, ["path"]).where("parent_id = owner")
    subject = F.concat_ws(".", F.coalesce("fn", F.lit("default")), F.col("name"))
    return _rows(f, "prefer-readonly", rows, subject=subject)


@rule("explicit-return-type")
def explicit_return_type(f: Facts) -> DataFrame:
    get = lambda o: f.config.get("explicit-return-type", o)
    kinds = ["function", "function_expr"] + ["arrow"] * get("include-arrow-functions") + ["method"] * get("include-class-methods")
    rows = f.where(*kinds).where(~_is("has_return") & ~_is("overload"))
    if get("ignore-when-inferred"):
        rows = rows.where(~_is("typed_binding"))
    if not get("include-private"):
        in_class = F.array_contains("anc", "class") & F.array_contains("anc", "export") | F.array_contains("anc", "class") & F.array_contains("anc", "export_default")
        rows = rows.where(F.col("exported") | (F.col("kind") == "method") & in_class)
    else:
        rows = rows.where(F.col("kind").isin("function", "method") | _is("is_init") | F.col("exported"))
    spot = tuple(F.coalesce(a, b, F.col(c)) for a, b, c in zip(_named("name"), _named("bound"), ("start", "end", "line", "column")))
    return _rows(f, "explicit-return-type", rows, subject=F.coalesce("name", _a("bound_name")), place=spot)


# -- domain rules


def _prefixed(name: Column, prefixes: list[str]) -> Column:
    return name.rlike("^(?:" + "|".join(prefixes) + ")[A-Z]")


@rule("boolean-prefix")
def boolean_prefix(f: Facts) -> DataFrame:
    kinds = ("let",) if f.config.get("boolean-prefix", "ignore-constants") else ("let", "const")
    boolean = _a("type").isin("boolean", "Boolean") | (_a("init") == "boolean")
    rows = f.where("declarator").where(_a("decl").isin(*kinds) & boolean & F.col("name").isNotNull() & ~_prefixed(F.col("name"), f.config.get("boolean-prefix", "prefixes")))
    return _rows(f, "boolean-prefix", rows, subject=F.col("name"))


PASCAL = "^[A-Z][A-Za-z0-9]*$"


@rule("component-file-only-components")
def component_file_only_components(f: Facts) -> DataFrame:
    files = f.config.domain("components") & F.col("path").endswith(".tsx")
    bad_kind = _a("what").isin("type_alias", "interface", "enum", "namespace")
    named = (F.col("kind") == "export") & (bad_kind | ~F.coalesce(F.col("name"), F.lit("")).rlike(PASCAL))
    default = (F.col("kind") == "export_default") & F.col("name").isNotNull() & ~F.col("name").rlike(PASCAL)
    listed = (F.col("kind") == "export_names") & (_is("type_only") | ~F.forall(F.split(F.coalesce(_a("exported"), F.lit("X")), ","), lambda x: x.rlike(PASCAL) | (x == "default")))
    return _rows(f, "component-file-only-components", f.syn.where(files & (named | default | listed)), subject=F.col("name"))


CONTROL = ("if", "for", "for_in", "for_of", "for_await", "while", "do", "switch", "try")


@rule("entry-file-no-logic")
def entry_file_no_logic(f: Facts) -> DataFrame:
    """Top level only; what is exported by name is exempt."""
    entry = paths.is_entry(F.col("path"), f.config.get("entry-file-no-logic", "entry-files"))
    top = F.col("parent_id").isNull() & F.col("kind").isin("function", "class", *CONTROL)
    valued = (F.col("kind") == "declarator") & (F.size("anc") == 1) & _is("function_valued")
    default = F.col("kind").isin("class", "function") & (F.element_at(F.concat(F.array(F.lit("")), F.col("anc")), -1) == "export_default") & (F.size("anc") == 1)
    what = F.when(F.col("kind") == "class", "Class").when(F.col("kind") == "function", "Function").when(F.col("kind") == "declarator", "Arrow function").otherwise("Control flow")
    detail = F.concat(what, F.lit(" contains logic that should be moved to a dedicated module."))
    return _rows(f, "entry-file-no-logic", f.syn.where(entry & (top | valued | default & (F.col("kind") == "class"))), detail=detail, subject=F.col("name"))


@rule("hook-no-jsx")
def hook_no_jsx(f: Facts) -> DataFrame:
    rows = f.where("jsx").where(f.config.domain("hooks"))
    first = rows.groupBy("path").agg(F.min_by(F.struct("start", "end", "line", "column"), "start").alias("s")).select("path", "s.*")
    return _rows(f, "hook-no-jsx", first)


@rule("hook-prefix")
def hook_prefix(f: Facts) -> DataFrame:
    named = (F.col("kind") == "function") & F.col("name").isNotNull() | (F.col("kind") == "declarator") & _is("function_valued") & _a("decl").isin("let", "const")
    rows = f.syn.where(f.config.domain("hooks") & named & ~_prefixed(F.col("name"), f.config.get("hook-prefix", "prefixes")))
    spot = tuple(F.coalesce(a, F.col(b)) for a, b in zip(_named("name"), ("start", "end", "line", "column")))
    return _rows(f, "hook-prefix", rows, subject=F.col("name"), place=spot)


@rule("no-inline-types")
def no_inline_types(f: Facts) -> DataFrame:
    """Where the tree keeps types decides where they may stand."""
    folders, suffixes = f.config.domains["types"]
    foldered, suffixed = paths.in_domain(F.col("path"), folders, []), paths.in_domain(F.col("path"), [], suffixes)
    style = f.sources.agg(F.coalesce(F.bool_or(suffixed), F.lit(False)).alias("any_suffix"), F.coalesce(F.bool_or(foldered), F.lit(False)).alias("any_folder"))
    ok = suffixed & (F.col("any_suffix") | ~F.col("any_folder")) | foldered & F.col("any_folder") | F.col("path").endswith(".d.ts")
    rows = f.where("interface", "type_alias").crossJoin(F.broadcast(style)).where(~ok)  # style is one row
    return _rows(f, "no-inline-types", rows, subject=F.col("name"))


@rule("no-logic-in-domain")
def no_logic_in_domain(f: Facts) -> DataFrame:
    types, constants = f.config.domain("types"), f.config.domain("constants")
    top = (F.size("anc") == 0) | (F.size("anc") == 1) & F.get("anc", F.lit(0)).isin("export", "export_default")
    var = (F.col("kind") == "declarator") & F.when(F.get("anc", F.lit(0)) == "variables", F.size("anc") == 1).otherwise((F.get("anc", F.lit(0)) == "export") & (F.size("anc") == 2))
    code = F.col("kind").isin("function", "class") & top
    bad = types & (code | var) | constants & ~types & (code | var & ((_a("decl") != "const") | _is("function_valued")))
    return _rows(f, "no-logic-in-domain", f.syn.where(bad & ~_is("declare")), subject=F.col("name"))


# -- TypeScript rules


@rule("no-any")
def no_any(f: Facts) -> DataFrame:
    get = lambda o: f.config.get("no-any", o)
    exempt = f.config.domain("generated")
    for folder in get("allowed-folders"):
        exempt = exempt | F.col("path").contains(folder)
    for pattern in get("allow-explicit-any-in"):
        exempt = exempt | F.col("path").rlike(pattern)
    rows = f.where("t_keyword").where((F.col("name") == "any") & ~exempt)
    if get("allow-in-types"):
        rows = rows.where(~F.arrays_overlap("anc", F.array(F.lit("type_alias"), F.lit("interface"))))
    return _rows(f, "no-any", rows)


@rule("no-empty-interface")
def no_empty_interface(f: Facts) -> DataFrame:
    return _rows(f, "no-empty-interface", f.where("interface").where(_is("empty")), subject=F.col("name"))


@rule("no-enums")
def no_enums(f: Facts) -> DataFrame:
    return _rows(f, "no-enums", f.where("enum"), subject=F.col("name"))


@rule("no-interface")
def no_interface(f: Facts) -> DataFrame:
    rows = f.where("interface")
    if f.config.get("no-interface", "allow-declaration-merging"):
        rows = rows.withColumn("n", F.count("*").over(W.partitionBy("path", "name"))).where("n <= 1")
    return _rows(f, "no-interface", rows, subject=F.col("name"))


@rule("no-namespace")
def no_namespace(f: Facts) -> DataFrame:
    return _rows(f, "no-namespace", f.where("namespace").where(_a("word") == "namespace"), subject=F.col("name"))


@rule("no-non-null-assertion")
def no_non_null_assertion(f: Facts) -> DataFrame:
    return _rows(f, "no-non-null-assertion", f.where("non_null"))


@rule("no-type-assertion")
def no_type_assertion(f: Facts) -> DataFrame:
    return _rows(f, "no-type-assertion", f.where("as"))


@rule("no-unnecessary-type-assertion")
def no_unnecessary_type_assertion(f: Facts) -> DataFrame:
    pairs = {"string": "string", "template": "string", "number": "number", "boolean": "boolean", "null": "null"}
    hit = reduce(lambda a, b: a | b, [(_a("expr") == e) & (_a("type") == "t_keyword") & (_a("type_name") == t) for e, t in pairs.items()])
    return _rows(f, "no-unnecessary-type-assertion", f.where("as").where(hit))


SURE = ("array", "arrow", "object", "function_expr", "class_expr", "new", "template", "boolean", "number", "string", "regex", "non_null", "meta")


@rule("no-unsafe-optional-chaining")
def no_unsafe_optional_chaining(f: Facts) -> DataFrame:
    """An optional link whose own left side can never be missing."""
    links = f.where("member", "index", "call").where(_is("optional")).select("path", F.col("node_id").alias("link"), "start", "end", "line", "column")
    left = f.syn.where(F.col("kind").isin(*SURE) | (F.col("kind") == "id") & (F.col("name") == "this")).select("path", F.col("parent_id").alias("link"), F.col("start").alias("s"))
    return _rows(f, "no-unsafe-optional-chaining", links.join(left, ["path", "link"]).where("s = start").dropDuplicates(["path", "link"]))


@rule("prefer-satisfies")
def prefer_satisfies(f: Facts) -> DataFrame:
    literal = _a("expr").isin("object", "array", "string", "number", "boolean", "template", "null")
    weak = (_a("type") == "t_const") | (_a("type") == "t_keyword") & _a("type_name").isin("any", "unknown")
    return _rows(f, "prefer-satisfies", f.where("as").where(literal & ~weak))


@rule("no-magic-numbers")
def no_magic_numbers(f: Facts) -> DataFrame:
    get = lambda o: f.config.get("no-magic-numbers", o)
    value = _a("number").cast("double")
    allowed = reduce(lambda a, x: a | (F.abs(value - float(x)) < 1e-9), get("allowed-numbers"), F.lit(False))
    out = _rows(f, "no-magic-numbers", f.where("number").where(~_is("exempt") & ~F.coalesce(allowed, F.lit(False))), subject=_a("value"))
    if get("enforce-strings"):
        texts = f.where("string").where(~_is("exempt"))
        texts = texts.where(~F.col("name").isin(*get("allowed-strings"))) if get("allowed-strings") else texts
        out = out.unionByName(_rows(f, "no-magic-numbers", texts, subject=F.col("name"), message="No magic strings. Extract string literals to named constants."))
    return out


@rule("no-process-env")
def no_process_env(f: Facts) -> DataFrame:
    chain = _a("path").rlike(r"^process\.env($|[.\[])")
    return _rows(f, "no-process-env", f.where("member", "index").where(chain & _is("outermost")), subject=_a("path"))


# -- hygiene rules


@rule("no-console")
def no_console(f: Facts) -> DataFrame:
    """Calls on console, and of names taken from it earlier in the file."""
    code = f.syn.where(~paths.matches_any(F.col("path"), f.config.get("no-console", "allow-patterns")))
    calls = code.where(F.col("kind") == "call")
    direct = calls.where(_a("callee").rlike(r"^console(\.\w+|\[\])$"))
    taken = code.where((F.col("kind") == "binding") & _is("from_console")).select("path", F.col("name").alias("alias"), F.col("start").alias("since"))
    named = calls.join(taken.groupBy("path", "alias").agg(F.min("since").alias("since")), "path").where((_a("callee") == F.col("alias")) & (F.col("start") > F.col("since"))).select(calls.columns)
    return _rows(f, "no-console", direct.unionByName(named), subject=_a("callee"))


@rule("no-debugger")
def no_debugger(f: Facts) -> DataFrame:
    return _rows(f, "no-debugger", f.where("debugger"))


@rule("no-eval")
def no_eval(f: Facts) -> DataFrame:
    hit = (F.col("kind") == "call") & (_a("callee") == "eval") | (F.col("kind") == "new") & (_a("callee") == "Function")
    return _rows(f, "no-eval", f.syn.where(hit), subject=_a("callee"), place=_named("callee"))


def _test_calls(f: Facts, name: str, word: str) -> DataFrame:
    rows = f.where("call").where(_a("callee").isin(*[f"{x}.{word}" for x in ("describe", "it", "test")]))
    return _rows(f, name, rows, subject=_a("callee"), place=_named("callee"))


@rule("no-focused-test")
def no_focused_test(f: Facts) -> DataFrame:
    return _test_calls(f, "no-focused-test", "only")


@rule("no-skipped-test")
def no_skipped_test(f: Facts) -> DataFrame:
    return _test_calls(f, "no-skipped-test", "skip")


@rule("no-await-in-loop")
def no_await_in_loop(f: Facts) -> DataFrame:
    """Nested functions do not reset the loop."""
    return _rows(f, "no-await-in-loop", f.where("await").where(F.arrays_overlap("anc", F.array(*map(F.lit, LOOPS)))))


@rule("no-promise-executor-return")
def no_promise_executor_return(f: Facts) -> DataFrame:
    at = _a("executor_depth").cast("int")
    valued = (F.col("kind") == "return") & _is("valued") & (at == 1)
    return _rows(f, "no-promise-executor-return", f.syn.where(valued | (F.col("kind") == "arrow") & _is("expression_body") & (at == 1)))


@rule("no-silent-catch")
def no_silent_catch(f: Facts) -> DataFrame:
    return _rows(f, "no-silent-catch", f.where("try").where(_is("silent")))


@rule("no-then-chain")
def no_then_chain(f: Facts) -> DataFrame:
    rows = f.where("call").where(_is("then"))
    return _rows(f, "no-then-chain", rows.where(_is("chained")) if f.config.get("no-then-chain", "allow-single") else rows)


@rule("no-comments")
def no_comments(f: Facts) -> DataFrame:
    doc = _is("doc") if f.config.get("no-comments", "allow-doc-comments") else F.lit(False)
    return _rows(f, "no-comments", f.where("comment").where(~_is("directive") & ~doc))


@rule("no-abbreviations")
def no_abbreviations(f: Facts) -> DataFrame:
    get = lambda o: f.config.get("no-abbreviations", o)
    words = [w for w in ("btn", "ctx", "mgr", *get("extra-abbreviations")) if w not in get("allow-abbreviations")]
    hit = F.lit(None).cast("string")
    for p in reversed(get("abbreviation-patterns")):
        hit = F.when(F.col("name").rlike(f"(?i){p}"), p).otherwise(hit)
    for w in reversed(words):
        hit = F.when(F.lower("name").contains(w.lower()), w).otherwise(hit)
    rows = f.where("binding", "param", "import_name", "catch_param", "function", "class", "interface", "type_alias", "enum").where("name is not null").withColumn("hit", hit).where("hit is not null")
    if get("ignore-destructured"):
        rows = rows.where(~F.array_contains("anc", "pattern"))
    if get("ignore-properties"):
        rows = rows.where(~F.coalesce(_is("in_object"), F.lit(False)))
    spot = tuple(F.coalesce(a, F.col(b)) for a, b in zip(_named("name"), ("start", "end", "line", "column")))
    return _rows(f, "no-abbreviations", rows, detail=F.concat(F.lit("contains `"), F.col("hit"), F.lit("`")), subject=F.col("name"), place=spot)


@rule("no-nested-functions")
def no_nested_functions(f: Facts) -> DataFrame:
    named = {"function": ("function", "function_expr"), "arrow": ("arrow",), "class-method": ("method", "constructor", "getter", "setter"), "object-method": ("object_method",)}
    counted = [k for c in f.config.get("no-nested-functions", "contexts") for k in named[c]]
    most = f.config.get("no-nested-functions", "max-depth")
    depth = F.size(F.filter("anc", lambda k: k.isin(*counted))) + 1
    return _rows(f, "no-nested-functions", f.where(*counted).where(depth > most), detail=F.format_string(f"Depth %d exceeds maximum of {most}.", depth), subject=F.col("name"))


# -- running them


def catalogue(spark: SparkSession, config: Config | None = None) -> DataFrame:
    """The rules with category, level, fixability and conflicts."""
    config = config or Config()
    rows = [(n, c, s, config.level(n), n in FIXABLE, CONFLICTS.get(n, []), m) for n, c, s, m in CATALOGUE]
    return spark.createDataFrame(rows, "name string, category string, default_severity string, severity string, fixable boolean, conflicts array<string>, message string")


GRAPH = ("no-upward-import", "layer-boundaries", "no-test-import", "no-barrel-chain", "no-circular-import", "no-orphan-files", "no-private-package-import", "no-package-cycle")
UNSUPPRESSED = ("no-duplicate-file-names", "no-dump-files")


def run(f: Facts, names: list[str] | None = None) -> DataFrame:
    """Raw findings of the enabled rules; graph rules leave out files that did
    not parse."""
    names = [n for n, *_ in CATALOGUE if n in (names or RULES) and f.config.level(n) != "off"]
    broken = extract.failures(f.syn).select("file").distinct()
    parts = []
    for n in names:
        rows = RULES[n](f).select(*COLUMNS)
        parts.append(rows.join(broken, "file", "left_anti") if n in GRAPH else rows)
    if not parts:
        return f.spark.createDataFrame([], "file string, start int, end int, line int, column int, rule string, message string, severity string, detail string, subject string")
    return reduce(DataFrame.unionByName, parts)


def lint(f: Facts, baseline: DataFrame | None = None, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Everything a report needs: findings kept, raw findings, stale
    directives, parse failures."""
    raw = materialize(run(f, names), "raw")
    directives = extract.directives(f.syn)
    exempt = raw["rule"].isin(*UNSUPPRESSED) | raw["line"].isNull() & (raw["rule"] != "no-barrel-files")
    kept = post.suppress(raw.where(~exempt), directives).unionByName(raw.where(exempt))
    if baseline is not None:
        kept = post.without_baseline(kept, baseline)
    return {"violations": kept, "raw": raw, "stale": post.stale(directives, raw), "failures": extract.failures(f.syn), "directives": directives}
