import json
import os
import subprocess
import tomllib

import pytest
from pyspark.sql import functions as F

from stratalens.functions import paths
from stratalens.operators import cache, fix, post
from stratalens.plans import config, report, rewrites, rules
from stratalens.sources import extract, project
from stratalens.sources.typescript import SyntaxFailure, parse
from stratalens.streaming import watch

FILES = {
    "src/a.ts": "import { b } from './b';\ndebugger;\nconst x: any = y!;\n// lint-ignore-next-line no-debugger\ndebugger;\n",
    "src/b.ts": "import { a } from './a';\nexport const o = { p: 1 } as Foo;\nit.only('t', () => {});\nexport function f(z: string[]): void {}\n",
    "src/bad.ts": "const = ;",
    "src/index.ts": "",
}
NAMES = ["no-debugger", "no-any", "no-non-null-assertion", "no-circular-import", "prefer-satisfies", "no-focused-test", "prefer-readonly", "no-empty-domain", "no-orphan-files"]


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, source string")


def keys(df):
    return sorted((r.file, r.line or 0, r.rule) for r in df.collect())


@pytest.fixture(scope="module")
def linted(spark):
    facts = rules.Facts(frame(spark, FILES))
    return facts, rules.lint(facts, names=NAMES)


def test_lint_suppresses_and_reports_failures(linted):
    _, out = linted
    assert ("src/a.ts", 2, "no-debugger") in keys(out["violations"]) and ("src/a.ts", 5, "no-debugger") not in keys(out["violations"])
    assert ("src/a.ts", 5, "no-debugger") in keys(out["raw"])
    assert [r.file for r in out["failures"].collect()] == ["src/bad.ts"] and out["stale"].count() == 0
    assert ("src/a.ts", 1, "no-circular-import") in keys(out["violations"])


def test_reports(spark, linted, tmp_path):
    facts, out = linted
    v, failures = out["violations"], out["failures"]
    summary = post.summary(v, 4)
    doc = json.loads(report.as_json(v, failures, summary, out["stale"]))
    assert doc["summary"]["n_files"] == 4 and len(doc["violations"]) == v.count() and doc["parseFailures"]
    log = json.loads(report.sarif(v, failures))
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == v.count() and not log["runs"][0]["invocations"][0]["executionSuccessful"]
    rows = [json.loads(r.value) for r in report.ndjson(v, failures, summary).collect()]
    assert rows[0]["type"] == "summary" and sum(r["type"] == "violation" for r in rows) == v.count()
    assert "| error | no-debugger | src/a.ts | 2 |" in report.markdown(v, summary)
    told = report.text(v, summary)
    assert "no-debugger" in told and "src/a.ts:2" in told
    dot = report.graph_dot(facts.sources.select("path"), facts.edges)
    assert '"src/a.ts" -> "src/b.ts"' in dot and '"src/index.ts" [color=blue]' in dot
    assert json.loads(report.graph_json(facts.sources.select("path"), facts.edges))["edges"][0]["kind"] == "Import"
    stats = report.statistics(facts.sources, facts.edges)
    assert stats["files"] == 4 and stats["imports"] == 2 and "Most imported:" in report.statistics_text(stats)
    report.publish("x", str(tmp_path / "deep/er/out.txt"))
    assert (tmp_path / "deep/er/out.txt").read_text() == "x"
    with pytest.raises(ValueError):
        report.check_format("stats", "sarif")


def test_baseline_and_history(spark, linted, tmp_path):
    _, out = linted
    project.write_baseline(post.make_baseline(out["violations"]), str(tmp_path / "b.json"))
    known = project.read_baseline(spark, str(tmp_path / "b.json"))
    assert post.without_baseline(out["violations"], known).count() == 0
    assert post.pruned_baseline(known, out["violations"].limit(0)).count() == 0
    project.append_history(post.summary(out["violations"], 4), str(tmp_path / "h"))
    with open(tmp_path / "h" / "broken.json", "w") as f:
        f.write("{not json\n")
    assert [r.files for r in project.read_history(spark, str(tmp_path / "h")).collect()] == [4]


def test_fixes_are_applied_and_idempotent(spark, linted, tmp_path):
    facts, out = linted
    fixed = fix.apply(facts.sources, fix.collect(out["violations"], facts.syn))
    rows = {r.path: r for r in fixed.collect()}
    assert rows["src/a.ts"].after == "import { b } from './b';\n\nconst x: unknown = y;\n// lint-ignore-next-line no-debugger\ndebugger;\n"
    assert rows["src/b.ts"].after.splitlines()[1:] == ["export const o = { p: 1 } satisfies Foo;", "it('t', () => {});", "export function f(z: readonly string[]): void {}"]
    os.makedirs(tmp_path / "src")
    (tmp_path / "src/a.ts").write_text(FILES["src/a.ts"])
    (tmp_path / "src/b.ts").write_text("changed meanwhile")
    assert fix.write_back(fixed, str(tmp_path), dry_run=True)[0] == ("src/a.ts", "would change")
    assert fix.write_back(fixed, str(tmp_path)) == [("src/a.ts", "written"), ("src/b.ts", "changed on disk")]
    again = rules.Facts(frame(spark, {p: r.after for p, r in rows.items()}))
    left = rules.lint(again, names=["no-any", "no-debugger", "prefer-satisfies", "no-focused-test", "prefer-readonly"])["violations"]
    assert fix.collect(left, again.syn).count() == 0


def test_overlapping_and_bad_edits(spark):
    df = spark.createDataFrame([("a", "r", 1, 1, 0, 5, "x"), ("a", "r", 2, 2, 4, 6, "y"), ("a", "r", 3, 3, 8, 9, "z")], "path string, rule string, fix_id long, edit_id long, start int, end int, replacement string")
    assert [r.fix_id for r in fix.accepted(df).collect()] == [3]
    assert fix.splice("aéb".encode(), [(2, 3, "")]) is None and fix.splice(b"abc", [(2, 9, "")]) is None
    assert fix.splice(b"abc", [(1, 2, "X"), (3, 3, "!")]) == b"aXc!"


def test_every_fixable_rule_has_a_fix(spark):
    """Each fix applied once leaves nothing for its rule to report or to fix."""
    files = {
        "any.ts": ("no-any", "let a: any;\n", "let a: unknown;\n"),
        "dbg.ts": ("no-debugger", "debugger;\nf();\n", "\nf();\n"),
        "iface.ts": ("no-empty-interface", "export interface A<T> { };\ninterface B extends C {}\ninterface D {}\ninterface D { x: 1 }\n", "export type A<T> = Record<string, never>;\ninterface B extends C {}\ninterface D {}\ninterface D { x: 1 }\n"),
        "only.ts": ("no-focused-test", "it.only('é', f);\n", "it('é', f);\n"),
        "nn.ts": ("no-non-null-assertion", "const a = b!;\n", "const a = b;\n"),
        "env.ts": ("no-process-env", "const a = process.env.A, b = process.env.B; // x\r\nconst c = `${process.env.C}\n`;\nlast(process.env)", "const a = process.env.A, b = process.env.B; // x // lint-ignore-line no-process-env\r\nconst c = `${process.env.C}\n`;\nlast(process.env) // lint-ignore-line no-process-env"),
        "skip.ts": ("no-skipped-test", "test.skip('x', f);\n", "test('x', f);\n"),
        "ro.ts": ("prefer-readonly", "export function f(a: string[]): void {}\n", "export function f(a: readonly string[]): void {}\n"),
        "sat.ts": ("prefer-satisfies", "const a = { b: 1 } as Foo;\n", "const a = { b: 1 } satisfies Foo;\n"),
        "exp.ts": ("sort-exports", "export const b = 'é';\nexport const a = 2;\n\nexport { z };\n", "export const a = 2;\nexport const b = 'é';\n\nexport { z };\n"),
        "imp.ts": ("sort-imports", "import c from 'c';\nimport {\n  b,\n} from 'b';\nimport a from 'a';\n\nimport y from 'y';\n// why\nimport x from 'x';\n", "import a from 'a';\nimport {\n  b,\n} from 'b';\nimport c from 'c';\n\nimport y from 'y';\n// why\nimport x from 'x';\n"),
    }
    assert {r for r, _, _ in files.values()} == set(rules.FIXABLE)
    facts = rules.Facts(frame(spark, {p: s for p, (_, s, _) in files.items()}), rules.Config(severity={r: "warn" for r in rules.FIXABLE}))
    v = rules.lint(facts, names=list(rules.FIXABLE))["violations"]
    edits = rewrites.collect(facts, v)
    for rule in rules.FIXABLE:
        mine = {p: s for p, (r, s, _) in files.items() if r == rule}
        done = {r.path: r.after for r in fix.apply(facts.sources.where(F.col("path").isin(*mine)), edits.where(F.col("rule") == rule)).collect()}
        assert done == {p: files[p][2] for p in mine}, rule
    assert "+let a: unknown;" in {r.path: r.diff for r in rewrites.previews(fix.apply(facts.sources, edits)).collect()}["any.ts"]


def test_options_of_names(spark):
    files = frame(spark, {"a.ts": "const { submitBtn, x: { yBtn } } = q;\nconst [aBtn] = z;\nconst done: boolean = f();\nlet open: boolean = f();\n"})
    seen = lambda rule, options: sorted(r.subject for r in rules.RULES[rule](rules.Facts(files, rules.Config(options={rule: options}))).collect())
    assert seen("no-abbreviations", {}) == ["aBtn", "submitBtn", "yBtn"]
    assert seen("no-abbreviations", {"ignore-properties": True}) == ["aBtn"]
    assert seen("no-abbreviations", {"ignore-destructured": True}) == []
    assert seen("boolean-prefix", {}) == ["done", "open"] and seen("boolean-prefix", {"ignore-constants": True}) == ["open"]


#: Some of what each preset sets.  Fixed values.
PRESET_LEVELS = {
    "balanced": {"no-console": "warn", "no-barrel-files": "info", "prefer-readonly": "warn", "no-any": None},
    "strict": {"no-console": "error", "no-large-file": "warn", "no-nested-functions": "warn", "entry-file-no-logic": "error", "no-then-chain": "error"},
    "migration": {"no-console": "off", "no-large-file": "info", "max-function-params": "info", "no-silent-catch": "error", "no-test-import": "error"},
    "react": {"hook-prefix": "error", "component-file-only-components": "warn", "boolean-prefix": "info", "no-silent-catch": "warn", "no-comments": None},
    "library": {"no-console": "off", "explicit-return-type": "error", "no-barrel-chain": "info", "prefer-readonly": "error", "no-enums": None},
    "no-barrels": {"no-barrel-files": "error", "directory-must-have-barrel": "off", "no-export-star": "error", "no-debugger": "error"},
}


@pytest.mark.parametrize("name", sorted(config.PRESETS))
def test_presets(tmp_path, name):
    chosen = config.preset(name)
    assert config.check(chosen) == []
    assert {r: chosen["rules"].get(r, {}).get("severity") for r in PRESET_LEVELS[name]} == PRESET_LEVELS[name]
    with open(config.init(str(tmp_path), name), "rb") as f:
        assert tomllib.load(f) == chosen
    with pytest.raises(FileExistsError):
        config.init(str(tmp_path), name)
    built = config.build(chosen)
    for rule, default in ((n, s) for n, _, s, _ in rules.CATALOGUE if n not in chosen["rules"]):
        assert built.level(rule) == default


def test_watch_state_is_durable(spark, tmp_path):
    """Only changed files are parsed; a new watcher goes on from the stored state,
    and a batch that is run again gives the same findings as a full run."""
    names = [*NAMES, "no-console", "no-empty-directories", "no-duplicate-file-names"]
    log = [{"src/c.ts": "import './a';\nconsole.log(1);\n"}, {"src/a.ts": "import { b } from './b';\n", "src/x/b.ts": ""}, {"src/b.ts": None}]
    first = watch.Watcher(frame(spark, FILES), names=names, state=f"file://{tmp_path}/s")
    now, seen = dict(FILES), []
    for i, change in enumerate(log):
        watcher = first if i < 2 else watch.Watcher(frame(spark, FILES), names=names, state=f"file://{tmp_path}/s")
        rows = spark.createDataFrame(list(change.items()), "path string, source string")
        for _ in range(2):
            seen = keys(watcher.step(rows, i))
        now = {p: s for p, s in {**now, **change}.items() if s is not None}
        full = rules.Facts(frame(spark, now))
        assert seen == keys(rules.run(full, names)), i
    assert seen


def test_entry_points_are_probed(tmp_path):
    for p in ("a/src/x.ts", "a/src/x.js", "b/lib/index.tsx", "c/d.mjs"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("")
    tries = {"a/src/x.js": "a/src/x.ts", "a/src/x": "a/src/x.ts", "b/lib": "b/lib/index.tsx", "c/d.ts": "c/d.mjs", "e/f.ts": "e/f.ts"}
    assert {k: project.probe_entry(str(tmp_path), k) for k in tries} == tries


def test_records_of_diagnostics_and_suppressions(spark, linted):
    facts, out = linted
    summary = post.summary(out["violations"], 4)
    notes = spark.createDataFrame([("config", "unknown rule")], "category string, message string")
    totals = post.suppression_totals(out["raw"], out["directives"])
    rows = [json.loads(r.value) for r in report.ndjson(out["violations"], out["failures"], summary, notes, totals).collect()]
    kinds = [r["type"] for r in rows]
    assert kinds == sorted(kinds, key=["summary", "file", "diagnostic", "parse_failure", "violation", "suppressions"].index)
    assert {"type": "diagnostic", "category": "config", "message": "unknown rule"} in rows and rows[-1]["n_suppressed"] == 1
    assert json.loads(report.as_json(out["violations"], out["failures"], summary, None, notes))["diagnostics"] == [{"category": "config", "message": "unknown rule"}]


def test_config():
    merged = config.merge({"project": {"root": "src"}, "rules": {"no-any": {"severity": "warn", "allow-in-types": True}}}, {"project": {"root": "x"}, "rules": {"no-any": "error"}})
    assert merged == {"project": {"root": "src"}, "rules": {"no-any": {"severity": "error", "allow-in-types": True}}}
    said = config.check({"rules": {"no-ayn": "warn", "no-any": {"severity": "loud", "allow-in-type": True}, "no-barrel-files": "warn", "directory-must-have-barrel": "warn"}, "fail-on": {"default": "never"}})
    assert any("did you mean 'no-any'" in s for s in said) and any("loud" in s for s in said) and any("'allow-in-types'" in s for s in said)
    assert any("contradict" in s for s in said) and any("never" in s for s in said)
    for name in ("balanced", "strict", "migration", "react", "library", "no-barrels"):
        assert not [s for s in config.check(config.preset(name)) if "contradict" not in s]
        assert config.build(config.preset(name)).level("no-debugger") == "error"


def test_nested_config(tmp_path):
    os.makedirs(tmp_path / "p/q")
    (tmp_path / "lint.toml").write_text('[rules]\nno-any = "error"\n')
    (tmp_path / "p/q/lint.toml").write_text('[rules]\nno-enums = "off"\n')
    found = dict(config.resolve(str(tmp_path)))
    assert found["p/q"]["rules"]["no-any"] == "error" and config.build(found["p/q"]).level("no-enums") == "off"
    with pytest.raises(ValueError):
        config.resolve(str(tmp_path), deny_children=True)


def test_tree_git_and_workspace(spark, tmp_path):
    for path, text in {"src/a.ts": "x", "src/.h/b.tsx": "é", "src/c.js": "", "package.json": '{"workspaces": ["packages/*", "!packages/no"]}', "packages/ui/package.json": '{"name": "@s/ui", "exports": {".": "./index.ts", "./x": {"import": "./x.ts"}}}', "packages/ui/index.ts": "", "packages/no/package.json": '{"name": "no"}'}.items():
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text(text)
    os.makedirs(tmp_path / "empty/node_modules")
    tree = {r.path: r.source for r in project.read_tree(spark, str(tmp_path)).collect()}
    assert tree == {"src/a.ts": "x", "src/.h/b.tsx": "é", "packages/ui/index.ts": ""}
    assert project.read_tree(spark, str(tmp_path), scope="src", exclude=["**/.h/**"]).count() == 1
    packages, entries = project.workspace(spark, str(tmp_path))
    assert [tuple(r) for r in packages.collect()] == [("@s/ui", "packages/ui")]
    assert sorted(tuple(r) for r in entries.collect()) == [("@s/ui", "", "packages/ui/index.ts"), ("@s/ui", "x", "packages/ui/x.ts")]
    dirs = {r.path: r for r in project.list_directories(spark, str(tmp_path), rules.IGNORED_DIRS).collect()}
    assert dirs["empty"].subdirectories == [] and dirs["packages/ui"].barrels_empty == [True]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    (tmp_path / "src/a.ts").write_text("changed")
    (tmp_path / "src/new.ts").write_text("")
    git("mv", "src/.h/b.tsx", "src/moved.tsx")
    assert sorted(r.path for r in project.changed_files(spark, str(tmp_path)).collect()) == ["src/a.ts", "src/moved.tsx", "src/new.ts"]
    assert [r.path for r in project.changed_files(spark, str(tmp_path), "staged").collect()] == ["src/moved.tsx"]
    with pytest.raises(ValueError):
        project.changed_files(spark, str(tmp_path), "range", "--output=x")
    aliases, include, _ = project.tsconfig(spark, '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}, "include": ["src"]}')
    assert [tuple(r) for r in aliases.collect()] == [("@/*", "./src/*", 0)] and include == ["src/**/*"]


def test_incremental_equals_full(spark, tmp_path):
    names = ["no-debugger", "no-circular-import", "no-orphan-files", "no-anemic-domain"]
    w = watch.Watcher(frame(spark, FILES), names=names)
    after = dict(FILES) | {"src/b.ts": "debugger;\n", "src/n/c.ts": "import '../b';\n"}
    del after["src/index.ts"]
    folder = tmp_path / "changes"
    os.makedirs(folder)
    query = watch.watch(watch.change_stream(spark, str(folder)), w, str(tmp_path / "ck"), "0 seconds")
    try:
        with open(folder / "1.json", "w") as f:
            for seq, (p, s) in enumerate([("src/b.ts", "stale"), ("src/b.ts", after["src/b.ts"]), ("src/n/c.ts", after["src/n/c.ts"]), ("src/index.ts", None)]):
                f.write(json.dumps({"path": p, "source": s, "seq": seq}) + "\n")
        query.processAllAvailable()
    finally:
        query.stop()
    full = rules.run(rules.Facts(frame(spark, after)), names)
    assert keys(w.violations) == keys(full)
    diff = {r.path: r.source for r in watch.changes_between(frame(spark, FILES), frame(spark, after)).collect()}
    assert diff == {"src/b.ts": "debugger;\n", "src/n/c.ts": "import '../b';\n", "src/index.ts": None}


def test_warm_run_equals_cold_run(spark, tmp_path):
    cold = rules.Facts(frame(spark, FILES))
    cache.store(cold.sources, cold.syn, str(tmp_path / "c"))
    after = dict(FILES) | {"src/b.ts": "debugger;\n", "src/new.ts": "let x: any;\n"}
    warm = rules.Facts(frame(spark, after), cache=str(tmp_path / "c"))
    again = rules.Facts(frame(spark, after))
    assert keys(rules.run(warm, NAMES)) == keys(rules.run(again, NAMES))
    assert [r.file for r in extract.failures(warm.syn).collect()] == ["src/bad.ts"]
    assert cache.syntax(cold.sources, str(tmp_path / "none")).count() == cold.syn.count()


def test_parser_reads_the_language():
    good = [
        "import React, { type FC, useState as u } from 'react';\nexport * as b from './b'; export { a as default, type T } from \"./c\"; export type { Q } from './q';",
        "export interface Foo<T extends object = {}> extends Bar, Baz<T> { a?: string; readonly b: number[]; m<T>(x: T): void; [k: string]: any; new (x: number): Foo<T> }",
        "type M<T> = { readonly [K in keyof T]?: T[K] extends infer U ? U : never };",
        "abstract class X<T> extends Y<T> implements Z { private static readonly a = 1; constructor(private x: number) { super(); } get v(): number { return 1 } async *gen() { yield* a; } @dec() foo!: string; static { a(); } }",
        "const f = async <T,>(x: T, { a, b: [c = 1] }: P): Promise<T> => ({ ...x, y: `t${a + `n${b}`}` });",
        "const g = a < b ? c > d : e as const; const h = foo<string>(x) ?? bar?.[0]?.baz?.(1); let r = /ab[/]c/g.test(s) / 2;",
        "type F = (a: number, b?: string) => asserts a is string; let t: [a: string, b?: number, ...c: boolean[]]; const w = a ? (b): c => d : e;",
        "label: for (let i = 0, n = 5; i < n; i++) { if (a >> 2 > 3) continue label; else break; } x = <any>y; declare global { interface W { a: 1 } }",
    ]
    for text in good:
        parse(text)
    parse('const A = () => <div className="a" {...p} on={() => 1}>text {x ? <B.C /> : <>frag {/* c */}</>} don\'t</div>;', "a.tsx")
    for text in ("const = 1;", "f(", "`a${", "class { x", "import { a from 'b';"):
        with pytest.raises(SyntaxFailure):
            parse(text)


def test_line_ranges_do_not_depend_on_ties(spark):
    lines = [n for n in (1, 2, 3, 5, 6, 8) for _ in range(2 if n == 6 else 40)] + [9, 10]
    rows = [("a.ts", n, 1, "r", "m", s, None) for s in post.SEVERITIES for n in lines] + [("a.ts", None, 1, "r", "m", "warn", None)]
    want, start, end = [], 1, 1
    for n in sorted(r[1] for r in rows if r[1] is not None)[1:]:
        if n != end + 1:
            want.append((start, end))
            start = n
        end = n
    want = sorted(want + [(start, end)])
    df = spark.createDataFrame(rows, "file string, line int, column int, rule string, message string, severity string, subject string")
    for parts in (1, 7):
        got = [(r.first_line, r.last_line, r.lines) for r in post.line_ranges(df.repartition(parts)).collect()]
        assert sorted(got) == [(a, b, str(a) if a == b else f"{a}-{b}") for a, b in want]


def test_columns_are_bytes():
    rows = {r[4]: r for r in extract.facts("a.ts", "const é = 1; let ü = x;\n'é'; let b = 2;") if r[3] == "declarator"}
    assert (rows["ü"][7], rows["ü"][8]) == (1, 19) and (rows["b"][7], rows["b"][8]) == (2, 11)


def test_globs():
    import re

    hit = lambda g, p: bool(re.match(paths.glob_regex(g), p))
    assert hit("src/*.ts", "src/a.ts") and not hit("src/*.ts", "src/b/a.ts") and hit("**/*.ts", "a.ts") and hit("src/**", "src/a/b")
    assert hit("a/{b,c}/[!x]?.ts", "a/c/yz.ts") and not hit("a/{b,c}/[!x]?.ts", "a/c/xz.ts")
    with pytest.raises(ValueError):
        paths.glob_regex("a[")
    assert paths.edit_distance("no-ayn", "no-any") == 1


def test_catalogue_is_whole():
    names = [n for n, *_ in rules.CATALOGUE]
    assert len(names) == len(set(names)) == 64 and set(names) == set(rules.RULES)
    assert set(rules.OPTIONS) <= set(names) and set(rules.FIXABLE) <= set(names)
