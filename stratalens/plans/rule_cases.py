"""A source tree grown from the ``supplier`` table for each rule.

A case is a small tree with the places where its rule must report, derived by hand
from the rule's definition.  Every supplier owns a copy of it in a folder of its own,
``s<key>/``, planted with the violations if its balance is not negative; the others
own three empty files, so that what is found depends on the table.  Expected rows are
computed in SQL from the same planting.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.plans import rules
from stratalens.registry import query
from stratalens.runtime import materialize, table

#: rule -> files, places (file, line, column), options, other settings.
CASES: dict[str, tuple[dict[str, str], list[tuple[str, int | None, int | None]], dict[str, Any], dict[str, Any]]] = {}


def case(rule: str, files: dict[str, str], expected: list[tuple[str, int | None, int | None]], options: dict[str, Any] | None = None, **settings: Any) -> None:
    CASES[rule] = files, expected, options or {}, settings


case("no-upward-import", {"a/b/x.ts": "import { y } from '../y';\nimport { z } from './z';\nimport { w } from './../w';\nexport * from '../../q';\n"}, [("a/b/x.ts", 1, 1), ("a/b/x.ts", 4, 1)])
case("layer-boundaries", {"ui/a.ts": "import '../data/b';\n", "data/b.ts": "import { a } from '../ui/a';\n"}, [("data/b.ts", 1, 1)], layers=[("ui", ["ui"], []), ("data", ["data"], [])])
case("no-test-import", {"a.ts": "import { h } from './b.test';\n", "b.test.ts": "import { h } from './c.test';\n", "c.test.ts": "export const h = 1;\n"}, [("a.ts", 1, 1)])
case("no-barrel-chain", {"index.ts": "export * from './x';\nimport './x';\n", "x/index.ts": "export { a } from './a';\n", "x/a.ts": "export const a = 1;\n"}, [("index.ts", 1, 1)])
case("no-circular-import", {"a.ts": "import './b';\nimport './b';\n", "b.ts": "import './a';\nimport './c';\n", "c.ts": "import './b';\n", "d.ts": "\nimport './d';\n", "e.ts": "import './a';\n"}, [("a.ts", 1, 1), ("d.ts", 2, 1)])
case("no-orphan-files", {"main.ts": "import './a';\n", "a.ts": "import './a';\n", "b.ts": "import './a';\n", "c.test.ts": "", "index.ts": ""}, [("b.ts", 1, 1), ("index.ts", 1, 1)])
PACKAGES = {"packages": [("@s/app", "packages/app"), ("@s/ui", "packages/ui")], "entries": [("@s/app", "", "packages/app/index.ts"), ("@s/ui", "", "packages/ui/index.ts")]}
case("no-private-package-import", {"packages/app/index.ts": "import { a } from '@s/ui';\nimport { b } from '@s/ui/secret';\nimport { c } from './local';\n", "packages/app/local.ts": "", "packages/ui/index.ts": "", "packages/ui/secret.ts": ""}, [("packages/app/index.ts", 2, 1)], **PACKAGES)
case("no-package-cycle", {"packages/app/index.ts": "\nimport { a } from '@s/ui';\nimport { b } from '@s/ui';\n", "packages/ui/index.ts": "import { x } from '@s/app';\n"}, [("packages/app/index.ts", 2, 1), ("packages/ui/index.ts", 1, 1)], **PACKAGES)
case("no-empty-directories", {"a/index.ts": "// nothing\n/* here */\n", "b/index.ts": "export {};\n", "c/index.ts": "", "c/x.ts": ""}, [("a", None, None)])
case("directory-must-have-barrel", {"index.ts": "", "a/x.ts": "", "a/b/y.ts": "", "c/index.tsx": "", "c/d/z.ts": ""}, [("a", None, None)])
case("max-items-per-directory", {f"a/f{i}.ts": "" for i in range(4)} | {"b/x.ts": "", "b/y.ts": "", "b/z.ts": ""}, [("a", None, None)], {"max-items": 3})
case("min-items-per-directory", {"a/x.ts": "", "b/x.ts": "", "b/y.ts": "", "b/z.ts": ""}, [("a", None, None)])
case("max-directory-depth", {"a/b/c/x.ts": "", "a/y.ts": ""}, [("a/b/c", None, None), ("a/b/c/x.ts", None, None)], {"max-depth": 3})
case("no-empty-domain", {"a/index.ts": "export const a = 1;\n", "b/index.ts": "", "b/x.ts": ""}, [("a", None, None)])
case("no-anemic-domain", {"a/x.ts": "", "b/x.ts": "", "b/y.ts": "", "node_modules/p/x.ts": ""}, [("a", None, None)])
case("no-god-domain", {f"a/f{i}.ts": "" for i in range(4)} | {"b/x.ts": ""}, [("a", None, None)], {"max-files": 3})
case("no-duplicate-file-names", {"a/x@k.ts": "", "b/x@k.ts": "", "c/x@k.ts": "", "a/index.ts": "", "b/index.ts": ""}, [("a/x@k.ts", None, None), ("a/x@k.ts", None, None), ("b/x@k.ts", None, None)])
case("no-dump-files", {"src/Utils.ts": "", "src/helpers.tsx": "", "src/my-utils.ts": "", "src/misc.ts": ""}, [("src/Utils.ts", 1, 1), ("src/helpers.tsx", 1, 1), ("src/misc.ts", 1, 1)], {"extra-names": ["misc"]})
case("no-large-file", {"a.ts": "a\nb\nc\n", "b.ts": "a\nb\nc\né", "c.ts": "a\nb\n"}, [("b.ts", 4, 3)], {"max-lines": 3})
case("no-side-effect-imports", {"a.ts": "import './x.css';\nimport {} from './y';\nimport z from './z';\n"}, [("a.ts", 1, 1)])
case("no-restricted-imports", {"a.ts": "import _ from 'lodash';\nimport m from 'lodash/map';\nimport { old } from 'api';\nimport { neu } from 'api';\nexport * from 'gen-x';\nimport l from 'lodashish';\n"}, [("a.ts", 1, 1), ("a.ts", 2, 1), ("a.ts", 3, 1), ("a.ts", 5, 1)], {"restricted": ["lodash", {"pattern": "api", "named": ["old"]}, "gen-*"]})
case("no-test-code-in-production", {"a.ts": "import { vi } from 'vitest';\nimport x from 'jesting';\ndescribe('x', () => {});\nfoo.describe();\n", "b.test.ts": "describe('x', () => {});\n"}, [("a.ts", 1, 1), ("a.ts", 3, 1)])
case("sort-imports", {"a.ts": "import b from 'b';\nimport A from 'A';\nimport c from 'c';\n\nimport a from 'a';\nfoo();\nimport z from 'z';\nimport y from 'y';\n"}, [("a.ts", 2, 1), ("a.ts", 8, 1)])
case("sort-exports", {"a.ts": "export const b = 1;\nexport const a = 2;\n\nexport { x } from './x';\nexport * from './a';\n"}, [("a.ts", 2, 1), ("a.ts", 5, 1)])
case("no-default-export", {"a.ts": "export default 1;\n", "b.ts": "const x = 1;\nexport { x as default };\n", "c.ts": "export const y = 1;\n"}, [("a.ts", 1, 1), ("b.ts", 2, 1)])
case("no-export-star", {"a.ts": "export * from './b';\nexport * as c from './c';\n"}, [("a.ts", 1, 1)])
case("no-mutable-exports", {"a.ts": "export let a = 1;\nexport const b = 2;\nlet c = 3;\nexport var d = 4;\n"}, [("a.ts", 1, 1), ("a.ts", 4, 1)])
case("max-file-exports", {"a.ts": "export const a = 1, b = 2;\nexport { c, d };\nexport default 1;\n", "b.ts": "export const a = 1;\n"}, [("a.ts", 1, 1)], {"max-exports": 4})
case("no-barrel-files", {"index.ts": "export { a } from './a';\n", "x/index.ts": "export const b = 1;\n", "a.ts": "export * from './b';\n"}, [("index.ts", None, None)])
case("no-logic-in-barrel", {"index.ts": "export * from './a';\nimport b from './b';\nconst c = 1;\n", "x/index.ts": "export { a } from './a';\n"}, [("index.ts", 2, 1)])
case("max-function-params", {"a.ts": "function f(a, b, c, d) {}\nconst g = (a, b, c, ...d) => 1;\nclass C { m(a: 1, b: 2, c: 3, d: 4) {} }\n"}, [("a.ts", 1, 10), ("a.ts", 3, 11)])
case("prefer-readonly", {"a.ts": "export function f(a: string[], b: readonly string[], c: Array<number>) {}\nexport const g = (x: number[]) => x;\nfunction h(y: string[]) {}\n"}, [("a.ts", 1, 19), ("a.ts", 1, 54), ("a.ts", 2, 19)])
case("explicit-return-type", {"a.ts": "export function f() {}\nexport function g(): void {}\nexport const h = () => 1;\nfunction i() {}\nexport default function () {}\n"}, [("a.ts", 1, 17), ("a.ts", 3, 14), ("a.ts", 5, 16)])
case("boolean-prefix", {"a.ts": "const done: boolean = f();\nlet isOk = true;\nlet island = false;\nvar old = true;\nconst n = 1;\n"}, [("a.ts", 1, 7), ("a.ts", 3, 5)])
case("component-file-only-components", {"components/A.tsx": "export const Card = () => <a/>;\nexport const helper = 1;\nexport type Props = {};\nexport function useX() {}\n", "lib/b.tsx": "export const helper = 1;\n"}, [("components/A.tsx", 2, 1), ("components/A.tsx", 3, 1), ("components/A.tsx", 4, 1)])
case("entry-file-no-logic", {"main.ts": "import a from './a';\nfunction run() {}\nconst f = () => 1;\nif (a) run();\nexport function ok() {}\nconst n = 1;\n", "other.ts": "function run() {}\n"}, [("main.ts", 2, 1), ("main.ts", 3, 7), ("main.ts", 4, 1)])
case("hook-no-jsx", {"hooks/a.tsx": "const a = 1;\nexport const useA = () => <div><b/></div>;\n", "b.tsx": "export const B = () => <i/>;\n"}, [("hooks/a.tsx", 2, 27)])
case("hook-prefix", {"hooks/a.ts": "export function useA() { function inner() {} }\nconst go = () => 1;\nconst user = () => 1;\nconst n = 1;\n", "b.ts": "function go() {}\n"}, [("hooks/a.ts", 1, 35), ("hooks/a.ts", 2, 7), ("hooks/a.ts", 3, 7)])
case("no-inline-types", {"a.ts": "interface A {}\nexport type B = string;\n", "types/b.ts": "export interface C {}\n", "g.d.ts": "interface G {}\n"}, [("a.ts", 1, 1), ("a.ts", 2, 8)])
case("no-logic-in-domain", {"types/a.ts": "export type A = 1;\nexport const b = 1;\nfunction f() {}\n", "constants/c.ts": "export const D = 1;\nexport let e = 2;\nexport const g = () => 1;\nclass H {}\n", "x.ts": "function f() {}\n"}, [("types/a.ts", 2, 14), ("types/a.ts", 3, 1), ("constants/c.ts", 2, 12), ("constants/c.ts", 3, 14), ("constants/c.ts", 4, 1)])
case("no-any", {"a.ts": "let a: any;\nconst é = 1; function f(x: Array<any>): unknown { return x as any; }\nconst any = 1;\n", "generated/b.ts": "let a: any;\n"}, [("a.ts", 1, 8), ("a.ts", 2, 35), ("a.ts", 2, 64)])
case("no-empty-interface", {"a.ts": "interface A {}\ninterface B extends A {}\ninterface C { a: 1 }\n"}, [("a.ts", 1, 1), ("a.ts", 2, 1)])
case("no-enums", {"a.ts": "enum A { B }\nexport const enum C { D = 1 }\nconst e = 1;\n"}, [("a.ts", 1, 1), ("a.ts", 2, 8)])
case("no-interface", {"a.ts": "interface A { a: 1 }\ninterface B { b: 1 }\ninterface B { c: 1 }\n"}, [("a.ts", 1, 1)])
case("no-namespace", {"a.ts": "namespace A { }\nmodule B { }\ndeclare module 'x' { }\n"}, [("a.ts", 1, 1)])
case("no-non-null-assertion", {"a.ts": "const a = b!;\nc!.d!.e();\nif (a != b) {}\n"}, [("a.ts", 1, 11), ("a.ts", 2, 1), ("a.ts", 2, 1)])
case("no-type-assertion", {"a.ts": "const a = b as string;\nconst c = [1] as const;\nconst d = <any>e;\n"}, [("a.ts", 1, 11), ("a.ts", 2, 11)])
case("no-unnecessary-type-assertion", {"a.ts": "const a = 'x' as string;\nconst b = 1 as number;\nconst c = true as boolean;\nconst d = e as string;\nconst f = 1 as string;\n"}, [("a.ts", 1, 11), ("a.ts", 2, 11), ("a.ts", 3, 11)])
case("no-unsafe-optional-chaining", {"a.ts": "[1]?.length;\nthis?.a;\na?.b?.c;\n'x'?.length;\nnew A()?.b;\n"}, [("a.ts", 1, 1), ("a.ts", 2, 1), ("a.ts", 4, 1), ("a.ts", 5, 1)])
case("prefer-satisfies", {"a.ts": "const a = { b: 1 } as Foo;\nconst c = [1] as const;\nconst d = x as Foo;\nconst e = {} as any;\n"}, [("a.ts", 1, 11)])
case("no-magic-numbers", {"a.ts": "const A = 5;\nlet b = 6;\nf(7, -8, 1);\nenum E { A = 9 }\nnew Array(10);\ntype T = 11;\nconst c = -12;\nconst d = 13 * e;\n"}, [("a.ts", 2, 9), ("a.ts", 3, 3), ("a.ts", 3, 7), ("a.ts", 8, 11)], {"allowed-numbers": ["1"]})
case("no-process-env", {"a.ts": "const a = process.env.A;\nconst b = process.env;\nconst c = process['x'];\nprocess.env.B.trim();\n"}, [("a.ts", 1, 11), ("a.ts", 2, 11), ("a.ts", 4, 1)])
case("no-console", {"a.ts": "log(1);\nconsole.log(1);\nconsole['warn'](2);\nconst { log, warn: w } = console;\nlog(3);\nw(4);\n", "scripts/b.ts": "console.log(1);\n"}, [("a.ts", 2, 1), ("a.ts", 3, 1), ("a.ts", 5, 1), ("a.ts", 6, 1)], {"allow-patterns": ["**/scripts/**"]})
case("no-debugger", {"a.ts": "debugger;\nif (a) {\n  debugger\n}\n"}, [("a.ts", 1, 1), ("a.ts", 3, 3)])
case("no-eval", {"a.ts": "eval('x');\n  new Function('y');\nfoo.eval('z');\nFunction('q');\n"}, [("a.ts", 1, 1), ("a.ts", 2, 7)])
case("no-focused-test", {"a.ts": "it.only('x', f);\ndescribe.only('y', g);\nit('z', f);\nfoo.only(1);\n"}, [("a.ts", 1, 1), ("a.ts", 2, 1)])
case("no-skipped-test", {"a.ts": "test.skip('x', f);\nit.only('y', g);\n"}, [("a.ts", 1, 1)])
case("no-await-in-loop", {"a.ts": "async function f() {\n  for (const x of y) { await x; }\n  while (1) { const g = async () => { await z; }; }\n  await w;\n  for await (const q of r) { await q; }\n}\n"}, [("a.ts", 2, 24), ("a.ts", 3, 39)])
case("no-promise-executor-return", {"a.ts": "new Promise((r) => { return 1; });\nnew Promise((r) => r(1));\nnew Promise((r) => { return; });\nnew Promise(function (r) { f(() => { return 2; }); });\n"}, [("a.ts", 1, 22), ("a.ts", 2, 13)])
case("no-silent-catch", {"a.ts": "try { a() } catch (e) { }\ntry { a() } catch (e) { throw e; }\nfunction f() { try { a() } catch { return 1; } }\ntry { a() } catch (e) { if (e) { console.error(e); } }\n  try { a() } catch (e) { g(() => { throw e; }); }\n"}, [("a.ts", 1, 1), ("a.ts", 5, 3)])
case("no-then-chain", {"a.ts": "a.then(b);\nc.then(d).then(e);\n"}, [("a.ts", 2, 1), ("a.ts", 2, 1)])
case("no-comments", {"a.ts": "// plain\n/** doc */\n/// triple\n// lint-ignore-next-line no-eval\nconst a = 1; /* tail */\n"}, [("a.ts", 1, 1), ("a.ts", 5, 14)])
case("no-abbreviations", {"a.ts": "const submitBtn = 1;\nfunction f(appCtx: string) {}\nimport { Mgr } from './m';\nconst fine = x.btn;\n"}, [("a.ts", 1, 7), ("a.ts", 2, 12), ("a.ts", 3, 10)])
case("no-nested-functions", {"a.ts": "function a() {\n  const b = () => {\n    function c() {}\n  };\n}\nclass K { m() { return () => () => 1; } }\n"}, [("a.ts", 3, 5), ("a.ts", 6, 30)])


#: Places outside the suppliers' folders: the root has folders and no barrel.
SHARED = {"directory-must-have-barrel": [("", None, None)]}
PLANTED = "s_acctbal >= 0"


def _planted(spark, sf_dir: str, rule: str) -> DataFrame:
    """``(path, source)``: each supplier's folder, with the case or empty files."""
    files = spark.createDataFrame(sorted(CASES[rule][0].items()), "path string, source string")
    owners = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey, '/') as home", "cast(s_suppkey as string) as k", f"{PLANTED} as planted")
    told = owners.where("planted").crossJoin(F.broadcast(files)).select(F.concat("home", F.replace("path", F.lit("@k"), "k")).alias("path"), F.replace("source", F.lit("'@s/"), F.concat(F.lit("'@"), F.rtrim("home", F.lit("/")), F.lit("/"))).alias("source"))
    # three files, as fewer or more would break rules of their own
    clean = owners.where("not planted").withColumn("n", F.explode(F.array(*map(F.lit, "abc"))))
    told = told.union(clean.select(F.concat("home", F.lit("clean"), "k", "n", F.lit(".test.ts")), F.lit("")))
    return told.repartition(spark.sparkContext.defaultParallelism)


def _facts(spark, rule: str, sf_dir: str) -> rules.Facts:
    _, _, options, settings = CASES[rule]
    level = {"layer-boundaries": "warn"} if rule == "layer-boundaries" else {}
    make = spark.createDataFrame
    config = rules.Config(severity=level, options={rule: options} if options else {}, layers=settings.get("layers", []))
    owners = table(spark, sf_dir, "supplier").where(PLANTED).selectExpr("concat('s', s_suppkey) as home")
    own = lambda name: F.replace(name, F.lit("@s"), F.concat(F.lit("@"), "home"))
    at = lambda path: F.concat_ws("/", "home", path)
    packages = entries = None
    if "packages" in settings:
        rows = owners.crossJoin(F.broadcast(make(settings["packages"], "name string, directory string")))
        packages = materialize(rows.select(own("name").alias("name"), at("directory").alias("directory")), "packages")
        rows = owners.crossJoin(F.broadcast(make(settings["entries"], "package string, subpath string, path string")))
        entries = materialize(rows.select(own("package").alias("package"), "subpath", at("path").alias("path")), "entries")
    return rules.Facts(materialize(_planted(spark, sf_dir, rule), "tree"), config, packages=packages, entries=entries)


def found(spark, rule: str, sf_dir: str) -> DataFrame:
    return rules.RULES[rule](_facts(spark, rule, sf_dir)).select("file", "line", "column", "rule", "severity")


def _sql(rule: str) -> str:
    severity = "warn" if rule == "layer-boundaries" else next(s for n, _, s, _ in rules.CATALOGUE if n == rule)
    put = lambda v: "null" if v is None else str(v)

    def rows(file: str, places: list, source: str) -> str:
        listed = ", ".join(f"('{f}', {put(ln)}, {put(c)})" for f, ln, c in places)
        return f"select {file} as file, cast(line as int) as line, cast(\"column\" as int) as \"column\", '{rule}' as rule, '{severity}' as severity from (values {listed}) t(file, line, \"column\"){source}"

    sql = rows("'s' || s_suppkey || '/' || replace(file, '@k', s_suppkey::varchar)", CASES[rule][1], f", supplier where {PLANTED}")
    return sql + (f" union all {rows('file', SHARED[rule], '')}" if rule in SHARED else "")


for _name in CASES:
    query(f"rule_{_name.replace('-', '_')}", _sql(_name))(lambda spark, sf_dir, name=_name: found(spark, name, sf_dir))
