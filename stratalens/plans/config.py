"""Configuration: TOML files merged from root to leaf."""

from __future__ import annotations

import json
import os
import re
import tomllib
from typing import Any

from stratalens.functions.paths import edit_distance
from stratalens.plans.rules import CATALOGUE, CONFLICTS, DOMAINS, OPTIONS, Config

FILE = "lint.toml"
LEVELS = ("off", "info", "warn", "error")
#: Rules of the presets, each with its level and options; rules that a preset leaves
#: out keep their own level.  Fixed values.
PRESETS = {
    "balanced": """
no-console warn allow-patterns=[]
no-debugger error
no-eval error
no-empty-interface error
no-export-star warn
no-focused-test error
no-skipped-test error
no-test-code-in-production error
no-mutable-exports error
no-namespace error
no-silent-catch error
no-non-null-assertion error
no-unsafe-optional-chaining warn
no-await-in-loop warn
no-promise-executor-return warn
explicit-return-type warn
no-circular-import error
no-large-file warn max-lines=500
max-function-params warn max-params=3
no-barrel-files info
no-barrel-chain info
no-logic-in-barrel warn
no-package-cycle error
no-test-import error
no-process-env warn
no-type-assertion warn
no-magic-numbers info
no-abbreviations info
no-default-export info components-only=false
no-enums info
no-interface info allow-declaration-merging=true
no-inline-types info
no-comments info allow-doc-comments=true
no-side-effect-imports info
sort-exports info
sort-imports info
prefer-readonly warn
""",
    "strict": """
no-console error allow-patterns=[]
no-debugger error
no-eval error
no-empty-interface error
no-export-star error
no-focused-test error
no-skipped-test error
no-test-code-in-production error
no-mutable-exports error
no-namespace error
no-silent-catch error
no-non-null-assertion error
no-unsafe-optional-chaining error
no-await-in-loop error
no-promise-executor-return error
no-type-assertion error
explicit-return-type error
no-circular-import error
no-large-file warn max-lines=300
max-function-params warn max-params=3
no-barrel-files error
no-barrel-chain error
no-logic-in-barrel error
no-magic-numbers error allowed-numbers=["0", "1", "-1"] enforce-strings=false
no-any error allowed-folders=[]
no-abbreviations error extra-abbreviations=[]
no-comments error allow-doc-comments=true
no-default-export error components-only=false
prefer-readonly error
no-enums error
no-interface error allow-declaration-merging=true
no-inline-types error
no-logic-in-domain error
max-directory-depth warn max-depth=5 ignore-dirs=[]
no-duplicate-file-names error ignore-names=[]
no-dump-files error extra-names=[]
no-empty-directories error ignore-dirs=[]
no-process-env error
no-restricted-imports error restricted=[]
no-side-effect-imports error
no-test-import error
no-package-cycle error
no-unnecessary-type-assertion error
no-then-chain error
sort-exports warn
sort-imports warn
no-nested-functions warn max-depth=2 contexts=["function", "arrow", "class-method", "object-method"]
no-orphan-files warn entry-files=["main", "app", "layout", "page"]
entry-file-no-logic error entry-files=["main", "app", "layout", "page"]
""",
    "migration": """
no-console off
no-debugger error
no-eval error
no-empty-interface error
no-export-star off
no-focused-test error
no-skipped-test error
no-test-code-in-production error
no-mutable-exports error
no-namespace error
no-silent-catch error
no-non-null-assertion off
no-unsafe-optional-chaining off
no-await-in-loop off
no-promise-executor-return off
no-type-assertion off
explicit-return-type off
no-circular-import error
no-large-file info max-lines=800
max-function-params info max-params=5
no-barrel-files off
no-barrel-chain off
no-logic-in-barrel off
no-magic-numbers off
no-any off
no-abbreviations off
no-comments off
no-default-export off
prefer-readonly off
no-enums off
no-interface off
no-inline-types off
no-logic-in-domain off
max-directory-depth off
no-duplicate-file-names off
no-dump-files off
no-empty-directories off
no-process-env off
no-restricted-imports off
no-side-effect-imports off
no-test-import error
no-package-cycle error
sort-exports off
sort-imports off
""",
    "react": """
no-console warn allow-patterns=[]
no-debugger error
no-eval error
no-empty-interface error
hook-no-jsx error
hook-prefix error prefixes=["use"]
component-file-only-components warn
no-default-export info components-only=true
no-barrel-files info
no-logic-in-barrel warn
boolean-prefix info prefixes=["is", "has", "can"] ignore-constants=false
no-silent-catch warn
no-non-null-assertion error
no-unsafe-optional-chaining warn
no-await-in-loop warn
no-promise-executor-return warn
explicit-return-type info
no-circular-import error
no-large-file warn max-lines=400
max-function-params warn max-params=3
entry-file-no-logic warn entry-files=["main", "app", "layout", "page"]
no-orphan-files warn entry-files=["main", "app", "layout", "page"]
no-nested-functions warn max-depth=2 contexts=["function", "arrow", "class-method", "object-method"]
""",
    "library": """
no-console off
no-debugger error
no-eval error
no-empty-interface error
no-export-star off
no-focused-test error
no-skipped-test error
no-test-code-in-production error
no-mutable-exports error
no-namespace error
no-silent-catch error
no-non-null-assertion error
no-unsafe-optional-chaining warn
no-await-in-loop warn
no-promise-executor-return warn
no-type-assertion warn
explicit-return-type error
no-circular-import error
no-large-file warn max-lines=500
max-function-params warn max-params=3
no-barrel-files info
no-barrel-chain info
no-logic-in-barrel warn
no-magic-numbers warn allowed-numbers=["0", "1", "-1"] enforce-strings=false
no-any warn allowed-folders=[]
no-abbreviations info
prefer-readonly error
no-interface info allow-declaration-merging=true
no-restricted-imports warn restricted=[]
no-package-cycle error
no-test-import error
no-side-effect-imports warn
""",
    "no-barrels": """
no-console warn allow-patterns=[]
no-debugger error
no-eval error
no-empty-interface error
no-barrel-files error
no-barrel-chain error
no-logic-in-barrel error
directory-must-have-barrel off
no-export-star error
no-circular-import error
""",
}
#: Folders and suffixes that a preset spells out.  Fixed values.
PRESET_STRUCTURE = {
    "react": {
        "hooks": {"folders": ["hooks"], "file-suffixes": [".hook.ts", ".hooks.ts"]},
        "components": {"folders": ["components"], "file-suffixes": [".component.tsx", ".components.tsx"]},
    }
}


def preset(name: str) -> dict[str, Any]:
    """A named starting point; rules that it leaves out keep their level."""
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}")
    chosen: dict[str, dict[str, Any]] = {}
    for line in PRESETS[name].split("\n"):
        if line:
            rule, level, rest = f"{line}  ".split(" ", 2)
            options = re.findall(r"[a-z-]+=(?:\[[^\]]*\]|\S+)", rest)
            chosen[rule] = {"severity": level} | {k: json.loads(v) for k, _, v in (o.partition("=") for o in options)}
    out: dict[str, Any] = {"project": {"root": "src", "respect-gitignore": True}, "rules": chosen}
    if name in PRESET_STRUCTURE:
        out["structure"] = {k: dict(v) for k, v in PRESET_STRUCTURE[name].items()}
    return out


def dump(settings: dict[str, Any]) -> str:
    """Settings as TOML, tables in their order."""
    put = lambda v: json.dumps(v, ensure_ascii=False)
    lines: list[str] = []

    def table(path: list[str], value: dict[str, Any]) -> None:
        plain = {k: v for k, v in value.items() if not isinstance(v, dict)}
        if plain and path:
            lines.extend([f"[{'.'.join(path)}]", *(f"{k} = {put(v)}" for k, v in plain.items()), ""])
        elif plain:
            lines.extend([*(f"{k} = {put(v)}" for k, v in plain.items()), ""])
        for k, v in value.items():
            if isinstance(v, dict):
                table([*path, k], v)

    table([], settings)
    return "\n".join(lines)


def init(root: str, name: str = "balanced", force: bool = False) -> str:
    """Write the file of a preset; one that exists is kept unless forced."""
    at = os.path.join(root, FILE)
    if os.path.exists(at) and not force:
        raise FileExistsError(at)
    with open(at, "w") as f:
        f.write(dump(preset(name)))
    return at


def merge(parent: dict[str, Any], child: dict[str, Any]) -> dict[str, Any]:
    """The child's fields win; a bare level keeps the parent's options; the
    project's root is always the parent's; layers are replaced by name."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in parent.items()}
    for part, value in child.items():
        if not isinstance(value, dict):
            out[part] = value
            continue
        mine = out.setdefault(part, {})
        for k, v in value.items():
            if part == "project" and k == "root" and "root" in mine:
                continue
            old = mine.get(k)
            old = {"severity": old} if part == "rules" and isinstance(old, str) else old
            v = {"severity": v} if part == "rules" and isinstance(v, str) else v
            mine[k] = {**old, **v} if isinstance(old, dict) and isinstance(v, dict) else v
    return out


def resolve(root: str, deny_children: bool = False) -> list[tuple[str, dict[str, Any]]]:
    """``(directory, settings)`` of each configuration, merged onto that of
    the nearest directory above; the root comes first."""
    out: list[tuple[str, dict[str, Any]]] = []
    for at, subs, names in sorted(os.walk(root)):
        subs[:] = [s for s in subs if s not in ("node_modules", ".git")]
        rel = os.path.relpath(at, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        own: dict[str, Any] | None = None
        if FILE in names:
            with open(os.path.join(at, FILE), "rb") as f:
                own = tomllib.load(f)
        if not rel:
            out.append(("", own if own is not None else preset("balanced")))
        elif own is not None:
            if deny_children:
                raise ValueError(f"nested configuration {rel}/{FILE} is not allowed")
            above = max((d for d, _ in out if not d or rel.startswith(d + "/")), key=len)
            out.append((rel, merge(dict(out)[above], own)))
    return out


def build(settings: dict[str, Any]) -> Config:
    rules = {n: {"severity": v} if isinstance(v, str) else v for n, v in settings.get("rules", {}).items()}
    domains = dict(DOMAINS)
    for name, d in settings.get("structure", {}).items():
        folders, suffixes = domains.get(name, ([], []))
        domains[name] = (d.get("folders", folders), d.get("file-suffixes", suffixes))
    layers = settings.get("architecture", {}).get("layers", {})
    order = layers.get("order", [])
    return Config(
        severity={n: v["severity"] for n, v in rules.items() if "severity" in v},
        options={n: {k: x for k, x in v.items() if k != "severity"} for n, v in rules.items()},
        domains=domains,
        layers=[(n, layers.get(n, {}).get("folders", []), layers.get(n, {}).get("file-suffixes", [])) for n in order],
    )


def check(settings: dict[str, Any]) -> list[str]:
    """Unknown rules, options and levels, and rules that contradict."""
    known = [n for n, *_ in CATALOGUE]
    out = []
    on = set()
    for name, value in settings.get("rules", {}).items():
        value = {"severity": value} if isinstance(value, str) else value
        if name not in known:
            near = min(known, key=lambda k: edit_distance(k, name))
            out.append(f"unknown rule {name!r}" + (f"; did you mean {near!r}?" if edit_distance(near, name) <= 3 else ""))
            continue
        if value.get("severity", "warn") not in LEVELS:
            out.append(f"{name}: unknown severity {value['severity']!r}")
        if value.get("severity") != "off":
            on.add(name)
        options = OPTIONS.get(name, {})
        for o in value:
            if o != "severity" and o not in options:
                near = min(options, key=lambda k: edit_distance(k, o), default="")
                out.append(f"{name}: unknown option {o!r}" + (f"; did you mean {near!r}?" if near and edit_distance(near, o) <= 3 else ""))
    out += [f"{a} and {b} contradict each other" for a, bs in CONFLICTS.items() for b in bs if a < b and {a, b} <= on]
    policy = settings.get("fail-on", {})
    out += [f"fail-on: unknown threshold {v!r}" for v in [policy.get("default", "error"), *policy.get("rules", {}).values(), *policy.get("categories", {}).values()] if v not in ("any", "warn", "error")]
    return out
