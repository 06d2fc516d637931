"""Type definitions: YAML files in a schema folder, one type each, over built-in presets; small, so on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from vellum.functions.markdown import load_yaml

PRESETS = {
    "agent": "paths: ['.claude/agents/*.md']\nfields:\n  name: {type: string, required: true}\n  description: {type: string, required: true}\n",
    "agents": "paths: ['**/AGENTS.md']\nstructure:\n  size_warning: 4000\n",
    "command": "paths: ['.claude/commands/**/*.md']\nfields:\n  description: {type: string, required: true}\n",
    "journal": "paths: ['**/journal/????-??.md']\nstructure:\n  title: from_date\n  date_headings: {sort: newest_first}\n",
    "journal-entry": "paths: ['**/journal/????-??-??T??-??.md']\nstructure:\n  title: required\n",
    "readme": "paths: ['**/README.md']\nfields:\n  created: {type: date, required: true}\n  description: {type: string, required: true}\nstructure:\n  title: from_directory\n",
    "roadmap": "paths: ['**/ROADMAP.md']\nstructure:\n  title: Roadmap\n  strict_sections: false\n  sections:\n    - {title: Non-Goals, required: true, intro_text: Out of scope}\n",
    "skill": "paths: ['**/skills/*/SKILL.md']\nfields:\n  name: {type: string, required: true}\n  description: {type: string, required: true}\n",
}
TYPES = ("string", "link", "date", "datetime", "integer", "float", "bool", "enum", "list")
STRUCTURE_KEYS = {"title", "intro", "sections", "strict_sections", "size_warning", "date_headings"}


@dataclass
class Schema:
    """Types by name, each a mapping with paths, fields and structure; errors keep their messages.

    ``folder``: where the files lie that they were read from; empty if they are presets alone, which cover only files
    that a pattern matches.
    """

    types: dict = field(default_factory=dict)
    errors: list = field(default_factory=list)
    folder: str = "schema"

    def paths(self) -> list[tuple[str, str]]:
        return [(name, p) for name, t in self.types.items() for p in t.get("paths") or []]


def _check(name: str, t: dict) -> None:
    for f, d in (t.get("fields") or {}).items():
        if d.get("type") not in TYPES:
            raise ValueError(f"type '{name}', field '{f}': unknown type '{d.get('type')}'")
        if d["type"] == "enum" and not d.get("values") or d["type"] == "list" and d.get("item_type") == "enum" and not d.get("values"):
            raise ValueError(f"type '{name}', field '{f}': enum needs values")
    unknown = set(t.get("structure") or {}) - STRUCTURE_KEYS
    if unknown:
        raise ValueError(f"type '{name}': unknown keys {sorted(unknown)}")
    for s in (t.get("structure") or {}).get("sections") or []:
        if s.get("bullets") is False:
            raise ValueError(f"type '{name}', section '{s.get('title')}': bullets can't be false")


def schema(definitions: dict[str, str], presets: bool = False) -> Schema:
    """From type names and YAML texts; presets fill in types that aren't defined."""
    out = Schema()
    for name in sorted(definitions):
        try:
            t = load_yaml(definitions[name]) or {}
            _check(name, t)
            out.types[name] = t
        except Exception as e:  # a bad file fails its folder, as one diagnostic
            return Schema(errors=[f"schema error: {name}: {e}"])
    for name, text in (PRESETS if presets else {}).items():
        out.types.setdefault(name, load_yaml(text))
    seen: set = set()
    for name, p in out.paths():
        if p in seen:
            out.errors.append(f"path pattern error: duplicate path pattern '{p}'")
        seen.add(p)
    return out


def load(folder: str, presets: bool = True) -> Schema:
    texts = {}
    for n in sorted(os.listdir(folder)):
        stem, ext = os.path.splitext(n)
        if ext in (".yaml", ".yml"):
            with open(os.path.join(folder, n), encoding="utf-8") as f:
                texts[stem] = f.read()
    return schema(texts, presets)


def load_all(root: str, folder: str) -> dict[str, Schema]:
    """Schemas by what they cover, relative to the root: each folder called ``folder``, outside .git and what the
    tree's ignore files leave out; presets alone at the root if there is none."""
    from vellum.sources.corpus import Ignored

    ignored, out = Ignored(root), {}
    for d, dirs, _ in os.walk(root):
        rel = os.path.normpath(os.path.relpath(d, root))
        ignored.enter(rel)
        if folder in dirs:
            out[rel] = load(os.path.join(d, folder))
            out[rel].folder = os.path.normpath(os.path.join(rel, folder))
        dirs[:] = sorted(n for n in dirs if n not in (".git", folder) and not ignored(os.path.normpath(os.path.join(rel, n)), True))
    if not out:
        out["."] = schema({}, True)
        out["."].folder = ""
    return out


def find_root(start: str, folder: str) -> str:
    """The nearest folder above that holds a schema folder, else a .git folder, else the start."""
    for name in (folder, ".git"):
        at = os.path.abspath(start)
        while True:
            if os.path.isdir(os.path.join(at, name)):
                return at
            if os.path.dirname(at) == at:
                break
            at = os.path.dirname(at)
    return os.path.abspath(start)


def preset(name: str) -> str:
    """The YAML text of one preset."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset '{name}' (available: {', '.join(sorted(PRESETS))})")
    return PRESETS[name]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(PRESETS.items()), "name string, yaml string")
