"""Own rules from YAML (with PyYAML) or JSON texts and files, checked before they are used."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import Path

from ..functions.regex import compiled
from ..operators.detect import SEVERITIES
from ..operators.rule_table import Rule

#: The newest version of the rules' format that is understood.
FORMAT = "1"


class RuleError(ValueError):
    """What is wrong with a rule or a file of rules."""


def _read(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        yaml = None
    try:
        tree = yaml.safe_load(text) if yaml else json.loads(text)
    except Exception as e:
        raise RuleError(f"not readable: {e}") from e
    if not isinstance(tree, dict) or not isinstance(tree.get("rules") or [], list):
        raise RuleError("rules must be a list under the key rules")
    return tree


def check(rules: Iterable[Rule]) -> None:
    """Names, severities and patterns must be usable, and names unique whatever their letter case."""
    seen: dict[str, int] = {}
    for i, r in enumerate(rules):
        if not r.name:
            raise RuleError(f"rule {i} has no name")
        if r.severity.upper() not in SEVERITIES:
            raise RuleError(f"rule {r.name}: unknown severity {r.severity!r}")
        try:
            compiled(r.pattern)
        except re.error as e:
            raise RuleError(f"rule {r.name}: bad pattern: {e}") from e
        if r.name.lower() in seen:
            raise RuleError(f"rule {r.name}: also at {seen[r.name.lower()]}")
        seen[r.name.lower()] = i


def from_text(text: str) -> tuple[Rule, ...]:
    out = []
    for i, x in enumerate(_read(text).get("rules") or []):
        if not isinstance(x, dict):
            raise RuleError(f"rule {i} is no mapping")
        version = str(x.get("version") or "")
        if version > FORMAT:
            raise RuleError(f"rule {i} ({x.get('name')}): version {version} is newer than {FORMAT}")
        out.append(Rule(
            str(x.get("name") or ""), str(x.get("severity") or ""), str(x.get("pattern") or ""), tuple(map(str, x.get("tags") or ())), bool(x.get("multi_line")),
            bool(x.get("requires_context")), tuple(map(str, x.get("context_keywords") or ())), float(x.get("entropy_threshold") or 0.0),
        ))
    check(out)
    return tuple(out)


def from_file(path: str) -> tuple[Rule, ...]:
    try:
        return from_text(Path(path).read_text(encoding="utf-8"))
    except (RuleError, OSError) as e:
        raise RuleError(f"{path}: {e}") from e


def from_folder(path: str) -> tuple[Rule, ...]:
    """Rules of all .yaml files of a folder in the order of their names, unique among all of them."""
    out = [r for f in sorted(Path(path).glob("*.yaml")) for r in from_file(str(f))]
    try:
        check(out)
    except RuleError as e:
        raise RuleError(f"{path}: {e}") from e
    return tuple(out)
