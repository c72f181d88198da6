"""Configuration files: index fields of sources, normalizer, correlations. A block that isn't known is an error."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..model import MANDATORY, EngineError, identifier
from ..operators.extract import ExtractRule
from ..operators.parsers import Override
from ..operators.stateful import ChainRule


def index_fields_by_source(path: str | Path) -> dict[str, list[str]]:
    """The declared fields of each [source.NAME]; `default` stands for sources without a table of their own."""
    found = tomllib.loads(Path(path).read_text())
    for name in found:
        if name != "source":
            raise EngineError(f"{path}: unknown block {name!r}")
    return {name: [identifier(f) for f in of.get("index_fields", [])] for name, of in found.get("source", {}).items()}


def index_fields(path: str | Path) -> set[str]:
    """Fields of the event table: those that any source declares, and the mandatory ones."""
    return set(MANDATORY).union(*index_fields_by_source(path).values())


def correlations(path: str | Path) -> list[ChainRule]:
    """[[rule]] blocks, each with its [[rule.step]] blocks."""
    found = tomllib.loads(Path(path).read_text())
    if unknown := set(found) - {"rule"}:
        raise EngineError(f"{path}: unknown block {sorted(unknown)[0]!r}")
    rules = []
    for r in found.get("rule", []):
        if not r.get("step"):
            raise EngineError(f"correlation {r.get('id')!r} has no steps")
        steps = tuple((str(s["rule_id"]), int(s.get("min_count", 1))) for s in r["step"])
        rules.append(ChainRule(str(r["id"]), str(r.get("title", "")), str(r["join_field"]), steps, int(r.get("window_seconds", 300)), bool(r.get("ordered", True))))
    return rules


@dataclass
class Normalizer:
    """bind, ports and data folder; the last file that sets a section wins. Overrides and rules in order of the files."""

    listen: dict[str, str] = field(default_factory=dict)
    storage: dict[str, str] = field(default_factory=dict)
    overrides: list[Override] = field(default_factory=list)
    rules: list[ExtractRule] = field(default_factory=list)


RESERVED = ("from", "pattern", "set", "force_severity")


def normalizer(path: str | Path) -> Normalizer:
    """A file, or the *.toml files of a folder in order of name. The syntax is line by line: [listen], [storage],
    [[overrides.rule]] and [[extract.rule]]; `key = value` with the value between its outer quotes as it stands, so
    backslashes are literal and a key may repeat (pattern); `{ a = "b" }` for remap and set. In an extract rule a key that
    isn't reserved is a condition."""
    path, out = Path(path), Normalizer()
    for file in sorted(path.glob("*.toml")) if path.is_dir() else [path]:
        _read(file, out)
    return out


def _read(file: Path, out: Normalizer) -> None:
    section: str = ""
    block: Override | ExtractRule | dict | None = None
    remapping = False
    for line in file.read_text().splitlines():
        line = uncommented(line).strip()
        if not line:
            continue
        if line.startswith("["):
            section, remapping = line.strip("[]").strip(), False
            match section:
                case "overrides.rule":
                    out.overrides.append(block := Override())
                case "extract.rule":
                    out.rules.append(block := ExtractRule())
                case "listen":
                    out.listen = block = {}
                case "storage":
                    block = {}
                case _:
                    raise EngineError(f"{file}: unknown block {section!r}")
            continue
        key, equals, value = (x.strip() for x in line.partition("="))
        if not equals:
            continue
        value = value.strip('"')
        if isinstance(block, dict):
            block[key] = value
            if section == "storage":
                out.storage = block
        elif isinstance(block, Override):
            remapping |= key == "remap"
            _override(block, key, value, remapping)
        elif isinstance(block, ExtractRule):
            _extract(block, key, value)


def _override(block: Override, key: str, value: str, remapping: bool) -> None:
    if key == "remap":
        block.rename |= inline(value)
    elif remapping:
        block.rename[key] = value
    elif key == "reparse":
        block.reparse = value == "true"
    elif key in ("source_ip", "starts_with", "contains", "format", "source", "reparse_as"):
        setattr(block, key, value)


def _extract(block: ExtractRule, key: str, value: str) -> None:
    match key:
        case "pattern":
            block.patterns.append(value)
        case "from":
            block.source = value
        case "set":
            block.set |= inline(value)
        case "force_severity":
            block.force_severity = value == "true"
        case _:
            block.when[key] = value


def uncommented(line: str) -> str:
    """The line up to a # outside double quotes."""
    return re.match(r'(?:[^"#]|"[^"]*"?)*', line)[0]


def inline(value: str) -> dict[str, str]:
    """{ a = "b", c = "d" }: pairs whose key or value is empty are left out."""
    value = value.strip()
    if not (value.startswith("{") and value.endswith("}")):
        return {}
    pairs = (x.partition("=") for x in value[1:-1].split(",") if "=" in x)
    found = {k.strip().strip('"'): v.strip().strip('"') for k, _, v in pairs}
    return {k: v for k, v in found.items() if k and v}


def cross_check(rules: list[ExtractRule], indexed: set[str]) -> tuple[set[str], set[str]]:
    """Fields that rules produce and no source indexes, and the other way round."""
    produced = {n for r in rules for n in r.set} | {n for r in rules for p in r.patterns for n in re.findall(r"\(\?P?<([A-Za-z_]\w*)>", p)}
    return produced - indexed, indexed - produced - set(MANDATORY)
