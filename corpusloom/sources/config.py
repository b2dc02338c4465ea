"""Configuration on the driver: identities, labelled sets, settings."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession


def key_of(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


@dataclass
class Identities:
    """Names that several pages share and what was decided on them, and aliases of concepts; all keys are normalised."""

    collisions: dict[str, dict] = field(default_factory=dict)  # key -> {"identities": [paths], "default": path or None}
    aliases: dict[str, str] = field(default_factory=dict)

    def add_collision(self, name: str, paths: list[str]) -> None:
        """Note that a name has several pages; a decision that still fits stays."""
        held = self.collisions.get(key_of(name), {}).get("default")
        self.collisions[key_of(name)] = {"identities": sorted(paths), "default": held if held in paths else None}

    def decide(self, name: str, path: str) -> None:
        if path not in self.collisions.get(key_of(name), {}).get("identities", []):
            raise ValueError(f"{path} is no page of the name {name}")
        self.collisions[key_of(name)]["default"] = path

    def clear(self, name: str) -> None:
        if key_of(name) in self.collisions:
            self.collisions[key_of(name)]["default"] = None

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """aliases and decisions (norm, concept) and collisions (norm), as resolve_identity reads them."""
        decided = [(k, c["default"]) for k, c in self.collisions.items() if c["default"]]
        return {
            "aliases": spark.createDataFrame(list(self.aliases.items()), "norm string, concept string"), "decisions": spark.createDataFrame(decided, "norm string, concept string"),
            "collisions": spark.createDataFrame([(k,) for k in self.collisions], "norm string"),
        }


def load_identities(text: str) -> Identities:
    """Identities of a YAML text; a default that is none of the identities is refused."""
    raw = yaml.safe_load(text) or {}
    found = Identities(aliases={key_of(k): v for k, v in (raw.get("aliases") or {}).items()})
    for name, c in (raw.get("collisions") or {}).items():
        found.add_collision(name, list(c["identities"]))
        if c.get("default") is not None:
            found.decide(name, c["default"])
    return found


def dump_identities(identities: Identities) -> str:
    return yaml.safe_dump({"collisions": identities.collisions, "aliases": identities.aliases}, sort_keys=True, allow_unicode=True)


#: What every row of a labelled set must have, and the schema of its table.
LABELLED = {
    "retrieval": (("id", "category", "query", "relevant"), "id string, category string, query string, relevant array<string>"),
    "extraction": (("id", "text", "expected"), "id string, text string, expected array<string>, forbidden array<string>, note string"),
    "assessment": (("id", "claim", "evidence", "expected_classification"), "id string, claim string, evidence string, expected_classification string, expected_proposal string, refined_statement string, note string, stratum string"),
}


def load_labelled(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """A labelled set of a YAML list (or of the list under `cases` or `queries`) as a table; missing, unknown or repeated keys are refused."""
    needed, schema = LABELLED[kind]
    names = [c.split()[0] for c in schema.split(", ")]
    raw = yaml.safe_load(text)
    rows = next((raw[k] for k in ("cases", "queries") if k in raw), None) if isinstance(raw, dict) else raw
    if not isinstance(rows, list):
        raise ValueError("no list of cases")
    seen = set()
    for r in rows:
        if missing := [k for k in needed if r.get(k) in (None, "")]:
            raise ValueError(f"{r.get('id')} lacks {missing}")
        if unknown := sorted(set(r) - set(names)):
            raise ValueError(f"{r['id']} has unknown keys {unknown}")
        if r["id"] in seen:
            raise ValueError(f"{r['id']} occurs twice")
        seen.add(r["id"])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def settings(defaults: dict[str, object], text: str = "", env: dict[str, str] | None = None, prefix: str = "CORPUSLOOM_") -> dict[str, object]:
    """Settings by name: the environment beats the file (lines of NAME=value), the file beats the defaults; values take the type of their default."""
    env = dict(os.environ) if env is None else env
    given = {k.strip(): v.strip().strip("\"'") for k, _, v in (x.partition("=") for x in text.splitlines() if "=" in x and not x.lstrip().startswith("#"))}

    def typed(value: str, like: object) -> object:
        if isinstance(like, bool):
            return value.lower() in ("1", "true", "yes", "on")
        return type(like)(value) if isinstance(like, (int, float)) else value

    out = {}
    for name, value in defaults.items():
        raw = env.get(prefix + name.upper(), given.get(prefix + name.upper()))
        out[name] = value if raw is None else typed(raw, value)
    return out
