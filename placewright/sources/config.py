"""Configuration from a file: TOML or JSON, and YAML where its package is installed."""

import json
import tomllib

REQUIRED = ("texts", "numbers")


def load_config(path: str) -> dict:
    """The file as a dictionary."""
    with open(path, "rb") as f:
        data = f.read()
    if path.endswith(".json"):
        return json.loads(data)
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(data)
    return tomllib.loads(data.decode())


def field_paths(config: dict) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """The paths of text and number columns for ``documents.extract_fields``; both maps must be there, and a lone path is a list of one."""
    fields = config.get("fields") or {}
    missing = [k for k in REQUIRED if not isinstance(fields.get(k), dict)]
    if missing:
        raise ValueError(f"no paths of fields: {missing}")
    texts, numbers = ({n: [p] if isinstance(p, str) else list(p) for n, p in fields[k].items()} for k in REQUIRED)
    return texts, numbers
