"""Configuration files: discovery, loading by extension, merging, validation. One small document, so on the driver."""

from __future__ import annotations

import json
import os
import re

BASENAMES = (".golangci.yml", ".golangci.yaml", ".golangci.json")
UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def load(path: str) -> dict:
    """By extension: yml, yaml or json; another one is an error."""
    kind = os.path.splitext(path)[1].lstrip(".").lower()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if kind == "json":
        return json.loads(text)
    if kind in ("yml", "yaml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package") from e
        return yaml.safe_load(text) or {}
    raise ValueError(f"unsupported configuration format: {kind or path}")


def discover(start: str, home: str | None = None) -> str | None:
    """The first configuration file in the folder, its ancestors, then the home folder."""
    here, seen = os.path.abspath(start), []
    while here not in seen:
        seen.append(here)
        here = os.path.dirname(here)
    if home and os.path.abspath(home) not in seen:
        seen.append(os.path.abspath(home))
    return next((os.path.join(d, b) for d in seen for b in BASENAMES if os.path.isfile(os.path.join(d, b))), None)


def merge(base: dict, over: dict) -> dict:
    """Scalars: the overlay's unless zero; lists: appended, once each; booleans: or; maps: merged."""
    out = dict(base)
    for k, v in over.items():
        b = base.get(k)
        if isinstance(v, dict) and isinstance(b, dict):
            out[k] = merge(b, v)
        elif isinstance(v, list) and isinstance(b, list):
            out[k] = list(dict.fromkeys([*b, *v])) if all(isinstance(x, str) for x in [*b, *v]) else b + [x for x in v if x not in b]
        elif isinstance(v, bool) or isinstance(b, bool):
            out[k] = bool(b) or bool(v)
        elif v or k not in base:
            out[k] = v
    return out


def duration(text: str) -> float:
    """Seconds of a duration such as 1h2m3.5s."""
    if text in ("0", ""):
        return 0.0
    sign = -1.0 if text[0] == "-" else 1.0
    rest = text.lstrip("+-")
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(h|ms|us|µs|ns|m|s)", rest)
    if not parts or "".join(a + b for a, b in parts) != rest:
        raise ValueError(f"not a duration: {text}")
    return sign * sum(float(a) * UNITS[b] for a, b in parts)


def canonical(value) -> str:
    """JSON with sorted keys, without empty values at any depth."""

    def pruned(x):
        if isinstance(x, dict):
            kept = {k: p for k, v in x.items() if (p := pruned(v)) not in (None, "", [], {}, False, 0)}
            return kept
        if isinstance(x, list):
            return [pruned(v) for v in x]
        return x

    return json.dumps(pruned(value), sort_keys=True, separators=(",", ":"))


def salt(name: str, settings: dict) -> str:
    import hashlib

    text = canonical(settings)
    return hashlib.sha256(f"{len(name)}:{name}{len(text)}:{text}".encode()).hexdigest()


#: Where version 1 keys went in version 2.
MOVED = {
    ("run", "skip-dirs"): ("linters", "exclusions", "paths"),
    ("run", "skip-files"): ("linters", "exclusions", "paths"),
    ("issues", "exclude-dirs"): ("linters", "exclusions", "paths"),
    ("issues", "exclude-files"): ("linters", "exclusions", "paths"),
    ("issues", "exclude-rules"): ("linters", "exclusions", "rules"),
    ("linters-settings",): ("linters", "settings"),
}


def migrated(config: dict) -> tuple[dict, list[str]]:
    """A version 2 document from a version 1 one, and warnings about what moved."""
    if str(config.get("version", "1")) == "2":
        return config, []
    out, warnings = json.loads(json.dumps(config)), []
    for old, new in MOVED.items():
        here = out
        for k in old[:-1]:
            here = here.get(k) if isinstance(here, dict) else None
        if not isinstance(here, dict) or old[-1] not in here:
            continue
        value = here.pop(old[-1])
        warnings.append(f"{'.'.join(old)} is now {'.'.join(new)}")
        piece = value
        for k in reversed(new):
            piece = {k: piece}
        out = merge(out, piece)
    out["version"] = "2"
    return out, warnings


def exclusion_patterns(config: dict) -> list[str]:
    linters = config.get("linters") or {}
    return [*((linters.get("exclusions") or {}).get("paths") or []), *((config.get("formatters") or {}).get("exclusions", {}).get("paths") or [])]
