"""Reading the ontology file on the driver: configuration of at most a few hundred lines."""

from __future__ import annotations

import json

from stockweave.operators.ontology import Ontology, from_dict


def load_ontology(path: str) -> Ontology:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return from_dict(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a YAML ontology needs PyYAML; give it as JSON instead") from e
    return from_dict(yaml.safe_load(text))
