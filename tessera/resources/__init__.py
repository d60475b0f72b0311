"""Packaged tables."""

import json
import pkgutil
from functools import cache


@cache
def load(name: str) -> dict:
    return json.loads(pkgutil.get_data(__name__, f"{name}.json"))
