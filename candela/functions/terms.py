"""Term lists to compact tests with the same result.

A term that contains another term of its list can never decide a substring test, so it is
dropped.  What is left becomes either a literal array (long texts) or one prefix-sharing
pattern (short names), whichever scans that kind of text faster.
"""

from __future__ import annotations

import re
from collections.abc import Iterable


def minimal_terms(terms: Iterable[str]) -> list[str]:
    """Terms that hold no other term of the list, shortest first."""
    unique = list(dict.fromkeys(terms))
    kept = [t for t in unique if not any(o != t and o in t for o in unique)]
    return sorted(kept, key=len)


def prefix_pattern(terms: Iterable[str]) -> str:
    """One regular expression that finds any of the terms, common prefixes shared."""
    root: dict = {}
    for term in minimal_terms(terms):
        node = root
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        if "" in node:
            return ""
        arms = [re.escape(ch) + emit(child) for ch, child in node.items()]
        return arms[0] if len(arms) == 1 else "(?:" + "|".join(arms) + ")"

    return emit(root)
