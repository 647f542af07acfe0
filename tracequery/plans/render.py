"""Results as JSON, text and trees."""

from __future__ import annotations

import json


def to_json(result: dict) -> str:
    return json.dumps(result, indent=2, ensure_ascii=False, default=str)


def to_text(result, indent: int = 0) -> str:
    """Nested dictionaries and lists as indented lines."""
    pad, lines = "  " * indent, []
    if isinstance(result, dict):
        for k, v in result.items():
            lines += [f"{pad}{k}:", to_text(v, indent + 1)] if isinstance(v, (dict, list)) and v else [f"{pad}{k}: {v}"]
    elif isinstance(result, list):
        for v in result:
            lines += [f"{pad}-", to_text(v, indent + 1)] if isinstance(v, (dict, list)) else [f"{pad}- {v}"]
    else:
        lines.append(f"{pad}{result}")
    return "\n".join(lines)


def tree_lines(counts: list[tuple[str, int]]) -> list[str]:
    """Lines of a tree from (dotted path, number of signals)."""
    return [f"{'  ' * path.count('.')}{path.rsplit('.', 1)[-1]} ({n} signals)" for path, n in sorted(counts, key=lambda x: x[0].split("."))]
