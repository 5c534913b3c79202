"""Answers as text: compact or indented JSON, or a compact tabular form. Text stays as it is."""

from __future__ import annotations

import json
from typing import Any


def compact(answer: Any) -> str:
    return answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False, separators=(",", ":"))


def pretty(answer: Any) -> str:
    return answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False, indent=2)


def _scalar(value: Any) -> str:
    if value is None or isinstance(value, (bool, int, float)):
        return json.dumps(value)
    text = str(value)
    plain = text and text == text.strip() and not any(c in text for c in ',:"\\\n\r\t[]{}#|') and text not in ("true", "false", "null") and not text.startswith("-")
    try:
        float(text)
        plain = False
    except ValueError:
        pass
    return text if plain else json.dumps(text, ensure_ascii=False)


def tabular(answer: Any) -> str:
    """Keys with values, and lists of like records as a header with one line a record; JSON where the form doesn't fit."""
    if isinstance(answer, str):
        return answer
    lines = []
    for key, value in answer.items():
        if isinstance(value, list):
            names = list(value[0]) if value and isinstance(value[0], dict) else []
            if not value:
                lines.append(f"{key}[0]:")
            elif names and all(isinstance(r, dict) and list(r) == names for r in value):
                lines.append(f"{key}[{len(value)}]{{{','.join(names)}}}:")
                lines += ["  " + ",".join(_scalar(r[n]) for n in names) for r in value]
            else:
                return compact(answer)
        elif isinstance(value, dict):
            return compact(answer)
        else:
            lines.append(f"{key}: {_scalar(value)}")
    return "\n".join(lines)
