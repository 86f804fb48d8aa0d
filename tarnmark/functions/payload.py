"""Reading what a language model answered."""

from __future__ import annotations

import json
import re

_FENCED = re.compile(r"```[a-zA-Z]*\s*(.*?)\s*```$", re.S)


def response_text(response) -> str:
    """Text of a plain string, of an object with ``content``, or of content blocks."""
    content = getattr(response, "content", response)
    if isinstance(content, (list, tuple)):
        pieces = (b if isinstance(b, str) else b.get("text") if isinstance(b, dict) else None for b in content)
        return "".join(p for p in pieces if isinstance(p, str))
    return str(content)


def json_payload(text: str):
    """The JSON value in a model's answer: alone, fenced, or between the outermost braces or brackets; else None."""
    flat = text.strip()
    fenced = _FENCED.match(flat)
    flat = fenced[1] if fenced else flat
    tries = [flat] + [flat[flat.find(a) : flat.rfind(b) + 1] for a, b in ("{}", "[]") if 0 <= flat.find(a) < flat.rfind(b)]
    for one in tries:
        try:
            return json.loads(one)
        except ValueError:
            pass
    return None


def _ids(value) -> list[str] | None:
    return value if isinstance(value, list) and all(isinstance(x, str) for x in value) else None


def read_plan(text: str) -> list[str] | None:
    """Concept ids of a plan; None if malformed."""
    found = json_payload(text)
    return _ids(found if isinstance(found, list) else found.get("concept_ids") if isinstance(found, dict) else None)


_TRUE, _FALSE = {"true", "t", "yes", "y", "on", "1"}, {"false", "f", "no", "n", "off", "0"}


def _flag(value) -> bool | None:
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) and value in (0, 1):
        return bool(value)
    if isinstance(value, str):
        return True if value.lower() in _TRUE else False if value.lower() in _FALSE else None
    return None


def read_decision(text: str) -> tuple[bool, list[str]] | None:
    """(context suffices, next ids); None if malformed."""
    found = json_payload(text)
    if not isinstance(found, dict):
        return None
    enough, ids = _flag(found.get("sufficient")), _ids(found.get("next_concept_ids", []))
    return None if enough is None or ids is None else (enough, ids)


def read_answer(text: str) -> tuple[str, list[str]] | None:
    """(answer, citations); None if malformed."""
    found = json_payload(text)
    if not isinstance(found, dict) or not isinstance(found.get("answer"), str):
        return None
    ids = _ids(found.get("citations", []))
    return None if ids is None else (found["answer"], ids)
