"""The published schema of a question as a JSON Schema document, put together from its parts."""

from __future__ import annotations

from typing import Any

from attesta.operators import bank


def text(low: int | None = None, high: int | None = None, pattern: str | None = None, among: tuple[str, ...] = ()) -> dict[str, Any]:
    rules = {"minLength": low, "maxLength": high, "pattern": pattern, "enum": list(among) or None}
    return {"type": "string", **{k: v for k, v in rules.items() if v is not None}}


def closed(properties: dict[str, Any], *optional: str) -> dict[str, Any]:
    """An object with these keys only, all required but the optional ones."""
    return {"type": "object", "additionalProperties": False, "required": [k for k in properties if k not in optional], "properties": properties}


# Keys, lengths, patterns and codes of the published format.
OPTION_ID, FROM_1 = "^[a-d]$", {"type": "integer", "minimum": 1}
REFERENCE = closed(
    {"book": text(2, 40), "chapter": FROM_1, "verseStart": FROM_1, "verseEnd": FROM_1, "display": text(4, 80), "translation": text(2, 80), "note": text(high=300)},
    "verseEnd", "translation", "note",
)
REVIEW = closed({"referenceChecked": {"type": "boolean"}, "singleCorrectAnswerChecked": {"type": "boolean"}, "doctrinalSensitivity": text(among=bank.SENSITIVITIES), "notes": text(high=500)})
QUESTION = closed(
    {
        "id": text(pattern="^qb-[a-z0-9]+(?:-[a-z0-9]+)*$"), "version": {"const": 1}, "status": text(among=bank.STATUSES), "language": {"const": "es"}, "category": text(2, pattern=bank.SLUG),
        "difficulty": text(among=bank.LEVELS), "contentType": text(among=bank.CONTENT_TYPES), "prompt": text(10, 240),
        "options": {"type": "array", "minItems": 3, "maxItems": 4, "uniqueItems": True, "items": closed({"id": text(pattern=OPTION_ID), "text": text(1, 160)})},
        "correctOptionId": text(pattern=OPTION_ID), "explanation": text(20, 600), "references": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/reference"}},
        "tags": {"type": "array", "uniqueItems": True, "items": text(2, 40, bank.SLUG)}, "review": {"$ref": "#/$defs/review"},
    }
) | {"$defs": {"reference": REFERENCE, "review": REVIEW}}
