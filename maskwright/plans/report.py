"""Reports: what every one of them states, and how they are written."""

from __future__ import annotations

import json

VERSION = "1"
LIMITATIONS = (
    "The classes rest on the columns that the policy names as quasi-identifiers; columns it misses are not measured.",
    "Statistics of classes describe this table alone, not what it reveals together with other data.",
    "Detectors find shapes: identifiers that are misspelt, spelt out or of other kinds remain.",
    "Pseudonymous data can be reversed by whoever holds the key; neither mode certifies anonymity.",
)
DICOM_LIMITATIONS = (
    "Pixels are not read: text that is burned into an image stays.",
    "The profile is a selection of the standard's attributes, not the whole of it.",
    "Attributes that no rule names are kept.",
    "Date shifts keep intervals: known dates elsewhere can reveal the shift.",
    "Remapped identifiers are pseudonyms for whoever holds the key.",
)


def to_json(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, indent=2)
