"""Lexical extractors. Each has symbols(), calls() and imports() of a source's bytes; all ranges are byte offsets."""

from corpusloom.operators.languages import go, python, rust, script

EXTRACTORS = {"python": python, "rust": rust, "go": go, "typescript": script.TYPESCRIPT, "javascript": script.JAVASCRIPT}
