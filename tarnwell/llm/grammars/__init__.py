"""Parsing-expression grammars by language. parser(language) gives one, built once a process."""

from __future__ import annotations

from functools import cache
from importlib import import_module

#: Language names of files.language that have a grammar, and the module that builds it.
LANGUAGES = {"javascript": "ecma", "typescript": "ecma", "csharp": "csharp", "python": "python", "sql": "sql", "json": "small", "css": "small", "proto": "small"}


@cache
def parser(language: str):
    """An object with parse(text) -> -1 or the furthest failure position."""
    return import_module(f"{__name__}.{LANGUAGES[language]}").build(language)
