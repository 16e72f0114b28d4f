"""Pieces of DuckDB SQL that several oracle queries use."""

from __future__ import annotations

from quirestone.functions.text import NOT_WS_CLASS, WS_CLASS  # noqa: F401


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def blank(x: str) -> str:
    return f"coalesce({trim(x)} = '', TRUE)"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS_CLASS}+', ' ', 'g'), ' ')"


def tokens(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '{NOT_WS_CLASS}+')), 0)"


def first_tokens(x: str, n: str) -> str:
    return f"array_to_string(list_slice(regexp_extract_all({x}, '({WS_CLASS}*{NOT_WS_CLASS}+)', 1), 1, {n}), '')"


def sha256(x: str) -> str:
    return f"sha256({x})"
