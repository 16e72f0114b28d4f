"""White space, tokens, normal forms and hashes as built-in Spark expressions.

White space is the 29-character class of Python's ``str.isspace``. Java's ``\\s`` knows only six of
them, so every expression here names the class explicitly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 white-space characters, once as a regular-expression class, once as characters.
WS_CLASS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS_CLASS = WS_CLASS.replace("[", "[^", 1)
_OTHER_WS_CLASS = WS_CLASS.replace(r"\x{20}", r"\x{1f}")
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# For Java's engine, which tests the parts of a class in order: first what most characters are, then the rest.
_TOKEN = f"[!-~{NOT_WS_CLASS}]++"
_RUN = f"[[^!-~]&&{WS_CLASS}]"
_RUN_BUT_ONE_SPACE = f" {_RUN}++|[[^ -~]&&{_OTHER_WS_CLASS}]{_RUN}*+"


def trim_ws(text: Column) -> Column:
    """``text`` without white space at both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    """True for null, empty and all-white-space text."""
    return text.isNull() | (trim_ws(text) == "")


def normalize_ws(text: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, _RUN_BUT_ONE_SPACE, " "), F.lit(" "))


def token_count(text: Column) -> Column:
    """Number of maximal runs of other characters than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0))


def has_more_tokens(text: Column, n: int) -> Column:
    """Whether ``text`` has more than ``n`` tokens; most texts are too short for that and aren't searched."""
    return (F.length(text) > 2 * n) & (token_count(text) > n)


def first_tokens(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th token, the white space inside kept as it is."""
    pieces = F.regexp_extract_all(text, F.lit(f"({_RUN}*+{_TOKEN})"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), F.greatest(n, F.lit(0))), "")


def content_hash(text: Column) -> Column:
    """sha256 of the normalized text, in hex."""
    return F.sha2(normalize_ws(text), 256)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Name-based UUID of version 5, equal to ``uuid.uuid5(namespace, name)``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), -1, 1)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
