"""Column functions on text: accents, names, tokens, ids in links. Built-in expressions only."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """All characters that decompose to one ASCII character and marks, and those ASCII characters."""
    src, dst = [], []
    for k in range(0x80, sys.maxunicode + 1):
        plain = unicodedata.normalize("NFD", chr(k)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            src.append(chr(k))
            dst.append(plain)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accents()


def strip_accents(c: Column) -> Column:
    """Accents off, then every character beyond ASCII dropped (letters without a decomposition too)."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def normalize_name(c: Column) -> Column:
    """Upper case without accents and outer blanks; null is ''."""
    return F.coalesce(F.trim(F.upper(strip_accents(c))), F.lit(""))


#: Status tags that follow a name in exported tables.
STATUS_TAGS = ["DTD", "OUT", "G-League", "TWO-WAY", "FA"]
#: Position groups of a roster and the positions they stand for.
POSITIONS = {"G": "SG", "F": "SF", "GF": "SG", "FG": "SF", "FC": "PF", "CF": "C"}


def clean_entity_name(c: Column, tags: list[str] | None = None) -> Column:
    """What stands before `(`, without outer quotes and status tags, blanks collapsed; null stays null."""
    head = F.regexp_replace(F.split(c, r"\(", 2)[0], "^[\"']+|[\"']+$", "")
    return F.array_join(F.filter(F.split(F.trim(head), r"\s+"), lambda t: (t != "") & ~t.isin(tags or STATUS_TAGS)), " ")


def first_token(c: Column) -> Column:
    """The first word; null if there is none."""
    return F.nullif(F.split(F.trim(c), r"\s+")[0], F.lit(""))


def last_token(c: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.trim(c), r"\s+"), -1), F.lit(""))


def split_name(c: Column) -> tuple[Column, Column]:
    """First and last name; a single word is a last name with first name ''."""
    parts = F.split(F.trim(c), r"\s+")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(""), F.element_at(parts, -1)


def extract_id(c: Column, pattern: str) -> Column:
    """Group 1 of the first match; null without one."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def primary_category(c: Column, names: dict[str, str] | None = None) -> Column:
    """The part before `-`, trimmed, mapped by `names` where it is there."""
    head = F.trim(F.split(c, "-", 2)[0])
    return F.coalesce(mapped(head, names or POSITIONS), head)


def mapped(c: Column, names: dict[str, str]) -> Column:
    """names[c], null where c isn't a key. For a few dozen keys; use a join beyond."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def alias(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(mapped(c, names), c)


def signed_text(c: Column) -> Column:
    """A number with its sign, as text: +3.5, -2.0, 0.0."""
    return F.when(c > 0, F.concat(F.lit("+"), c.cast("string"))).otherwise(c.cast("string"))
