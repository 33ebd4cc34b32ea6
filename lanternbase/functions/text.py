"""Tokens of documents and queries, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query drops (fixed list).
STOP_WORDS = """
a an the this that these those i me my we our you your he she it they them is are was were be been being have has had do does did
will would could should can may might in on at to for of with by from about into through before after between under over and or but
if then because as while when where what which who how why up out no not so just also than too get go use make set show find tell help
""".split()


@cache
def fold_table() -> tuple[str, str]:
    """Letters with exactly one diacritic, and the letters without it.

    Letters whose decomposition is one letter and one combining mark lose the mark; those with two keep both.
    """
    source, target = "ſµ", "sμ"
    for first, last in ((0xC0, 0x24F), (0x386, 0x3CE), (0x400, 0x45F), (0x1E00, 0x1EFF)):
        for c in map(chr, range(first, last + 1)):
            parts = unicodedata.normalize("NFD", c)
            if c == c.lower() and len(parts) == 2 and unicodedata.combining(parts[1]):
                source, target = source + c, target + parts[0]
    return source, target


def fold(text: Column) -> Column:
    """Lower case without diacritics, also of decomposed letters. ASCII texts skip the character table, which is the costly part."""
    folded = F.translate(F.regexp_replace(F.lower(text), "\\p{Mn}+", ""), *fold_table())
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def document_tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text; null gives no tokens."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}\\p{Co}]+"), lambda t: t != "")


def query_tokens(query: Column) -> Column:
    """Runs of letters, digits and underscores with two bytes or more that are no stop words; order and repeats stay."""
    runs = F.split(F.coalesce(query, F.lit("")), "[^\\p{IsAlphabetic}\\p{N}_]+")
    return F.filter(runs, lambda t: (F.octet_length(t) >= 2) & ~F.lower(t).isin(STOP_WORDS))


def query_phrases(query: Column) -> Column:
    """The token list of each query token: one with an underscore is a phrase of adjacent terms, maybe of none."""
    return F.transform(query_tokens(query), document_tokens)


def trim(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+\\z", "")
