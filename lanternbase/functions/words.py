"""Tokens of texts in letters below U+0200, by Arrow batches: those of ``text.document_tokens``, from tables of bytes instead of regular expressions.

Below U+0200 neither the case nor the diacritic of a letter depends on its neighbours, and no folded letter takes more bytes than the letter did.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternbase.functions.text import fold_table

#: The first byte of U+0200 in UTF-8.
_BEYOND = 0xC8
#: What stands for a byte between tokens, and for one that a folded letter no longer needs.
_GAP, _NONE = 0x20, 0x01
#: What ``trim`` takes from both ends.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def plain(text: Column) -> Column:
    """Whether a text is UTF-8 and all of its characters are below U+0200; ``split_plain`` is for these only."""
    return F.is_valid_utf8(text) & ((F.octet_length(text) == F.length(text)) | ~text.rlike("[^\\x{0}-\\x{1FF}]"))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The folded byte of each ASCII byte, and the two folded bytes of each letter of two bytes, by its number."""
    folds, one, two = str.maketrans(*fold_table()), np.full(256, _GAP, np.uint8), np.full((0x200, 2), _GAP, np.uint8)
    for c in range(0x200):
        made = "".join(x for x in chr(c).lower() if unicodedata.category(x) != "Mn")
        made = (made.translate(folds) if c >= 0x80 else made).encode()
        if unicodedata.category(made.decode())[0] in "LN":
            if c < 0x80:
                one[c] = made[0]
            else:
                two[c] = made[0], made[1] if len(made) > 1 else _NONE
    return one, two


def are_plain(texts: pa.StringArray) -> np.ndarray:
    """Whether all of each text's characters are below U+0200."""
    data, at, lengths = _bytes(texts)
    beyond = np.append(0, np.cumsum(data >= _BEYOND, dtype=np.int32)) if (data >= _BEYOND).any() else None
    return np.ones(len(lengths), bool) if beyond is None else beyond[at + lengths] == beyond[at]


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some texts one after the other, and where each text's begin and how many they are."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], np.diff(offsets)


def _marked(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes with marks for gaps and bytes that are gone, where tokens begin, and how many each text has; a null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    data, at, lengths = _bytes(texts)
    one, two = _tables()
    out = one[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        pair = two[((data[lead] & 31).astype(np.int32) << 6) | (data[lead + 1] & 63)]
        out[lead], out[lead + 1] = pair[:, 0], pair[:, 1]
    within = out != _GAP
    begins = within.copy()
    begins[1:] &= ~within[:-1]
    edge = at[lengths > 0]
    begins[edge] = within[edge]
    starts = np.flatnonzero(begins)
    upto = np.searchsorted(starts, np.append(at, len(data)))
    return out, starts, np.diff(upto)


def count_plain(texts: pa.StringArray) -> np.ndarray:
    """The number of tokens of each of some plain texts."""
    return _marked(texts)[2]


def split_plain(texts: pa.StringArray) -> pa.ListArray:
    """The tokens of each of some plain texts."""
    out, starts, counts = _marked(texts)
    kept = out > _GAP
    # a token's first byte is never one that is gone
    offsets = np.append(0, np.cumsum(kept, dtype=np.int32))[np.append(starts, len(out))].astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(out[kept]))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), tokens)
