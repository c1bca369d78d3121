"""Words and stable draws shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, functions as F

# A word is a run of anything but space, tab, line feed, vertical tab, form feed
# and carriage return.  ``bytes.split()`` cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """``crc32(doc_id as text) mod divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Text that a Python task turns into objects at once.
PIECE_BYTES = 1 << 20


def pieces(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch in runs of about ``size`` bytes, or one text if that is longer, each with its first row."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(lengths):
        held += int(n)
        if held >= size:
            yield first, texts.slice(first, i + 1 - first).to_pylist()
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts.slice(first).to_pylist()
