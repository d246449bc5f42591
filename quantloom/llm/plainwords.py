"""Words of letters, digits and all characters beyond ASCII, as bytes, for operators that read texts in Arrow batches."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

# The helpers travel with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A word of a text in UTF-8 whose A-Z are lower-cased: every byte from 0x80 belongs to a character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_END = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20


def pieces(text: bytes, size: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(start, lower-cased part): the text in parts of about `size` (else `PIECE`) bytes, each ending where no word is split."""
    start, size = 0, size or PIECE
    while start < len(text):
        end = start + size
        if end < len(text):
            found = _END.search(text, end)
            end = found.end() if found else len(text)
        yield start, text[start:end].lower()  # bytes.lower changes A-Z only
        start = end


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of the text in order, a list for each piece."""
    for _, part in pieces(text):
        yield WORD.findall(part)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch in UTF-8; a NULL is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
