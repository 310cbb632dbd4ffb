"""Words of a text as bytes, and the items of a benchmark in blocks that a worker can hold."""

from __future__ import annotations

import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is no digit, no letter and no character beyond ASCII parts words; of letters only A-Z are lower-cased.
_KEPT = set(string.digits.encode() + string.ascii_lowercase.encode()) | set(range(0x80, 0x100))
_TABLE = bytes(b if b in _KEPT else ord(" ") for b in (ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else b for b in range(256)))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, in order; bytes.split parts at ASCII white space alone."""
    return text.translate(_TABLE).split()


def item_blocks(items: DataFrame, key: str, text: str, weight: Column, most: int) -> Iterator[DataFrame]:
    """Items (_item, _text) in blocks by a hash of their key, of about ``most`` in summed weight each; an item is never parted.

    Whoever asks takes one block at a time to the driver and to the workers, so what these hold does not grow with the items.
    """
    kept = items.select(F.col(f"`{key}`").cast("long").alias("_item"), F.col(f"`{text}`").alias("_text"))
    total = kept.agg(F.sum(weight)).first()[0] or 0
    blocks = max(1, -(-total // most))
    for b in range(blocks):
        yield kept if blocks == 1 else kept.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b)
