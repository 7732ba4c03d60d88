"""What the text operators share: row hygiene, words as bytes, the shared folder."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from adjudica.operators.components import scratch_path, shared_folder as shared_dir, stored

#: Lower-cases A-Z and turns every byte outside 0-9, a-z, 0x80-0xFF into a space, so that
#: ``split()`` gives the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def base_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text string) of every row, null text as empty; other columns go."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def word_bytes(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class WordHashes:
    """64-bit hashes of words, memoised up to ``limit`` entries (then begun anew)."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.seen = limit, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        new = set(words).difference(seen)
        if len(seen) + len(new) > self.limit:
            seen.clear()
            new = set(words)
        for w in new:
            seen[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


__all__ = ["WORD_BYTES", "WordHashes", "base_rows", "mix64", "scratch_path", "shared_dir", "stored", "word_bytes"]
