"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that become Python values at once.
SLICE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(column: str = "doc_id") -> Column:
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(id_text(column)), F.lit(folds))


def batch_map(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Map columns to columns, an Arrow batch at a time.

    ``fn`` gets a dict of Python lists and returns a dict of lists, arrays or
    Arrow arrays in the order of ``schema``, for up to SLICE rows at a time.
    Spark bounds a batch in rows and in bytes, so memory does not follow the
    partition's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                out = fn(batch.slice(k, SLICE).to_pydict())
                yield pa.RecordBatch.from_pydict(
                    {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()}
                )

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of byte strings, remembered up to a bound."""

    def __init__(self, limit: int = 400_000, seed: int = 0):
        super().__init__()
        import xxhash

        self._hash, self._limit, self._seed = xxhash.xxh64_intdigest, limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        found = self[word] = self._hash(word, self._seed)
        return found


ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case, as UTF-8."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
