"""What several operators need: written tables, columns made of texts, runs of equal keys, disjoint sets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.session import cut, discard, new_path, shared_dir
from strandloom.sums import summed

__all__ = ["Sets", "by_key", "cut", "discard", "finite_rows", "map_texts", "new_path", "orderable", "positional", "shared_dir", "split_words", "summed", "table", "words_of"]

#: Texts that are Python objects at a time; Spark bounds the batch around them by bytes.
SLICE_ROWS = 1_000
# Blocks of scripts that put no spaces between words (Thai, Lao, Tibetan, Burmese, Khmer, Japanese, Chinese).
UNSPACED = (
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)
_SPACED = re.compile(r"\w+")
_HIGH = re.compile(f"[{chr(UNSPACED[0][0])}-\U0010ffff]")
_blocks = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
_MIXED = re.compile(rf"[^\W{_blocks}]+|(?=\w)[{_blocks}]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns named by position, so that an operator can add columns of any other name, and the new names by the old ones."""
    names = {c: f"__in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def orderable(df: DataFrame) -> list[str]:
    """The columns that rows can be ordered by."""
    plain = lambda kind: not re.search(r"\b(map|variant|interval|geometry|geography)\b", kind)
    return [f"`{c}`" for c, kind in df.dtypes if plain(kind)]


def words_of(text: Column | str) -> Column:
    """Number of runs of characters that are not ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def map_texts(docs: DataFrame, text: str, keep: Sequence[str], find: Callable[[list[str | None]], list[Sequence]], added: str) -> DataFrame:
    """The columns ``keep`` and those of the schema ``added``, which ``find`` makes, a list each, of a batch's texts.

    A kept column whose name, in any case, is that of a made one is left out: the made one replaces it.  In Arrow batches,
    so that null and large integers stay as they are.
    """
    kinds = T._parse_datatype_string(added).fields
    made_names = {f.name.lower() for f in kinds}
    columns = [c for c in dict.fromkeys(keep) if c.lower() not in made_names]
    slim = docs.select(*[F.col(f"`{c}`") for c in columns])
    fields = slim.schema.fields
    if text in columns and slim.schema[text].dataType == T.StringType():
        at = columns.index(text)  # no second copy for the worker
    else:
        at, slim = len(columns), docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*fields, *kinds])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            made = find(batch.column(at).to_pylist())
            new = [pa.array(x, arrow.field(len(columns) + i).type) for i, x in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *new], names=arrow.names)

    return slim.mapInArrow(run, schema)


def by_key(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """One table for each run of rows with equal first ``n_keys`` columns; the rows come sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
        start = 0
        for i in range(batch.num_rows + 1):
            if i < batch.num_rows and keys[i] == last:
                continue
            if i > start:
                held.append(batch.slice(start, i - start))
            if i < batch.num_rows:
                if held:
                    yield pa.Table.from_batches(held)
                held, last, start = [], keys[i], i
    if held:
        yield pa.Table.from_batches(held)


def finite_rows(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the lists with ``size`` entries, all of them finite numbers, and these as a matrix of doubles."""
    lists = lists.cast(pa.large_list(pa.float64()))
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == size)
    values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
    good = np.isfinite(values).all(1)
    return at[good], values[good]


def split_words(text: str | None) -> list[str]:
    """Runs of word characters in lower case; in scripts without spaces, each letter is a word of its own."""
    if not text:
        return []
    text = text.lower()
    return (_MIXED if _HIGH.search(text) else _SPACED).findall(text)


class Sets:
    """Disjoint sets of 0 .. n-1; a set's root is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y
