"""Language identification by compression.

For each language there is a raw-content zstandard dictionary: lower-case text of a bounded, seeded sample of labelled
documents.  A whole text is brought to the same form (lower case, runs of other than letters as one space), cut into
blocks of ``BLOCK`` bytes, and every block is compressed on its own with each dictionary; the language with the fewest
bytes in total wins.  Blocks keep the dictionary decisive in long texts, which would else soon be compressed by
themselves.  A text below ``SHORT`` bytes is repeated up to them, as a tiny block is stored as it is, with one size for all
dictionaries.  ``margin`` is 1 - best/second; below ``MIN_MARGIN`` the prediction counts as rejected.

Bound of the sample: at most ``SAMPLE_DOCS`` documents a language are looked at, of at most ``SAMPLE_CHARS`` characters
(where a language has only longer ones, its shortest), and ``DICT_BYTES`` are kept.  Prediction covers every document.

Scale.  Fitting is one count and one filtered read; the driver holds languages x DICT_BYTES.  Prediction is one narrow
pass in Arrow batches, with the dictionaries prepared once for each Python worker.

Cases.  Null text or text without a letter: ``und``, score 0, rejected.  No labelled document at all: every text is
``und``.  One language only: it is predicted with score 1.  Equal sizes: the first language in code-point order, margin
0.  Repeated rows: each gets its row.  Extra columns are ignored.  Empty table: no rows.  Very long texts: linear.
"""

from __future__ import annotations

import re
from functools import lru_cache

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import map_texts

SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 400, 8_192, 110_000
BLOCK, LEVEL, SHORT = 1_024, 6, 256
MIN_MARGIN = 0.005
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


def in_training(doc_id: str = "doc_id") -> Column:
    """Documents that may be learned from; those without an id are not, nor are they held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def plain(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """The dictionaries of the languages of training documents."""
    known = docs.where(in_training(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string")).alias("h"))
    fits = F.length("text") <= SAMPLE_CHARS
    counts = known.groupBy("lang").agg(F.sum(fits.cast("long")).alias("n"), F.count(F.lit(1)).alias("all")).collect()
    out: dict[str, bytes] = {}
    share = {r["lang"]: min(1.0, 2 * SAMPLE_DOCS / r["n"]) for r in counts if r["n"]}
    if share:
        # the digest's place in its range picks about twice the documents that are asked for; the first of them are taken
        part = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
        place = (F.col("h").cast("double") / 2.0**64) + 0.5
        picked = known.where(fits & (place <= part[F.col("lang")])).select("lang", F.struct("h", "text").alias("x"))
        # in groups first, so that the list of one language is bounded wherever it is made
        some = picked.groupBy("lang", F.pmod(F.col("x")["h"], F.lit(16)).alias("g")).agg(F.slice(F.array_sort(F.collect_set("x")), 1, SAMPLE_DOCS // 8).alias("xs"))
        for r in some.groupBy("lang").agg(F.slice(F.array_sort(F.flatten(F.collect_list("xs"))), 1, SAMPLE_DOCS).alias("xs")).collect():
            out[r["lang"]] = _joined(x["text"] for x in r["xs"])
    if long_only := [r["lang"] for r in counts if not r["n"]]:
        for r in known.where(F.col("lang").isin(long_only)).groupBy("lang").agg(F.min_by(F.left("text", F.lit(DICT_BYTES)), F.struct(F.length("text"), F.col("h"))).alias("text")).collect():
            out[r["lang"]] = _joined([r["text"]])
    return {k: v for k, v in sorted(out.items()) if v}


def _joined(texts) -> bytes:
    seen, out, size = set(), [], 0
    for t in texts:
        if t not in seen and size < DICT_BYTES:
            seen.add(t)
            out.append(plain(t))
            size += len(out[-1]) + 1
    return b" ".join(x for x in out if x)[:DICT_BYTES]


@lru_cache(maxsize=2)
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return made


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float]:
    """Language and margin of one text."""
    body = plain(text) if text and any(map(str.isalpha, text)) else b""
    if not body or not model:
        return UNDETERMINED, 0.0
    if len(body) < SHORT:
        body = b" ".join([body] * -(-SHORT // (len(body) + 1)))
    blocks = [body[i : i + BLOCK] for i in range(0, len(body), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in _compressors(model))
    return sizes[0][1], 1.0 if len(sizes) == 1 else 1.0 - sizes[0][0] / sizes[1][0]


def predict(docs: DataFrame, model: dict[str, bytes], *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The columns ``keep`` of every document, with lang_pred, score (the margin, 0 to 1) and rejected."""
    fixed = tuple(sorted(model.items()))

    def find(texts: list[str | None]) -> list:
        found = [classify(t, fixed) for t in texts]
        return [[x for x, _ in found], [y for _, y in found], [x == UNDETERMINED or y < min_margin for x, y in found]]

    return map_texts(docs, text, keep, find, "lang_pred string, score double, rejected boolean")
