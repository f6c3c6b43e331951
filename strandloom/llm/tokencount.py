"""Token counts by compiled transducers, without running a tokenizer over the texts.

The vocabulary is a byte-level BPE (a ``tokenizers`` JSON file).  Two deterministic transducers are compiled from it:

*  The splitter, over 12 character classes and 13 states.  A transition tells whether a piece of text ends before the
   character read, or before the one ahead of it (``_machine``).
*  The lexicon, over the bytes of a piece.  A transition emits the change of the number of tokens (``countmachine``).

A batch of texts is one string of classes, with an end mark after each text, and is cut into chunks of ``CHUNK``
characters.  Each chunk is run from *every* state at once, which gives its state map; the maps compose associatively
and a parallel prefix scan (``_scan``) gives each chunk's true first state; a second run marks the piece ends.  Both
runs go through all chunks in step, a column of characters at a time.  Every piece starts in the lexicon's first state, so pieces
then go through the lexicon in step, and what it emits adds up by document.

Exactness.  Character classes are taken from the library itself, for every code point.  Counts are those of merging, without
digests.  The text of a special token counts as one token and splits the text, as the library does by default.  A vocabulary
whose merges use symbols before they are made is refused.

Scale.  One narrow pass, no shuffle.  A worker holds one group of texts (``GROUP_CHARS``, or one longer text, at about 40 bytes
a character) and the transitions compiled so far, in tables of at most about 200 MB, and their states (``countmachine.STATES``).  The compiled vocabulary
is fixed by the file.

Cases.  Null text: empty, 0 tokens.  Repeated rows: each gets its row.  Extra columns are ignored.  Empty table: no rows.
Very long texts and pieces: linear in their length.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from strandloom.llm.countmachine import Transducer
from strandloom.llm.shared import map_texts

CHUNK = 64
GROUP_CHARS = 1 << 20
LIMIT = 512

# Classes of characters.
_LETTER, _STMD, _R, _V, _E, _L, _NUMBER, _APOSTROPHE, _SIGN, _SPACE, _BLANK, _END = range(12)
_CLASSES = 12
# States: at a start; in a run of letters, digits, signs; in white space of one character or more, ending in a space or
# another blank; after an apostrophe, perhaps with the first letter of a two-letter ending; after a whole contraction.
_START, _IN_L, _IN_N, _IN_S, _ONE_SP, _ONE_BL, _MORE_SP, _MORE_BL, _AP, _AP_R, _AP_V, _AP_L, _WHOLE = range(13)
_STATES = 13
_HERE, _BACK = 1, 2  # a piece ends before the character read; before the one ahead of it


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by state * _CLASSES + class."""
    letters = (_LETTER, _STMD, _R, _V, _E, _L)
    fresh = {**dict.fromkeys(letters, _IN_L), _NUMBER: _IN_N, _APOSTROPHE: _AP, _SIGN: _IN_S, _SPACE: _ONE_SP, _BLANK: _ONE_BL, _END: _START}
    joined = fresh | {_APOSTROPHE: _IN_S}  # behind a space, an apostrophe is a sign like others
    nxt, mark = np.zeros((_STATES, _CLASSES), np.uint8), np.full((_STATES, _CLASSES), _HERE, np.uint8)
    for c in range(_CLASSES):
        nxt[:, c] = fresh[c]
    stays = {_IN_L: letters, _IN_N: (_NUMBER,), _IN_S: (_SIGN, _APOSTROPHE)}
    for state, classes in stays.items():
        for c in classes:
            nxt[state, c], mark[state, c] = state, 0
    for state in (_ONE_SP, _ONE_BL, _MORE_SP, _MORE_BL):
        for c, to in ((_SPACE, _MORE_SP), (_BLANK, _MORE_BL)):
            nxt[state, c], mark[state, c] = to, 0
        for c in (*letters, _NUMBER, _APOSTROPHE, _SIGN):  # the last space goes with what follows, the last blank stands alone
            if state in (_ONE_SP, _MORE_SP):
                nxt[state, c] = joined[c]
                mark[state, c] = 0 if state == _ONE_SP else _BACK
            elif state == _MORE_BL:
                mark[state, c] = _HERE | _BACK
    for c, to in ((_SIGN, _IN_S), (_APOSTROPHE, _IN_S), (_STMD, _WHOLE), (_R, _AP_R), (_V, _AP_V), (_L, _AP_L)):
        nxt[_AP, c], mark[_AP, c] = to, 0
    for state, last in ((_AP_R, _E), (_AP_V, _E), (_AP_L, _L)):
        for c in range(_CLASSES):  # no contraction after all: the apostrophe was a piece, and letters began after it
            nxt[state, c] = _IN_L if c in letters else fresh[c]
            mark[state, c] = _BACK if c in letters else _BACK | _HERE
        nxt[state, last], mark[state, last] = _WHOLE, 0
    return nxt.ravel(), mark.ravel()


@lru_cache(maxsize=1)
def unicode_classes(path: str) -> bytes:
    """The class of each code point, as the library's own splitter groups it; compressed to a few kilobytes."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    table = np.full(0x110000, _SIGN, np.uint8)
    for first in range(0, 0x110000, 0x1000):
        points = [p for p in range(first, first + 0x1000) if not 0xD800 <= p < 0xE000]
        # "a" joins letters, "1" digits, "." signs; white space leaves its neighbours alone.  Three characters a point.
        for near, kind in (("a", _LETTER), ("1", _NUMBER)):
            at, text = 0, "".join(f"{near}{chr(p)}\n" for p in points)
            ends = {span[1] for _, span in split(text)}
            for p in points:
                if at + 1 not in ends:
                    table[p] = kind
                at += 3
    for p in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):  # Unicode's White_Space
        table[p] = _BLANK
    for chars, kind in ((" ", _SPACE), ("'", _APOSTROPHE), ("stmd", _STMD), ("r", _R), ("v", _V), ("e", _E), ("l", _L)):
        for c in chars:
            table[ord(c)] = kind
    return zlib.compress(table.tobytes())


class Counter:
    """The compiled machines of one vocabulary file."""

    def __init__(self, path: str, classes: bytes | None = None):
        classes = classes or unicode_classes(path)
        spec = json.load(open(path, encoding="utf-8"))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE: bytes that stand for themselves; the others follow from 256
        other = [b for b in range(256) if b not in plain]
        symbol = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.lexicon = Transducer([symbol[b] for b in range(256)], merges)
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.next, self.mark = _machine()

    def _scan(self, maps: np.ndarray) -> np.ndarray:
        """The state before each chunk, by a prefix scan over the chunks' state maps (states x chunks)."""
        step, n = 1, maps.shape[1]
        while step < n:
            maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], axis=0)
            step *= 2
        return np.concatenate((np.array([_START], np.uint8), maps[_START, :-1]))

    def marks(self, classes: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each character.  The last class must be _END."""
        n = -(-len(classes) // CHUNK)
        padded = np.full(n * CHUNK, _END, np.uint8)
        padded[: len(classes)] = classes
        columns = np.ascontiguousarray(padded.reshape(n, CHUNK).T)
        maps = np.repeat(np.arange(_STATES, dtype=np.uint8)[:, None], n, axis=1)
        for column in columns:
            maps = self.next.take(maps * np.uint8(_CLASSES) + column)
        state = self._scan(maps)
        out = np.empty((CHUNK, n), np.uint8)
        for i, column in enumerate(columns):
            at = state * np.uint8(_CLASSES) + column
            out[i] = self.mark.take(at)
            state = self.next.take(at)
        flat = out.T.ravel()[: len(classes)]
        begins = (flat & _HERE) > 0
        begins[:-1] |= (flat[1:] & _BACK) > 0
        return begins

    def _group(self, texts: list[str]) -> np.ndarray:
        """Token counts of texts without special tokens."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
        classes = self.classes.take(points)
        ends = np.cumsum(sizes + 1) - 1
        classes[ends] = _END
        begins = self.marks(classes)
        begins[ends] = True
        first = np.flatnonzero(begins)
        end = np.append(first[1:], len(points))
        real = classes[first] != _END
        first, end = first[real], end[real]
        if not len(first):
            return np.zeros(len(texts), np.int64)
        lone = points >> 11 == 0x1B  # a lone surrogate reads as a question mark
        width = 1 + ((points > 0x7F) & ~lone).astype(np.int64) + ((points > 0x7FF) & ~lone) + (points > 0xFFFF)
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(width)))
        data = np.frombuffer("\0".join(texts).encode("utf-8", "replace"), np.uint8)
        counts = self.lexicon.counts(data, at[first], at[end] - at[first])
        return np.bincount(np.searchsorted(ends, first), counts, len(texts)).astype(np.int64)

    def count(self, texts: list[str | None]) -> list[int]:
        parts, owner, total = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            rest = [t or ""]
            for s in self.special:
                rest = [y for x in rest for y in x.split(s)]
            total[i] = len(rest) - 1
            parts += rest
            owner += [i] * len(rest)
        at = 0
        while at < len(parts):
            stop, chars = at, 0
            while stop < len(parts) and (stop == at or chars + len(parts[stop]) < GROUP_CHARS):
                chars += len(parts[stop]) + 1
                stop += 1
            np.add.at(total, owner[at:stop], self._group(parts[at:stop]))
            at = stop
        return total.tolist()


@lru_cache(maxsize=1)
def counter(path: str, classes: bytes) -> Counter:
    return Counter(path, classes)


def count_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; ``path``: the vocabulary file, at the same place on every machine."""
    classes = unicode_classes(path)

    def find(texts: list[str | None]) -> list:
        counts = counter(path, classes).count(texts)
        return [[len(t.encode("utf-8")) if t else 0 for t in texts], counts, [n > limit for n in counts]]

    return map_texts(docs, text, (doc_id,), find, "n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed(doc_id, "doc_id")
