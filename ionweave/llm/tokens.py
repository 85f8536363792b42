"""Whole texts to token ids with a public tokenizer file, at the price of a dictionary look-up per word.

The tokenizer splits at white space before anything else and never joins across it, so the ids of a text are
the ids of its space-separated pieces in order, and those of a piece the ids of its parts: runs of letters, digits,
runs of others. A worker encodes the parts that are new to it in bulk with the library and keeps them in two
generations of bounded size. A text that holds the start of a special token, and every piece whose split is not
certain, goes to the library whole.
"""
from __future__ import annotations

from collections.abc import Iterable
from itertools import pairwise
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts in a generation; two generations bound the memory of a worker to about 150 MB.
GENERATION = 300_000
#: Characters whose parts are looked up at once.
BATCH_CHARS = 1_000_000
#: Words handed to the library in one string.
JOINED = 64

#: Kinds of bytes: space, letters, digits, others. A part is a run of one kind, or a digit.
_KIND = np.full(256, 3, np.uint8)
_KIND[32], _KIND[48:58], _KIND[97:123], _KIND[128:] = 0, 2, 1, 1


def unsplit(first: np.ndarray, u: np.ndarray, at: np.ndarray) -> None:
    """Makes one part of every piece of ``u`` that holds a position of ``at``; ``first``: whether a byte begins a part."""
    spaces = np.concatenate([[-1], np.flatnonzero(u == 32), [len(u)]])
    k = np.unique(np.searchsorted(spaces, at))
    inner = np.zeros(len(u) + 1, np.int8)
    inner[spaces[k - 1] + 2] += 1
    inner[spaces[k]] -= 1
    first &= np.cumsum(inner[:-1], dtype=np.int8) <= 0


class WordIds:
    """Encodes texts of one tokenizer file; ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        #: The same model behind a split at spaces: for letters that the normalizer would leave as they are.
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Splitting is exact where the file lowers, splits at white space and marks word ends.
        self.exact = ("Lowercase()" in str(self.tok.normalizer) and r"[^\s\p{L}\p{N}]+" in str(self.tok.pre_tokenizer)
                      and "</w>" in str(self.tok.model))
        self.bytewise = "ByteLevel(" in str(self.tok.pre_tokenizer) and "use_regex=False" in str(self.tok.pre_tokenizer)
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.odd: dict[bytes, bytes] = {}

    def by_library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_words(self, words: list[bytes]) -> None:
        """Adds words of letters only: many in one string, cut again at the ids that end a word."""
        texts = [w.decode() for w in words]
        easy = [u.isascii() or max(u) < "\u0100" for u in texts] if self.bytewise else [False] * len(texts)   # lower case is one letter, and composed
        for tok, of in ((self.plain, True), (self.tok, False)):
            own = [w for w, e in zip(words, easy, strict=True) if e == of]
            as_text = [u.lower() if of else u for u, e in zip(texts, easy, strict=True) if e == of]
            joined = [" ".join(as_text[i:i + JOINED]) for i in range(0, len(own), JOINED)]
            for k, e in enumerate(tok.encode_batch_fast(joined, add_special_tokens=False)):
                g = own[k * JOINED:(k + 1) * JOINED]
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(g) or (len(cuts) and cuts[-1] != len(ids)):
                    for w in g:
                        self.young[w] = self.by_library(w.decode())
                    continue
                raw, at = ids.tobytes(), 0
                for w, c in zip(g, (4 * cuts).tolist(), strict=True):
                    self.young[w] = raw[at:c]
                    at = c

    def add(self, parts: list[bytes]) -> list[int]:
        """Makes the parts known to the young generation; returns the numbers of those whose split is not certain."""
        young, old, words, unsure = self.young, self.old, [], []
        for k, q in enumerate(parts):
            if q in old:
                young[q] = old[q]
            elif q.isalpha():
                words.append(q)
            elif q[0] == 32:
                young[q] = b""
            elif b"'" in q or q.isascii():
                young[q] = self.by_library(q.decode("utf-8", "replace"))
            elif _KIND[np.frombuffer(q, np.uint8)].max() > 1:       # a piece that is one part
                young[q] = self.by_library(q.decode("utf-8", "replace"))
            elif (t := q.decode("utf-8", "replace")).isalpha() and normalize("NFC", t).lower().isalpha():      # a mark may come of a letter
                words.append(q)
            else:
                unsure.append(k)
        self.of_words(words)
        return unsure

    def of_batch(self, texts: list[str | None]) -> list[bytes]:
        """Parts are found by numpy and numbered by Arrow, so the dictionaries are asked once for each distinct part."""
        raws = [(t or "").encode("utf-8", "replace") for t in texts]
        whole = {i: self.by_library(texts[i] or "") for i, r in enumerate(raws) if not self.exact or b"<|" in r}
        buffer = b" ".join([b"" if i in whole else r for i, r in enumerate(raws)]).lower().replace(b"\n", b" ")
        begins = np.cumsum([0] + [1 + (0 if i in whole else len(r)) for i, r in enumerate(raws)])
        u = np.frombuffer(buffer, np.uint8)
        kind = _KIND[u]
        first = np.ones(len(u), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        if len(marks := np.flatnonzero(u == 39)):
            unsplit(first, u, marks)
        for again in (True, False):
            starts = np.append(np.flatnonzero(first), len(u))
            parts = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(buffer)]).dictionary_encode()
            distinct = self.listed(parts.dictionary)
            ids = list(map(self.young.get, distinct))
            new = [k for k, x in enumerate(ids) if x is None]
            unsure = [new[k] for k in self.add([distinct[k] for k in new])] if new else []
            if not again or not unsure:
                break
            unsplit(first, u, starts[:-1][np.isin(parts.indices.to_numpy(), unsure)])
        for k in new:
            ids[k] = self.young[distinct[k]] if distinct[k] in self.young else self.of_piece(distinct[k])
        joined = pa.array(ids, pa.large_binary()).take(parts.indices)
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, "<i8", len(joined) + 1) if len(joined) else np.zeros(1, np.int64)
        ends = ends[np.searchsorted(starts, np.minimum(begins, len(u)))].tolist()
        data = memoryview(data or b"")
        return [whole[i] if i in whole else bytes(data[ends[i]:ends[i + 1]]) for i in range(len(texts))]

    def of_piece(self, piece: bytes) -> bytes:
        """The ids of a whole piece that looks like a part, so the generations, which answer for parts, cannot hold it."""
        if len(self.odd) > GENERATION // 4:
            self.odd.clear()
        if piece not in self.odd:
            self.odd[piece] = self.by_library(piece.decode("utf-8", "replace"))
        return self.odd[piece]

    @staticmethod
    def listed(values: pa.LargeBinaryArray) -> list[bytes]:
        """``to_pylist`` without an object a value."""
        if not len(values):
            return []
        _, offsets, data = values.buffers()
        at, raw = np.frombuffer(offsets, "<i8", len(values) + 1).tolist(), data.to_pybytes() if data else b""
        return [raw[a:b] for a, b in pairwise(at)]

    def of(self, texts: Iterable[str | None]) -> Iterable[bytes]:
        """The ids of each text in order; null counts as empty."""
        batch, size = [], 0
        for t in texts:
            batch.append(t)
            size += len(t or "")
            if size >= BATCH_CHARS:
                yield from self.of_batch(batch)
                batch, size = [], 0
        if batch:
            yield from self.of_batch(batch)


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The encoder of a file in this process; a Python worker keeps it from task to task."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
