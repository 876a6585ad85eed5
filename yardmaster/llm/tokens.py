"""Exact token counts by heap-and-linked-list byte-pair merging.

A piece's bytes form a linked list; a heap holds the rank and place of each
adjacent pair that has a merge. The lowest rank, then the leftmost place, is
popped and merged until none is left. The count is initial symbols minus merges;
no identifiers are given out. White space never lies in a token of the
vocabularies handled here, so counts are kept for white-space-separated words and
for pieces, in tables bounded by `memo` entries a worker.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, texts

#: Printable ASCII and its white space: classes and cases are the same to Python and to the library.
_SIMPLE = re.compile(r"[\t-\r -~]*")
#: White space to str.split or to the vocabulary's \\s but perhaps not to both.
_ODD = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\u2060\ufeff"


def split_words(text: str) -> list[str]:
    """White-space-separated words; one word where the two notions of white space may differ."""
    return [text] if any(c in text for c in _ODD) else text.split()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    at = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [at[b] for b in range(256)]


class BytePairCounter:
    """Counts tokens as a `tokenizers` file of this kind does: NFC, lower case, split, byte-level BPE.

    Simple texts are split here, others by the library's own normalizer and
    pre-tokenizer, whose tables of letters and digits are of its Unicode version.
    """

    def __init__(self, path: str, memo: int = 500_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"normalizers not handled: {kinds}")
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # of simple texts, these are all letters and digits
        self.pieces = re.compile(split.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        count_piece, count_word = self.merge_count, self._word

        class Pieces(dict):
            def __missing__(self, piece):
                n = count_piece(piece)
                if len(self) < memo and len(piece) < 64:
                    self[piece] = n
                return n

        class Words(dict):
            def __missing__(self, word):
                n = count_word(word)
                if len(self) < memo and len(word) < 64:
                    self[word] = n
                return n

        self.piece_counts, self.word_counts = Pieces(), Words()

    def merge_count(self, piece: str) -> int:
        """Tokens of a piece, written in ASCII or in the symbols of its bytes."""
        raw = piece.encode() if piece.isascii() else bytes(map(self.byte_of.__getitem__, piece))
        n, merges = len(raw), self.merges
        if n == 1:
            return 1
        inner = self.inner
        symbol = [inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if m := merges.get((symbol[i], symbol[i + 1])):
                heap.append((m[0], i, m[1]))
        heapify(heap)
        count = n
        while heap:
            _, i, new = heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            m = merges.get((symbol[i], symbol[j]))
            if m is None or m[1] != new:  # the pair that was here is gone
                continue
            symbol[i], symbol[j] = new, -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, symbol[k])):
                    heappush(heap, (m[0], i, m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbol[h], new))):
                heappush(heap, (m[0], h, m[1]))
        return count

    def _plain(self, text: str) -> int:
        pieces = self.pieces.findall(text.lower()) if _SIMPLE.fullmatch(text) else [p for p, _ in self.split(self.normalize(text))]
        return sum(map(self.piece_counts.__getitem__, pieces))

    def _word(self, text: str) -> int:
        if self.special is None or "<|" not in text:
            return self._plain(text)
        return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))

    def count(self, text: str) -> int:
        return sum(map(self.word_counts.__getitem__, split_words(text)))


_counters: dict[tuple[str, int], BytePairCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str, budget: int = 2048, memo: int = 500_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > budget) of every whole text.

    `vocabulary` is a file's path that every executor can open. Null and empty
    texts have 0 bytes and 0 tokens. A row in gives a row out: repeated rows
    repeat, a null doc_id stays null, an empty table gives an empty result. Other
    columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        key = (vocabulary, memo)
        if key not in _counters:  # kept by the Python worker for its next tasks
            _counters[key] = BytePairCounter(vocabulary, memo)
        count = _counters[key].count
        for batch in batches:
            got = texts(batch)
            n = [count(t) for t in got]
            size = [len(t.encode("utf-8")) for t in got]
            columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > budget for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
