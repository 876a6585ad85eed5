"""Sequence packing along a Hilbert curve.

Each document's tokens are hashed to vectors, whose mean is projected to a few
dimensions; its place on a Hilbert curve through these is the document's key.
Documents are range-sorted by key and laid end to end, so a sequence holds
neighbours on the curve. Ranges hold about equally many tokens, not rows: their
bounds are quantiles of a sample of tokens. Each range fills whole sequences; what
is left at its end is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stash
from .tokens import byte_symbols

DIMENSIONS, BITS, BUCKETS = 4, 12, 4096
#: Bits of a document's place below its key, from a hash, so that bounds can part documents of one key.
SPREAD = 15
#: Tokens a range is to hold, ranges at most, and tokens sampled a range.
RANGE, RANGES, POINTS = 1 << 21, 100_000, 32
#: The kind of vocabulary whose plain words are split here: NFC, lower case, pieces, byte level.
_LOWER_CASE_PIECES = (("NFC", "Replace", "Lowercase"), ("Split", "ByteLevel"), (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",))
#: Printable ASCII and the letters of Latin-1: their classes, cases and normal forms are the same in all versions of Unicode.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
#: Of plain words in UTF-8, the bytes that are letters' (1), digits (2), and others (0).
_CLASS = np.array([1 if c >= 128 or 97 <= c <= 122 else 2 if 48 <= c <= 57 else 0 for c in range(256)], np.uint8)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of unsigned coordinates below 2**bits.

    The coordinates are turned into the curve's transposed index by undoing, from
    the highest bit down, the exchange or inversion of axes that each level makes
    (Skilling 2004); its bits are then interleaved.
    """
    x = [c.astype(np.int64) for c in points.T]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] if i == 0 else x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ t) >> b) & 1)
    return key


class WordIds:
    """Token ids of white-space-separated words by the library, kept in flat tables.

    A batch is split and its words told apart in Arrow, so that each is looked up
    once. They are parted at ASCII white space only; other white space inside a
    word is the library's to handle. Plain words, of printable ASCII and Latin-1
    letters, are put in lower case and split into pieces by the classes of their bytes, as
    the library would; only the pieces' merges are left to it. Other words, those with a
    special token, and all words of vocabularies of another kind go through it whole.
    Units (pieces, other words) new to a batch are coded in one call on their joined
    text and told apart by the tokens that close a word, else by their words or offsets. Beyond
    `memo` units a batch's new ones are forgotten after it.
    """

    def __init__(self, path: str, memo: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.limit = Tokenizer.from_file(path), memo
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # of symbols of bytes
        for library in (self.library, self.merger):
            library.no_truncation()
            library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known_kind = _kind(path) == _LOWER_CASE_PIECES
        self.symbols = np.array([32 if b == 32 else ord(c) for b, c in enumerate(byte_symbols())], "<u4")
        suffix, vocabulary = getattr(self.library.model, "end_of_word_suffix", None), self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.closes[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.directions = np.random.default_rng(20).choice(np.array([-1, 1], np.float32), (BUCKETS, DIMENSIONS))
        #: Units' rows in the tables, which have room for more: flat ids, where a unit's end, and its summed direction.
        self.at: dict[str, int] = {}
        self.ids, self.ends, self.vector = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros((0, DIMENSIONS), np.float32)

    def coded(self, units: list[str], library) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of the units, how many each has, and each one's summed direction."""
        text = " ".join(units)
        if library is self.merger:  # its words are the units
            if not text.isascii():
                text = self.symbols[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.closes[ids])
            if len(last) == len(units):
                counts = np.diff(last, prepend=-1)
            else:
                counts = np.bincount(np.array(library.encode(text, add_special_tokens=False).word_ids, np.int64), minlength=len(units))
        else:
            got = library.encode(text, add_special_tokens=False)
            ids = np.array(got.ids, np.uint32)
            starts = np.cumsum([0, *(len(u) + 1 for u in units[:-1])])
            offsets = np.fromiter((o for o, _ in got.offsets), np.int64, len(ids))
            counts = np.bincount(np.searchsorted(starts, offsets, "right") - 1, minlength=len(units))
        hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)  # the top 12 bits: BUCKETS
        return ids, counts, _sums(np.take(self.directions, hashed.astype(np.int64), axis=0), np.cumsum(counts))

    def _placed(self, units: pa.Array, known: int, library) -> tuple[np.ndarray, list[str]]:
        """Each unit's row in the tables, and the units that are new, whose rows are put behind the `known`."""
        told = units.dictionary_encode()
        keys = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(places < 0)
        if new := [keys[i] for i in missing.tolist()]:
            ids, counts, vector = self.coded(new, library)
            end = self.ends[known]
            self.ids = _put(self.ids, end, ids)
            self.ends = _put(self.ends, known + 1, end + np.cumsum(counts))
            self.vector = _put(self.vector, known, vector)
            places[missing] = np.arange(known, known + len(new))
        return places[told.indices.to_numpy()], new

    def _plain(self, words: pa.Array) -> pa.Array:
        if not self.known_kind:
            return pa.array(np.zeros(len(words), bool))
        plain = pc.match_substring_regex(words, _PLAIN)
        # most batches have no special token at all
        text = words.buffers()[2].to_pybytes().lower() if words.buffers()[2] else b""
        if any(not t.isascii() or t.lower().encode() in text for t in self.special):
            plain = pc.and_not(plain, pc.match_substring_regex(words, "|".join(map(re.escape, self.special)), ignore_case=True))
        return plain

    def flat(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' ids (null: empty) end to end, where each text's begin (and the last one's end), and the mean vector of each."""
        texts = pc.ascii_split_whitespace(pc.fill_null(batch.cast(pa.large_string()), ""))
        told = texts.flatten().dictionary_encode()
        words = told.dictionary
        plain = self._plain(words)
        is_plain = plain.to_numpy(zero_copy_only=False)
        pieces, many = plain_pieces(pc.utf8_lower(words.filter(plain)))
        known = len(self.at)
        at_plain, new = self._placed(pieces, known, self.merger)
        at_other, new_ = self._placed(words.filter(pc.invert(plain)), known + len(new), self.library)
        if known < self.limit:
            self.at.update(zip(new + new_, range(known, known + len(new) + len(new_))))
        # units of each word, in the words' order
        units = np.ones(len(words), np.int64)
        units[is_plain] = many
        unit = np.empty(units.sum(), np.int64)
        of_plain = np.repeat(is_plain, units)
        unit[of_plain], unit[~of_plain] = at_plain, at_other
        begins = self.ends[unit]
        size = self.ends[unit + 1] - begins
        word_ids = self.ids[_ranges(begins, size)]
        ends = np.cumsum(units)
        upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]
        word_vector = _sums(np.take(self.vector, unit, axis=0), ends)  # much faster than with [unit]
        # words of each text
        flat = told.indices.to_numpy()
        length = np.diff(upto)[flat]
        out = word_ids[_ranges(upto[flat], length)]
        cut = np.cumsum(pc.list_value_length(texts).to_numpy())
        tokens = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], cut])]
        return out, tokens, _sums(np.take(word_vector, flat, axis=0), cut) / np.maximum(np.diff(tokens), 1)[:, None]

    def encode(self, batch: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text (null: empty), and the mean vector of each."""
        out, tokens, means = self.flat(batch)
        return [out[a:b] for a, b in zip(tokens, tokens[1:])], means


def plain_pieces(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of plain words in lower case, none of them empty, and how many each word has.

    Letters go together, digits stand alone, other characters go together. An apostrophe that
    begins its piece takes a following s, t, m, d, re, ve or ll of its word with it.
    """
    if not len(words):
        return words, np.zeros(0, np.int64)
    _, offsets, text = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    text = np.frombuffer(text, np.uint8)[offsets[0] : offsets[-1]]
    offsets, n = offsets - offsets[0], len(text)
    kind = _CLASS[text]
    word = np.zeros(n + 3, bool)  # three more, so what follows an apostrophe can be looked at
    word[offsets] = word[n:] = True
    first = word.copy()
    first[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    at = np.flatnonzero(text == ord("'"))
    at = at[first[at] & ~word[at + 1]]
    one = at[np.isin(text[at + 1], list(b"stmd"))]
    two = at[~word[at + 2]]
    two = two[np.isin(text[two + 1] * np.uint16(256) + text[two + 2], [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])]
    first[one + 1] = first[two + 1] = False
    first[one + 2] = first[two + 3] = True
    starts = np.flatnonzero(first[: n + 1])  # with the end
    pieces = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(text)])
    return pieces, np.diff(np.searchsorted(starts, offsets))


def _put(table: np.ndarray, at: int, rows: np.ndarray) -> np.ndarray:
    """The table, a larger copy where it has no room, with the rows from `at` on."""
    if len(table) < at + len(rows):
        table = np.concatenate([table[:at], np.zeros((at + 2 * len(rows), *table.shape[1:]), table.dtype)])
    table[at : at + len(rows)] = rows
    return table


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, end to end."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _kind(path: str) -> tuple:
    """How a vocabulary's file has texts normalized and split."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [(spec.get(x) or {}) for x in ("normalizer", "pre_tokenizer")]
    first, second = steps[0].get("normalizers", []), steps[1].get("pretokenizers", [])
    return tuple(x["type"] for x in first), tuple(x["type"] for x in second), tuple(x["pattern"].get("Regex") for x in second if "pattern" in x)


def _sums(rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the consecutive runs of rows that stop before each end; the last ends with the rows."""
    out, begins = np.zeros((len(ends), rows.shape[1])), np.concatenate([[0], ends[:-1]])
    some = ends > begins
    if some.any():
        out[some] = np.add.reduceat(rows, begins[some], axis=0, dtype=np.float64)
    return out


_coders: dict[tuple[str, int], WordIds] = {}


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = 2, memo: int = 400_000) -> DataFrame:
    """doc_id, place, n and ids of each row: the n token ids (little-endian unsigned 32-bit, with `end_id`
    last) and the place along the curve, key before a hash of the row's number."""
    bounded_batches(docs.sparkSession, rows=1000, size="8m")

    def run(batches):
        key = (vocabulary, memo)
        if key not in _coders:  # kept by the Python worker for its next tasks
            _coders[key] = WordIds(vocabulary, memo)
        rows = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, tokens, means = _coders[key].flat(batch.column("text"))
            spots = np.clip((means + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            size = np.diff(tokens) + 1
            coded = np.insert(ids, tokens[1:], end_id).astype("<u4", copy=False)
            cuts = np.concatenate([[0], 4 * np.cumsum(size)])
            # equal rows are told apart, too, so the most frequent one is no range by itself
            number = (np.arange(rows, rows + batch.num_rows, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            rows += batch.num_rows
            place = (hilbert_key(spots, BITS) << SPREAD) | (number >> np.uint64(64 - SPREAD)).astype(np.int64)
            if cuts[-1] >= 1 << 31:
                raise ValueError("a batch's ids are 2 GB or more")
            coded = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(coded)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(place), pa.array(size, pa.int64()), coded], ["doc_id", "place", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, place long, n long, ids binary")


def ranged(coded: DataFrame, tokens: int = RANGE) -> DataFrame:
    """`coded` (place, n) dealt to ranges of about `tokens` tokens, and sorted by place within them.

    One token in `tokens` / POINTS is sampled, evenly, so their number, all that the
    driver gets, is POINTS for each of at most RANGES ranges, or a few more.
    """
    total = coded.agg(F.sum("n")).first()[0] or 0
    parts = max(1, min(RANGES, -(-total // tokens)))
    every = max(1, total // (parts * POINTS))
    hits = F.floor((F.col("n") + F.pmod(F.xxhash64("place", "n"), F.lit(every))) / every).cast("long")
    points = coded.select("place", hits.alias("hits")).filter("hits > 0").toArrow()
    places, weights = points["place"].to_numpy(), points["hits"].to_numpy()
    order = np.argsort(places)
    sums = np.cumsum(weights[order])
    bounds = places[order][np.searchsorted(sums, sums[-1] * np.arange(1, parts) / parts)] if len(sums) else np.zeros(0, np.int64)

    @F.arrow_udf("int")
    def part(place: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, place.to_numpy(), "right").astype(np.int32))

    return coded.withColumn("part", part("place")).repartitionById(parts, F.col("part")).drop("part").sortWithinPartitions("place")


def pack(coded: DataFrame, length: int = 4096, tokens: int = RANGE) -> DataFrame:
    """Pieces of documents laid in sequences of `length` tokens along the curve; see `packed`."""

    def run(batches):
        task, made = TaskContext.get().partitionId() << 40, 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows: list[list] = [[] for _ in names]
        open_docs, filled = [], 0

        def put(parts, room):
            """Lay the parts in a sequence of `room` tokens; what doesn't fit is returned."""
            nonlocal made
            offset, rest = 0, []
            for doc, start, ids, total in parts:
                take = min(len(ids), room - offset)
                if take:
                    for column, x in zip(rows, (doc, start, take, zlib.crc32(ids[:take]), total, task + made, offset)):
                        column.append(x)
                    offset += take
                if take < len(ids):
                    rest.append((doc, start + take, ids[take:], total))
            made += 1
            return rest

        def out():
            nonlocal rows
            kinds = [kind_arrow, *[pa.int64()] * 6]
            ready, rows = rows, [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(ready, kinds)], names)

        kind_arrow = pa.int64()
        for batch in batches:
            kind_arrow = batch.schema.field("doc_id").type
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), "<u4")
                open_docs.append((doc, 0, ids, len(ids)))
                filled += len(ids)
                while filled >= length:
                    open_docs = put(open_docs, length)
                    filled -= length
            open_docs = [(d, s, x.copy(), n) for d, s, x, n in open_docs]  # let go of the batch
            yield out()
        while filled:
            room = 1 << (filled.bit_length() - 1)
            open_docs = put(open_docs, room)
            filled -= room
        yield out()

    kind = coded.schema["doc_id"].dataType.simpleString()
    return ranged(coded, tokens).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 2, memo: int = 400_000) -> DataFrame:
    """Pack every whole text; a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A null or empty text is its `end_id` alone. Repeated rows are packed as often
    as they come, a null doc_id stays null, an empty table gives an empty result.
    Ties on the curve are laid in the order of a hash. Other columns are not
    read. Ids are written once to the shared folder, so the sampling for the ranges
    and any retry read them back instead of coding texts again.
    """
    return pack(stash(tokenized(docs, vocabulary, end_id, memo), "tokens"), length)
