"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A sequence costs its tokens (linear layers) and, for each piece in it, the square
of the piece's tokens (attention stays within a document). Pieces in descending
order go to the sequence of least cost that still has room; what fits nowhere is
cut, as documents may be cut freely.

Every task packs the documents of its own partition as they stream by, a window
of tokens at a time: nothing is shuffled, a task holds one window, and a window
has hundreds of sequences to balance. What a window leaves over goes into the
next one; what a partition leaves over is less than a sequence and is cut at
powers of two, so that nothing is padded at all.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, ship, table

LENGTH = 2048
END_ID = 1
#: Tokens of a window, about: 512 sequences.
WINDOW_IDS = 1 << 20
#: Attention's cost of a squared token, in costs of a token: 1 / (6 x width), for a width of 1,024.
QUADRATIC = 1 / 6144
#: Words of one generation of a worker's memory; the last generation is kept beside the new one.
CACHED_WORDS = 600_000
#: Characters of texts whose unknown words are encoded together, about; words encoded as one text.
TOGETHER, JOINED = 1 << 22, 64
#: Sequences of an output batch.
BATCH = 256

#: Words and white space as a byte-level tokenizer takes them apart: a blank belongs to the word after it.
_UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space on which libraries differ.
_ODD = re.compile(r"[^\S \n\t\r]")
#: Marks after a word that make one token run and start no contraction.
_MARKS = '.,;:!?)]}"#$%&*+-/<=>@^_|~\u2026\u201d\u00bb'
#: Begins the name of a part of a text that has no blank before it.
_BARE = "\0"


def alphabet() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def laid_out(found: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words given as codes into `found`, their ids as bytes; and how many ids lie before each word, and in all."""
    ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
    own = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(own)])
    places = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], own)
    places += np.arange(ends[-1])
    return ids[places], ends


def _merger(tokenizer, spec: dict):
    """An encoder of words by the same merges, if it must give the tokenizer's ids; else None.

    It merges the neighbours that together are the token of least id, the tokenizer those that are the first
    in its list of pairs. If ids follow the list, and the tokenizer makes every token of the vocabulary from its own
    letters, both do the same: neighbours that make up a token, all earlier merges being done,
    are then the pair that the list has for it.
    """
    import tiktoken

    vocab, merges, special = spec["model"]["vocab"], spec["model"]["merges"], {x["content"] for x in spec.get("added_tokens", [])}
    order = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
    own = {t: i for t, i in vocab.items() if t not in special}
    if order != sorted(set(order)) or any([x.value for x in tokenizer.model.tokenize(t)] != [t] for t in own):
        return None
    letters = alphabet()
    ranks = {bytes(letters[c] for c in t): i for t, i in own.items()}
    return tiktoken.Encoding("words", pat_str=r" \S+|\n|\S+", mergeable_ranks=ranks, special_tokens={})


class ByteEncoder:
    """Texts -> ids as little-endian bytes; equal to encoding the whole texts with the tokenizer.

    A byte-level tokenizer parts a text at single blanks, and the blank
    is the first byte of what follows: these parts are encoded apart and
    remembered. Unknown ones are encoded as one text and parted where ids
    begin with a blank; those of letters alone, which are single words to the tokenizer, by `_merger`. Texts with special tokens, and
    all texts of any other tokenizer, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.by_word = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True
        self.newline = self.tokenizer.token_to_id("Ċ")
        self.merger = _merger(self.tokenizer, spec) if self.by_word else None
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, text: str) -> list[str] | None:
        """The parts of a text that isn't plain; None if it must be encoded whole."""
        if not self._by_part(text) or _ODD.search(text):
            return None
        return [u[1:] if u[0] == " " and not u.isspace() else _BARE + u for u in _UNITS.findall(text)]

    def _by_part(self, text: str) -> bool:
        return bool(self.by_word) and _BARE not in text and not any(x in text for x in self.special)

    def _merged(self, texts: list[str]) -> list[np.ndarray]:
        return [self.merger.encode_to_numpy(t, disallowed_special=()) for t in texts]

    def _together(self, words: list[str], ids_of, bare: bool = False) -> list[str]:
        """Learn words that are encoded as one text and parted, at blanks or line ends; returns those of texts that didn't part as expected."""
        groups, failed = [words[low : low + JOINED] for low in range(0, len(words), JOINED)], []
        texts = ["\n".join(w[1:] for w in g) if bare else " " + " ".join(g) for g in groups]
        for some, ids in zip(groups, ids_of(texts), strict=True):
            starts = np.flatnonzero(ids == self.newline) + 1 if bare else np.flatnonzero(self.spaced[ids])
            if bare:
                starts = np.concatenate([[0], starts])
            if len(starts) == len(some) and starts[0] == 0:
                raw, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids) + 4 * bare]
                self.known.update(zip(some, [raw[i : k - 4 * bare] for i, k in zip(cuts, cuts[1:], strict=False)], strict=True))
            else:
                failed += some
        return failed

    def _made_of(self, part: str) -> list[str] | None:
        """The parts that one of letters, marks after them and single line ends is made of: tokens end between them. None for other parts."""
        lead = part[:1] if part[:1] == _BARE else ""
        out: list[str] = []
        for line in part[len(lead) :].split("\n"):
            core = line.rstrip(_MARKS)
            if not core.isalpha():
                return None
            out += [lead + core] if not out else [_BARE + "\n", _BARE + core]
            if core != line:
                out.append(_BARE + line[len(core) :])
        return out if len(out) > 1 else None

    def _learn(self, missing: Iterable[str]) -> None:
        """Encode distinct parts that aren't known."""
        known, before = self.known, self.before
        fresh, made = set(), []
        for w in missing:
            if w.isalpha() or (of := self._made_of(w)) is None:
                fresh.add(w)
            else:
                made.append((w, of))
        for x in {x for _, of in made for x in of}.difference(known):
            if x in before:
                known[x] = before[x]
            else:
                fresh.add(x)
        letters, bare, words, alone = [], [], [], []
        for w in fresh:
            if w.isalpha():
                letters.append(w)
            elif w[:1] in _BARE or w[0].isspace():
                (bare if self.newline is not None and w[1:].isalpha() and w[0] == _BARE else alone).append(w)
            else:
                words.append(w)
        merged = self._merged if self.merger else self._ids
        alone += self._together(words, self._ids) + self._together(letters, merged) + self._together(bare, merged, bare=True)
        whole = [w[1:] if w[:1] == _BARE else " " + w for w in alone]
        known.update((w, x.tobytes()) for w, x in zip(alone, self._ids(whole), strict=True))
        known.update((w, b"".join(map(known.__getitem__, of))) for w, of in made)

    def _found(self, names: list[str]) -> list[bytes]:
        """The ids of parts, those that aren't known being learned."""
        if len(self.known) >= CACHED_WORDS:
            self.known, self.before = {}, self.known
        found = list(map(self.known.get, names))
        if missing := [i for i, x in enumerate(found) if x is None]:
            new = [names[i] for i in missing]
            again = list(map(self.before.get, new))
            self.known.update((w, x) for w, x in zip(new, again, strict=True) if x is not None)
            self._learn({w for w, x in zip(new, again, strict=True) if x is None})
            for i, x in zip(missing, map(self.known.__getitem__, new), strict=True):
                found[i] = x
        return found

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts with single blanks only. Each distinct part of a window is looked up once."""
        raw = [f"{_BARE}{t} ".encode() for t in texts]
        stops, data = np.cumsum([len(x) for x in raw]), b"".join(raw)
        parts, counts, n, low = [], [np.zeros(0, np.int64)], 0, 0
        while low < len(data):
            last = low + 2 * TOGETHER
            high = 1 + (data.rfind(b" ", low, last) if last < len(data) else len(data) - 1)
            high = high or 1 + data.index(b" ", low)
            window = np.frombuffer(data, np.uint8)[low:high]
            blank = window == 32
            ends = np.flatnonzero(blank)
            offsets = np.concatenate([[0], ends - np.arange(len(ends))])
            words = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(window[~blank])).dictionary_encode()
            ids, before = laid_out(self._found(words.dictionary.to_numpy(zero_copy_only=False).tolist()), words.indices.to_numpy())
            cuts = stops[np.searchsorted(stops, low, "right") : np.searchsorted(stops, high, "right")] - low
            parts.append(ids.tobytes())
            counts.append(4 * (n + before[np.searchsorted(ends, cuts)]))
            n, low = n + len(ids), high
        own, at = b"".join(parts), 0
        for stop in np.concatenate(counts).tolist():
            yield own[at:stop]
            at = stop

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        low = 0
        while low < len(texts):
            high, size = low + 1, len(texts[low])
            while high < len(texts) and size + len(texts[high]) <= TOGETHER:
                size += len(texts[high])
                high += 1
            some, low = texts[low:high], high
            plain = ["  " not in t and self._by_part(t) for t in some]
            parted = self._plain([t for t, p in zip(some, plain, strict=True) if p])
            for text, p in zip(some, plain, strict=True):
                if p:
                    yield next(parted)
                else:
                    units = self._units(text)
                    yield self._ids([text])[0].tobytes() if units is None else b"".join(self._found(units))


_encoders: dict[str, ByteEncoder] = {}


def _encoder(path: str) -> ByteEncoder:
    hold("packing", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


# ---- one window ----------------------------------------------------------------------------------

#: A piece: doc_id, tokens of its document before it and in all, its ids as bytes.
Piece = tuple[int | None, int, int, bytes]


def cost(n, quadratic: float = QUADRATIC):
    """Estimated cost of a piece of n tokens."""
    return n + quadratic * n * n


def _cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, whole, ids = piece
    return (doc, start, whole, ids[: 4 * n]), (doc, start + n, whole, ids[4 * n :])


def balance(pieces: list[Piece], count: int, length: int = LENGTH, quadratic: float = QUADRATIC) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill `count` sequences of `length` tokens; returns them and the pieces left over.

    Pieces of at most `length` tokens, descending (ties by their order), go to the sequence of least cost
    with room for all of them. Those that fit nowhere, descending again, are cut:
    the sequence of least cost with any room takes what it can. If there are enough tokens, all sequences are full.
    """
    filled: list[list[Piece]] = [[] for _ in range(count)]
    costs, free = np.zeros(count), np.full(count, length)
    rest = []
    for p in sorted(pieces, key=lambda p: -len(p[3])):
        n = len(p[3]) // 4
        room = np.flatnonzero(free >= n)
        if not len(room):
            rest.append(p)
            continue
        at = room[costs[room].argmin()]
        filled[at].append(p)
        free[at] -= n
        costs[at] += cost(n, quadratic)
    queue = [(costs[i], int(i)) for i in np.flatnonzero(free)]
    heapq.heapify(queue)
    left = []
    for p in rest:
        while queue and len(p[3]):
            paid, at = heapq.heappop(queue)
            here, p = _cut(p, min(int(free[at]), len(p[3]) // 4))
            n = len(here[3]) // 4
            filled[at].append(here)
            free[at] -= n
            if free[at]:
                heapq.heappush(queue, (paid + cost(n, quadratic), at))
        if len(p[3]):
            left.append(p)
    return filled, left


def in_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences whose lengths are the powers of two that add up to the pieces' tokens, largest first."""
    out, total = [], sum(len(p[3]) for p in pieces) // 4
    pieces = list(pieces)
    for k in reversed(range(total.bit_length())):
        if total >> k & 1:
            own, free = [], 1 << k
            while free:
                here, rest = _cut(pieces[0], min(free, len(pieces[0][3]) // 4))
                pieces[:1] = [rest] if len(rest[3]) else []
                own.append(here)
                free -= len(here[3]) // 4
            out.append(own)
    return out


# ---- the operator --------------------------------------------------------------------------------

SEQUENCES = (
    "sequence_id long, n_tokens long, n_padded long, cost double, ids binary, "
    "doc_id array<long>, start array<long>, length array<long>, doc_tokens array<long>, offset array<long>"
)
_ARROW = pa.schema(
    [("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("n_padded", pa.int64()), ("cost", pa.float64()), ("ids", pa.binary())]
    + [(n, pa.list_(pa.int64())) for n in ("doc_id", "start", "length", "doc_tokens", "offset")]
)


def padded(n: int, length: int = LENGTH) -> int:
    """Tokens of a sequence of n once padded: as it is at a power of two, else `length`."""
    return n if n & (n - 1) == 0 else length


def _packer(path: str, end_id: int, length: int, quadratic: float, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        pieces: list[Piece] = []
        held, rows = 0, []

        def row(own: list[Piece]) -> tuple:
            nonlocal number
            sizes = [len(p[3]) // 4 for p in own]
            n = sum(sizes)
            offsets = np.cumsum([0, *sizes[:-1]]).tolist()
            out = (number, n, padded(n, length), float(sum(cost(x, quadratic) for x in sizes)), b"".join(p[3] for p in own), [p[0] for p in own], [p[1] for p in own], sizes, [p[2] for p in own], offsets)
            number += 1
            return out

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            rows.clear()
            return out

        def flush() -> None:
            nonlocal pieces, held
            filled, pieces = balance(pieces, held // length, length, quadratic)
            rows.extend(map(row, filled))
            held %= length

        for b in batches:
            docs, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for doc, ids in zip(docs, encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                whole = n - n % length
                for start in range(0, whole, length):  # a document's full sequences are full as they are
                    rows.append(row([(doc, start, n, ids[4 * start : 4 * (start + length)])]))
                    if len(rows) >= BATCH:
                        yield batch()
                if whole < n:
                    pieces.append((doc, whole, n, ids[4 * whole :]))
                    held += n - whole
                if held >= window:
                    flush()
                if len(rows) >= BATCH:
                    yield batch()
        flush()
        rows.extend(map(row, in_powers(pieces)))
        if rows:
            yield batch()

    return run


def sequences(
    docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH, quadratic: float = QUADRATIC, window: int = WINDOW_IDS
) -> DataFrame:
    """Sequences of at most `length` tokens, a power of two, that hold every token of every document once.

    A row is a sequence: sequence_id, n_tokens, n_padded (n_tokens at a power of
    two, else `length`; here they are always equal), its estimated cost, its ids
    (little-endian unsigned 32-bit), and its pieces in order as parallel arrays:
    doc_id, start (ids of the document before it), length, doc_tokens (with the
    end id) and offset in the sequence.

    Null texts are empty: their end id alone. Null doc_ids stay null; repeated
    rows and ids are documents each; of pieces of one length the first in the partition
    goes first. A very long text is cut into full sequences; its ids are in memory once. Empty tables give no rows, other columns are
    ignored. sequence_ids are unique and depend on how the input is
    partitioned, as the windows do: the same files and settings give the same rows.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_packer(path, end_id, length, quadratic, window), SEQUENCES)


def pieces(packed: DataFrame) -> DataFrame:
    """The pieces of sequences, a row each: sequence_id, doc_id, start, length, doc_tokens, offset, ids."""
    names = ("doc_id", "start", "length", "doc_tokens", "offset")
    each = packed.select("sequence_id", F.col("ids").alias("all"), F.explode(F.arrays_zip(*names)).alias("p")).select("sequence_id", "all", "p.*")
    ids = F.expr("substring(all, CAST(4 * offset + 1 AS int), CAST(4 * length AS int))")
    return each.withColumn("ids", ids).drop("all")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents; ids_crc32 is of each piece's ids as they stand in their sequence."""
    packed = pieces(sequences(table(spark, sf_dir, "documents"), tokenizer_path()))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
