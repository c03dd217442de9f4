"""Token-ID output in compressed byte or bit planes.

The format: a folder of Parquet files, so that Spark's commit protocol keeps a
lost executor's half-written files out and any shared store will do.

* `blocks`: a row per block of ids: shard, chunk, first, n_ids, data (the planes,
  each compressed with zstandard, after a header with their sizes) and which
  documents lie where in it. A shard is a range of doc_ids, in order.
* `index`: the chunk index, a row per block: shard, chunk, start (ids of all
  blocks before it), n_ids, n_bytes and n_docs. `ids_between` reads by it.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column_udf, hold, map_pandas, scratch, stored, table
from .packing import alphabet, laid_out

#: Ids of a block; the last block of a shard is shorter.
BLOCK_IDS = 32_768
END_ID = 2
#: Words of one generation of a worker's memory; the last generation is kept beside the new one.
CACHED_WORDS = 300_000
#: Bytes of texts that are taken apart together, about.
TOGETHER = 1 << 20
#: The white space that parts words.
BLANKS = b" ", b"\n", b"\t", b"\r"
#: Words of a text that is parted again at the word ends; plain words of one.
PARTED, PARTED_PLAIN = 1_000, 4_000
#: Runs of these are words of their own to a tokenizer that splits off letters (an apostrophe may start one).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MAGIC = b"IDP1"

#: Letters that stay letters when composed and in lower case, so that a mark after one is a run of its own.
PLAIN = "A-Za-z0-9\u00C0-\u012F\u0131-\u024F\u0386-\u03CE\u0400-\u0481\u048A-\u052F"
#: Kinds of bytes.
LETTER, BLANK, MARK = range(3)
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"".join(BLANKS))] = BLANK
_KIND[list(MARKS.encode())] = MARK


def _table(pattern: str, size: int) -> np.ndarray:
    """Which characters below `size` a pattern matches; the last entry, at -1, is False."""
    out = np.zeros(0x10001, bool)
    out[[m.start() for m in re.finditer(pattern, "".join(map(chr, range(size))))]] = True
    return out


#: White space to Python and the tokenizer.
_SPACE = r"(?![\x1C-\x1F])\s"
#: What a run of marks that is alone may follow, plain letters and white space (of two bytes at most), and what may follow it: no other symbol.
_STANDS_AFTER, _STANDS_BEFORE = _table(rf"(?=\w)[{PLAIN}]|[{re.escape(MARKS)}]|{_SPACE}", 0x800), _table(rf"\w|[{re.escape(MARKS)}]|{_SPACE}", 0x10000)

# ---- one block -----------------------------------------------------------------------------------


def encode_block(ids: np.ndarray, plane: str = "byte", level: int = 3) -> bytes:
    """A block of ids as planes: magic, plane kind, count, sizes of the compressed planes, the planes.

    The ids' little-endian 32 bits are transposed: plane p holds byte (or bit) p
    of every id, so the mostly-zero high planes shrink to nothing.
    """
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        planes = [raw[:, i].tobytes() for i in range(4)]
    elif plane == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]
    else:
        raise ValueError("plane must be byte or bit")
    squeeze = zstandard.ZstdCompressor(level=level).compress
    packed = [squeeze(p) for p in planes]
    head = struct.pack("<4sBI", MAGIC, len(planes), len(ids)) + struct.pack(f"<{len(packed)}I", *map(len, packed))
    return head + b"".join(packed)


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block, exactly."""
    magic, count, n = struct.unpack_from("<4sBI", data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = 9 + 4 * count
    open_ = zstandard.ZstdDecompressor().decompress
    planes = []
    for size in struct.unpack_from(f"<{count}I", data, 9):
        planes.append(np.frombuffer(open_(data[at : at + size]), np.uint8))
        at += size
    if count == 4:
        raw = np.stack(planes, axis=1)
    else:
        raw = np.packbits(np.stack([np.unpackbits(p, count=n, bitorder="little") for p in planes], axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)[:n]


def crc32_join(first: int, second: int, length: int) -> int:
    """crc32 of a+b from those of a and of b, whose length is given."""
    poly = 0xEDB88320

    def times(a: int, b: int) -> int:  # polynomials modulo poly, highest power in the lowest bit
        out = 0
        while b:
            if b & 0x80000000:
                out ^= a
            b = (b << 1) & 0xFFFFFFFF
            a = (a >> 1) ^ (poly if a & 1 else 0)
        return out

    power, step, n = 0x80000000, 0x40000000, length * 8
    while n:
        if n & 1:
            power = times(power, step)
        step, n = times(step, step), n >> 1
    return times(power, first) ^ second


# ---- encoding ------------------------------------------------------------------------------------

def _word_ends(tokenizer) -> np.ndarray | None:
    """Which ids end a word, if the tokenizer drops white space and marks the ends of words; else None."""
    spec = json.loads(tokenizer.to_str())
    suffix, before = spec["model"].get("end_of_word_suffix"), spec.get("pre_tokenizer") or {}
    splits = [x for x in before.get("pretokenizers", [before]) if x.get("type") == "Split"]
    if not suffix or not any(x["behavior"] == "Removed" and x["invert"] for x in splits):
        return None
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
    return ends


def _crowded(data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether the runs of the marks at these places of UTF-8 text don't stand alone, or it would take longer to tell."""
    last, lead = data[marks - 1].astype(np.int32), data[marks - 2].astype(np.int32)  # a place below 0 is the blank at the end
    two = (lead & 0x1F) << 6 | last & 0x3F
    before = np.where(last < 0x80, last, np.where((lead >> 5 == 6) & (marks > 1), two, -1))
    lead, mid, last = (data[np.minimum(marks + i, len(data) - 1)].astype(np.int32) for i in (1, 2, 3))
    two, three = (lead & 0x1F) << 6 | mid & 0x3F, (lead & 0xF) << 12 | (mid & 0x3F) << 6 | last & 0x3F
    after = np.where(lead < 0x80, lead, np.where(lead >> 5 == 6, two, np.where(lead >> 4 == 14, three, -1)))
    return ~_STANDS_AFTER[before] | ~_STANDS_BEFORE[after]


def _words(data: np.ndarray, apart: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of UTF-8 text that ends with a blank: where each starts, offsets (one more than words) and the letters of all.

    Words stand between blanks; with `apart`, where all runs of marks of such a word stand alone, each of them and what lies between are words too.
    """
    kind = _KIND[data]
    marks = np.flatnonzero(kind == MARK)
    if not apart:
        kind[marks] = LETTER
    elif len(crowded := marks[_crowded(data, marks)]):
        blanks = np.flatnonzero(kind == BLANK)
        whole = np.zeros(len(blanks), bool)
        whole[np.searchsorted(blanks, crowded)] = True
        kind[marks[whole[np.searchsorted(blanks, marks)]]] = LETTER
    solid, change = kind != BLANK, kind[1:] != kind[:-1]
    first, last = solid.copy(), solid.copy()
    first[1:] &= change
    last[:-1] &= change
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    return starts, np.concatenate([[0], np.cumsum(sizes)]), data[solid]


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case but before a character beyond ASCII, which may join with the letter."""
    upper = data - np.uint8(65) < 26
    upper[:-1] &= data[1:] < 0x80
    return data | upper.view(np.uint8) << np.uint8(5)


def _windows(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of a text that ends with a blank, cut behind blanks, of TOGETHER bytes or of one longer word."""
    low = 0
    while low < len(data):
        high = low + TOGETHER
        if high >= len(data):
            high = len(data)
        elif cut := 1 + max(data.rfind(b, low, high) for b in BLANKS):
            high = cut
        else:
            high = 1 + min(x for b in BLANKS if (x := data.find(b, high)) >= 0)
        yield low, high
        low = high


def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


#: Words of Latin letters that are composed already and have one lower-case letter each.
_LATIN = re.compile("[A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+").fullmatch
#: What the tokenizer does with words before it merges letters: for Latin words in lower case, nothing but to write their bytes as letters.
_STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPELLED = {b: letter for letter, b in alphabet().items() if b >= 0x80}


def _plain(tokenizer):
    """The same tokenizer without its steps before merging, for lower-case words of Latin letters as `_spelled` writes them; None if it has other steps."""
    spec = json.loads(tokenizer.to_str())
    steps = [x for k, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for x in (spec.get(k) or {}).get(many, [])]
    if [x["type"] for x in steps] != _STEPS or any(x["content"].isalpha() for x in spec["added_tokens"]):
        return None
    _, blanks, _, split, spelling = steps
    if (blanks["pattern"], blanks["content"], split["pattern"]) != ({"Regex": r"\s+"}, " ", {"Regex": _SPLIT}) or spelling["use_regex"] or spelling["add_prefix_space"]:
        return None
    spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}
    return type(tokenizer).from_str(json.dumps(spec))


def _spelled(text: str) -> str:
    return text if text.isascii() else text.encode().decode("latin-1").translate(_SPELLED)


def _letter_ids(tokenizer, ends: np.ndarray, words: list[str], plain=None) -> Iterator[tuple[str, bytes]]:
    """The ids of words of letters alone, as bytes; `plain` takes lower-case Latin ones.

    They are encoded as one text and parted at the word ends: each gives one at
    least, so equal counts mean one for each. If a word was taken apart, those
    encoded along with it are encoded one by one.
    """
    step = PARTED_PLAIN if plain else PARTED
    for low in range(0, len(words), step):
        some = words[low : low + step]
        text = " ".join(some)
        ids = _ids(plain, [_spelled(text)])[0] if plain else _ids(tokenizer, [text])[0]
        stops = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(stops) == len(some):
            raw = ids.tobytes()
            yield from ((w, raw[i:k]) for w, i, k in zip(some, [0, *stops], stops, strict=False))
        else:
            yield from ((w, x.tobytes()) for w, x in zip(some, _ids(tokenizer, some), strict=True))


def _all_letters(word: str) -> bool:
    """Whether a word is of letters alone, once composed and in lower case too."""
    return word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha()


class _Encoder:
    """Texts -> ids as little-endian bytes; equal to encoding the whole texts.

    A tokenizer that drops white space never joins characters over it: words
    between plain blanks are then encoded apart and remembered, for two
    generations of CACHED_WORDS words at most. With any other tokenizer whole
    texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = _word_ends(self.tokenizer)
        self.plain = _plain(self.tokenizer)
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _learn(self, missing: list[str]) -> None:
        """Encode distinct words that aren't known."""
        lower, latin, letters, others, cased = [], [], [], [], []
        for w in missing:
            if self.plain and _LATIN(w):
                (cased if not w.islower() else lower if w.isascii() else latin).append(w)
            else:
                (letters if _all_letters(w) else others).append(w)
        for some in lower, latin:
            self.known.update(_letter_ids(self.tokenizer, self.ends, some, self.plain))
        self.known.update(_letter_ids(self.tokenizer, self.ends, letters))
        self.known.update((w, x.tobytes()) for w, x in zip(others, _ids(self.tokenizer, others), strict=True))
        as_lower = [w.lower() for w in cased]
        self.known.update(_letter_ids(self.tokenizer, self.ends, list(set(as_lower).difference(self.known)), self.plain))
        self.known.update(zip(cased, [self.known[w] for w in as_lower], strict=True))

    def _window(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 text that ends with a blank, and how many of them lie before each place of `cuts`."""
        bare = not any(x in data.tobytes().lower() for x in self.special)  # special tokens are taken as they stand in a text
        starts, offsets, letters = _words(_lowered(data) if bare and self.plain else data, bare)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
        names, codes = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        if len(self.known) >= CACHED_WORDS:
            self.known, self.before = {}, self.known
        found = list(map(self.known.get, names))
        if missing := [i for i, x in enumerate(found) if x is None]:
            new = [names[i] for i in missing]
            again = list(map(self.before.get, new))
            self.known.update((w, x) for w, x in zip(new, again, strict=True) if x is not None)
            self._learn([w for w, x in zip(new, again, strict=True) if x is None])
            for i, w in zip(missing, map(self.known.__getitem__, new), strict=True):
                found[i] = w
        ids, ends = laid_out(found, codes)
        return ids, ends[np.searchsorted(starts, cuts)]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        low = 0
        while low < len(texts):
            high, size = low + 1, len(texts[low])
            while high < len(texts) and size + len(texts[high]) <= TOGETHER:
                size += len(texts[high])
                high += 1
            some, low = texts[low:high], high
            if self.ends is None:
                yield from (x.tobytes() for x in _ids(self.tokenizer, some))
                continue
            raw = [t.encode() + b"\n" for t in some]
            stops, data = np.cumsum([len(x) for x in raw]), b"".join(raw)
            parts, counts, n = [], [], 0
            for first, last in _windows(data):
                cuts = stops[np.searchsorted(stops, first, "right") : np.searchsorted(stops, last, "right")] - first
                ids, before = self._window(np.frombuffer(data, np.uint8)[first:last], cuts)
                parts.append(ids.tobytes())
                counts.append(4 * (n + before))
                n += len(ids)
            own, at = b"".join(parts), 0
            for stop in np.concatenate(counts).tolist():
                yield own[at:stop]
                at = stop


_known: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    hold("tokens", _known.clear)
    if path not in _known:
        _known[path] = _Encoder(path)
    return _known[path]


BLOCKS = (
    "shard int, chunk int, first long, n_ids long, data binary, "
    "doc_seq array<long>, doc_id array<long>, doc_first array<long>, doc_n array<long>"
)


def _blocks(path: str, end_id: int, plane: str, block_ids: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        shard = TaskContext.get().partitionId()
        buffer, pieces, chunk, first, seq = bytearray(), [], 0, 0, -1
        width = 4 * block_ids

        def take(n: int):
            nonlocal pieces, chunk, first
            data, ids = bytes(buffer[:n]), n // 4
            del buffer[:n]
            now, later = [], []
            for s, d, at, size in pieces:  # a document may go on in the next block
                here = min(size, first + ids - at)
                if here > 0:
                    now.append((s, d, at, here))
                if here < size:
                    later.append((s, d, at + max(here, 0), size - max(here, 0)))
            row = (shard, chunk, first, ids, encode_block(np.frombuffer(data, "<u4"), plane), *map(list, zip(*now, strict=True)))
            pieces, chunk, first = later, chunk + 1, first + ids
            return row

        names = [x.split()[0] for x in BLOCKS.split(", ")]
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], encode(list(batch["text"])), strict=True):
                seq += 1
                pieces.append((seq, None if doc is None else int(doc), first + len(buffer) // 4, len(ids) // 4 + 1))
                buffer += ids
                buffer += end
                while len(buffer) >= width:
                    rows.append(take(width))
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if buffer:
            yield pd.DataFrame([take(len(buffer))], columns=names)

    return run


def encode_documents(docs: DataFrame, path: str, end_id: int = END_ID, plane: str = "byte", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of token ids of all documents in ascending doc_id order: the rows of the file format.

    A row is a block: shard, chunk, the place of its first id within the shard,
    the number of ids, the encoded planes, and which documents lie where: their
    order, doc_id, first id and number of ids here. Null texts are empty and give
    the end id alone; null doc_ids come first; repeated rows are all written, and
    rows of one doc_id are ordered by a hash of their texts. An empty table gives
    no blocks; other columns are ignored. Blocks hold `block_ids` ids, and a long
    text goes on over several, so no task holds more than a batch of texts, the
    longest text and a block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas makes integers with nulls floats
    return map_pandas(rows, _blocks(path, end_id, plane, block_ids), BLOCKS)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            data = decode_block(r.data).tobytes()
            for s, d, at, n in zip(r.doc_seq, r.doc_id.split(","), r.doc_first, r.doc_n, strict=True):
                low = 4 * int(at - r.first)
                out.append((r.shard, s, d or None, at, n, zlib.crc32(data[low : low + 4 * int(n)])))
        yield pd.DataFrame(out, columns=["shard", "seq", "doc_id", "first", "n", "crc"])


def _joined(parts: pd.Series) -> pd.Series:
    out = []
    for own in parts:
        crc = own[0]["crc"]
        for p in own[1:]:
            crc = crc32_join(crc, p["crc"], 4 * int(p["n"]))
        out.append(crc)
    return pd.Series(out, dtype="int64")


def _bases(blocks: DataFrame) -> DataFrame:
    """(shard, base): ids of all shards before; a row per shard."""
    ends = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def decode_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from blocks as read back."""
    named = blocks.withColumn("doc_id", F.array_join("doc_id", ",", ""))
    pieces = map_pandas(named, _pieces, "shard int, seq long, doc_id string, first long, n long, crc long")
    whole = pieces.groupBy("shard", "seq").agg(
        F.min("doc_id").cast("long").alias("doc_id"),
        F.min("first").alias("first"),
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("first", "n", "crc"))).alias("parts"),  # a document's own blocks
    )
    whole = whole.join(_bases(blocks), "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "parts")
    several = F.size("parts") > 1  # only documents that straddle blocks leave the JVM
    crc = column_udf(blocks.sparkSession, _joined, "long", "parts")
    one = whole.where(~several).withColumn("ids_crc32", F.col("parts")[0]["crc"])
    return one.unionByName(whole.where(several).withColumn("ids_crc32", crc)).drop("parts")


def write(docs: DataFrame, folder: str, path: str, **how) -> None:
    """Write the token ids of `docs` to `folder`, which must not exist; `path` is the tokenizer's file."""
    stored(encode_documents(docs, path, **how), f"{folder}/blocks")
    blocks = docs.sparkSession.read.parquet(f"{folder}/blocks")
    index = blocks.select("shard", "chunk", "first", "n_ids", F.octet_length("data").alias("n_bytes"), F.size("doc_seq").alias("n_docs"))
    index = index.join(_bases(blocks), "shard").withColumn("start", F.col("base") + F.col("first"))
    index.select("shard", "chunk", "start", "n_ids", "n_bytes", "n_docs").write.parquet(f"{folder}/index")


def ids_between(spark: SparkSession, folder: str, start: int, stop: int) -> np.ndarray:
    """The ids start..stop of the whole output; only the blocks that the index names are read."""
    index = spark.read.parquet(f"{folder}/index").where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    wanted = index.orderBy("start").collect()  # stop - start ids at most
    if not wanted:
        return np.zeros(0, "<u4")
    found = F.struct("shard", "chunk").isin([F.struct(F.lit(r["shard"]), F.lit(r["chunk"])) for r in wanted])
    blocks = spark.read.parquet(f"{folder}/blocks").where(F.col("shard").isin([r["shard"] for r in wanted]) & found)
    data = {(r["shard"], r["chunk"]): bytes(r["data"]) for r in blocks.select("shard", "chunk", "data").collect()}
    ids = np.concatenate([decode_block(data[r["shard"], r["chunk"]]) for r in wanted])
    return ids[max(start - wanted[0]["start"], 0) : stop - wanted[0]["start"]]


def tokenised(docs: DataFrame, path: str, **how) -> DataFrame:
    """Write the token ids to the shared folder, read them back and describe each document."""
    spark = docs.sparkSession
    folder = scratch(spark, "token-ids")
    write(docs, folder, path, **how)
    return decode_documents(spark.read.parquet(f"{folder}/blocks"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"), tokenizer_path())
