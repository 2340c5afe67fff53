"""Token ids in Simple-8b word-aligned files.

A file is a sequence of chunks, each followed by one line feed. A chunk holds whole documents:

    magic "S8BC" | u32 documents | u64 ids | u32 blocks | u64 words          (little-endian, 28 bytes)
    u8 has_id[documents] | i64 doc_id[documents] | u64 ids of each document[documents]
    u32 first word of each block[blocks + 1] | u64 words[words]

Blocks hold BLOCK ids (the last one of a chunk fewer). The low 4 bits of a word are its selector: selectors 0 to 13 pack the
counts and widths of PACKINGS into the other 60 bits, selector 15 is an escape, its id is the whole next word. A block's
last word may have unused places. All blocks of a chunk are packed and unpacked side by side by numpy.

Chunks are written through Spark's own writer, so any store that Spark reaches will do, and come back by its binary reader.
Documents are in ascending doc_id order over the sorted files (null ids first, ties by a hash of the text).

Inputs: null and empty texts have only the end id; rows that repeat a doc_id are written each on their own; other columns
are ignored; empty tables give no files and an empty result.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_path, fresh_path, lean, materialize, shuffles_dropped
from .hashing import slices, text_buffer

MAGIC, HEAD, BLOCK = b"S8BC", struct.Struct("<4sIQIQ"), 128
#: Count and width of selectors 0 to 13.
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE, PAD = 15, 60
#: Text bytes of a file, about, and of a chunk: a file is one row of the binary reader, and has whole chunks.
FILE_BYTES, CHUNK_BYTES = 12 << 20, 1 << 20
#: Text bytes of a range of doc_ids, which one task sorts and writes as several files.
RANGE_BYTES = 256 << 20
#: Pieces that a worker remembers at most (a power of 2), ids that they have, about, and long pieces.
CACHE_PIECES, CACHE_IDS, CACHE_LONG = 1 << 21, 8 << 20, 20_000
#: Bytes of plain text that are cut at once.
CUT_BYTES = 1 << 18


def _needs(ids: np.ndarray) -> np.ndarray:
    """For each id one more than the largest packing width that is too narrow for it, or 0."""
    need = np.zeros(ids.shape, np.uint8)
    for bits in sorted({w for _, w in PACKINGS}):
        need[ids >= np.uint64(1 << bits)] = bits + 1
    return need


_SHORT = _needs(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each block and the end, words) of unsigned 64-bit ids."""
    ids = np.asarray(ids, np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    wide = np.zeros((blocks, BLOCK + PAD), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    wide[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    need = np.zeros(wide.shape, np.uint8)
    need[:, :BLOCK] = (_SHORT[flat.astype(np.int64)] if int(ids.max()) < len(_SHORT) else _needs(flat)).reshape(blocks, BLOCK)
    top = {1: need}
    for c in (2, 4, 8, 16, 32):
        half = top[c // 2]
        top[c] = np.maximum(half[:, : half.shape[1] - c // 2], half[:, c // 2 :])
    # ids that fit a packing fit all later ones: their selector is the number of those that they don't fit
    choice = np.zeros((blocks, BLOCK), np.uint8)
    for count, width in PACKINGS:
        c = 1 << (count.bit_length() - 1)
        most = np.maximum(top[c][:, :BLOCK], top[c][:, count - c : count - c + BLOCK])
        choice += most > width
    choice[choice == len(PACKINGS)] = ESCAPE
    counts = np.array([c for c, _ in PACKINGS] + [1, 1], np.int64)
    held = np.full(blocks, BLOCK, np.int64)
    held[-1] = n - (blocks - 1) * BLOCK
    path, at, live = [], np.zeros(blocks, np.int64), np.arange(blocks)
    while len(live):
        s = choice[live, at[live]]
        step = np.full(blocks, -1, np.int64)
        step[live] = at[live]
        path.append(step)
        at[live] += counts[s]
        live = live[at[live] < held[live]]
    places = np.stack(path, 1)
    block, order = np.nonzero(places >= 0)
    start = places[block, order]
    chosen = choice[block, start]
    words = chosen.astype(np.uint64)
    base = block * (BLOCK + PAD) + start
    source = wide.ravel()
    for s, (count, width) in enumerate(PACKINGS):
        rows = np.flatnonzero(chosen == s)
        for j in range(count if len(rows) else 0):
            # places after the end of the block are zeros of the padding
            words[rows] |= source[base[rows] + j] << np.uint64(4 + j * width)
    lengths = 1 + (chosen == ESCAPE).astype(np.int64)
    out = np.zeros(int(lengths.sum()), np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    out[first[:-1]] = words
    escaped = np.flatnonzero(chosen == ESCAPE)
    out[first[escaped] + 1] = source[base[escaped]]
    heads = first[np.concatenate([np.flatnonzero(order == 0), [len(order)]])]
    return heads.astype(np.uint32), out


def unpack(heads: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of packed words."""
    if not n:
        return np.zeros(0, np.uint64)
    blocks = len(heads) - 1
    chosen = (words & np.uint64(15)).astype(np.int64)
    real = np.ones(len(words), bool)
    suspects = np.flatnonzero(chosen == ESCAPE)
    for i in suspects:  # a raw word after an escape is no selector
        if real[i] and i + 1 < len(words):
            real[i + 1] = False
    counts = np.array([c for c, _ in PACKINGS] + [1, 1], np.int64)
    at = np.flatnonzero(real)
    block = np.searchsorted(heads[1:].astype(np.int64), at, "right")
    held = counts[chosen[at]]
    total = np.concatenate([[0], np.cumsum(held)])
    first = np.searchsorted(at, heads[:-1].astype(np.int64))
    place = block * (BLOCK + PAD) + total[:-1] - total[first][block]
    wide = np.zeros(blocks * (BLOCK + PAD), np.uint64)
    for s, (count, width) in enumerate(PACKINGS):
        rows = np.flatnonzero(chosen[at] == s)
        for j in range(count if len(rows) else 0):
            wide[place[rows] + j] = (words[at[rows]] >> np.uint64(4 + j * width)) & np.uint64((1 << width) - 1)
    rows = np.flatnonzero(chosen[at] == ESCAPE)
    wide[place[rows]] = words[at[rows] + 1] if len(rows) else 0
    return wide.reshape(blocks, BLOCK + PAD)[:, :BLOCK].ravel()[:n]


def chunk(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    heads, words = pack(ids)
    has = np.array([d is not None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join((HEAD.pack(MAGIC, len(doc_ids), len(ids), len(heads) - 1, len(words)), has.tobytes(), known.tobytes(), lengths.astype("<u8").tobytes(), heads.astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def chunks(data: bytes):
    """(doc_ids, lengths, ids) of each chunk of a file."""
    data, at = memoryview(data), 0
    while at < len(data):
        magic, docs, n, blocks, count = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no chunk at byte {at}")
        at += HEAD.size
        parts = []
        for kind, size in (("u1", docs), ("<i8", docs), ("<u8", docs), ("<u4", blocks + 1), ("<u8", count)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        if data[at : at + 1] != b"\n":
            raise ValueError(f"no line feed at byte {at}")
        at += 1
        has, known, lengths, heads, words = parts
        yield [int(d) if h else None for h, d in zip(has, known, strict=True)], lengths.astype(np.int64), unpack(heads, words, n)


#: Plain text, whose classes and lower-case forms are plain, has the characters 00 to 1B, 20 to 7E, and the letters of C0 to FF; no "<|".
#: Of its bytes 0 are plain, 1 are not, 2 depend on the next byte.
_ODD = np.ones(256, np.uint8)
_ODD[[*range(0x1C), *range(0x20, 0x7F), *range(0x80, 0xC0)]] = 0
_ODD[[0xC3, ord("<")]] = 2
#: Kinds of the bytes of plain, lower-case text.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(9, 14), 32]] = _SPACE
_KIND[[*range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The first n bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Second word of pieces of more than 15 bytes; none of the others has it.
LONG = np.uint64(2**64 - 1)
#: The settings of a tokenizer file for which cut() cuts plain, lower-case text as the tokenizer does.
PLAIN_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "truncation": None,
}


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def has_plain_rules(settings: dict) -> bool:
    """Whether a tokenizer file's settings are those of PLAIN_RULES, with no added token that plain text may hold."""
    return all(settings.get(k) == v for k, v in PLAIN_RULES.items()) and all(t["content"].startswith("<|") for t in settings.get("added_tokens") or ())


def plain_texts(texts: pa.Array) -> np.ndarray:
    """Whether each text has plain characters alone; others, and those that may hold a special token, are encoded whole."""
    body, offsets = text_buffer(texts)
    kind = _ODD[body]
    at = np.flatnonzero(kind)
    byte, after = body[at], body[np.minimum(at + 1, max(len(body) - 1, 0))]
    at = at[(kind[at] == 1) | (byte == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (byte == ord("<")) & (after == ord("|"))]
    before = np.searchsorted(at, offsets)
    return before[1:] == before[:-1]


def lower(body: np.ndarray) -> np.ndarray:
    """Bytes of plain text in lower case."""
    low = _LOWER[body]
    at = np.flatnonzero(low[:-1] == 0xC3) + 1
    low[at[low[at] <= 0x9E]] += 32
    return low


def cut(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of plain, lower-case text that begins and ends with a space."""
    kind = _KIND[low]
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= kind == _DIGIT
    at = np.flatnonzero(low[:-1] == ord("'"))
    at = at[kind[at - 1] != _OTHER]  # others are inside a piece
    one, two = low[at + 1], low[np.minimum(at + 2, len(low) - 1)]
    short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    new[at[short | long] + 1] = False
    new[at[short] + 2] = True
    new[at[long] + 3] = True
    edges = np.flatnonzero(new)
    real = kind[edges] != _SPACE
    return edges[real], np.append(edges[1:], len(low))[real]


def keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each piece, its bytes and above them its length, so no other piece has both; the second is LONG for more than 15 bytes."""
    room = np.zeros(len(low) // 8 + 4, np.uint64)
    room.view(np.uint8)[: len(low)] = low

    def eight(at: np.ndarray) -> np.ndarray:
        word, bits = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        return (room[word] >> bits) | ((room[word + 1] << (np.uint64(56) - bits)) << np.uint64(8))

    n = ends - starts
    first, second = eight(starts) & _FIRST[np.minimum(n, 8)], n.astype(np.uint64) << np.uint64(56)
    more = np.flatnonzero(n > 8)
    second[more] |= eight(starts[more] + 8) & _FIRST[np.minimum(n[more] - 8, 7)]
    second[more[n[more] > 15]] = LONG
    return first, second


class Known:
    """Ids of pieces of up to 15 bytes, found for many pieces at once.

    A piece has two places; where both are taken, the newcomer replaces one of them. The ids lie in a pool; when that is full,
    all is forgotten.
    """

    def __init__(self, places: int) -> None:
        self.shift = np.uint64(64 - (places.bit_length() - 1))
        self.first, self.second, self.value = (np.zeros(places, np.uint64) for _ in range(3))
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def forget(self) -> None:
        self.second[:] = 0
        self.used = 0

    def add(self, lists: list[list[int]]) -> np.ndarray:
        """For each list of ids its place in the pool, times 2**32, and their number."""
        number = np.array([len(x) for x in lists], np.uint64)
        to = np.cumsum(number, dtype=np.uint64) + np.uint64(self.used)
        at, self.used = self.used, self.used + int(number.sum())
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), self.used), np.uint32)])
        self.pool[at : self.used] = [i for x in lists for i in x]
        return (to - number) << np.uint64(32) | number

    def ids(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each value, ids of all)."""
        at, number = (values >> np.uint64(32)).astype(np.int64), (values & np.uint64(2**32 - 1)).astype(np.int64)
        to = np.cumsum(number)
        return number, self.pool[np.repeat(at - to + number, number) + np.arange(number.sum())]

    def _place(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = (first ^ second * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> self.shift).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, pieces that are not known)."""
        place = self._place(first, second)
        out = self.value[place]
        rest = np.flatnonzero((self.first[place] != first) | (self.second[place] != second))
        place = place[rest] ^ 1
        out[rest] = self.value[place]
        return out, rest[(self.first[place] != first[rest]) | (self.second[place] != second[rest])]

    def keep(self, first: np.ndarray, second: np.ndarray, value: np.ndarray) -> None:
        """Remember the values of different pieces."""
        place = self._place(first, second)
        place ^= np.where(self.second[place] == 0, 0, np.where(self.second[place ^ 1] == 0, 1, value >> np.uint64(32) & np.uint64(1))).astype(np.int64)
        self.first[place], self.second[place], self.value[place] = first, second, value


class Encoder:
    """Ids of whole texts, piece by piece through a bounded cache.

    The tokenizer's rules cut a text into pieces that its model encodes one by one, and drop white space. Plain texts are cut
    here by the same rules, many at once, and only unknown pieces go to the model; all other texts go through the tokenizer. The
    shortcut is taken only where the tokenizer file has these rules; `plain` turns it off.
    """

    def __init__(self, path: str, end_id: int, plain: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.end, self.long = Tokenizer.from_file(path), end_id, {}
        with open(path, encoding="utf-8") as f:
            self.plain = plain and has_plain_rules(json.load(f))
        self.model, self.letters, self.known = self.tok.model, {b: c for b, c in _byte_letters().items() if b != 32}, Known(CACHE_PIECES if self.plain else 2)

    def all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, ids of all texts); the end id is the last one of each."""
        plain = plain_texts(texts) if self.plain else np.zeros(len(texts), bool)
        if plain.all():
            return self._plain(texts)
        whole = [self.tok.encode(t or "", add_special_tokens=False).ids + [self.end] for t in texts.filter(pa.array(~plain)).to_pylist()]
        lengths, ids = self._plain(texts.filter(pa.array(plain)))
        cuts, whole = iter(np.split(ids, np.cumsum(lengths))), iter(whole)
        parts = [next(cuts) if p else np.array(next(whole), np.uint32) for p in plain]
        return np.array([len(p) for p in parts], np.int64), np.concatenate(parts)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        body, offsets = text_buffer(texts)
        view, edges = memoryview(body), offsets.tolist()
        low = lower(np.frombuffer(b" ".join([b"", *(view[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)), b""]), np.uint8))
        at, starts, numbers, ids = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        while at < len(low) - 1:
            to = _last_space(low, at)
            start, values = self._values(low[at : to + 1])
            for out, x in zip((starts, numbers, ids), (start + at, *self.known.ids(values)), strict=True):
                out.append(x)
            at = to
        before = np.concatenate([[0], np.cumsum(np.concatenate(numbers))])
        edges = before[np.searchsorted(np.concatenate(starts), offsets + np.arange(len(offsets)))]  # of each text, from the space before it
        return np.diff(edges) + 1, np.insert(np.concatenate(ids), edges[1:], self.end)

    def _values(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces and their values in the pool."""
        if self.known.used >= CACHE_IDS:
            self.known.forget()
        if not self.known.used or len(self.long) >= CACHE_LONG:
            self.long.clear()
        starts, ends = cut(low)
        first, second = keys(low, starts, ends)
        values, fresh = self.known.find(first, second)
        if len(fresh):
            raw, is_long = low.tobytes(), second[fresh] == LONG
            some = fresh[~is_long]
            some = some[np.lexsort((first[some], second[some]))]
            new = np.ones(len(some), bool)
            new[1:] = (first[some[1:]] != first[some[:-1]]) | (second[some[1:]] != second[some[:-1]])
            one = some[new]
            learned = self._learn([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            values[some] = learned[np.cumsum(new) - 1]
            self.known.keep(first[one], second[one], learned)
            some = fresh[is_long]
            pieces = [raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            new = [x for x in dict.fromkeys(pieces) if x not in self.long]
            self.long.update(zip(new, self._learn(new).tolist(), strict=True))
            values[some] = [self.long[x] for x in pieces]
            for x in new:
                if len(x) >= 100:  # hardly comes again
                    del self.long[x]
        return starts, values

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Values of pieces that the model encodes now."""
        letters = b" ".join(pieces).decode("latin-1").translate(self.letters).split(" ") if pieces else []
        return self.known.add([[t.id for t in self.model.tokenize(x)] for x in letters])


def _last_space(low: np.ndarray, at: int) -> int:
    """The last space of the CUT_BYTES after at, or the first one after these; low ends with a space."""
    to = at + CUT_BYTES
    found = np.flatnonzero(_KIND[low[at + 1 : to + 1]] == _SPACE)
    if len(found):
        return at + 1 + int(found[-1])
    while not len(found):
        found, to = np.flatnonzero(_KIND[low[to : to + CUT_BYTES]] == _SPACE), to + CUT_BYTES
    return to - CUT_BYTES + int(found[0])


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """This worker's encoder, loaded once and used by all its tasks."""
    if (path, end_id) not in _encoders:
        _encoders.clear()
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> None:
    """Token files of docs under path, named in doc_id order. tokenizer: a path that every executor has.

    Ranges of doc_ids are sorted by one task each. There are as many as the session has shuffle partitions where these have
    file_bytes or more, and otherwise as few as range_bytes allows, so their number stays small on large inputs.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(-(-size // range_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes)), 1)

    def run(batches):
        encode = None
        for batch in lean(batches):
            encode = encode or encoder(tokenizer, end_id)
            ids = batch.column(0).to_pylist()
            for at, part in slices(batch.column(1), CHUNK_BYTES):
                data = chunk(ids[at : at + len(part)], *encode.all(part))
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["chunk"])

    dealt = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    with shuffles_dropped(spark):
        rows = dealt.mapInArrow(run, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
        rows.write.option("lineSep", "\n").option("maxRecordsPerFile", max(1, 2 * file_bytes // CHUNK_BYTES)).text(path)


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, with file and place, as the files have them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches):
        for batch in lean(batches):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = place = 0
                for doc_ids, lengths, ids in chunks(data.as_buffer()):
                    raw, edges = memoryview(ids.astype("<u4")).cast("B"), np.concatenate([[0], np.cumsum(lengths)])
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    rows = len(doc_ids)
                    yield pa.RecordBatch.from_pydict({"file": pa.array([name.rpartition("/")[2]] * rows), "place": pa.array(range(place, place + rows), pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()), "at": pa.array(edges[:-1] + at, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                    at, place = at + int(lengths.sum()), place + rows

    return files.mapInArrow(run, "file string, place long, doc_id long, at long, n_tokens long, ids_crc32 long")


#: Ranges whose files are summed together before the running sum over all.
GROUP = 1024


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds start, ids of all documents before it: running sums over files within groups of ranges, and over these groups."""
    number = lambda p: F.coalesce(F.try_to_number(F.regexp_extract("file", p, 1), F.lit("9" * 18)).cast("long"), F.lit(0))
    part, piece = number(r"part-(\d+)"), number(r"-c(\d+)")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total")).select("file", "total", part.alias("part"), piece.alias("piece"), F.floor(part / GROUP).alias("group"))
    so_far = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = files.groupBy("group").agg(F.sum("total").alias("total")).select("group", so_far(W.orderBy("group")).alias("base"))
    before = files.withColumn("before", so_far(W.partitionBy("group").orderBy("part", "piece", "file"))).join(groups, "group")
    before = before.select("file", (F.col("base") + F.col("before")).alias("before"))
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file", "place")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the token files of docs to path and give what they hold of each document; without a path they go once read."""
    target = path or fresh_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, target, end_id)
    rows = materialize(read(docs.sparkSession, target), "token-rows")
    if path is None:
        drop_path(docs.sparkSession, target)
    return with_starts(rows)
