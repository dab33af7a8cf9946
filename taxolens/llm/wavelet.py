"""Token-id output: one wavelet matrix per shard, in one compressed file.

A shard holds the token ids of whole documents in ascending doc_id order. Its ids are
split in bit-planes from the highest bit down; each plane is stably parted by its
bits, zeros first, which gives rank and select over any id. A plane is stored in chunks
of ``CHUNK_BITS`` bits, and a directory in the file has the ones before each chunk and
the chunk's place: rank opens one chunk, select finds its chunk by the directory. From
the one file come ``access`` (the id at a place), ``count`` (an id before a place) and
``occurrences`` (its places) without opening the rest, and ``decode`` (all ids).

File: magic, a JSON header length (4 bytes), the JSON header, then zstandard frames: which
doc ids aren't null, doc ids, document lengths, the directory (per plane: 32-bit ranks,
then 32-bit sizes of chunks) and the chunks of the planes, highest bit first; the header
has the lengths of the frames before the chunks.

Documents are dealt over tasks by ranges of doc_id, so shards in order of (task,
number) hold ascending ids. A task that runs again writes the same file names with the
same bytes, each file first under a name of its own.

Defined cases: a null or empty text has only the end id; repeated or null doc_ids are
written each (nulls first, equal ids by text); a text of any length stays in one shard;
other columns stay out; no rows, no files.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolens.llm.common import fresh_path, keep, only, open_shared, publish, release, small_batches, utf8
from taxolens.llm.hashing import SPACE, TOGETHER, Lookup, word_hashes

MAGIC = b"WMX2"
#: A shard is closed when it has so many ids.
SHARD_TOKENS = 1 << 20
END_ID = 1
#: Bytes of text that a task sorts and writes, about.
TASK_BYTES = 256 << 20
#: Bits of a plane in one chunk.
CHUNK_BITS = 1 << 15
#: Words whose ids a worker remembers.
CACHE_WORDS = 800_000
#: New words that are merged into the large table, at least.
MERGED = 1 << 16
#: ASCII punctuation, and the first bytes of two-byte Latin letters (U+00C0 to U+017F).
PUNCTUATION = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()
LATIN = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5])
#: Bytes that words for the model alone may have: those two, ASCII letters, second bytes, newlines.
SIMPLE = PUNCTUATION | LATIN | np.isin(np.arange(256), [10, *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0xC0)])
#: Code points of those letters by byte; white space stays.
PIECE_LETTERS = np.array([b if b in (10, 32) else ord(BYTE_LETTERS[b]) for b in range(256)], "<u4")


#: The rules under which a text's ids are those of its words.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(path: str) -> bool:
    """Does a tokenizer's file have the rules that ``WordEncoder`` relies on?"""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    same = rules.get("normalizer") == WORD_NORMALIZER and rules.get("pre_tokenizer") == WORD_PIECES and rules.get("post_processor") is None
    return same and not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in rules.get("added_tokens", []))


class TextEncoder:
    """The ids of whole texts, for any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for text in texts:
            yield np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")


class WordEncoder:
    """The ids of texts from those of their words, for tokenizers that ``by_words`` lets
    through: their rules never join or look across ASCII white space, fold case, and part a
    run of letters from the punctuation behind it, so a text's ids are those of its
    lower-case words, and a word's those of its letters and of what follows. Texts with
    marks of special tokens are taken as written.

    New words of Latin letters and ASCII punctuation behind them are parted here and given
    to the tokenizer's model together, in one call; other new words go through the whole
    tokenizer, each by itself.

    What is known of words lies in flat arrays by the hash of the word: a large table, and
    a small one of new words that is merged into it when it has grown. When both have
    ``CACHE_WORDS`` words, the large one is dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.tokenizer.model)  # of byte-level letters, parted by white space
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.old, self.young = _Known.none(), _Known.none()

    def ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and where each word's begin (one entry
        more than words). ``data`` are the words' bytes, a newline behind each."""
        plain = np.logical_not(np.logical_or.reduceat(_odd(data), starts))
        if plain.all():
            return self._plain(data)
        sizes = np.diff(np.append(starts, data.size))
        flat, begin = self._plain(data[np.repeat(plain, sizes)])
        words = [data[i : i + n - 1].tobytes() for i, n in zip(starts[~plain].tolist(), sizes[~plain].tolist())]
        others = [self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in words]
        numbers = np.zeros(starts.size, np.int64)
        numbers[plain], numbers[~plain] = np.diff(begin), [len(i) for i in others]
        ids, own = np.empty(numbers.sum(), "<u4"), np.repeat(plain, numbers)
        ids[own], ids[~own] = flat, np.array([t for i in others for t in i], "<u4")
        return ids, np.concatenate([[0], np.cumsum(numbers)])

    def _plain(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` of words without odd bytes."""
        a = np.frombuffer(data.tobytes().decode().lower().encode(), np.uint8)
        tops = np.flatnonzero(a == 10)
        if not tops.size:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        punct = PUNCTUATION[a]
        parted = np.flatnonzero(punct[1:] & ~punct[:-1] & (a[:-1] != 10)) + 1
        letters = PIECE_LETTERS[np.insert(a, parted, 32)].tobytes().decode("utf-32-le")
        (found,) = self.pieces.encode_batch_fast([letters], add_special_tokens=False)
        ids, pieces = np.array(found.ids, "<u4"), tops.size + parted.size
        ends = np.flatnonzero(self.last[ids]) + 1
        if ends.size != pieces:  # marks of ends are missing or not only there
            found = self.pieces.encode(letters, add_special_tokens=False)
            ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(pieces), "right")
        last = np.arange(tops.size) + np.searchsorted(parted, tops)  # each word's last piece
        return ids, np.concatenate([[0], ends[last]])

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (size == 0 or size + len(texts[to]) < TOGETHER):
                size, to = size + len(texts[to]) + 1, to + 1
            yield from self._together([t if b"<|" in t else t.lower() for t in texts[at:to]])
            at = to

    def _together(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        data = b"\n".join([*texts, b""])
        hashes, starts = word_hashes(data)
        hashes = hashes.view(np.int64)
        young = self.young.keys.find(hashes)
        old = np.full(hashes.size, -1, np.int32)
        old[young < 0] = self.old.keys.find(hashes[young < 0])
        new = np.flatnonzero((young < 0) & (old < 0))
        if new.size:
            fresh, first = np.unique(hashes[new], return_index=True)
            a, begin = np.frombuffer(data, np.uint8), starts[new[first]]
            spaces = np.flatnonzero(SPACE[a])
            size = spaces[np.searchsorted(spaces, begin)] - begin + 1  # with the space behind
            at = np.cumsum(size)
            words = a[np.repeat(begin - (at - size), size) + np.arange(at[-1])]
            words[at - 1] = 10
            ids, begin = self.ids(words, at - size)
            self.young = self.young.and_(_Known(Lookup(fresh[:0]), begin, ids), fresh)
            young = self.young.keys.find(hashes)
        flat = np.concatenate([self.young.ids, self.old.ids])
        begin = np.where(young >= 0, self.young.begin[young], self.old.begin[old] + self.young.ids.size)
        length = np.where(young >= 0, self.young.length(young), self.old.length(old))
        ends = np.cumsum(length)
        out = flat[np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if ends.size else 0)]
        tops = np.cumsum([len(t) + 1 for t in texts])
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.searchsorted(starts, tops)])].tolist()
        for a, b in zip(edges, edges[1:]):
            yield out[a:b]
        if self.young.begin.size > max(MERGED, self.old.begin.size // 4):
            full = self.young.begin.size + self.old.begin.size > CACHE_WORDS
            self.old, self.young = (self.young if full else self.old.and_(self.young)), _Known.none()


@dataclass
class _Known:
    """Ids of words: those of word ``i`` are ``ids[begin[i]:begin[i + 1]]``. ``begin`` has one
    entry more than there are words."""

    keys: Lookup
    begin: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls) -> _Known:
        return cls(Lookup(np.zeros(0, np.int64)), np.zeros(1, np.int64), np.zeros(0, "<u4"))

    def length(self, at: np.ndarray) -> np.ndarray:
        """Numbers of ids; of -1, something."""
        return self.begin[np.minimum(at + 1, self.begin.size - 1)] - self.begin[at]

    def and_(self, other: _Known, keys: np.ndarray | None = None) -> _Known:
        return _Known(Lookup(np.concatenate([self.keys.keys, other.keys.keys if keys is None else keys])), np.concatenate([self.begin, other.begin[1:] + self.ids.size]), np.concatenate([self.ids, other.ids]))


def _odd(data: np.ndarray) -> np.ndarray:
    """Marks the bytes by which a word isn't Latin letters with ASCII punctuation behind: the
    tokenizer's normaliser only folds the case of such words, and its rules part them there.
    Words begin at the start and behind newlines."""
    odd, second, latin, punct = ~SIMPLE[data], (data & 0xC0) == 0x80, LATIN[data], PUNCTUATION[data]
    pair = data[:-1].astype(np.uint16) << 8 | data[1:]
    odd[1:] |= second[1:] != latin[:-1]  # not a letter of two bytes
    odd[1:] |= (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0)  # signs, and the dotted I
    odd[1:] |= punct[:-1] & ~punct[1:] & (data[1:] != 10)  # letters behind punctuation
    odd[:1] |= second[:1]
    return odd


def encoder_of(path: str) -> WordEncoder | TextEncoder:
    """A worker's own encoder: what it has learnt serves the worker's next tasks."""
    held = only("wavelet")
    if path not in held:
        held[path] = WordEncoder(path) if by_words(path) else TextEncoder(path)
    return held[path]


def build_planes(ids: np.ndarray, bits: int):
    """The planes of a wavelet matrix, highest bit first: (packed bits, ones before each
    chunk and in all)."""
    cur = ids
    for level in range(bits - 1, -1, -1):
        one = (cur & cur.dtype.type(1 << level)).astype(bool)
        packed = np.packbits(one)
        sums = np.add.reduceat(np.bitwise_count(packed), np.arange(0, packed.size, CHUNK_BITS // 8), dtype=np.int64) if one.size else np.zeros(0, np.int64)
        yield packed.tobytes(), np.concatenate([[0], np.cumsum(sums)]).astype("<u4")
        cur = np.concatenate([cur.take(np.flatnonzero(~one)), cur.take(np.flatnonzero(one))])  # by places: masks cost five times as much


def encode_shard(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard as the bytes of its file."""
    bits = max(1, int(ids.max()).bit_length()) if ids.size else 1
    small = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    press = zstandard.ZstdCompressor(level=1)
    known = np.array([d is not None for d in doc_ids], bool)
    directory, chunks, step = [], [], CHUNK_BITS // 8
    for plane, ranks in build_planes(small, bits):
        own = [press.compress(plane[at : at + step]) for at in range(0, len(plane), step)]
        directory += [ranks, np.array([len(c) for c in own], "<u4")]
        chunks += own
    frames = [np.packbits(known).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), np.concatenate(directory).tobytes()]
    frames = [press.compress(f) for f in frames]
    head = json.dumps({"docs": len(doc_ids), "tokens": int(ids.size), "bits": bits, "frames": [len(f) for f in frames]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *frames, *chunks])


@lru_cache(maxsize=1)
def _opener() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


@dataclass
class Shard:
    """A shard read from its bytes; chunks are opened when they are asked for."""

    docs: int
    tokens: int
    bits: int
    frames: list[bytes]
    ranks: np.ndarray
    places: np.ndarray
    body: bytes

    @classmethod
    def parse(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        n = int.from_bytes(data[4:8], "little")
        head, at, frames = json.loads(data[8 : 8 + n]), 8 + n, []
        for size in head["frames"]:
            frames.append(data[at : at + size])
            at += size
        count = -(-head["tokens"] // CHUNK_BITS)
        directory = np.frombuffer(_opener().decompress(frames.pop()), "<u4").reshape(head["bits"], 2 * count + 1).astype(np.int64)
        places = np.concatenate([[0], np.cumsum(directory[:, count + 1 :].ravel())])
        return cls(head["docs"], head["tokens"], head["bits"], frames, directory[:, : count + 1], places, data[at:])

    def _open(self, i: int) -> bytes:
        return _opener().decompress(self.frames[i])

    def _chunk(self, level: int, k: int) -> np.ndarray:
        """The packed bits of a chunk of a plane."""
        i = level * (self.ranks.shape[1] - 1) + k
        return np.frombuffer(_opener().decompress(self.body[self.places[i] : self.places[i + 1]]), np.uint8)

    def _plane(self, level: int) -> np.ndarray:
        packed = [self._chunk(level, k) for k in range(self.ranks.shape[1] - 1)]
        return np.unpackbits(np.concatenate(packed) if packed else np.zeros(0, np.uint8), count=self.tokens).view(bool)

    def _rank(self, level: int, place: int) -> tuple[int, int]:
        """Ones before a place of a plane, and the bit there (0 behind the end)."""
        k, off = divmod(place, CHUNK_BITS)
        if k == self.ranks.shape[1] - 1:
            return int(self.ranks[level, k]), 0
        own = self._chunk(level, k)
        whole, rest = divmod(off, 8)
        ones = int(self.ranks[level, k]) + int(np.bitwise_count(own[:whole]).sum())
        if whole == own.size:
            return ones, 0
        byte = int(own[whole])
        return ones + (byte >> (8 - rest)).bit_count(), byte >> (7 - rest) & 1

    def _select(self, level: int, one: bool, ranks: np.ndarray) -> np.ndarray:
        """Places of the ones (or zeros) of the given ascending ranks in a plane."""
        before = self.ranks[level]
        if not one:
            before = np.minimum(np.arange(before.size) * CHUNK_BITS, self.tokens) - before
        chunk = np.searchsorted(before, ranks, "right") - 1
        out = np.empty(ranks.size, np.int64)
        for k in np.unique(chunk).tolist():
            own = chunk == k
            bits = np.unpackbits(self._chunk(level, k), count=min(CHUNK_BITS, self.tokens - k * CHUNK_BITS))
            out[own] = k * CHUNK_BITS + np.flatnonzero(bits == one)[ranks[own] - before[k]]
        return out

    def documents(self) -> tuple[list, np.ndarray]:
        known = np.unpackbits(np.frombuffer(self._open(0), np.uint8), count=self.docs)
        ids = np.frombuffer(self._open(1), "<i8").tolist()
        return [d if k else None for d, k in zip(ids, known)], np.frombuffer(self._open(2), "<i8")

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each undoes one stable parting."""
        cur = np.zeros(self.tokens, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = self._plane(level)
            zeros = self.tokens - int(one.sum())
            above = np.empty_like(cur)
            above[np.flatnonzero(~one)], above[np.flatnonzero(one)] = cur[:zeros], cur[zeros:]
            above |= one.astype(cur.dtype) << cur.dtype.type(self.bits - 1 - level)
            cur = above
        return cur.astype(np.uint32)

    def access(self, place: int) -> int:
        value = 0
        for level in range(self.bits):
            ones, one = self._rank(level, place)
            value = value << 1 | one
            place = self.tokens - int(self.ranks[level, -1]) + ones if one else place - ones
        return value

    def _interval(self, token: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.bits):
            x, y = self._rank(level, a)[0], self._rank(level, b)[0]
            if token >> (self.bits - 1 - level) & 1:
                zeros = self.tokens - int(self.ranks[level, -1])
                a, b = zeros + x, zeros + y
            else:
                a, b = a - x, b - y
        return a, b

    def count(self, token: int, before: int | None = None) -> int:
        """How often an id stands before a place (by default, in the shard)."""
        if token >> self.bits:
            return 0
        a, b = self._interval(token, 0, self.tokens if before is None else before)
        return b - a

    def occurrences(self, token: int) -> list[int]:
        """The places of an id, ascending: select through the planes, from below."""
        if token >> self.bits:
            return []
        a, b = self._interval(token, 0, self.tokens)
        at = np.arange(a, b)
        for level in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - level) & 1)
            zeros = self.tokens - int(self.ranks[level, -1])
            at = self._select(level, one, at - zeros if one else at)
        return np.sort(at).tolist()


def tasks_for(docs: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks to deal ``docs`` over: as many as the session shuffles into, more for much text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and write shard files under ``folder``.
    Returns the manifest: part, number, path, docs, tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or tasks_for(docs)
    dealt = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.crc32(F.col("text").cast("binary"))).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        encoder = encoder_of(tokenizer_path)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, lengths, pieces, size = [], [], [], 0
        end = np.array([END_ID], "<u4")

        def flush():
            path = f"{folder}/shard-{part:06d}-{number:06d}.wmx"
            publish(path, encode_shard(doc_ids, lengths, np.concatenate(pieces)))
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [path], "docs": [len(doc_ids)], "tokens": [size]}, pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(utf8(batch.column(1)))):
                doc_ids.append(doc_id)
                lengths.append(ids.size + 1)
                pieces += [ids, end]
                size += lengths[-1]
                if size >= shard_tokens:
                    yield flush()
                    doc_ids, lengths, pieces, size, number = [], [], [], 0, number + 1
        if doc_ids:
            yield flush()
        release()

    return keep(dealt.mapInArrow(write, "part int, number int, path string, docs long, tokens long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Documents from the shard files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    before, total = {}, 0
    for part, tokens in sorted(manifest.groupBy("part").agg(F.sum("tokens")).collect()):  # a number a task
        before[part] = total
        total += tokens
    if not before:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    own = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spark.createDataFrame(list(before.items()), "part int, before long")  # two numbers a task
    files = manifest.join(F.broadcast(offsets), "part").select("path", (F.col("before") + F.coalesce(F.sum("tokens").over(own), F.lit(0))).alias("start"))

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_shared(path, "rb") as f:
                    shard = Shard.parse(f.read())
                doc_ids, lengths = shard.documents()
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        release()

    n = max(1, min(10_000, manifest.count()))
    return files.repartition(n, F.xxhash64("path")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenised(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write ``docs`` as shards into the shared folder and read the files back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return read_shards(write_shards(docs, tokenizer_path, fresh_path(docs.sparkSession, "shards")))
