"""Token ids as raw binary shards with a minimal perfect hash index over document keys.

Shards.  Documents are range-partitioned and sorted by doc_id; each partition is written as
one file: the raw ids (little-endian, 2 bytes where the vocabulary allows, else 4), then
documents + 1 offsets, then 32 bytes (magic, version, bytes of an id, documents, ids).  A
file's name is unique to the attempt that wrote it, and only files in the manifest that the
finished job returns exist for readers, so lost executors leave nothing half-written.

Index.  Keys are dealt to buckets by a hash; each bucket holds a minimal perfect hash: levels of bit
arrays (a key that is alone at its bit stays, the others go on to the next level), whose ranks number
the keys without gaps.  A slot stores a 32-bit fingerprint, the shard, the document's place
in it and how many documents share the key.  A lookup is one bucket, a few bit tests, a fingerprint
comparison and two offsets: constant time, whatever the size of the corpus.

Encoding.  A byte-level vocabulary splits texts by a pattern and no token reaches over a split.  Some splits
are certain from the neighbouring characters: before a blank that stands alone between visible characters,
before a line break after a visible character, before and after one before a visible character, and before a punctuation mark after an ASCII letter or
digit or a letter of Latin-1.  Texts are cut there; each distinct piece of a block is encoded once and remembered (a bounded memory for
each worker), and the ids of all pieces are put together by array operations.  A new piece of letters alone, with or without
a blank before them, is one match of the pattern, so it goes straight to the library's model, spelt in the model's alphabet; other new
pieces go through the whole tokenizer.  The ids are those of the whole text; a vocabulary with another pattern, or with added tokens
besides the one for the end of a text, has its texts encoded whole.

Defined results: a null text is an empty one (only the end id); documents that share a doc_id
stand next to each other, ordered by text, and a lookup finds all of them; null doc_ids come first and are one key, which is kept beside the index;
an empty table makes no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import cut, scratch
from orrery.llm.textblocks import blocks, lean, mix64

VOCABULARY = "byte_bpe_50k.json"
END = 2
MAGIC = b"IDSHARD1"
FOOTER = struct.Struct("<8sIIQQ")
BUCKET_KEYS = 1 << 15
#: Pieces that a worker remembers: so many new ones, and as many from before.
REMEMBER = 300_000

#: The bucket of the null key.
_NONE = -1
_GOLD = 0x9E3779B97F4A7C15
#: Text bytes that are encoded at a time.
ENCODE_BYTES = 2 << 20
#: Text bytes of a shard, where the session's shuffle partitions would make larger ones.
SHARD_BYTES = 256 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[9:14] = _BLANK[28:33] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b"!\"#$%&'()*+,-./:;=?@[]_")] = True
#: Letters below U+2000 that Unicode has had since version 3.2, so the pattern takes them for letters in any version of the library.
_LETTERS = frozenset(c for c in map(chr, range(0x2000)) if c.isalpha() and unicodedata.ucd_3_2_0.category(c)[0] == "L")


def _fs(path: str):
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _blank_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a blank character beyond ASCII starts at these bytes; what ends before the data is none."""
    byte = lambda k: data[np.minimum(at + k, len(data) - 1)]
    a, b, c = byte(0), byte(1), byte(2)
    narrow = (c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)
    wide = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x80) & narrow | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | wide


def _visible_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each byte is visible; there is one, in the same text."""
    seen = ~_BLANK[data[at - 1]]
    wide = np.flatnonzero(data[at - 1] >= 0x80)
    near = at[wide]
    seen[wide] = ~(_blank_at(data, np.maximum(near - 2, 0)) | _blank_at(data, np.maximum(near - 3, 0)))
    return seen


def _visible_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a visible character starts at each byte."""
    seen = ~_BLANK[data[at]]
    wide = np.flatnonzero(data[at] >= 0x80)
    seen[wide] = ~_blank_at(data, at[wide])
    return seen


def cuts(block) -> np.ndarray:
    """Bytes where a split is certain, inside texts."""
    data = block.data
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[block.offset] = True
    inner = lambda at: at[~edge[at]]
    blank = inner(np.flatnonzero(data == 32))
    blank = blank[~edge[blank + 1]]
    blank = blank[_visible_before(data, blank) & _visible_at(data, blank + 1)]
    line = np.flatnonzero(data == 10)
    before, after = inner(line), inner(line + 1)
    after = after[_visible_at(data, after) & (data[after] != 60)]  # blanks before an added token end a text
    stop = inner(np.flatnonzero(_STOP[data]))
    last = data[stop - 1]
    stop = stop[_ALNUM[last] | (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (data[stop - 2] == 0xC3)]  # or U+00C0..U+00FF but for two signs
    found = [blank, before[_visible_before(data, before)], inner(after - 1), after, stop]
    mark = np.zeros(len(data) + 1, dtype=bool)
    for at in found:
        mark[at] = True
    return np.flatnonzero(mark)


def letters(piece: str) -> bool:
    """Whether the piece is letters alone, or a blank and letters: one match of the byte-level pattern."""
    own = piece.removeprefix(" ")
    return own != "" and _LETTERS.issuperset(own)


class Encoder:
    """Ids of texts by the tokenizers library, remembering the pieces it has seen."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(file)
        every = "".join(map(chr, range(0x2000)))
        spelt = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(every)
        #: How the model spells each byte of what `letters` takes
        self.alphabet = dict(zip(every.encode(), "".join(part for part, _ in spelt)))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        special = self.tokenizer.get_added_tokens_decoder()
        self.split = next((i for i, t in special.items() if t.content == "<|endoftext|>"), None)
        shape = json.loads(self.tokenizer.to_str())
        how = shape.get("pre_tokenizer") or {}
        #: Whether the vocabulary splits by the byte-level pattern and by no other token, as it is
        self.cut = shape.get("normalizer") is None and all(t.content == "<|endoftext|>" for t in special.values()) and how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space")
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def _parts(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        raw, width = ids.tobytes(), ids.itemsize
        return [raw[a:z] for a, z in zip((start * width).tolist(), (end * width).tolist())]

    def _letters(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of letters, by the model."""
        tokenize, ids, end = self.tokenizer.model.tokenize, [], []
        for spelt in "\n".join(pieces).encode().decode("latin-1").translate(self.alphabet).split(self.alphabet[10]):
            ids += [token.id for token in tokenize(spelt)]
            end.append(len(ids))
        return self._parts(np.array(ids, dtype=self.width), np.array([0, *end[:-1]]), np.array(end))

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, many in one text, with a special token between them."""
        found = []
        for lo in range(0, len(pieces), 2000):
            flat = np.array(self.tokenizer.encode_batch_fast(["<|endoftext|>".join(pieces[lo : lo + 2000])], add_special_tokens=False)[0].ids, dtype=self.width)
            cut = np.flatnonzero(flat == self.split)
            found += self._parts(flat, np.append(0, cut + 1), np.append(cut, len(flat)))
        return found

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces."""
        simple = list(map(letters, pieces)) if self.cut else [False] * len(pieces)
        plain = list(compress(pieces, simple))
        others = [p for p, own in zip(pieces, simple) if not own]
        joined = [] if self.split is None else [p for p in others if "<|" not in p]
        by_model, by_join = iter(self._letters(plain) if plain else ()), iter(self._joined(joined))
        return [next(by_model) if own else self.ids(p) if self.split is None or "<|" in p else next(by_join) for p, own in zip(pieces, simple)]

    def encode(self, block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's texts one after the other, END after each, and how many each has."""
        if len(self.known) > REMEMBER:
            self.known, self.before = {}, self.known
        at = cuts(block) if self.cut else np.zeros(0, dtype=np.int64)
        first = np.arange(block.rows) + np.searchsorted(at, block.offset[:-1])  # each text's first piece
        start = np.sort(np.concatenate([block.offset[:-1], at]))
        offset = np.append(start, block.offset[-1]).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offset), pa.py_buffer(block.data)).dictionary_encode()
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        held = list(map(self.known.get, words))
        fresh = [k for k, own in enumerate(held) if own is None]
        names = [words[k] for k in fresh]
        found = list(map(self.before.get, names))
        learnt = iter(self._learn([w for w, own in zip(names, found) if own is None]))
        found = [next(learnt) if own is None else own for own in found]
        self.known.update(zip(names, found))
        for k, own in zip(fresh, found):
            held[k] = own
        held.append(np.array([END], dtype=self.width).tobytes())
        many = np.fromiter(map(len, held), dtype=np.int32, count=len(held)) // np.dtype(self.width).itemsize
        begin = np.cumsum(many, dtype=np.int32) - many
        # the pieces of each text, and the last of `held` after them
        ends = np.append(first[1:], len(start)) + np.arange(block.rows)
        number = np.full(len(start) + block.rows, len(words), dtype=np.int32)
        own = np.ones(len(number), dtype=bool)
        own[ends] = False
        number[own] = pieces.indices.to_numpy()
        length = many[number]
        total = np.cumsum(length, dtype=np.int64)
        place = np.repeat((begin[number] - (total - length)), length)
        place += np.arange(len(place))
        return np.frombuffer(b"".join(held), dtype=self.width)[place], np.diff(np.append(0, total[ends]))


_encoders: dict[str, Encoder] = {}  # of this process: what one task has learnt serves the next


def _write(batches, folder: str, file: str):
    encoder = _encoders.get(file) or _encoders.setdefault(file, Encoder(file))
    ids, lengths = [], []
    number = None
    filesystem, path = _fs(folder)
    name = f"shard-{uuid.uuid4().hex}"
    out = None
    for batch in batches:
        for block in blocks(batch.column(1), ENCODE_BYTES):
            if out is None:
                number = batch.column(2)[0].as_py()
                filesystem.create_dir(path, recursive=True)
                out = filesystem.open_output_stream(f"{path}/{name}.ids")
            encoded, many = encoder.encode(block)
            ids.append(batch.column(0).slice(block.lo, block.rows))
            lengths.append(many)
            out.write(encoded.tobytes())
    if out is None:
        return
    width = np.dtype(encoder.width).itemsize
    lengths = np.concatenate(lengths)
    offsets = np.append(0, np.cumsum(lengths))
    out.write(offsets.astype("<u8").tobytes())
    out.write(FOOTER.pack(MAGIC, 1, width, len(lengths), int(offsets[-1])))
    out.close()
    keys = pa.concat_arrays(ids)
    known, value = keys.is_valid().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy()
    first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (known[1:] != known[:-1])))
    many = np.diff(np.append(first, len(keys)))
    n = len(first)
    yield pa.RecordBatch.from_arrays(
        [keys.take(pa.array(first)), pa.array(np.full(n, number)), pa.array(first), pa.array(many), pa.array([f"{name}.ids"] * n), pa.array(np.full(n, len(keys))), pa.array(np.full(n, int(offsets[-1])))],
        ["key", "part", "place", "many", "file", "documents", "ids"],
    )


def write_shards(docs: DataFrame, folder: str, file: str, partitions: int | None = None) -> DataFrame:
    """Write the shards; returns the manifest: one row per key (key, part, place, many, file, documents, ids)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions
    if n is None:
        held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // SHARD_BYTES))
    placed = texts.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    numbered = placed.withColumn("part", F.spark_partition_id().cast("long"))
    return cut(numbered.mapInArrow(lean(lambda b: _write(b, folder, file)), "key bigint, part bigint, place bigint, many bigint, file string, documents bigint, ids bigint"))


class Index:
    """A minimal perfect hash over distinct 64-bit keys, as levels of bit arrays."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base = np.append(0, np.cumsum([int(level.sum()) for level in levels]))
        self.ranks = [np.append(0, np.cumsum(level)) for level in levels]

    @staticmethod
    def build(keys: np.ndarray) -> Index:
        if len(np.unique(keys)) < len(keys):
            raise ValueError("an index takes each key once")
        levels, left = [], keys
        while len(left):
            size = 2 * len(left) + 1
            at = Index._at(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return Index(levels)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys.view(np.uint64) ^ np.uint64(_GOLD * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys that were not built in, any slot or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            at = self._at(keys[left], k, len(level))
            hit = level[at]
            out[left[hit]] = self.base[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.view(np.uint64) + np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(32)).astype(np.uint32)


def _build(batches):
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables).combine_chunks()
    bucket = table.column("bucket").to_numpy()
    for value in np.unique(bucket):
        own = table.filter(pa.array(bucket == value))
        if value == _NONE:  # no key to hash: its places as they are
            empty = pa.array([[]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([[]], pa.list_(pa.binary())), empty, empty, *(pa.array([own.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("part", "place", "many"))], ["bucket", "levels", "sizes", "fingerprint", "part", "place", "many"])
            continue
        keys = own.column("key").to_numpy()
        index = Index.build(keys)
        order = np.empty(len(keys), dtype=np.int64)
        order[index.slots(keys)] = np.arange(len(keys))
        levels = [np.packbits(level).tobytes() for level in index.levels]
        column = lambda name: [own.column(name).to_numpy()[order].tolist()]  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays(
            [pa.array([value]), pa.array([levels], pa.list_(pa.binary())), pa.array([[len(x) for x in index.levels]], pa.list_(pa.int64())), pa.array([fingerprints(keys)[order].astype(np.int64).tolist()], pa.list_(pa.int64())),
             pa.array(column("part"), pa.list_(pa.int64())), pa.array(column("place"), pa.list_(pa.int64())), pa.array(column("many"), pa.list_(pa.int64()))],
            ["bucket", "levels", "sizes", "fingerprint", "part", "place", "many"],
        )


_INDEX = "bucket bigint, levels array<binary>, sizes array<bigint>, fingerprint array<bigint>, part array<bigint>, place array<bigint>, many array<bigint>"


def _bucket(buckets: int):
    return F.when(F.col("key").isNull(), _NONE).otherwise(F.pmod(F.xxhash64("key", F.lit(23)), F.lit(buckets))).alias("bucket")


def build_index(manifest: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """One row per bucket of about bucket_keys keys, and the number of buckets."""
    buckets = max(1, -(-manifest.count() // bucket_keys))
    keyed = manifest.select("key", "part", "place", "many", _bucket(buckets))
    return cut(keyed.repartition(buckets, "bucket").mapInArrow(_build, _INDEX)), buckets


def _look(batches):
    import pandas as pd

    for batch in batches:
        for own in batch.to_pylist():
            if own["bucket"] == _NONE:
                columns = [pa.array([None] * len(own["part"]), pa.int64()), *(pa.array(own[c], pa.int64()) for c in ("part", "place", "many"))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "part", "place", "many"])
                continue
            index = Index([np.unpackbits(np.frombuffer(level, np.uint8))[:size].astype(bool) for level, size in zip(own["levels"], own["sizes"])])
            keys = np.array(own["keys"], dtype=np.int64)
            slot = index.slots(keys)
            sound = slot >= 0
            sound[sound] = np.array(own["fingerprint"], dtype=np.uint32)[slot[sound]] == fingerprints(keys[sound])
            slot = slot[sound]
            frame = pd.DataFrame({"key": keys[sound], "part": np.array(own["part"])[slot], "place": np.array(own["place"])[slot], "many": np.array(own["many"])[slot]})
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)


def look_up(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """keys (key: long) -> key, part, place, many of those that the index holds; each key once."""
    asked = keys.select("key").distinct().select("key", _bucket(buckets)).groupBy("bucket").agg(F.collect_list("key").alias("keys"))
    return index.join(asked, "bucket").mapInArrow(_look, "key bigint, part bigint, place bigint, many bigint")


def open_shard(folder: str, name: str):
    """(file, bytes of an id, documents, ids)"""
    filesystem, path = _fs(folder)
    file = filesystem.open_input_file(f"{path}/{name}")
    magic, _, width, documents, ids = FOOTER.unpack(file.read_at(FOOTER.size, file.size() - FOOTER.size))
    assert magic == MAGIC, f"{name} is no shard"
    return file, width, documents, ids


def _read(batches, folder: str):
    held, held_name = None, None
    for batch in batches:
        keys, (place, many) = batch.column(0).to_pylist(), (batch.column(k).to_numpy() for k in (2, 3))
        base, names = batch.column(5).to_numpy(), batch.column(4).to_pylist()
        rows = []
        for i, name in enumerate(names):
            if name != held_name:
                held, held_name = open_shard(folder, name), name
            file, width, documents, ids = held
            offsets = np.frombuffer(file.read_at(8 * (int(many[i]) + 1), width * ids + 8 * int(place[i])), dtype="<u8").astype(np.int64)
            raw = np.frombuffer(file.read_at(width * int(offsets[-1] - offsets[0]), width * int(offsets[0])), dtype=f"<u{width}")
            for a, z in zip(offsets[:-1], offsets[1:]):
                own = raw[a - offsets[0] : z - offsets[0]].astype("<u4")
                rows.append((keys[i], base[i] + a, z - a, zlib.crc32(own.tobytes())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(found: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """Documents at the places found: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    from pyspark.sql import Window

    shards = manifest.select("part", "file", "documents", "ids").distinct()  # one row per shard
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("part", "file", before.alias("base"))
    placed = found.join(shards, "part").select("key", "part", "place", "many", "file", "base")
    return placed.repartition("part").sortWithinPartitions("part", "place").mapInArrow(lambda b: _read(b, folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_table(docs: DataFrame, file: str, folder: str | None = None) -> DataFrame:
    """Write docs as shards with their index, then look every key up and read it back."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    manifest = write_shards(docs, folder, file)
    index, buckets = build_index(manifest)
    keys = docs.select(F.col("doc_id").cast("long").alias("key"))
    return read_back(look_up(keys, index, buckets), manifest, folder)
