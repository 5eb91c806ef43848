"""Token ids of documents in binary files: canonical length-limited Huffman codes from global counts.

A run is a folder of the shared file system:

* ``codebook``: ``GLHC``, version, limit, the number of symbols, then a code length (one byte) for each;
* ``part-NNNNN-NNNNN.glt``: ``GLTK``, version, counts of documents, ids and blocks, then int64 document keys, uint8 null marks of
  the keys, int64 ids per document, uint64 bit offsets of the blocks, the length of the bit stream, the stream.

Files follow each other in ascending document key (null first; equal keys by a hash of the text), and so do the documents
in them. A file is written under another name and renamed, so a task that is run again does no harm.

Stages: (1) encode every text and keep the ids, two bytes each, as a Parquet table in the shared folder; (2) count ids over
all of it and make the code (bounded by the vocabulary); (3) range-partition by key and write the files; (4) read them back.

Defined cases: null and empty texts give the end id alone; null keys are kept, first; repeated rows stay separate
documents; an empty table makes a codebook and no file; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import huffman
from .common import arrow, drop_path, scratch, table, written
from .tokencount import tokenizer
from .words import pieces, text_bytes
from .wordtable import WIDTH, WordTable, lanes

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that keeps a text from being cut into words: more than one together, and all but newline and tab.
BESIDE = ("  ", "\n ", " \n", "\t ", " \t", "\n\n", "\n\t", "\t\n")
ODD_SPACE = r"[\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words that a worker remembers: the first ones it meets, so the common ones are among them.
REMEMBERED = 1 << 19
#: Bytes of words, and characters of a text, that the library gets at once, about.
LIBRARY_BYTES, LIBRARY_CHARS = 1 << 16, 1 << 17
#: A place where the library always cuts: before a space between a printable character and a letter.
SAFE = re.compile(r"(?<=[!-~])(?= [A-Za-z])")
#: Ids in a file, about; tasks that write files, and that read them, at most.
FILE_IDS, MOST_PARTS, MOST_READERS = 4 << 20, 8192, 65536
#: What stands before a word: nothing, a space or a newline.
FIRST, SPACED, LINE = 0, 1, 2


class WordEncoder:
    """Token ids of texts by remembered words with the white space before them.

    Words are looked up in numpy for a whole batch. New ones go to the library end to end, each behind its space or newline, as
    such a place is always a border of pre-tokens; how many ids belong to each follows from the ids' byte lengths.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes that each id stands for; a byte-level vocabulary has a letter for each byte.
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, k in vocab.items():
            self.bytes[k] = len(piece)
        specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts that go to the library whole.
        self.whole = "|".join(["^[ \n\t]", "[ \n\t]$", "\\x00", ODD_SPACE, *BESIDE, *map(re.escape, specials)])
        self.cuts = not any(SAFE.search(s) for s in specials)
        self.known = WordTable(REMEMBERED)
        self.size, self.start, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def by_library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def whole_text(self, text: str) -> np.ndarray:
        """The ids of a text that isn't cut into words; a long one goes in parts, cut where the library cuts anyway."""
        out, at = [], 0
        while at < len(text):
            cut = SAFE.search(text, at + LIBRARY_CHARS) if self.cuts else None
            end = cut.start() if cut else len(text)
            out.append(self.by_library(text[at:end]))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint16)

    def new_words(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and the number of ids of each."""
        ids, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int32)]
        ends = np.cumsum(size + 1)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LIBRARY_BYTES, "right")))
            n = size[i:j] + 1
            begin = np.cumsum(n) - n
            text = raw[np.arange(int(n.sum())) + np.repeat(start[i:j] - 1 - begin, n)]
            text[begin] = np.where(kind[i:j] == SPACED, 32, 10)
            found = self.by_library(text.tobytes().decode())
            last = np.searchsorted(np.cumsum(self.bytes[found]), begin + n)
            many = np.diff(last + 1, prepend=0)
            lead = np.flatnonzero(kind[i:j] == FIRST)  # a text's first word has no newline before it
            found = np.delete(found, (np.cumsum(many) - many)[lead])
            many[lead] -= 1
            ids.append(found)
            sizes.append(many.astype(np.int32))
            i = j
        return np.concatenate(ids), np.concatenate(sizes)

    def by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that can be cut into words, and the number of ids of each."""
        raw, offsets = text_bytes(texts)
        raw = np.concatenate([np.zeros(1, np.uint8), raw, np.zeros(WIDTH, np.uint8)])
        offsets = offsets + 1
        inner = raw[1 : offsets[-1]]
        blank = np.flatnonzero((inner == 32) | (inner == 10)) + 1
        # a word begins at each text's start and after each blank; the one that starts at a text's place comes first
        start = np.concatenate([offsets[:-1], blank + 1])
        end = np.concatenate([blank, offsets[1:]])
        kind = np.concatenate([np.zeros(len(texts), np.uint8), np.where(raw[blank] == 32, SPACED, LINE).astype(np.uint8)])
        order, end = np.argsort(start, kind="stable"), np.sort(end, kind="stable")
        start, kind = start[order], kind[order]
        size = end - start
        lane, tag = lanes(raw, start, size), (0x80 | kind << 5 | np.minimum(size, WIDTH + 1)).astype(np.uint8)
        row, _ = self.known.rows(lane, tag)
        row = row.astype(np.int64)
        row[size > WIDTH] = -1
        sizes, starts, flat = self.size, self.start, self.flat
        lacking = np.flatnonzero(row < 0)
        if len(lacking):
            short = lacking[size[lacking] <= WIDTH]
            once = WordTable(len(short))
            at, first = once.rows(lane[:, short], tag[short], add=True)
            row[short] = len(sizes) + at
            first = short[first]
            long = lacking[size[lacking] > WIDTH]
            named: dict[tuple[int, bytes], int] = {}
            for i in long:
                row[i] = len(sizes) + once.n + named.setdefault((int(kind[i]), raw[start[i] : end[i]].tobytes()), len(named))
            _, at = np.unique(row[long], return_index=True)
            every = np.concatenate([first, long[at]])
            ids, many = self.new_words(raw, start[every], size[every], kind[every])
            room = min(self.known.most - self.known.n, len(first))
            begin = len(flat) + np.cumsum(many) - many
            if room:
                kept, _ = self.known.rows(lane[:, first[:room]], tag[first[:room]], add=True)
                order = np.argsort(kept)
                self.start = np.concatenate([starts, begin[:room][order]])
                self.size, self.flat = np.concatenate([sizes, many[:room][order]]), np.concatenate([flat, ids[: int(many[:room].sum())]])
            starts = np.concatenate([starts, begin])
            sizes, flat = np.concatenate([sizes, many]), np.concatenate([flat, ids])
        per_word = sizes[row]
        ends = np.cumsum(per_word)
        place = np.repeat(starts[row] - (ends - per_word), per_word)
        place += np.arange(len(place))
        first_word = np.searchsorted(start, offsets[:-1])
        inside = np.concatenate([[0], ends])[np.concatenate([first_word, [len(start)]])]
        return flat[place], np.diff(inside)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and the number of ids of each."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        if not odd.any():
            ids, n = self.by_words(texts)
            return np.insert(ids, np.cumsum(n), end), n + 1
        parts: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            ids, n = self.by_words(texts.take(pa.array(plain)))
            for i, part in zip(plain, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                parts[i] = part
        for i in np.flatnonzero(odd):
            parts[i] = self.whole_text(texts[int(i)].as_py())
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.insert(np.concatenate(parts), np.cumsum(n), end), n + 1


_encoder: tuple[str, WordEncoder] | None = None


def encoder_of(path: str) -> WordEncoder:
    """This worker's encoder."""
    global _encoder
    if _encoder is None or _encoder[0] != path:
        _encoder = (path, WordEncoder(path))
    return _encoder[1]


def encoded(docs: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tie, n, ids): ids as little-endian uint16, with the end id. No shuffle."""
    kept = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(path)
        for b in batches:
            for p in pieces(b, 2, 1 << 19):
                ids, n = enc.encode(p.column(2), end)
                offsets = np.concatenate([[0], np.cumsum(n * 2)])
                raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(n), raw], names=["key", "tie", "n", "ids"])

    return arrow(kept, run, "key long, tie long, n long, ids binary")


def id_counts(coded: DataFrame, symbols: int) -> np.ndarray:
    """Global count by id. A task adds its own up first; what reaches the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(symbols, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=symbols)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    found = arrow(coded.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(symbols, np.int64)
    out[found.id.to_numpy()] = found.n.to_numpy()
    return out


def _put(path: str, data: bytes) -> None:
    """Write a file whole: under another name, then renamed."""
    where, inner = fs.FileSystem.from_uri(path)
    aside = f"{inner.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    where.create_dir(inner.rpartition("/")[0], recursive=True)
    with where.open_output_stream(aside) as f:
        f.write(data)
    where.move(aside, inner)


def _get(path: str) -> bytes:
    where, inner = fs.FileSystem.from_uri(path)
    with where.open_input_file(inner) as f:
        return f.read()


def pack_codebook(lengths: np.ndarray) -> bytes:
    return b"GLHC" + struct.pack("<HHI", 1, huffman.LIMIT, len(lengths)) + lengths.astype(np.uint8).tobytes()


def unpack_codebook(data: bytes) -> np.ndarray:
    version, limit, n = struct.unpack_from("<HHI", data, 4)
    if data[:4] != b"GLHC" or version != 1 or limit != huffman.LIMIT or len(data) != 12 + n:
        raise ValueError("not a codebook of version 1")
    return np.frombuffer(data, np.uint8, n, 12)


def pack_part(keys: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    stream, checkpoints = huffman.encode(ids, lengths, codes)
    head = b"GLTK" + struct.pack("<HxxQQQ", 1, len(keys), len(ids), len(checkpoints))
    return b"".join([head, keys.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), sizes.astype("<i8").tobytes(), checkpoints.astype("<u8").tobytes(), struct.pack("<Q", len(stream)), stream])


def unpack_part(data: bytes, decoder: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, null marks, sizes and ids of a file."""
    version, docs, n, blocks = struct.unpack_from("<HxxQQQ", data, 4)
    if data[:4] != b"GLTK" or version != 1:
        raise ValueError("not a token file of version 1")
    at = 32
    keys = np.frombuffer(data, "<i8", docs, at)
    nulls = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
    sizes = np.frombuffer(data, "<i8", docs, at := at + docs)
    checkpoints = np.frombuffer(data, "<u8", blocks, at := at + 8 * docs)
    (size,) = struct.unpack_from("<Q", data, at := at + 8 * blocks)
    stream = data[at + 8 : at + 8 + size]
    if len(stream) != size:
        raise ValueError("the file is cut short")
    return keys, nulls, sizes, huffman.decode(stream, checkpoints, n, decoder)


def write_tokens(docs: DataFrame, folder: str, path: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs' token files under folder; returns the manifest (part, file, path, docs, ids), itself a written table.

    Ranges of keys are tasks, MOST_PARTS of them at most, as what the driver samples for their borders grows with their number;
    a task writes as many files as its range needs, one after another.
    """
    spark = docs.sparkSession
    symbols = max(tokenizer(path).get_vocab_size(with_added_tokens=True), end + 1)
    if symbols > 1 << 16:
        raise ValueError("ids above 65535 aren't supported")
    kept = scratch(spark, "token-ids")
    encoded(docs, path, end, key, text).write.option("compression", "zstd").parquet(kept)
    coded = spark.read.parquet(kept)
    counts = id_counts(coded, symbols)
    lengths = huffman.code_lengths(counts)
    codes = huffman.canonical(lengths)
    book = spark.sparkContext.broadcast((lengths, codes))
    _put(f"{folder}/codebook", pack_codebook(lengths))
    parts = int(min(MOST_PARTS, max(1, -(-int(counts.sum()) // FILE_IDS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for p in pieces(b, 2, FILE_IDS // 2):
                held.append(p)
                size += p.column(2).nbytes // 2
                if size >= FILE_IDS:
                    yield put(part, file, held)
                    file, held, size = file + 1, [], 0
        if held:
            yield put(part, file, held)

    def put(part: int, file: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys = np.concatenate([b.column(0).fill_null(0).to_numpy() for b in held])
        nulls = np.concatenate([np.asarray(b.column(0).is_null()) for b in held])
        sizes = np.concatenate([b.column(1).to_numpy() for b in held])
        ids = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for b in held for x in b.column(2)])
        name = f"{folder}/part-{part:05d}-{file:05d}.glt"
        _put(name, pack_part(keys, nulls, sizes, ids, *book.value))
        return pa.RecordBatch.from_pydict({"part": [part], "file": [file], "path": [name], "docs": [len(keys)], "ids": [len(ids)]})

    ordered = coded.repartitionByRange(parts, F.col("key").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("key").asc_nulls_first(), "tie")
    manifest = written(arrow(ordered.select("key", "n", "ids"), run, "part long, file long, path string, docs long, ids long"), "token-manifest")
    drop_path(spark, kept)
    return manifest


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """From the files alone, per document: key, start, n_tokens, ids (binary, little-endian uint32).

    start counts the ids of all documents before it: running sums over the manifest, first over its parts, whose number is
    bounded, then over the files of each. Every file is a task's, however few bytes the manifest has.
    """
    earlier = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", earlier.alias("_parts"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("_files", F.coalesce(inside, F.lit(0))).join(F.broadcast(parts), "part")  # MOST_PARTS rows at most
    files = files.repartition(max(1, min(manifest.count(), MOST_READERS)), "path").select("path", (F.col("_parts") + F.col("_files")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                decoder = decoder or huffman.table_of(unpack_codebook(_get(f"{folder}/codebook")))
                keys, nulls, sizes, ids = unpack_part(_get(path), decoder)
                ends = np.cumsum(sizes)
                for i in range(0, len(keys), 1000):
                    j = min(i + 1000, len(keys))
                    a, z = int(ends[i] - sizes[i]), int(ends[j - 1])
                    offsets = np.concatenate([[0], np.cumsum(sizes[i:j] * 4)]).astype(np.int64)
                    raw = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(ids[a:z].astype("<u4"))]).cast(pa.binary())
                    key = pa.array(keys[i:j], mask=nulls[i:j].astype(bool))
                    yield pa.RecordBatch.from_arrays([key, pa.array(base + ends[i:j] - sizes[i:j]), pa.array(sizes[i:j]), raw], names=["key", "start", "n_tokens", "ids"])

    return arrow(files, run, "key long, start long, n_tokens long, ids binary")


def token_output(docs: DataFrame, path: str, end: int = 2, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Write docs' ids to a new folder, read it back: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, folder, path, end, key, text)
    back = read_tokens(manifest, folder)
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of the token files of documents."""
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


