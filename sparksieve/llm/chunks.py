"""Documents in chunks, and exchanges between chunks by key.

Operators that compare pieces of all texts (word windows, byte strings, contexts)
work on chunks: runs of documents of a few MB, packed once and kept in the shared
checkpoint folder.  An exchange then takes three steps.

1. Each chunk reduces what it holds to one sorted, distinct list of keys for each
   bucket of keys, so a key that is everywhere is sent once by a chunk.
2. Each bucket looks at the lists of all chunks and answers every list with one
   small block, in the order of that list.
3. The answers go back to their chunks, beside the chunk's texts.

Keys are spread by hash, buckets are as many as shuffle partitions, and nothing is
collected to the driver.  Lists are sent with their bytes in planes, the top byte of
all keys first: sorted keys have planes that the shuffle's compression makes small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shuffle_partitions

#: Bytes of text in a chunk, about.  More make an exchange smaller and its tasks larger.
CHUNK_BYTES = 8 << 20
#: Bytes of words that numpy hashes at a time (their arrays fit a cache).
SLICE_BYTES = 1 << 16
#: A null id compares as the largest.
NO_ID = np.iinfo(np.int64).max


class Texts:
    """Documents of a chunk: ids (int64), null ids (bool), and texts as one byte array with offsets."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, data: np.ndarray, offsets: np.ndarray, chunk: int = 0):
        self.ids, self.null, self.data, self.offsets, self.chunk = ids, null, data, offsets, chunk

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def id_list(self) -> list[int | None]:
        return [None if n else i for i, n in zip(self.ids.tolist(), self.null.tolist(), strict=True)]


def _pack(ids: list[pa.Array], texts: list[pa.Array]) -> bytes:
    batch = pa.table({"id": pa.chunked_array(ids, pa.int64()), "text": pa.chunked_array(texts, pa.large_binary())}).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes, chunk: int = 0) -> Texts:
    got = pa.ipc.open_stream(payload).read_all().combine_chunks()
    ids, text = got["id"].chunk(0) if got["id"].num_chunks else pa.array([], pa.int64()), got["text"].chunk(0) if got["text"].num_chunks else pa.array([], pa.large_binary())
    null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    all_data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), null, all_data[at[0] : at[-1]], at - at[0], chunk)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs(doc_id, text) -> (chunk long, payload binary), kept in the checkpoint folder; null texts are empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, size = TaskContext.get().partitionId() << 32, 0, 0
        ids, texts = [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([_pack(ids, texts)], pa.binary())], ["chunk", "payload"])

        for b in batches:
            text = b.column(1).cast(pa.large_binary())
            ends = np.cumsum(np.asarray(pa.compute.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False)))
            text, i = text.fill_null(b""), 0
            while i < len(b):
                done = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(ends, done + chunk_bytes - size, "right")))
                ids.append(b.column(0)[i:j])
                texts.append(text[i:j])
                size += int(ends[min(j, len(b)) - 1]) - done
                i = j
                if size >= chunk_bytes or i < len(b):
                    yield out()
                    n, size, ids, texts = n + 1, 0, [], []
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(rows.mapInArrow(pack, "chunk long, payload binary"))


def planes(values: np.ndarray, keep: int = 8) -> bytes:
    """The top `keep` bytes of unsigned integers, as byte planes, the top byte of all first."""
    wide = values.dtype.itemsize
    rows = values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, wide)
    return np.ascontiguousarray(rows[:, : min(keep, wide)].T).tobytes()


def unplanes(blob: bytes | memoryview, dtype: type, keep: int = 8) -> np.ndarray:
    wide = np.dtype(dtype).itemsize
    keep = min(keep, wide)
    rows = np.zeros((len(blob) // keep, wide), np.uint8)
    rows[:, :keep] = np.frombuffer(blob, np.uint8).reshape(keep, -1).T
    return rows.view(np.dtype(dtype).newbyteorder(">")).ravel().astype(dtype)


def bucket_edges(n: int) -> np.ndarray:
    """Where n equal ranges of 64-bit keys begin, without the first."""
    return np.array([(k << 64) // n for k in range(1, n)], np.uint64)


def split_sorted(keys: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the n buckets in sorted 64-bit keys."""
    return np.concatenate([[0], np.searchsorted(keys, bucket_edges(n)), [len(keys)]])


#: One chunk's answers to each question asked before: the answer's bytes by bucket.
Answers = list[dict[int, bytes]]
Emit = Callable[[Texts, Answers], Iterator[tuple[int, bytes]]]
Reply = Callable[[list[bytes]], list[bytes]]
Finish = Callable[[Texts, Answers], Iterator[pa.RecordBatch]]

ASKED = "bucket int, chunk long, blob binary"


def _beside(chunks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    joined = chunks.select("chunk", "payload")
    for i, a in enumerate(answers):
        joined = joined.join(a.withColumnRenamed("answers", f"answers{i}"), "chunk", "left")
    return joined


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Texts, Answers]]:
    for b in batches:
        for i in range(len(b)):
            got = [{x["bucket"]: x["blob"] for x in column[i].as_py() or []} for column in b.columns[2:]]
            chunk = b.column(0)[i].as_py()
            yield chunk, unpack(b.column(1)[i].as_buffer(), chunk), got


def ask(chunks: DataFrame, answers: list[DataFrame], emit: Emit) -> DataFrame:
    """(bucket, chunk, blob): what each chunk asks of each bucket, knowing the answers to earlier questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts, got in _each(batches):
            asked = list(emit(texts, got))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in asked], pa.int32()), pa.array([chunk] * len(asked), pa.int64()), pa.array([x for _, x in asked], pa.binary())], ["bucket", "chunk", "blob"])

    return _beside(chunks, answers).mapInArrow(run, ASKED)


def answer(asked: DataFrame, reply: Reply, n: int) -> DataFrame:
    """(chunk, answers array<struct<bucket, blob>>): each bucket's blobs together give one answer each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, chunk, blob = [], [], []
        for b in batches:
            bucket += b.column(0).to_pylist()
            chunk += b.column(1).to_pylist()
            blob += b.column(2).to_pylist()
        for k in sorted(set(bucket)):
            own = [i for i, x in enumerate(bucket) if x == k]
            got = reply([blob[i] for i in own])
            for i in own:
                blob[i] = b""
            yield pa.RecordBatch.from_arrays([pa.array([chunk[i] for i in own], pa.int64()), pa.array([k] * len(own), pa.int32()), pa.array(got, pa.binary())], ["chunk", "bucket", "blob"])

    replies = asked.repartitionById(n, "bucket").mapInArrow(run, "chunk long, bucket int, blob binary")
    return replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))


def finish(chunks: DataFrame, answers: list[DataFrame], done: Finish, schema: str) -> DataFrame:
    """The rows that `done` makes of each chunk and the answers to its questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, got in _each(batches):
            yield from done(texts, got)

    return _beside(chunks, answers).mapInArrow(run, schema)


def buckets(df: DataFrame) -> int:
    return shuffle_partitions(df.sparkSession)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit integers whose output bits look independent."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, cuts: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes of several texts that begin and end at `cuts`."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~outside[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = cuts[:-1]
    first = first[first < len(data)]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = cuts[1:] - 1
    last = last[last >= 0]
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of byte strings data[starts:ends]: a sum over bytes of mixed (byte, place in the string), mixed with the length."""
    out, length = np.zeros(len(starts), np.uint64), ends - starts
    upto, i = np.cumsum(length), 0
    while i < len(starts):
        done = int(upto[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(upto, done + SLICE_BYTES, "right")))
        own = length[i:j]
        first = upto[i:j] - own - done
        place = np.arange(int(own.sum()), dtype=np.int64) - np.repeat(first, own)
        byte = data[place + np.repeat(starts[i:j], own)]
        mixed = mix64((place.astype(np.uint64) << np.uint64(8) | byte) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        out[i:j] = mix64(np.add.reduceat(mixed, first) + own.astype(np.uint64))
        i = j
    return out


def chunk_words(texts: Texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, and for each document where its words begin (one more at the end)."""
    starts, ends = words_of(texts.data, texts.offsets)
    data = lower_ascii(texts.data) if lower else texts.data
    return hash_words(data, starts, ends, 0x5EED), np.searchsorted(starts, texts.offsets)


def shingle_hashes(word: np.ndarray, begin: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles, and where each text's begin; word: hashes of words, begin: where each text's words begin, both with one more at the end.

    A text with fewer words than a shingle has one of all of them; one without words has none.
    """
    n = np.diff(begin)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    at = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(begin[:-1], count)
    end = np.repeat(begin[1:], count)
    total = np.zeros(len(at), np.uint64)
    for t, m in enumerate(multipliers(shingle, 4)):
        total += np.where(at + t < end, word[np.minimum(at + t, max(0, len(word) - 1))] * m, np.uint64(t)) if len(word) else np.uint64(0)
    return mix64(total), first


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers for sums of hashes."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)
