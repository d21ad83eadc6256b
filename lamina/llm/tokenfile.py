"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

Format. A table of blocks in ascending document order. A block holds: the SHA-256 of the dictionary, its
part and number in the part, ids in the part before it, the document ids (int64), their numbers of ids, the end
offset of each document's frame (both uint32) and the frames. A frame is the document's ids as
little-endian uint16 (uint32 if a larger id may occur), compressed by itself with the dictionary, so one
short document can be read by its block's index alone. The dictionary is a table of one row beside it.

The dictionary is trained on a bounded sample of serialized id arrays: at most `dict_docs` documents
taken by a hash of doc_id, of each at most `dict_ids` ids from a hashed place on; it decides sizes only, never contents.

Null texts count as empty (only the end id); rows with a null doc_id come first; repeated ones are kept
side by side. Extra columns are not read. An empty table gives an empty file set.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, tables, words

BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20


class WordBpe(bpe.LatinBpe):
    """A lower-casing tokenizer that drops white space: runs of letters, single digits, runs of other signs."""

    drops_space = True
    last_lead = 0xC3

    def __init__(self, path: str):
        model = self._load(path)
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [(vocab[x], vocab[y], vocab[x.removesuffix(end) + y]) for x, y in model["merges"]]
        self.merger = bpe.Merger(merges, *([vocab[c + e] for c in bpe.byte_alphabet()] for e in ("", end)))

    def fold(self, raw: np.ndarray) -> np.ndarray:
        low = words.LOWER[raw]
        at = np.flatnonzero(raw[:-1] == 0xC3) + 1
        at = at[(raw[at] >= 0x80) & (raw[at] <= 0x9E) & (raw[at] != 0x97)]
        low[at] += 0x20
        return low

    def bounds(self, raw, cls, edge, offsets):
        edge[:-1][cls == bpe.DIGIT] = True
        bpe.contractions(raw, cls, edge, offsets)


def train_dictionary(docs: DataFrame, path: str, *, dict_docs: int = 2000, dict_ids: int = 2000, size: int = 32 << 10) -> bytes:
    """A zstandard dictionary from a bounded sample, made in one task; b"" if the sample is too small.

    Of each sampled text a window of 20 * dict_ids characters is taken that begins at a hashed place of the whole text.
    """
    text, hashed = F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    begin = (1 + F.pmod(F.xxhash64("doc_id"), F.greatest(F.length(text) - 20 * dict_ids, F.lit(0)).cast("long") + 1)).cast("int")
    wide = docs.select(hashed.alias("h"), F.substring(text, begin, F.lit(20 * dict_ids)).alias("text")).filter("text is not null")
    share = docs.select("doc_id").count()
    if share > dict_docs:
        wide = wide.filter(F.col("h") < int((1 << 32) * dict_docs / share))
    sample = wide.orderBy("h").limit(dict_docs).select("text").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, arrays = bpe.encoder(WordBpe, path), []
        for batch in batches:
            ids, ends = enc.encode_column(batch.column(0))
            arrays += [x[:dict_ids].astype("<u2").tobytes() for x in np.split(ids, ends[:-1])]
        # too few ids have no dictionary; else a failure is an error
        made = zstandard.train_dictionary(min(size, sum(map(len, arrays)) // 8), arrays, level=3).as_bytes() if len(arrays) >= 16 and sum(map(len, arrays)) >= 1 << 16 else b""
        yield pa.RecordBatch.from_pydict({"d": pa.array([made], pa.binary())})

    got = sample.mapInArrow(run, "d binary").collect()  # one row of at most `size` bytes
    return bytes(got[0].d) if got else b""


def write(docs: DataFrame, path: str, out: str, *, end_id: int = 2, partitions: int | None = None, **dictionary) -> None:
    """Encode every whole text, append end_id, and write blocks and dictionary under `out`.

    One shuffle deals documents by ranges of doc_id; a range is sorted and encoded as a stream.
    """
    spark = docs.sparkSession
    tables.small_batches(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    trained = train_dictionary(docs, path, **dictionary)
    sha = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(sha, bytearray(trained))], "sha string, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = bpe.encoder(WordBpe, path)
        kw = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
        zip_ = zstandard.ZstdCompressor(level=3, **kw)
        width = "<u2" if enc.tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        end = np.array([end_id], width).tobytes()
        part, start, number = TaskContext.get().partitionId(), 0, 0
        names, counts, frames, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "sha": pa.array([sha]), "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "start": pa.array([start], pa.int64()),
                "ids": pa.array([sum(counts)], pa.int64()), "first_doc": pa.array([names[0]], pa.int64()), "last_doc": pa.array([names[-1]], pa.int64()), "width": pa.array([int(width[2])], pa.int32()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())), "counts": pa.array([np.array(counts, "<u4").tobytes()], pa.binary()),
                "ends": pa.array([np.cumsum([len(f) for f in frames]).astype("<u4").tobytes()], pa.binary()), "frames": pa.array([b"".join(frames)], pa.binary()),
            })

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                piece = batch.slice(i, 1000)
                flat, ends = enc.encode_column(piece.column(1))
                flat = flat.astype(width)
                for name, ids in zip(piece.column(0).to_pylist(), np.split(flat, ends[:-1]), strict=True):
                    frame = zip_.compress(ids.tobytes() + end)
                    names.append(name)
                    counts.append(len(ids) + 1)
                    frames.append(frame)
                    size += len(frame)
                    if len(names) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                        yield block()
                        start, number = start + sum(counts), number + 1
                        names, counts, frames, size = [], [], [], 0
        if names:
            yield block()

    n = partitions or tables.shuffle_partitions(spark)
    schema = "sha string, part int, number int, start long, ids long, first_doc long, last_doc long, width int, doc_ids array<long>, counts binary, ends binary, frames binary"
    docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{out}/blocks")


def read(spark: SparkSession, out: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before it over all files), n_tokens, ids_crc32 and, with with_ids, ids of each document."""
    trained = bytes(spark.read.parquet(f"{out}/dictionary").first().dictionary)
    sha = hashlib.sha256(trained).hexdigest()
    blocks = spark.read.parquet(f"{out}/blocks")
    # ids before each part: one row a part, so the running sum is over as many rows as there are files
    ids = {r.part: r.ids for r in blocks.groupBy("part").agg(F.sum("ids").alias("ids")).collect()}
    before, total = {}, 0
    for part in sorted(ids):
        before[part], total = total, total + ids[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        kw = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
        unzip = zstandard.ZstdDecompressor(**kw)
        for batch in batches:
            for b in batch.to_pylist():
                if b["sha"] != sha:
                    raise ValueError("a block was written with another dictionary")
                counts, ends = np.frombuffer(b["counts"], "<u4").astype(np.int64), np.frombuffer(b["ends"], "<u4").astype(np.int64)
                crcs, all_ids = [], []
                for s, e, n in zip([0, *ends[:-1].tolist()], ends.tolist(), counts.tolist(), strict=True):
                    x = np.frombuffer(unzip.decompress(b["frames"][s:e], max_output_size=n * b["width"]), f"<u{b['width']}").astype("<u4").tobytes()
                    crcs.append(zlib.crc32(x))
                    if with_ids:
                        all_ids.append(x)
                starts = before[b["part"]] + b["start"] + np.cumsum(counts) - counts
                got = {"doc_id": pa.array(b["doc_ids"], pa.int64()), "start": pa.array(starts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crcs, pa.int64())}
                yield pa.RecordBatch.from_pydict(got | ({"ids": pa.array(all_ids, pa.binary())} if with_ids else {}))

    return blocks.select("sha", "part", "start", "width", "doc_ids", "counts", "ends", "frames").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each of its rows): only blocks whose range holds it are read, and only its own frames are decompressed."""
    import zstandard

    trained = bytes(spark.read.parquet(f"{out}/dictionary").first().dictionary)
    unzip = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}))
    at = F.array_position("doc_ids", F.lit(doc_id).cast("long"))
    blocks = spark.read.parquet(f"{out}/blocks").filter((F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id)) & (F.col("last_doc") >= doc_id) & (at > 0))
    found = []
    for b in blocks.orderBy("part", "number").toLocalIterator():
        if b.sha != hashlib.sha256(trained).hexdigest():
            raise ValueError("a block was written with another dictionary")
        counts, ends = np.frombuffer(b.counts, "<u4"), [0, *np.frombuffer(b.ends, "<u4").tolist()]
        for i, name in enumerate(b.doc_ids):
            if name == doc_id:
                found.append(np.frombuffer(unzip.decompress(b.frames[ends[i] : ends[i + 1]], max_output_size=int(counts[i]) * b.width), f"<u{b.width}").astype("<u4"))
    return found
