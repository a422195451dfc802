"""Canonical length-limited Huffman coding of token ids.

Global counts of ids (as many rows as the vocabulary) give code lengths by package-merge, at most
`limit` bits; codes are canonical, so a header of lengths is enough. A file of the format is a Parquet
table of independent blocks in ascending order of document id: first and last ids, lengths of the
documents, the payload, and the bit offset of every STEP-th id. Decoding looks up `limit` bits at a
time in a table, in all stretches between checkpoints at once."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm import textkit
from sedimenta.llm.encode import encoder, tokenizer_path
from sedimenta.llm.shared import partitions, shared_dir, stored

STEP = 256
LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits, 0 where the count is 0 (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    w = counts[order].astype(np.float64)
    levels, row, leaf = [], w, np.ones(len(w), bool)
    levels.append(leaf)
    for _ in range(limit - 1):
        paired = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        row = np.concatenate([w, paired])
        by = np.argsort(row, kind="stable")
        row, leaf = row[by], (np.arange(len(row)) < len(w))[by]
        levels.append(leaf)
    take, n = 2 * len(w) - 2, np.zeros(len(w), np.int64)
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        n[:k] += 1
        take = 2 * (take - k)
    out[order] = n
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    n = np.bincount(lengths, minlength=1)
    for bits in range(1, len(n)):
        code <<= bits - last
        ids = np.flatnonzero(lengths == bits)
        codes[ids] = code + np.arange(len(ids))
        code, last = code + len(ids), bits
    return codes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(payload, bit offset of each STEP-th id); codes have at most 24 bits."""
    n = lengths[ids].astype(np.int64)
    if not len(n):
        return b"", np.zeros(0, np.int64)
    at = np.cumsum(n) - n
    total = int(at[-1] + n[-1])
    value = codes[ids].astype(np.uint64) << (np.uint64(32) - (n + (at & 7)).astype(np.uint64))
    byte = at >> 3
    size = (total + 7) // 8 + 4
    out = np.zeros(size, np.uint8)
    for k in range(4):
        part = (value >> np.uint64(24 - 8 * k)) & np.uint64(255)
        out += np.bincount(byte + k, weights=part, minlength=size)[:size].astype(np.uint8)
    return out[: (total + 7) // 8].tobytes(), at[::STEP]


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, code length) by the next `width` bits."""
    width = int(lengths.max(initial=1))
    codes = canonical(lengths)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    run = np.int64(1) << (width - lengths[ids].astype(np.int64))
    sym = np.zeros(1 << width, np.uint32)
    num = np.zeros(1 << width, np.uint8)
    begin = codes[ids].astype(np.int64) << (width - lengths[ids].astype(np.int64))
    where = textkit.ragged(begin, run)
    sym[where], num[where] = np.repeat(ids, run), np.repeat(lengths[ids], run)
    return sym, num, width


def decode_block(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    sym, num, width = table
    buf = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    word = (buf[:-3] << 24) | (buf[1:-2] << 16) | (buf[2:-1] << 8) | buf[3:]
    lanes = len(checkpoints)
    pos = np.asarray(checkpoints, np.int64).copy()
    out = np.zeros((STEP, lanes), np.uint32)
    shift = np.uint32(32 - width)
    most = len(word) - 1
    for i in range(min(STEP, n)):
        w = (word[np.minimum(pos >> 3, most)] << (pos & 7).astype(np.uint32)) >> shift
        out[i] = sym[w]
        pos += num[w]
    return out.T.reshape(-1)[:n]


def tokens(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks (_part, _seq, ids of documents, their lengths, token ids as little-endian 32-bit) in ascending order."""

    def run(batches):
        from pyspark import TaskContext

        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in textkit.slices(batch, "text"):
                ids, offs = enc(b.column(1), end)
                small = ids.max(initial=0) < 1 << 16
                yield pa.record_batch(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(offs).tolist()], pa.list_(pa.int64())), pa.array([small], pa.bool_()), pa.array([ids.astype("<u2" if small else "<u4").tobytes()], pa.binary())],
                    ["_part", "_seq", "doc_ids", "n", "small", "ids"],
                )
                seq += 1

    order = [F.col("id"), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(partitions(docs), *order[:2]).sortWithinPartitions(*order)
    return rows.mapInArrow(run, "_part int, _seq int, doc_ids array<long>, n array<long>, small boolean, ids binary")


def _ids(small: bool, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if small else "<u4").astype(np.uint32)


def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end: int = 2, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes documents and writes the file at `path` (in the shared folder, where none is given); returns the path.

    A null or empty text is the one id `end`; a null id sorts first; repeated ids follow each other; an
    empty table gives a file without blocks. Other columns are ignored. The file has two tables: `code`
    (id, length) and `blocks`."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tables/huffman-{uuid.uuid4().hex}"
    blocks = stored(tokens(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), end, id_col, text_col), "tokens")

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for small, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.bincount(_ids(small, raw))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = blocks.select("small", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the vocabulary has ids
    counts = np.zeros(int(max(found.column(0).to_pylist(), default=0)) + 1, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    lengths = code_lengths(counts, limit)
    codes = canonical(lengths)
    shared = spark.sparkContext.broadcast((lengths, codes))

    def squeeze(batches):
        lengths, codes = shared.value
        for b in batches:
            for part, seq, docs_, n, small, raw in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                ids = _ids(small, raw)
                payload, marks = encode_block(ids, lengths, codes)
                yield pa.record_batch(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([docs_], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([marks.tolist()], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                    ["part", "seq", "n_ids", "doc_ids", "n", "marks", "payload"],
                )

    blocks.mapInArrow(squeeze, "part int, seq int, n_ids long, doc_ids array<long>, n array<long>, marks array<long>, payload binary").write.parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used), "length": pa.array(lengths[used].astype(np.int32))}) if len(used) else [], "id long, length int").coalesce(1).write.parquet(f"{path}/code")
    return path


def read(spark: SparkSession, path: str, digest=None, out: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a file, or with digest(ids) of type `out` in
    place of ids; start counts the ids of all documents before it."""
    code = spark.read.parquet(f"{path}/code").toArrow()
    lengths = np.zeros(int(max(code.column(0).to_pylist(), default=0)) + 1, np.uint8)
    lengths[code.column(0).to_numpy()] = code.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # one row for each part of the file
    parts = sizes.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    within = blocks.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("_in"))
    base = within.join(F.broadcast(parts), "part").select("part", "seq", (F.col("_base") + F.col("_in")).alias("base"))
    digest = digest or (lambda ids: ids.astype(np.int64).tolist())

    def expand(batches):
        table = decoding_table(shared.value)
        for b in batches:
            for first, n_ids, docs_, n, marks, payload in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                ids = decode_block(payload, np.array(marks, np.int64), n_ids, table)
                n = np.array(n, np.int64)
                offs = np.concatenate([[0], np.cumsum(n)])
                yield pa.record_batch([pa.array(docs_, pa.int64()), pa.array(first + offs[:-1]), pa.array(n), pa.array([digest(ids[a:z]) for a, z in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.int64() if out else pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", "ids"])

    rows = blocks.join(base, ["part", "seq"]).select("base", "n_ids", "doc_ids", "n", "marks", "payload")
    return rows.mapInArrow(expand, f"doc_id long, start long, n_tokens long, ids {out or 'array<long>'}")


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
