"""Token counts without ids: pieces once per distinct pre-token, times its frequency in each document.

Pass one gathers the distinct pre-tokens of the corpus and how often they occur; the library counts the
pieces of each once. Pass two sums, per document, pieces times frequency: the most frequent pre-tokens
(at most HEAD of them, 16 bytes each) stand in a broadcast table, and all others go to their counts by
a shuffle join. Pre-tokens are told apart by 64-bit hashes; but for a collision of two, both ways are exact.
Texts of ordinary characters are split with array operations, those with others (beyond Latin Extended-A,
controls, `<|`) by the library's normaliser and splitter, and then take the same way. Only a text that
holds an added token's string is counted by the library whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import textkit
from sedimenta.llm.encode import _N, _SPACE, _L, _LINE, _after, _tokenizer, classes, odd_texts, tokenizer_path
from sedimenta.llm.shared import lean, stored

HEAD = 1 << 20
FLUSH = 400_000
"""Pre-tokens, as Arrow rows, that a worker holds before it gives them on."""
_BANNED = (b"<|", b"\xc2\x85", b"\xc2\xa0", b"\xc4\xb0")
_libs: dict = {}
_added: dict[int, list[str]] = {}


def _lib(path: str):
    if path not in _libs:
        _libs[path] = _tokenizer(path)
    return _libs[path]


def pretokens(data: np.ndarray, offs: np.ndarray, odd: np.ndarray):
    """(starts, ends, doc) of `'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`, in texts that aren't odd."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    cls = classes(data)
    start = np.ones(n, bool)
    start[1:] = cls[1:] != cls[:-1]
    start |= (cls == _N) & ((data & 0xC0) != 0x80)
    head = offs[:-1][offs[:-1] < n]
    start[head] = True
    at = np.flatnonzero((data == 39) & start)
    if len(at):
        end = offs[np.searchsorted(offs, at, "right")]
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b = pad[at + 1] | 32, pad[at + 2] | 32
        one = (at + 1 < end) & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (at + 2 < end) & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        letter = np.concatenate([cls == _L, np.zeros(4, bool)])
        one &= letter[at + 1]
        two &= letter[at + 1] & letter[at + 2]
        for ok, k in ((one, 2), (two, 3)):
            start[at[ok] + 1] = False
            nxt = at[ok] + k
            start[nxt[nxt < end[ok]]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    doc = np.searchsorted(offs, starts, "right") - 1
    keep = (cls[starts] != _SPACE) & (cls[starts] != _LINE) & ~odd[doc]
    return starts[keep], ends[keep], doc[keep]


def _pieces(lib, text: str) -> list[str] | None:
    """The normalised pre-tokens of any text as the library splits it; None if an added token stands in it."""
    if id(lib) not in _added:
        _added[id(lib)] = [t.content for t in lib.get_added_tokens_decoder().values()]
    if any(t in text for t in _added[id(lib)]):
        return None
    plain = lib.normalizer.normalize_str(text) if lib.normalizer else text
    return [plain[a:z] for _, (a, z) in lib.pre_tokenizer.pre_tokenize_str(plain)]


def _split(col: pa.Array, lib):
    """(bytes, texts to be counted whole, starts, ends, text and hash of each pre-token)."""
    data, offs = textkit.utf8(col)
    odd = odd_texts(data, offs, False, _BANNED)
    starts, ends, doc = pretokens(data, offs, odd)
    more, owner = [], []
    for i in np.flatnonzero(odd).tolist():
        own = _pieces(lib, col[i].as_py())
        if own is not None:
            odd[i] = False
            more += [p.encode() for p in own]
            owner += [i] * len(own)
    if more:
        size = np.array([len(p) for p in more], np.int64)
        at = len(data) + np.cumsum(size)
        data = np.concatenate([data, np.frombuffer(b"".join(more), np.uint8)])
        starts, ends, doc = np.concatenate([starts, at - size]), np.concatenate([ends, at]), np.concatenate([doc, np.array(owner, np.int64)])
    return data, odd, starts, ends, doc, textkit.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)


def _distinct(h: np.ndarray):
    """(sorted distinct, an index of each, index into them of each hash)."""
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return s[new], order[new], which


def piece_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(h, occurrences, pieces) of every distinct pre-token."""

    def gather(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def merged():
            t = pa.Table.from_batches(held).combine_chunks()
            uniq, rep, which = _distinct(t.column("h").to_numpy().view(np.uint64))
            n = np.zeros(len(uniq), np.int64)
            np.add.at(n, which, t.column("n").to_numpy())
            return pa.record_batch([pa.array(uniq.view(np.int64)), t.column("piece").combine_chunks().take(pa.array(rep)), pa.array(n)], ["h", "piece", "n"])

        def parts(b):
            return (b.slice(i, 20_000) for i in range(0, b.num_rows, 20_000))

        lib = _lib(path)
        for batch in batches:
            for b in textkit.slices(batch, "text"):
                data, _, starts, ends, _, h = _split(b.column(0), lib)
                uniq, rep, which = _distinct(h)
                at, length = starts[rep], ends[rep] - starts[rep]
                offs = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                piece = pa.StringArray.from_buffers(len(rep), pa.py_buffer(offs), pa.py_buffer(data[textkit.ragged(at, length)]))
                held.append(pa.record_batch([pa.array(uniq.view(np.int64)), piece, pa.array(np.bincount(which, minlength=len(uniq)))], ["h", "piece", "n"]))
                size += len(uniq)
                if size > FLUSH:
                    held = [merged()]
                    size = held[0].num_rows
                    if size > FLUSH // 2:
                        yield from parts(held[0])
                        held, size = [], 0
        if held:
            yield from parts(merged())

    def count(batches):
        """Rows sorted by hash: those of one are summed, and its pieces counted."""
        lib = _lib(path)
        last: list[pa.RecordBatch] = []

        def counted(s, n):
            e = lib.encode(s.column(1).to_pylist(), is_pretokenized=True, add_special_tokens=False)
            k = np.bincount(np.array(e.word_ids, np.int64), minlength=s.num_rows)
            return pa.record_batch([s.column(0), pa.array(n), pa.array(k)], ["h", "n", "k"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*last, b]).combine_chunks()
            h = t.column(0).to_numpy()
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.add.reduceat(t.column(2).to_numpy(), start)
            s = pa.record_batch([t.column(c).combine_chunks().take(pa.array(start)) for c in range(2)] + [pa.array(n)], b.schema)
            last = [s.slice(len(n) - 1)]
            for i in range(0, len(n) - 1, 20_000):
                m = min(20_000, len(n) - 1 - i)
                yield counted(s.slice(i, m), n[i : i + m])
        for s in last:
            yield counted(s, s.column(2).to_numpy())

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(gather), "h long, piece string, n long")
    return stored(found.repartition("h").sortWithinPartitions("h").mapInArrow(lean(count), "h long, n long, k long"), "pretokens")


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), a row for each row of docs.

    A null or empty text has 0 bytes and 0 tokens. Null and repeated ids keep their rows. Other columns
    are ignored; an empty table gives none."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    known = piece_counts(docs, path, text_col)
    sizes = dict(known.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect())  # 63 rows at most
    least, total = 63, 0
    for e in range(62, -1, -1):
        total += sizes.get(e, 0)
        if total > HEAD:
            break
        least = e
    head = known.where(F.floor(F.log2("n")).cast("int") >= least).select("h", "k").toArrow()  # HEAD rows at most
    keys = head.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], head.column(1).to_numpy()[order]))

    def frequencies(batches):
        from pyspark import TaskContext

        keys, k = shared.value
        row = TaskContext.get().partitionId() << 40
        lib = _lib(path)
        for batch in batches:
            for b in textkit.slices(batch, "text"):
                _, odd, _, _, doc, h = _split(b.column(1), lib)
                uniq, _, which = _distinct(h)
                pos = np.minimum(np.searchsorted(keys, uniq), max(len(keys) - 1, 0))
                hit = keys[pos] == uniq if len(keys) else np.zeros(len(uniq), bool)
                n = np.zeros(len(uniq), np.int64)
                n[hit] = k[pos[hit]]
                total = np.bincount(doc, weights=n[which], minlength=b.num_rows).astype(np.int64)
                slow = np.flatnonzero(odd)
                if len(slow):
                    total[slow] = [len(x) for x in lib.encode_batch([b.column(1)[int(i)].as_py() for i in slow], add_special_tokens=False)]
                rare = ~hit[which]
                d, key = doc[rare], which[rare]
                pair, freq = np.unique(d * max(len(uniq), 1) + key, return_counts=True)
                d, key = pair // max(len(uniq), 1), uniq[pair % max(len(uniq), 1)]
                cut = np.searchsorted(d, np.arange(b.num_rows + 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(freq.astype(np.int64))], ["h", "f"]))
                yield pa.record_batch([pa.array(row + np.arange(b.num_rows)), b.column(0), pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64()), pa.array(total), tail], ["row", "id", "n_bytes", "known", "tail"])
                row += b.num_rows

    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(frequencies), f"row long, id {kind}, n_bytes long, known long, tail array<struct<h:long,f:long>>"), "frequencies")
    tail = rows.select("row", F.inline("tail")).join(known.where(F.floor(F.log2("n")).cast("int") < least).select("h", "k"), "h")
    more = tail.groupBy("row").agg(F.sum(F.col("k") * F.col("f")).alias("more"))
    n = F.col("known") + F.coalesce("more", F.lit(0))
    return rows.join(more, "row", "left").select(F.col("id").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
