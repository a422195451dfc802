"""Best-fit packing by exact-complement hashing.

Pieces are packed by length alone. The histogram of lengths (at most `cap` numbers) goes to the driver;
there the sums of one, two and three lengths are indexed, each longest remaining length opens sequences, and
their gap is looked up in the index and filled exactly as often as the counts allow. What no combination
fills goes by best fit, longest first. The plan is a bounded list of patterns with multiplicities. Pieces
take their places by their rank among those of their length, found with two-level counts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm import textkit
from sedimenta.llm.encode import encoder, tokenizer_path
from sedimenta.llm.shared import stored


class Sums:
    """Sums of one, two and three available lengths, each with its combination of the largest first length.

    Counts only fall, so a combination that is used up stays so: a sum's entry moves on to the next one when
    it is met, down to none, and no other entry needs a change. The index is a few numbers for each sum."""

    def __init__(self, counts: np.ndarray):
        self.count: list[int] = counts.tolist()
        cap = len(counts) - 1
        two, three = np.zeros(cap + 1, np.int64), np.zeros(cap + 1, np.int64)
        have = np.flatnonzero(counts)
        for b in have.tolist():  # later ones are larger
            two[b + have[(have <= b) & (have + b <= cap) & ((have < b) | (counts[b] > 1))]] = b
        sums = np.flatnonzero(two)
        for a in have.tolist():
            three[a + sums[sums + a <= cap]] = a
        self.two: list[int] = two.tolist()
        self.three: list[int] = three.tolist()

    def _free(self, length: int, aside: tuple[int, ...]) -> int:
        return self.count[length] - aside.count(length)

    def _pair(self, total: int, aside: tuple[int, ...]) -> tuple[int, int] | None:
        b, dead = self.two[total], True
        while 2 * b >= total > 1:
            a = total - b
            least = 2 if a == b else 1
            if self._free(b, aside) >= least and self._free(a, aside) >= least:
                return b, a
            dead = dead and not (self.count[b] >= least and self.count[a] >= least)
            b -= 1
            if dead:
                self.two[total] = b if 2 * b >= total else 0
        return None

    def _triple(self, total: int, aside: tuple[int, ...]) -> tuple[int, int, int] | None:
        a, dead = self.three[total], True
        while 3 * a >= total > 2:
            if self._free(a, aside) > 0 and (two := self._pair(total - a, (*aside, a))):
                return a, *two
            dead = dead and not (self.count[a] and self.two[total - a])
            a -= 1
            if dead:
                self.three[total] = a if 3 * a >= total else 0
        return None

    def find(self, gap: int, aside: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """One, two or three available lengths with the sum `gap`, beside those put aside; large ones first."""
        if self._free(gap, aside) > 0:
            return (gap,)
        return self._pair(gap, aside) or self._triple(gap, aside)

    def take(self, lengths: tuple[int, ...]) -> int:
        """How often the combination can be had; it is taken so often."""
        times = {n: lengths.count(n) for n in lengths}
        m = min(self.count[n] // k for n, k in times.items())
        for n, k in times.items():
            self.count[n] -= k * m
        return m


def plan(histogram: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, number of such sequences)], with every piece once."""
    c = np.zeros(cap + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= cap:
            raise ValueError(f"length {length} is not in 1..{cap}")
        c[length] += n
    sums = Sums(c)
    out: list[tuple[tuple[int, ...], int]] = []
    left: list[tuple[int, int]] = []
    for length in range(cap, 0, -1):
        while n := sums.count[length]:
            rest = sums.find(cap - length, (length,)) if length < cap else ()
            if rest is None:
                left.append((length, n))
                sums.count[length] = 0
            else:
                out.append(((length, *rest), sums.take((length, *rest))))
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length, n in left:
        while n:
            gap = min((g for g in bins if g >= length), default=None)
            if gap is None:
                each = cap // length
                for times, m in ((each, n // each), (n % each, 1)):
                    if times and m:
                        bins.setdefault(cap - times * length, []).append(((length,) * times, m))
                break
            have, m = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
            each = gap // length
            full, some = min(m, n // each), 0
            if full:
                bins.setdefault(gap - each * length, []).append((have + (length,) * each, full))
                n -= full * each
            if full < m and 0 < n < each:
                bins.setdefault(gap - n * length, []).append((have + (length,) * n, 1))
                some, n = 1, 0
            if m > full + some:
                bins.setdefault(gap, []).append((have, m - full - some))
    return out + [x for b in bins.values() for x in b]


def places(patterns: list[tuple[tuple[int, ...], int]], cap: int) -> tuple[np.ndarray, ...]:
    """Sorted (length, first rank), with the first sequence and the offset of the run of ranks there."""
    rank = np.zeros(cap + 1, np.int64)
    rows, seq = [], 0
    for lengths, m in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, rank[n], seq, offset))
            rank[n] += m
            offset += n
        seq += m
    t = np.array(rows, np.int64).reshape(-1, 4)
    t = t[np.lexsort((t[:, 1], t[:, 0]))]
    return t[:, 0], t[:, 1], t[:, 2], t[:, 3]


def pieces(docs: DataFrame, path: str, cap: int, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, _part, _local) of every document with `end` after its ids;
    only documents of more than cap ids are cut, the first piece taking what is over."""

    def cut(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(cap + 1, np.int64)
        enc = encoder(path)
        for batch in batches:
            for b in textkit.slices(batch, "text"):
                ids, offs = enc(b.column(1), end)
                raw = memoryview(ids.astype("<u4").tobytes())
                n = np.diff(offs)
                parts = -(-n // cap)
                row = np.repeat(np.arange(len(n)), parts)
                piece = textkit.ragged(np.zeros(len(n), np.int64), parts)
                first = n - (parts - 1) * cap
                length = np.where(piece == 0, first[row], cap)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * cap)
                at = offs[:-1][row] + start
                crc = [zlib.crc32(raw[a * 4 : z * 4]) for a, z in zip(at.tolist(), (at + length).tolist())]
                order = np.argsort(length, kind="stable")
                s = length[order]
                local = np.empty(len(s), np.int64)
                local[order] = np.arange(len(s)) - np.searchsorted(s, s)
                local += seen[length]
                seen += np.bincount(length, minlength=cap + 1)
                yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(local)], ["id", "piece", "start", "length", "ids_crc32", "_part", "_local"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long, _part int, _local long")


def pack(docs: DataFrame, cap: int = 2048, end: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and offset.

    A null or empty text is the one id `end`. Repeated rows and ids are packed as often as they come; a
    null id stays null. An empty table gives none. Other columns are ignored."""
    table = stored(pieces(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), cap, end, id_col, text_col), "pieces")
    counts = table.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # cap rows at most
    base = counts.select("_part", "length", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_base"))
    spots = places(plan(histogram, cap), cap)
    key = (spots[0] << 40) | spots[1]

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            i = np.searchsorted(key, (length << 40) | rank, "right") - 1
            seq, off = (spots[2][i] + rank - spots[1][i], spots[3][i]) if len(i) else (rank, rank)
            yield pa.record_batch([*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    ranked = table.join(base, ["_part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_local")).alias("_rank"))
    return ranked.mapInArrow(place, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
