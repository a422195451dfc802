"""Benchmark decontamination by winnowing.

Of every run of W consecutive K-word fingerprints the smallest is kept, in benchmark items as in
documents, so any shared span of K + W - 1 = 8 words has a kept fingerprint in common. Those are
joined, and each hit is extended: the 8-word windows around it are compared with the items' windows,
word for word. Items of fewer words are one window, found by all runs of that many words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm import textkit
from sedimenta.llm.shared import bloom, in_bloom, stored

SPAN, K, W = 8, 5, 4


def _prints(h: np.ndarray, doc: np.ndarray, lengths: list[int]):
    """(fingerprint, first word, words) of what winnowing keeps, and of all runs of the given lengths."""
    g, at = textkit.doc_grams(h, doc, K)
    kept = textkit.winnow(g, doc[at], W)
    out = [(g[kept], at[kept], np.full(len(kept), SPAN))]
    for n in lengths:
        g, at = textkit.doc_grams(h, doc, n)
        out.append((textkit.mix(g ^ np.uint64(n)), at, np.full(len(g), n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _word(data: np.ndarray) -> bytes:
    return textkit.ALNUM[data].tobytes()


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words, win, prints) of every window of every item; prints: its kept fingerprints."""

    def run(batches):
        for batch in batches:
            for b in textkit.slices(batch, "text"):
                data, offs = textkit.utf8(b.column(1))
                starts, ends, doc, h = textkit.words(data, offs, textkit.ALNUM)
                raw, rows = _word(data), []
                count = np.bincount(doc, minlength=b.num_rows)
                first = np.cumsum(count) - count
                for i, (n, a) in enumerate(zip(count.tolist(), first.tolist(), strict=True)):
                    if not n:
                        continue
                    own = np.zeros(n, np.int64)
                    size = SPAN if n >= SPAN else n
                    fp, at, length = _prints(h[a : a + n], own, [n] if n < SPAN else [])
                    keep = length == size
                    fp, at = fp[keep].view(np.int64), at[keep]
                    word = [raw[s:e].decode() for s, e in zip(starts[a : a + n].tolist(), ends[a : a + n].tolist())]
                    for s in range(n - size + 1):
                        near = (at >= s) & (at + (K if size == SPAN else size) <= s + size)
                        rows.append((i, size, " ".join(word[s : s + size]), fp[near].tolist()))
                ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.record_batch([ids, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["item", "words", "win", "prints"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"item {kind}, words int, win string, prints array<long>")


def contamination(docs: DataFrame, items: DataFrame, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs.

    Words are lower-cased runs of ASCII letters, digits and all that is not ASCII. Null and empty texts
    have none. Items with a null id are left out; items with the same id are one. Null and repeated
    document ids keep their rows. Other columns are ignored; empty tables give no hits or no rows."""
    windows = stored(item_windows(items, item_id, item_text), "windows")
    prints = windows.select(F.explode("prints").alias("fp")).distinct()
    short = sorted(r[0] for r in windows.where(F.col("words") < SPAN).select("words").distinct().collect())  # 7 at most
    shared = docs.sparkSession.sparkContext.broadcast(bloom(prints, "fp"))

    def scan(batches):
        from pyspark import TaskContext

        bits, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for b in textkit.slices(batch, "text"):
                data, offs = textkit.utf8(b.column(1))
                starts, ends, doc, h = textkit.words(data, offs, textkit.ALNUM)
                n = np.bincount(doc, minlength=b.num_rows)
                first, stop = np.cumsum(n) - n, np.cumsum(n)
                fp, at, length = _prints(h, doc, short)
                near = np.flatnonzero(in_bloom(bits, fp)) if len(fp) else np.zeros(0, np.int64)
                near = near[np.argsort(doc[at[near]], kind="stable")] if len(near) else near
                hits = []
                if len(near):
                    raw = _word(data)
                    for i in near.tolist():
                        a, size, d = int(at[i]), int(length[i]), int(doc[at[i]])
                        lo = max(int(first[d]), a - (SPAN - K)) if size == SPAN else a
                        hi = min(int(stop[d]), a + SPAN) if size == SPAN else a + size
                        word = [raw[s:e].decode() for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
                        wins = [" ".join(word[s : s + size]) for s in range(len(word) - size + 1)]
                        hits.append({"fp": int(fp[i].view(np.int64)), "words": size, "at": lo - int(first[d]), "wins": wins})
                cut = np.searchsorted(doc[at[near]] if len(near) else near, np.arange(b.num_rows + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(cut), pa.array(hits, pa.struct([("fp", pa.int64()), ("words", pa.int32()), ("at", pa.int32()), ("wins", pa.list_(pa.string()))])))
                yield pa.record_batch([pa.array(row + np.arange(b.num_rows)), b.column(0), pa.array(n.astype(np.int64)), found], ["row", "id", "n_words", "hits"])
                row += b.num_rows

    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"row long, id {kind}, n_words long, hits array<struct<fp:long,words:int,at:int,wins:array<string>>>"), "scanned")
    hits = rows.where(F.size("hits") > 0).select("row", F.inline("hits")).join(prints, "fp", "left_semi")
    spots = hits.select("row", "words", "at", F.posexplode("wins").alias("i", "win")).select("row", "words", (F.col("at") + F.col("i")).alias("s"), "win").distinct()
    owners = windows.groupBy("words", "win").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = spots.join(owners, ["words", "win"])
    order = Window.partitionBy("row").orderBy("s")
    ends = spans.groupBy("row", "s").agg(F.max(F.col("s") + F.col("words")).alias("e")).withColumn("before", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    length = ends.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("before", "s")))).cast("long").alias("n_hit"))
    sets = spans.select("row", "items").distinct().groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    names = F.sort_array(F.transform(F.coalesce("items", F.array().cast(f"array<{items.schema[item_id].dataType.simpleString()}>")), lambda x: x.cast("string")))
    out = rows.select("row", "id", "n_words").join(length, "row", "left").join(sets, "row", "left")
    n = F.size(names).cast("long")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n.alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n >= least_items).alias("contaminated"))
