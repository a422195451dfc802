"""Near-duplicates by SuperMinHash.

Each element of a document's shingle set draws one value for every place of a permutation of the m
signature places: j + r for its j-th place, so an element's values are correlated and a signature has
less variance than independent hashes give; once every place holds a value under j, no later draw can
lower one, and a document stops. Signatures are cut into bands; documents that share a band are
candidates, compared on full sets, and grouped by union-find.

Buckets are never expanded into pairs while they are large. Equal sets are one node from the start.
Shingles that no other candidate has bound what a node can share: a node with too many of them can be
linked with nothing, and a pair whose bound is too low isn't compared; both are exact. In a bucket one
node, the centre, is compared with the others; nodes that are found linked need no further comparison,
so only pairs between different components are left, and these come next, around other centres as long
as there are more than a linear number, else all of them. Later bands look only at buckets that still
hold several components. No candidate link between components is dropped."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import textkit
from sedimenta.llm.shared import bloom, components, in_bloom, lean, stored

U = np.uint64
FIRST = 8
"""Bands that are taken before the others."""
LINEAR = 16
"""Pairs for each node and band that are looked at, once buckets have had a centre; beyond it they get further ones."""


def shingles(col: pa.Array, k: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text): distinct k-word shingles, ascending; fewer words are one shingle."""
    data, offs = textkit.utf8(col)
    n_docs = len(offs) - 1
    _, _, doc, h = textkit.words(data, offs, table)
    n = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(n) - n
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(at[-1], U)
    g, where = textkit.doc_grams(h, doc, k)
    d = doc[where]
    out[at[d] + where - first[d]] = g
    for size in range(1, k):
        some = np.flatnonzero(n == size)
        if len(some):
            out[at[some]] = textkit.grams(h, size)[first[some]]
    for a, z in zip(at[:-1][count > 1].tolist(), at[1:][count > 1].tolist()):
        out[a:z].sort()
    owner = np.repeat(np.arange(n_docs), count)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=n_docs))]).astype(np.int64)


def signatures(elements: np.ndarray, offs: np.ndarray, m: int, chunk: int = 1 << 15) -> np.ndarray:
    """SuperMinHash of each set, a row of m values: step j in the upper 32 bits, the draw in the lower."""
    docs = len(offs) - 1
    none = np.iinfo(U).max
    sig = np.full((docs, m), none, U)
    flat = sig.reshape(-1)
    owner = np.repeat(np.arange(docs), np.diff(offs))
    for lo in range(0, len(elements), chunk):
        e, d = elements[lo : lo + chunk], owner[lo : lo + chunk]
        perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(e), 1))
        live, row = np.arange(len(e)), d
        touched = np.arange(d[0], d[-1] + 1)
        for j in range(m):
            if j:
                most = sig[touched].max(1)
                open_ = most >= (U(j) << U(32))
                if not open_.all():
                    left = np.zeros(d[-1] - d[0] + 1, bool)
                    left[touched[open_] - d[0]] = True
                    touched = touched[open_]
                    keep = left[row - d[0]]
                    live, row = live[keep], row[keep]
                if not len(live):
                    break
            u = textkit.mix(e[live] + U((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
            to = j + (((u >> U(32)) * U(m - j)) >> U(32)).astype(np.int64)
            place = perm[live, to].astype(np.int64)
            perm[live, to] = perm[live, j]
            np.minimum.at(flat, row * m + place, (U(j) << U(32)) | (u & U(0xFFFFFFFF)))
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), U)
    for b in range(bands):
        acc = np.full(len(sig), b + 1, U)
        for i in range(b * rows, b * rows + rows):
            acc = textkit.mix(acc * U(0x9FB21C651E98DF25) + sig[:, i])
        out[:, b] = acc
    return out


def fingerprints(docs: DataFrame, k: int, table: np.ndarray, bands: int, rows: int) -> DataFrame:
    """(id, n, a, b, bands, digest): size and 128-bit key of the set, band keys, a byte of each place."""
    m = bands * rows

    def run(batches):
        for batch in batches:
            for s in textkit.slices(batch, "text"):
                e, offs = shingles(s.column(1), k, table)
                n = np.diff(offs)
                some = n > 0
                keys = []
                for salt in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
                    total = np.concatenate([np.zeros(1, U), np.cumsum(textkit.mix(e * U(salt) + U(salt >> 7)), dtype=U)])
                    keys.append((total[offs[1:]] - total[offs[:-1]]).view(np.int64))
                sig = signatures(e, offs, m)
                band = band_keys(sig, bands, rows)
                digest = (textkit.mix(sig) >> U(56)).astype(np.uint8).view(np.int8)
                cut = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(band[some].reshape(-1).view(np.int64)))
                yield pa.record_batch([s.column(0), pa.array(n), pa.array(keys[0]), pa.array(keys[1]), lists, pa.FixedSizeListArray.from_arrays(pa.array(digest.reshape(-1)), m).cast(pa.list_(pa.int8()))], ["id", "n", "a", "b", "bands", "digest"])

    return docs.mapInArrow(lean(run), "id long, n long, a long, b long, bands array<long>, digest array<byte>")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float, num: int, den: int, m: int) -> DataFrame:
    """Pairs whose common shingles can be enough and whose signatures agree in a share of at least `least`."""
    x = nodes.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("free").alias("fu"), F.col("digest").alias("du"))
    y = nodes.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("free").alias("fv"), F.col("digest").alias("dv"))
    both = pairs.join(x, "u").join(y, "v").where(_possible(num, den))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 20_000):
                s = b.slice(i, 20_000)
                if s.num_rows:
                    du, dv = (s.column(c).flatten().to_numpy().reshape(-1, m) for c in (2, 3))
                    keep = pa.array((du == dv).mean(1) >= least)
                    yield pa.record_batch([s.column(0).filter(keep), s.column(1).filter(keep)], ["u", "v"])

    return both.select("u", "v", "du", "dv").mapInArrow(lean(run), "u long, v long")


def _possible(num: int, den: int) -> Column:
    """Whether sizes nu, nv with fu, fv shingles that others have too leave room for the similarity."""
    most = F.least("fu", "fv")
    return most * den >= (F.col("nu") + F.col("nv") - most) * num


def _sets(docs: DataFrame, ids: DataFrame, k: int, table: np.ndarray) -> DataFrame:
    """(id, set) of the documents of ids."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom(ids, "id"))

    def run(batches):
        for batch in batches:
            key = np.asarray(batch.column(0).fill_null(0)).astype(np.int64).view(U)
            batch = batch.filter(pa.array(in_bloom(shared.value, key)))
            for s in textkit.slices(batch, "text"):
                e, offs = shingles(s.column(1), k, table)
                yield pa.record_batch([s.column(0), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(e.view(np.int64)))], ["id", "set"])

    return stored(docs.mapInArrow(lean(run), "id long, set array<long>").join(ids, "id", "left_semi"), "sets")


def _candidates(nodes: DataFrame) -> DataFrame:
    """Nodes with a bucket of at least two, and by the Bloom bitmap of such buckets perhaps some others."""
    shared = nodes.sparkSession.sparkContext.broadcast(bloom(nodes.select(F.explode("bands").alias("key")).groupBy("key").count().where("count > 1"), "key"))

    def run(batches):
        for b in batches:
            bands = b.column("bands")
            hit = in_bloom(shared.value, bands.flatten().to_numpy().view(U)) if b.num_rows else np.zeros(0, bool)
            yield b.filter(pa.array(hit.reshape(b.num_rows, -1).any(1)) if b.num_rows else pa.array([], pa.bool_()))

    return nodes.mapInArrow(lean(run), "n long, a long, b long, id long, bands array<long>, digest array<byte>")


def _against(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, ref, size, lacks, more, mask): how a set differs from a reference of `size` shingles: how many
    of them it lacks, which (in 256 bits), and how many it has more."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                rows = []
                for sx, sz in zip(b.column(2), b.column(3), strict=True):
                    x, z = (v.values.to_numpy().view(U) for v in (sx, sz))
                    gone = z[~np.isin(z, x)]
                    mask = np.zeros(4, U)
                    np.bitwise_or.at(mask, ((gone >> U(6)) & U(3)).astype(np.int64), U(1) << (gone & U(63)))
                    rows.append((len(z), len(gone), len(x) - len(z) + len(gone), mask.view(np.int64).tolist()))
                cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
                yield pa.record_batch([b.column(0), b.column(1), *cols, pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["id", "ref", "size", "lacks", "more", "mask"])

    x, z = sets.select("id", F.col("set").alias("sx")), sets.select(F.col("id").alias("ref"), F.col("set").alias("sz"))
    both = pairs.join(x, "id").join(z, "ref").select("id", "ref", "sx", "sz")
    return stored(both.mapInArrow(lean(run), "id long, ref long, size long, lacks long, more long, mask array<long>"), "against")


def _side(rows: DataFrame, t: str) -> DataFrame:
    extra = F.greatest(F.col("more") - (F.col("n") - F.col("free")), F.lit(0))  # beyond the reference, and not its own
    names = [F.col(c).alias(f"{c}_{t}") for c in ("c", "bands", "digest", "lacks", "mask")]
    return rows.select("key", *(["band", "size"] if t == "u" else []), F.col("id").alias(t), F.col("n").alias("n" + t), F.col("free").alias("f" + t), *names, extra.alias(f"extra_{t}"))


def _overlapping(num: int, den: int) -> Column:
    """Whether two sets that lack known parts of one reference can still overlap enough: what either
    lacks isn't shared, and what both have beyond it is at most what the one with less has."""
    bits = lambda c: sum((F.bit_count(c(i)) for i in range(2, 5)), F.bit_count(c(1))).cast("long")
    at = lambda t: lambda i: F.element_at(f"mask_{t}", i)
    both = bits(lambda i: at("u")(i).bitwiseAND(at("v")(i))) + F.col("lacks_u") - bits(at("u"))
    most = F.col("size") - (F.col("lacks_u") + F.col("lacks_v") - F.least("lacks_u", "lacks_v", both)) + F.least("extra_u", "extra_v")
    return most * den >= (F.col("nu") + F.col("nv") - most) * num


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that hold on full sets."""
    x, y = sets.select(F.col("id").alias("u"), F.col("set").alias("su")), sets.select(F.col("id").alias("v"), F.col("set").alias("sv"))
    inter = F.size(F.array_intersect("su", "sv")).cast("long")
    both = pairs.select("u", "v").join(y, "v").join(x, "u").select("u", "v", inter.alias("i"), (F.size("su") + F.size("sv")).alias("t"))
    return stored(both.where(F.col("i") * den >= (F.col("t") - F.col("i")) * num).select("u", "v").distinct(), "confirmed")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 38, rows: int = 5, table: np.ndarray = textkit.ALNUM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each row of docs; documents are linked where
    den * |intersection| >= num * |union| of their k-word shingle sets.

    Null, empty and wordless texts have empty sets and are linked with nothing. A null id is linked with
    nothing, its component is null and it is kept. Rows of one id are one node with the sets of all;
    ids are integers, or cast to long.
    Other columns are ignored; an empty table gives none. Sets are of 64-bit hashes. With the default
    bands a link at exactly the threshold is missed with a chance of 3e-7 (32 bands of 6 at 0.85: 3e-7),
    above it less; the prefilter on whole signatures keeps four and a half standard deviations (3e-6)."""
    m, need = bands * rows, num / den
    least = need - 4.5 * (need * (1 - need) / m) ** 0.5
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = stored(fingerprints(docs, k, table, bands, rows), "fingerprints")
    full = prints.where("n > 0 and id is not null")
    nodes = stored(full.groupBy("n", "a", "b").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("digest").alias("digest")), "nodes")
    some = stored(_candidates(nodes), "candidates")
    sets = _sets(docs, some.select("id").distinct(), k, table)
    alone = sets.select("id", F.explode("set").alias("e")).groupBy("e").agg(F.min("id").alias("id"), F.max("id").alias("z")).where("id = z").groupBy("id").agg(F.count("*").alias("own"))
    rows_of = some.groupBy("id").agg(F.count("*").alias("rows"))  # of several texts with one id nothing is known
    own = F.when(F.col("rows") == 1, F.coalesce("own", F.lit(0))).otherwise(0)
    some = some.join(alone, "id", "left").join(rows_of, "id").withColumn("free", F.col("n") - own).where(F.col("free") * den >= F.col("n") * num)
    some = stored(some.select("id", "n", "free", "digest", "bands"), "linkable")
    slim = some.select("id", "n", "free", "digest")
    total = nodes.count()
    member: DataFrame | None = None

    def test(pairs: DataFrame) -> None:
        """Confirms pairs and joins the components of those that hold."""
        nonlocal member
        good = _confirm(stored(pairs, "pairs"), sets, num, den)
        if good.isEmpty():
            return
        if member is None:
            member = components(good)
            return
        ends = labelled(good.withColumnRenamed("u", "id")).select("v", F.col("c").alias("cu")).withColumnRenamed("v", "id")
        merged = components(labelled(ends).select("cu", "c"))
        fresh = good.select(F.col("u").alias("id")).union(good.select("v")).distinct()
        whole = fresh.join(member, "id", "full").select("id", F.coalesce("component", "id").alias("component"))
        merged = merged.select(F.col("id").alias("component"), F.col("component").alias("_into"))
        member = stored(whole.join(merged, "component", "left").select("id", F.coalesce("_into", "component").alias("component")), "members")

    def labelled(rows: DataFrame) -> DataFrame:
        """rows with c, the component of id."""
        if member is None:
            return rows.withColumn("c", F.col("id"))
        return rows.join(member, "id", "left").select(*rows.columns, F.coalesce("component", "id").alias("c"))

    def open_(rows: DataFrame) -> DataFrame:
        """Rows (key, band, id, n, free, c) of buckets with several components, without those that by their
        sizes can be linked with nothing there."""
        bounds = rows.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.min("n").alias("nv"), F.max("free").alias("fv")).where("_lo <> _hi").select("key", "nv", "fv")
        both = rows.withColumns({"nu": F.col("n"), "fu": F.col("free")}).join(bounds, "key")
        return both.where(_possible(num, den)).select("key", "band", "id", "n", "free", "c")

    for start, count in ((1, FIRST), (FIRST + 1, bands - FIRST)):
        rows = labelled(some.select("id", "n", "free", "bands")).select("id", "n", "free", "c", F.posexplode(F.slice("bands", start, count)).alias("_at", "key")).withColumn("band", (F.col("_at") + start).cast("long"))
        live, turn = stored(open_(rows), "buckets"), 0
        while True:
            sizes = live.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
            pairs = sizes.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("nn")) / 2), F.lit(0))).first()[0]
            if not pairs:
                break
            if (turn or start > 1) and pairs <= LINEAR * total * count:  # linear: all of them
                refs = live.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("free")).alias("own"), "id")).alias("m")).select("key", F.col("m.id").alias("ref"))
                seen = live.join(refs, "key")
                seen = seen.join(_against(seen.select("id", "ref").distinct(), sets), ["id", "ref"]).join(some.select("id", "bands", "digest"), "id")
                x, y = _side(seen, "u"), _side(seen, "v")
                new = F.array_position(F.zip_with("bands_u", "bands_v", lambda p, q: p == q), True) == F.col("band")  # in the first band that they share
                alike = F.size(F.filter(F.zip_with("digest_u", "digest_v", lambda p, q: p == q), lambda e: e)) >= least * m
                test(x.join(y, (x.key == y.key) & (F.col("u") < F.col("v")) & (F.col("c_u") != F.col("c_v")) & _possible(num, den) & _overlapping(num, den) & new & alike).select("u", "v"))
                break
            # the centre has the fewest shingles of its own: it is the likeliest to be linked with the others
            centres = live.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("free")).alias("own"), "id", "c")).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", F.col("m.id").alias("centre"), F.col("m.c").alias("cc"))
            star = live.join(centres, "key").where("c <> cc").select(F.least("centre", "id").alias("u"), F.greatest("centre", "id").alias("v"))
            test(_likely(star.distinct(), slim, least, num, den, m))
            live = live.join(centres.select("key", F.col("centre").alias("id")), ["key", "id"], "left_anti").select("key", "band", "id", "n", "free")
            live, turn = stored(open_(labelled(live)), "buckets"), turn + 1

    same = nodes.select("n", "a", "b", F.col("id").alias("rep"))
    if member is not None:
        same = same.join(member.withColumnRenamed("id", "rep"), "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("rep"))
    out = prints.select("id", "n", "a", "b").join(same, ["n", "a", "b"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
