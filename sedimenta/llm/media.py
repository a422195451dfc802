"""Copies of images by local descriptors.

Corners of several scales, the best of each cell of a grid, get binary tests turned by the patch's
orientation; descriptors meet in Hamming tables (one for each 32-bit word of a descriptor: two that differ
in at most 7 bits meet), a match must also agree in a sketch of other bits, and a pair of images is a copy
if enough matches at different corners agree on one scale, turn and shift. Crops, resizes, turns and edits
of brightness, contrast and noise keep interior corners.

Images go in blocks, and every two blocks meet once, in one task that holds the Hamming tables of both: all
pairs of a bucket are compared, whatever its size, and only links leave the task. A tile of two blocks with
many matches is halved until they fit, so memory is bounded by two images, and no matches are shuffled or
stored. The number of tiles grows with the square of the number of blocks."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import textkit
from sedimenta.llm.shared import bloom, components, in_bloom, partitions, stored

CELL = 11
"""Pixels of a grid cell, which keeps its best corner at each scale: corners grow with an image's area."""
SCALES = (1.0, 0.84, 0.7071, 0.5946, 0.5)
WORDS = 8
MOST_BITS = 5
"""Bits of 24 in which the sketches of a match may differ."""
BLOCK, BLOCK_BYTES = 2048, 8 << 20
"""Images of a block, and bytes of their corners."""
MOST_MET = 1 << 22
"""Pairs of corners that are compared at once; a tile of more is halved."""
MOST_PIXELS = 1 << 26
"""A picture of more is not decoded: a small file may claim any size."""
AGREE = 4
"""Matches at different corners that must agree."""


def _balanced_tests(n: int, seed: int = 7) -> np.ndarray:
    """Pairs of places (x, y, x, y) that lie across the patch's orientation: along it the outcome is known in
    advance, since all patches get brighter that way, and descriptors would crowd in few buckets."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        x, y, step, other = rng.normal(0, 4), rng.normal(0, 5), rng.uniform(-3, 3), rng.normal(0, 5)
        if abs(y - other) >= 3 and max(abs(x), abs(y), abs(x + step), abs(other)) <= 9:
            out.append((x, y, x + step, other))
    return np.array(out)


_TESTS = _balanced_tests(WORDS * 32)
_TURNS = 24
_a = np.arange(_TURNS) * 2 * np.pi / _TURNS
_ROT = np.rint(np.stack([np.stack([np.cos(_a)[:, None] * _TESTS[:, i] - np.sin(_a)[:, None] * _TESTS[:, i + 1], np.sin(_a)[:, None] * _TESTS[:, i] + np.cos(_a)[:, None] * _TESTS[:, i + 1]], -1) for i in (0, 2)], 2)).astype(int)
_yy, _xx = np.mgrid[-7:8, -7:8]
_DISC = (_yy**2 + _xx**2 <= 49).astype(np.float32)
_EDGE = 8


def png(gray: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = gray.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey values of an 8-bit PNG (grey or RGB, with or without alpha, not interlaced) or a binary PGM or
    PPM; None of anything else."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            at, body, head = 8, b"", None
            while at < len(raw):
                (n,) = struct.unpack(">I", raw[at : at + 4])
                kind, data = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
                if kind == b"IHDR":
                    head = struct.unpack(">IIBBBBB", data)
                elif kind == b"IDAT":
                    body += data
                at += n + 12
            w, h, depth, colour, _, _, laced = head
            c = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
            if depth != 8 or laced or not 0 < w * h <= MOST_PIXELS:
                return None
            lines = np.frombuffer(zlib.decompressobj().decompress(body, h * (w * c + 1)), np.uint8).reshape(h, w * c + 1)
            out = np.zeros((h, w * c), np.uint8)
            for y in range(h):
                line, up = lines[y, 1:], out[y - 1] if y else np.zeros(w * c, np.uint8)
                if lines[y, 0] == 0:
                    out[y] = line
                elif lines[y, 0] == 2:
                    out[y] = line + up
                else:
                    own = out[y]
                    for x in range(w * c):
                        a, b, d = int(own[x - c]) if x >= c else 0, int(up[x]), int(up[x - c]) if x >= c else 0
                        guess = a if lines[y, 0] == 1 else (a + b) // 2 if lines[y, 0] == 3 else min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2]
                        own[x] = (int(line[x]) + guess) & 255
            out = out.reshape(h, w, c)
        elif raw[:2] in (b"P5", b"P6"):
            head = re.match(rb"P[56]" + rb"(?:\s+(?:#[^\n]*\n\s*)*)(\d{1,9})" * 3 + rb"\s", raw)
            if head is None:
                return None
            (w, h, most), at = map(int, head.groups()), head.end() - 1
            if most > 255 or not 0 < w * h <= MOST_PIXELS:
                return None
            c = 3 if raw[:2] == b"P6" else 1
            out = np.frombuffer(raw, np.uint8, w * h * c, at + 1).reshape(h, w, c)
        else:
            return None
        return out[:, :, :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32) if out.shape[2] >= 3 else out[:, :, 0].astype(np.float32)
    except (TypeError, KeyError, ValueError, IndexError, struct.error, zlib.error):
        return None


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2 r + 1 of each picture, edges repeated."""
    for axis in (-2, -1):
        n = x.shape[axis]
        p = x.take(np.clip(np.arange(-r, n + r), 0, n - 1), axis)
        x = sum(p[..., k : k + n, :] if axis == -2 else p[..., k : k + n] for k in range(2 * r + 1))
    return x / np.float32((2 * r + 1) ** 2)


def _scaled(x: np.ndarray, s: float) -> np.ndarray:
    if s == 1:
        return x
    h, w = int(x.shape[-2] * s), int(x.shape[-1] * s)
    y, z = np.minimum(np.arange(h) / s, x.shape[-2] - 1.001), np.minimum(np.arange(w) / s, x.shape[-1] - 1.001)
    i, j = y.astype(int), z.astype(int)
    fy, fz = (y - i)[:, None].astype(x.dtype), (z - j).astype(x.dtype)
    top, low = x[..., i, :], x[..., i + 1, :]
    return (top[..., j] * (1 - fz) + top[..., j + 1] * fz) * (1 - fy) + (low[..., j] * (1 - fz) + low[..., j + 1] * fz) * fy


def describe(gray: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale index, turn) of the kept corners of a picture, and their descriptors as WORDS 32-bit words."""
    return describe_all([gray])[0]


def describe_all(grays: list[np.ndarray | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The corners of each picture; those of one shape are taken together, up to 2^20 pixels."""
    out: list = [(np.zeros((0, 4)), np.zeros((0, WORDS), np.uint32))] * len(grays)
    shapes: dict[tuple, list[int]] = {}
    for i, g in enumerate(grays):
        if g is not None and min(g.shape) > 2 * _EDGE + 4:
            shapes.setdefault(g.shape, []).append(i)
    for (h, w), own in shapes.items():
        step = max(1, (1 << 20) // (h * w))
        for lo in range(0, len(own), step):
            some = own[lo : lo + step]
            which, where, words = _corners(np.stack([grays[i] for i in some]).astype(np.float32))
            order = np.argsort(which, kind="stable")
            cut = np.searchsorted(which[order], np.arange(len(some) + 1))
            for i, a, z in zip(some, cut[:-1].tolist(), cut[1:].tolist()):
                out[i] = where[order[a:z]], words[order[a:z]]
    return out


def _corners(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Picture, (x, y, scale index, turn) and descriptor of the kept corners of pictures of one shape."""
    found = [(np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros((0, WORDS), np.uint32))]
    for level, s in enumerate(SCALES):
        x = _scaled(stack, s)
        h, w = x.shape[1:]
        if min(h, w) <= 2 * _EDGE + 4:
            break
        soft = _box(x, 1)
        gy, gx = np.gradient(soft, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = a * b - c * c - np.float32(0.05) * (a + b) ** 2
        inner = r[:, _EDGE:-_EDGE, _EDGE:-_EDGE]
        top = inner > 1.0
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                if dy or dx:
                    near = r[:, _EDGE + dy : h - _EDGE + dy, _EDGE + dx : w - _EDGE + dx]
                    top &= inner > near if (dy, dx) > (0, 0) else inner >= near
        p, y, z = np.nonzero(top)
        y, z = y + _EDGE, z + _EDGE
        order = np.lexsort((-r[p, y, z], z // CELL, y // CELL, p))
        p, y, z = p[order], y[order], z[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (np.diff(y // CELL) != 0) | (np.diff(z // CELL) != 0)
        p, y, z = p[new], y[new], z[new]
        smooth = _box(x, 2)
        for lo in range(0, len(p), 4096):
            q, i, j = p[lo : lo + 4096], y[lo : lo + 4096], z[lo : lo + 4096]
            patch = soft[q[:, None, None], i[:, None, None] + _yy, j[:, None, None] + _xx] * _DISC
            turn = np.rint(np.arctan2((patch * _yy).sum((1, 2)), (patch * _xx).sum((1, 2))) * _TURNS / (2 * np.pi)).astype(int) % _TURNS
            t = _ROT[turn]
            at = lambda k: smooth[q[:, None], np.clip(i[:, None] + t[:, :, k, 1], 0, h - 1), np.clip(j[:, None] + t[:, :, k, 0], 0, w - 1)]
            bits = at(0) + np.float32(0.5) < at(1)
            found.append((q, np.stack([j / s, i / s, np.full(len(q), level), turn], 1), np.packbits(bits, axis=1).view(">u4").astype(np.uint32)))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def consensus(x: np.ndarray, y: np.ndarray, enough: int | None = None) -> int:
    """The most matches (rows of x, y: x, y, scale index, turn) at different corners that one scale, turn and shift explains;
    or, sooner, any number of them that is enough."""
    if not len(x):
        return 0
    s = np.array(SCALES)
    ratio = s[x[:, 2].astype(int)] / s[y[:, 2].astype(int)]
    angle = (y[:, 3] - x[:, 3]) * 2 * np.pi / _TURNS
    best = 0
    for k, f in {(round(float(a), 3), round(float(b), 3)) for a, b in zip(ratio, angle % (2 * np.pi))}:
        own = (np.abs(ratio - k) < 0.02 * k) & (np.abs((angle - f + np.pi) % (2 * np.pi) - np.pi) < 2.5 * np.pi / _TURNS)
        c, d = np.cos(f) * k, np.sin(f) * k
        moved = np.stack([c * x[own, 0] - d * x[own, 1], d * x[own, 0] + c * x[own, 1]], 1)
        shift = y[own, :2] - moved
        for t in shift:
            ok = np.abs(shift - t).max(1) <= 3
            if ok.sum() > best:
                spots: list[list[float]] = []
                for u in x[own][ok][:, :2].tolist():
                    if all(abs(u[0] - v[0]) > 4 or abs(u[1] - v[1]) > 4 for v in spots):
                        spots.append(u)
                best = max(best, len(spots))
                if enough is not None and best >= enough:
                    return best
    return best


class _Block:
    """Some images: their nodes, and owner (an index into them), words, sketches and place of every corner."""

    def __init__(self, nodes: np.ndarray, words: list[bytes], at: list[bytes]):
        self.nodes = nodes
        self.n = np.array([len(x) // (4 * WORDS) for x in words], np.int64)
        self.owner = np.repeat(np.arange(len(nodes), dtype=np.int32), self.n)
        self.words = np.frombuffer(b"".join(words), "<u4").reshape(-1, WORDS)
        self.at = np.frombuffer(b"".join(at), "<f4").reshape(-1, 4)
        low = self.words & np.uint32(0xFF)
        self.sketch = np.stack([sum(low[:, (w + 1 + 2 * j) % WORDS] << np.uint32(8 * j) for j in range(3)) for w in range(WORDS)])
        self._order: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def half(self, second: bool) -> _Block:
        """The first or second half of the images."""
        m = len(self.nodes) // 2
        own, c = (slice(m, None), slice(int(self.n[:m].sum()), None)) if second else (slice(m), slice(int(self.n[:m].sum())))
        out = object.__new__(_Block)
        out.nodes, out.n, out._order = self.nodes[own], self.n[own], []
        out.owner = np.repeat(np.arange(len(out.nodes), dtype=np.int32), out.n)
        out.words, out.at, out.sketch = self.words[c], self.at[c], self.sketch[:, c]
        return out

    def table(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The Hamming table of a word: its sorted values, their corners, and the corners' sketches."""
        if not self._order:
            number = np.arange(len(self.words), dtype=np.uint64)
            for k in range(WORDS):  # sorting numbers is faster than sorting places by them
                by = np.sort(self.words[:, k].astype(np.uint64) << np.uint64(32) | number)
                at = (by & np.uint64(0xFFFFFFFF)).astype(np.int32)
                self._order.append(((by >> np.uint64(32)).astype(np.uint32), at, self.sketch[k][at]))
        return self._order[w]


def _links(a: _Block, b: _Block) -> list[tuple[int, int]]:
    """The pairs of nodes (smaller, larger) of an image of a and one of b, or two of a if b is a, that are copies."""
    if not len(a.words) or not len(b.words):
        return []
    found = []
    for w in range(WORDS):
        (x, _, _), (y, _, _) = a.table(w), b.table(w)
        lo = np.searchsorted(y, x, "left")
        has = np.flatnonzero(y[np.minimum(lo, len(y) - 1)] == x)
        lo = lo[has]
        found.append((has, lo, np.searchsorted(y, x[has], "right") - lo))
    met = sum(int(n.sum()) for _, _, n in found)
    if met > MOST_MET and max(len(a.nodes), len(b.nodes)) > 1:
        if a is b:
            p, q = a.half(False), a.half(True)
            return _links(p, p) + _links(p, q) + _links(q, q)
        if len(a.nodes) >= len(b.nodes):
            return _links(a.half(False), b) + _links(a.half(True), b)
        return _links(a, b.half(False)) + _links(a, b.half(True))
    left, right, width = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], np.int32(len(b.nodes))  # a block has BLOCK images at most
    for w, (has, lo, n) in enumerate(found):
        (_, i, one), (_, j, two) = a.table(w), b.table(w)
        cut = np.searchsorted(np.cumsum(n), np.arange(MOST_MET, int(n.sum()) + MOST_MET, MOST_MET), "right")
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(n)]):
            to = textkit.ragged(lo[s:e], n[s:e])
            same = np.flatnonzero(np.bitwise_count(np.repeat(one[has[s:e]], n[s:e]) ^ two[to]) <= MOST_BITS)
            k, to = np.repeat(i[has[s:e]], n[s:e])[same], j[to[same]]
            if a is b:
                once = a.owner[k] < a.owner[to]
                k, to = k[once], to[once]
            left.append(k)
            right.append(to)
    i, j = np.concatenate(left), np.concatenate(right)
    pair = a.owner[i] * width + b.owner[j]
    by, often = np.sort(pair), np.zeros(len(a.nodes) * len(b.nodes), bool)
    often[by[AGREE - 1 :][by[AGREE - 1 :] == by[: max(len(by) - AGREE + 1, 0)]]] = True
    some = np.flatnonzero(often[pair])
    code = np.sort(i[some].astype(np.int64) * len(b.words) + j[some])
    code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code  # a match once, however many words it has in common
    i, j = np.divmod(code, len(b.words))
    pair = a.owner[i].astype(np.int64) * width + b.owner[j]
    # matches that agree are of one ratio of scales and within two steps of one turn
    x, y = a.at[i], b.at[j]
    ratio = (x[:, 2] - y[:, 2]).astype(np.int64) + len(SCALES) - 1
    turn = (y[:, 3] - x[:, 3]).astype(np.int64) % _TURNS
    kind = pair * (2 * len(SCALES)) + ratio
    value, n = np.unique(kind * _TURNS + turn, return_counts=True)
    near = np.zeros(len(value), np.int64)
    for d in range(-2, 3):
        other = value // _TURNS * _TURNS + (value + d) % _TURNS
        at = np.minimum(np.searchsorted(value, other), max(len(value) - 1, 0))
        near += np.where(value[at] == other, n[at], 0)
    perhaps = np.unique(value[near >= AGREE] // _TURNS // (2 * len(SCALES)))
    keep = np.isin(pair, perhaps)
    i, j, pair = i[keep], j[keep], pair[keep]
    order = np.argsort(pair, kind="stable")
    i, j, pair = i[order], j[order], pair[order]
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else pair
    out = []
    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(pair)]):
        u, v = int(a.nodes[a.owner[i[s]]]), int(b.nodes[b.owner[j[s]]])
        x, y = a.at[i[s:e]], b.at[j[s:e]]
        if u > v:
            u, v, x, y = v, u, y, x
        if consensus(x, y, AGREE) >= AGREE:
            out.append((u, v))
    return out


def _copied(points: DataFrame, images: int) -> DataFrame:
    """(u, v), u < v: the pairs of nodes of points (node, words, at), about so many, that are copies."""

    def blocks(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def done():
            nodes, words, at = zip(*held)
            return pa.record_batch([pa.array([number]), pa.array([nodes], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.binary())), pa.array([at], pa.list_(pa.binary()))], ["block", "nodes", "words", "at"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if held and (len(held) == BLOCK or size + len(row[1]) + len(row[2]) > BLOCK_BYTES):
                    yield done()
                    number, held, size = number + 1, [], 0
                held.append(row)
                size += len(row[1]) + len(row[2])
        if held:
            yield done()

    def tile(batches):
        known: dict[int, _Block] = {}

        def block(b, row, first):
            number = b.column(first)[row].as_py()
            if number not in known:
                if len(known) > 3:
                    known.pop(next(iter(known)))
                known[number] = _Block(np.array(b.column(first + 1)[row].values), b.column(first + 2)[row].as_py(), b.column(first + 3)[row].as_py())
            known[number] = known.pop(number)  # the one not used for longest goes first
            return known[number]

        for b in batches:
            for row in range(b.num_rows):
                out = _links(block(b, row, 0), block(b, row, 4))
                yield pa.record_batch([pa.array([x[c] for x in out], pa.int64()) for c in range(2)], ["u", "v"])

    kept = stored(points.coalesce(max(1, -(-images // BLOCK))).mapInArrow(blocks, "block long, nodes array<long>, words array<binary>, at array<binary>"), "blocks")
    one, two = kept.toDF("a", "an", "aw", "aa"), kept.toDF("b", "bn", "bw", "ba")
    return one.join(two.hint("shuffle_replicate_nl"), F.col("a") <= F.col("b")).mapInArrow(tile, "u long, v long")


def copies(media: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """(id, n_points, n_links, class_id), a row for each row of media; class_id: the smallest id of the class.

    Equal bytes are one image from the start. n_links counts the other images that an image is a copy of,
    however many there are. A null or undecodable image has no points and is in a class of its own or of its
    equal bytes; a null one is alone. A null id has a null class; ids are cast to long. Rows of one id are
    one node. Other columns are ignored; an empty table gives none."""
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))

    def run(batches):
        from pyspark import TaskContext

        node = TaskContext.get().partitionId() << 33
        known: dict[bytes, tuple[bytes, bytes]] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                s = b.slice(lo, 64)
                pictures = s.column(1).to_pylist()
                names = [b"" if raw is None else hashlib.sha256(raw).digest() for raw in pictures]
                raws = dict(zip(names, pictures))
                if len(known) > 4096:
                    known.clear()
                fresh = [name for name in raws if name not in known]
                for name, (where, words) in zip(fresh, describe_all([decode(raws[name]) for name in fresh]), strict=True):
                    known[name] = where.astype("<f4").tobytes(), words.astype("<u4").tobytes()
                out = [(name or None, *known[name]) for name in names]
                yield pa.record_batch([pa.array(node + np.arange(s.num_rows)), s.column(0), *(pa.array([x[c] for x in out], pa.binary()) for c in range(3))], ["node", "id", "sum", "at", "words"])
                node += s.num_rows

    seen = stored(rows.mapInArrow(run, "node long, id long, sum binary, at binary, words binary"), "points")
    real = seen.where("id is not null and sum is not null")
    groups = real.groupBy("sum").agg(F.min("id").alias("head"), F.min_by("node", "id").alias("own"), F.count("*").alias("n"))
    twins = stored(real.select("node", "sum").join(groups.where("n > 1"), "sum").where("node <> own").select("node"), "twins")
    bits = seen.sparkSession.sparkContext.broadcast(bloom(twins, "node"))

    def perhaps(batches):
        for b in batches:
            hit = pa.array(in_bloom(bits.value, b.column(0).to_numpy().astype(np.int64).view(np.uint64)))
            yield pa.record_batch([*b.columns, hit], [*b.schema.names, "twin"])

    told = real.select("node", "words", "at").mapInArrow(perhaps, "node long, words binary, at binary, twin boolean")
    ones = told.where("not twin").unionByName(told.where("twin").join(twins, "node", "left_anti")).select("node", "words", "at")
    name = lambda c: groups.select(F.col("own").alias(c), F.col("head").alias(f"h{c}"))
    links = stored(_copied(ones, seen.count()), "links").join(name("u"), "u").join(name("v"), "v").select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v"))
    links = stored(links.where("u <> v").distinct(), "copies")
    member = components(links)
    degree = links.select(F.col("u").alias("id")).union(links.select("v")).groupBy("id").agg(F.count("*").alias("n_links"))
    heads = groups.select("sum", F.col("head").alias("id")).join(member, "id", "left").join(degree, "id", "left").select("sum", "n_links", F.coalesce("component", "id").alias("class"))
    out = seen.select("id", "sum", (F.octet_length("at") / 16).cast("long").alias("n_points")).join(heads, "sum", "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "n_points", F.when(F.col("id").isNotNull(), F.coalesce("n_links", zero)).otherwise(zero).alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class_id"))


def scene(seed: int, size: int = 72, boxes: int = 28) -> np.ndarray:
    """A textured picture of grey boxes that depends on the seed alone."""
    rng = np.random.default_rng(seed)
    out = np.full((size, size), 128.0)
    for y, x, h, w, v in zip(*rng.integers(0, size - 6, (2, boxes)), *rng.integers(6, 26, (2, boxes)), rng.integers(10, 246, boxes), strict=True):
        out[y : y + h, x : x + w] = v
    texture = _scaled(rng.normal(0, 42, (size // 3 + 1, size // 3 + 1)), 3.0)[:size, :size]
    return np.rint(np.clip(out * 0.6 + 52 + texture, 0, 255))


def edited(full: np.ndarray, kind: int) -> np.ndarray:
    """A copy of a square picture: a crop to half of its area, darker and flatter, smaller, or turned."""
    n = len(full)
    a, z = n // 7, n // 7 + round(n * 0.71)
    return (full[a:z, a - 1 : z - 1], full * 0.8 + 12, _scaled(full, 0.8), np.rot90(full))[kind % 4]


def media_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A media column for a table that has none: (media_id, media), two for each vector. 2 * id is the
    scene of the vector, 2 * id + 1 a copy of it that is edited in one of four ways, by the id."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                s, ids, out = b.slice(lo, 64), [], []
                for i, seed in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
                    full = scene(seed)
                    ids += [2 * i, 2 * i + 1]
                    out += [png(full), png(edited(full, i))]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["media_id", "media"])

    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.crc32(F.to_json(F.struct(vector_col)).cast("binary")).alias("seed")).repartition(partitions(vectors), id_col).mapInArrow(run, "media_id long, media binary")
