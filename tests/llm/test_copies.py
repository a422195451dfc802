import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from fixtures import documents, prose, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import decontam, media, neardup, passages, shared, textkit
from sedimenta.llm.shared import components

FOLD = {i: i + 32 for i in range(65, 91)}
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def split(t, pattern=ALNUM):
    return pattern.findall((t or "").translate(FOLD))


def shingles(t, k, pattern):
    w = split(t, pattern)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aBé .!\t\n\x1c9日")), max_size=20), max_size=6))
def test_words(some):
    import pyarrow as pa

    for table, pattern in ((textkit.ALNUM, ALNUM), (textkit.SPACED, SPACED)):
        data, offs = textkit.utf8(pa.array(some, pa.string()))
        starts, ends, doc, h = textkit.words(data, offs, table)
        x = table[data].tobytes() if len(data) else b""
        got = [(int(d), x[a:z].decode()) for a, z, d in zip(starts, ends, doc)]
        assert got == [(i, w) for i, t in enumerate(some) for w in split(t, pattern)]
        assert len(set(h.tolist())) == len({w for _, w in got})


def variants(seed=1):
    """Groups of near copies, with chains whose ends aren't similar themselves."""
    rng, out = random.Random(seed), []
    for n in (12, 40, 150):
        base = prose(rng, n).split(" ")
        for copies in range(14):
            w = list(base)
            for _ in range(copies // 2 if n > 12 else copies // 6):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def brute_groups(some, k, num, den, pattern):
    sets = {i: shingles(t, k, pattern) for i, t in enumerate(some)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return sets, roots(links, sets)


def test_near_duplicates(spark):
    some = texts() + variants()
    for k, num, bands, rows, table, pattern in ((3, 85, 32, 6, textkit.SPACED, SPACED), (5, 80, 38, 5, textkit.ALNUM, ALNUM)):
        sets, want = brute_groups(some, k, num, 100, pattern)
        got = neardup.near_duplicates(documents(spark, list(enumerate(some))), k=k, num=num, bands=bands, rows=rows, table=table)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    odd = neardup.near_duplicates(documents(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in odd) == [("1", 1, True), ("2", 2, True), ("3", 3, True), ("3", 3, True), ("None", None, True), ("None", None, True)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**63, 80).astype(np.uint64)])
    sig = neardup.signatures(np.concatenate([np.sort(a), np.sort(b), a[:2]]), np.array([0, 400, 800, 802]), 256)
    assert abs((sig[0] == sig[1]).mean() - 320 / 480) < 0.1
    assert (sig < np.iinfo(np.uint64).max).all()
    again = neardup.signatures(np.sort(a), np.array([0, 400]), 256, chunk=64)
    assert (again[0] == sig[0]).all()


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(pairs, {x for p in pairs for x in p})
    assert got == {n: want[n] for p in pairs if p[0] != p[1] for n in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_contamination(docs, items, least=2):
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(8, len(w))
        for s in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    found |= own
                    hit.update(range(s, s + n))
        names = ",".join(sorted(map(str, found)))
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(found) >= least))
    return sorted(out)


def test_contamination(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 8, 9, 3, 1, 2, 60])] + [(7, None), (8, "!!"), (10, "one"), (None, "one two")]
    items.append((11, items[0][1]))
    docs = list(enumerate(texts()))
    for i in range(30):
        a = split(items[rng.choice([0, 1, 2, 6])][1])
        s = rng.randrange(len(a))
        docs.append((100 + i, prose(rng, 20) + " " + " ".join(a[s : s + rng.randrange(6, 20)]).upper() + " " + prose(rng, rng.choice([0, 20]))))
    docs += [(7, docs[-1][1]), (None, items[0][1])]
    bench = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for own in (items, items[:3], []):
        got = decontam.contamination(documents(spark, docs), bench(own)).collect()
        assert sorted((str(r.doc_id), *(r[c] for c in cols)) for r in got) == brute_contamination(docs, own)
    assert decontam.contamination(documents(spark, []), bench(items)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=2, max_size=12, unique=True))
def test_chain_is_the_best(anchors):
    p, r = np.array([a for a, _ in anchors]), np.array([b for _, b in anchors])
    order = sorted(range(len(p)), key=lambda i: (r[i], p[i]))
    best = {}
    for i in order:
        before = [best[j] - passages.GAP * (p[i] - p[j] + r[i] - r[j]) for j in best if p[j] < p[i] and r[j] < r[i]]
        best[i] = passages.K + max([0, *before])
    found = passages.chain(p, r)
    top = max(best.values())
    assert (abs(found[0][0] - top) < 1e-9) if found else top < max(passages.LEAST_SCORE, 2 * passages.K)
    for _, line in found:
        assert all(p[a] < p[b] and r[a] < r[b] for a, b in zip(line, line[1:]))


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if not (old := row) else [i, *([0] * len(b))]
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        assert passages._distance(np.array(a), np.array(b)) == row[-1]


def test_passages(spark):
    rng = random.Random(8)
    passage, other = prose(rng, 70).split(" "), prose(rng, 30)
    fuzzy = list(passage)
    for i in (20, 45):
        fuzzy[i] = "edited"
    del fuzzy[60]
    filler = lambda: prose(random.Random(rng.random()), 300) + " " + " ".join(f"w{rng.randrange(10**7)}" for _ in range(40))
    rows = [(5, filler() + " " + " ".join(passage) + " " + filler()), (6, filler() + " " + " ".join(passage) + " tail"), (7, " ".join(fuzzy) + " " + filler()), (8, filler() + " " + other), (9, filler() + " " + other), (10, filler())]
    rows += [(20 + i, t) for i, t in enumerate(["", None, "short", "to " * 80, "to " * 80])] + [(30, filler()), (None, " ".join(passage))]
    rows += [(30, rows[11][1])]
    got = passages.repeated_passages(documents(spark, rows)).collect()
    assert {(r.doc_id, r.ref_id) for r in got} == {(6, 5), (7, 5), (24, 23)}
    text = dict(rows)
    for r in got:
        if r.doc_id == 6:
            w = split(text[6])[r.start : r.end]
            assert set(split(" ".join(passage))) <= set(w) and len(w) <= len(split(" ".join(passage))) + 3 and r.errors <= 2
    cut = {r.doc_id: r.text for r in passages.without_passages(documents(spark, rows), passages.repeated_passages(documents(spark, rows))).collect()}
    assert cut[5] == text[5] and cut[10] == text[10] and 24 not in cut and cut[23] == text[23] and cut[21] is None
    assert cut[6].endswith("tail") and passage[30] + " " + passage[31] not in cut[6]
    assert passages.repeated_passages(documents(spark, [])).count() == 0


def own_words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def uncovered(rows, found, least=50):
    """(document, word) of the runs of `least` words that an earlier document has too and no passage covers."""
    w = {i: split(t) for i, t in rows}
    seen, missed = set(), set()
    for i in sorted(w):
        grams = [tuple(w[i][p : p + least]) for p in range(len(w[i]) - least + 1)]
        held = {x for r in found if r.doc_id == i for x in range(r.start, r.end)}
        missed |= {(i, x) for p, g in enumerate(grams) if g in seen for x in range(p, p + least)} - {(i, x) for x in held}
        seen |= set(grams)
    return missed


def test_two_passages_of_a_pair(spark):
    rng, rows = random.Random(12), []
    for n, (size, gap) in enumerate([(60, 40), (60, 80), (60, 100), (60, 150), (100, 80), (100, 300), (200, 150), (200, 300)]):
        one, two = own_words(rng, size), own_words(rng, size)
        for side in range(2):
            rows.append((10 * n + side, " ".join([*own_words(rng, 30), *one, *own_words(rng, gap), *two, *own_words(rng, 30)])))
        rows.append((10 * n + 2, " ".join([*own_words(rng, 9), *one, *own_words(rng, gap // 2), *two])))
    found = passages.repeated_passages(documents(spark, rows)).collect()
    assert not uncovered(rows, found)
    assert all(r.end - r.start >= 50 and r.errors <= 0.2 * (r.end - r.start) for r in found)


def test_passage_in_parts(spark):
    """The parts of a passage occur one by one in different earlier documents, the whole of it only later."""
    rng, rows = random.Random(13), []
    text = lambda *parts: " ".join(w for x in parts for w in [*own_words(rng, 40), *x, *own_words(rng, 40)])
    for n in range(12):
        whole, cut = own_words(rng, 50 + n * 5), (25, 30, 20)[n % 3]
        rows += [(100 * n + i, text(whole[c : c + cut])) for i, c in enumerate(range(0, len(whole), cut))]
        rows += [(100 * n + 50 + i, text(whole)) for i in range(3)]
    rows += [(5000, text(rows[-1][1].split(" ")[30:130])), (5001, "to be or " * 70), (5002, "so " + "to be or " * 90)]
    found = passages.repeated_passages(documents(spark, rows)).collect()
    assert not uncovered(rows, found)
    own = dict(rows)
    for r in found:
        assert r.errors <= 0.2 * (r.end - r.start) and r.ref_id < r.doc_id
        assert r.errors or split(own[r.doc_id])[r.start : r.end] == split(own[r.ref_id])[r.ref_start : r.ref_end]


def test_edited_passage_in_parts(spark):
    """As before, but the later copies are edited, so that none is a run of an earlier one; parts are frequent."""
    rng, rows, where = random.Random(15), [], []
    text = lambda *parts: " ".join(w for x in parts for w in [*own_words(rng, 40), *x, *own_words(rng, 40)])
    lines = [own_words(rng, 22) for _ in range(6)]
    for i, x in enumerate(lines * 5):
        rows.append((i, text(x, ["so"] * 40)))
    for n in range(20):
        one, two, three = rng.sample(lines, 3)
        whole = [*one, *two, *three] if n % 2 else [*one, *two, *own_words(rng, 25)]
        for side in range(3):
            copy = [f"edit{n}x{side}" if side and (i + 4 * side) % 12 == 11 else w for i, w in enumerate(whole)]
            rows.append((1000 + 10 * n + side, text(copy)))
        where += [1000 + 10 * n + side for side in (1, 2)]
    found = passages.repeated_passages(documents(spark, rows)).collect()
    for doc in where:
        held = {x for r in found if r.doc_id == doc for x in range(r.start, r.end)}
        assert len(held & set(range(40, 106))) >= 55
    assert all(r.end - r.start >= 50 and r.errors <= 0.2 * (r.end - r.start) and r.ref_id < r.doc_id for r in found)


def test_joints_against_brute_force():
    rng = random.Random(16)
    for _ in range(60):
        docs = []
        for _ in range(rng.randrange(1, 4)):
            docs.append(sorted((p, *rng.choice([(1, 0), (1, 9), (1, 90), (2, 4), (2, 200), (3, 0)])) for p in rng.sample(range(400), rng.randrange(1, 60))))
        rows = [(n, *x) for n, own in enumerate(docs) for x in own]
        doc, pos, ref, rpos = (np.array(x, np.int64) for x in zip(*rows))
        kept = passages.turning(doc, pos, ref, rpos)
        none = np.zeros((0, 2), np.int64)
        key, p, q, free = passages.joints((doc[kept] << 32) + pos[kept], ref[kept], rpos[kept], none, none)
        want = set()
        for n, own in enumerate(docs):
            for i, (a, *x) in enumerate(own):
                for j, (z, *y) in enumerate(own[i + 1 :], i + 1):
                    near = x[0] == y[0] and 0 < y[1] - x[1] <= passages.REACH
                    between = [o[1:] for o in own[i + 1 : j]]
                    if z - a <= passages.REACH and x != y and not near and tuple(x) not in between and tuple(y) not in between:
                        want.add((n, a, z, *x, *y))
        assert {(int(x >> 32), int(x & 0xFFFFFFFF), int(y & 0xFFFFFFFF)) for x, y in zip(p, q)} == {x[:3] for x in want} and free.all()
        assert len(p) == len(want) and len({(int(k), *x[3:]) for k, x in zip(key, [next(w for w in want if w[:3] == (int(a >> 32), int(a & 0xFFFFFFFF), int(z & 0xFFFFFFFF))) for a, z in zip(p, q)])}) == len(set(key.tolist()))


def test_larger_sets_against_brute_force():
    rng = random.Random(17)
    for _ in range(60):
        size, some = rng.randrange(2, 5), {}
        for _ in range(rng.randrange(30)):
            own = tuple((p, -p) for p in sorted(rng.sample(range(7), size)))
            some[own] = (own, rng.random() < 0.3, rng.randrange(3), tuple(p + rng.choice([0, 0, 0, 50]) for p, _ in own))
        want: dict = {}
        for one in some.values():
            for two in some.values():
                both = sorted({*one[0], *two[0]})
                place = lambda x: {s: (x[2], at) for s, at in zip(x[0], x[3])}
                if len(both) == size + 1 and any(place(one)[s] != place(two)[s] for s in one[0] if s in two[0]):
                    want[tuple(both)] = want.get(tuple(both), False) or one[1] or two[1]
        assert passages.larger(list(some.values()), 1 << 16) == want
        assert not want or passages.larger(list(some.values()), 0) is None


def test_frequent_joints_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Two frequent lines side by side in otherwise different documents, and edited copies that no first occurrence of
    joints holds: pairs grow with the documents, and the copies are found, also where sets of seeds are too many."""
    rng, rows, where = random.Random(18), [], []
    text = lambda *parts: " ".join(w for x in parts for w in [*own_words(rng, 40), *x])
    lines = [own_words(rng, 20) for _ in range(4)]
    rows += [(i, text(x, ["so"] * 20)) for i, x in enumerate(lines)]
    rows += [(10 + i, text([*lines[i % 4], *lines[(i // 4 + 1 + i) % 4]], ["so"] * 20)) for i in range(120)]
    for n in range(8):
        whole = [*(rng.sample(lines, 3)[0]), *rng.choice(lines), *rng.choice(lines), *own_words(rng, 12)]
        for side in range(2):
            copy = [f"edit{n}x{side}" if (i + 4 * side) % 12 == 11 else w for i, w in enumerate(whole)]
            rows.append((1000 + 10 * n + side, text(copy, own_words(rng, 40))))
        where.append(1001 + 10 * n)
    made, real = [], passages.stored
    monkeypatch.setattr(passages, "stored", lambda df, name, *a: made.append((name, real(df, name, *a))) or made[-1][1])
    for most in (passages.MOST_SETS, 0):
        monkeypatch.setattr(passages, "MOST_SETS", most)
        made.clear()
        found = passages.repeated_passages(documents(spark, rows)).collect()
        for doc in where:
            held = {x for r in found if r.doc_id == doc for x in range(r.start, r.end)}
            assert len(held & set(range(40, 112))) >= 55
        pairs = [df.count() for name, df in made if name == "pairs"]
        assert len(pairs) == 1 and (most == 0 or 0 < pairs[0] < 6 * len(rows))


def test_equal_stretches_give_larger_sets_once(spark, monkeypatch):
    """Documents with the same short lines in a row, each two of which first occurred elsewhere: however many they are,
    their larger sets are made once, and all meet the first of them."""
    made, real = [], passages.stored
    monkeypatch.setattr(passages, "stored", lambda df, name, *a: made.append((name, real(df, name, *a))) or made[-1][1])
    larger = []
    for copies in (4, 16):
        rng = random.Random(19)
        text = lambda *parts: " ".join(w for x in parts for w in [*own_words(rng, 8), *x])
        some = [own_words(rng, 5) for _ in range(4000)]
        _, _, doc, h = textkit.words(*textkit.utf8(pa.array([" ".join(x) for x in some])), textkit.ALNUM)
        lines = [some[i] for i in np.argsort(textkit.doc_grams(h, doc, passages.K)[0])[:5]]  # so small that each is a seed wherever it stands
        rows = [(i, text(x)) for i, x in enumerate(lines)]
        rows += [(10 + 5 * i + j, text(lines[i], lines[j])) for i in range(5) for j in range(i + 1, 5)]
        made.clear()
        passages.repeated_passages(documents(spark, [*rows, *((100 + n, text(*lines)) for n in range(copies))])).collect()
        larger.append(sum(df.count() for name, df in made if name == "sets" and "many" in df.columns))
        pairs = {tuple(r) for name, df in made if name == "pairs" for r in df.collect()}
        assert {(100 + n, 100) for n in range(1, copies)} <= pairs
    assert larger[0] == larger[1] > 0


def test_rounds_of_larger_sets_are_not_in_one_plan(spark, monkeypatch):
    """Texts of the same short lines in a row and all shorter rows of them apart: several rounds of larger sets. The plan of
    all pairs reads a table of each round, and what a round made and nothing reads again goes within a workspace."""
    plans, real = [], passages.stored
    monkeypatch.setattr(passages, "stored", lambda df, name, *a: (plans.append((name, df._jdf.queryExecution().toString())), real(df, name, *a))[1])
    rng = random.Random(19)
    text = lambda *parts: " ".join(w for x in parts for w in [*own_words(rng, 8), *x])
    some = [own_words(rng, 5) for _ in range(4000)]
    _, _, doc, h = textkit.words(*textkit.utf8(pa.array([" ".join(x) for x in some])), textkit.ALNUM)
    lines = [some[i] for i in np.argsort(textkit.doc_grams(h, doc, passages.K)[0])[:5]]
    rows = [(i, text(x)) for i, x in enumerate(lines)]
    rows += [(10 + 5 * i + j, text(lines[i], lines[j])) for i in range(5) for j in range(i + 1, 5)]
    rows += [(100 + n, text(*lines)) for n in range(4)]
    want = sorted(passages.repeated_passages(documents(spark, rows)).collect())
    assert sum(name == "stretches" for name, _ in plans) > 1
    assert [plan.count("Join") for name, plan in plans if name == "pairs"] == [0]
    folder = Path(shared.shared_dir(spark)) / "tables"
    before = set(folder.iterdir())
    with shared.workspace(spark):
        got = shared.stored(passages.repeated_passages(documents(spark, rows)), "got", keep=True)
        assert not {f.name.split("-")[0] for f in set(folder.iterdir()) - before} & {"heads", "stretches", "sets", "joints", "pairs", "runs"}
    assert sorted(got.collect()) == want


def test_stretches():
    one = [(((3, 7), (9, 8)), 1, True), (((9, 8), (30, 5)), 2, False), (((90, 7), (99, 8)), 1, True)]
    two = [(((x[0][0][0] + 40, x[0][0][1]), (x[0][1][0] + 41, x[0][1][1])), *x[1:]) for x in one[2:]]
    digests, begins = passages.stretches(one)
    assert begins == [3, 3, 90] and digests[0] == digests[1] != digests[2] == passages.stretches(two)[0][0]
    assert passages.stretches([one[0]])[0][0] == digests[2] != passages.stretches([(*one[0][:2], False)])[0][0]


def test_passage_twice_in_a_document(spark):
    """Copies with an edit every 16 words: the second in a document, and one behind stray uses of its words."""
    rng, rows = random.Random(14), []
    for n in range(10):
        one = own_words(rng, 90)
        edited = [["edit", *one[i + 1 : i + 16]] for i in range(0, 90, 16)]
        copy = [w for x in edited for w in x]
        stray = [w for x in edited for w in [*x, *own_words(rng, 3)]]
        rows.append((10 * n, " ".join([*own_words(rng, 50), *one, *own_words(rng, 50)])))
        rows.append((10 * n + 1, " ".join([*one[:60], *own_words(rng, 200), *copy, *own_words(rng, 200), *copy])))
        rows.append((10 * n + 2, " ".join([*stray[:19], *own_words(rng, 300), *copy])))
    found = passages.repeated_passages(documents(spark, rows)).collect()
    for n in range(10):
        for doc, start in ((1, 260), (1, 550), (2, 319)):
            held = {x for r in found if r.doc_id == 10 * n + doc for x in range(r.start, r.end)}
            assert len(held & set(range(start, start + 90))) >= 85


def test_compositions_against_brute_force(spark):
    """Texts put together from pieces of a few sources, with edits and loops: every run of 50 words that an
    earlier document has is found."""
    for seed in (0, 2):
        rng, rows = random.Random(seed), []
        src = [own_words(rng, 400) for _ in range(6)]
        for i in range(300):
            w = []
            for _ in range(rng.randrange(1, 7)):
                k = rng.random()
                if k < 0.7:
                    s = rng.choice(src)
                    at = rng.randrange(len(s))
                    piece = s[at : at + rng.choice([6, 10, 20, 30, 45, 49, 50, 51, 60, 80, 120])]
                    for _ in range(max(1, len(piece) // 12) if rng.random() < 0.4 else 0):
                        piece[rng.randrange(len(piece))] = f"edit{rng.randrange(50)}"
                    w += piece
                else:
                    w += ["to", "be", "or"] * rng.randrange(1, 40) if k < 0.8 else own_words(rng, rng.randrange(1, 40))
            rows.append((i * 3, " ".join(w)))
        found = passages.repeated_passages(documents(spark, rows)).collect()
        assert not uncovered(rows, found)
        own = {i: split(t) for i, t in rows}
        for r in found:
            assert r.end - r.start >= 50 and r.errors <= 0.2 * (r.end - r.start) and r.ref_id < r.doc_id
            assert r.errors or own[r.doc_id][r.start : r.end] == own[r.ref_id][r.ref_start : r.ref_end]


def test_images(spark):
    """Recall of each kind of edit, none of it across scenes; large groups of copies; all that isn't an image."""
    edits = {"half": lambda x: x[10:61, 9:60], "third": lambda x: x[14:56, 15:57], "small": lambda x: media._scaled(x, 0.8), "smaller": lambda x: media._scaled(x, 0.7), "turned": np.rot90, "dark": lambda x: x * 0.8 + 12, "gamma": lambda x: 255 * (x / 255) ** 1.3, "noise": lambda x: np.clip(x + np.random.default_rng(1).normal(0, 4, x.shape), 0, 255)}
    rows = []
    for seed in range(30):
        full = media.scene(seed)
        rows += [(20 * seed, full), *((20 * seed + 1 + k, f(full)) for k, f in enumerate(edits.values()))]
    rows += [(700 + i, media.scene(99) * (1 - i / 300) + i / 40) for i in range(60)]
    rows = [(i, bytearray(media.png(x))) for i, x in rows] + [(900, None), (901, bytearray(b"no image")), (902, bytearray(b"no image")), (None, bytearray(media.png(media.scene(0)))), (903, None), (904, bytearray(media.png(np.zeros((4, 4)))))]
    df = spark.createDataFrame([(i, m, 1, "x") for i, m in rows], "media_id long, media binary, id long, points string")
    out = media.copies(df).collect()
    got = {r.media_id: r for r in out if r.media_id is not None}
    assert len(out) == len(rows)
    for k, name in enumerate(edits):
        assert sum(got[20 * seed + 1 + k].class_id == 20 * seed for seed in range(30)) >= (24 if name == "third" else 27), name
    assert all(got[i].class_id // 20 == i // 20 for i in got if i < 600)
    assert {got[700 + i].class_id for i in range(60)} == {700} and all(got[700 + i].n_links for i in range(60))
    assert got[900].class_id == 900 and got[903].class_id == 903 and got[901].class_id == got[902].class_id == 901 and got[904].n_points == 0
    assert [r.class_id for r in out if r.media_id is None] == [None]
    assert media.copies(df.where("false")).count() == 0


def linked(one, two):
    """Whether two described pictures are copies, by all pairs of their corners."""
    (at, words), (to, others) = ((a, w.astype(np.int64)) for a, w in (one, two))
    sketch = lambda w, k: sum((w[:, (k + 1 + 2 * j) % media.WORDS] & 0xFF) << 8 * j for j in range(3))
    met = np.zeros((len(words), len(others)), bool)
    for k in range(media.WORDS):
        met |= (words[:, k, None] == others[None, :, k]) & (np.bitwise_count(sketch(words, k)[:, None] ^ sketch(others, k)) <= media.MOST_BITS)
    i, j = np.nonzero(met)
    return media.consensus(at[i], to[j]) >= media.AGREE


def test_large_groups_of_images_keep_every_link(spark, monkeypatch):
    """90 copies that are cropped, darkened and noisy: links and classes are those of all pairs."""
    rng, full = np.random.default_rng(5), media.scene(3)
    some = []
    for i in range(90):
        y, x = rng.integers(0, 12, 2)
        some.append(np.rint(np.clip(full[y : y + 60, x : x + 60] * rng.uniform(0.6, 1) + rng.normal(0, 2, (60, 60)), 0, 255)))
    known = media.describe_all([x.astype(np.float32) for x in some])
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if linked(known[a], known[b])}
    assert max(sum(i in p for p in want) for i in range(90)) > 40
    got = {r.media_id: r for r in media.copies(spark.createDataFrame([(i, bytearray(media.png(x))) for i, x in enumerate(some)], "media_id long, media binary")).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in p for p in want) for i in range(90)}
    assert {i: r.class_id for i, r in got.items()} == roots(want, range(90))
    block = lambda ids: media._Block(np.array(ids), [known[i][1].astype("<u4").tobytes() for i in ids], [known[i][0].astype("<f4").tobytes() for i in ids])
    for most in (1 << 22, 5000, 1):
        monkeypatch.setattr(media, "MOST_MET", most)
        one, two = block(range(50)), block(range(50, 90))
        assert sorted(media._links(one, one) + media._links(one, two) + media._links(two, two)) == sorted(want)


def test_hamming_tables_and_crowded_buckets():
    """Tables are in the order of a word, with 32-bit places and sketches; a bucket that holds every corner keeps all links."""
    rng = np.random.default_rng(8)
    at = np.array([[9.0 * k, 40 - 7 * (k % 3), 0, 0] for k in range(6)])
    words = np.tile(rng.integers(0, 1 << 32, (6, media.WORDS), dtype=np.uint32), (40, 1, 1))
    words[:, :, 0] = 5  # the same in all corners of all images
    words[20:, :, 1:] = rng.integers(0, 1 << 32, (20, 6, media.WORDS - 1), dtype=np.uint32)
    known = [(at, w) for w in words]
    block = media._Block(np.arange(40), [w.astype("<u4").tobytes() for w in words], [at.astype("<f4").tobytes()] * 40)
    for w in range(media.WORDS):
        value, i, sketch = block.table(w)
        assert (i == np.argsort(block.words[:, w], kind="stable")).all() and (value == block.words[i, w]).all() and (sketch == block.sketch[w][i]).all()
        assert {i.dtype, sketch.dtype, block.owner.dtype} <= {np.dtype(np.int32), np.dtype(np.uint32)}
    want = [(a, b) for a in range(40) for b in range(a + 1, 40) if linked(known[a], known[b])]
    assert sorted(media._links(block, block)) == want and len(want) >= 190


def test_png_and_pnm():
    x = np.random.default_rng(1).integers(0, 256, (9, 7)).astype(float)
    assert (media.decode(media.png(x)) == x).all()
    assert (media.decode(b"P5 # note\n7 9\n255\n" + x.astype(np.uint8).tobytes()) == x).all()
    for cut in (b"P5", b"P5 12", b"P5 #", b"P5 7 9 255", b"P5 7 9 255\nxx", b"P6 99999 99999 255\n", media.png(x)[:40], media.png(np.zeros((300, 300)))[:-60]):
        assert media.decode(cut) is None
    bomb = media.struct.pack(">IIBBBBB", 60000, 60000, 8, 0, 0, 0, 0)
    assert media.decode(b"\x89PNG\r\n\x1a\n" + media.struct.pack(">I", 13) + b"IHDR" + bomb + b"0000") is None
    assert media.decode(None) is None and media.decode(b"\x89PNG\r\n\x1a\nxx") is None and media.decode(b"") is None
