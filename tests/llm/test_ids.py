import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, prose, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sedimenta.llm import encode, idcodec, packing, tokencount

BPE = Tokenizer.from_file(encode.tokenizer_path("byte_bpe_50k.json"))
WORD = Tokenizer.from_file(encode.tokenizer_path("word_bpe_49k.json"))
ODD = st.text(alphabet=st.sampled_from(list("ab'stmdlrevLR 19²½\n\t.,!éÉß×ª\x85\xa0İ<|日")), max_size=30)


def ids(t, end):
    return BPE.encode(t or "", add_special_tokens=False).ids + [end]


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_encoder_is_the_library(some):
    flat, offs = encode.encoder(encode.tokenizer_path("byte_bpe_50k.json"))(pa.array(some), 7)
    assert [flat[a:z].tolist() for a, z in zip(offs, offs[1:])] == [ids(t, 7) for t in some]


@settings(max_examples=300, deadline=None)
@given(ODD | st.text(alphabet=st.sampled_from(list("aЖяΣςİıﬁ日本한😀👩\u200d\u0301\u0627’“”'s\u3000 12\n")), max_size=30))
def test_pretokens_are_the_library(t):
    data, odd, starts, ends, _, _ = tokencount._split(pa.array([t]), WORD)
    assert not odd[0] or "<|" in t
    if not odd[0]:
        pieces = [data[a:z].tobytes().decode() for a, z in zip(starts, ends)]
        assert sum(len(WORD.encode(p, add_special_tokens=False).ids) for p in pieces) == len(WORD.encode(t, add_special_tokens=False).ids)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=2000), st.integers(9, 16))
def test_huffman_round_trip(some, limit):
    a = np.array(some, np.uint32)
    lengths = idcodec.code_lengths(np.bincount(a, minlength=2), limit)
    assert lengths.max() <= limit and (not len(a) or sum(2.0 ** -int(n) for n in lengths if n) <= 1)
    payload, marks = idcodec.encode_block(a, lengths, idcodec.canonical(lengths))
    assert (idcodec.decode_block(payload, marks, len(a), idcodec.decoding_table(lengths)) == a).all()


def test_huffman_is_optimal_without_a_limit():
    import heapq

    counts = np.random.default_rng(0).integers(1, 1000, 200)
    heap, total = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert (counts * idcodec.code_lengths(counts, 30)).sum() == total
    skew = np.array([1 << i for i in range(30)])
    lengths = idcodec.code_lengths(skew, 8)
    assert lengths.max() == 8 and abs(sum(2.0 ** -int(n) for n in lengths) - 1) < 1e-9


def test_id_files(spark):
    docs = documents(spark)
    path = idcodec.write(docs)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids) for r in idcodec.read(spark, path).collect())
    at = 0
    for (i, start, n, own), t in zip(got, texts(), strict=True):
        assert own == ids(t, 2) and (start, n) == (at, len(own))
        at += n
    assert idcodec.read(spark, idcodec.write(documents(spark, []))).count() == 0
    same = [(1, "b"), (1, "a"), (None, "c"), (2, None)]
    got = idcodec.read(spark, idcodec.write(documents(spark, same))).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]
    assert min(got, key=lambda r: r.start).doc_id is None


@pytest.mark.parametrize("cap", [8, 64, 2048])
def test_packing(spark, cap):
    own = {i: np.array(ids(t, 0), "<u4") for i, t in enumerate(texts())}
    seqs, cover = {}, {}
    for r in packing.pack(documents(spark), cap=cap).collect():
        part = own[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and len(part) == r.length <= cap
        assert r.length == cap or r.piece == 0
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        cover[r.doc_id] = cover.get(r.doc_id, 0) + r.length
    assert cover == {i: len(x) for i, x in own.items()}
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= cap
    assert packing.pack(documents(spark, [])).count() == 0
    assert packing.pack(documents(spark, [(None, "a"), (None, "a"), (3, None)])).count() == 3


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 1000), max_size=25))
def test_plan_keeps_every_piece(histogram):
    plan = packing.plan(histogram, 60)
    total = {}
    for lengths, m in plan:
        assert sum(lengths) <= 60 and m > 0
        for n in lengths:
            total[n] = total.get(n, 0) + m
    assert total == histogram
    need = sum(n * c for n, c in histogram.items())
    assert sum(m for _, m in plan) <= max(-(-need // 60) * 2, 1)


def test_exact_complements():
    assert packing.plan({10: 5, 50: 5}, 60) == [((50, 10), 5)]
    assert sum(m for _, m in packing.plan({30: 2, 20: 3, 15: 4, 45: 0 + 1}, 60)) == 4


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 3), max_size=12), st.lists(st.integers(1, 24), max_size=40))
def test_sums_against_brute_force(histogram, gaps):
    """While counts fall, a combination is found if and only if there is one."""
    left, sums = dict(histogram), packing.Sums(np.array([histogram.get(n, 0) for n in range(25)]))
    for gap in gaps:
        opened = max((n for n, k in left.items() if k), default=0)
        aside = (opened,) if opened else ()
        free = sorted(n for n, k in left.items() for _ in range(k - (n == opened)))
        want = any(sum(c) == gap for size in (1, 2, 3) for c in combinations(free, size))
        got = sums.find(gap, aside)
        assert (got is not None) == want
        if got:
            times = sums.take((*aside, *got))
            for n in (*aside, *got):
                left[n] -= times
            assert times > 0 and min(left.values()) >= 0


@pytest.mark.parametrize("head", [1 << 20, 5])
def test_token_counts(spark, monkeypatch, head):
    monkeypatch.setattr(tokencount, "HEAD", head)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(documents(spark), limit=50).collect()}
    more = ["Привет, мир! Это проверка.", "日本語のテキスト、混ざった text", "emoji 😀👩‍👩‍👧 and “curly” quotes’s", "a\tb <|endoftext|> c", "e\u0301 é"] * 2
    some = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(documents(spark, list(enumerate(more)))).collect()}
    assert some == {i: len(WORD.encode(t, add_special_tokens=False).ids) for i, t in enumerate(more)}
    for i, t in enumerate(texts()):
        n = len(WORD.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 50)
    assert tokencount.count_tokens(documents(spark, [])).count() == 0
    assert tokencount.count_tokens(documents(spark, [(1, "a b"), (1, "a b"), (None, None)])).count() == 3


def test_prose_is_varied():
    import random

    assert len(set(prose(random.Random(1), 100).split())) > 20


def test_counts_in_small_parts(spark, monkeypatch):
    """Pre-tokens that workers give on many times, and that meet again over many batches."""
    monkeypatch.setattr(tokencount, "FLUSH", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(documents(spark).repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: len(WORD.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts())}


def test_pieces_start_anew(monkeypatch):
    """A worker's table of pieces stays within its bound, and ids don't depend on it."""
    made = encode.Encoder(encode.tokenizer_path("byte_bpe_50k.json"))
    rows = [t or "" for t in texts()]
    want = [made.lib.encode(t, add_special_tokens=False).ids for t in rows]
    monkeypatch.setattr(encode, "MOST_PIECES", 300)
    for t, ids in zip(rows, want, strict=True):
        assert made(pa.array([t]))[0].tolist() == ids
        assert len(made.keys) <= 300


def test_frequent_pieces_stay(monkeypatch):
    """Words of every text are learned once, however many others fill the table."""
    monkeypatch.setattr(encode, "MOST_PIECES", 300)
    made, learned = encode.Encoder(encode.tokenizer_path("byte_bpe_50k.json")), []
    learn = made._learn
    monkeypatch.setattr(made, "_learn", lambda keys, pieces: learned.extend(pieces) or learn(keys, pieces))
    common = [f"common{chr(97 + i)}" for i in range(20)]
    for n in range(30):
        text = " ".join([*common, *(f"rare{chr(97 + n % 26)}{chr(97 + i % 26)}{'x' * (i // 26 + n // 26 * 9)}" for i in range(60))])
        flat, _ = made(pa.array([text]), 7)
        assert flat.tolist() == ids(text, 7) and len(made.keys) <= 300
    assert all(sum(p.strip() == w for p in learned) == 1 for w in common)


def test_workers_give_memory_back():
    """What a function of batches has freed isn't held by the allocator below a block that lives on."""
    from sedimenta.llm.shared import lean

    pins, own = [], lambda: int(next(x for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")).split()[1]) >> 10

    def work(batches):
        for _ in batches:
            blocks = [np.ones(12_500) for _ in range(3000)]  # 100 KB each, so none is mapped by itself
            pins.append(np.ones(12_500))
            yield len(blocks)
            del blocks

    before = own()
    assert list(work([1])) == [3000]
    held = own() - before
    assert list(lean(work)([1])) == [3000]
    assert held > 200 and own() - before < 100
