"""Line dedup, piecewise hashes, SimHash, tokenizers and packing against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import bpe_chunks, covering_simhash, line_dedup, piecewise_hash, sp_chunks, token_spans, vector_packing, wrappers
from palimpsest.llm.vector_packing import Limits

ODD = " \n\t\r\x0b\x0c\x00\x1c\x85ab.1é漢 😀'sﬁ▁<>​"
odd_text = st.text(st.sampled_from(ODD), max_size=30) | st.text(max_size=20)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, "x") for i, t in rows], "doc_id long, text string, lines string, n_lines long, row string")


# line dedup

LINES = ["Common  line", "  common  LINE\t", "rare", "", "É", "é", "x" * 70_000]


def brute_lines(rows, min_docs, min_chars=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for n, (_, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                seen.setdefault(k, set()).add(n)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(seen.get(key(x), ())) < min_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("max_broadcast", "shard_keys"), [(1 << 20, 1 << 17), (1 << 20, 3), (0, 1 << 17), (0, 3)])
def test_line_dedup_equals_brute_force(spark, max_broadcast, shard_keys):
    r = random.Random(1)
    pool = LINES + [f"line {k}" for k in range(40)]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(1, 8)))) for k in range(60)] + [(7, None), (None, "rare\nrare"), (8, ""), (8, "")]
    got = line_dedup.drop_common_lines(docs(spark, rows).repartition(3), min_docs=6, max_broadcast=max_broadcast, shard_keys=shard_keys)
    assert got.columns == ["doc_id", "text", "lines", "row", "n_lines", "n_dropped"]
    assert sorted(((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got.collect()), key=repr) == brute_lines(rows, 6)


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.drop_common_lines(docs(spark, [])).collect() == []


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, (5000, 2))
    row = line_dedup.build_shard(0, keys[:, 0].copy(), keys[:, 1].copy(), np.arange(1, 5001))
    shard = line_dedup.Shard(row)
    assert len(shard.counts) == 5000 and shard.bits.sum() == 5000
    assert (shard.probe(keys[:, 0].copy(), keys[:, 1].copy()) == np.arange(1, 5001)).all()
    other = rng.integers(-(1 << 62), 1 << 62, (5000, 2))
    assert not shard.probe(other[:, 0].copy(), other[:, 1].copy()).any()


@pytest.mark.parametrize("max_broadcast", [32 << 20, 0])
def test_counts_are_compared_when_probed(spark, max_broadcast):
    """An index of all lines drops the same as one of those at the threshold."""
    rows = [(i, "\n".join(["in all", f"in {i // 3}", f"own {i}", "", "in all"])) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [sorted(tuple(x) for x in line_dedup.drop_common_lines(df, min_docs=3, index_from=k, max_broadcast=max_broadcast, shard_keys=8).collect()) for k in (1, None)]
    assert got[0] == got[1] == sorted((i, f"own {i}\n", 5, 3) for i in range(24))


def test_a_perfect_hash_refuses_equal_keys():
    k = np.array([5, 5], np.int64)
    with pytest.raises(ValueError, match="distinct"):
        line_dedup.build_shard(0, k, k.copy(), np.array([1, 1]))
    close = np.array([[7, 1], [7, 2], [8, 1], [7 << 7, 1], [0, 0]], np.int64)
    assert line_dedup.Shard(line_dedup.build_shard(0, close[:, 0].copy(), close[:, 1].copy(), np.arange(5) + 1)).probe(close[:, 0].copy(), close[:, 1].copy()).tolist() == [1, 2, 3, 4, 5]


# piecewise hashes


def test_fingerprint_pairs(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8)))
    rows = [(k * 3, " ".join(word() for _ in range(r.choice([0, 1, 5, 200, 3000])))) for k in range(40)]
    rows += [(500, None), (501, rows[5][1]), (502, "é" * 5000), (503, "ab" * 100_000), (600, "tie"), (600, "tied")]
    got = piecewise_hash.fingerprint_pairs(docs(spark, rows).repartition(5), at_once=4).collect()
    assert len(got) == len(rows)
    order = sorted((i, t or "") for i, t in rows if i != 600)
    by = {x.doc_id: x for x in got}
    for (i, t), (_, following) in zip(order[:-1], order[1:], strict=True):
        k = len(t) // 4
        changed = t[: len(t) - k] + following[:k]
        x = by[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert x.fingerprint == piecewise_hash.fingerprint(t.encode()) and x.edited_fingerprint == piecewise_hash.fingerprint(changed.encode())
        assert 0 <= x.near_edited <= 1 and (x.near_edited == 1 or x.fingerprint != x.edited_fingerprint)
        if len(t) > 2000 and len(set(t)) > 5:
            assert x.near_edited > 0.5 and x.near_next < 0.3
    assert by[15].fingerprint == by[501].fingerprint


def test_last_row_meets_the_first(spark):
    got = {x.doc_id: x for x in piecewise_hash.fingerprint_pairs(docs(spark, [(1, "abcdefgh"), (2, "ijklmnop")])).collect()}
    assert got[2].edited_sha256 == hashlib.sha256(b"ijklmnab").hexdigest()
    alone = piecewise_hash.fingerprint_pairs(docs(spark, [(1, "abcdefgh")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1
    assert piecewise_hash.fingerprint_pairs(docs(spark, [])).collect() == []


def test_likeness_is_the_edit_distance():
    def lcs(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    r = random.Random(3)
    for _ in range(50):
        a = "".join(r.choice("ABC") for _ in range(r.randint(1, 64)))
        b = "".join(r.choice("ABC") for _ in range(r.randint(1, 64)))
        got = piecewise_hash._likeness([a], [b])[0]
        assert got in (0.0, pytest.approx(2 * lcs(a, b) / (len(a) + len(b))))


def test_stretches_do_not_change_a_fingerprint(monkeypatch):
    raw = random.Random(4).randbytes(50_000)
    want = piecewise_hash.fingerprint(raw)
    monkeypatch.setattr(piecewise_hash, "STRETCH", 777)
    assert piecewise_hash.fingerprint(raw) == want


# SimHash


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    comp = list(range(len(fps)))

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(fps))]


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(5)
    base = [" ".join(r.choice(["alpha", "Beta", "gamma", "delta", "é", "zeta"]) + str(r.randint(0, 30)) for _ in range(120)) for _ in range(8)]
    rows = []
    for k in range(80):
        words = r.choice(base).split(" ")
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = "changed"
        rows.append((k, r.choice([" ", "\n", " \t"]).join(words)))
    rows += [(200, None), (201, " \n"), (202, ""), (203, "one"), (204, "ONE"), (205, "one two"), (150, rows[3][1])]
    got = {x.doc_id: x for x in covering_simhash.near_duplicates(docs(spark, rows).repartition(3)).collect()}
    rows.sort()
    fps = [brute_simhash(t) for _, t in rows]
    comp = brute_components(fps)
    assert {i: (f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, comp, strict=True)} == {i: (x.fingerprint, x.component_id) for i, x in got.items()}
    kept = {x.doc_id for x in covering_simhash.one_of_each(docs(spark, rows)).collect()}
    assert kept == {i for i, x in got.items() if x.component_id == i}


@pytest.mark.parametrize(("most_bits", "few"), [(1 << 27, 1000), (1 << 27, 0), (1 << 15, 1000), (64, 0)])
def test_rows_without_the_gone(spark, most_bits, few):
    """By the bitmap alone, with a join of the marked rows, with a crowded bitmap, and by a join of all; clashing columns, null and repeated ids."""
    names = ["doc_id", "text", "key", "bits", "bucket", "place", "word", "stays", "gone", "spot"]
    rows = [(k if k % 50 else None, f"t{k}", *[k] * 8) for k in range(9000)] + [(7, "again", *[0] * 8), (8, "again", *[0] * 8)]
    table = spark.createDataFrame(rows, "doc_id int, text string, " + ", ".join(f"{c} long" for c in names[2:]))
    for dropped in ([], [k for k in range(9000) if k % 3 == 1 or k % 50 == 0]):
        gone = spark.createDataFrame([(k,) for k in dropped], "key long")
        got = covering_simhash.without(table, "doc_id", gone, most_bits=most_bits, few=few)
        assert got.columns == names
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(x) for x in rows if x[0] not in set(dropped))


def test_no_text_moves_where_the_bitmap_decides(spark):
    table = spark.createDataFrame([(k, f"t{k}") for k in range(100)], "doc_id long, text string")
    plan = covering_simhash.without(table, "doc_id", spark.createDataFrame([(3,)], "key long"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("bucket", [50_000, 2])
def test_components_of_chained_fingerprints(spark, bucket):
    """Chains, stars and far ones; small buckets take the finer tables."""
    r = random.Random(6)
    fps = []
    for _ in range(15):
        x = r.getrandbits(64)
        for _ in range(14):
            fps.append(x)
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(64)
    rows = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)]
    got = {x.doc_id: x.component_id for x in covering_simhash.components(spark.createDataFrame(rows, "doc_id long, fp long"), 2, bucket=bucket, share=50).collect()}
    assert got == dict(enumerate(brute_components(fps)))


def test_masks_cover():
    for radius in (1, 2):
        m = covering_simhash.masks(list(range(64)), radius)
        assert len(m) == (2 << radius) - 1
        assert all(any(not x >> i & 1 and not x >> j & 1 for x in m) for i in range(64) for j in (range(64) if radius == 2 else [i]))


def test_simhash_of_an_empty_table(spark):
    assert covering_simhash.near_duplicates(docs(spark, [])).collect() == []


# tokenizers


@settings(max_examples=400, deadline=None)
@given(odd_text)
def test_sentencepiece_equals_the_library(text):
    path = sp_chunks.default_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = sp.encode(text, add_bos=True, add_eos=True)
    assert sp_chunks.encode(path, text) == np.array(ids, "<u4").tobytes()
    assert sp_chunks.decode(path, [sp_chunks.encode(path, text)]) == [sp.decode(ids)]


@settings(max_examples=400, deadline=None)
@given(odd_text | st.lists(st.sampled_from(["the", "don't", " ", "  ", "\n", "<|endoftext|>", "Straße", "x1", "."]), max_size=8).map("".join))
def test_bpe_and_spans_equal_the_library(text):
    path = bpe_chunks.default_path()
    got = bpe_chunks.tokenizer(path).encode(text, add_special_tokens=False)
    assert bpe_chunks.encode(path, text) == np.array(got.ids, "<u4").tobytes()
    first, last = token_spans.spans(path, text)
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == got.offsets


def test_round_trip_query(spark):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (4, "x" * 5000), (5, "Hello  world\n"), (None, "a ▁b"), (6, "word " * 30_000)]
    got = sp_chunks.round_trip(docs(spark, rows), with_ids=True).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=sp_chunks.default_path())
    want = {i: sp.encode(t or "", add_bos=True, add_eos=True) for i, t in rows}
    for x in got:
        raw = np.array(want[x.doc_id], "<u4").tobytes()
        assert (x.n_tokens, x.ids_sha256, bytes(x.ids)) == (len(want[x.doc_id]), hashlib.sha256(raw).hexdigest(), raw)
        assert x.decoded_sha256 == hashlib.sha256(sp.decode(want[x.doc_id]).encode()).hexdigest()
    assert len(got) == len(rows) and sp_chunks.round_trip(docs(spark, [])).collect() == []


# sections


def brute_sections(offsets, bounds, rule):
    counts, outside = [0.0] * len(bounds), 0
    for a, b in offsets:
        met = sorted((s for s in range(len(bounds)) if min(b, bounds[s][1]) > max(a, bounds[s][0])), key=lambda s: bounds[s])
        share = [min(b, bounds[s][1]) - max(a, bounds[s][0]) for s in met]
        if not met:
            outside += 1
        elif rule == "share":
            for s, x in zip(met, share, strict=True):
                counts[s] += x / sum(share)
        else:
            counts[met[{"majority": share.index(max(share)), "start": 0, "end": -1}[rule]]] += 1
    return counts, outside


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(0, 30), max_size=8, unique=True).map(sorted), st.sampled_from(token_spans.RULES), st.randoms())
def test_attribution_equals_brute_force(sizes, cuts, rule, r):
    ends = np.cumsum(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
    starts = ends - np.array(sizes, np.int64)
    bounds = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)][:: r.choice([1, 2])]
    r.shuffle(bounds)
    counts, _, outside = token_spans.attribute(starts, ends, np.array(bounds, np.int64).reshape(-1, 2), rule)
    want, out = brute_sections(list(zip(starts.tolist(), ends.tolist(), strict=True)), bounds, rule)
    assert counts.tolist() == pytest.approx(want) and outside == out


def test_section_tokens(spark):
    rows = [(1, "one two\nthree"), (2, None), (3, "é😀\n\n"), (3, "é😀\n\n"), (None, "x " * 40_000)]
    got = token_spans.section_tokens(docs(spark, rows)).collect()
    path = bpe_chunks.default_path()
    total = {i: len(bpe_chunks.encode(path, t or "")) // 4 for i, t in rows}
    for i, n in {1: 1, 2: 1, 3: 2, None: 1}.items():
        assert sum(x.n_tokens for x in got if x.doc_id == i) == total[i] * n
    assert [(x.first, x.last) for x in got if x.doc_id == 1] == [(0, 8), (8, 13)]
    own = spark.createDataFrame([(1, "one two three", [(0, 3), (8, 13)]), (2, "a", None)], "doc_id long, text string, s array<struct<first:int,last:int>>")
    assert {(x.doc_id, x.section): x.n_tokens for x in token_spans.section_tokens(own, sections_col="s").collect()} == {(1, 0): 1, (1, 1): 1, (1, -1): 1, (2, -1): 1}


# packing


def check_packing(pieces, ids, limits):
    """pieces: (document, start, length, sequence, offset, loss)"""
    by_doc, by_seq = {}, {}
    for d, start, n, s, at, loss in pieces:
        assert n > 0
        by_doc.setdefault(d, []).append((start, n))
        by_seq.setdefault(s, []).append((at, n, loss))
    for d, total in ids.items():
        end = 0
        for start, n in sorted(by_doc[d]):
            assert start == end
            end += n
        assert end == total
    padding = 0
    for own in by_seq.values():
        end = 0
        for at, n, _ in sorted(own):
            assert at == end
            end += n
        assert end <= limits.tokens and len(own) <= limits.segments and sum(x[2] for x in own) <= limits.loss
        padding += 0 if end & (end - 1) == 0 else limits.tokens - end
    return padding


@pytest.mark.parametrize("group_ids", [1 << 24, 3000])
@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 20), Limits(16, 2, 16), Limits(32, 100, 5)])
def test_packing_keeps_all_limits(limits, group_ids):
    r = random.Random(7)
    items = [(k, r.choice([1, 1, 2, 7, 40, 300, 5000]), r.choice([0, 0, 3, 200])) for k in range(700)]
    pieces = []
    for s, seq in enumerate(vector_packing.pack(items, limits, 64, group_ids)):
        at = 0
        for p in seq.pieces:
            pieces.append((p.doc, p.start, p.size, s, at, p.loss))
            at += p.size
    assert check_packing(pieces, {k: n for k, n, _ in items}, limits) == 0


def test_pack_documents(spark):
    r = random.Random(8)
    rows = [(k, " ".join(f"w{r.randint(0, 999)}" for _ in range(r.choice([0, 1, 30, 900])))) for k in range(120)] + [(500, None), (501, "long " * 40_000)]
    path = bpe_chunks.default_path()
    ids = {i: bpe_chunks.encode(path, t or "") + b"\0\0\0\0" for i, t in rows}
    got = vector_packing.pack_documents(docs(spark, rows).repartition(3)).collect()
    for x in got:
        assert x.ids_crc32 == zlib.crc32(ids[x.doc_id][4 * x.start : 4 * (x.start + x.length)]) and x.doc_tokens == len(ids[x.doc_id]) // 4
    assert check_packing([(x.doc_id, x.start, x.length, x.sequence_id, x.offset, 0) for x in got], {i: len(b) // 4 for i, b in ids.items()}, Limits()) == 0
    assert vector_packing.pack_documents(docs(spark, [])).collect() == []


def test_pack_instructions(spark):
    """Prompts bear no loss."""
    df = spark.createDataFrame([(k, "question " * 20, "answer " * 30) for k in range(30)], "doc_id long, prompt string, text string")
    limits = Limits(256, 8, 64)
    got = vector_packing.pack_documents(df, prompt_col="prompt", limits=limits).collect()
    prompt = len(bpe_chunks.encode(bpe_chunks.default_path(), "question " * 20)) // 4
    loss = lambda x: max(0, x.start + x.length - max(x.start, prompt))
    check_packing([(x.doc_id, x.start, x.length, x.sequence_id, x.offset, loss(x)) for x in got], {x.doc_id: x.doc_tokens for x in got}, limits)
    with pytest.raises(ValueError):
        Limits(1000)


def test_repeated_rows_are_packed_one_by_one(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (1, "same text"), (None, None)], "doc_id long, text string").coalesce(1)
    got = vector_packing.pack_documents(df).collect()
    n = {x.doc_tokens for x in got if x.doc_id == 1}.pop()
    assert sum(x.length for x in got if x.doc_id == 1) == 3 * n and sum(x.length for x in got if x.doc_id is None) == 1
    assert vector_packing.pack_documents(df.limit(0)).collect() == []


def test_section_tokens_of_an_empty_table(spark):
    assert token_spans.section_tokens(spark.createDataFrame([], "doc_id long, text string"), rule="majority").collect() == []


def test_one_table_of_chunks_equals_whole_texts(spark):
    """Each distinct chunk is segmented once, whatever the number of its rows, and ids come back by position."""
    r = random.Random(12)
    words = ["the", "of", "é", "", "wörd", "x" * 90, "😀", "a\nb"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for k in range(80)] + [(90, None), (90, None), (91, "with ▁ marker"), (92, "with ▁ marker"), (None, " lead  and trail  "), (93, "the " * 20_000)]
    df = docs(spark, rows).repartition(5)
    path = sp_chunks.default_path()
    for share in (1000, 3):
        got = sorted((tuple(x) for x in sp_chunks.by_table(df, share=share).collect()), key=repr)
        assert got == sorted((tuple(x) for x in sp_chunks.round_trip(df).collect()), key=repr)
    plain = df.select("text").withColumn("row", F.monotonically_increasing_id())
    table = sp_chunks.chunk_table(sp_chunks.occurrences(plain, path), path).collect()
    assert len(table) == len({(x.whole, x.chunk) for x in table})
    assert {x.chunk: x.n for x in table if x.whole} == {"": 2 + sum(t == "" for _, t in rows), "with ▁ marker": 2}
    assert sp_chunks.by_table(df.limit(0)).collect() == []


def _lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_common_order_is_the_longest():
    r = random.Random(12)
    for _ in range(400):
        a, b = ([r.choice("abcde"[: r.randint(1, 5)]) for _ in range(r.randrange(12))] for _ in "ab")
        got = wrappers.common_order(a, b)
        assert all(a[i] == b[j] for i, j in got) and len(got) == _lcs(a, b)
        assert all(p < q and s < t for (p, s), (q, t) in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("kind", ["unlike", "shuffled", "few tags", "one more in front"])
def test_wide_pages_align_in_linear_memory(kind):
    import time
    import tracemalloc

    n, r = 50_000, random.Random(13)
    a = [f"div x{k}q" if kind != "few tags" else r.choice(["p", "li", "div a"]) for k in range(n)]
    b = {"unlike": lambda: [f"div y{k}q" for k in range(n)], "shuffled": lambda: r.sample(a, n), "few tags": lambda: [r.choice(["p", "li", "div b"]) for _ in range(n)], "one more in front": lambda: ["p", *a, "p"]}[kind]()
    tracemalloc.start()
    start = time.time()
    nodes = lambda sigs: [[s, [], 0, 0, [], 0, 0, {}] for s in sigs]
    out = wrappers.align(nodes(a), nodes(b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.time() - start < 60 and peak < 400 << 20
    merged = len(a) + len(b) - len(out)
    assert merged == {"unlike": 0, "one more in front": n}.get(kind, merged) and (kind != "shuffled" or merged > 300)


def test_names_inside_an_article_that_may_be_its_subject():
    page = "<html><body><div class='sidebar'>side</div><article><h1>Title</h1>{}<p>last words</p></article></body></html>"
    for kept in ("subscribe-model", "comments-on-method", "social history", "share-of-market", "notice period"):
        assert wrappers.main_text(page.format(f"<div class='{kept}'>own text</div>"), None) == "Title own text last words", kept
    for cut in ("ad-slot", "comments-section", "newsletter-box", "cookie-banner", "social", "social share buttons", "related-posts", "ad", "comment-list comments"):
        assert wrappers.main_text(page.format(f"<div class='{cut}'>other text</div>"), None) == "Title last words", cut
