import hashlib
import random
from collections import Counter

import public_tokenizers as P
from pyspark.sql import functions as F

from palimpsest.llm import cross_tokens

WORDS = ["the", "banana", "naïve", "日本語", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "😀", "12345", "x\ty", "é", "é", " "]


def _brute(rows):
    """One pair of tokens after the other, with the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    bpe = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    bpe.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    made = []
    for key, text in rows:
        text = text or ""
        a, b = bpe.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        pa = [bytes(of[c] for c in bpe.id_to_token(i)) for i in a]
        pb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        want = (" " + text).encode()
        if not text or b"".join(pa) != want or b"".join(pb) != want:
            made.append((key, [], [], [], ""))
            continue
        spans = [[(sum(map(len, p[:k])), sum(map(len, p[: k + 1]))) for k in range(len(p))] for p in (pa, pb)]
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (u, v) in zip(b, spans[1], strict=True) if s < v and u < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        low, groups = 0, []
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, sp_, strict=True) if low < e <= c) for ids, sp_ in ((a, spans[0]), (b, spans[1]))))
            low = c
        made.append((key, a, b, links, ";".join(groups)))
    count = Counter(p for m in made for p in set(m[3]))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return sorted((key, len(a), len(b), g.count(";") + 1 if g else 0, len(ln), sum(count[p] == most[p[0]] for p in ln), sum(count[p] for p in ln), sha(g)) for key, a, b, ln, g in made)


def _rows(df, **more):
    return sorted(tuple(r) for r in cross_tokens.alignment(df, **more).collect())


def _texts(n, seed=5):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(WORDS) + rng.choice(["", " ", "\n", "  "]) for _ in range(rng.randrange(25))) for _ in range(n)]
    return [(k, rng.choice(texts[: max(1, n // 3)]) if k % 3 == 0 else t) for k, t in enumerate(texts)]


def test_equals_brute_force(spark):
    rows = [*_texts(120), (500, None), (501, ""), (502, " "), (503, "▁"), (504, "same"), (504, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("a", F.lit(2)).repartition(4)
    want = _brute(rows)
    assert _rows(df) == want
    assert sum(w[1] > 0 for w in want) > 60 and sum(w[3] < w[4] for w in want) > 30
    assert _rows(df, max_pairs=0) == want  # the counts joined, frequent pairs apart


def test_the_registered_query_equals_brute_force(spark, tmp_path):
    from palimpsest.llm.queries import op13_cross_tokens

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in op13_cross_tokens(spark, str(tmp_path)).collect()) == _brute(rows)


def test_each_distinct_text_is_aligned_once(spark):
    df = spark.createDataFrame([(k, "shared text" if k % 3 else f"own {k}") for k in range(300)], "doc_id long, text string").repartition(6)
    table = cross_tokens.aligned_texts(df).collect()
    assert len(table) == 101 and sum(r.n for r in table) == 300 and max(r.n for r in table) == 200
    pairs = cross_tokens.pair_counts(cross_tokens.aligned_texts(df)).collect()
    assert max(r.n for r in pairs) == 200


def test_a_hot_text_stays_out_of_the_shuffled_join(spark):
    df = spark.createDataFrame([(k, "hot" if k % 2 else f"cold {k}") for k in range(4000)], "doc_id long, text string")
    rows = _rows(df)
    assert len(rows) == 4000 and len({r[1:] for r in rows if r[0] % 2}) == 1


def test_edges(spark):
    schema = "doc_id long, text string"
    assert _rows(spark.createDataFrame([], schema)) == []
    long = "word " * 150_000
    rows = _rows(spark.createDataFrame([(1, long), (2, None)], schema))
    assert rows[1] == (2, 0, 0, 0, 0, 0, 0, "")
    assert rows[0][1] > 150_000 and rows[0][4] == rows[0][1] + rows[0][2] - rows[0][3]
