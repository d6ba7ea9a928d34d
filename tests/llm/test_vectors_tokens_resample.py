"""Vector codes, token-id files and importance resampling against brute force on small rows with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from paperloom.llm import resample, tokenids, vectors

WORDS = P.path("word_bpe_49k.json")


# --- 11 ---


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(codes, error) of rows (vec_id, vector) and the codebooks, all distances taken."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(cut(v, p), books[p])[1] for _, v in kept]
            for k in range(len(books[p])):
                mine = [cut(v, p) for (_, v), o in zip(kept, own) if o == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[near(cut(v, p), books[p]) for p in range(parts)] for _, v in kept]
    return Counter((i, tuple(k for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, found)), books


def vector_rows(n, grid, seed=3):
    """On a coarse grid distances tie often, and entries coincide."""
    rnd = random.Random(seed)
    value = (lambda: rnd.randint(-2, 2) / 4) if grid else (lambda: rnd.gauss(0, 0.3))
    rows = [(i * 2, [float(np.float32(value())) for _ in range(16)]) for i in range(n)]
    rows += [(1, None), (3, [None, *rows[0][1][1:]]), (5, [math.nan] * 16), (7, [math.inf, *rows[0][1][1:]]), (None, rows[n - 1][1]), (8, rows[2][1]), (8, rows[2][1]), (8, rows[1][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "grid"), [(300, False), (300, True), (5, False)])
def test_vector_codes(spark, monkeypatch, n, grid):
    monkeypatch.setattr(vectors, "AT_ONCE", 7)
    rows = vector_rows(n, grid)
    frame = [(i, v, None if k % 5 == 0 else k % 3, "x", 1) for k, (i, v) in enumerate(rows)]
    found = vectors.compress(spark.createDataFrame(frame, "vec_id long, embedding array<float>, label int, code string, slot int").repartition(5))
    want, books = lloyd(rows)
    got = vectors.with_label_error(found.rows).collect()
    assert Counter((r.vec_id, tuple(r.codes), r.error) for r in got) == want and found.books.tolist() == books
    sums = Counter()
    for r in got:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in got) and len(sums) == 4
    monkeypatch.setattr(vectors, "FEW_LABELS", 0)
    assert Counter(map(tuple, (r[:2] + r[3:] for r in vectors.with_label_error(found.rows).select("vec_id", "label", "codes", "error", "label_error").collect()))) == Counter((r.vec_id, r.label, r.error, r.label_error) for r in got)
    if n > 100 and not grid:  # bounds save most of the scans
        assert found.scanned[0] == 8 * len(got) and sum(found.scanned[3:]) < 2 * len(got) * 8
    near = vectors.restored(found.rows, found.books).first()
    assert len(near["restored"]) == 16 and sum(near["codes"]) >= 0


def test_no_vectors_and_unlike_widths(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.with_label_error(vectors.compress(spark.createDataFrame([(1, None, 1)], schema)).rows).count() == 0
    with pytest.raises(ValueError, match="width"):
        vectors.compress(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], schema))


def test_clustered_vectors_are_compressed_well(spark):
    rnd = np.random.default_rng(1)
    middle = rnd.normal(0, 1, (16, 16))
    rows = [(i, (middle[i % 16] + rnd.normal(0, 0.01, 16)).tolist(), i % 16) for i in range(800)]
    found = vectors.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    back = {r.vec_id: r.restored for r in vectors.restored(found.rows, found.books).collect()}
    assert max(np.abs(np.array(back[i]) - v).max() for i, v, _ in rows) < 0.08
    assert sum(found.scanned[1:]) < 0.05 * 6 * 8 * 800  # none but the first pass scans much


# --- 12 ---

TEXTS = ["Hello World's it's 42 <tag> naïve ÀÉÎ  İstanbul\tnew\nline", "日本語 mixed ᾈΣς text ﬁ", "<|endoftext|> spelt out <|startoftext|>", "é combining   nbsp em", "a" * 5000, "Ab1 " * 3000,
         "I'LL don't we've 'S 's", "٣٤ Ⅷ ½ x²", "", " ", None, "ǅ Ǆ ẞ ß ſ \x1c\x85 end", "&amp; #hash @user http://x.y/z?q=1"]


def test_token_id_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    alphabet = "abcXYZéÉßİıŁ0189 '’.,!?-_\n\t½²ªº×÷"
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    rows = [(i * 3, t, 1, "y") for i, t in enumerate(texts)] + [(9, "again", 1, "y"), (9, "again", 1, "y"), (None, "no id", 1, "y"), (None, None, 1, "y")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, ids string").repartition(4)
    tokenids.write(docs, WORDS, str(tmp_path / "t"))
    back = tokenids.read(spark, str(tmp_path / "t"))
    library = Tokenizer.from_file(WORDS)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    got = sorted(back.collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(ids(t))) for i, t, _, _ in rows)
    at = 0
    for r in got:  # gapless, in the order of ids, nulls last
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is None, i or 0))
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in tokenids.checked(back).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    some = tokenids.lookup(spark, str(tmp_path / "t"), [9, 300, 100_000])
    assert Counter((r.doc_id, r.start) for r in some.collect()) == Counter((r.doc_id, r.start) for r in got if r.doc_id in (9, 300))
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan
    files = tokenids.parts(spark, str(tmp_path / "t")).collect()
    assert sum(r.n_docs for r in files) == len(rows) and sum(r.n_ids for r in files) == at
    files.sort(key=lambda r: r.part)
    assert all(a.last_id <= b.first_id for a, b in zip(files, files[1:]) if b.first_id is not None)


def test_files_have_indexes_blooms_and_stripes(spark, tmp_path):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.sha2(F.concat("id", F.lit(f"{k}")), 256) for k in range(12))).alias("text")).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tokenids.write(rows, WORDS, str(tmp_path / "t"), stripe_mb=1, index_rows=1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    name = next((tmp_path / "t" / "ids").glob("*.orc"))
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(name)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() > 1
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
    assert (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds and (2, "BLOOM_FILTER_UTF8") not in kinds
    encodings = [c.getKind().toString() for c in footer.getColumnsList()]
    assert encodings[1] == encodings[6] == "DIRECT_V2"  # integer run-length encoding


def test_no_token_ids(spark, tmp_path):
    tokenids.write(spark.createDataFrame([], "doc_id long, text string"), WORDS, str(tmp_path / "t"))
    assert tokenids.read(spark, str(tmp_path / "t")).count() == 0


# --- 13 ---


def drawn(rows, target, seed=42, buckets=10_000):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    runs = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    docs = [(i, w := words(t), runs(w)) for i, t in rows]
    s, t = Counter(b for _, _, r in docs for b in r), Counter(b for x in target for b in runs(words(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, w, r in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, r))
        out.append([i, len(r), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return [tuple(x[:4]) for x in out], [tuple(x[:4]) for x in able[: 5 * len(able) // 100]]


def resample_rows(n=400, seed=6):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdé日9") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    text = lambda k: rnd.choice([" ", "-", "\n", "? "]).join(rnd.choice(vocabulary).title() for _ in range(k))
    rows = [(i * 5, text(rnd.randint(0, 90))) for i in range(n)]
    rows += [(1, None), (2, ""), (3, "?! \x00"), (4, "one"), (6, "one two"), (7, text(20_000)), (None, text(60)), (None, text(50)), (8, rows[0][1]), (8, rows[0][1]), (9, "x " * 9000), (11, text(20)), (12, text(19))]
    return rows, [text(rnd.randint(5, 60)) for _ in range(30)] + [None, ""]


@pytest.mark.parametrize(("chunk", "long"), [(4096, 8192), (3, 10)])
def test_resampling(spark, monkeypatch, chunk, long):
    rows, target = resample_rows()
    cut = resample.hashed
    monkeypatch.setattr(resample, "hashed", lambda x, n, buckets: cut(x, n, buckets, long, chunk))
    docs = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, score int, _rid int, words string").repartition(6)
    got = resample.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    every, want = drawn(rows, target)
    assert Counter(tuple(r[:4]) for r in got) == Counter(every)
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [tuple(r[:4]) for r in ranked] == want and [r.rank for r in ranked] == list(range(1, len(want) + 1)) and len(want) >= 15


def test_chunks_carry_what_runs_need(spark):
    text = " ".join(f"w{i}" for i in range(10))
    got = resample.chunks(spark.createDataFrame([(1, text)], "_rid long, words string"), 3, 4).collect()
    assert [(r.own, bytes(r.words).decode()) for r in got] == [(4, "w0 w1 w2 w3 w4 w5"), (4, "w4 w5 w6 w7 w8 w9"), (2, "w8 w9")]


def test_resampling_goes_towards_the_target(spark):
    rnd = random.Random(2)
    word = lambda a: f"{a}{rnd.randint(0, 30)}"
    rows = [(i, " ".join(word("near" if i % 10 == 0 else "far") for _ in range(40))) for i in range(400)]
    target = [(" ".join(word("near") for _ in range(40)),) for _ in range(40)]
    got = resample.resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(target, "text string")).where("rank is not null").collect()
    assert len(got) == 20 and all(r.doc_id % 10 == 0 for r in got)


def test_nothing_to_resample(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resampled(none, none).count() == 0
    few = resample.resampled(spark.createDataFrame([(1, "a b " * 15)], "doc_id long, text string"), none).collect()
    assert few[0].n_features == 87 and few[0]["rank"] is None
