"""Operators on texts against brute force: suffix dedup, line dedup, quality rules, BPE."""

import hashlib
import random
import re
from collections import Counter

import pytest

from linkmap.llm import bpe, line_dedup, quality, suffix_dedup
from linkmap.llm.common import SPACE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("doc_id", "text", "'x' n_lines", "1 n_bytes", "2 failed_bits", "3 n_tokens", "'k' kept", "4 ids")
    return df.repartition(3)


def suffix_brute(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        lost = set()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                lost.update(range(s, s + length))
            seen.add(w)
        out[i] = (len(b), len(lost), sum(k - 1 not in lost for k in lost), bytes(x for k, x in enumerate(b) if k not in lost))
    return out


@pytest.mark.parametrize("length,hot,windows", [(100, 200_000, 1 << 20), (50, 2, 1 << 20), (60, 200_000, 500)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, length, hot, windows):
    monkeypatch.setattr(suffix_dedup, "WINDOWS", windows)
    rng = random.Random(length)
    passages = ["".join(rng.choice("abcdé fgh") for _ in range(rng.choice([60, 150, 400]))) for _ in range(8)]
    docs = []
    for i in range(80):
        t = "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 6)))
        t = "ab" * rng.randint(0, 200) if rng.random() < 0.1 else docs[-1][1] if docs and rng.random() < 0.1 else t
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, "x" * 270_000 + passages[0])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, docs, True), length, hot).collect()}
    assert got == suffix_brute(docs, length)


def test_suffix_dedup_edges(spark):
    t = "the same long passage " * 8
    rows = [(1, t), (1, t), (2, t), (None, t), (3, "é" * 120), (4, "éx" + "é" * 119)]
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_removed == r.n_bytes, r.text) for r in suffix_dedup.suffix_dedup(frame(spark, rows), 100).collect())
    rng = random.Random(1)
    own = ["".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(12)]
    equal = [(i, t) for i, t in enumerate(own)] * 3 + [(50, own[3] + "x")]
    for hot in (50_000, 1):  # equal rows are one place and keep their text; the later copy loses it
        assert {(r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(frame(spark, equal), 100, hot).collect()} == {(i, 0) for i in range(12)} | {(50, 900)}
    # the row without id is first and keeps its first period; equal rows count as one place
    assert [x[1] for x in got[:4]] == [False, True, True, True]
    assert all("�" not in x[2] for x in got)
    assert suffix_dedup.suffix_dedup(frame(spark, []), 100).collect() == []


def test_suffix_dedup_tells_texts_of_one_id_apart(spark):
    """Two texts of one id whose 32-bit hashes are equal, and very many rows without id."""
    from pyspark.sql import functions as F

    made = spark.range(300_000).select(F.concat_ws("-", F.sha2(F.col("id").cast("string"), 512), F.md5(F.col("id").cast("string"))).alias("t"))
    same = made.groupBy(F.hash("t")).agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").first().ts
    rows = [(1, same[0]), (5, same[0]), (5, same[1])]
    got = {(r.doc_id, r.n_bytes - r.n_removed) for r in suffix_dedup.suffix_dedup(frame(spark, rows), 100).collect()}
    assert got == {(1, len(same[0])), (5, 0), (5, len(same[1]))}
    many = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws("-", F.sha2(F.col("id").cast("string"), 512), F.lit("x")).alias("text"))
    assert suffix_dedup.suffix_dedup(many, 100).where("n_removed > 0").count() == 0


def test_anchors_of_very_many_runs_are_split(spark):
    """A passage of one anchor amid other bytes: no task may hold its rows whole."""
    rng = random.Random(3)
    common = "z" * 70
    docs = [(i, "".join(rng.choice("abcdefgh") for _ in range(90)) + common + "".join(rng.choice("abcdefgh") for _ in range(rng.choice([40, 90])))) for i in range(120)]
    docs += [(i + 500, t[30:]) for i, t in docs[:40]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, docs), 100, hot=5).collect()}
    assert got == suffix_brute(docs, 100)


def skewed(spark, run):
    """Whether a join of the plan was split where a key is hot, with Spark's thresholds brought down to a fixture's size."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = run()
        df.collect()
        return "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_keys_are_split(spark):
    from linkmap.llm import warc

    hot = "one line that all documents of this table hold, over forty characters"
    docs = spark.range(0, 20_000, 1, 16).selectExpr("id doc_id", f"concat('own line of this document, over forty characters ', sha1(string(id)), '\n{hot}') text")
    assert skewed(spark, lambda: line_dedup.line_dedup(docs))
    pages = spark.range(0, 20_000, 1, 16).selectExpr("id page_id", "'u' url", "case when id % 2 = 0 then '' else sha1(string(id)) end html")
    assert skewed(spark, lambda: warc.mark_revisits(pages))


def line_brute(docs, min_chars=40, min_docs=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    holders = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and i != max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    common = ["A common line that many documents hold, İ %d ........" % i for i in range(6)] + ["short"]
    docs = [(i, "\n".join(rng.choice(common) + rng.choice(["", " ", "\t\x0b"]) if rng.random() < 0.6 else "own %d %f %s" % (i, rng.random(), "z" * 40) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, common[0].upper()), (103, "\n\n")]
    out = line_dedup.line_dedup(frame(spark, docs, True))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()} == line_brute(docs)
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_line_dedup_counts_repeated_rows_once(spark):
    x = "this line is surely longer than forty characters"
    rows = [(1, x)] * 6 + [(2, x), (None, x), (3, x)]
    assert all(r.n_dropped == 0 for r in line_dedup.line_dedup(frame(spark, rows)).collect())  # four documents
    got = [(r.doc_id, r.n_dropped) for r in line_dedup.line_dedup(frame(spark, [*rows, (4, x)])).collect()]
    assert sorted(got, key=str) == sorted([(1, 1)] * 6 + [(2, 1), (3, 1), (4, 0), (None, 1)], key=str)


def quality_brute(t):
    t = t or ""
    words = WORD.findall(t)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x x x x x", "ä# |<>\nä# |<>\n \n", "a\xa0b c"] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))).replace(" a ", "\n") for _ in range(60)]
    rows = quality.ledger(frame(spark, list(enumerate(texts)), True))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows.collect()}
    assert got == {i: quality_brute(t) for i, t in enumerate(texts)}
    base = {r.doc_id: r.p for r in rows.select("doc_id", quality.passes(quality.BASE).alias("p")).collect()}
    assert base == {i: not (b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, b in got.items()}


def test_quality_plan_has_no_python(spark):
    plan = quality.ledger(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_ablation(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failed_bits long")
    got = {r.rule: (r.n, r.n_fails, r.n_only, r.n_kept_without) for r in quality.ablation(rows, quality.BASE).collect()}
    assert got == {"few_words": (5, 3, 2, 4), "repeated_windows": (5, 1, 0, 2)}
    assert {r.rule: r.n for r in quality.ablation(rows.limit(0), quality.BASE).collect()} == {"few_words": 0, "repeated_windows": 0}


def test_bpe_equals_the_library(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ref = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = [None, "", " ", "a<|endoftext|>b  c", " \n x", "it's  'll\n\n\t q  ", "日本語 texte 👍🏽", "\x1c a\x85 b c", "a" * 5000]
    texts += ["".join(rng.choice("ab thein' \n\t.,1aé日<|>endoftext ") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    out = bpe.decode(bpe.encode(frame(spark, list(enumerate(texts)), True), path), path).collect()
    assert len(out) == len(texts)
    for r in out:
        want = ref.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == ref.decode(want, skip_special_tokens=False)


def test_bpe_words_equal_merging_by_hand():
    import public_tokenizers

    t = bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    for _ in range(3000):
        word = bytes(rng.choice(b" abcdefghilmnorstu") for _ in range(rng.randint(1, 14)))
        ids = [t.id_of[bytes([b])] for b in word]
        while True:
            best = min(((t.merged[x << 32 | y], k) for k, (x, y) in enumerate(zip(ids, ids[1:], strict=False)) if x << 32 | y in t.merged), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [t.id_of[t.bytes[ids[k]] + t.bytes[ids[k + 1]]]]
        assert t.ids(word) == ids, word


def test_kept_digest_is_of_utf8(spark):
    from pyspark.sql import functions as F

    out = line_dedup.line_dedup(frame(spark, [(1, "é\nb")])).select(F.sha2("text", 256).alias("h")).first()
    assert out.h == hashlib.sha256("é\nb".encode()).hexdigest()
