"""Sequence kernels and relations against plain models."""

import gzip
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkmap.functions import columns as C
from linkmap.functions import kernels as K
from linkmap.operators import numbers, repeats, sequences
from linkmap.sources import simulate, sinks, tables

M = (1 << 64) - 1
DNA = st.text(alphabet="ACGTacgtN", max_size=90)


def mix(x):
    x = (~x + (x << 21)) & M
    x ^= x >> 24
    x = (x + (x << 3) + (x << 8)) & M
    x ^= x >> 14
    x = (x + (x << 2) + (x << 4)) & M
    x ^= x >> 28
    return (x + (x << 31)) & M


def fnv(b):
    h = 0xCBF29CE484222325
    for x in b:
        h = ((h ^ x) * 0x100000001B3) & M
    return h


def kmers(s, k):
    comp = {"A": "T", "C": "G", "G": "C", "T": "A"}
    out = []
    for i in range(len(s) - k + 1 if k else 0):
        w = s[i : i + k]
        if set(w.upper()) <= set("ACGT"):
            back = "".join(comp[c] for c in reversed(w.upper()))
            value = (lambda t: sum("ACGT".index(c) << 2 * (k - 1 - j) for j, c in enumerate(t.upper()))) if k <= 32 else (lambda t: fnv(t.encode()))
            out.append((i, min(value(w), value(back))))
    return out


@settings(max_examples=150, deadline=None)
@given(DNA, st.sampled_from([1, 4, 7, 16, 31, 32, 33, 40]), st.integers(1, 9))
def test_kernels_equal_the_model(s, k, w):
    model = kmers(s, k)
    at, x = K.canonical_kmers(s.encode(), k)
    assert list(zip(at.tolist(), x.tolist(), strict=True)) == model
    h = [(mix(v), i) for i, v in model]
    short, starts = K.compress_runs(s.encode())
    assert starts.tolist() == [i for i in range(len(s)) if not i or s[i] != s[i - 1]] and short.decode() == "".join(s[i] for i in starts)


@settings(max_examples=120, deadline=None)
@given(st.lists(DNA, max_size=6), st.sampled_from([1, 4, 16, 32, 33]), st.integers(0, 9))
def test_many_sequences_equal_the_model_of_each(seqs, k, w):
    data = [s.encode() for s in seqs]
    row, at, x = K.kmers_of(data, k)
    found = [K.minimizers_of(data, k, w), K.minimizer_positions_of(data, k, w), K.minimizers_of_hashes(row, K.mix64(x), w)]
    for i, s in enumerate(seqs):
        model = kmers(s, k)
        assert list(zip(at[row == i].tolist(), x[row == i].tolist(), strict=True)) == model
        h = [(mix(v), j) for j, v in model]
        mins = [min(h[j : j + w]) for j in range(len(h) - w + 1)] if w else []
        loose = [min(h[j : j + w])[0] for j in range(max(1, len(h) - w + 1))] if h and w else []
        want = [list(dict.fromkeys(v for v, _ in mins)), list(dict.fromkeys(j for _, j in mins)), [v for j, v in enumerate(loose) if not j or v != loose[j - 1]]]
        assert [v[r == i].tolist() for r, v in found] == want


def test_counts_and_sketches_of_reads(spark):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    reads = [genome[i : i + 60].lower() if i % 3 else genome[i : i + 60] for i in range(0, 340, 7)] * 2
    df = spark.createDataFrame([(s,) for s in reads], "seq string").repartition(3)
    count = Counter(v for s in reads for _, v in kmers(s, 9))
    got = {r.code & M: r.n for r in repeats.kmer_counts(df, 9).collect()}
    assert got == count
    least = 12
    want = {v for v, n in count.items() if n >= least}
    near = {r.code & M for r in repeats.approximate_repeats(df, 9, least, 1 << 14).collect()}
    assert want <= near and len(near - want) <= 3
    sketch = repeats.approximate_counts(df, 9, 1 << 17)
    codes = np.array(list(count), np.uint64)
    assert (sketch.query(codes) >= np.array([count[int(c)] for c in codes])).all()


def test_packed_kmers_are_few_bytes_and_give_back_all(monkeypatch):
    rng = random.Random(12)
    seqs = ["".join(rng.choice("ACGTacgtN" if j % 5 == 0 else "ACGT") for _ in range(rng.choice([0, 3, 40, 150]))).encode() for j in range(300)] + [b"A" * 900]
    for k in (1, 9, 16, 31, 32):
        for least in (50, 1 << 30):  # with and without hot buckets
            monkeypatch.setattr(K, "HOT_LEAST", least)
            got = Counter()
            packed = K.packed_kmers(seqs, k)
            for bucket in {x[0] for x in packed}:
                for _, counted, n, data in (x for x in packed if x[0] == bucket):
                    found = {v: int(c) for v, c in zip(np.frombuffer(data, "<u8"), np.frombuffer(n, "<i8"))} if counted else Counter(K.unpacked_kmers([n], [data], k).tolist())
                    got.update({int(v): c for v, c in found.items()})
            assert got == Counter(K.kmers_of(seqs, k)[2].tolist()), (k, least)
    reads = ["".join(rng.choice("ACGT") for _ in range(150)).encode() for _ in range(2000)]
    packed = K.packed_kmers(reads, 16)
    assert sum(len(n) + len(data) for _, _, n, data in packed) < 2 * 135 * 2000  # they were 16 bytes each
    assert K.packed_kmers([], 5) == K.packed_kmers([b"ACG"], 5) == K.packed_kmers([b"NNNNNNN"], 5) == []


def test_incidence_is_told_apart_before_it_moves(spark):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(600))
    rows = []
    for i in range(300):
        a = rng.randrange(500)
        rows.append((i, [f"r{i} BX:Z:hot", f"r{i} BX:Z:b{i % 7}", f"r{i}", None][i % 4], None if i % 50 == 1 else genome[a : a + 80]))
    df = spark.createDataFrame(rows, "rec_no long, header string, seq string").repartition(3)
    counts = Counter(v for _, _, s in rows if s for _, v in kmers(s, 9))
    drop = {v for v, n in counts.items() if n >= 30}
    rep = repeats.repeated_kmers(repeats.kmer_counts(df, 9), 30)
    for some in (None, rep):
        want = set()
        for i, head, s in rows:
            key = None if head is None else head.split("Z:")[1] if "Z:" in head else head
            h = [mix(v) for _, v in kmers(s or "", 9) if some is None or v not in drop]
            starts = range(max(1, len(h) - 4)) if some is not None and h else range(len(h) - 4)
            want |= {(key, min(h[j : j + 5])) for j in starts}
        for more in ({}, {"together": 20}, {"exact": 3}):
            got = [(r.bx, r.mx & M) for r in sequences.index_linked(df, 9, 5, some, **more).collect()]
            assert len(got) == len(set(got)) and set(got) == want, more
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a barcode in several batches
    try:
        got = [(r.bx, r.mx & M) for r in sequences.index_linked(df, 9, 5, rep).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = sequences.index_linked(df, 9, 5, rep)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1  # reads move, not their minimizers


def test_columns(spark):
    heads = ["read1 BX:Z:ACGTACGT-1 more", "read1#123_456_789", "r#0", "r#0_0_0", "plain", "a#b BX:Z:x", "r BX:Z: y"]
    got = [r.b for r in spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string").orderBy("i").select(C.barcode(F.col("h")).alias("b")).collect()]
    assert got == ["ACGTACGT-1", "123_456_789", None, None, None, "x", ""]
    rc = spark.createDataFrame([("AACG",), ("acgt",), ("ACNGT",), ("ARn",)], "s string").select(C.reverse_complement(F.col("s")).alias("r"))
    assert [r.r for r in rc.collect()] == ["CGTT", "acgt", "ACNGT", "nNT"]
    xs = [0, 1, -1, 2**62, -(2**63), 123456789]
    rows = spark.createDataFrame([(x,) for x in xs], "x long").select("x", C.mix64(F.col("x")).alias("m"), C.to_unsigned_text(F.col("x")).alias("t")).withColumn("b", C.from_unsigned_text(F.col("t"))).collect()
    assert all(r.m & M == mix(r.x & M) and r.t == str(r.x & M) and r.b == r.x for r in rows)
    bad = spark.createDataFrame([("x",), ("18446744073709551616",), ("",)], "t string").select(C.from_unsigned_text(F.col("t")).alias("b")).collect()
    assert all(r.b is None for r in bad)


def test_filtered_minimizers(spark):
    rng = random.Random(4)
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(rng.choice([10, 20, 60])))) for i in range(30)]
    drop = {v for _, s in seqs for i, v in kmers(s, 8) if i % 3 == 0}
    rep = spark.createDataFrame([(v if v < 2**63 else v - 2**64,) for v in drop], "code long")
    got = {}
    for r in sequences.minimizers_filtered(spark.createDataFrame(seqs, "i long, seq string"), 8, 5, ["i"], rep).orderBy("i", "pos").collect():
        got.setdefault(r.i, []).append(r.mx & M)
    for i, s in seqs:
        h = [mix(v) for _, v in kmers(s, 8) if v not in drop]
        m = [min(h[j : j + 5]) for j in range(max(1, len(h) - 4))] if h else []
        assert got.get(i, []) == [x for j, x in enumerate(m) if not j or x != m[j - 1]]


def test_histogram_modes(spark):
    for values, want in (([1000, 500, 200, 100, 150, 300, 500, 400, 200, 100], 7), ([1000, 500, 200, 100, 50], 1)):
        freq = dict(enumerate(values, 1))
        hist = spark.createDataFrame(list(freq.items()), "mult long, freq long")
        assert repeats.mode_of(freq) == want == repeats.histogram_mode(hist) == repeats.mode_frame(hist).first().mode
    assert repeats.mode_of({1: 0}) is None and repeats.threshold(10, 3) == 30
    assert repeats.mode_of_table(["k\tf", "F1\t9", "1\t9", "2\t3", "3\t5", "4\t5", "5\t1"]) == 3


def test_sketches():
    x = np.arange(50, dtype=np.uint64)
    b = repeats.Bloom(1000, 3)
    b.insert(x)
    assert b.contains(x).all() and 0 < b.false_positive_rate() < 0.1
    again = repeats.Bloom.from_bytes(b.to_bytes())
    assert again.contains(x).all() and again.to_bytes() == b.to_bytes()
    c = repeats.CountMin(1 << 12)
    c.insert(np.repeat(x, 50))
    assert (c.query(x) >= 50).all() and (c.merge(c).query(x) >= 100).all()
    c.rows[:] = 65_000
    assert (c.merge(c).query(x) == 65_535).all()


def test_simulated_reads_are_of_the_reference(spark):
    rng = random.Random(3)
    ref = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((3000, 70_000, 1200, 140_000))}
    df = spark.createDataFrame(list(ref.items()), "name string, seq string")
    comp = str.maketrans("ACGT", "TGCA")
    p = simulate.Simulation(barcodes=80, molecules=3.0, molecule_size=4000.0, molecule_spread=1500.0, reads=12, read_length=90, error_rate=0.0, seed=5)
    rows = simulate.simulate_reads(df, p).collect()
    assert len({r.rec_no for r in rows}) == len(rows) == 12 * len({(r.barcode, r.molecule) for r in rows}) and len({r.barcode for r in rows}) == 80
    for r in rows:
        forward = r.seq.translate(comp)[::-1] if r.reverse else r.seq
        assert ref[r.name][r.start : r.start + 90] == forward and r.header == f"read{r.rec_no} BX:Z:{r.barcode}" and len(r.qual) == 90
    share = sum(r.name == "s3" for r in rows) / len(rows)
    assert 0.4 < share < 0.9 and 0.4 < sum(r.reverse for r in rows) / len(rows) < 0.6
    again = simulate.simulate_reads(df.repartition(3), p)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    noisy = {r.rec_no: r.seq for r in simulate.simulate_reads(df, simulate.Simulation(**{**p.__dict__, "error_rate": 0.05})).collect()}
    wrong = sum(x != y for r in rows for x, y in zip(r.seq, noisy[r.rec_no], strict=True)) / (90 * len(rows))
    assert 0.04 < wrong < 0.06
    assert simulate.simulate_reads(df.limit(0), p).count() == 0


def test_stretches_of_files_give_each_record_once(spark, tmp_path):
    rng = random.Random(2)
    quals = ["@" + "I" * 7, "+IIIIIII", "@@@@+@@+", ">IIIIIII"]
    fq = [(f"r{i} x", "".join(rng.choice("ACGT") for _ in range(8)), rng.choice(quals)) for i in range(200)]
    fa = [(f"c{i}", "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    (tmp_path / "a.fq").write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in fq))
    (tmp_path / "b.fa").write_text("".join(f">{h}\n{s[:30]}\n{s[30:]}\n" for h, s in fa))
    for split in (1 << 20, 700, 37):
        got = [tuple(r)[2:] for r in tables.read_fastx(spark, str(tmp_path / "a.fq"), split).orderBy("rec_no").collect()]
        assert got == fq
        got = [(r.header, r.seq) for r in tables.read_fastx(spark, str(tmp_path / "b.fa"), split).orderBy("rec_no").collect()]
        assert got == fa


def test_numbers_and_sums_go_over_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(numbers, "STRETCH", 7)
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9)) for i in rng.sample(range(1000), 150)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    rows.sort()
    assert [tuple(r) for r in numbers.row_numbers(df, [F.desc("k")], "n").orderBy("n").collect()] == [(*x, i) for i, x in enumerate(rows[::-1])]
    assert {r.k: r.s for r in numbers.running_sums(df, ["k"], "v", "s").collect()} == {k: sum(v for _, v in rows[: i + 1]) for i, (k, _) in enumerate(rows)}
    assert numbers.row_numbers(df.limit(0), ["k"], "n").count() == 0


def test_files(spark, tmp_path):
    fq = tmp_path / "a.fq.gz"
    fq.write_bytes(gzip.compress(b"@r1 BX:Z:b1\nACGT\n+\n@III\n@r2#c\nGG\n+\nII\n"))
    fa = tmp_path / "b.fa"
    fa.write_text(">c1 x\nAC\nGT\n>c2\n\n>c1\nTT\n")
    got = sorted((r.header, r.seq, r.qual) for r in tables.read_fastx(spark, [str(fq), str(fa)]).collect())
    assert got == [("c1", "TT", None), ("c1 x", "ACGT", None), ("c2", "", None), ("r1 BX:Z:b1", "ACGT", "@III"), ("r2#c", "GG", "II")]
    lists = sequences.index_ordered(tables.named_sequences(tables.read_fastx(spark, str(fa))), 2, 1)
    assert {r.name for r in lists.collect()} == {"c1"}
    mx = tmp_path / "m.tsv"
    mx.write_text("b1\t1 18446744073709551615:9:x bad\nb1\t2\nb2\n\tx\nb3\t\n")
    inc = tables.read_minimizers(spark, str(mx))
    assert sorted((r.bx, r.mx) for r in inc.collect()) == [("b1", -1), ("b1", 1), ("b1", 2)]
    assert [(r.name, r.qpos, r.mx) for r in tables.read_minimizer_lists(spark, str(mx)).collect()] == [("b1", 0, 2)]
    assert [r.line for r in sinks.minimizer_lines(inc, spark.createDataFrame([("b2",)], "bx string")).orderBy("name").collect()] == ["b1\t1 2 18446744073709551615", "b2"]
    g = tmp_path / "g.tsv"
    g.write_text("U\tm\tmol\na\t5\t1\nb\tx\t\na\t9\t2\nU\tV\tm\nb\ta\t3\na\tc\t2\n")
    v, e = tables.read_graph(spark, str(g))
    assert sorted((r.id, r.m, r.mol) for r in v.collect()) == [("a", 5, 1), ("b", 0, None), ("c", 0, None)]
    assert sorted((r.u, r.v, r.m) for r in e.collect()) == [("a", "b", 3), ("a", "c", 2)]
    sinks.write_graph(v, e, str(tmp_path / "out"))
    v2, e2 = tables.read_graph(spark, str(tmp_path / "out"))
    assert sorted(v2.collect(), key=str) == sorted(v.collect(), key=str) and sorted(e2.collect(), key=str) == sorted(e.collect(), key=str)
    p = tmp_path / "p.txt"
    p.write_text("a b\n\nc\n")
    assert [(r.tid, r.tpos, r.mol) for r in tables.read_paths(spark, str(p)).orderBy("tid", "tpos").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    bed = tmp_path / "x.bed"
    bed.write_text("1\t2\t3\tq\t9\n1\t2\nx\t1\t2\tq\t3\t+\n")
    assert sorted((r.tname, r.score, r.orientation) for r in tables.read_bed(spark, str(bed)).collect()) == [(0, 3, "+"), (1, 9, ".")]
