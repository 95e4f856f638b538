"""The pipeline on planted cases, and stage by stage."""

import random

import corpus_pipeline
from linkmap.llm import queries


def doc(rng, n=120):
    return "\n".join(" ".join(f"word{rng.randint(0, 3000)}" for _ in range(12)) for _ in range(n // 12))


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    docs = [doc(rng) for _ in range(30)]
    common = "a line of more than forty characters that many documents share"
    docs[:6] = [x + "\n" + common for x in docs[:6]]
    passage = doc(rng, 60)
    docs[10], docs[11] = docs[10] + "\n" + passage, docs[11] + "\n" + passage
    docs += [docs[20], docs[21] + " tail", "too short", None, "spam spam spam " * 60]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    names = df.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
        path = str(tmp_path / name)
        df.write.parquet(path)
        df = spark.read.parquet(path)
        kept.append({r.doc_id: r for r in df.collect()})
        if name != "packing":
            assert df.columns == names
    rules, lines, near, suffix, packed = kept
    assert set(rules) == set(range(32))
    assert [common in lines[i].text for i in range(6)] == [False] * 5 + [True]
    assert set(near) == set(range(30)) and all(r.n_chars == len(r.text) for r in near.values())
    assert passage in suffix[10].text and passage not in suffix[11].text
    assert set(packed) == set(suffix) and sum(r.n_tokens for r in packed.values()) == sum(len(r.text.split()) + 1 for r in suffix.values())


def test_columns_of_the_caller_pass_unchanged(spark):
    """Names that operators use for results of their own, odd values, and a very long text."""
    rng = random.Random(1)
    texts = [doc(rng) for _ in range(8)] + [doc(rng, 60_000), doc(rng)]
    clash = {"n_words": 7, "class_id": "mine", "n_lines": -1, "kept": True, "failed_bits": None, "n_dropped": 2.5, "__text": "t", "__id": 4, "others": [1], "N_Bytes": "x"}
    kind = "n_words int, class_id string, n_lines int, kept boolean, failed_bits string, n_dropped double, __text string, __id int, others array<int>, N_Bytes string"
    rows = [(i, t, *clash.values()) for i, t in enumerate(texts)] + [(None, texts[0] + " more", *[None] * len(clash)), (3, texts[3], *clash.values())]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {kind}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.dtypes == df.dtypes, name
        kept = [r for r in out.collect() if r.doc_id is not None]
        # the row without id comes first: it stands for the text that begins like it, where texts are compared
        assert len(kept) == (10 if name == "suffix_dedup" else 11) and all(list(r)[2:] == list(clash.values()) for r in kept), name
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").agg({"n_tokens": "sum"}).first()[0] == sum(len(r[1].split()) + 1 for r in rows)


def test_run_equals_its_stages_and_brute_force(spark, tmp_path):
    """Each stage's rows against a plain computation on small documents."""
    rng = random.Random(4)
    docs = [doc(rng) for _ in range(25)]
    common = "a line of more than forty characters that many documents share"
    docs[:7] = [x + "\n" + common for x in docs[:7]]
    passage = doc(rng, 60)
    docs[10], docs[11] = docs[10] + "\n" + passage, docs[11] + "\n" + passage
    docs += [docs[20], docs[21] + " tail", "too short", None, "", "spam spam spam " * 60]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    texts = {i: t for i, t in enumerate(docs) if t and len(t.split()) >= 50 and not t.startswith("spam")}
    texts = {i: "\n".join(x for x in t.split("\n") if x != common or i == 6) for i, t in texts.items()}
    del texts[25], texts[26]  # a copy and a near copy
    first = (texts[10].encode().find(passage.encode()), texts[11].encode().find(passage.encode()))
    assert first[0] > 0 and first[1] > 0
    texts[11] = texts[11].encode()[: first[1] - 1].decode()  # the line break before it is common as well
    assert got == {i: len(t.split()) + 1 for i, t in texts.items()}


def test_pipeline_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
    assert df.count() == 0


def test_queries_are_registered():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)} and set(queries.oracle_sql()) <= names
