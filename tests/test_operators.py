import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom import models
from corpusloom.operators import bm25, chunking, evaluate, hybrid, ingest, qa, sections, vector
from corpusloom.runtime import Scratch


def test_keep_first_and_resume(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "id string, n int, v string")
    assert {(r["id"], r["v"]) for r in ingest.keep_first(df, "id", [F.col("n")]).collect()} == {("a", "x"), ("b", "y")}
    have = spark.createDataFrame([("b", 0, "old")], "id string, n int, v string")
    assert {(r["id"], r["v"]) for r in ingest.resume_union(have, df, "id", [F.col("n")]).collect()} == {("b", "old"), ("a", "x")}


def test_batch_numbers(spark):
    df = spark.range(100).withColumn("o", (F.col("id") * 37) % 100)
    got = {r["o"]: r["batch_no"] for r in ingest.batch_numbers(df, ["o"], Scratch(spark, "t"), 32, rows_per_range=15).collect()}
    assert got == {i: i // 32 for i in range(100)}
    assert ingest.batch_numbers(df.limit(0), ["o"], Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("n, per_range", [(100_000, 1500), (2_000_000, 30_000), (2_000_000, 1_000_000)])
def test_row_numbers_have_no_gap_and_no_repeat(spark, n, per_range):
    """Beyond what the sampling of range bounds can hold, where bounds differ from job to job."""
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("id"))
    with Scratch(spark, "t") as scratch:
        got = ingest.row_numbers(df, ["id"], scratch, rows_per_range=per_range)
        row = got.agg(F.countDistinct("row_no").alias("d"), F.max("row_no").alias("hi"), F.count_if(F.col("row_no") != F.col("id")).alias("off")).first()
    assert (row["d"], row["hi"], row["off"]) == (n, n - 1, 0)


def test_first_rows(spark, tmp_path, monkeypatch):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("b", None, "n"), ("b", None, "n"), (None, 3, "p"), (None, 2, "q"), ("c", 1, None), ("d", 1, "t"), ("d", 1, "t")]
    spark.createDataFrame(rows, "k string, o int, `_at` string").repartition(3).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    want = [("None", "q"), ("a", "y"), ("b", "n"), ("c", "None"), ("d", "t")]
    for sent in (ingest.SENT_KEYS, 0):
        monkeypatch.setattr(ingest, "SENT_KEYS", sent)
        found = ingest.first_rows(stored.withColumnRenamed("_at", "v"), "k", [F.col("o")], ["k", "v"], Scratch(spark, "t"))
        assert sorted((str(r["k"]), str(r["v"])) for r in found.collect()) == want
    assert ingest.first_rows(stored.where("false"), "k", [F.col("o")], ["k"], Scratch(spark, "t")).count() == 0


def test_distinct_rows(spark, monkeypatch):
    rows = [("a", "x"), ("a", "x"), ("b", None), ("b", None), (None, None), ("c", "y")]
    df = spark.createDataFrame(rows, "k string, `t.t` string")
    for sent in (ingest.SENT_KEYS, 0):
        monkeypatch.setattr(ingest, "SENT_KEYS", sent)
        assert sorted(map(str, ingest.distinct_rows(df, Scratch(spark, "t")).collect())) == sorted(map(str, df.distinct().collect()))
    assert ingest.distinct_rows(df.limit(0), Scratch(spark, "t")).count() == 0


def test_download_keeps_going(spark, tmp_path):
    def fetch(url, path):
        if "bad" in url:
            raise OSError("no")
        with open(path, "wb") as f:
            f.write(url.encode())

    papers = spark.createDataFrame([("a/1", "u1"), ("b", "bad"), ("c", "u3"), ("c", "u3")], "arxiv_id string, pdf_url string")
    files = spark.createDataFrame([("/old/c.pdf", "c.pdf")], "path string, file_name string")
    got = {r["arxiv_id"]: r["local_pdf_path"] for r in ingest.download(papers, files, str(tmp_path), fetch, wait=0).collect()}
    assert got == {"a/1": f"{tmp_path}/a_1.pdf", "b": None, "c": "/old/c.pdf"}
    assert (tmp_path / "a_1.pdf").read_bytes() == b"u1"


def windows(spark, n):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "t string")
    return [(x["start"], x["n_words"]) for x in chunking.windows(df, [], "t").orderBy("idx").collect()]


def test_windows(spark):
    assert windows(spark, 450) == [(0, 450)]
    assert windows(spark, 451) == [(0, 450), (386, 65)]
    assert windows(spark, 836) == [(0, 450), (386, 450), (772, 64)]
    assert windows(spark, 775) == [(0, 450), (386, 389)]
    assert windows(spark, 0) == [(0, 0)]


def test_token_windows(spark):
    class Pairs:
        """Two characters a token."""

        def encode(self, text):
            return [text[i : i + 2] for i in range(0, len(text), 2)]

        def decode(self, ids):
            return "".join(ids)

    df = spark.createDataFrame([(1, "a " * 30), (2, "b " * 9), (3, None), (4, "")], "k int, t string")
    got = [tuple(r) for r in chunking.token_windows(df, ["k"], "t", Pairs(), 20, 5).orderBy("k", "idx").collect()]
    assert [g[:4] + g[5:] for g in got if g[0] == 1] == [(1, 0, 2, 0, 20), (1, 1, 2, 15, 15)]
    assert got[0][4] == ("a " * 20).strip() and [g[:4] for g in got[2:]] == [(2, 0, 1, 0), (4, 0, 1, 0)]
    parsed = spark.createDataFrame([("p", None, "A sentence of plain words stands here. " * 40)], "arxiv_id string, sections map<string,string>, full_text string")
    assert chunking.chunk_papers(parsed, tokenizer=Pairs()).count() >= 1


def test_chunk_id(spark):
    got = spark.range(1).select(chunking.chunk_id(F.lit("p1"), F.lit("method"), F.lit(3)).alias("x")).first()["x"]
    assert got == hashlib.md5(b"p1:method:3").hexdigest()[:12]


def split(spark, text):
    df = spark.createDataFrame([("p", text)], "arxiv_id string, full_text string")
    return [(r["section"], r["body"]) for r in sections.split_sections(df).orderBy("pos").collect()]


def test_sections(spark):
    long = "x" * 60
    assert split(spark, "no heading") == [("full_text", "no heading")]
    text = f"preamble\n## 1 Introduction\n{long}\n**2** **Methods**\n{long}\n# References\n{long}"
    assert [s for s, _ in split(spark, text)] == ["introduction", "method", "references"]
    assert split(spark, text)[0][1] == f"## 1 Introduction\n{long}"
    only = f"# References\n{long}"
    assert split(spark, only) == [("full_text", only)]
    short = "# Abstract\n" + "y" * 39  # 50 characters with the heading
    assert [s for s, _ in split(spark, short + "\n# Conclusion\n" + long)] == ["conclusion"]
    assert [s for s, _ in split(spark, short + "y\n# Conclusion\n" + long)] == ["abstract", "conclusion"]
    # the bold form wins over an earlier hash form of the same section
    both = f"# Results\n{long}\n**3** **Experiments**\n{long}"
    assert split(spark, both) == [("experiments", f"**3** **Experiments**\n{long}")]


def test_fusion_and_dedup(spark):
    ranks = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "query_id int, doc string, rank int")
    fused = hybrid.fuse_ranks([ranks([("a", 1), ("b", 2)]), ranks([("b", 1), ("c", 2)])])
    got = {r["doc"]: (round(r["rrf"], 6), r["rank"]) for r in fused.collect()}
    assert got == {"b": (round(1 / 62 + 1 / 61, 6), 1), "a": (round(1 / 61, 6), 2), "c": (round(1 / 62, 6), 3)}
    corpus = spark.createDataFrame([("d1", "p1", "s1"), ("d2", "p1", "s1"), ("d3", "p1", "s2"), ("d4", "p2", "s1")], "doc string, arxiv_id string, section string")
    ranked = spark.createDataFrame([(1, "d1", 0.9, 1), (1, "d2", 0.8, 2), (1, "d3", 0.7, 3), (1, "d4", 0.6, 4)], "query_id int, doc string, score double, rank int")
    best = hybrid.best_per_group(ranked, corpus, ["arxiv_id", "section"], 2)
    assert [(r["doc"], r["rank"]) for r in best.orderBy("rank").collect()] == [("d1", 1), ("d3", 2)]


def test_vector_search_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[7] = 0
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(99, None)], "vec_id int, embedding array<float>")
    queries = df.where("vec_id in (0, 30)").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vector.top_k(queries, df.repartition(5), 5).collect()}
    for q in (0, 30):
        live = [i for i in range(60) if i != 7]
        f = np.float32(x).astype(float)
        d = {i: round(1 - f[q] @ f[i] / np.linalg.norm(f[q]) / np.linalg.norm(f[i]), 6) for i in live}
        want = sorted(live, key=lambda i: (d[i], i))[:5]
        assert [got[q, r] for r in range(1, 6)] == want


def allocation(spark, n):
    df = spark.createDataFrame([(f"c{i}", f"p{i % 7}", 100, "t", "s", "x") for i in range(n)], "chunk_id string, arxiv_id string, word_count int, title string, section string, text string")
    return qa.allocate(df, Scratch(spark, "t"))


def test_allocation_and_pairs(spark):
    placed = allocation(spark, 100)
    assert {r["kind"]: r["count"] for r in placed.groupBy("kind").count().collect()} == {"grounded": 60, "refusal": 20, "synthesis": 20}
    papers = {r["chunk_id"]: r["arxiv_id"] for r in placed.collect()}
    pairs = qa.pairs(placed).collect()
    assert pairs and all(papers[r["first"]] != papers[r["second"]] for r in pairs)
    used = [c for r in pairs for c in (r["first"], r["second"])]
    assert len(used) == len(set(used))


def test_generated_json(spark):
    rows = [(1, 'x{"question":"12345678901","answer":"123456789012345678901"}y'), (2, '{"question":"1234567890","answer":"123456789012345678901"}'), (3, "none"), (4, None)]
    got = qa.parse_generated(spark.createDataFrame(rows, "id int, raw string"), "raw")
    assert {r["id"]: r["question"] for r in got.collect()} == {1: "12345678901", 2: None, 3: None, 4: None}


def test_samples(spark):
    class Picky:
        """Answers in its thinking only, and fails for one kind."""

        def __call__(self, prompt, system, temperature, json=False):
            assert json
            if "compares" in prompt:
                raise TimeoutError
            return "", models.dumps({"question": "What is said here?", "answer": f"It has {len(prompt)} characters in all."})

    rows = [(f"c{i}", f"p{i % 7}", 100, "About RAG", "s", f"text {i}") for i in range(100)]
    chunks = spark.createDataFrame(rows, "chunk_id string, arxiv_id string, word_count int, title string, section string, text string")
    asked = qa.requests(qa.allocate(chunks, Scratch(spark, "t")), chunks).cache()
    kinds = {r["type"]: r["count"] for r in asked.groupBy("type").count().collect()}
    assert kinds["grounded"] == 60 and kinds["refusal"] == 20 and 0 < kinds["synthesis"] <= 20
    made = qa.samples(asked, Picky(), "be brief", retries=0)
    assert made.columns == ["sample", "type", "instruction", "input", "output", "source_arxiv_id", "order_key"]
    row = made.where("type = 'refusal'").first()
    assert row["input"].startswith("Context from 'About RAG' (s):\ntext ") and row["input"].endswith("\n\nQuestion: What is said here?")
    assert "Topic: retrieval-augmented generation" in asked.where("type = 'refusal'").first()["prompt"]
    assert qa.sample_stats(made).first().asDict() == {"total": 80, "type1_grounded": 60, "type2_synthesis": 0, "type3_refusal": 20}
    whole = qa.samples(asked, models.EchoGenerator(), "be brief")
    pair = whole.where("type = 'synthesis'").first()
    assert pair["input"].count("Context from") == 2 and pair["source_arxiv_id"].count(",") == 1
    assert whole.select("order_key").distinct().count() == sum(kinds.values())


def test_group_by_paper_keeps_every_chunk(spark):
    rows = [("p", f"c{i}", 9 - i, f"t{i}") for i in range(10)] + [(None, "x", 1, "n"), ("q", "y", None, None)]
    df = spark.createDataFrame(rows, "arxiv_id string, chunk_id string, chunk_ord long, title string")
    got = qa.group_by_paper(df, Scratch(spark, "t")).orderBy("arxiv_id", "pos").collect()
    own = [r for r in got if r["arxiv_id"] == "p"]
    assert [r["chunk_id"] for r in own] == [f"c{9 - i}" for i in range(10)] and {(r["title"], r["n_chunks"]) for r in own} == {("t9", 10)}
    assert {(r["arxiv_id"], r["pos"], r["n_chunks"]) for r in got if r["arxiv_id"] != "p"} == {(None, 0, 1), ("q", 0, 1)}


def test_split_sizes(spark):
    df = spark.range(1997).withColumnRenamed("id", "k")
    got = {r["split"]: r["count"] for r in qa.train_eval_split(df, "k").groupBy("split").count().collect()}
    assert got == {"train": 1897, "eval": 100}


def test_metrics(spark):
    rows = [(1, ["a", "b"], ["b"]), (2, ["x", "x"], ["x"]), (3, [], ["q"])]
    df = spark.createDataFrame(rows, "item_id int, source_ids array<string>, expected_ids array<string>")
    m = evaluate.retrieval_metrics(evaluate.list_scores(df)).first()
    assert (m["hit_rate"], m["mrr"], m["avg_precision"]) == (round(2 / 3, 6), 0.5, 0.5)
    answers = [(1, "word " * 20, ["WORD"]), (2, "word " * 21, ["none"]), (3, "I don't " + "word " * 25, []), (4, None, ["x"])]
    got = {r["item_id"]: (r["substantive"], r["coverage"]) for r in evaluate.answer_details(spark.createDataFrame(answers, "item_id int, answer string, keywords array<string>")).collect()}
    assert got == {1: (False, 1.0), 2: (True, 0.0), 3: (False, None), 4: (False, 0.0)}


def test_vector_search_shuffles_the_best_of_each_task(spark):
    """A task gives its best once, however many batches it reads."""
    n, k = 20_000, 3
    df = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(1.0)).alias("embedding")).coalesce(2)
    queries = df.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    rows = [(r["query_id"], list(r["embedding"])) for r in queries.collect()]
    found = vector._block(rows, df, k, "vec_id", queries.schema["query_id"].dataType, "bigint")
    assert found.count() <= 4 * 5 * k
    assert {r["query_id"]: r["vec_id"] for r in vector.top_k(queries, df, 1).collect()} == {i: i for i in range(5)}
    assert vector.top_k(queries.limit(0), df, 2).count() == 0 and vector.top_k(queries, df.limit(0), 2).count() == 0


def test_stored_index(spark, tmp_path):
    texts = ["graph search over graph links", "token counts", "", None, "the the the graph", "?!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    made = bm25.build_index(df, "doc", "text", str(tmp_path / "i"))
    opened = bm25.open_index(spark, str(tmp_path / "i"))
    assert opened.n_docs == made.n_docs == 5 and opened.avgdl == pytest.approx((5 + 2 + 0 + 4 + 0) / 5)
    tf = {(r["term"], r["doc"]): r["tf"] for r in opened.postings.where("term is not null").collect()}
    assert tf[("graph", 0)] == 2 and tf[("the", 4)] == 3 and len(tf) == 4 + 2 + 2
    asked = spark.createDataFrame([(1, "graph links"), (2, "nothing here"), (3, None)], "query_id int, question string")
    assert [(r["query_id"], r["doc"], r["rank"]) for r in bm25.search(opened, asked, 5).orderBy("rank").collect()] == [(1, 0, 1), (1, 4, 2)]
    assert bm25.search(bm25.build_index(df.limit(0), "doc", "text", str(tmp_path / "e")), asked, 5).count() == 0
    plan = bm25.search(opened, asked, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]


def test_report_equals_stored_values(spark):
    """Relevance of the five results, words of the answer, keywords found and asked for, and seconds of 15 items."""
    items = [
        ("10011", 205, 5, 6, 19.28), ("00011", 155, 2, 5, 20.64), ("01000", 127, 5, 5, 17.47), ("11001", 237, 5, 5, 20.57), ("11100", 248, 2, 5, 22.36),
        ("01000", 98, 4, 5, 17.66), ("01000", 173, 2, 5, 17.02), ("01000", 222, 5, 5, 27.39), ("11110", 179, 4, 5, 24.18), ("10100", 183, 6, 6, 24.62),
        ("11011", 162, 5, 5, 17.0), ("10100", 102, 3, 5, 21.03), ("11010", 141, 5, 5, 15.59), ("10000", 159, 6, 6, 15.97), ("10100", 145, 4, 5, 23.45),
    ]
    rows = [
        (n, f"q{n}", "t", "an answer", w, found / total, found, total, True, [f"e{k}" if r == "1" else f"o{k}" for k, r in enumerate(rel)], [f"e{k}" for k in range(5)], True, s)
        for n, (rel, w, found, total, s) in enumerate(items)
    ]
    df = spark.createDataFrame(
        rows, "item_id int, question string, topic string, answer string, answer_word_count int, keyword_coverage double, keywords_found int, keywords_total int, "
        "source_hit boolean, source_ids array<string>, expected_ids array<string>, is_substantive boolean, latency_seconds double",
    )
    r = evaluate.report(df, "baseline", "now").first()
    assert (r["label"], r["config"]["dataset_size"], r["config"]["top_k"]) == ("baseline", 15, 5)
    got = r["retrieval"].asDict() | r["answer"]["summary"].asDict()
    want = {"hit_rate": 1.0, "mrr": 0.816667, "avg_precision": 0.44, "avg_keyword_coverage": 0.802222, "source_hit_rate": 1.0, "substantive_rate": 1.0, "avg_word_count": 169.066667}
    assert {k: got[k] for k in want} == want and got["total_time"] == 304.23
    assert len(r["answer"]["details"]) == 15 and r["answer"]["details"][0]["item_id"] == 0
    empty = evaluate.report(df.limit(0), "none", "now").first()
    assert empty["config"]["dataset_size"] == 0 and empty["retrieval"]["mrr"] is None


def test_progress(spark):
    rate, left = evaluate.progress(F.lit(20), F.lit(50), F.lit(30.0))
    none, _ = evaluate.progress(F.lit(0), F.lit(50), F.lit(0.0))
    assert tuple(spark.range(1).select(rate, left, none).first()) == (40.0, 0.75, None)
