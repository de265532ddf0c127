import json

import pytest
from pyspark.sql import functions as F

from corpusloom import api, jobs, models
from corpusloom.config import Settings
from corpusloom.runtime import Scratch, shared_dir
from corpusloom.sources import envelopes
from corpusloom.sources.search_api import PaperSearchSource
from corpusloom.streaming import ingest


def test_envelopes_round_trip(spark, tmp_path):
    path = str(tmp_path / "papers.json")
    assert envelopes.read_envelope(spark, path, "papers").count() == 0
    rows = [{"arxiv_id": "a1", "title": "Ü", "authors": ["x", "y"]}, {"arxiv_id": "a2", "title": None}]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"collected_at": "now", "papers": rows}, f, ensure_ascii=False, indent=2)
    got = envelopes.read_envelope(spark, path, "papers").orderBy("pos").collect()
    assert [(r["arxiv_id"], r["title"], r["pos"]) for r in got] == [("a1", "Ü", 0), ("a2", None, 1)]
    out = str(tmp_path / "store")
    jobs.papers(spark, path, out)
    assert spark.read.parquet(out).count() == 2 and not envelopes.path_exists(spark, out + "_next")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"papers": [{"arxiv_id": "a2", "title": "new"}, {"arxiv_id": "a3", "title": "third"}]}, f)
    jobs.papers(spark, path, out)
    jobs.papers(spark, path, out)
    assert {r["arxiv_id"]: r["title"] for r in spark.read.parquet(out).collect()} == {"a1": "Ü", "a2": None, "a3": "third"}
    envelopes.write_rows(spark.range(3), out, {"n": 3})
    envelopes.write_rows(spark.range(2), out)
    assert spark.read.parquet(out).count() == 2 and spark.read.json(out + "_facts").first()["value"] == "3"
    envelopes.drop_table(spark, out)
    envelopes.drop_table(spark, out)
    assert not envelopes.path_exists(spark, out)


def test_chunk_index_and_evaluation_jobs(spark, tmp_path):
    text = "**1** **Introduction**\n" + "A sentence of plain words about graphs stands here. " * 40
    df = spark.createDataFrame([("p1", {"introduction": text}, text), ("p2", None, None)], "arxiv_id string, sections map<string,string>, full_text string")
    at = {x: str(tmp_path / x) for x in ("parsed", "chunks", "index", "items", "report", "qa")}
    df.write.parquet(at["parsed"])
    jobs.chunk(spark, at["parsed"], at["chunks"])
    assert spark.read.parquet(at["chunks"]).count() == 1
    assert jobs.index(spark, at["chunks"], at["index"]) == {"ok": 1}
    assert spark.read.parquet(at["index"] + "/vectors").columns == ["doc", "embedding"]

    class Down:
        def __call__(self, texts):
            raise OSError("down")

    class Halts:
        def __call__(self, texts):
            raise SystemExit

    assert jobs.index(spark, at["chunks"], at["index"], Down()) == {"failed": 1} and spark.read.parquet(at["index"] + "/vectors").count() == 0
    jobs.index(spark, at["chunks"], at["index"])
    with pytest.raises(Exception):
        jobs.index(spark, at["chunks"], at["index"], Halts())
    assert spark.read.parquet(at["index"] + "/vectors").count() == 1  # a run that dies leaves the stored index
    items = [(1, "plain words about graphs", "t", ["p1"], ["characters", "none"]), (2, "plain sentence", None, ["p9"], None)]
    spark.createDataFrame(items, "item_id int, question string, topic string, expected_arxiv_ids array<string>, expected_keywords array<string>").write.parquet(at["items"])
    jobs.evaluation(spark, at["index"], at["report"], at["items"])
    made = json.loads(spark.read.text(at["report"]).first()["value"])
    assert made["label"] == "baseline" and made["retrieval"]["hit_rate"] == 0.5 and made["answer"]["summary"]["avg_keyword_coverage"] == 0.25
    assert [d["source_ids"] for d in made["answer"]["details"]] == [["p1"], ["p1"]] and made["answer"]["details"][1]["topic"] is None
    engine = api.Engine.open(spark, at["index"], models.HashEmbedder(), models.EchoGenerator())
    assert engine.query("graphs in words")["sources"][0]["arxiv_id"] == "p1"

    big = spark.range(40).selectExpr("concat('c', id) chunk_id", "concat('p', id % 3) arxiv_id", "100 word_count", "'T' title", "'s' section", "concat('text ', id) text")
    big.write.mode("overwrite").parquet(at["chunks"])
    jobs.qa_samples(spark, at["chunks"], at["qa"])
    made = spark.read.parquet(at["qa"])
    assert made.columns == ["type", "instruction", "input", "output", "source_arxiv_id"] and made.count() >= 32
    facts = {r["fact"]: r["value"] for r in spark.read.json(at["qa"] + "_facts").collect()}
    assert facts["type1_grounded"] == "24" and facts["failed"] == "0" and int(facts["total"]) == made.count()


def test_parse_job(spark, tmp_path):
    (tmp_path / "f").mkdir()
    body = "## 1 Introduction\n" + "words of it " * 10 + "\n\n\n\n# Conclusion\n" + "more  words " * 10
    for name, content in (("a.pdf", body), ("b.pdf", "no heading at all"), ("c.pdf", ""), ("d.pdf", "broken"), ("unused.pdf", body)):
        (tmp_path / "f" / name).write_text(content)

    def render(content):
        if content == b"broken":
            raise ValueError
        return content.decode()

    facts = "arxiv_id string, title string, abstract string, authors array<string>, published string, categories array<string>, local_pdf_path string"
    papers = [(x, f"T{x}", None, ["n"], "2024", ["c"], f"{tmp_path}/f/{x}.pdf") for x in "abcd"] + [("e", "Te", None, [], "", [], None), ("g", "Tg", None, [], "", [], f"{tmp_path}/f/g.pdf")]
    spark.createDataFrame(papers, facts).write.parquet(str(tmp_path / "papers"))
    out = str(tmp_path / "parsed")
    jobs.parse(spark, str(tmp_path / "papers"), out, render)
    got = {r["arxiv_id"]: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {"a", "b"} and set(got["a"]["sections"]) == {"introduction", "conclusion"} and got["b"]["sections"] == {"full_text": "no heading at all"}
    assert got["a"]["char_count"] == len(got["a"]["full_text"]) and got["a"]["word_count"] == len(got["a"]["full_text"].split()) and "  " not in got["a"]["full_text"]
    facts = {r["fact"]: r["value"] for r in spark.read.json(out + "_facts").collect()}
    assert (facts["total_parsed"], facts["sectioned"], facts["full_text_only"]) == ("2", "1", "1")


def test_search_source(spark):
    spark.dataSource.register(PaperSearchSource)
    read = spark.read.format("paper_search").option("queries", json.dumps(["rag", "fails"])).option("client", "tests.search_client:search")
    rows = read.option("retries", 0).load().orderBy("arxiv_id").collect()
    assert [(r["arxiv_id"], r["query_source"]) for r in rows] == [("rag0v1", "rag"), ("rag1v1", "rag")]


def test_streaming_ingest_adds_each_paper_once(spark, tmp_path):
    landing, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    text = "A sentence of plain words stands here. " * 40

    def land(name, ids):
        (tmp_path / "in").mkdir(exist_ok=True)
        with open(f"{landing}/{name}.json", "w") as f:
            for i in ids:
                f.write(json.dumps({"arxiv_id": i, "full_text": text}) + "\n")

    land("one", ["p1", "p2", "p1"])
    ingest.start(spark, landing, out, check).awaitTermination()
    land("two", ["p2", "p3"])
    ingest.start(spark, landing, out, check).awaitTermination()
    assert sorted(r["arxiv_id"] for r in spark.read.parquet(out).collect()) == ["p1", "p2", "p3"]


def test_engine(spark):
    texts = ["retrieval of passages with ranks", "graphs of papers and links", "tokens and vocabularies"]
    embedder = models.HashEmbedder(16)
    corpus = spark.createDataFrame([(i, t, f"p{i}", "s", f"T{i}") for i, t in enumerate(texts)], "doc long, text string, arxiv_id string, section string, title string")
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(embedder(texts))], "doc long, embedding array<float>")
    engine = api.Engine(spark, corpus, vectors, embedder, models.EchoGenerator())
    got = engine.query("graphs of papers and links", 2)
    assert got["sources"][0]["arxiv_id"] == "p1" and got["answer"].startswith("A prompt of") and len(got["sources"]) == 2
    assert engine.health()["status"] == "healthy" and engine.health()["documents"] == 3

    class Slow:
        def __call__(self, prompt, system, temperature):
            raise TimeoutError

    class Gone(Slow):
        def ready(self):
            return False

        def __call__(self, prompt, system, temperature):
            raise OSError

    for generator, error in ((Slow(), api.ModelTimeout), (Gone(), api.ModelUnavailable)):
        other = api.Engine(spark, corpus, vectors, embedder, generator, index=engine.index)
        other.answers = lambda found, g=generator: models.generate(api.rag.prompts(found.results, corpus, found.queries), "query_id", "prompt", g, retries=0, traced=True)
        assert other.health()["status"] == "degraded" and not other.health()["generator"]
        with pytest.raises(error):
            other.query("graphs of papers")
    found = [engine.search([q]) for q in ("graphs of papers", "tokens and more")]  # two callers of one engine
    assert [f.queries.first()["question"] for f in found] == ["graphs of papers", "tokens and more"]
    with pytest.raises(api.InvalidRequest):
        engine.query("ab")
    with pytest.raises(api.InvalidRequest):
        engine.query("long enough", 21)


def test_embedding_falls_back_and_generation_retries(spark):
    class Flaky:
        def __call__(self, texts):
            if len(texts) > 1 or texts[0] == "bad":
                raise OSError("down")
            return [[1.0, 2.0]]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id int, text string").coalesce(1)
    got = {r["id"]: r["status"] for r in models.embed(df, "id", "text", Flaky()).collect()}
    assert got == {1: "ok", 2: "failed", 3: "failed"}

    def broken(prompt, system, temperature):
        raise OSError("down")

    assert [r["raw"] for r in models.generate(df, "id", "text", broken, retries=1, wait=0).collect()] == [None] * 3


def test_settings_and_scratch(spark, monkeypatch):
    monkeypatch.setenv("CORPUSLOOM_TOP_K", "7")
    assert Settings.from_env().top_k == 7 and Settings.from_env().rrf_k == 60
    scratch = Scratch(spark, "x")
    table = scratch.table(spark.range(5).withColumn("v", F.lit("a")))
    assert table.count() == 5 and scratch.root.startswith(shared_dir(spark))
    scratch.drop(table)

    with Scratch(spark, "x") as closed:
        root = closed.root
        closed.table(spark.range(1))
    assert not envelopes.path_exists(spark, root)


def test_answer_or_thinking():
    assert models.answer_of(("", " thought ")) == "thought" and models.answer_of(("said", "thought")) == "said" and models.answer_of("plain") == "plain"


def test_entry_passes_on_what_breaks(tmp_path):
    """A subpackage that is left out is fine, one that can't be imported is an error."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert int(run().stdout) > 50
    (tmp_path / "corpusloom" / "llm").mkdir()
    (tmp_path / "corpusloom" / "llm" / "__init__.py").write_text("")
    (tmp_path / "corpusloom" / "llm" / "queries.py").write_text("import missing_module")
    assert run().returncode
