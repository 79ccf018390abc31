"""Evaluation runs, diagnostics, the console and storage from end to end, with stubs for the models."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.plans import diagnostics as D
from lodestone.plans import evaluation as E
from lodestone.sources import corpus
from lodestone.sources.cache import AnswerCache
from lodestone.sources.config import Settings
from lodestone.sources.index import Index, ensure_index
from lodestone.sources.storage import Place

SMALL = Settings(chunk_size=400, chunk_overlap=80, min_chunk_len=30, max_distance=2.0, raw_top_k=4, final_top_k=2)


class Chat:
    def complete(self, system, prompt):
        return "an answer"


class Scorer:
    def score(self, question, answer, contexts, ground_truth):
        return {"faithfulness": len(contexts) / 2, "context_precision": float("nan")}


@pytest.fixture
def index(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Rules\n\n" + "\n\n".join(f"Clause {i} says something of weight. " * 3 for i in range(8)))
    (tmp_path / "m.json").write_text(json.dumps({"entries": [{"path": "a.txt", "source": "a", "source_display": "A"}]}))
    found = Index(spark, tmp_path / "index")
    ensure_index(found, corpus.read_sources(spark, tmp_path / "m.json"), SMALL)
    return found


def test_evaluation_run(spark, index, tmp_path, monkeypatch):
    monkeypatch.delenv("RAGAS_DO_NOT_TRACK", raising=False)
    (tmp_path / "eval.json").write_text(json.dumps({"name": "two", "cases": [{"question": "What?", "ground_truth": "that"}, {"question": "Why?", "ground_truth": "so"}]}))
    found = E.run(spark, tmp_path / "eval.json", index, Scorer(), SMALL, chat=Chat())
    means = {r.metric: (r["mean"], r.n_valid) for r in found["means"].collect()}
    assert means == {"faithfulness": (1.0, 2), "context_precision": (None, 0), "context_utilization": (None, 0)}
    assert (found["name"], found["overall"], found["verdict"], found["metrics"].count()) == ("two", 1.0, "good", 6)
    cases = E.questions(spark, tmp_path / "eval.json")[1]
    rows = E.answered(cases, index, SMALL, chat=Chat()).orderBy("query_id").collect()
    assert [(r.question, r.answer, r.ground_truth, len(r.contexts)) for r in rows] == [("What?", "an answer", "that", 2), ("Why?", "an answer", "so", 2)]


def test_diagnostics(spark, index):
    asked = spark.createDataFrame([(1, "What of the clause?"), (2, "Какой налог?")], "query_id long, query string").withColumn("embedding", T.sha_embedding(F.col("query")))
    found = D.hits(asked, index.chunks(), 3)
    report = D.retrieval_report(found).collect()
    assert len(report) == 6 and all(len(r.preview) <= 303 and "\n" not in r.preview and r.source_display == "A" for r in report)
    labelled, ranges = D.threshold_report(found)
    assert {r.label for r in labelled.collect()} == {"irrelevant"} and {r.label: r.n for r in ranges.collect()} == {"relevant": 0, "doubtful": 0, "irrelevant": 6}
    made = {r.query_id: r for r in D.simulation(asked, found, 2.0, 2).collect()}
    assert (made[1].raw, made[1].final, made[1].sufficient) == (3, 2, True) and all(s.startswith("A | ") for s in made[1].sources)
    none = {r.query_id: r for r in D.simulation(asked, found, -1.0, 2).collect()}
    assert (none[1].final, none[1].sources, none[1].sufficient) == (0, [], False)
    strict = {r.query_id: r.sufficient for r in D.simulation(asked, found, 2.0, 2, {"налог": ["ндс"]}).collect()}
    assert strict == {1: True, 2: False}


def test_console(spark, tmp_path, monkeypatch, capsys):
    for name in ("OPENAI_API_KEY", "LLM_API_KEY", "RAG_CORPUS_CONFIG", "RAG_CHROMA_PATH", "RAG_COLLECTION_NAME"):
        monkeypatch.delenv(name, raising=False)
    assert cli.main(tmp_path, spark, []) == 1
    (tmp_path / "a.txt").write_text("Rules. " * 100)
    (tmp_path / "m.json").write_text(json.dumps({"entries": [{"path": "a.txt", "source": "a", "source_display": "A"}]}))
    for name, value in {"LLM_API_KEY": "k", "RAG_CORPUS_CONFIG": "m.json", "RAG_MAX_DISTANCE": "2", "RAG_CLI_CONTEXT_MAX_ITEMS": "1", "RAG_CLI_CONTEXT_PREVIEW_CHARS": "10"}.items():
        monkeypatch.setenv(name, value)
    assert cli.main(tmp_path, spark, ["What?", "what", "", "stats", "clear", "yes", "quit", "never"], Chat()) == 0
    said = capsys.readouterr().out
    assert "(by offline)" in said and "(from the cache of" in said and said.count("an answer") == 2 and "'entries': 1" in said and "cleared" in said and "never" not in said


def test_console_goes_on_after_a_failure():
    said = []

    def ask(question):
        raise RuntimeError("no network")

    cli.converse(["a", "EXIT"], ask, dict, lambda: None, said.append)
    assert said == ["error: no network"]
    shown = cli.shown_context([{"text": "t" * 30, "metadata": {"source_display": "S", "section_heading": "h" * 130}}, {"text": "u", "metadata": None}], 0, 20)
    assert shown == ["1. [S] " + "h" * 120 + "…", "   " + "t" * 20 + "…", "2.", "   u"]


def test_summary_and_numbers(spark):
    texts = [(i, "Word and word. " * (40 * i) or None) for i in range(5)] + [(9, "x" * 3000)]
    docs = spark.createDataFrame([(i, "s", "S", "k", "o", f"{i}.txt", t) for i, t in texts], "entry_ord long, source string, source_display string, source_kind string, doc_type string, file_name string, text string").repartition(3)
    chunks = C.chunk_documents(docs, chunk_size=120, overlap=20, min_len=10)
    rows = C.with_ids(chunks).orderBy("id_num").collect()
    assert [r.id_num for r in rows] == list(range(len(rows))) and [(r.entry_ord, r.chunk_ord) for r in rows] == sorted((r.entry_ord, r.chunk_ord) for r in rows)
    found = C.summary(chunks).first()
    assert found.after_total == len(rows) and found.after_max_len <= 120 and found.before_total == sum((r.hard_split_index or 0) == 0 for r in rows)
    assert found.before_max_len == max(r.unlimited_len for r in rows)
    assert tuple(C.summary(chunks.where("1 = 0")).first()) == (0, 0, 0, 0) and C.with_ids(chunks.where("1 = 0")).count() == 0


def test_places(spark, tmp_path):
    """Files and folders through Spark's file systems, also one that Python's own functions cannot see."""
    place = Place(spark, f"file://{tmp_path}/deep/er")
    (place / "a.json").write_text("one")
    (place / "a.json").write_text("zwei é")
    assert (place / "a.json").read_text() == "zwei é" and [x.name for x in place.children()] == ["a.json"] and place.size() > 0
    place.remove()
    assert not place.exists() and place.children() == [] and place.size() == 0
    folder = f"file://{tmp_path}/cache"
    spark.range(1).write.parquet(f"{folder}/v0")
    cache = AnswerCache(spark, folder, "f")
    assert not Place(spark, f"{folder}/v0").exists()
    cache.store(spark.createDataFrame([("A?", "x", [])], "query string, answer string, context array<struct<text string, metadata map<string,string>, id string>>"))
    assert cache.stats()["entries"] == 1 and cache.lookup(spark.createDataFrame([(1, " a ")], "query_id long, query string")).first().cached_answer == "x"
