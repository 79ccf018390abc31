"""The state machine of the index, the cache and answers from end to end, with stubs for the models."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluation as V
from lodestone.operators import retrieval as R
from lodestone.plans import answering as A
from lodestone.sources import corpus
from lodestone.sources.cache import AnswerCache
from lodestone.sources.config import Settings
from lodestone.sources.index import Index, IndexBuildError, ensure_index

SMALL = Settings(chunk_size=400, chunk_overlap=80, min_chunk_len=30, max_distance=2.0, raw_top_k=4, final_top_k=2)


@pytest.fixture
def manifest(tmp_path):
    for name in ("alpha", "beta"):
        text = f"{name.title()} rules\r\n\r\n" + "\n\n".join(f"{name.title()} clause {i}. " + "It says something of weight. " * 4 for i in range(6))
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "m.json").write_text(json.dumps({"entries": [{"path": f"{n}.txt", "source": n, "source_display": n.title(), "source_kind": "policy"} for n in ("alpha", "beta")]}))
    return tmp_path / "m.json"


class Failing:
    def embed(self, texts):
        raise RuntimeError("secret-key in here")


class Counting:
    def complete(self, system, prompt):
        return f"  answer to {len(prompt)} characters "


def test_sources(spark, manifest):
    rows = corpus.read_sources(spark, manifest).orderBy("entry_ord").collect()
    assert [r.source for r in rows] == ["alpha", "beta"] and "\r" not in rows[0].text and rows[0].doc_type == "overview"


def test_index_states(spark, manifest, tmp_path):
    index, sources = Index(spark, tmp_path / "index"), corpus.read_sources(spark, manifest)
    assert ensure_index(index, sources, SMALL) == ["index is empty (first ingestion)"]
    count = index.count()
    assert count > 4 and ensure_index(index, sources, SMALL) == []
    ids = [r.id for r in index.chunks().orderBy("id_num").collect()]
    assert ids == [f"doc_{i}" for i in range(count)]
    changed = Settings(**{**SMALL.__dict__, "corpus_version": "2"})
    with pytest.raises(IndexBuildError) as e:
        ensure_index(index, sources, changed, provider=Failing())
    assert "secret" not in str(e.value)
    assert index.manifest()["state"] == "incomplete"
    assert ensure_index(index, sources, changed) == ["previous ingestion did not complete (index state: 'incomplete')"]
    with pytest.raises(IndexBuildError):  # nothing stored is touched by a corpus without chunks
        ensure_index(index, sources.withColumn("text", F.lit("")), Settings(**{**SMALL.__dict__, "corpus_version": "3"}))
    assert index.manifest()["state"] == "complete" and index.count() == count


def test_answers(spark, manifest, tmp_path):
    index = Index(spark, tmp_path / "index")
    ensure_index(index, corpus.read_sources(spark, manifest), SMALL)
    cache = AnswerCache(spark, tmp_path / "cache", A.answer_fingerprint(index, SMALL, A.Profile()))
    asked = spark.createDataFrame([(1, "What does clause 2 say?"), (2, "И что тогда?")], "query_id long, query string")
    first = {r.query_id: r for r in A.answer(asked, index, cache, SMALL, chat=Counting()).collect()}
    assert first[1].answer.startswith("answer to") and not first[1].from_cache and len(first[1].context_docs) == 2 and first[1].model == "offline"
    again = {r.query_id: r for r in A.answer(asked.withColumn("query", F.concat(F.lit("  "), "query", F.lit("!"))), index, cache, SMALL, chat=Counting()).collect()}
    assert all(r.from_cache and r.model is None and r.cached_at for r in again.values())
    assert cache.stats()["entries"] == 2
    strict = Settings(**{**SMALL.__dict__, "max_distance": 0.0})
    gated = {r.query_id: r for r in A.answer(asked, index, AnswerCache(spark, tmp_path / "other", "f"), strict, chat=None).collect()}
    assert gated[1].answer == T.NO_BASIS["en"] and gated[2].answer == T.NO_BASIS["ru"] and all(r.insufficient_basis for r in gated.values())
    cache.clear()
    assert cache.stats()["entries"] == 0
    with pytest.raises(ValueError):
        AnswerCache(spark, tmp_path, " ")


def hits(spark, rows):
    return spark.createDataFrame([(1, i, d, t) for i, (d, t) in enumerate(rows, 1)], "query_id long, rank int, distance double, text string")


def kept(frame):
    return [r["rank"] for r in frame.orderBy("number").collect()]


def test_selection_order(spark):
    nan, inf = float("nan"), float("inf")
    assert kept(R.select_context(hits(spark, [(0.44, "a"), (0.45, "b"), (nan, "c"), (-inf, "d"), (None, "e"), (0.1, "  "), (0.2, None), (0.3, "f")]))) == [1, 8]
    # a copy beyond the cutoff does not push out one within it; copies take no final place
    assert kept(R.select_context(hits(spark, [(0.9, "a"), (0.1, "a"), (0.2, " a "), (0.2, "b"), (0.3, "c")]), final_top_k=2)) == [2, 4]
    # order stays that of the ranks
    assert kept(R.select_context(hits(spark, [(0.4, "a"), (0.1, "b")]))) == [1, 2]


def test_top_k_ties_and_odd_vectors(spark):
    chunks = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id_num long, embedding array<double>")
    found = R.top_k(spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>"), chunks, 2).orderBy("rank").collect()
    assert [(r.id_num, r.distance) for r in found] == [(1, 0.0), (3, 0.0)]
    assert R.top_k(spark.createDataFrame([], "query_id long, embedding array<double>"), chunks, 2).count() == 0


def test_providers_are_tried_again():
    class Shy:
        calls = 0

        def embed(self, texts):
            self.calls += 1
            if self.calls < 3:
                raise R.Retryable
            return [(1, [2.0]), (0, [1.0])]

    waits = []
    assert R.embed_batch(Shy(), ["a", "b"], 5, waits.append) == [[1.0], [2.0]] and waits == [1, 2]
    with pytest.raises(R.ProviderError):
        R.embed_batch(type("Down", (), {"embed": lambda self, t: (_ for _ in ()).throw(R.Retryable())})(), ["a"], 2, waits.append)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_normal_forms_of_all_known_code_points_without_python_workers(spark):
    known = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    # alone, and between marks that are put in another order or composed
    rows = pd.DataFrame({"t": known, "u": [f"a{c}\u0323\u0301{c}\u0300" for c in known]})
    given = spark.createDataFrame(rows)
    found = given.select(*(rule(F.col(c)).alias(f"{c}{form}") for c in "tu" for form, rule in (("NFC", T.nfc), ("NFKC", T.nfkc))))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    found = found.toPandas()
    for c in "tu":
        for form in ("NFC", "NFKC"):
            assert found[c + form].tolist() == [unicodedata.normalize(form, x) for x in rows[c]]
    assert value(spark, T.nfc(F.lit(None).cast("string"))) is None and value(spark, T.nfkc(F.lit(""))) == ""


def test_text_rules(spark):
    assert value(spark, T.question_text(F.lit("  What is  IT ?! "))) == "what is it"
    assert value(spark, T.question_text(F.lit("what ? !"))) == "what ?"
    assert value(spark, T.content_text(F.lit("é  a\x1cb"))) == "é a b"
    assert value(spark, T.content_key(F.lit(" 　"))) is None
    assert value(spark, T.escape_body(F.lit("</retrieved_fragment>"))) == "&lt;/retrieved_fragment>"
    assert value(spark, T.escape_attribute(F.lit("a\n\"b' <&>"))) == "a &quot;b&#x27; &lt;&amp;&gt;"
    assert value(spark, T.fragment(F.lit(1), F.lit("x<y"), F.lit(""), F.lit("s"), F.lit(None).cast("string"), F.lit("h"))) == '<retrieved_fragment number="1" source="s" heading="h">\nx&lt;y\n</retrieved_fragment>'
    assert value(spark, T.snippet(F.lit("HEADbody"), F.lit("4"))) == "body" and value(spark, T.snippet(F.lit("HEADbody"), F.lit("x"))) == "HEADbody"


def test_reports(spark):
    m = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 0.5), ("c", None)], "metric string, value double")
    means = {r.metric: r["mean"] for r in V.metric_means(m).collect()}
    assert means == {"a": 1.0, "b": 0.5, "c": None}
    assert V.overall(V.metric_means(m)).first().asDict() == {"overall": 0.75, "verdict": "good"}
    assert V.overall(V.metric_means(m.where("1 = 0"))).first().overall == 0.0
    ranges = {r.label: (r.n, r.distances) for r in V.distance_ranges(spark.createDataFrame([("relevant", 0.1), ("relevant", 0.25)], "label string, distance double")).collect()}
    assert ranges == {"relevant": (2, "0.100000..0.250000"), "doubtful": (0, "n/a"), "irrelevant": (0, "n/a")}
    assert value(spark, V.report_label(F.lit("Какой налог?"), F.lit("НДС"))) == "relevant"
    assert value(spark, V.report_label(F.lit("порядок алиментов"), F.lit("гарант"))) == "irrelevant"
    assert value(spark, V.report_label(F.lit("отказ"), F.lit("выплат"))) == "doubtful"


def test_questions_as_a_stream(spark, tmp_path):
    from lodestone.streaming.questions import answer_stream

    asked = spark.createDataFrame([(1, "a"), (2, "ф")], "query_id long, query string")
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    answer_stream(stream, lambda b: b.withColumn("answer", T.no_basis_answer(F.col("query"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.query_id: r.answer for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: T.NO_BASIS["en"], 2: T.NO_BASIS["ru"]}
