"""Judged metrics, the HTTP provider against a local server, and evaluation runs that are interrupted."""

from __future__ import annotations

import json
import pickle
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone import cli, evaluate
from lodestone.operators import judging as J
from lodestone.operators.retrieval import ProviderError, Retryable, embed
from lodestone.plans import judged as P
from lodestone.sources import remote as H
from lodestone.sources.config import ConfigError
from lodestone.sources.resolve import Endpoint
from lodestone.sources.storage import Place


class Server:
    """A model endpoint: embeddings are text lengths, a chat says yes to evidence with "good" in it. It can be told to fail first."""

    def __init__(self):
        outer, self.asked, self.failures, self.most, self.now, self.lock = self, [], [], 0, 0, threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def do_POST(self):
                with outer.lock:
                    outer.now += 1
                    outer.most = max(outer.most, outer.now)
                    fail = outer.failures.pop(0) if outer.failures else None
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with outer.lock:
                    outer.asked.append((self.path, self.headers["Authorization"], body))
                if fail:
                    out, code = b"no", fail
                elif self.path.endswith("/embeddings"):
                    data = [{"index": i, "embedding": [len(t), 1]} for i, t in enumerate(body["input"])]
                    out, code = json.dumps({"data": data[::-1]}).encode(), 200
                else:
                    prompt = body["messages"][1]["content"]
                    word = "Yes." if "<evidence>\n" in prompt and "good" in prompt.split("<evidence>\n")[1] else "No" if "<evidence>" in prompt else "A good answer. And more."
                    out, code = json.dumps({"choices": [{"message": {"content": word}}]}).encode(), 200
                self.send_response(code)
                self.end_headers()
                self.wfile.write(out)
                with outer.lock:
                    outer.now -= 1

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://user:secret@127.0.0.1:{self.http.server_port}/v1/".replace("user:secret@", "")
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


@pytest.fixture
def server():
    made = Server()
    yield made
    made.http.shutdown()


def pauses(endpoint: Endpoint) -> tuple[H.Client, list]:
    slept: list[float] = []
    return H.Client(endpoint, slept.append), slept


def test_client_retries_and_refusals(server):
    client, slept = pauses(Endpoint(server.url, "key", 5.0, 3))
    server.failures = [503, 429]
    assert H.RemoteEmbedder(client, "m").embed(["a", "bbb"]) == [(1, [3.0, 1.0]), (0, [1.0, 1.0])]
    assert slept == [1, 2] and server.asked[0][:2] == ("/v1/embeddings", "Bearer key") and server.asked[0][2]["model"] == "m"
    assert H.RemoteChat(client, "c", 7, 0.5).complete("s", "p") == "A good answer. And more."
    sent = server.asked[-1][2]
    assert (sent["max_tokens"], sent["temperature"], [m["role"] for m in sent["messages"]]) == (7, 0.5, ["system", "user"])
    server.failures = [401]
    with pytest.raises(ProviderError, match="HTTP 401"):
        H.RemoteChat(client, "c").complete("s", "p")
    server.failures = [500] * 9
    with pytest.raises(Retryable):
        H.RemoteEmbedder(client, "m").embed(["a"])
    server.failures = []


def test_hint_shows_no_credentials():
    client, slept = pauses(Endpoint("http://user:secret@127.0.0.1:9/v1?key=secret", "hidden", 0.2, 2))
    with pytest.raises(ProviderError) as e:
        H.RemoteChat(client, "c").complete("s", "p")
    assert "secret" not in str(e.value) and "hidden" not in str(e.value) and "LLM_BASE_URL" in str(e.value) and "127.0.0.1:9/v1" in str(e.value) and slept == [1, 2]


def test_embeddings_on_executors(spark, server):
    provider = H.RemoteEmbedder(H.Client(Endpoint(server.url, "key", 5.0, 2)), "m")
    pickle.loads(pickle.dumps(provider))
    server.failures = [502]
    found = embed(spark.createDataFrame([(i, "x" * i) for i in range(40)], "id int, text string").repartition(3), provider, batch=4)
    assert {r["id"]: r["embedding"] for r in found.collect()} == {i: [float(i), 1.0] for i in range(40)}


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    pace = H.Pace(4, lambda: now[0], sleep)
    for _ in range(3):
        pace.wait()
    assert slept == [0.25, 0.25]
    H.Pace(None, sleep=pytest.fail).wait()


def test_answers_are_asked_once_and_kept(spark, server, tmp_path):
    journal = H.Journal.at(Place(spark, tmp_path / "journal"))
    chat = H.RemoteChat(H.Client(Endpoint(server.url, "k", 5.0, 0)), "m")
    rows = spark.createDataFrame([("q1", "x"), ("q2", None), ("q1", "x"), (None, "y")], "prompt string, other string").repartition(3)

    def send(row):
        return chat.complete("s", f"{row['prompt']} {row['other']}")

    limits = H.Limits(2, 1000.0)
    assert [r["answer"] for r in H.ask(rows, send, journal, "one", limits).collect()] == ["A good answer. And more."] * 4
    assert len(server.asked) == 3 and server.most <= 2
    H.ask(rows, send, journal, "one", limits).collect()
    assert len(server.asked) == 3
    H.ask(rows, send, journal, "two", limits).collect()
    assert len(server.asked) == 6
    server.failures = [400]
    with pytest.raises(Exception, match="HTTP 400"):
        H.ask(rows, send, journal, "three", H.Limits(1)).collect()
    asked = len(server.asked)
    H.ask(rows, send, journal, "three", H.Limits(1)).collect()
    assert len({json.dumps(x[2]) for x in server.asked[6:]}) == 3 and len(server.asked) >= asked
    assert H.ask(rows.limit(0), send, journal, "one", limits).count() == 0


def test_metrics_by_hand(spark):
    rows = [
        (1, "faithfulness", 1, True), (1, "faithfulness", 2, False), (1, "faithfulness", 3, None), (1, "context_precision", 1, False), (1, "context_precision", 2, True), (1, "context_precision", 3, True),
        (2, "context_precision", 1, None), (2, "context_precision", 2, True), (2, "context_utilization", 1, False), (3, "faithfulness", 1, None),
    ]
    verdicts = spark.createDataFrame(rows, "query_id long, metric string, item int, verdict boolean").repartition(3)
    cases = spark.createDataFrame([(i,) for i in (1, 2, 3, 3, 4)], "query_id long")
    found = {(r["query_id"], r["metric"]): r["value"] for r in J.metrics(verdicts, cases).collect()}
    assert len(found) == 12 and found[1, "faithfulness"] == 0.5 and found[1, "context_precision"] == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert found[2, "context_precision"] == 1.0 and found[2, "context_utilization"] == 0.0
    assert all(v is None for k, v in found.items() if k not in {(1, "faithfulness"), (1, "context_precision"), (2, "context_precision"), (2, "context_utilization")})


def test_requests(spark):
    schema = "query_id long, question string, answer string, contexts array<string>, ground_truth string"
    cases = spark.createDataFrame([(1, "q", "One. Two at Mr. A. Three", ["f", None, "g"], "t"), (2, None, None, None, None), (3, "q", "", [], "t")], schema)
    rows = sorted(tuple(r) for r in J.requests(cases).collect())
    assert rows == [
        (1, "context_precision", 1, "q", "t", "f"), (1, "context_precision", 2, "q", "t", "g"),
        (1, "context_utilization", 1, "q", "One. Two at Mr. A. Three", "f"), (1, "context_utilization", 2, "q", "One. Two at Mr. A. Three", "g"),
        (1, "faithfulness", 1, "q", "One.", "f\n\ng"), (1, "faithfulness", 2, "q", "Two at Mr. A. Three", "f\n\ng"),
    ]
    words = spark.createDataFrame([("a b c", "B c!", True), ("a b", "c", False), ("...", "a", None), ("Ä", "ä", True)], "s string, e string, v boolean")
    assert all(r[0] is r[1] for r in words.select("v", J.overlap_verdict(F.col("s"), F.col("e"))).collect())


def test_verdict_words(spark):
    said = [("Yes.", True), ("  no, it", False), ("«Да»", True), ("нет", False), ("Perhaps yes", None), ("", None), (None, None), ("yesterday", None)]
    found = spark.createDataFrame(said, "a string, v boolean").select("v", P.verdict(F.col("a")).alias("w")).collect()
    assert all(r["v"] is r["w"] for r in found)


@pytest.fixture
def deployment(tmp_path, monkeypatch, server):
    for name in ("OPENAI_API_KEY", "OPENAI_BASE_URL", "RAG_CHROMA_PATH", "RAG_COLLECTION_NAME", "RAG_EVAL_JUDGE_BASE_URL", "RAG_EVAL_JUDGE_API_KEY", "RAG_EVAL_JUDGE_MODEL"):
        monkeypatch.delenv(name, raising=False)
    (tmp_path / "a.txt").write_text("Rules of good things. " * 60)
    (tmp_path / "m.json").write_text(json.dumps({"entries": [{"path": "a.txt", "source": "a", "source_display": "A"}]}))
    (tmp_path / "eval.json").write_text(json.dumps({"name": "two", "cases": [{"question": "What?", "ground_truth": "that"}, {"question": "Why so?", "ground_truth": "so"}]}))
    for name, value in {"LLM_API_KEY": "key", "LLM_BASE_URL": server.url, "OPENAI_MAX_RETRIES": "0", "RAG_CORPUS_CONFIG": "m.json", "RAG_MAX_DISTANCE": "2"}.items():
        monkeypatch.setenv(name, value)
    return tmp_path


def test_evaluation_command_goes_on_where_it_stopped(spark, server, deployment, capsys):
    args = ["--dataset", str(deployment / "eval.json"), "--run", "r1", "--concurrency", "2"]
    assert evaluate.main(args, deployment, spark) == 0
    said = capsys.readouterr().out
    assert "two: 2 questions" in said and "1. What?" in said and "faithfulness: 1.0000" in said and "(good)" in said and "key" not in said.replace("key supporting", "")
    asked = len(server.asked)
    assert evaluate.main(args, deployment, spark) == 0
    assert capsys.readouterr().out == said and [p for p, *_ in server.asked[asked:]] == []
    # an interrupted run: the second time, only what has no answer yet is asked
    args[3] = "r2"
    chats = [json.dumps(b) for p, _, b in server.asked if p.endswith("completions")]
    server.failures = [None, None, None, None, 400, 400, 400, 400]
    assert evaluate.main(args, deployment, spark) == 1
    assert "--run r2" in capsys.readouterr().err
    server.failures = []
    assert evaluate.main(args, deployment, spark) == 0
    assert capsys.readouterr().out.replace("r2", "r1") == said
    assert {json.dumps(b) for p, _, b in server.asked[asked:] if p.endswith("completions")} == set(chats)
    with pytest.raises(ConfigError, match="begun with other"):
        P.Run(spark, deployment / "runtime" / "evaluation", "r1", {"other": 1})


def test_evaluation_command_without_a_judge(spark, deployment, monkeypatch, capsys):
    monkeypatch.delenv("LLM_API_KEY")
    assert evaluate.main(["--dataset", str(deployment / "eval.json")], deployment, spark) == 1
    assert evaluate.main(["--dataset", str(deployment / "none.json")], deployment, spark) == 1
    with pytest.raises(SystemExit):
        evaluate.main([], deployment, spark)
    assert "LLM_API_KEY" in capsys.readouterr().err


def test_console_asks_the_endpoint(spark, server, deployment, capsys):
    assert cli.main(deployment, spark, ["What?", "quit"]) == 0
    assert "A good answer. And more." in capsys.readouterr().out
    assert {p for p, *_ in server.asked} == {"/v1/embeddings", "/v1/chat/completions"}
