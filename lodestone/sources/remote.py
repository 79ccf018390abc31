"""Models behind an endpoint that speaks the public chat and embeddings protocol over HTTP, asked from executors.

A client holds nothing but settings, so it travels to the tasks. Requests are bounded in number across all tasks by `Limits`, and each answer is
written as a file of its own before it is used: a task that runs again, on another executor or in another run, asks only for what has no answer yet.
"""

from __future__ import annotations

import hashlib
import json
import socket
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.retrieval import ProviderError, Retryable
from lodestone.sources import resolve
from lodestone.sources.config import Settings
from lodestone.sources.storage import Place

#: Answers of a server that may be another one next time.
BUSY = {408, 409, 429, 500, 502, 503, 504}
LONGEST_PAUSE = 30


def connection_hint(shown: str, error: BaseException | None = None) -> str:
    """What to look at when an endpoint can't be reached; names neither key nor credentials."""
    kind = f" ({type(error).__name__})" if error else ""
    return (
        f"no answer from the model endpoint {shown}{kind}: connection error or time-out. Check that {resolve.URL} names an endpoint that can be reached and has the model, that a local "
        "server is running, and network, firewall and proxy (HTTPS_PROXY) for a remote one. A longer OPENAI_TIMEOUT or a smaller RAG_EMBED_BATCH_SIZE may help."
    )


class Client:
    """POST requests to one endpoint, with its time-out and retries."""

    def __init__(self, endpoint: resolve.Endpoint, sleep: Callable[[float], None] = time.sleep):
        self.endpoint, self.sleep = endpoint, sleep

    def post(self, path: str, body: dict[str, Any]) -> dict[str, Any]:
        """The answer's JSON. Busy servers and connection errors are asked again; refusals are a ProviderError at once."""
        url = f"{self.endpoint.url.rstrip('/')}/{path}"
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.endpoint.key}"}
        failure: BaseException | None = None
        for k in range(self.endpoint.retries + 1):
            if k:
                self.sleep(min(LONGEST_PAUSE, 2 ** (k - 1)))
            try:
                with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=self.endpoint.timeout) as found:
                    return json.loads(found.read())
            except urllib.error.HTTPError as e:
                if e.code not in BUSY:
                    raise ProviderError(f"the model endpoint {self.endpoint} refused {path}: HTTP {e.code}") from None
                failure = e
            except (urllib.error.URLError, socket.timeout, ConnectionError, TimeoutError) as e:
                failure = e
            except ValueError:
                raise ProviderError(f"the model endpoint {self.endpoint} answered {path} with no JSON") from None
        raise Retryable(connection_hint(str(self.endpoint), failure)) from None


class RemoteEmbedder:
    def __init__(self, client: Client, model: str):
        self.client, self.model = client, model

    def embed(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        found = self.client.post("embeddings", {"model": self.model, "input": texts})
        return [(int(d["index"]), [float(x) for x in d["embedding"]]) for d in found["data"]]


class RemoteChat:
    def __init__(self, client: Client, model: str, max_tokens: int | None = None, temperature: float = 0.0):
        self.client, self.model, self.max_tokens, self.temperature = client, model, max_tokens, temperature

    def complete(self, system: str, prompt: str) -> str | None:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages, "temperature": self.temperature}
        if self.max_tokens is not None:
            body["max_tokens"] = self.max_tokens
        try:
            choices = self.client.post("chat/completions", body).get("choices") or [{}]
        except Retryable as e:
            raise ProviderError(str(e)) from None
        return (choices[0].get("message") or {}).get("content")


def providers(settings: Settings = Settings()) -> tuple[RemoteEmbedder, RemoteChat]:
    """(embedder, chat) of the endpoint that the environment names; a missing key is an error before anything is asked."""
    client = Client(resolve.endpoint())
    return RemoteEmbedder(client, settings.embedding_model), RemoteChat(client, settings.chat_model, settings.max_tokens, settings.temperature)


def judge_chat(judge: resolve.Judge) -> RemoteChat:
    return RemoteChat(Client(judge.endpoint), judge.model)


@dataclass(frozen=True)
class Limits:
    """Requests at a time and requests a second (None: no limit), over all tasks of a job together."""

    concurrency: int = 8
    per_second: float | None = None


class Pace:
    """Lets a task begin a request no more often than its share of the rate allows."""

    def __init__(self, per_second: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.every, self.next, self.clock, self.sleep = 1 / per_second if per_second else 0.0, 0.0, clock, sleep

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.every


class Journal:
    """Answers by request, each a file under a folder that all machines share; written under a name of its own and then renamed."""

    def __init__(self, uri: str):
        self.uri = uri

    @classmethod
    def at(cls, place: Place) -> Journal:
        return cls(place.qualified())

    def _open(self, key: str):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.uri)
        return system, f"{folder}/{key[:2]}", f"{folder}/{key[:2]}/{key}.json"

    def get(self, key: str) -> Any:
        """The stored answer; LookupError where there is none."""
        system, _, path = self._open(key)
        try:
            with system.open_input_stream(path) as f:
                return json.loads(f.read())["answer"]
        except FileNotFoundError:
            raise LookupError(key) from None

    def put(self, key: str, answer: Any) -> None:
        system, folder, path = self._open(key)
        system.create_dir(folder, recursive=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps({"answer": answer}).encode())
        system.move(draft, path)


class JournaledChat:
    """A chat whose answers are written down: an equal request, in this run or a later one, is not sent again."""

    def __init__(self, chat: Any, journal: Journal, identity: str):
        self.chat, self.journal, self.identity = chat, journal, identity

    def complete(self, system: str, prompt: str) -> str | None:
        key = hashlib.sha256(json.dumps([self.identity, system, prompt]).encode()).hexdigest()
        try:
            return self.journal.get(key)
        except LookupError:
            found = self.chat.complete(system, prompt)
            self.journal.put(key, found)
            return found


def ask(requests: DataFrame, send: Callable[[dict[str, Any]], Any], journal: Journal, identity: str, limits: Limits = Limits(), column: str = "answer") -> DataFrame:
    """requests with a text column: send(row as a dict), a text or null for each different row.

    identity: all beside the row that shapes an answer (model, endpoint, prompt version). Equal rows are sent once. Tasks are `limits.concurrency`, each with its share of the rate.
    """
    names = requests.columns
    key = F.sha2(F.concat(F.lit(hashlib.sha256(identity.encode()).hexdigest()), F.to_json(F.struct(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names))), {"ignoreNullFields": "false"})), 256)
    keyed = requests.withColumn("_request", key)
    share = limits.per_second / limits.concurrency if limits.per_second else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(share)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                request = row.pop("_request")
                try:
                    found = journal.get(request)
                except LookupError:
                    pace.wait()
                    found = send(row)
                    journal.put(request, found)
                yield pa.RecordBatch.from_arrays([pa.array([request], pa.string()), pa.array([found], pa.string())], ["_request", column])

    once = keyed.dropDuplicates(["_request"]).repartition(limits.concurrency, "_request")
    answers = once.mapInArrow(run, f"_request string, `{column}` string")
    return keyed.join(answers, "_request", "left").drop("_request")
