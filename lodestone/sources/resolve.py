"""What the environment says about the corpus, the index, the model endpoint and the judge. Driver only; keys never become columns."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from lodestone.functions.identity import normal_endpoint
from lodestone.sources import config as K

#: The names of settings and their defaults.
CORPUS, COLLECTION, INDEX = "RAG_CORPUS_CONFIG", "RAG_COLLECTION_NAME", "RAG_CHROMA_PATH"
DEFAULT_COLLECTION, DEFAULT_INDEX = "rag_collection", "runtime/chroma_db"
KEY, OLD_KEY, URL, OLD_URL = "LLM_API_KEY", "OPENAI_API_KEY", "LLM_BASE_URL", "OPENAI_BASE_URL"
HOSTED_URL = "https://api.openai.com/v1"
JUDGE_URL, JUDGE_KEY, JUDGE_MODEL = "RAG_EVAL_JUDGE_BASE_URL", "RAG_EVAL_JUDGE_API_KEY", "RAG_EVAL_JUDGE_MODEL"
CHAT_MODEL, DEFAULT_CHAT_MODEL = "RAG_CHAT_MODEL", "gpt-4o-mini"
NO_TRACKING = "RAGAS_DO_NOT_TRACK"


def setting(*names: str) -> str:
    """The first of these settings that is not blank, trimmed; else ''."""
    return next(filter(None, (os.environ.get(n, "").strip() for n in names)), "")


def corpus_entries(root: str | Path = ".") -> list[dict[str, Any]]:
    """The entries of the manifest that RAG_CORPUS_CONFIG names; not naming one is an error, never an empty corpus."""
    if named := setting(CORPUS):
        return K.load_corpus(Path(root) / named)
    raise K.ConfigError(f"no corpus is configured: set {CORPUS} to the path of a corpus manifest")


def profile(root: str | Path = ".") -> K.Profile:
    """The profile of that manifest, the default one without a manifest."""
    named = setting(CORPUS)
    return K.load_profile(Path(root) / named) if named else K.Profile()


def collection_name() -> str:
    return setting(COLLECTION) or DEFAULT_COLLECTION


def index_folder(root: str | Path = ".") -> str:
    """A relative path lies under root, an absolute one or a URI stays as it is."""
    named = setting(INDEX) or DEFAULT_INDEX
    return named if "://" in named else str(Path(root).resolve() / named)


@dataclass(frozen=True)
class Endpoint:
    """How a model is reached. Its text shows neither key nor credentials."""

    url: str = field(repr=False)
    key: str = field(repr=False)
    timeout: float = 180.0
    retries: int = 5

    def __str__(self) -> str:
        return normal_endpoint(self.url)


def base_url() -> str | None:
    """The configured URL. A new-style key without a URL means the hosted default, whatever an old-style URL says; so does None."""
    return setting(URL) or (None if setting(KEY) else setting(OLD_URL) or None)


def endpoint() -> Endpoint:
    key = setting(KEY, OLD_KEY)
    if not key:
        raise K.ConfigError(f"{KEY} (or {OLD_KEY}) is not set")
    return Endpoint(base_url() or HOSTED_URL, key, K.number("OPENAI_TIMEOUT", 180, 0, float), K.number("OPENAI_MAX_RETRIES", 5, 0))


@dataclass(frozen=True)
class Judge:
    model: str
    endpoint: Endpoint
    separate: bool

    def __str__(self) -> str:
        return f"model={self.model} endpoint={self.endpoint} ({'separate judge endpoint (RAG_EVAL_JUDGE_*)' if self.separate else 'the application own endpoint'})"


def judge(model: str | None = None) -> Judge:
    """The application's own endpoint, unless a judge's URL and key are both set; one without the other is an error."""
    named = (model or "").strip() or setting(JUDGE_MODEL, CHAT_MODEL) or DEFAULT_CHAT_MODEL
    own = {name: setting(name) for name in (JUDGE_URL, JUDGE_KEY)}
    if all(own.values()):
        return Judge(named, Endpoint(own[JUDGE_URL], own[JUDGE_KEY]), True)
    if any(own.values()):
        raise K.ConfigError(f"a separate judge needs both {JUDGE_URL} and {JUDGE_KEY}; unset both to judge with the application's own endpoint")
    return Judge(named, endpoint(), False)


def keep_private() -> None:
    """Usage statistics of evaluation libraries are off unless the user has said otherwise."""
    if not setting(NO_TRACKING):
        os.environ[NO_TRACKING] = "true"
