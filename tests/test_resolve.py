"""What the environment says: corpus, index, endpoint, judge."""

from __future__ import annotations

import json

import pytest

from lodestone.sources import config as K
from lodestone.sources import resolve as R


@pytest.fixture(autouse=True)
def clean(monkeypatch):
    for name in (R.CORPUS, R.COLLECTION, R.INDEX, R.KEY, R.OLD_KEY, R.URL, R.OLD_URL, R.JUDGE_URL, R.JUDGE_KEY, R.JUDGE_MODEL, R.CHAT_MODEL, "OPENAI_TIMEOUT", "OPENAI_MAX_RETRIES"):
        monkeypatch.delenv(name, raising=False)
    return monkeypatch


def test_no_corpus_is_an_error(clean, tmp_path):
    for value in (None, " "):
        if value is not None:
            clean.setenv(R.CORPUS, value)
        with pytest.raises(K.ConfigError, match=R.CORPUS):
            R.corpus_entries(tmp_path)
        assert R.profile(tmp_path) == K.Profile()


def test_the_named_corpus(clean, tmp_path):
    (tmp_path / "a.txt").write_text("text")
    manifest = {"entries": [{"path": "a.txt", "source": "a", "source_display": "A"}], "profile": {"name": "own"}}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    clean.setenv(R.CORPUS, "m.json")
    (entry,) = R.corpus_entries(tmp_path)
    assert (entry["source_kind"], entry["doc_type"], entry["path"]) == ("unknown", "overview", str(tmp_path / "a.txt")) and R.profile(tmp_path).name == "own"
    (tmp_path / "m.json").write_text(json.dumps(manifest | {"profile": None}))
    assert R.profile(tmp_path) == K.Profile()


def test_collection_and_folder(clean, tmp_path):
    assert (R.collection_name(), R.index_folder(tmp_path)) == ("rag_collection", str(tmp_path / "runtime/chroma_db"))
    clean.setenv(R.COLLECTION, " ")
    clean.setenv(R.INDEX, "own/index")
    assert (R.collection_name(), R.index_folder(tmp_path)) == ("rag_collection", str(tmp_path / "own/index"))
    for given in ("/far/away", "hdfs://name/index"):
        clean.setenv(R.INDEX, given)
        assert R.index_folder(tmp_path) == given


@pytest.mark.parametrize(
    ("settings", "url"),
    [({R.OLD_KEY: "k"}, R.HOSTED_URL), ({R.OLD_KEY: "k", R.OLD_URL: "http://old"}, "http://old"), ({R.KEY: "k", R.OLD_URL: "http://old"}, R.HOSTED_URL), ({R.KEY: "k", R.URL: " http://new ", R.OLD_URL: "http://old"}, "http://new"), ({R.OLD_KEY: "k", R.URL: "http://new"}, "http://new")],
)
def test_endpoint(clean, settings, url):
    for name, value in settings.items():
        clean.setenv(name, value)
    found = R.endpoint()
    assert (found.url, found.key, found.timeout, found.retries) == (url, "k", 180.0, 5)


def test_keys_are_not_shown(clean):
    with pytest.raises(K.ConfigError):
        R.endpoint()
    clean.setenv(R.KEY, "sk-hidden")
    clean.setenv(R.URL, "http://user:secret@h.example:80/v1/?t=1")
    shown = f"{R.endpoint()} {R.endpoint()!r} {R.judge()} {R.judge()!r}"
    assert "hidden" not in shown and "secret" not in shown and "http://h.example/v1" in shown


def test_judge(clean):
    with pytest.raises(K.ConfigError):
        R.judge()
    clean.setenv(R.KEY, "own")
    assert R.judge().endpoint.key == "own" and not R.judge().separate and R.judge().model == R.DEFAULT_CHAT_MODEL
    clean.setenv(R.CHAT_MODEL, "chat")
    assert R.judge().model == "chat" and R.judge(" named ").model == "named"
    clean.setenv(R.JUDGE_URL, "http://judge")
    with pytest.raises(K.ConfigError):
        R.judge()
    clean.setenv(R.JUDGE_KEY, "other")
    clean.setenv(R.JUDGE_MODEL, "strict")
    found = R.judge()
    assert (found.endpoint.url, found.endpoint.key, found.model, found.separate) == ("http://judge", "other", "strict", True)


def test_privacy(clean):
    for given, left in ((None, "true"), (" ", "true"), ("false", "false")):
        clean.delenv(R.NO_TRACKING, raising=False)
        if given is not None:
            clean.setenv(R.NO_TRACKING, given)
        R.keep_private()
        assert R.setting(R.NO_TRACKING) == left
    clean.delenv(R.NO_TRACKING)
