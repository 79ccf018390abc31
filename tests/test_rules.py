"""Rules that work on one value: chunking, identity, configuration."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions import identity as I
from lodestone.functions import prompt as P
from lodestone.operators import chunking as C
from lodestone.sources import config as K


@settings(max_examples=200, deadline=None)
@given(st.text("ab .!?;,\n", max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_pieces_keep_the_limit_and_end(text, limit, overlap):
    pieces = C.hard_pieces(text, limit, overlap)
    assert all(0 < len(p) <= limit for p in pieces) and bool(pieces) == bool(text.strip())


def test_pieces():
    assert C.hard_pieces("", 100, 20) == [] and C.hard_pieces(None, 100, 20) == []
    assert C.hard_pieces("short", 100, 20) == ["short"] and C.hard_pieces(" whole text ", 0, 5) == ["whole text"]
    assert len(C.hard_pieces("X" * 2000, 100, 99)) < 1000
    # the first kind of cut in the list that qualifies wins, not the latest
    assert C.hard_pieces("aaaaaaaa. b c ddd ee", 14, 0)[0] == "aaaaaaaa."


def test_overlap_starts_at_a_sentence():
    assert C.carried_over("One two. Three four", 14) == "Three four"
    assert C.carried_over("abc", 10) == "abc"
    assert C.carried_over("keep all", 0) == "keep all"


def test_only_a_leading_long_paragraph_is_cut_by_sentences():
    long = "Aaaa bbbb. " * 10
    leading = C.semantic_chunks(long, 40, 0, 1)
    assert all(len(c) <= 110 for c in leading) and len(leading) > 1
    later = C.semantic_chunks(f"Short one.\n\n{long}", 40, 5, 1)
    assert any(len(c) > 40 for c in later)


def test_headers_take_half_a_chunk_at_most():
    profile = K.Profile()
    heading = C.heading_of("H" * 300)
    assert heading == "H" * 160 + "…"
    assert len(C.header_for(profile, "D" * 80, "policy", heading, 400)) == 200
    assert C.header_for(profile, "D" * 60, "policy", heading, 100) == ""


def test_chunk_rows():
    doc = {"text": "Title\n\n" + "A sentence here. " * 60, "source_display": "Doc", "source_kind": "policy", "doc_type": "overview"}
    rows = list(C.chunks_of(doc, K.Profile(), 400, 80, 30))
    assert len(rows) > 2 and all(len(r["text"]) <= 400 for r in rows)
    assert all(r["text"][: r["header_len"]].startswith("[Source: Doc | policy]") for r in rows if r["header_len"])


def test_sections():
    assert C.sections_of("A one\nB two", r"(?m)^(?=[AB])") == ["A one", "B two"]
    assert C.sections_of(" none ", r"(?m)^(?=Z)") == ["none"] and C.sections_of("  ", None) == []


@pytest.mark.parametrize(
    ("raw", "normal"),
    [("HTTPS://API.Example.com:443/v1/", "https://api.example.com/v1"), ("http://LocalHost:80", "http://localhost"), ("http://[::1]:8080/v1", "http://[::1]:8080/v1"), ("https://u:p@h.example/v1?x=1#f", "https://h.example/v1"), ("Not A URL/", "not a url"), ("  ", ""), (None, ""), ("http://h:99999/x", "http://h:99999/x")],
)
def test_endpoints(raw, normal):
    assert I.normal_endpoint(raw) == normal


def identity(**changes):
    return I.IndexIdentity(**{"corpus_version": "1", "corpus_fingerprint": "c", "embedding_model": "a", "embedding_endpoint": "default", "chunk_size": 800, "chunk_overlap": 200, "min_chunk_len": 80, "profile_fingerprint": "p"} | changes)


def test_index_problems():
    stored = I.to_manifest(identity(), I.COMPLETE, 7)
    assert I.index_problems(identity(), stored, 7) == []
    assert I.index_problems(identity(), None, 0) == ["index is empty (first ingestion)"]
    assert I.index_problems(identity(), {}, 3) == ["index manifest is missing (the 3 stored chunks were built without one)"]
    assert I.index_problems(identity(embedding_model="b"), stored, 7) == ["embedding model changed (was 'a', now 'b')"]
    assert I.index_problems(identity(corpus_fingerprint="d"), stored, 7) == ["corpus manifest/content fingerprint changed"]
    assert I.index_problems(identity(), stored, 6) == ["chunk count mismatch (manifest records 7, collection holds 6)"]
    assert I.index_problems(identity(), I.to_manifest(identity(), I.INCOMPLETE, 7), 7) == ["previous ingestion did not complete (index state: 'incomplete')"]
    for bad in (0, -1, "7", 7.0, True, None):
        assert len(I.index_problems(identity(), stored | {"rag_chunk_count": bad}, 7)) == 1


def test_canonical_json():
    assert I.canonical_json({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}'
    with pytest.raises(ValueError):
        I.canonical_json(float("nan"))


def test_every_setting_changes_the_answers_identity():
    base = {"index": identity().values(), "chat_model": "m", "chat_endpoint": "default", "max_tokens": 10, "temperature": 0.1, "raw_top_k": 3, "max_distance": 0.4, "final_top_k": 2, "system_prompt_extra": ""}
    other = {"index": identity(chunk_size=1).values(), "chat_model": "n", "chat_endpoint": "x", "max_tokens": 11, "temperature": 0.2, "raw_top_k": 4, "max_distance": 0.5, "final_top_k": 1, "system_prompt_extra": "be kind"}
    prints = {I.fingerprint(I.AnswerIdentity(**base | {k: v}).values()) for k, v in other.items()}
    assert len(prints) == len(base) and I.fingerprint(I.AnswerIdentity(**base).values()) not in prints
    for bad in (float("nan"), True, "0.3"):
        with pytest.raises(ValueError, match="temperature"):
            I.AnswerIdentity(**base | {"temperature": bad})


def test_system_prompt_only_grows():
    assert P.system_prompt(" ") == P.SYSTEM and P.system_prompt("Be brief.").startswith(P.SYSTEM)


@pytest.mark.parametrize("bad", [{"nmae": "x"}, {"name": " "}, {"section_boundaries": {"a": "("}}, {"chunk_header": "{other}"}, {"chunk_header": "{heading"}, {"system_prompt_extra": "x" * 4001}, {"kind_labels": {"a": 1}}, []])
def test_profiles_are_checked(bad):
    with pytest.raises(K.ConfigError):
        K.profile_from(bad)


@pytest.mark.parametrize("bad", [[], {}, {"entries": []}, {"entries": "x"}, {"entries": ["x"]}, {"entries": [{"path": "a.txt", "source": "a"}]}, {"entries": [{"path": "no.txt", "source": "a", "source_display": "A"}]}])
def test_manifests_are_checked(tmp_path, bad):
    (tmp_path / "m.json").write_text(json.dumps(bad))
    with pytest.raises(K.ConfigError):
        K.load_corpus(tmp_path / "m.json")


def test_settings(monkeypatch):
    assert K.Settings.from_env().final_top_k == 5
    monkeypatch.setenv("RAG_TOP_K", "3")
    assert K.Settings.from_env().final_top_k == 3
    monkeypatch.setenv("RAG_FINAL_TOP_K", "")
    with pytest.raises(K.ConfigError):
        K.Settings.from_env()
    for bad in ({"max_distance": True}, {"max_distance": -1.0}, {"max_distance": float("nan")}, {"final_top_k": 0}, {"raw_top_k": True}):
        with pytest.raises(K.ConfigError):
            K.Settings(**bad)


def test_questions_and_env(tmp_path, monkeypatch):
    (tmp_path / "q.json").write_text(json.dumps({"cases": [{"question": " a? ", "ground_truth": "b"}]}))
    assert K.load_questions(tmp_path / "q.json") == ("q", [("a?", "b")])
    (tmp_path / ".env").write_text("A_SETTING=file\nOTHER_SETTING='x'\n# no=1\n")
    monkeypatch.setenv("A_SETTING", "process")
    monkeypatch.delenv("OTHER_SETTING", raising=False)
    K.load_env(tmp_path / ".env")
    import os

    assert (os.environ["A_SETTING"], os.environ.pop("OTHER_SETTING")) == ("process", "x")
