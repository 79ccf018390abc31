"""Declared inputs, checked on the driver before any plan is built: corpus manifests, domain profiles, question sets, settings."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from lodestone.functions import sentences as S

DEFAULT_HEADER = "[Source: {source_display} | {kind_label}]\n[Section: {heading}]\n\n"
HEADER_FIELDS = {"source_display", "kind_label", "heading"}
MOST_EXTRA_CHARS = 4000
#: What entries that say nothing have.
OPTIONAL = {"source_kind": "unknown", "doc_type": "overview"}


class ConfigError(ValueError):
    """A declared input is missing or malformed."""


Check = Callable[[Any], str | None]


def text(value: Any) -> str | None:
    return None if isinstance(value, str) and value.strip() else "must be a non-empty string"


def text_of_at_most(limit: int) -> Check:
    return lambda value: "must be a string" if not isinstance(value, str) else f"is longer than {limit} characters" if len(value) > limit else None


def texts_by_name(value: Any) -> str | None:
    if not isinstance(value, Mapping):
        return "must be an object of strings"
    odd = [x for pair in value.items() for x in pair if text(x)]
    return f"must hold non-empty strings, not {odd[0]!r}" if odd else None


def patterns(value: Mapping[str, str]) -> str | None:
    for name, pattern in value.items():
        try:
            re.compile(pattern)
        except re.error as e:
            return f"has no valid regex for {name!r}: {e}"
    return None


class _Blank(dict):
    """Stands for a template's values: every known name is blank, any other is an error."""

    def __missing__(self, name: str) -> str:
        if name in HEADER_FIELDS:
            return ""
        raise LookupError(f"unknown field {name!r}")


def template(value: str) -> str | None:
    try:
        value.format_map(_Blank())
    except (LookupError, ValueError, AttributeError) as e:
        return f"is no valid template: {e}"
    return None


def checked(what: str, value: Any, *checks: Check) -> Any:
    """value, if none of the checks, in their order, has a complaint."""
    for check in checks:
        if complaint := check(value):
            raise ConfigError(f"{what} {complaint}")
    return value


def ruled(default: Any, *checks: Check) -> Any:
    """A field with its checks; defaults that can change are made anew for each object."""
    options = {"default_factory": default} if callable(default) else {"default": default}
    return field(metadata={"checks": checks}, **options)


@dataclass(frozen=True)
class Profile:
    """How texts of a domain are cut and labelled. Data only."""

    name: str = ruled("generic", text)
    system_prompt_extra: str = ruled("", text_of_at_most(MOST_EXTRA_CHARS))
    section_boundaries: Mapping[str, str] = ruled(dict, texts_by_name, patterns)
    kind_labels: Mapping[str, str] = ruled(dict, texts_by_name)
    chunk_header: str = ruled(DEFAULT_HEADER, text, template)
    sentence_language: str = ruled("en", text)

    def __post_init__(self) -> None:
        for f in fields(self):
            checked(f"profile field {f.name}", getattr(self, f.name), *f.metadata["checks"])

    def chunking_identity(self) -> dict[str, Any]:
        """What changes stored chunks: all but the name and the prompt's extra, and the rules that cut sentences."""
        return {k: v for k, v in asdict(self).items() if k not in ("name", "system_prompt_extra")} | {"sentence_rules": S.rule_name(self.sentence_language)}


def profile_from(data: Any) -> Profile:
    """A manifest's profile; null stands for the default."""
    if data is None:
        return Profile()
    given = dict(checked("a profile", data, lambda x: None if isinstance(x, Mapping) else "must be an object"))
    known = {f.name: given.pop(f.name) for f in fields(Profile) if f.name in given}
    checked("a profile", sorted(given), lambda rest: f"has unknown fields {rest}" if rest else None)
    return Profile(**known)


def read_object(path: str | Path, what: str) -> Any:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise ConfigError(f"{what} not found: {path}") from e
    except json.JSONDecodeError as e:
        raise ConfigError(f"{what} is not valid JSON: {path}: {e}") from e
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError(f"{what} cannot be read: {path}: {e}") from e


def load_profile(path: str | Path) -> Profile:
    """The manifest's profile, or the default; corpus files are not looked at."""
    data = read_object(path, "corpus manifest")
    if not isinstance(data, Mapping):
        raise ConfigError("a corpus manifest must be an object")
    return profile_from(data.get("profile"))


def load_corpus(path: str | Path) -> list[dict[str, Any]]:
    """Entries in manifest order with entry_ord and the absolute path of their files."""
    data = read_object(path, "corpus manifest")
    entries = data.get("entries") if isinstance(data, Mapping) else None
    if not isinstance(entries, list) or not entries:
        raise ConfigError("a corpus manifest needs a non-empty list of entries")
    out = []
    for n, e in enumerate(entries):
        if not isinstance(e, Mapping):
            raise ConfigError(f"entry {n} must be an object")
        row = {f: checked(f"entry {n}: {f}", (OPTIONAL | e).get(f), text) for f in ("path", "source", "source_display", *OPTIONAL)}
        file = (Path(path).resolve().parent / row["path"]).resolve()
        if not file.is_file():
            raise ConfigError(f"entry {n}: no such file: {file}")
        out.append(row | {"entry_ord": n, "path": str(file), "file_name": file.name})
    return out


def load_questions(path: str | Path) -> tuple[str, list[tuple[str, str]]]:
    """(name, [(question, ground truth)]) of an evaluation set."""
    data = read_object(path, "evaluation set")
    cases = data.get("cases") if isinstance(data, Mapping) else None
    if not isinstance(cases, list) or not cases or not all(isinstance(c, Mapping) for c in cases):
        raise ConfigError("an evaluation set needs a non-empty list of cases")
    name = data.get("name")
    return (name.strip() if isinstance(name, str) and name.strip() else Path(path).stem), [tuple(checked(f"case {n}: {f}", c.get(f), text).strip() for f in ("question", "ground_truth")) for n, c in enumerate(cases)]


def load_env(path: str | Path) -> None:
    """KEY=value lines of one .env file; what the process has set stays."""
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, found, value = line.strip().removeprefix("export ").partition("=")
            if found and key.strip() and not key.startswith("#"):
                os.environ.setdefault(key.strip(), value.strip().strip("\"'"))


def number(name: str, default: float, least: float | None = None, kind: type = int) -> Any:
    """A setting from the environment."""
    raw = os.environ.get(name)
    try:
        value = kind(default if raw is None else raw)
    except ValueError as e:
        raise ConfigError(f"{name} must be a number, got {raw!r}") from e
    if least is not None and not value >= least:
        raise ConfigError(f"{name} must be at least {least}, got {raw!r}")
    return value


@dataclass(frozen=True)
class Settings:
    corpus_version: str = "1"
    embedding_model: str = "sha-256"
    embedding_endpoint: str | None = None
    chat_model: str = "offline"
    chat_endpoint: str | None = None
    chunk_size: int = 800
    chunk_overlap: int = 200
    min_chunk_len: int = 80
    embed_batch: int = 16
    embed_attempts: int = 5
    raw_top_k: int = 10
    max_distance: float = 0.44
    final_top_k: int = 5
    max_tokens: int = 1500
    temperature: float = 0.3

    def __post_init__(self) -> None:
        for name, least in (("chunk_size", 1), ("chunk_overlap", 0), ("min_chunk_len", 0), ("raw_top_k", 1), ("final_top_k", 1), ("embed_batch", 1), ("embed_attempts", 1)):
            value = getattr(self, name)
            if type(value) is not int or value < least:
                raise ConfigError(f"{name} must be an integer of at least {least}, got {value!r}")
        d = self.max_distance
        if isinstance(d, bool) or not isinstance(d, (int, float)) or not 0 <= d < float("inf"):
            raise ConfigError(f"max_distance must be a finite number of at least 0, got {d!r}")

    @classmethod
    def from_env(cls) -> Settings:
        """RAG_FINAL_TOP_K counts where it is present, even blank (then an error); else RAG_TOP_K."""
        final = "RAG_FINAL_TOP_K" if "RAG_FINAL_TOP_K" in os.environ else "RAG_TOP_K"
        return cls(
            corpus_version=os.environ.get("RAG_CORPUS_VERSION", "1"),
            embedding_model=os.environ.get("RAG_EMBEDDING_MODEL", cls.embedding_model),
            chat_model=os.environ.get("RAG_CHAT_MODEL", cls.chat_model),
            chunk_size=number("RAG_CHUNK_SIZE", 800, 1),
            chunk_overlap=number("RAG_CHUNK_OVERLAP", 200, 0),
            min_chunk_len=number("RAG_MIN_CHUNK_LEN", 80, 0),
            embed_batch=max(1, number("RAG_EMBED_BATCH_SIZE", 16)),
            embed_attempts=max(1, number("OPENAI_EMBED_RETRIES", 5)),
            raw_top_k=number("RAG_RAW_TOP_K", 10, 1),
            max_distance=number("RAG_MAX_DISTANCE", 0.44, 0, float),
            final_top_k=number(final, 5, 1),
            max_tokens=number("RAG_MAX_TOKENS", 1500, 1),
            temperature=number("RAG_TEMPERATURE", 0.3, 0, float),
        )
