"""A console for questions: `python -m lodestone.cli`. Words of its own: exit, stats, clear."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from lodestone.plans import answering
from lodestone.sources import config, corpus, remote, resolve
from lodestone.sources.cache import AnswerCache
from lodestone.sources.index import Index, ensure_index

LEAVE = {"exit", "quit", "q"}
YES = {"yes", "y", "да"}
HEADING_CHARS = 120


def shown_context(context: list, most: int = 0, chars: int = 220) -> list[str]:
    """Lines for the fragments of an answer: at most `most` of them (0: all), `chars` characters of each."""
    out = []
    for n, item in enumerate(context[: most or None], 1):
        meta = item["metadata"] or {}
        heading = (meta.get("section_heading") or "").strip()
        heading = heading if len(heading) <= HEADING_CHARS else f"{heading[:HEADING_CHARS]}…"
        name = f"[{meta['source_display']}]" if meta.get("source_display") else ""
        text = item["text"] if len(item["text"]) <= chars else f"{item['text'][:chars].rstrip()}…"
        out += [" ".join(filter(None, (f"{n}.", name, heading))), f"   {text}"]
    return out


def shown_answer(row) -> list[str]:
    if row.from_cache:
        origin = f"from the cache of {row.cached_at}"
    elif row.insufficient_basis:
        origin = "no fitting context; no model was asked"
    else:
        origin = f"by {row.model}"
    lines = [f"({origin})", row.answer]
    if row.context_docs:
        most, chars = config.number("RAG_CLI_CONTEXT_MAX_ITEMS", 0), config.number("RAG_CLI_CONTEXT_PREVIEW_CHARS", 220)
        lines += [f"context: {len(row.context_docs)} fragments", *shown_context(row.context_docs, max(0, most), chars)]
    return lines


def converse(lines: Iterable[str], ask: Callable[[str], list[str]], stats: Callable[[], dict], clear: Callable[[], None], say: Callable[[str], None] = print) -> None:
    """Answer line by line until one says goodbye; a failed question does not end the conversation."""
    given = iter(lines)
    for line in given:
        word = line.strip()
        if word.lower() in LEAVE:
            return
        try:
            if not word:
                say("please ask a question")
            elif word.lower() == "stats":
                say(str(stats()))
            elif word.lower() == "clear":
                say("clear the cache? (yes/no)")
                if next(given, "").strip().lower() in YES:
                    clear()
                    say("cleared")
            else:
                for text in ask(word):
                    say(text)
        except Exception as e:  # noqa: BLE001
            say(f"error: {e}")


def main(root: str | Path = ".", spark: SparkSession | None = None, lines: Iterable[str] | None = None, chat: answering.Chat | None = None) -> int:
    config.load_env(Path(root) / ".env")
    try:
        resolve.endpoint()
        settings, profile = config.Settings.from_env(), resolve.profile(root)
        entries = resolve.corpus_entries(root)
    except config.ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    provider = None
    if chat is None:
        provider, chat = remote.providers(settings)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    index = Index(spark, resolve.index_folder(root), resolve.collection_name())
    ensure_index(index, corpus.read_sources(spark, entries), settings, profile, provider)
    cache = AnswerCache(spark, Path(root).resolve() / "runtime" / "cache", answering.answer_fingerprint(index, settings, profile))

    def ask(question: str) -> list[str]:
        asked = spark.createDataFrame([(0, question)], "query_id long, query string")
        return shown_answer(answering.answer(asked, index, cache, settings, profile, provider, chat).first())

    converse(sys.stdin if lines is None else lines, ask, lambda: answering.stats(index, cache, settings), cache.clear)
    return 0


if __name__ == "__main__":
    sys.exit(main())
