"""Batches of questions answered from an index: cache, retrieval, selection, gate, prompt, model, cache."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import identity as I
from lodestone.functions import prompt as P
from lodestone.functions import text as T
from lodestone.operators import retrieval as R
from lodestone.sources.cache import CONTEXT, AnswerCache
from lodestone.sources.config import Profile, Settings
from lodestone.sources.index import Index
from lodestone.sources.storage import written


class Chat(Protocol):
    def complete(self, system: str, prompt: str) -> str | None: ...


class OfflineChat:
    def complete(self, system: str, prompt: str) -> str | None:
        return "No model is connected."


def generate(prompts: DataFrame, chat: Chat, system: str, concurrency: int | None = None) -> DataFrame:
    """prompts(query_id, prompt) with answer; a blank completion is an error. At most `concurrency` tasks ask at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = [(chat.complete(system, p) or "").strip() for p in part["prompt"]]
            if not all(answers):
                raise R.ProviderError("the model gave an empty answer; the token limit may be too low")
            yield pd.DataFrame({"query_id": part["query_id"], "answer": answers})

    asked = prompts.select("query_id", "prompt")
    return (asked.repartition(concurrency, "query_id") if concurrency else asked).mapInPandas(run, "query_id long, answer string")


def answer_fingerprint(index: Index, settings: Settings, profile: Profile) -> str:
    built = {k: v for k, v in (index.manifest() or {}).items() if k not in ("state", "chunk_count")}
    same = ("chat_model", "max_tokens", "temperature", "raw_top_k", "max_distance", "final_top_k")
    return I.fingerprint(I.AnswerIdentity(index=built, chat_endpoint=I.endpoint_identity(settings.chat_endpoint), system_prompt_extra=profile.system_prompt_extra, **{k: getattr(settings, k) for k in same}).values())


RESULT = f"query_id long, query string, answer string, from_cache boolean, context_docs {CONTEXT}, cached_at timestamp, model string, mode string, insufficient_basis boolean"


def answer(questions: DataFrame, index: Index, cache: AnswerCache | None = None, settings: Settings = Settings(), profile: Profile = Profile(), provider: R.Embedder | None = None, chat: Chat | None = None, concurrency: int | None = None) -> DataFrame:
    """A row of RESULT for each of questions(query_id, query).

    Cache hits skip all that follows and carry no model, mode or distances. Questions without context get the fixed answer, no model call and
    no cache row. The others' answers are stored.
    """
    asked = questions.select("query_id", "query")
    looked = cache.lookup(asked) if cache else asked.withColumn("query_hash", F.lit("")).withColumns({"cached_answer": F.lit(None).cast("string"), "cached_context": F.lit(None).cast(CONTEXT), "cached_at": F.lit(None).cast("timestamp")})
    looked = written(looked, "looked-up")
    hits = looked.where("cached_answer is not null").select("query_id", "query", F.col("cached_answer").alias("answer"), F.lit(True).alias("from_cache"), F.col("cached_context").alias("context_docs"), "cached_at", F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("boolean").alias("insufficient_basis"))
    misses = looked.where("cached_answer is null").select("query_id", "query")
    chunks = index.chunks()
    found = R.top_k(R.embed(misses, provider or R.ShaEmbedder(), "query", settings.embed_batch, settings.embed_attempts), chunks, settings.raw_top_k)
    selected = written(R.select_context(found.join(chunks.drop("embedding"), "id_num"), settings.max_distance, settings.final_top_k), "selected")
    meta = F.map_filter(F.create_map(*(x for c in ("source", "source_display", "source_kind", "doc_type", "section_heading", "header_len") for x in (F.lit(c), F.col(c).cast("string")))), lambda k, v: v.isNotNull())
    docs = selected.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "text", F.to_json(meta).alias("metadata"), "id"))), lambda x: F.struct(x["text"].alias("text"), F.from_json(x["metadata"], "map<string,string>").alias("metadata"), x["id"].alias("id"))).alias("context_docs"))
    with_context = misses.join(R.context_block(selected), "query_id").join(docs, "query_id")
    prompts = with_context.withColumn("prompt", P.user_prompt(F.col("query"), F.col("context")))
    made = with_context.join(generate(prompts, chat or OfflineChat(), P.system_prompt(profile.system_prompt_extra), concurrency), "query_id")
    answered = written(made.select(
        "query_id", "query", "answer", F.lit(False).alias("from_cache"), "context_docs", F.lit(None).cast("timestamp").alias("cached_at"), F.lit(settings.chat_model).alias("model"), F.lit("generated").alias("mode"), F.lit(False).alias("insufficient_basis")
    ), "answers")
    refused = misses.join(with_context.select("query_id"), "query_id", "left_anti").select("query_id", "query", T.no_basis_answer(F.col("query")).alias("answer"), F.lit(False).alias("from_cache"), F.array().cast(CONTEXT).alias("context_docs"), F.lit(None).cast("timestamp").alias("cached_at"), F.lit(None).cast("string").alias("model"), F.lit("no_context").alias("mode"), F.lit(True).alias("insufficient_basis"))
    if cache:
        cache.store(answered.select("query", "answer", F.col("context_docs").alias("context")))
    return hits.unionByName(answered).unionByName(refused)


def stats(index: Index, cache: AnswerCache | None, settings: Settings) -> dict:
    return {"index": index.stats(), "cache": cache.stats() if cache else None, "raw_top_k": settings.raw_top_k, "max_distance": settings.max_distance, "final_top_k": settings.final_top_k}
