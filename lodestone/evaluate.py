"""The evaluation command: `python -m lodestone.evaluate --dataset PATH`. Makes judge calls for every claim and fragment; run it by hand."""

from __future__ import annotations

import argparse
import sys
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from lodestone.operators.retrieval import Embedder
from lodestone.plans import judged
from lodestone.plans.answering import Chat
from lodestone.sources import config, corpus, remote, resolve
from lodestone.sources.index import Index, ensure_index


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="python -m lodestone.evaluate", description="Answer a question set from the configured corpus and let a judge model grade the answers. The judge is the application's own endpoint unless RAG_EVAL_JUDGE_* name another.")
    made.add_argument("--dataset", required=True, metavar="PATH", help='JSON file {"cases": [{"question": ..., "ground_truth": ...}]}')
    made.add_argument("--judge-model", metavar="NAME", help=f"judge model (default: {resolve.JUDGE_MODEL}, else {resolve.CHAT_MODEL})")
    made.add_argument("--run", metavar="NAME", help="name of the run; a run of that name that was interrupted goes on (default: a new one)")
    made.add_argument("--folder", metavar="PATH", help="where runs are kept (default: runtime/evaluation under the root)")
    made.add_argument("--concurrency", type=int, default=8, metavar="N", help="requests at a time (default: 8)")
    made.add_argument("--per-second", type=float, metavar="N", help="requests a second in all (default: no limit)")
    return made


def main(argv: list[str] | None = None, root: str | Path = ".", spark: SparkSession | None = None, chat: Chat | None = None, judge: Chat | None = None, provider: Embedder | None = None) -> int:
    """The whole command; models that are given take the place of those that the environment names."""
    args = parser().parse_args(argv)
    config.load_env(Path(root) / ".env")
    resolve.keep_private()
    try:
        config.load_questions(args.dataset)
        named = resolve.judge(args.judge_model)
        settings, profile = config.Settings.from_env(), resolve.profile(root)
        entries = resolve.corpus_entries(root)
        if chat is None:
            provider, chat = remote.providers(settings)
    except config.ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    name = args.run or uuid.uuid4().hex[:12]
    print(f"judge: {named}\nquestions, context, answers and reference answers are sent to that judge\nrun: {name}")
    spark = spark or SparkSession.builder.appName("lodestone-evaluate").getOrCreate()
    try:
        index = Index(spark, resolve.index_folder(root), resolve.collection_name())
        ensure_index(index, corpus.read_sources(spark, entries), settings, profile, provider)
        limits = remote.Limits(max(1, args.concurrency), args.per_second)
        folder = args.folder or str(Path(root).resolve() / "runtime" / "evaluation")
        found = judged.run_judged(spark, args.dataset, index, judge or remote.judge_chat(named), str(named), folder, name, settings, profile, provider, chat, limits)
        print(f"{found['name']}: {found['cases']} questions")
        print("\n".join(judged.report_lines(found)))
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}\nthe run can go on with --run {name}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
