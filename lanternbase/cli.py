"""Command line: index, search, chat."""

from __future__ import annotations

import argparse
import json
import sys
import time
import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from lanternbase.config import load
from lanternbase.functions.models import HashModel, HostedModel
from lanternbase.memory import Memory
from lanternbase.operators import conversation, prompt


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lanternbase")
    for name in ("config", "workspace", "base-url", "api-key", "chat-model", "embed-model"):
        p.add_argument(f"--{name}")
    p.add_argument("--local-embed", action="store_true")
    p.add_argument("--debug", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--force", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-l", "--limit", type=int, default=5)
    s.add_argument("--lexical-only", action="store_true")
    s.add_argument("--full", action="store_true")
    sub.add_parser("chat")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command; what it prints is also returned."""
    args = parser().parse_args(argv)
    flags = {k: getattr(args, k) for k in ("workspace", "base_url", "api_key", "chat_model", "embed_model", "debug")}
    config = load(flags, args.config)
    spark = spark or SparkSession.builder.appName("lanternbase").getOrCreate()
    hosted = HostedModel(config.base_url, config.api_key, config.chat_model, config.embed_model)
    memory = Memory(spark, config, HashModel() if args.local_embed else hosted)
    lines: list[str] = []
    if args.command == "index":
        lines.append("indexed: {indexed}  skipped: {skipped}  deleted: {deleted}".format(**memory.index(args.force)))
    elif args.command == "search":
        found = memory.search_keyword(args.query, args.limit) if args.lexical_only else memory.search(args.query, args.limit)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        shown = prompt.result_lines(found.withColumn("place", F.row_number().over(best)), args.full).orderBy("place")
        lines += [r["line"] for r in shown.collect()] or ["no results"]
    else:
        chat(memory, hosted, note=(lambda line: print(f"[debug] {line}", file=sys.stderr)) if config.debug else None)
    for line in lines:
        print(line)
    return lines


def chat(memory: Memory, model: HostedModel, ask=input, say=print, note=None) -> None:
    """Questions until the end of input; both turns are stored after each answer.

    ``note`` gets what ``--debug`` shows of a turn: chunks and their scores, the prompt, the request, seconds and the answer's id.
    """
    session, turn, turns, previous = str(uuid.uuid4()), 0, memory.history(), memory.last_response_id()
    say("Chat ready. Ctrl-D to exit.")
    while True:
        try:
            question = ask("> ").strip()
        except (EOFError, KeyboardInterrupt):
            return
        if not question:
            continue
        began = time.monotonic()
        chosen = memory.search_for_context(question)
        # a few rows, as many as a prompt takes, so that showing them does not search again
        rows = chosen.orderBy("place").collect()
        messages = conversation.messages(memory.prompt_with(memory.spark.createDataFrame(rows, chosen.schema)), turns, question)
        if note:
            note(f"retrieval {time.monotonic() - began:.2f} s, {len(rows)} chunks")
            for r in rows:
                note(f"  {r['score']:.3f} {r['path']}:{r['start_line']}-{r['end_line']}")
            for m in messages:
                note(f"{m['role']}: {m['content'][:300]}")
            note(f"request: {json.dumps(model.request(messages, previous), indent=1)}")
        sent = time.monotonic()
        answer, previous = model.respond(messages, previous)
        if note:
            note(f"answer {previous} of {len(answer.split())} words after {time.monotonic() - sent:.2f} s, whole turn {time.monotonic() - began:.2f} s")
        say(answer)
        memory.insert_turn(session, turn, "user", question)
        memory.insert_turn(session, turn + 1, "assistant", answer, previous)
        turn += 2
        turns += [("user", question), ("assistant", answer)]


if __name__ == "__main__":
    main()
