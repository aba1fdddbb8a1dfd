"""The model step: a user callable over a request table, or a table of ready answers."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .requests import BROADCAST_CHARS, PARAMS, attach_context, context_chars

if TYPE_CHECKING:
    from ..sources.answers import AnswerLog

RESPONSES = "request_id string, text string, error string"
BASE_SETTINGS = ["temperature", "max_tokens", "stop"]
SETTINGS = list(PARAMS)

Client = Callable[..., str]


EMPTY_REPLY = "empty reply"


def _accepted(client: Client, settings: list[str]) -> list[str]:
    """The settings a client takes; one with ``**`` takes all."""
    try:
        known = inspect.signature(client).parameters.values()
    except (TypeError, ValueError):  # a callable that does not say
        return [s for s in settings if s in BASE_SETTINGS]
    if any(p.kind is p.VAR_KEYWORD for p in known):
        return settings
    return [s for s in settings if s in {p.name for p in known}]


def apply_model(
    requests: DataFrame,
    make_client: Callable[[], Client],
    partitions: int | None = None,
    contexts: DataFrame | None = None,
    log: AnswerLog | None = None,
) -> DataFrame:
    """Call a model once per request: (request_id, text, error).

    ``make_client`` runs once per task that has requests and returns
    ``client(messages, temperature, max_tokens, stop) -> text``; messages are
    ``{role, content}`` dicts. A client that has parameters ``token_field`` and
    ``reasoning_effort`` is told these as well; the first is the name under which the
    model takes its token limit. An exception becomes the ``error`` of its row and
    never fails the task, and no reply at all is the error ``empty reply``.
    ``partitions`` sets how many callers run at once.

    With ``contexts`` (seed, shots, messages) a request holds its ``query`` instead of
    messages: the few contexts go to each executor once. If they are too long for
    that, which is checked, they are joined to the requests.

    With ``log`` a task writes its answers ahead, a few calls at a time. Tried again, it
    hands on those in its log and calls the model for the rest only.

    A model may answer differently when called again: write the result to a
    stage table and go on from there (see ``plans.run.Run.answers``).
    """
    settings = [c for c in SETTINGS if c in requests.columns]
    shared = None
    if contexts is not None:
        if context_chars(contexts) <= BROADCAST_CHARS:
            rows = contexts.select("seed", "shots", "messages").collect()
            told = {(r["seed"], r["shots"]): [m.asDict() for m in r["messages"]] for r in rows}
            shared = requests.sparkSession.sparkContext.broadcast(told)
        else:
            requests = attach_context(requests, contexts)
    said = ["messages"] if shared is None else ["seed", "shots", "query"]
    slim = requests.select("request_id", *said, *settings)
    if partitions is not None:
        slim = slim.repartition(partitions)

    def ask(client: Client, passed: list[str], row: dict) -> tuple[str | None, str | None]:
        if shared is None:
            messages = [{"role": m["role"], "content": m["content"]} for m in row["messages"]]
        else:
            context = shared.value[row["seed"], row["shots"]]
            messages = [*map(dict, context), {"role": "user", "content": row["query"]}]
        options = {k: row[k] for k in passed}
        if options.get("stop") is not None:
            options["stop"] = list(options["stop"])
        try:
            text = client(messages, **options)
        except Exception as failure:  # the row carries the failure
            return None, f"{type(failure).__name__}: {failure}"
        return text, EMPTY_REPLY if text is None else None

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        written = None if log is None else log.of_task(TaskContext.get().partitionId())
        client, passed, known = None, [], set()
        for answered in written.earlier() if written else ():
            known.update(answered.column("request_id").to_pylist())
            yield answered.to_pandas()
        try:
            for batch in batches:
                rows = []
                for row in batch.to_dict("records"):
                    if row["request_id"] in known:
                        continue
                    if client is None:
                        client = make_client()
                        passed = _accepted(client, settings)
                    answer = (row["request_id"], *ask(client, passed, row))
                    rows.append(answer)
                    if written:
                        written.add(*answer)
                yield pd.DataFrame(rows, columns=["request_id", "text", "error"])
        finally:
            if written:
                written.flush()

    return slim.mapInPandas(call, RESPONSES)


def join_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their answers from a batch-inference table.

    A request without an answer carries the error ``no response``, an answer
    without a text the error ``empty reply``.
    """
    answers = responses.select("request_id", "text", "error", F.lit(True).alias("_seen"))
    joined = requests.join(answers, "request_id", "left")
    missing = F.when(F.col("_seen").isNull(), F.lit("no response")).when(
        F.col("text").isNull(), F.lit(EMPTY_REPLY)
    )
    return joined.withColumn("error", F.coalesce("error", missing)).drop("_seen")
