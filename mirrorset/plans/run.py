"""A run: where its stage tables live and how its model is called."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators.model import Client, apply_model, join_responses
from ..operators.order import beside, earlier, numbered
from ..operators.requests import PARAMS, content_ids, request_params
from ..operators.runcontrol import longest_reply, pending, prompt_words, said_tokens, stop_on_failures, streak_after, within_budget
from ..sources import stages
from ..sources.answers import AnswerStore


# Calls of the first window of a stage that stops on failures, and of a window at most. Each one is
# as long as all before it, so calls past a stop are no more than those before it.
FIRST_WINDOW = 128
LARGEST_WINDOW = 65_536

# Requests and their stage to (request_id, text, error) rows. Scoring requests hold a query in
# place of messages, and the contexts (seed, shots, messages) come as a third argument.
Responder = Callable[..., DataFrame]


@dataclass(frozen=True)
class ClientResponder:
    """Answer requests by a Python callable, ``partitions`` callers at a time.

    Its tasks log their answers as they come, see ``sources.answers``.
    """

    make_client: Callable[[], Client]
    partitions: int | None = None
    flush_calls: int = 50
    flush_seconds: float = 10.0

    def __call__(self, requests: DataFrame, stage: str, contexts: DataFrame | None = None, store: AnswerStore | None = None) -> DataFrame:
        log = store.log(self.flush_calls, self.flush_seconds) if store else None
        return apply_model(requests, self.make_client, self.partitions, contexts, log)


def client_responder(make_client: Callable[[], Client], partitions: int | None = None) -> Responder:
    return ClientResponder(make_client, partitions)


@dataclass(frozen=True)
class Run:
    """Stage tables under ``root``, keyed by seed, model and data set.

    ``respond`` is the model step: :func:`client_responder`, or any function that
    looks answers up, such as in the result table of a batch-inference job.
    ``chunks`` cuts each model step into that many jobs of even size, so that a
    run whose responder keeps no log has the answers of the jobs before when it dies.
    ``buckets`` is how many buckets new answer stores have, by default as many as shuffles have partitions.
    """

    spark: SparkSession
    root: str
    model: str
    dataset: str
    respond: Responder
    seed: int = 42
    attempt: int = 0
    chunks: int = 1
    buckets: int | None = None

    def save(self, df: DataFrame, stage: str) -> DataFrame:
        """Write a stage and read it back, so later steps never recompute it."""
        stages.write_stage(df, self.root, stage, self.seed, self.model, self.dataset)
        return self.load(stage)

    def load(self, stage: str) -> DataFrame:
        return stages.read_stage(self.spark, self.root, stage, self.seed, self.model, self.dataset)

    def has(self, stage: str) -> bool:
        return stages.has_stage(self.spark, self.root, stage, self.seed, self.model, self.dataset)

    def drop(self, stage: str) -> None:
        """Delete a stage that nothing reads any more."""
        stages.drop_stage(self.spark, self.root, stage, self.seed, self.model, self.dataset)

    def store(self, stage: str) -> AnswerStore:
        """The stored answers of a stage."""
        name = f"answers_{stage}_{self.seed}_{stages.slug_name(self.model)}_{stages.slug_name(self.dataset)}"
        return AnswerStore(self.spark, f"{self.root.rstrip('/')}/{name}", self.buckets)

    def _keyed(self, requests: DataFrame, stage: str) -> DataFrame:
        return content_ids(request_params(requests, stage, self.model))

    def _ids(self, keyed: DataFrame, stage: str, *kept: str) -> DataFrame:
        """Request ids and few columns beside them: what looks for answers moves these, and no texts."""
        return self.save(keyed.select(*kept, "request_id"), f"ids_{stage}")

    def _todo(
        self, keyed: DataFrame, store: AnswerStore, retry_failed: bool, stage: str = "", ids: DataFrame | None = None, example: str = "ord"
    ) -> DataFrame:
        """Requests without an answer; what tasks of a lost run have logged counts as answered."""
        store.recover(self.attempt)
        if not store.exists():
            return keyed
        if ids is None:
            return pending(keyed, store.read(), retry_failed)
        left = self.save(pending(ids.select(example, "request_id").distinct(), store.read(), retry_failed), f"pending_{stage}")
        if not left.take(1):
            return keyed.limit(0)
        known = ids.join(store.read().select("request_id"), "request_id", "left_semi")
        if not retry_failed and not known.take(1):
            return keyed
        return beside(keyed, left, [example, "request_id"], example, inner=True)

    def _ask(self, asked: DataFrame, stage: str, store: AnswerStore, *told: DataFrame) -> DataFrame:
        logged = {"store": store} if isinstance(self.respond, ClientResponder) else {}
        return self.respond(asked, stage, *told, **logged)

    def _stored(self, asked: DataFrame, store: AnswerStore) -> None:
        """Add answers to the store; then the log of the tasks that gave them is no longer needed."""
        store.append(asked, self.attempt)
        store.drop_log()

    def _joined(self, keyed: DataFrame, store: AnswerStore, ids: DataFrame | None = None, example: str = "ord") -> DataFrame:
        """Requests with their answers; with ``ids`` answers go to the texts, and rows of an example lie side by side."""
        store.compact()
        asked = keyed.drop("messages", *PARAMS)
        if ids is None:
            return join_responses(asked, store.read())
        said = join_responses(ids.select(example, "request_id").distinct(), store.read())
        return beside(asked, said, [example, "request_id"], example, inner=True)

    def answers(
        self,
        requests: DataFrame,
        stage: str,
        retry_failed: bool = False,
        contexts: DataFrame | None = None,
        example: str | None = None,
        texts: bool = True,
    ) -> DataFrame:
        """Requests with stored answers; only requests without one reach the model.

        Ids depend on the messages and settings, so answers to other texts or prompts
        are never taken. The answers are added to the stage's store and read back
        from it, so a run that was cut short goes on where the store ends.

        Where an example has many requests, ``example`` is the column that tells them apart: answers are looked for by
        ids alone then, and the rows of an example come out side by side. ``texts`` says whether requests hold texts
        besides their messages; without, they are written once with their ids and not made again.
        """
        keyed, store, ids = self._keyed(requests, stage), self.store(stage), None
        if example is not None:
            kept = [example] if texts else [c for c in keyed.columns if c not in ("request_id", "messages", *PARAMS)]
            ids = self._ids(keyed, stage, *kept)
        asked = self._todo(keyed, store, retry_failed, stage, ids, example)
        told = () if contexts is None else (contexts,)
        chunk = F.pmod(F.xxhash64("request_id"), F.lit(self.chunks))
        for number in range(self.chunks):
            part = asked if self.chunks == 1 else asked.filter(chunk == number)
            self._stored(self._ask(part, stage, store, *told), store)
        if ids is not None and not texts:
            return self._joined(ids, store)
        return self._joined(keyed, store, ids, example)

    def answers_until(
        self, requests: DataFrame, stage: str, max_consecutive: int, place: str, retry_failed: bool = False, example: str = "ord"
    ) -> DataFrame:
        """Like :meth:`answers`, in order of ``place`` (dense, from 0), until calls fail too often in a row.

        Requests go out in windows of the order, each as long as all before it; they should be rows of a table that
        lie in that order, as each window reads its own. The failures in a row at
        the end of a window are carried to the next one, so each answer is looked at once. The stage stops
        at the ``max_consecutive``-th failure in a row of this run, or at a quota error: that call and later
        ones are not stored, so the next run asks them again and goes on. As a caller does that is started
        again, a run counts from none. Only rows with a stored answer are returned.
        """
        keyed, store = self._keyed(requests, stage), self.store(stage)
        ids = self._ids(keyed, stage, place, example)
        todo = self._todo(ids.select(place, "request_id"), store, retry_failed)
        # numbered anew: places of this run's calls alone, so that a streak has no gaps
        numbers = self.save(numbered(todo.select(place, "request_id"), [place], "_call"), f"calls_{stage}")
        calls, streak, start = numbers.count(), 0, 0
        size = FIRST_WINDOW
        while start < calls:
            # a window has 65,536 rows at most, of which only numbers and ids are sent around
            now = F.broadcast(numbers.filter(F.col("_call").between(start, start + size - 1)))
            low, high, n = now.agg(F.min(place), F.max(place), F.count(F.lit(1))).first()
            window = keyed.filter(F.col(place).between(low, high))
            if high - low + 1 > n:
                window = window.join(now.select(place), place, "left_semi")
            said = self._ask(window.drop(place), stage, store).join(now.select("request_id", "_call"), "request_id")
            said = self.save(said, f"said_{stage}")
            kept = stop_on_failures(said, max_consecutive, "_call", carried=streak)
            self._stored(kept, store)
            if kept.count() < min(size, calls - start):
                break
            streak = streak_after(said, "_call", streak)
            start += size
            size = min(start, LARGEST_WINDOW)
        for held in ("calls", "said"):
            self.drop(f"{held}_{stage}")
        if not store.exists():
            return self._joined(keyed.limit(0), store)
        return self._answered(keyed, stage, store, ids, place, example)

    def _answered(self, keyed: DataFrame, stage: str, store: AnswerStore, ids: DataFrame, order: str, example: str) -> DataFrame:
        """Rows with a stored answer; what lies past the last of them in the order is not read."""
        known = ids.join(store.read().select("request_id"), "request_id", "left_semi")
        low, high = known.agg(F.min(order), F.max(order)).first()
        return self._joined(keyed.filter(F.col(order).between(low, high)) if low is not None else keyed.limit(0), store, known, example)

    def answers_within(
        self, requests: DataFrame, stage: str, limit: int, example: str = "ord", retry_failed: bool = False
    ) -> DataFrame:
        """Like :meth:`answers`, example by example in order, until prompts and replies cost more than ``limit``.

        An example is asked, with all its requests, if the calls of this run before it cost ``limit`` tokens at
        most; failed calls cost nothing. Replies are known only afterwards, so examples go out in waves: those
        that the budget reaches if every reply has the greatest length that the settings allow, or later twice
        that of the longest reply so far. The tokens that a wave really took are carried to the next one, and
        waves shrink as the budget does. Should replies outgrow a wave, examples past the limit are left out
        here; their answers are stored, so the next run takes them without another call. Only rows with
        a stored answer are returned.
        """
        keyed, store = self._keyed(requests, stage), self.store(stage)
        words, open_ = prompt_words(F.col("messages"))
        ids = self._ids(keyed.withColumns({"_words": words, "_open": open_}), stage, example, "max_tokens", "_words", "_open")
        todo = self._todo(ids, store, retry_failed)
        todo = todo if todo is ids else self.save(todo, f"pending_{stage}")
        prompt, reply = said_tokens(F.col("_words"), F.col("_open"), F.lit("")), token_estimate(F.coalesce("text", F.lit("")))
        each = todo.groupBy(example).agg(
            F.sum(prompt).alias("tokens"), F.count(F.lit(1)).alias("calls"), F.max(longest_reply(F.col("max_tokens"))).alias("longest")
        )
        sums = {f"{c}_before": ("sum", F.col(c)) for c in ("tokens", "calls")}
        costs = self.save(earlier(each, example, sums).na.fill(0), f"costs_{stage}")
        longest = costs.agg(F.max("longest")).first()[0] or 0
        spent, asked_until, tokens, calls, beyond = 0, None, 0, 0, None
        while spent <= limit:
            left = costs if asked_until is None else costs.filter(F.col(example) > asked_until)
            most = F.col("tokens_before") - tokens + (F.col("calls_before") - calls) * longest
            after = F.max(F.struct(example, F.col("tokens_before") + F.col("tokens"), F.col("calls_before") + F.col("calls")))
            reached = left.filter(most <= limit - spent).agg(after.alias("v")).first()["v"]
            if reached is None:
                break
            new = F.col(example) <= reached[0]
            new = new if asked_until is None else new & (F.col(example) > asked_until)
            wave, mine = keyed.filter(new), todo.filter(new)
            if todo is not ids and mine.count() < ids.filter(new).count():
                some = mine.select(example, "request_id").distinct()
                wave = beside(wave, some, [example, "request_id"], example, inner=True)
            said = self.save(self._ask(wave, stage, store), f"said_{stage}")
            self._stored(said, store)
            # prompts are known by their words, so no message meets its reply
            paid = mine.join(said.filter("error IS NULL").select("request_id", "text"), "request_id").select(
                example, said_tokens(F.col("_words"), F.col("_open"), F.col("text")).alias("tokens"), reply.alias("reply")
            )
            took, reply_most = paid.agg(F.sum("tokens"), F.max("reply")).first()
            if spent + (took or 0) > limit:
                past = within_budget(paid, limit=limit - spent, example=example).agg(F.max(example)).first()[0]
                beyond = mine.filter(F.col(example) > past).select("request_id")
            spent += took or 0
            longest = min(longest, 2 * (reply_most or 0) + 8)
            asked_until, tokens, calls = reached
        if not store.exists():
            return self._joined(keyed.limit(0), store)
        if beyond is not None:
            ids = ids.join(beyond, "request_id", "left_anti")
        return self._answered(keyed, stage, store, ids, example, example)
