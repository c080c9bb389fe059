"""Prompt to answer by a client that the user supplies."""

from __future__ import annotations

import hashlib
import json
import math
import queue
import threading
import time
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sourcemine import schemas
from sourcemine.fixed_values import CLIENT_RETRIES

# A client takes a prompt and its settings and returns the texts of the choices.
Client = Callable[..., "list[str | None]"]
ClientFactory = Callable[[], Client]

FLUSH_ROWS = 64
TIMED_OUT = "TimeoutError"


def _checked(texts: list[str | None]) -> list[str | None]:
    """An answer that no table can hold is the fault of its call, not of the task."""
    for text in texts:
        if text is not None:
            str.encode(text)
    return texts


def _finished(
    rows: Iterator[dict], answered: Callable[[dict], dict], calls_in_flight: int, time_limit: float | None
) -> Iterator[dict]:
    """Rows with their answers as calls finish; a window of calls is under way.

    Each call has a thread of its own that nobody waits for: one that does not come
    back in ``time_limit`` seconds is given up, its row fails alone, and the next call
    takes its place in the window.  What it answers later is not looked at.
    """
    done: queue.SimpleQueue = queue.SimpleQueue()
    under_way: dict[int, tuple[dict, float]] = {}
    started = 0
    while True:
        while len(under_way) < calls_in_flight and (row := next(rows, None)) is not None:
            under_way[started] = row, time.monotonic() + (time_limit or math.inf)
            call = lambda number=started, row=dict(row): done.put((number, answered(row)))
            threading.Thread(target=call, daemon=True).start()
            started += 1
        if not under_way:
            return
        first = min(end for _, end in under_way.values())
        try:
            number, row = done.get(timeout=None if first == math.inf else max(0.0, first - time.monotonic()))
        except queue.Empty:
            now = time.monotonic()
            for number in [n for n, (_, end) in under_way.items() if end <= now]:
                row = under_way.pop(number)[0]
                row.pop("prompt")
                yield row | {"choices": None, "error": f"{TIMED_OUT}: no answer in {time_limit} s"}
            continue
        if under_way.pop(number, None) is not None:
            yield row


def _complete_batches(
    factory: ClientFactory, settings: dict, calls_in_flight: int, as_finished: bool, time_limit: float | None
):
    schema = to_arrow_schema(schemas.COMPLETIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()

        def answered(row: dict) -> dict:
            row["choices"], row["error"] = None, None
            try:
                texts = _checked(client(row.pop("prompt"), **settings))
                row["choices"] = [{"message": {"content": text}} for text in texts]
            except Exception as error:  # noqa: BLE001 - a candidate fails alone
                row["error"] = f"{type(error).__name__}: {error}"
            return row

        def answers() -> Iterator[dict]:
            # A call waits far longer than it computes, so a core may hold several.
            if calls_in_flight == 1 and time_limit is None:
                yield from (answered(row) for batch in batches for row in batch.to_pylist())
            elif as_finished:
                rows = (row for batch in batches for row in batch.to_pylist())
                yield from _finished(rows, answered, calls_in_flight, time_limit)
            else:
                for batch in batches:  # in the order of its rows, a batch at a time
                    rows = ({**row, "at": at} for at, row in enumerate(batch.to_pylist()))
                    found = list(_finished(rows, answered, calls_in_flight, time_limit))
                    yield from sorted(found, key=lambda row: row.pop("at"))

        done = []
        for row in answers():
            done.append(row)
            if len(done) == FLUSH_ROWS:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return run


def with_prompt_sha(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("prompt_sha", F.sha2("prompt", 256))


def call_settings(model: str, temperature: float, params: Mapping[str, str] | None) -> dict:
    """What a client is called with beside the prompt; ``params`` may not restate it."""
    fixed_ones = {"model": model, "temperature": temperature, "num_retries": CLIENT_RETRIES}
    clash = sorted(fixed_ones.keys() & (params or {}).keys())
    if clash:
        raise ValueError(f"params may not set {', '.join(clash)}")
    return {**fixed_ones, **(params or {})}


def with_request_sha(keyed: DataFrame, settings: dict) -> DataFrame:
    """Digest of all that decides an answer: the prompt and the call's settings."""
    told = json.dumps(settings, sort_keys=True, default=str)
    return keyed.withColumn("request_sha", F.sha2(F.concat_ws("\n", "prompt_sha", F.lit(told)), 256))


def complete(
    prompts: DataFrame,
    client_factory: ClientFactory,
    temperature: float,
    model: str = "",
    params: Mapping[str, str] | None = None,
    attempt: int = 1,
    calls_in_flight: int = 1,
    as_finished: bool = False,
    time_limit: float | None = None,
) -> DataFrame:
    """One answer per row; a client that raises gives a null answer and its message.

    The client is built once per partition and called from up to
    ``calls_in_flight`` threads there (with more than one it has to bear that).
    Rows come in their own order or, ``as_finished``, in that of the answers, where a
    slow call holds up nothing but itself.  A call that takes more than ``time_limit``
    seconds is given up and fails alone.
    Answers cost money and differ from call to
    call: write the result before reading it more than once.
    """
    settings = call_settings(model, temperature, params)
    keyed = prompts if "prompt_sha" in prompts.columns else with_prompt_sha(prompts)
    return (
        with_request_sha(keyed, settings)
        .withColumn("attempt", F.lit(attempt))
        .select("repo", "name", "prompt_sha", "request_sha", "attempt", "prompt")
        .mapInArrow(_complete_batches(client_factory, settings, calls_in_flight, as_finished, time_limit), schemas.COMPLETIONS)
    )


def offline_client() -> Client:
    """A client without a model: its answer is a pure function of the prompt."""

    def answer(prompt: str, **_settings) -> list[str | None]:
        digest = hashlib.sha256(prompt.encode()).hexdigest()
        if digest[0] == "0":
            raise ConnectionError("no route to the model")
        if digest[0] == "1":
            return []
        if digest[0] == "2":
            return [""]
        if digest[0] == "3":
            return [f"I cannot help with {digest}."]
        return [f"Here it is:\n```python\n\n# {digest}\n```\nDone.", "unused"]

    return answer


def steady_client() -> Client:
    """An offline client that answers every prompt and names its model."""

    def answer(prompt: str, model: str = "", **_settings) -> list[str | None]:
        return [f"```python\n# {model} {hashlib.sha256(prompt.encode()).hexdigest()}\n```"]

    return answer


def shaky_client() -> Client:
    """The same, but down for one prompt in four."""
    steady = steady_client()

    def answer(prompt: str, **settings) -> list[str | None]:
        if hashlib.sha256(prompt.encode()).hexdigest()[0] in "0123":
            raise ConnectionError("no route to the model")
        return steady(prompt, **settings)

    return answer
