"""What becomes of rows that an operator can't work on, and timing of Python functions.

``fail`` stops the job. ``skip`` drops the row. ``mark`` keeps it with a message in ``_error``, so that a
quarantine and the good rows can be split off one DataFrame.
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "_error"
_policy: contextvars.ContextVar[str] = contextvars.ContextVar("policy", default="fail")


@contextlib.contextmanager
def on_error(policy: str) -> Iterator[None]:
    """The policy of operators applied within."""
    token = _policy.set(named(policy))
    try:
        yield
    finally:
        _policy.reset(token)


def named(policy: Any) -> str:
    """A policy by its name, or by :func:`warn_and_continue` or :func:`reraise`."""
    if policy in (warn_and_continue, "warn_and_continue"):
        return "skip"
    if policy in (reraise, "reraise"):
        return "fail"
    if policy not in ("fail", "skip", "mark"):
        raise ValueError("error policy: 'fail', 'skip' or 'mark'")
    return policy


def warn_and_continue(problem: BaseException | str) -> bool:
    """As a handler in driver code: warns and says to go on. As a policy: ``skip``."""
    import warnings

    warnings.warn(str(problem), stacklevel=2)
    return True


def reraise(problem: BaseException) -> bool:
    raise problem


def fail_if(df: DataFrame, bad: Column, message: str | Column) -> DataFrame:
    """Treats rows where ``bad`` is true by the policy in force."""
    bad, policy = F.coalesce(bad, F.lit(False)), _policy.get()
    message = F.lit(message) if isinstance(message, str) else message
    if policy == "skip":
        return df.filter(~bad)
    if policy == "mark":
        known = F.col(ERROR) if ERROR in df.columns else F.lit(None).cast("string")
        return df.withColumn(ERROR, F.coalesce(known, F.when(bad, message)))
    return df.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, without ``_error``, and the quarantine."""
    if ERROR not in df.columns:
        return df, df.limit(0).withColumn(ERROR, F.lit(None).cast("string"))
    return df.filter(F.col(ERROR).isNull()).drop(ERROR), df.filter(F.col(ERROR).isNotNull())


class CallTimeout(Exception):
    """A Python function took longer than allowed."""


def limited(fn: Callable[..., Any], seconds: float | None = None) -> Callable[..., Any]:
    """``fn``, given up after ``seconds`` (or SAMPLE_CALL_SECONDS of the environment). It isn't stopped, only left."""
    env = os.environ.get("SAMPLE_CALL_SECONDS", "")
    seconds = seconds if seconds is not None else float(env) if env else None
    if seconds is None:
        return fn

    def call(*args: Any, **how: Any) -> Any:
        out: dict[str, Any] = {}

        def work() -> None:
            try:
                out["value"] = fn(*args, **how)
            except BaseException as problem:
                out["problem"] = problem

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        thread.join(seconds)
        if thread.is_alive():
            raise CallTimeout(f"{getattr(fn, '__name__', fn)} took over {seconds} s")
        if "problem" in out:
            raise out["problem"]
        return out["value"]

    return call


def by_value(fn: Callable[[Any], Any], returns: str, seconds: float | None, name: str) -> Callable[[Column], Column]:
    """A Python function of one value as a Column function: a struct of value, error (a message, or null) and seconds.

    Values come in Arrow batches. A call is given up after ``seconds`` or what the driver's environment
    says (:func:`limited`); its error, as any other, is the row's own.
    """
    env = os.environ.get("SAMPLE_CALL_SECONDS", "")
    seconds = seconds if seconds is not None else float(env) if env else None

    @F.pandas_udf(f"value {returns}, error string, seconds double")
    def run(x: pd.Series) -> pd.DataFrame:
        values, problems, times = _called(fn, list(x), seconds)
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(problems, dtype=object), "seconds": pd.Series(times, dtype="float64")})

    # Else a filter on its errors would be moved before it, with the calls made there once more.
    return run.asNondeterministic()


class _Lane:
    """Calls of values one after another, by one thread, until it is through or left."""

    def __init__(self, fn: Callable[[Any], Any], values: list[Any]) -> None:
        self.fn, self.values, self.lock, self.through = fn, values, threading.Lock(), threading.Event()
        self.done: list[tuple[Any, str | None, float]] = []
        self.left, self.began = False, time.perf_counter()
        self.fatal: BaseException | None = None

    def work(self) -> None:
        try:
            for v in self.values:
                try:
                    row = (self.fn(v), None)
                except Exception as problem:
                    row = (None, f"{type(problem).__name__}: {problem}")
                with self.lock:
                    if self.left:
                        return
                    now = time.perf_counter()
                    self.done.append((*row, now - self.began))
                    self.began = now
        except BaseException as problem:  # no value's own error: it ends the task
            self.fatal = problem
        self.through.set()


def _called(fn: Callable[[Any], Any], values: list[Any], seconds: float | None) -> tuple[list, list, list]:
    """Values, errors and seconds of calls; one that takes over ``seconds`` is left as it is, and a new thread goes on behind it.

    So a thread is started for each call that is given up, not for each call.
    """
    out: list[tuple[Any, str | None, float]] = []
    while len(out) < len(values):
        lane = _Lane(fn, values[len(out) :])
        if seconds is None:
            lane.work()
        else:
            threading.Thread(target=lane.work, daemon=True).start()
            rest = seconds
            while not lane.through.wait(max(rest, 0)):
                with lane.lock:
                    rest = lane.began + seconds - time.perf_counter()
                    lane.left = rest <= 0 and len(lane.done) < len(lane.values)
                if lane.left:
                    name = getattr(fn, "__name__", fn)
                    lane.done.append((None, f"CallTimeout: {name} took over {seconds} s", seconds - rest))
                    break
        if lane.fatal:
            raise lane.fatal
        out += lane.done
    return tuple(map(list, zip(*out, strict=True))) or ([], [], [])


def profiled() -> bool:
    """Whether Python functions' seconds are kept as columns: SAMPLE_PROFILE of the driver's environment."""
    return bool(os.environ.get("SAMPLE_PROFILE"))
