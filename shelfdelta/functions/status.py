"""Task lifecycle rules as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfdelta.functions import fixed


def transition_allowed(current: Column, new: Column) -> Column:
    """Whether the fixed transition table lets ``current`` become ``new``."""
    pairs = [F.lit(f"{a}>{b}") for a, nexts in fixed.TRANSITIONS.items() for b in nexts]
    return F.concat(current, F.lit(">"), new).isin(*pairs)


def is_terminal(status: Column) -> Column:
    return status.isin(fixed.TERMINAL_STATUSES)


def is_known(status: Column) -> Column:
    return status.isin(fixed.TASK_STATUSES)


def duration_ms(started: Column, ended: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", started, ended).cast("bigint")


def stamps(new_status: Column, at: Column, queued: Column, started: Column,
           completed: Column) -> dict[str, Column]:
    """Lifecycle columns after moving to ``new_status`` at the moment ``at``."""
    done = is_terminal(new_status)
    return {
        "queued_at": F.when(new_status == "queued", at).otherwise(queued),
        "started_at": F.when(new_status == "started", at).otherwise(started),
        "completed_at": F.when(done, at).otherwise(completed),
        "duration_ms": F.when(done & started.isNotNull(), duration_ms(started, at)),
    }


def start_states() -> Column:
    """The identity of the transition fold: each status maps to itself."""
    return F.array(*[F.lit(s) for s in fixed.TASK_STATUSES])


def step(states: Column, message: Column) -> Column:
    """Advance every possible current status by one message; refused moves stay."""
    return F.transform(states, lambda s: F.when(transition_allowed(s, message), message).otherwise(s))


def chain(first: Column, then: Column) -> Column:
    """Compose two folds: run ``then`` from wherever ``first`` ended."""
    index = F.create_map(*[x for i, s in enumerate(fixed.TASK_STATUSES) for x in (F.lit(s), F.lit(i))])
    return F.transform(first, lambda s: F.get(then, F.element_at(index, s)))
