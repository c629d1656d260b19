"""Commands by type, with interceptors around their handlers, and the outcomes that audit rows are made of."""

from __future__ import annotations

import datetime
import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

LOG = logging.getLogger(__name__)

#: Why a handler did not run.
VETOED, REPLAY = "VETOED", "IDEMPOTENT_REPLAY"


@dataclass(frozen=True)
class Result:
    """events that a command gave, or, where its handler did not run, the reason and the interceptor that stopped it."""

    events: tuple = ()
    reason: str | None = None
    stopped_by: str | None = None


@dataclass(frozen=True)
class Context:
    command: Any
    command_type: str
    command_id: str
    aggregate_type: str | None
    aggregate_id: str | None
    at: datetime.datetime
    result: Result | None = None


class Interceptor:
    def before(self, context: Context) -> bool:
        """False stops the command."""
        return True

    def after(self, context: Context) -> None:
        """The outcome is known: done, stopped by a later interceptor, or done before."""

    def on_error(self, context: Context, error: BaseException) -> None:
        """The handler, or before() of a later interceptor, has failed."""


@dataclass
class CommandBus:
    """Handlers by the exact class of the command. before() is called in the order of the interceptors; those whose before() went through
    hear of the outcome, the last of them first, and what they raise then is logged and changes nothing."""

    interceptors: list[Interceptor] = field(default_factory=list)
    handlers: dict[type, tuple[str, Callable[[Any], str], Callable[[Any], tuple]]] = field(default_factory=dict)
    inbox: dict[str, tuple[type, str, Result]] = field(default_factory=dict)

    def register(self, kind: type, aggregate_type: str, ident: Callable[[Any], str], handler: Callable[[Any], tuple]) -> None:
        if kind in self.handlers:
            raise ValueError(f"{kind.__name__} has a handler")
        self.handlers[kind] = (aggregate_type, ident, handler)

    def execute(self, command: Any, key: str | None = None) -> Result:
        """With a key a command is done once; a second call gives the first one's events."""
        kind = type(command)
        if kind not in self.handlers:
            raise ValueError(f"no handler for {kind.__name__}")
        aggregate_type, ident, handler = self.handlers[kind]
        target = ident(command)
        if target is None:
            raise ValueError(f"{kind.__name__} has no aggregate id")
        context = Context(command, kind.__name__, str(uuid.uuid4()), aggregate_type, target, datetime.datetime.now(datetime.timezone.utc))
        passed: list[Interceptor] = []
        try:
            for each in self.interceptors:
                if not each.before(context):
                    result = Result((), VETOED, type(each).__name__)
                    break
                passed.append(each)
            else:
                result = self._replayed(kind, target, key) or Result(tuple(handler(command)))
                if key is not None and result.reason is None:
                    self.inbox[key] = (kind, target, result)
        except BaseException as error:
            self._tell(passed, lambda each: each.on_error(context, error))
            raise
        told = replace(context, result=result)
        self._tell(passed, lambda each: each.after(told))
        return result

    def _replayed(self, kind: type, target: str, key: str | None) -> Result | None:
        if key is None or key not in self.inbox:
            return None
        first, of, result = self.inbox[key]
        if (first, of) != (kind, target):
            raise ValueError(f"the key {key} belongs to another command")
        return replace(result, reason=REPLAY)

    @staticmethod
    def _tell(passed: list[Interceptor], call: Callable[[Interceptor], None]) -> None:
        for each in reversed(passed):
            try:
                call(each)
            except Exception:
                LOG.exception("%s failed after a command", type(each).__name__)


class Audit(Interceptor):
    """Gathers the outcomes of commands as rows (OUTCOMES) for audit.command_rows."""

    OUTCOMES = "command_id string, command_type string, aggregate_type string, aggregate_id string, user_id string, occurred_at timestamp, vetoed boolean, error string, n_events int"

    def __init__(self, user: Callable[[], str | None] = lambda: None):
        self.user, self.rows = user, []

    def _row(self, c: Context, vetoed: bool, error: str | None, n: int) -> None:
        self.rows.append((c.command_id, c.command_type, c.aggregate_type, c.aggregate_id, self.user(), c.at, vetoed, error, n))

    def after(self, context: Context) -> None:
        self._row(context, context.result.reason == VETOED, None, len(context.result.events))

    def on_error(self, context: Context, error: BaseException) -> None:
        self._row(context, False, str(error) or type(error).__name__, 0)
