"""Request budgets: token buckets in exact integers, and the fair order of those who wait.

A bucket's level is a pure function of the level before, the time that passed and the policy, in token-milliseconds: a
token is ``per_ms`` of them and each millisecond brings ``requests``. ``folds.token_bucket`` is the same over columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from tidemark.errors import BudgetTimeout, ConfigError

#: Lanes in the order in which they are served.
LANES = {"live": 0, "reconcile": 1, "backfill": 2, "replay": 3}


@dataclass(frozen=True)
class Policy:
    requests: int
    per_ms: int
    burst: int

    def __post_init__(self) -> None:
        if min(self.requests, self.per_ms, self.burst) < 1:
            raise ConfigError("a budget needs requests, per_ms and burst of 1 or more")


class Level(NamedTuple):
    amount: int
    at: int


def level(before: Level | None, now: int, policy: Policy, room: int) -> Level:
    """A new bucket holds a full burst. Time that runs back brings nothing and isn't taken over."""
    if before is None:
        before = Level(policy.burst * policy.per_ms, now)
    passed = max(0, now - before.at)
    return Level(min(room * policy.per_ms, before.amount + passed * policy.requests), before.at + passed)


@dataclass
class Buckets:
    levels: dict[str, Level] = field(default_factory=dict)

    def take(self, name: str, cost: int, policy: Policy, now: int) -> int:
        """0 if the cost was paid, else the milliseconds after which it may be. A cost above the burst may be saved up for."""
        price = max(cost, 0) * policy.per_ms
        have = level(self.levels.get(name), now, policy, max(policy.burst, cost))
        paid = price <= have.amount
        self.levels[name] = have._replace(amount=have.amount - price * paid)
        return 0 if paid else -(-(price - have.amount) // policy.requests)

    def peek(self, name: str, policy: Policy, now: int) -> float:
        return level(self.levels.get(name), now, policy, policy.burst).amount / policy.per_ms


@dataclass
class Waiting:
    who: str
    lane: str
    weight: float
    cost: int
    deadline: int | None
    seq: int


@dataclass
class Account:
    """What one asker had of a budget: cost by weight, and when last."""

    share: float
    turn: int = 0


@dataclass
class Queue:
    policy: Policy
    waiting: list[Waiting] = field(default_factory=list)
    accounts: dict[str, Account] = field(default_factory=dict)

    def rank(self, w: Waiting) -> tuple:
        mine = self.accounts[w.who]
        return LANES[w.lane], mine.share, mine.turn, w.seq


class Manager:
    """A queue per budget. ``advance`` serves whoever may be served at a time; only ``acquire`` sleeps, as it is told."""

    def __init__(self, policies: dict[str, Policy], buckets: Buckets | None = None):
        self.buckets = buckets or Buckets()
        self.queues = {name: Queue(policy) for name, policy in policies.items()}
        self.turns = 0

    def _queue(self, name: str) -> Queue:
        if name not in self.queues:
            raise ConfigError(f"there is no budget {name!r}")
        return self.queues[name]

    def _turn(self) -> int:
        self.turns += 1
        return self.turns

    def ask(self, name: str, who: str, lane: str = "live", weight: float = 1.0, cost: int = 1, deadline: int | None = None) -> Waiting:
        """Newcomers begin with the least share of the others, so they don't catch up on what they missed."""
        queue = self._queue(name)
        if who not in queue.accounts:
            queue.accounts[who] = Account(min((a.share for a in queue.accounts.values()), default=0.0))
        queue.waiting.append(Waiting(who, lane, weight, cost, deadline, self._turn()))
        return queue.waiting[-1]

    def order(self, name: str) -> list[Waiting]:
        """Lane, then least served by weight, then least recently served, then first come."""
        queue = self._queue(name)
        return sorted(queue.waiting, key=queue.rank)

    def leave(self, name: str, w: Waiting) -> None:
        """An asker that gives up."""
        queue = self._queue(name)
        queue.waiting = [x for x in queue.waiting if x is not w]

    def _served(self, name: str, now: int) -> Iterator[Waiting | int]:
        """Each one that is served, and at the end, if others wait, for how long."""
        queue = self._queue(name)
        while queue.waiting:
            w = min(queue.waiting, key=queue.rank)
            wait = self.buckets.take(name, w.cost, queue.policy, now)
            if wait:
                yield wait
                return
            self.leave(name, w)
            account = queue.accounts[w.who]
            account.share += w.cost / w.weight
            account.turn = self._turn()
            yield w

    def advance(self, name: str, now: int) -> tuple[list[Waiting], int | None]:
        """Who is served now, and when to come again. Deadlines that have passed raise for their askers."""
        late = [w for w in self._queue(name).waiting if w.deadline is not None and w.deadline < now]
        for w in late:
            self.leave(name, w)
        if late:
            raise BudgetTimeout("a request waited too long for its budget", waiting=late)
        got = list(self._served(name, now))
        wait = got.pop() if got and isinstance(got[-1], int) else None
        return got, None if wait is None else now + wait

    def acquire(self, name: str, clock: Callable[[], int], sleep: Callable[[int], None], **asked: object) -> int:
        """Wait for one's turn; how many milliseconds it took. Whoever else is served meanwhile has been told by ``advance``."""
        began = clock()
        w = self.ask(name, **asked)
        try:
            while True:
                now = clock()
                served, again = self.advance(name, now)
                if any(x is w for x in served):
                    return now - began
                sleep(max(1, (again or now + 1) - now))
        finally:
            self.leave(name, w)
