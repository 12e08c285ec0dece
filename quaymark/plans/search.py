"""Full evaluation in one job, and the budgeted search for the best and the worst format."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.operators.scoring import accuracy, scored


def evaluate_all(prompts: DataFrame, *by: str) -> DataFrame:
    """Accuracy of every node over the rows of ``prompts`` (generation, answer, output_classes)."""
    return accuracy(scored(prompts), *by)


@dataclass
class Arms:
    """What playing each arm gives: per batch the rows that were right and the rows, and the sums over all rows."""

    nodes: list[str]
    batch: int
    right: list[np.ndarray]
    size: list[np.ndarray]
    total_right: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, nodes: list[str], grid, batch: int) -> "Arms":
        """From a row of outcomes for each arm; the rows may differ in length."""
        rows = [np.asarray(r, np.int64) for r in grid]
        starts = [np.arange(0, len(r), batch) for r in rows]
        right = [np.add.reduceat(r, at) if len(r) else np.zeros(0, np.int64) for r, at in zip(rows, starts, strict=True)]
        size = [np.minimum(batch, len(r) - at) for r, at in zip(rows, starts, strict=True)]
        return cls(nodes, batch, right, size, np.array([r.sum() for r in rows], np.int64), np.array([len(r) for r in rows], np.int64))


def outcomes(log: DataFrame, batch: int, steps: int) -> Arms:
    """The arms of a log that holds the answer of every node to its rows (``eval_pos``: from 0, per node).

    Rows are summed by batch in Spark. No arm is played more often than there are steps, so all that comes to the
    driver is a number for each of the first ``steps`` batches of each node, and the node's sums over all of its
    rows, however many these are. A row that is there twice counts once.
    """
    rows = (log if "is_right" in log.columns else scored(log)).groupBy("node_id", "eval_pos").agg(F.max(F.col("is_right").cast("bigint")).alias("hit"))
    number = F.floor(F.col("eval_pos") / batch)
    by = F.when(number < steps, number).otherwise(F.lit(steps)).cast("bigint").alias("b")
    found = rows.groupBy("node_id", by).agg(F.sum("hit").alias("hits"), F.count("*").alias("n")).orderBy("node_id", "b").toArrow().to_pandas()
    arms = Arms([], batch, [], [], np.zeros(0, np.int64), np.zeros(0, np.int64))
    totals = []
    for node, mine in found.groupby("node_id", sort=True):
        played = mine[mine["b"] < steps]
        arms.nodes.append(node)
        arms.right.append(played["hits"].to_numpy(np.int64))
        arms.size.append(played["n"].to_numpy(np.int64))
        totals.append((int(mine["hits"].sum()), int(mine["n"].sum())))
    arms.total_right, arms.total = (np.array([t[k] for t in totals], np.int64) for k in (0, 1))
    return arms


@dataclass
class Search:
    """The state of a search: successes and trials of each arm, how many batches it was played, and the trace of the steps."""

    arms: Arms
    seed: int = 0
    prior: tuple[float, float] = (1.1, 5.0)
    successes: np.ndarray = field(init=False)
    trials: np.ndarray = field(init=False)
    trace: list[tuple[str, int, str, int, int, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.arms.batch < 1 or not self.arms.nodes or not self.arms.total.all():
            raise ValueError("a batch and every arm need at least one row")
        self.nodes = self.arms.nodes
        self.successes, self.trials = np.zeros(len(self.nodes), np.int64), np.zeros(len(self.nodes), np.int64)
        self.played = np.zeros(len(self.nodes), np.int64)
        self.random = np.random.default_rng(self.seed)

    def run(self, phase: str, steps: int, rule: str = "thompson", draws: np.ndarray | None = None) -> str:
        """``steps`` batches for the 'highest' or the 'lowest' accuracy; the arm found best by then.

        Each step draws from every arm's Beta posterior (or takes its upper bound, or a row of the given ``draws``) and
        plays the extreme one; an arm that has seen all of its own rows is out, and the phase ends early when all are.
        The first of equals is played.
        """
        sign = 1.0 if phase == "highest" else -1.0
        for step in range(steps):
            spent = self.trials >= self.arms.total
            if spent.all():
                break
            if draws is not None:
                draw = draws[step]
            elif rule == "thompson":
                a, b = self.prior
                draw = self.random.beta(a + self.successes, b + self.trials - self.successes)
            else:
                n = np.maximum(self.trials, 1)
                draw = np.where(self.trials > 0, self.successes / n + 2 * np.sqrt(np.log1p(step) / n), 0.0)
            arm = int(np.argmax(np.where(spent, -1e9, sign * draw)))
            at = self.played[arm]
            self.successes[arm] += self.arms.right[arm][at]
            self.trials[arm] += self.arms.size[arm][at]
            self.played[arm] += 1
            self.trace.append((phase, step, self.nodes[arm], int(self.successes[arm]), int(self.trials[arm]), self.best(phase)))
        return self.best(phase)

    def best(self, phase: str) -> str:
        """The arm of the best ratio: the largest name on a tie for 'highest', the smallest for 'lowest'; '' before any trial."""
        tried = [(self.successes[k] / self.trials[k], self.nodes[k]) for k in np.flatnonzero(self.trials)]
        return (max(tried) if phase == "highest" else min(tried))[1] if tried else ""

    def finish(self, *nodes: str) -> None:
        """All remaining rows of the given arms, outside the budget."""
        for arm in (self.nodes.index(n) for n in nodes if n in self.nodes):
            self.successes[arm], self.trials[arm] = self.arms.total_right[arm], self.arms.total[arm]


def prior_from(p: float) -> tuple[float, float]:
    """A prior around the original format's accuracy; it is clamped below one."""
    p = min(max(p, 0.0), 0.999)
    return max(5 * p / (1 - p), 1.1), 5.0


def check_budget(budget: int, batch: int, samples: int) -> int:
    """Steps a phase: the budget must hold a whole, even number of batches, the samples a whole number."""
    if budget % batch or (budget // batch) % 2 or samples % batch:
        raise ValueError("budget and samples must be whole multiples of the batch, the budget an even one")
    return budget // batch // 2


def two_phases(nodes: list[str], grid, budget: int, batch: int, seed: int = 0, rule: str = "thompson", original: str | None = None) -> Search:
    """``search_arms`` over a row of outcomes for each node."""
    return search_arms(Arms.of(nodes, grid, batch), budget, seed, rule, original)


def search_arms(arms: Arms, budget: int, seed: int = 0, rule: str = "thompson", original: str | None = None) -> Search:
    """Half the budget for the best format, half for the worst, continuing the same counts; then both are completed.

    The original format (the first arm, if it isn't named) has been evaluated in full beforehand: its counts stand from the
    start, it is never played, and the prior is drawn from its accuracy.
    """
    steps = check_budget(budget, arms.batch, arms.batch)
    first = original if original is not None else arms.nodes[0]
    k = arms.nodes.index(first)
    search = Search(arms, seed, prior_from(float(arms.total_right[k] / arms.total[k])))
    search.finish(first)
    best = search.run("highest", steps, rule)
    worst = search.run("lowest", steps, rule)
    search.finish(best, worst)
    return search
