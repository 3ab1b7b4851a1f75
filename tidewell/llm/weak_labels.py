"""Weak supervision with DataFrame operations: voters that vote or abstain, fitted by expectation-maximisation.

A row has votes v0, v1, ...: 1 for, -1 against, 0 abstains. Rows are first counted by vote pattern, so
each round of the fit is one aggregation over at most 3^k rows and brings back one row of sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES = (-1, 0, 1)


@dataclass
class VoteModel:
    """Share of positives, and for each voter the chance of each vote given positive and negative."""

    prior: float
    chances: list[tuple[dict[int, float], dict[int, float]]]

    def posterior(self, votes: list[Column]) -> Column:
        """Chance that a row with these votes is positive."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, (yes, no) in zip(votes, self.chances):
            step = {v: math.log(yes[v] / no[v]) for v in VOTES}
            odds = odds + F.when(vote > 0, step[1]).when(vote < 0, step[-1]).otherwise(step[0])
        return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), odds))))


#: Chances to start from, given positive and negative. Evenly matched votes: right four times in five
#: when a voter does not abstain. Rules that look for one fault each: a good row hardly ever shows the
#: fault, a bad row shows few of all faults, so passing a rule says little.
EVEN = ({1: 0.6, 0: 0.25, -1: 0.15}, {1: 0.15, 0: 0.25, -1: 0.6})
FAULTS = ({1: 0.745, 0: 0.25, -1: 0.005}, {1: 0.55, 0: 0.2, -1: 0.25})


def fit(rows: DataFrame, votes: list[str], prior: float = 0.5, begin=EVEN, rounds: int = 10, smooth: float = 1.0) -> VoteModel:
    """Expectation-maximisation over rows' votes, from `begin` for every voter.

    `begin` also weighs as 10 * smooth rows of either class, so that few rows don't decide alone.
    """
    counts = rows.groupBy(*votes).agg(F.count("*").alias("n")).persist()
    model = VoteModel(prior, [begin] * len(votes))
    try:
        for _ in range(rounds):
            p = model.posterior([F.col(v) for v in votes])
            sums = [F.sum(F.col("n") * p), F.sum(F.col("n") * (1 - p))]
            for v in votes:
                for side in (p, 1 - p):
                    sums += [F.sum(F.when(F.col(v) == value, F.col("n") * side).otherwise(0.0)) for value in VOTES]
            got = list(counts.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
            if got[0] is None:
                return model
            yes, no = got[0], got[1]
            chances = []
            for j, (old_yes, old_no) in enumerate(model.chances):
                part = got[2 + 6 * j : 8 + 6 * j]
                new = [
                    {v: (part[3 * s + i] + 10 * smooth * begin[s][v]) / ((yes, no)[s] + 10 * smooth) for i, v in enumerate(VOTES)}
                    for s in (0, 1)
                ]
                # a voter may turn out useless, never reversed: its votes keep their meaning
                if new[0][1] * new[1][-1] < new[0][-1] * new[1][1]:
                    new = [old_yes, old_no]
                chances.append((new[0], new[1]))
            share = (yes + smooth) / (yes + no + 2 * smooth)
            moved = abs(share - model.prior) + sum(abs(a[0][1] - b[0][1]) + abs(a[1][1] - b[1][1]) for a, b in zip(chances, model.chances))
            model = VoteModel(min(max(share, 0.01), 0.99), chances)
            if moved < 1e-4:
                break
    finally:
        counts.unpersist()
    return model
