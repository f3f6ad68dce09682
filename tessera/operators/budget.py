"""Budgets of runs: reservations that are settled or released, by phase, within limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASES = ("compose", "solve", "gpu")
STATUSES = ("reserved", "refused", "settled", "released", "unknown")


@dataclass
class Ledger:
    """What one run has spent and reserved. compose and solve are money and share a limit; gpu is hours and has its own."""

    most_money: float
    most_gpu: float | None = None
    spent: list = field(default_factory=lambda: [0.0, 0.0, 0.0])
    held: list = field(default_factory=lambda: [0.0, 0.0, 0.0])
    open: dict = field(default_factory=dict)

    def _hold(self, amounts: Sequence[float], sign: int) -> None:
        # without reservations nothing is held, whatever the rounding of what came and went
        self.held = [h + sign * a for h, a in zip(self.held, amounts, strict=True)] if self.open else [0.0, 0.0, 0.0]

    def step(self, kind: str, reservation: str, amounts: Sequence[float | None]) -> str:
        if kind == "reserve":
            new = [a or 0.0 for a in amounts]
            money = sum(self.spent[:2]) + sum(self.held[:2]) + sum(new[:2])
            if money > self.most_money or (self.most_gpu is not None and self.spent[2] + self.held[2] + new[2] > self.most_gpu):
                return "refused"
            if reservation in self.open:
                return "unknown"
            self.open[reservation] = new
            self._hold(new, 1)
            return "reserved"
        if kind not in ("settle", "release") or reservation not in self.open:
            return "unknown"
        was = self.open.pop(reservation)
        self._hold(was, -1)
        if kind == "settle":
            self.spent = [s + (w if a is None else a) for s, w, a in zip(self.spent, was, amounts, strict=True)]
        return "settled" if kind == "settle" else "released"


OUT = "status string, " + ", ".join(f"{w}_{p} double" for w in ("spent", "reserved") for p in PHASES)


def ledger(entries: DataFrame, run: str, order: Sequence[str], kind: str, reservation: str, amounts: Sequence[str], most_money: float, most_gpu: float | None = None) -> DataFrame:
    """Adds status and, after each entry, what its run has spent and reserved by phase.

    entries: kind is reserve, settle or release; amounts names three columns, by PHASES. A reservation is refused if what
    is spent and reserved would pass a limit. Settling takes the reservation off and spends its amounts, or those given in
    their place, even past the limit; releasing only takes it off. An entry for a reservation that is not open, a second
    one under an open name and an unknown kind are `unknown` and change nothing. A null amount of a reservation is 0.

    Whether an entry is refused depends on all before it, so that a run is walked in order: sorted by Spark, in Arrow
    batches, with the run's open reservations as all that is held.
    """
    names = list(entries.columns)
    used = entries.select("*", F.col(run).cast("string").alias("_run"), F.col(kind).alias("_kind"), F.col(reservation).cast("string").alias("_id"), *(F.col(a).cast("double").alias(f"_{p}") for a, p in zip(amounts, PHASES, strict=True)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for batch in batches:
            out = []
            for key, what, name, *given in zip(batch["_run"], batch["_kind"], batch["_id"], *(batch[f"_{p}"] for p in PHASES), strict=True):
                if key != now:
                    now, state = key, Ledger(most_money, most_gpu)
                status = state.step(what, name, [None if pd.isna(x) else float(x) for x in given])
                out.append((status, *state.spent, *state.held))
            told = pd.DataFrame(out, columns=["status", *(f"{w}_{p}" for w in ("spent", "reserved") for p in PHASES)], index=batch.index)
            yield pd.concat([batch[names], told], axis=1)

    ordered = used.repartition(run).sortWithinPartitions("_run", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields)
    return ordered.mapInPandas(walk, f"{schema}, {OUT}")


def should_abort(accepted: Column, attempted: Column, least_rate: float, least_attempts: int) -> Column:
    """Whether a run is to stop: enough attempts, and too few of them accepted."""
    return F.coalesce((attempted > 0) & (attempted >= least_attempts) & (accepted / attempted < least_rate), F.lit(False))
