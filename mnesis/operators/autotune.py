"""Adoption of parameters in rounds: a step that passes its gate must pass again before it is taken; snapshots, the pending step and the ledger are tables of one commit log."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.model import DEFAULT, Params
from mnesis.operators.evaluate import mutation_ladder
from mnesis.sources.commits import Change, Store

SNAPSHOT = "version long, params string, source string, mutation string"
PENDING = "mutation string, params string, pass_rounds long"
LEDGER = "round long, snapshot long, tried array<string>, best string, delta double, p_value double, decision string"


def create(store: Store) -> None:
    for name, schema in (("param_snapshots", SNAPSHOT), ("autotune_pending", PENDING), ("autotune_ledger", LEDGER)):
        store.create(name, store.spark.createDataFrame([], schema), None)


def told(p: Params) -> str:
    """The parameters that are tuned, as text."""
    return json.dumps({"rrf_k": p.rrf_k, "tier": p.tier}, sort_keys=True)


def read(text: str, p: Params = DEFAULT) -> Params:
    got = json.loads(text)
    return replace(p, rrf_k=got["rrf_k"], tier=got["tier"])


def current(store: Store, p: Params = DEFAULT) -> Params:
    """The parameters of the last snapshot; p before the first."""
    last = store.read("param_snapshots").orderBy(F.desc("version")).first()
    return p if last is None else read(last.params, p)


def turn(ladder: list, version: int, most: int) -> list:
    """The part of the ladder that a round tries: other steps after each new snapshot."""
    return [ladder[(version * most + i) % len(ladder)] for i in range(min(most, len(ladder)))]


def decide(best: str | None, pending: tuple[str, int] | None, rounds: int) -> tuple[str, int]:
    """The decision, and how often the best step has then passed in a row (0: nothing is pending)."""
    if best is None:
        return ("rolled_back" if pending else "no_candidate"), 0
    if pending is None or pending[0] != best:
        n, decision = 1, "pending_reset" if pending else "first_pass"
    else:
        n, decision = pending[1] + 1, "first_pass_held"
    return ("solidified", 0) if n >= rounds and pending is not None and pending[0] == best else (decision, n)


def play(store: Store, number: int, gate: Callable[[list[tuple[str, Params]], Params], DataFrame], p: Params = DEFAULT, most: int = 4, rounds: int = 2) -> str:
    """One round, whose changes are one commit; its decision. gate(ladder, params) gives evaluate.paired_gate() of the steps. A round that is played again is as it was.

    The best step is that of the greatest delta among those that pass, the earlier in the ladder among equal ones. Without one, what is pending is dropped.
    """
    played = store.read("autotune_ledger").where(F.col("round") == number).first()
    if played is not None:
        return played.decision
    base, spark = store.version(), store.spark
    now = current(store, p)
    last = store.read("param_snapshots", base).agg(F.max("version").alias("v")).first().v
    snapshots = [] if last is not None else [(0, told(now), "baseline", None)]
    version = last or 0
    ladder = turn(mutation_ladder(now), version, most)
    place = {name: i for i, (name, _) in enumerate(ladder)}
    passed = [r for r in gate(ladder, now).where("gate_pass").collect() if r.mutant in place]  # `most` rows at most
    best = min(passed, key=lambda r: (-r.delta, place[r.mutant]), default=None)
    row = store.read("autotune_pending", base).first()
    decision, n = decide(best and best.mutant, row and (row.mutation, row.pass_rounds), rounds)
    taken = best and told(dict(ladder)[best.mutant])
    if decision == "solidified":
        snapshots.append((version + 1, taken, "solidified", best.mutant))
    pending = [(best.mutant, taken, n)] if n else []
    ledger = [(number, version, list(place), best and best.mutant, best and best.delta, best and best.p_value, decision)]
    changes = {
        "param_snapshots": Change("append", spark.createDataFrame(snapshots, SNAPSHOT)), "autotune_pending": Change("replace", spark.createDataFrame(pending, PENDING)), "autotune_ledger": Change("append", spark.createDataFrame(ledger, LEDGER)),
    }
    store.commit("autotune", changes, base)
    return decision
