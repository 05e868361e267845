"""Agents by tier. Classes come from an explicit registry: a configuration names a kind, it never names code to import."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.plans import generate
from inkwell.sources import config as cf

Decision = Callable[[DataFrame, generate.Model], DataFrame]
_KINDS: dict[str, Decision] = {}


def get_logger(name: str, level: int | str = logging.INFO) -> logging.Logger:
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(message)s"))
        log.addHandler(handler)
    log.setLevel(level)
    return log


def register(kind: str) -> Callable[[Decision], Decision]:
    def keep(f: Decision) -> Decision:
        if kind in _KINDS:
            raise ValueError(f"{kind} is registered already")
        _KINDS[kind] = f
        return f

    return keep


def kind_of(name: str) -> Decision:
    if name not in _KINDS:
        raise KeyError(f"no kind of agent is registered as {name!r}; there are {sorted(_KINDS)}")
    return _KINDS[name]


@register("lite")
def lite(asks: DataFrame, model: generate.Model) -> DataFrame:
    """agent, answer: one question for each agent; an agent whose model fails answers with nothing to do."""
    return generate.answered_objects(asks, model).select("agent", "answer")


def decided(asks: DataFrame, config: Mapping, model: generate.Model = generate.stub_object, tier: int | None = None) -> DataFrame:
    """Answers of the cast (of one tier) to asks(agent, system, prompt), each by the kind that its entry names."""
    members = cf.cast(config) if tier is None else cf.tier_cast(config, tier)
    out = None
    for kind in sorted({c.get("class") or "lite" for c in members}):
        mine = [c["key"] for c in members if (c.get("class") or "lite") == kind]
        found = kind_of(kind)(asks.where(F.col("agent").isin(*mine)), model)
        out = found if out is None else out.unionByName(found)
    return asks.select("agent", F.lit("{}").alias("answer")).limit(0) if out is None else out


def world_step(arcs: DataFrame, model: generate.Model = generate.stub_object) -> DataFrame:
    """One answer for each arc(arc_id, system, prompt)."""
    return generate.answered_objects(arcs, model).select("arc_id", "answer")


def scene_step(scenes: DataFrame, model: generate.Model = generate.stub_object) -> DataFrame:
    """Turns of shared scenes (day, location, system, prompt); scenes without an answer have none."""
    return generate.turns(generate.answered_objects(scenes, model))
