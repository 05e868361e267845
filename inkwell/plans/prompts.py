"""Prompts: blocks of text that are joined in order, empty ones left out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.sources import config as cf

#: Hooks that a context lists at most.
MOST_HOOKS = 8


def blocks(parts: Iterable[tuple[str, str | None]], separator: str = "\n\n") -> str:
    """Titled blocks; a part without a body is left out."""
    return separator.join(f"## {title}\n{body.strip()}" if title else body.strip() for title, body in parts if body and body.strip())


def bullets(items: Iterable, most: int | None = None) -> str:
    held = [str(i) for i in items if str(i).strip()]
    return "\n".join(f"- {i}" for i in (held if most is None else held[:most]))


def system_prompt(rules: str, world: str, people: str, state: str, gaps: str = "", context: str = "") -> str:
    return blocks([("写作规则", rules), ("世界观", world), ("人物", people), ("角色状态", state), ("信息差", gaps), ("上文", context)])


def section_prompts(sections: DataFrame) -> DataFrame:
    """``sections`` with ``prompt``: what happens, in which direction, how long; expanded ones carry their own direction."""
    def line(title: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(f"{title}："), value))

    expanded = F.when(F.col("weight") == "expanded", line("重点", F.col("expanded_direction")))
    asked = F.concat_ws("\n", line("场景", F.col("subject")), line("锚点", F.col("scene_anchor")), line("内容", F.col("description")), line("张力", F.col("tension_direction")), expanded, F.concat(F.lit("约 "), F.col("length_hint").cast("string"), F.lit(" 字")))
    return sections.withColumn("prompt", asked)


def chapter_context(previous: Mapping | None, hooks: Iterable[str], people: Mapping[str, Mapping], now: Mapping | None, labels: Mapping[str, str]) -> str:
    """What a vault says before a chapter is written; empty if it says one thing at most."""
    before, here = previous or {}, now or {}
    span, world = here.get("time_span") or {}, here.get("world_state") or {}
    parts = [("上一章关键事件", bullets(before.get("key_events") or []))]
    parts += [(f"{labels[k]} 状态", bullets(f"{a}: {'; '.join(map(str, b)) if isinstance(b, list) else b}" for a, b in v.items())) for k, v in before.items() if k in labels and isinstance(v, Mapping)]
    parts.append(("未回收伏笔", bullets(hooks, MOST_HOOKS)))
    for name, person in people.items():
        history = person.get("state_history") or []
        if history and isinstance(history[-1], Mapping):
            last = history[-1]
            goal = (person.get("goals") or {}).get("immediate")
            parts.append((f"{name} 当前状态", bullets([f"状态: {last.get('summary') or last.get('status') or ''}", f"位置: {person.get('current_location') or '未知'}", *([f"目标: {goal}"] if goal else [])])))
    if span:
        parts.append(("时间范围", f"{span.get('start', '?')} → {span.get('end', '?')}" + (f"（故事第 {span['absolute_day']} 天）" if span.get("absolute_day") else "")))
    if world.get("stage"):
        parts.append(("世界阶段", "\n".join([str(world["stage"]), "; ".join(e for e in world.get("public_events") or [] if e)])))
    held = blocks(parts)
    return held if held.count("## ") > 1 else ""


def world_context(lore: str, env: Mapping, facts: Iterable[str], chapters: Iterable[int]) -> str:
    """For the world step: lore, the state of time and places, at most three facts, the chapters to cover."""
    held = list(facts)[:3]
    return blocks([("世界观", lore), ("环境", bullets(f"{k}: {v}" for k, v in env.items() if v not in (None, "", {}, []))), ("事实", bullets(held)), ("章节", ", ".join(map(str, chapters)))])


def agent_prompt(config: Mapping, key: str, view: str, memories: str, goals: Mapping, tom: str = "") -> tuple[str, str]:
    """System text and question for an agent's decision."""
    name = cf.character_name(config, key)
    return blocks([("", f"你是{name}。"), ("目标", bullets(f"{k}: {v}" for k, v in goals.items() if v)), ("认知", tom)]), blocks([("", view), ("记忆", memories), ("", "请决定你的行动。")])


def spec_prompt(scenes: DataFrame) -> DataFrame:
    """chapter and its scenes as lines, for the step that designs a spec."""
    mark = F.concat_ws(" ", F.when(F.col("interactive"), "对手戏"), F.when(F.col("has_private"), "隐藏信息"))
    line = F.concat(F.lit("- 第"), F.col("day").cast("string"), F.lit("天 @"), F.col("location"), F.lit(" "), mark)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("day", "first_time", "location", line.alias("line")))), lambda s: s["line"])
    return scenes.groupBy("chapter").agg(F.array_join(ordered, "\n").alias("prompt"))


def dimension_text(name: str, state: Mapping, last: int = 3) -> str:
    """A character's dimensions and the last entries of its history."""
    history = [f"第{h.get('chapter')}章: {h.get('description', '')}" for h in (state.get("history") or [])[-last:]]
    return blocks([(f"{name} 状态", bullets(f"{k}: {v}/5" for k, v in (state.get("dimensions") or {}).items())), ("近期变化", bullets(history))])
