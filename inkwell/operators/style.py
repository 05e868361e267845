"""Style and quality gates over text: dialogue state, lexicon scans, density and length checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell import params
from inkwell.functions.text import blank_to_null, contains_any, count_of, lines_of, present, replace_first, strip, total_of


def document_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, line (from 1) and raw for every line."""
    return docs.select(key, F.posexplode(lines_of(F.col(text))).alias("at", "raw")).select(key, (F.col("at") + 1).alias("line"), "raw")


def _any(text: Column, marks: Sequence[str], test) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | test(text, F.lit(mark))
    return found


def with_dialogue(lines: DataFrame, key: str, opening=params.OPENING_QUOTES, closing=params.CLOSING_QUOTES, one_line: bool = False) -> DataFrame:
    """``lines`` with ``stripped`` and ``narrative`` (outside dialogue).

    A line that starts with an opening mark starts dialogue and is dialogue itself; the next line that
    ends with a closing mark ends it. With ``one_line`` an opening line that also ends with a closing
    mark ends its own dialogue.
    """
    opens, closes = _any(F.col("stripped"), opening, F.startswith), _any(F.col("stripped"), closing, F.endswith)
    event = F.when(opens & closes, 0).when(opens, 1) if one_line else F.when(opens, 1)
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last(event.when(closes, 0), ignorenulls=True).over(before), F.lit(0))
    return lines.withColumn("stripped", strip(F.col("raw"))).withColumn("narrative", ~opens & (state == 0))


def split_lexicon(entries: Sequence[tuple[str, str]]) -> dict[str, list[str]]:
    """{severity: words} from (word, severity); a word that is fatal isn't listed again as high."""
    found: dict[str, list[str]] = {}
    for word, severity in entries:
        found.setdefault(severity, []).append(word)
    fatal = set(found.get("fatal", ()))
    return {s: sorted(set(w) - (fatal if s != "fatal" else set())) for s, w in found.items()}


def line_violations(docs: DataFrame, key: str, fatal: Sequence[str], high: Sequence[str], opening=params.OPENING_QUOTES, closing=params.CLOSING_QUOTES, text: str = "text") -> DataFrame:
    """key, line, word, severity, context: fatal words anywhere, high ones outside dialogue; one row for each (word, line).

    The lexicon rides in the expression, so a line is read once however many words there are.
    """
    marked = with_dialogue(document_lines(docs, key, text), key, opening, closing)

    def hits(words: Sequence[str], severity: str, where: Column, among: Column) -> Column:
        listed = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
        found = F.filter(listed, lambda w: where & F.contains(among, w))
        return F.transform(found, lambda w: F.struct(w.alias("word"), F.lit(severity).alias("severity")))

    both = F.concat(hits(fatal, "fatal", F.lit(True), F.col("raw")), hits([w for w in high if w not in set(fatal)], "high", F.col("narrative"), F.col("stripped")))
    return marked.select(key, "line", F.explode(both).alias("v"), F.left("stripped", F.lit(80)).alias("context")).select(key, "line", "v.word", "v.severity", "context")


def overused(docs: DataFrame, key: str, limits: dict[str, int | None], text: str = "text") -> DataFrame:
    """key, word, n, allowed of words that occur more often than they may."""
    rows = F.array(*[F.struct(F.lit(w).alias("word"), count_of(F.col(text), F.lit(w)).alias("n"), F.lit(params.DEFAULT_ALLOWED if a is None else a).alias("allowed")) for w, a in limits.items()])
    return docs.select(key, F.explode(F.filter(rows, lambda r: r["n"] > r["allowed"])).alias("r")).select(key, "r.*")


def quality_issues(docs: DataFrame, key: str, forbidden=params.FORBIDDEN_WORDS, similes=params.SIMILE_MARKERS, target: str = "target", text: str = "text", simile_most: int = params.SIMILE_MOST) -> DataFrame:
    """key, severity, category, subject, measure, fixable: forbidden words, simile density and length against ``target``."""
    body = F.col(text)

    def issue(severity, category: str, subject: Column, measure: Column, fixable) -> Column:
        return F.struct(
            (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.lit(category).alias("category"), subject.alias("subject"),
            measure.cast("double").alias("measure"), (fixable if isinstance(fixable, Column) else F.lit(fixable)).alias("fixable"),
        )

    found = [issue("error", "forbidden", F.lit(w), count_of(body, F.lit(w)), False) for w in forbidden]
    words = F.filter(F.array(*found), lambda r: r["measure"] > 0)
    n = total_of(body, similes)
    simile = F.when(n > simile_most, F.array(issue("warn", "simile", F.lit("density"), n, True)))
    ratio = F.length(body) / F.nullif(F.col(target), F.lit(0))
    severity = F.when(ratio < params.LENGTH_LOW, "error").when(ratio < params.LENGTH_SHORT, "warn").when(ratio > params.LENGTH_LONG, "info")
    length = F.when(severity.isNotNull(), F.array(issue(severity, "length", F.lit("ratio"), F.round(ratio, 6), ratio <= 1)))
    none = F.slice(F.array(issue("", "", F.lit(""), F.lit(0), False)), 1, 0)
    every = F.concat(words, F.coalesce(simile, none), F.coalesce(length, none))
    return docs.select(key, F.explode(every).alias("i")).select(key, "i.*")


def liveliness(docs: DataFrame, key: str, text: str = "text", inner=params.INNER_MARKERS, generic=params.GENERIC_CARE, specific=params.SPECIFIC_CARE, shown=params.SHOWN_CARE,
               temperature=params.TEMPERATURE_WORDS, humor=params.HUMOR_MARKERS, irony: str = params.SELF_IRONY, sensory=params.SENSORY_MARKERS, warm: str = "主角", pronoun: str = "主角",
               sensory_least: int = params.SENSORY_LEAST) -> DataFrame:
    """key, dimension, severity, hits of the six checks that fail; hits are numbers of distinct markers."""
    body = F.col(text)
    ratio = present(body, inner) * 3000.0 / F.greatest(F.length(body), F.lit(1))
    about = F.filter(lines_of(body), lambda line: F.contains(line, F.lit(warm)) | F.contains(F.left(line, F.lit(3)), F.lit(warm[:1])))
    generic_hits = F.aggregate(about, F.lit(0), lambda a, line: a + present(line, generic))
    specific_hits = F.aggregate(about, F.lit(0), lambda a, line: a + present(line, specific))
    acts = F.regexp_count(body, F.lit(rf"[。]\s*{pronoun}[^。]{{2,30}}[了]"))
    checks = [
        ("inner", F.lit("warn"), present(body, inner), ratio < 1.5),
        ("warmth", F.when(F.size(about) == 0, "info").otherwise("warn"), generic_hits, (F.size(about) == 0) | ((generic_hits >= specific_hits) & (specific_hits < 3))),
        ("shown", F.lit("info"), present(body, shown), (present(body, shown) < 2) & (acts < 3)),
        ("temperature", F.lit("warn"), present(body, temperature), present(body, temperature) < 2),
        ("humor", F.lit("info"), present(body, humor), (present(body, humor) < 3) & (F.regexp_count(body, F.lit(irony)) < 2)),
        ("sensory", F.lit("info"), present(F.left(body, F.lit(params.SENSORY_WINDOW)), sensory), present(F.left(body, F.lit(params.SENSORY_WINDOW)), sensory) < sensory_least),
    ]
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), s.alias("severity"), h.cast("long").alias("hits"), bad.alias("bad")) for d, s, h, bad in checks])
    return docs.select(key, F.explode(F.filter(rows, lambda r: r["bad"])).alias("r")).select(key, "r.dimension", "r.severity", "r.hits")


def fix_violations(docs: DataFrame, key: str, deletable=params.DELETABLE_WORDS, text: str = "text") -> DataFrame:
    """``docs`` with the first occurrence of each deletable word gone from every line that has it."""
    def mend(line: Column) -> Column:
        for word in deletable:
            line = replace_first(line, word)
        return line

    return docs.withColumn(text, F.when(contains_any(F.col(text), deletable), F.array_join(F.transform(lines_of(F.col(text)), mend), "\n")).otherwise(F.col(text)))


def gate(docs: DataFrame, violations: DataFrame, key: str) -> DataFrame:
    """key, n_fatal, n_high, n_medium, passed for every document; clean ones pass."""
    counts = violations.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("fatal", "high", "medium")])
    out = docs.select(key).join(counts, key, "left").na.fill(0, ["n_fatal", "n_high", "n_medium"])
    return out.withColumn("passed", F.col("n_fatal") + F.col("n_high") + F.col("n_medium") == 0)


def fixed_issues(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fixable issues that a repair has removed."""
    return before.where("fixable").join(after, list(keys), "left_anti")


def keep_longer(old: Column, new: Column) -> Column:
    """A rewritten text, unless it has lost more than half of its length."""
    return F.when(F.length(new) < 0.5 * F.length(old), old).otherwise(F.coalesce(blank_to_null(new), old))
