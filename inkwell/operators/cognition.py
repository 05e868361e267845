"""What characters know, against what is true, and what they think of each other's knowledge."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell import params
from inkwell.functions.text import hashed_terms, normalised, strip, term_hash, typed_terms
from inkwell.operators.automata import scanned
from inkwell.operators.joins import BLOCK_ROWS, BROADCAST_ROWS, if_small
from inkwell.operators.meetings import meet_often, met_by_blocks
from inkwell.operators.numbering import numbered
from inkwell.operators.terms import WHITE, Held, scores
from inkwell.sources.tables import kept


#: A fact of up to so many terms is touched by any one of them, whatever its kind.
BRIEF_FACT = 3


def exploded_terms(rows: DataFrame, key: str, text: str, stop_words: Sequence[str] = params.STOP_WORDS, stop_ngrams: Sequence[str] = params.STOP_NGRAMS, kinds: str = "sbt") -> DataFrame:
    return rows.select(key, F.explode(typed_terms(F.col(text), stop_words, stop_ngrams, kinds)).alias("t")).select(key, "t.kind", "t.term")


def posted_terms(facts: DataFrame, fact_key: str, fact: str, **stops) -> DataFrame:
    """kind, term, fact_key, brief: where a text's term finds facts.

    Facts of more than ``BRIEF_FACT`` terms are found by their own kind of term, and never by bigrams, which
    don't count for them; brief ones by any kind.
    """
    held = exploded_terms(facts, fact_key, fact, **stops)
    sizes = held.groupBy(fact_key).agg((F.countDistinct("term") <= BRIEF_FACT).alias("brief"))
    kinds = F.when(F.col("brief"), F.array(F.lit("s"), F.lit("b"), F.lit("t"))).when(F.col("kind") != "b", F.array("kind"))
    return held.join(sizes, fact_key).select(F.explode(kinds).alias("kind"), "term", fact_key, "brief").distinct()


def term_scores(texts: DataFrame, facts: DataFrame, text_key: str, text: str, fact_key: str = "fact_id", fact: str = "proposition", **stops) -> DataFrame:
    """text_key, fact_key, score of the pairs that share enough terms.

    Facts of up to three terms count 10 for any shared term; others 2 plus the shared short terms, or the
    shared trigrams if there are two at least. Few facts' terms are held by the workers, and a text's terms are looked up where
    it lies (``terms``); many are found by an equi-join on the hash of (kind, term), which shuffles.
    """
    posted = posted_terms(facts, fact_key, fact, **stops)
    held = Held.of(posted, fact_key, **stops)
    if held is None:
        return _joined_scores(texts, posted, text_key, text, fact_key, **stops)
    single, repeated = _by_repeats(texts, text_key)
    found = held.touched(single, text_key, text, facts.schema[fact_key], "score long", _all_scores)
    return found if repeated is None else found.unionByName(_summed_scores(held, repeated, facts, text_key, text, fact_key))


def _joined_scores(texts: DataFrame, posted: DataFrame, text_key: str, text: str, fact_key: str, **stops) -> DataFrame:
    kinds = "sbt" if posted.where("kind = 'b'").limit(1).count() else "st"
    hashed = posted.select(term_hash(F.col("kind"), F.col("term")).alias("h"), "kind", fact_key, "brief")
    shared = texts.select(text_key, F.explode(hashed_terms(F.col(text), **stops, kinds=kinds)).alias("h")).join(if_small(hashed), "h")
    counts = shared.groupBy(text_key, fact_key).agg(F.max("brief").alias("brief"), F.count_if(F.col("kind") == "s").alias("shorts"), F.count_if(F.col("kind") == "t").alias("trigrams"))
    return _scored(counts, text_key, fact_key)


def _scored(counts: DataFrame, text_key: str, fact_key: str) -> DataFrame:
    score = F.when(F.col("brief"), 10).when(F.col("shorts") > 0, F.col("shorts") + 2).when(F.col("trigrams") >= 2, F.col("trigrams"))
    return counts.withColumn("score", score.cast("long")).where("score is not null").select(text_key, fact_key, "score")


def _all_scores(counts: np.ndarray, brief: np.ndarray) -> tuple[np.ndarray, ...]:
    score = scores(counts, brief)
    at = np.flatnonzero(score)
    return at, score[at]


def _all_counts(counts: np.ndarray, brief: np.ndarray) -> tuple[np.ndarray, ...]:
    at = np.flatnonzero(counts.any(axis=1))
    return at, brief[at], counts[at, 0], counts[at, 1]


def _by_repeats(texts: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and the others (None if there are none): their terms count together."""
    repeated = texts.groupBy(F.col(key).alias("_repeated")).agg(F.count("*").alias("_n")).where("_n > 1").select("_repeated")
    if repeated.isEmpty():
        return texts, None
    repeated, same = if_small(repeated), texts[key].eqNullSafe(F.col("_repeated"))
    return texts.join(repeated, same, "left_anti"), texts.join(repeated, same, "left_semi")


def _summed_scores(held: Held, texts: DataFrame, facts: DataFrame, text_key: str, text: str, fact_key: str) -> DataFrame:
    counts = held.touched(texts, text_key, text, facts.schema[fact_key], "brief boolean, shorts long, trigrams long", _all_counts)
    summed = counts.groupBy(text_key, fact_key).agg(F.max("brief").alias("brief"), F.sum("shorts").alias("shorts"), F.sum("trigrams").alias("trigrams"))
    return _scored(summed, text_key, fact_key)


def _in_order(held: Held, facts: DataFrame) -> np.ndarray | None:
    """The held numbers of the facts' rows in table order; None if these are too many."""
    rows = facts.select("fact_id", "ord").limit(BROADCAST_ROWS + 1).orderBy("ord").select("fact_id").toArrow().column(0).to_pylist()
    return np.array([held.numbers[k] for k in rows if k in held.numbers], np.int64) if len(rows) <= BROADCAST_ROWS else None


#: Characters of a piece of text by which containment is found; characters of a text that are cut into pieces at once.
PIECE, STRETCH = 12, 1 << 16
#: What a row of pieces stands for, for texts; facts take the other part.
HAY, NEEDLE, BARE = 0, 1, 2


def _prepared(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, norm, bare: the normalised text and, where nothing is left of it, the stripped one."""
    norm = rows.select(F.col(key).alias(key), F.col(text).alias("_text"), normalised(F.col(text)).alias("norm"))
    return norm.select(key, "norm", F.when(F.length("norm") == 0, strip(F.col("_text"))).otherwise("").alias("bare"))


def _pieces(prepared: DataFrame, key: str, hay_lengths: Sequence[int], longest: int, roles: Sequence[int] = (HAY, NEEDLE, BARE)) -> DataFrame:
    """key, role, at, n, piece of a text that may hold others and may itself lie in another, in one pass.

    HAY: every place's piece of ``PIECE`` characters (``at``: its place), if that is one of ``hay_lengths``;
    shorter pieces are whole needles, once and without a place. NEEDLE: the n pieces that cover a text of at
    most ``longest`` characters end to end (``at``: the piece's place from its start). BARE: a text of which
    normalisation leaves nothing. Long texts are cut into stretches that overlap, so no array grows with a text.
    """
    starts = F.sequence(F.lit(0), F.floor(F.length("norm") / STRETCH).cast("int") * STRETCH, F.lit(STRETCH))
    part = F.substring("norm", F.col("start") + 1, F.lit(STRETCH + PIECE - 1))
    cut = prepared.select(key, "norm", "bare", F.explode(starts).alias("start")).select(key, "norm", "bare", "start", part.alias("part"), F.length("norm").alias("size"))

    def every(n: int) -> Column:
        return F.regexp_extract_all("part", F.lit(f"(?=(.{{{n}}}))."), F.lit(1))

    none = F.array().cast("array<string>")
    in_place = F.greatest(F.col("size") - F.col("start") - PIECE + 1, F.lit(0)) if PIECE in hay_lengths else F.lit(0)
    n_hay = F.least(in_place, F.lit(STRETCH)).alias("n_hay")
    covers = (F.col("start") == 0) & F.col("size").between(1, longest)
    n_needle = F.when(covers, F.ceil(F.col("size") / PIECE).cast("int")).otherwise(0).alias("n_needle")
    counted = cut.select("*", n_hay, n_needle)
    last = F.greatest(F.col("size") - PIECE, F.lit(0))
    needle = F.when(F.col("n_needle") > 0, F.transform(F.sequence(F.lit(0), F.col("n_needle") - 1), lambda k: F.substring("norm", F.least(k * PIECE, last) + 1, F.lit(PIECE)))).otherwise(none)
    short = F.array_distinct(F.concat(none, *[every(n) for n in hay_lengths if n < PIECE]))
    bare = F.when(F.length("bare") > 0, F.array("bare")).otherwise(none)
    long_ones = every(PIECE) if PIECE in hay_lengths else none
    dealt = counted.select(key, "size", "start", "n_hay", "n_needle", F.length("bare").alias("n_bare"), F.posexplode(F.concat(long_ones, needle, bare, short)).alias("pos", "piece"))
    of_needle = F.col("pos") - F.col("n_hay")
    is_needle = (of_needle >= 0) & (of_needle < F.col("n_needle"))
    hay, needle_role, bare_role = (F.lit(r) for r in roles)
    return dealt.select(
        key, F.when(is_needle, needle_role).when((F.col("n_bare") > 0) & (of_needle == F.col("n_needle")), bare_role).otherwise(hay).alias("role"),
        F.when(of_needle < 0, F.col("start") + F.col("pos")).when(is_needle, F.least(of_needle * PIECE, last)).otherwise(0).alias("at"),
        F.when(is_needle, F.col("n_needle")).alias("n"), "piece",
    )


#: What the stage's other rows are: a fact's whole text that stands in a text.
FOUND = 3
_OTHERS = re.compile("[^0-9A-Za-z一-鿿]+")


def _marks(text: str | None, found: Callable[[str], Iterable[str]], longest: int, whole: bool) -> Iterator[tuple[int, int, int | None, str]]:
    """(role, at, n, piece) of a text: the facts it holds and, if ``whole``, what finds it inside facts of up to ``longest`` characters."""
    if text is None:
        return
    norm = _OTHERS.sub("", text)
    for word in found(norm):
        yield FOUND, 0, None, word
    if not whole:
        return
    if not norm and (bare := text.strip(WHITE)):
        yield BARE, 0, None, bare
    elif 0 < len(norm) <= longest:
        n = -(-len(norm) // PIECE)
        for k in range(n):
            at = min(k * PIECE, max(len(norm) - PIECE, 0))
            yield NEEDLE, at, n, norm[at : at + PIECE]


def contained(texts: DataFrame, facts: DataFrame, text_key: str, text: str, fact_key: str = "fact_id", fact: str = "proposition") -> DataFrame:
    """Pairs of which one normalised text contains the other, or that are equal when stripped.

    Texts are read and normalised in one pass, which marks them. Facts in a text are found by an automaton of all facts.
    Only texts no longer than the
    longest fact can lie inside one: such a text is covered by pieces of ``PIECE`` characters and found by an equi-join on them
    with the facts' pieces; it is there where all of its own follow each other, so neither text is needed again to check that.
    The facts' pieces are broadcast if they are few; then only marks leave the place where texts lie.
    """
    told = _prepared(facts, fact_key, fact)
    longest = told.agg(F.max(F.length("norm"))).first()[0] or 0
    given = texts.select(text_key, F.col(text).cast("binary").alias("_text"))
    kind = "role int, at int, n int, piece string"
    fields = [pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def marked(values: list[bytes | None], found: Callable[[str], Iterable[str]], part: int) -> tuple[list[int], list[pa.Array]]:
        rows, marks = [], []
        for k, value in enumerate(values):
            mine = list(_marks(None if value is None else value.decode("utf-8", "replace"), found, longest, part == 0))
            rows += [k] * len(mine)
            marks += mine
        return rows, [pa.array([m[i] for m in marks], f) for i, f in enumerate(fields)]

    of_texts = scanned(given, text_key, "_text", told, "norm", marked, kind)
    of_facts = _pieces(told, fact_key, range(1, PIECE + 1), 0, (NEEDLE, HAY, BARE)).select(fact_key, "role", F.col("at").alias("fact_at"), "piece")
    whole = told.where(F.length("norm") > 0).select(fact_key, F.lit(FOUND).alias("role"), F.lit(0).alias("fact_at"), F.col("norm").alias("piece"))
    met = of_texts.join(if_small(of_facts.unionByName(whole)), ["role", "piece"])
    # a piece's place in its needle is taken from its place in the hay
    runs = met.groupBy(text_key, fact_key, "role", (F.col("fact_at") - F.col("at")).alias("start")).agg(F.countDistinct("at").alias("seen"), F.max(F.coalesce("n", F.lit(1))).alias("wanted"))
    return runs.where("seen = wanted").select(text_key, fact_key).distinct()


def matched_facts(texts: DataFrame, facts: DataFrame, text_key: str, text: str, **stops) -> DataFrame:
    """fact_id, text_key, score, place: facts that a text touches, the strongest first, then in table order.

    Where facts are few a text's facts are ranked where it lies.
    """

    def placed(found: DataFrame) -> DataFrame:
        ordered = found.join(facts.select("fact_id", "ord"), "fact_id")
        return ordered.withColumn("place", F.row_number().over(Window.partitionBy(text_key).orderBy(F.desc("score"), "ord"))).drop("ord")

    posted = posted_terms(facts, "fact_id", "proposition", **stops)
    held = Held.of(posted, "fact_id", **stops)
    order = None if held is None else _in_order(held, facts)
    if order is None:
        return placed(_joined_scores(texts, posted, text_key, text, "fact_id", **stops))

    def ranked(counts: np.ndarray, brief: np.ndarray) -> tuple[np.ndarray, ...]:
        score = scores(counts, brief)[order]
        at = np.flatnonzero(score)
        at = at[np.argsort(-score[at], kind="stable")]
        return order[at], score[at], np.arange(1, len(at) + 1, dtype=np.int32)

    single, repeated = _by_repeats(texts, text_key)
    found = held.touched(single, text_key, text, facts.schema["fact_id"], "score long, place int", ranked).select("fact_id", text_key, "score", "place")
    return found if repeated is None else found.unionByName(placed(_summed_scores(held, repeated, facts, text_key, text, "fact_id")))


def matched_beliefs(beliefs: DataFrame, facts: DataFrame, key: str, proposition: str = "proposition", **stops) -> DataFrame:
    """key, fact_id of the first fact in table order that a belief's proposition matches.

    Where facts are few only the first that its terms touch leaves a belief.
    """
    given = beliefs.select(F.col(key), F.col(proposition).alias("_prop"))
    posted = posted_terms(facts, "fact_id", "proposition", **stops)
    held = Held.of(posted, "fact_id", **stops)
    order = None if held is None else _in_order(held, facts)

    def first(counts: np.ndarray, brief: np.ndarray) -> tuple[np.ndarray, ...]:
        return (order[scores(counts, brief)[order] > 0][:1],)

    if order is None:
        by_terms = _joined_scores(given, posted, key, "_prop", "fact_id", **stops).select(key, "fact_id")
    else:
        single, repeated = _by_repeats(given, key)
        by_terms = held.touched(single, key, "_prop", facts.schema["fact_id"], "", first)
        if repeated is not None:
            by_terms = by_terms.unionByName(_summed_scores(held, repeated, facts, key, "_prop", "fact_id").select(key, "fact_id"))
    pairs = contained(given, facts, key, "_prop").unionByName(by_terms).join(facts.select("fact_id", "ord"), "fact_id")
    return pairs.groupBy(key).agg(F.min_by("fact_id", "ord").alias("fact_id"))


def known_facts(knowledge: DataFrame, facts: DataFrame) -> DataFrame:
    """Knowledge of facts that the table has."""
    return knowledge.join(facts, "fact_id")


def merged_knowledge(entries: DataFrame, agent: str = "agent") -> DataFrame:
    """agent, fact_id, confidence, source, confirmed_at_chapter from entries in order of ``seq``.

    The highest confidence stays with its source (the first to reach it); the chapter is the first one's.
    """
    best = F.struct(F.col("confidence"), -F.col("seq"))
    return entries.groupBy(agent, "fact_id").agg(
        F.max("confidence").alias("confidence"), F.max_by("source", best).alias("source"), F.min_by("chapter", "seq").alias("confirmed_at_chapter"),
    )


def deciding_entries(entries: DataFrame, agent: str = "agent") -> DataFrame:
    """Of each (agent, fact) the entries that ``merged_knowledge`` rests on: the best and the first."""
    row = F.struct(*entries.columns)
    held = entries.groupBy(agent, "fact_id").agg(F.max_by(row, F.struct(F.col("confidence"), -F.col("seq"))).alias("best"), F.min_by(row, "seq").alias("first"))
    return held.select(F.explode(F.array_distinct(F.array("best", "first"))).alias("e")).select("e.*")


def new_knowledge(merged: DataFrame, before: DataFrame, agent: str = "agent") -> DataFrame:
    return merged.join(before, [agent, "fact_id"], "left_anti")


def observed_entries(fragments: DataFrame, facts: DataFrame, agent: str, chapter: int, **stops) -> DataFrame:
    """Entries for true facts that an agent's text fragments (agent, frag_id, seq, text) touch."""
    hits = matched_facts(fragments, facts, "frag_id", "text", **stops).join(facts.where("truth").select("fact_id"), "fact_id")
    return hits.join(fragments.select("frag_id", agent, "seq"), "frag_id").select(
        agent, "fact_id", "seq", F.lit(params.OBSERVED_CONFIDENCE).alias("confidence"), F.lit("observed").alias("source"), F.lit(chapter).alias("chapter")
    )


def belief_entries(beliefs: DataFrame, facts: DataFrame, agent: str, chapter: int, **stops) -> DataFrame:
    """Entries for true facts that active beliefs (agent, belief_id, seq, proposition, confidence, status) match."""
    active = beliefs.where("status = 'active'")
    hits = matched_beliefs(active, facts, "belief_id", **stops).join(facts.where("truth").select("fact_id"), "fact_id")
    return hits.join(active, "belief_id").select(agent, "fact_id", "seq", "confidence", F.lit("belief").alias("source"), F.lit(chapter).alias("chapter"))


def wrong_beliefs(beliefs: DataFrame, facts: DataFrame, agent: str, **stops) -> DataFrame:
    """agent, fact_id, believes: active beliefs that match a false fact."""
    active = beliefs.where("status = 'active'")
    hits = matched_beliefs(active, facts, "belief_id", **stops).join(facts.where("not truth").select("fact_id"), "fact_id")
    return hits.join(active, "belief_id").select(agent, "fact_id", "seq", F.col("proposition").alias("believes"))


def knowledge_gaps(agents: DataFrame, facts: DataFrame, knowledge: DataFrame, wrong: DataFrame | None = None, agent: str = "agent") -> DataFrame:
    """(agent, fact_id) of the facts that an agent neither knows nor holds a false belief of.

    The result is agents times facts by its nature, less what is known. Fact ids lie in blocks of about
    ``BLOCK_ROWS``; an agent's row meets each block's array, takes away what the agent knows of that block and
    unfolds the rest, so pairs that are known are never made.
    """
    n_facts = facts.count()
    n_blocks = max(1, -(-n_facts // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("fact_id"), F.lit(n_blocks)).alias("_block")
    told = facts.groupBy(block).agg(F.collect_set("fact_id").alias("_every"))
    held = knowledge.select(agent, "fact_id")
    if wrong is not None:
        held = held.unionByName(wrong.select(agent, "fact_id"))
    known = held.groupBy(agent, block).agg(F.collect_set("fact_id").alias("_known"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("_block")
    met = agents.select(agent, blocks).join(known, [agent, "_block"], "left").join(F.broadcast(told) if n_facts <= BROADCAST_ROWS else told, "_block")
    return met.select(agent, F.explode(F.when(F.col("_known").isNull(), F.col("_every")).otherwise(F.array_except("_every", "_known"))).alias("fact_id"))


def known_to_nobody(facts: DataFrame, knowledge: DataFrame) -> DataFrame:
    return facts.join(knowledge, "fact_id", "left_anti")


def first_believers(wrong: DataFrame, agent: str = "agent") -> DataFrame:
    """fact_id, believes, agent of the first false belief of each fact, by agent and seq."""
    return wrong.groupBy("fact_id").agg(F.min_by(F.struct("believes", agent), F.struct(agent, "seq")).alias("f")).select("fact_id", "f.*")


def newly_confirmed(now: DataFrame, before: DataFrame, facts: DataFrame, agent: str = "agent") -> DataFrame:
    """(agent, fact_id) known now but not before, for agents of which there is an earlier state."""
    tracked = before.select(agent).distinct()
    return now.join(before, [agent, "fact_id"], "left_anti").join(tracked, agent, "left_semi").join(facts.select("fact_id"), "fact_id", "left_semi").select(agent, "fact_id")


#: Agents of a scene that a task pairs with all others of it; pairs of a task, and tasks at most.
SCENE_SLICE, PAIRS_A_TASK, PAIR_TASKS = 1000, 100_000, 4096


def pair_tasks(presence: DataFrame, scene: Sequence[str], agent: str = "agent") -> int:
    """Tasks for the pairs of all scenes. Agents are few bytes and pairs many, so the number follows from the pairs."""
    sizes = presence.where(F.col(agent).isNotNull()).groupBy(*scene).agg(F.countDistinct(agent).cast("double").alias("n"))
    pairs = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    return int(min(PAIR_TASKS, max(1, -(-pairs // PAIRS_A_TASK))))


def co_presence(presence: DataFrame, scene: Sequence[str], agent: str = "agent", tasks: int | None = None) -> DataFrame:
    """scene, a, b for every pair a < b of agents of a scene, once for each scene.

    Pairs are what is asked for, n * (n - 1) / 2 in a scene of n agents. A large scene is dealt out: slices of about
    ``SCENE_SLICE`` agents each meet all others, in tasks of their own; scenes lie in ``tasks`` tasks (``pair_tasks``).
    """
    tasks = tasks or pair_tasks(presence, scene, agent)
    here = presence.select(*scene, F.col(agent).alias("a")).where(F.col(agent).isNotNull()).distinct()
    slices = here.groupBy(*scene).agg(F.ceil(F.count("*") / SCENE_SLICE).alias("_slices"))
    dealt = here.join(slices, list(scene))
    one = dealt.withColumn("_slice", F.pmod(F.xxhash64("a"), F.col("_slices"))).drop("_slices")
    other = dealt.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices").withColumnRenamed("a", "b")
    one, other = (x.repartition(tasks, *scene, "_slice") for x in (one, other))
    return one.join(other.hint("merge"), [*scene, "_slice"]).where(F.col("a") < F.col("b")).drop("_slice")


#: Facts of a block, of which a pair's row has a bit each.
FACT_BITS = 64


def _shared_facts(presence: DataFrame, scene_facts: DataFrame, told: DataFrame, scene: Sequence[str], agent: str, first: bool, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(who, target, _block, _bits for both ways of every pair of agents that share a scene with facts, _block and its _facts).

    ``told(fact_id, _sensitive)`` is numbered, and a block of ``FACT_BITS`` facts is one number. If ``first``, ``_bits`` are those of facts
    that first came up at ``first_at``, the ``at`` of a scene; a pair has a row for each such moment. If ``counted``, a pair has one
    row of n and n_secret bits.

    Where agents meet often, pairs are found by blocks and none is shuffled; where most never meet, those that do are grouped.
    """
    place = numbered(told.distinct(), ["fact_id", "_sensitive"], "_no")
    coded = place.select("fact_id", "_sensitive", F.floor((F.col("_no") - 1) / FACT_BITS).alias("_block"), F.expr(f"shiftleft(1L, cast((_no - 1) % {FACT_BITS} as int))").alias("_mask"))
    here = scene_facts.join(if_small(coded.drop("_sensitive")), "fact_id")
    moment = ["_at_no"] if first else []
    if first:
        moments = numbered(scene_facts.where(F.col("at").isNotNull()).select("at").distinct(), ["at"], "_at_no")
        here = here.join(if_small(moments), "at", "left").groupBy(*scene, "_block", "_mask").agg(F.min("_at_no").alias("_at_no"))
    held = here.groupBy(*scene, "_block", *moment).agg(F.bit_or("_mask").alias("_bits"))
    if counted:
        secret = F.coalesce(F.bit_or(F.when(F.col("_sensitive"), F.col("_mask"))), F.lit(0).cast("long"))
        held = held.join(if_small(coded.groupBy("_block").agg(secret.alias("_secret"))), "_block")
    held = kept(held)
    present = presence.join(if_small(held.select(*scene).distinct()), list(scene), "left_semi")
    size = meet_often(present, scene, agent)
    met = met_by_blocks(present, held, scene, agent, size, first, counted) if size else _met_by_grouping(present, held, scene, agent, first, counted)
    if first:
        met = met.join(if_small(moments.withColumnRenamed("at", "first_at")), "_at_no", "left")
    return met, coded.groupBy("_block").agg(F.collect_list(F.struct("_mask", "fact_id", "_sensitive")).alias("_facts"))


def _met_by_grouping(present: DataFrame, held: DataFrame, scene: Sequence[str], agent: str, first: bool, counted: bool) -> DataFrame:
    """What ``met_by_blocks`` returns, by a row for each pair, scene and block, dealt out by pairs."""
    tasks = pair_tasks(present, scene, agent)
    met = co_presence(present, scene, agent, tasks).join(if_small(held), list(scene)).drop(*scene).repartition(tasks, "a", "b")
    if first:
        earlier = Window.partitionBy("a", "b", "_block").orderBy(F.asc_nulls_last("_at_no")).rowsBetween(Window.unboundedPreceding, -1)
        known = F.coalesce(F.bit_or("_bits").over(earlier), F.lit(0).cast("long"))
        met = met.withColumn("_bits", F.col("_bits").bitwiseAND(F.bitwise_not(known))).where("_bits != 0")
    else:
        met = met.groupBy("a", "b", "_block", *(["_secret"] if counted else [])).agg(F.bit_or("_bits").alias("_bits"))
    if counted:
        n_all, n_secret = F.bit_count("_bits").cast("long"), F.bit_count(F.col("_bits").bitwiseAND(F.col("_secret"))).cast("long")
        met = met.groupBy("a", "b").agg(F.sum(n_all).alias("n"), F.sum(n_secret).alias("n_secret"))
    ways = F.array(*[F.struct(F.col(x).alias("who"), F.col(y).alias("target")) for x, y in ("ab", "ba")])
    rest = [c for c in met.columns if c not in "ab"]
    return met.select(F.explode(ways).alias("w"), *rest).select("w.*", *rest)


def _low_trust(pairs: DataFrame, trust: DataFrame | Callable[[Column, Column], Column]) -> DataFrame:
    """``pairs`` with _low: whether who trusts target too little for what is sensitive."""
    unknown = F.lit(params.DEFAULT_TRUST < params.SENSITIVE_TRUST)
    if callable(trust):
        held = pairs.withColumn("_low", trust(F.col("who"), F.col("target")) < params.SENSITIVE_TRUST)
    else:
        held = pairs.join(if_small(trust.groupBy("who", "target").agg(F.max(F.col("trust") < params.SENSITIVE_TRUST).alias("_low"))), ["who", "target"], "left")
    return held.withColumn("_low", F.coalesce("_low", unknown))


def _told(facts: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    return facts.select("fact_id", F.coalesce(F.col("category").isin(*sensitive), F.lit(False)).alias("_sensitive"))


def theory_of_mind(
    presence: DataFrame, scene_facts: DataFrame, facts: DataFrame, trust: DataFrame | Callable[[Column, Column], Column], scene: Sequence[str], agent: str = "agent", sensitive: Sequence[str] = params.SENSITIVE_CATEGORIES, first: bool = True
) -> DataFrame:
    """who, target, fact_id, verdict and, if ``first``, first_at: what each agent takes the others of its scenes to know.

    ``scene_facts``: scene, fact_id, at. ``trust(who, target, trust)``, or a function of both columns where trust follows from them;
    a missing trust is 0.5. Facts of a
    sensitive category are uncertain below a trust of 0.4. Trust holds for the whole run, so a verdict is reached
    once, with the first shared scene.

    What comes up between two agents is found with a bit for each fact; facts become rows where the pair's row lies, and nothing is
    shuffled or grouped after that.
    """
    met, blocks = _shared_facts(presence, scene_facts, _told(facts, sensitive), scene, agent, first)
    at = ["first_at"] if first else []
    each = _low_trust(met, trust).join(if_small(blocks), "_block").select("who", "target", "_low", "_bits", *at, F.explode("_facts").alias("f")).where(F.col("_bits").bitwiseAND(F.col("f._mask")) != 0)
    return each.select("who", "target", "f.fact_id", F.when(F.col("f._sensitive") & F.col("_low"), "uncertain").otherwise("knows").alias("verdict"), *at)


def theory_of_mind_counts(
    presence: DataFrame, scene_facts: DataFrame, facts: DataFrame, trust: DataFrame | Callable[[Column, Column], Column], scene: Sequence[str], agent: str = "agent", sensitive: Sequence[str] = params.SENSITIVE_CATEGORIES
) -> DataFrame:
    """``tom_rollup`` of ``theory_of_mind``, counted from a pair's bits: no fact becomes a row."""
    met, _ = _shared_facts(presence, scene_facts, _told(facts, sensitive), scene, agent, False, counted=True)
    n_facts = facts.select("fact_id").distinct().count()
    uncertain = F.when(F.col("_low"), F.col("n_secret")).otherwise(0).alias("n_uncertain")
    both = _low_trust(met, trust).select("who", "target", uncertain, "n")
    return both.select("who", "target", (F.col("n") - F.col("n_uncertain")).alias("n_knows"), "n_uncertain", (F.lit(n_facts).cast("long") - F.col("n")).alias("n_not_knows"))


def verdict_changes(tom: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """who, target, fact_id, at, verdict of ``theory_of_mind`` that are new, or differ from ``before(who, target, fact_id, verdict)``."""
    found = tom.withColumnRenamed("first_at", "at")
    return found if before is None else found.join(before.select("who", "target", "fact_id", "verdict"), ["who", "target", "fact_id", "verdict"], "left_anti")


def tom_rollup(tom: DataFrame, facts: DataFrame) -> DataFrame:
    """who, target, n_knows, n_uncertain, n_not_knows; facts without a verdict aren't known.

    The ids of what isn't known are ``knowledge_gaps`` of the pair; here the number of facts, one value, goes to
    every row.
    """
    counts = tom.groupBy("who", "target").agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("knows", "uncertain")])
    return counts.withColumn("n_not_knows", F.lit(facts.select("fact_id").distinct().count()) - F.col("n_knows") - F.col("n_uncertain"))


def info_gaps_text(per_character: DataFrame) -> DataFrame:
    """name and a text block of (name, known, wrong, gaps), arrays of strings; empty parts are left out."""

    def part(title: str, column: str):
        return F.when(F.size(column) > 0, F.concat(F.lit(title), F.array_join(column, "；")))

    body = F.concat_ws("\n", part("已知：", "known"), part("错误信念：", "wrong"), part("未知：", "gaps"))
    return per_character.select("name", F.concat(F.lit("### "), F.col("name"), F.lit("\n"), body).alias("block")).where(F.length(body) > 0)
