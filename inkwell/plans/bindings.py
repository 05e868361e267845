"""The library's operators bound to the driver's tables, each with SQL that gives the same rows.

The tables hold neither agents nor scenes, so columns stand in for them: users are agents, event types and
hours are places, documents are texts, the benchmark's passages are facts. Word lists are words that occur
in the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import env
from inkwell.functions.text import strip, typed_terms
from inkwell.operators import chapters, cognition, memory, scenes, style, timeline, world
from inkwell.operators.joins import if_small
from inkwell.sources.tables import kept, read_table, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table; texts, on which the work is in the rows, are spread over all cores where they are one small file."""
    found = read_table(spark, d, table)
    return spread(found) if table in ("documents", "conversations") else found


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_present(text: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS BIGINT)" for w in words) + ")"


def sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")" if words else "FALSE"


def sql_count(text: str, word: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, '{word}', ''))) // {len(word)} AS BIGINT)"


# --- style and quality -------------------------------------------------------------------------------

OPENS, CLOSES = ("D",), ("!", ".")
FATAL, HIGH = ("of",), ("la", "der")
LIMITS = {"of": 3, "de": 5, "the": None}
FORBIDDEN, SIMILES = ("avec", "with", "mit"), ("ou", "an", "en")
DELETABLE = ("the", "der")

SQL_LINES = r"""lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
marked AS (
  SELECT doc_id, line, raw, s, starts_with(s, 'D') AS opens,
         CASE WHEN starts_with(s, 'D') THEN 1 WHEN ends_with(s, '!') OR ends_with(s, '.') THEN 0 END AS event
  FROM (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM lines)),
stated AS (
  SELECT *, NOT opens AND coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS narrative FROM marked),
violations AS (
  SELECT doc_id, CAST(line AS INT) AS line, w AS word, 'fatal' AS severity, left(s, 80) AS context FROM stated, (VALUES ('of')) t(w) WHERE contains(raw, w)
  UNION ALL SELECT doc_id, CAST(line AS INT), w, 'high', left(s, 80) FROM stated, (VALUES ('la'), ('der')) t(w) WHERE narrative AND contains(s, w))"""


def _violations(spark: SparkSession, d: str) -> DataFrame:
    return style.line_violations(read(spark, d, "documents"), "doc_id", FATAL, HIGH, OPENS, CLOSES)


@query("style_violations", f"WITH {SQL_LINES} SELECT * FROM violations")
def style_violations(spark, d):
    return _violations(spark, d)


@query("style_gate", f"""WITH {SQL_LINES},
c AS (SELECT doc_id, count(*) FILTER (severity = 'fatal') AS n_fatal, count(*) FILTER (severity = 'high') AS n_high, CAST(0 AS BIGINT) AS n_medium FROM violations GROUP BY 1)
SELECT d.doc_id, coalesce(n_fatal, 0) AS n_fatal, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_fatal + n_high, 0) = 0 AS passed, quality
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN labels l ON l.doc_id = d.doc_id""")  # fmt: skip
def style_gate(spark, d):
    gated = style.gate(read(spark, d, "documents"), _violations(spark, d), "doc_id")
    return gated.join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("overused_words", " UNION ALL ".join(f"SELECT doc_id, '{w}' AS word, {sql_count('text', w)} AS n, {3 if a is None else a} AS allowed FROM documents WHERE {sql_count('text', w)} > {3 if a is None else a}" for w, a in LIMITS.items()))
def overused_words(spark, d):
    return style.overused(read(spark, d, "documents"), "doc_id", LIMITS)


SQL_SIMILE = "(" + " + ".join(sql_count("text", w) for w in SIMILES) + ")"


@query("quality_issues", f"""WITH t AS (SELECT *, CAST(floor(avg(n_chars) OVER (PARTITION BY lang)) AS BIGINT) AS target FROM documents),
r AS (SELECT *, length(text) / CAST(target AS DOUBLE) AS ratio FROM t)
""" + " UNION ALL ".join(f"SELECT doc_id, 'error' AS severity, 'forbidden' AS category, '{w}' AS subject, CAST({sql_count('text', w)} AS DOUBLE) AS measure, FALSE AS fixable FROM documents WHERE contains(text, '{w}')" for w in FORBIDDEN) + f"""
UNION ALL SELECT doc_id, 'warn', 'simile', 'density', CAST({SQL_SIMILE} AS DOUBLE), TRUE FROM documents WHERE {SQL_SIMILE} > 5
UNION ALL SELECT doc_id, CASE WHEN ratio < 0.5 THEN 'error' WHEN ratio < 0.7 THEN 'warn' ELSE 'info' END, 'length', 'ratio', round(ratio, 6), ratio <= 1 FROM r WHERE ratio < 0.7 OR ratio > 1.5""")  # fmt: skip
def quality_issues(spark, d):
    docs = read(spark, d, "documents")
    mean = if_small(docs.groupBy(F.col("lang").alias("_lang")).agg(F.floor(F.avg("n_chars")).alias("target")))
    return style.quality_issues(docs.join(mean, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang"), "doc_id", FORBIDDEN, SIMILES)


@query("quality_fixed", f"""WITH t AS (SELECT doc_id, {SQL_SIMILE} AS n, length(text) AS before, length(replace(text, 'an', '')) AS after, (""" + " + ".join(sql_count("replace(text, 'an', '')", w) for w in SIMILES) + """) AS m FROM documents)
SELECT doc_id, CAST('simile' AS VARCHAR) AS category FROM t WHERE n > 5 AND m <= 5 AND after >= 0.5 * before""")
def quality_fixed(spark, d):
    docs = read(spark, d, "documents").withColumn("target", F.lit(0))
    repaired = docs.withColumn("text", style.keep_longer(F.col("text"), F.replace("text", F.lit("an"), F.lit(""))))
    before, after = (style.quality_issues(x, "doc_id", FORBIDDEN, SIMILES) for x in (docs, repaired))
    return style.fixed_issues(before, after, ["doc_id", "category", "subject"]).select("doc_id", "category")


LIVELY = dict(inner=("thi", "ich", "que"), generic=("the", "der"), specific=(",", "on", "en"), shown=("sten", "wh", "oi"), temperature=("tin", "ie", "ou"), humor=("qu", "sch", "ea"), sensory=("st", "nd", "er", "tr", "ei"))


def _sql_lively() -> str:
    p = {k: sql_present("text", v) for k, v in LIVELY.items()}
    warm = "list_filter(string_split(text, chr(10)), lambda l: contains(l, 'The') OR contains(left(l, 3), 'T'))"
    s = {k: f"coalesce(list_sum(list_transform({warm}, lambda l: {sql_present('l', LIVELY[k])})), 0)" for k in ("generic", "specific")}
    window = sql_present("left(text, 2000)", LIVELY["sensory"])
    acts = r"len(regexp_extract_all(text, '[。]\s*The[^。]{2,30}[了]'))"
    irony = "len(regexp_extract_all(text, 'sich|that'))"
    rows = [
        ("'inner'", "'warn'", p["inner"], f"{p['inner']} * 3000.0 / greatest(length(text), 1) < 1.5"),
        ("'warmth'", f"CASE WHEN len({warm}) = 0 THEN 'info' ELSE 'warn' END", s["generic"], f"len({warm}) = 0 OR ({s['generic']} >= {s['specific']} AND {s['specific']} < 3)"),
        ("'shown'", "'info'", p["shown"], f"{p['shown']} < 2 AND {acts} < 3"),
        ("'temperature'", "'warn'", p["temperature"], f"{p['temperature']} < 2"),
        ("'humor'", "'info'", p["humor"], f"{p['humor']} < 3 AND {irony} < 2"),
        ("'sensory'", "'info'", window, f"{window} < 5"),
    ]
    return " UNION ALL ".join(f"SELECT doc_id, {a} AS dimension, {b} AS severity, CAST({c} AS BIGINT) AS hits FROM documents WHERE {e}" for a, b, c, e in rows)


@query("liveliness", _sql_lively())
def liveliness(spark, d):
    return style.liveliness(read(spark, d, "documents"), "doc_id", irony="sich|that", warm="The", pronoun="The", sensory_least=5, **LIVELY)


def _sql_drop(line: str, word: str) -> str:
    return f"CASE WHEN contains({line}, '{word}') THEN left({line}, instr({line}, '{word}') - 1) || substr({line}, instr({line}, '{word}') + {len(word)}) ELSE {line} END"


@query("fixed_text", f"""WITH a AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: {_sql_drop('l', 'the')}) AS ls FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(ls, lambda l: {_sql_drop('l', 'der')}), chr(10))) AS text_md5 FROM a""")
def fixed_text(spark, d):
    return style.fix_violations(read(spark, d, "documents"), "doc_id", DELETABLE).select("doc_id", F.md5("text").alias("text_md5"))


LORE_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
s AS (SELECT doc_id, line, regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^[-*] \s*', '') AS t, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS b FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM s WHERE b <> '' AND left(b, 1) NOT IN ('#', '|', '>') AND length(t) >= 4)
SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY line)) AS lore_md5, count(*) AS n_lines FROM k WHERE n <= 15 GROUP BY 1"""


@query("world_lore", LORE_SQL)
def world_lore(spark, d):
    from inkwell.sources.vault import distilled_lore

    found = distilled_lore(read(spark, d, "documents"), "doc_id")
    return found.select("doc_id", F.md5("lore").alias("lore_md5"), "n_lines")


# --- cognition ---------------------------------------------------------------------------------------

STOPS = ("the", "of", "and", "to", "in", "is", "that", "la", "le", "de", "les", "des", "et", "un", "en", "der", "die", "und", "ist", "el", "que", "los", "y")
STOP_GRAMS = ("the", "ion", "ent")
SQL_SEPARATORS = "[\\s·,.;:!?()\\[\\]{}<>“”‘’—\\-，。；、！？：''（）]+"


def sql_terms(table: str, key: str, text: str, name: str) -> str:
    tokens = f"list_filter(list_transform(string_split_regex({text}, '{SQL_SEPARATORS}'), lambda t: trim(t)), lambda t: length(t) >= 2 AND t NOT IN ({quoted(STOPS)}))"
    grams = "\n  UNION ALL ".join(
        f"SELECT key, '{k}', unnest(list_distinct(list_filter(flatten(list_transform(list_filter(ts, lambda t: length(t) > 4), lambda t: list_transform(range(1, length(t) - {n} + 2), lambda i: substr(t, CAST(i AS BIGINT), {n})))), lambda g: g NOT IN ({quoted(STOP_GRAMS)})))) FROM {name}_tokens"
        for k, n in (("b", 2), ("t", 3))
    )
    return f"""{name}_tokens AS (SELECT {key} AS key, {tokens} AS ts FROM {table}),
{name}_terms AS (SELECT key, 's' AS kind, unnest(list_distinct(list_filter(ts, lambda t: length(t) <= 4))) AS term FROM {name}_tokens
  UNION ALL {grams})"""


def sql_scores(name: str = "doc") -> str:
    return f"""sizes AS (SELECT key, count(DISTINCT term) AS n_terms FROM fact_terms GROUP BY 1),
{name}_scores AS (SELECT * FROM (
  SELECT a.key AS text_key, f.key AS fact_id, CASE WHEN n_terms <= 3 THEN 10
      WHEN count(*) FILTER (a.kind = 's' AND f.kind = 's') > 0 THEN 2 + count(*) FILTER (a.kind = 's' AND f.kind = 's')
      WHEN count(*) FILTER (a.kind = 't' AND f.kind = 't') >= 2 THEN count(*) FILTER (a.kind = 't' AND f.kind = 't') END AS score
  FROM {name}_terms a JOIN fact_terms f USING (term) JOIN sizes s ON s.key = f.key GROUP BY a.key, f.key, n_terms) WHERE score IS NOT NULL)"""


FACTS_SQL = sql_terms("benchmark", "item_id", "text", "fact")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(
        F.col("item_id").alias("fact_id"), F.col("item_id").alias("ord"), F.when(F.col("item_id") % 5 == 0, "secret").otherwise("world").alias("category"), F.col("text").alias("proposition"), (F.col("item_id") % 4 != 0).alias("truth")
    )


STOP_LISTS = dict(stop_words=STOPS, stop_ngrams=STOP_GRAMS)


@query("fact_terms", f"WITH {FACTS_SQL} SELECT key AS item_id, count(*) FILTER (kind = 's') AS n_shorts, count(*) FILTER (kind = 'b') AS n_bigrams, count(*) FILTER (kind = 't') AS n_trigrams, md5(string_agg(kind || term, ' ' ORDER BY kind, term)) AS terms_md5 FROM fact_terms GROUP BY 1")
def fact_terms(spark, d):
    terms = read(spark, d, "benchmark").select("item_id", F.explode(typed_terms(F.col("text"), STOPS, STOP_GRAMS)).alias("t")).select("item_id", "t.*")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "term"))), lambda t: F.concat(t["kind"], t["term"])), " ")
    return terms.groupBy("item_id").agg(F.count_if(F.col("kind") == "s").alias("n_shorts"), F.count_if(F.col("kind") == "b").alias("n_bigrams"), F.count_if(F.col("kind") == "t").alias("n_trigrams"), F.md5(joined).alias("terms_md5"))


@query("fact_match", f"WITH {FACTS_SQL}, {sql_terms('documents', 'doc_id', 'text', 'doc')}, {sql_scores()} SELECT text_key AS doc_id, fact_id, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY text_key ORDER BY score DESC, fact_id) AS INT) AS place FROM doc_scores")
def fact_match(spark, d):
    return cognition.matched_facts(read(spark, d, "documents"), _facts(spark, d), "doc_id", "text", **STOP_LISTS)


SQL_NORM = "regexp_replace({0}, '[^0-9A-Za-z一-鿿]', '', 'g')"


@query("belief_match", f"""WITH {FACTS_SQL}, turns AS (SELECT conv_id * 1000 + turn AS belief_id, text FROM conversations), {sql_terms('turns', 'belief_id', 'text', 'doc')}, {sql_scores()},
n AS (SELECT belief_id, text, {SQL_NORM.format('text')} AS norm FROM turns), f AS (SELECT item_id, text, {SQL_NORM.format('text')} AS norm FROM benchmark),
p AS (SELECT text_key AS belief_id, fact_id FROM doc_scores
  UNION SELECT belief_id, item_id FROM n, f WHERE trim(n.text) = trim(f.text) OR (n.norm <> '' AND f.norm <> '' AND (contains(n.norm, f.norm) OR contains(f.norm, n.norm))))
SELECT belief_id, min(fact_id) AS fact_id FROM p GROUP BY 1""")  # fmt: skip
def belief_match(spark, d):
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("belief_id"), F.col("text").alias("proposition"))
    return cognition.matched_beliefs(turns, _facts(spark, d), "belief_id", **STOP_LISTS)


KNOWN_SQL = f"""nd AS (SELECT doc_id, source, {SQL_NORM.format('text')} AS norm FROM documents), nf AS (SELECT item_id, {SQL_NORM.format('text')} AS norm FROM benchmark),
hit AS (SELECT doc_id, source, item_id FROM nd, nf WHERE nf.norm <> '' AND nd.norm <> '' AND (contains(nd.norm, nf.norm) OR contains(nf.norm, nd.norm))),
known AS (SELECT DISTINCT source, item_id FROM hit)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.struct("doc_id", "source").alias("doc"), "text")
    return cognition.contained(docs, _facts(spark, d), "doc", "text").select("doc.doc_id", "fact_id", "doc.source")


def _knowledge(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select(F.col("source").alias("agent"), "fact_id").distinct()


@query("known_facts", f"WITH {KNOWN_SQL} SELECT source AS agent, k.item_id AS fact_id, b.text AS proposition FROM known k JOIN benchmark b USING (item_id) WHERE k.item_id % 4 <> 0")
def known_facts(spark, d):
    return cognition.known_facts(_knowledge(spark, d), _facts(spark, d).where("truth")).select("agent", "fact_id", "proposition")


@query("knowledge_gaps", f"WITH {KNOWN_SQL} SELECT source AS agent, item_id AS fact_id FROM (SELECT DISTINCT source FROM documents), benchmark WHERE (source, item_id) NOT IN (SELECT (source, item_id) FROM known)")
def knowledge_gaps(spark, d):
    agents = read(spark, d, "documents").select(F.col("source").alias("agent")).distinct()
    return cognition.knowledge_gaps(agents, _facts(spark, d), _knowledge(spark, d))


@query("knowledge_snapshot", f"""WITH {KNOWN_SQL}, a AS (SELECT DISTINCT source FROM documents),
t AS (SELECT source, count(*) FILTER (item_id % 4 <> 0) AS n_known, count(*) FILTER (item_id % 4 = 0) AS n_wrong FROM known GROUP BY 1)
SELECT source AS agent, coalesce(n_known, 0) AS n_known, coalesce(n_wrong, 0) AS n_wrong, (SELECT count(*) FROM benchmark) - coalesce(n_known, 0) - coalesce(n_wrong, 0) AS n_gaps FROM a LEFT JOIN t USING (source)""")
def knowledge_snapshot(spark, d):
    agents = read(spark, d, "documents").select(F.col("source").alias("agent")).distinct()
    facts, held = _facts(spark, d), kept(_knowledge(spark, d))
    known = held.join(facts.where("truth").select("fact_id"), "fact_id")
    wrong = held.join(facts.where("not truth").select("fact_id"), "fact_id")
    gaps = cognition.knowledge_gaps(agents, facts, known, wrong)
    counts = [x.groupBy("agent").agg(F.count("*").alias(n)) for n, x in (("n_known", known), ("n_wrong", wrong), ("n_gaps", gaps))]
    for one in counts:
        agents = agents.join(one, "agent", "left")
    return agents.na.fill(0)


@query("type_a_unknown", f"WITH {KNOWN_SQL} SELECT item_id AS fact_id, text AS proposition FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM known)")
def type_a_unknown(spark, d):
    return cognition.known_to_nobody(_facts(spark, d), _knowledge(spark, d)).select("fact_id", "proposition")


@query("type_b_first", f"""WITH {KNOWN_SQL} SELECT item_id AS fact_id, first(source ORDER BY source, doc_id) AS agent, first(doc_id ORDER BY source, doc_id) AS believes FROM hit WHERE item_id % 4 = 0 GROUP BY 1""")
def type_b_first(spark, d):
    wrong = _hits(spark, d).join(_facts(spark, d).where("not truth").select("fact_id"), "fact_id").select("fact_id", F.col("source").alias("agent"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("believes"))
    return cognition.first_believers(wrong).select("fact_id", "agent", "believes")


@query("type_a_diff", f"""WITH {KNOWN_SQL}, earlier AS (SELECT DISTINCT source, item_id FROM hit WHERE doc_id < (SELECT avg(doc_id) FROM documents))
SELECT source AS agent, item_id AS fact_id FROM known WHERE (source, item_id) NOT IN (SELECT (source, item_id) FROM earlier) AND source IN (SELECT source FROM earlier)""")
def type_a_diff(spark, d):
    hits = kept(_hits(spark, d).select(F.col("source").alias("agent"), "fact_id", "doc_id"))
    middle = read(spark, d, "documents").agg(F.avg("doc_id").alias("middle"))
    before = hits.join(F.broadcast(middle)).where(F.col("doc_id") < F.col("middle")).select("agent", "fact_id").distinct()
    return cognition.newly_confirmed(hits.select("agent", "fact_id").distinct(), before, _facts(spark, d))


@query("knowledge_merge", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS best, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS born FROM events)
SELECT user_id AS agent, event_type AS fact_id, max(value) AS confidence, max(event_id) FILTER (best = 1) AS source, max(CAST(day(ts) AS INT)) FILTER (born = 1) AS confirmed_at_chapter FROM e GROUP BY 1, 2""")
def knowledge_merge(spark, d):
    return cognition.merged_knowledge(_entries(spark, d))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").alias("agent"), F.col("event_type").alias("fact_id"), F.col("value").alias("confidence"), F.col("event_id").alias("source"), F.dayofmonth("ts").alias("chapter"), F.col("event_id").alias("seq"))


@query("knowledge_new", """SELECT DISTINCT user_id AS agent, event_type AS fact_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.event_type = e.event_type AND day(o.ts) <= 10)""")
def knowledge_new(spark, d):
    entries = _entries(spark, d)
    return cognition.new_knowledge(cognition.merged_knowledge(entries), entries.where("chapter <= 10").select("agent", "fact_id").distinct()).select("agent", "fact_id")


SQL_ACTIONS = """actions AS (SELECT user_id AS agent, event_id AS seq, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) + 1 AS day, strftime(ts, '%H:%M') AS time, event_type || '@' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS location, event_type || ' ' || props AS brief, value FROM events)"""


def _actions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        F.col("user_id").alias("agent"), F.col("event_id").alias("seq"), (F.datediff(F.to_date("ts"), F.lit("2024-01-01")) + 1).alias("day"), F.date_format("ts", "HH:mm").alias("time"),
        F.concat("event_type", F.lit("@"), F.lpad(F.hour("ts").cast("string"), 2, "0")).alias("location"), F.concat("event_type", F.lit(" "), "props").alias("brief"), "value",
    )


SQL_TOM = f"""WITH {SQL_ACTIONS},
p AS (SELECT DISTINCT day, location, agent FROM actions), sf AS (SELECT DISTINCT day, location, CAST(split_part(brief, '"k": ', 2).replace('}}', '') AS BIGINT) % 20 AS fact_id FROM actions WHERE value > 20),
pr AS (SELECT a.agent AS who, b.agent AS target, fact_id, day, location, CASE WHEN (fact_id % 5 = 0) AND CASE WHEN (a.agent + b.agent) % 3 = 0 THEN 0.2 WHEN (a.agent + b.agent) % 3 = 1 THEN 0.9 ELSE 0.5 END < 0.4 THEN 'uncertain' ELSE 'knows' END AS verdict
  FROM p a JOIN p b USING (day, location) JOIN sf USING (day, location) WHERE a.agent <> b.agent AND fact_id IN (SELECT item_id FROM benchmark)),
vb AS (SELECT *, row_number() OVER (PARTITION BY who, target, fact_id ORDER BY day DESC, location DESC) AS n FROM pr)"""


def _tom(spark: SparkSession, d: str) -> tuple:
    actions = _actions(spark, d)
    number = F.regexp_extract("brief", r'"k": (\d+)', 1).cast("long") % 20
    scene_facts = actions.where("value > 20").select("day", "location", number.alias("fact_id"), F.struct("day", "location").alias("at")).distinct()

    def trust(who: Column, target: Column) -> Column:
        kind = (who + target) % 3
        return F.when(kind == 0, 0.2).when(kind == 1, 0.9)

    return actions, scene_facts, _facts(spark, d), trust, ["day", "location"], "agent", ("secret",)


@query("co_presence_tom", f"{SQL_TOM} SELECT who, target, fact_id, verdict FROM vb WHERE n = 1")
def co_presence_tom(spark, d):
    return cognition.theory_of_mind(*_tom(spark, d), first=False)


@query("tom_changes", f"{SQL_TOM}, c AS (SELECT *, lag(verdict) OVER (PARTITION BY who, target, fact_id ORDER BY day, location) AS b FROM pr) SELECT who, target, fact_id, day, location, verdict FROM c WHERE b IS NULL OR b <> verdict")
def tom_changes(spark, d):
    return cognition.verdict_changes(cognition.theory_of_mind(*_tom(spark, d))).select("who", "target", "fact_id", "at.day", "at.location", "verdict")


@query("tom_rollup", f"{SQL_TOM} SELECT who, target, count(*) FILTER (verdict = 'knows') AS n_knows, count(*) FILTER (verdict = 'uncertain') AS n_uncertain, (SELECT count(*) FROM benchmark) - count(*) AS n_not_knows FROM vb WHERE n = 1 GROUP BY 1, 2")
def tom_rollup(spark, d):
    return cognition.theory_of_mind_counts(*_tom(spark, d))


# --- scenes ------------------------------------------------------------------------------------------

PHONE, ANOMALY, NAMES, MEETING = ("1}",), ("7}",), ("view", "click", "k"), ("pur", "err")
SQL_EVENTS = SQL_ACTIONS + """, ev AS (SELECT *, 'u' || CAST(agent % 7 AS VARCHAR) || CASE WHEN value < 5 THEN '_private' ELSE '' END AS pov, CAST(agent % 3 AS VARCHAR) AS arc FROM actions)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    private = F.when(F.col("value") < 5, "_private").otherwise("")
    return _actions(spark, d).withColumn("pov", F.concat(F.lit("u"), (F.col("agent") % 7).cast("string"), private)).withColumn("arc", (F.col("agent") % 3).cast("string"))


@query("shared_scenes", f"WITH {SQL_ACTIONS} SELECT day, location, count(DISTINCT agent) AS n_agents, count(*) AS n_actions FROM actions GROUP BY 1, 2 HAVING count(DISTINCT agent) >= 2")
def shared_scenes(spark, d):
    return scenes.shared_scenes(_actions(spark, d))


@query("scene_agents", f"""WITH {SQL_ACTIONS}, f AS (SELECT day, location, agent, min(seq) AS pos FROM actions GROUP BY 1, 2, 3)
SELECT day, location, string_agg(CAST(agent AS VARCHAR), ',' ORDER BY pos) AS agents FROM f GROUP BY 1, 2 HAVING count(*) >= 2""")
def scene_agents(spark, d):
    return scenes.scene_agents(_actions(spark, d)).withColumn("agents", F.array_join("agents", ","))


SQL_SCENES = SQL_EVENTS + f""", sc AS (SELECT day, location, min(time) AS first_time, count(*) AS n_events, count(DISTINCT pov) AS n_povs, max(CAST(ends_with(pov, '_private') AS INT)) = 1 AS has_private,
  max(CAST(NOT {sql_any('brief', PHONE)} AND {sql_any('brief', NAMES)} AS INT)) = 1 AS interactive, max(CAST({sql_any('brief', ANOMALY)} AS INT)) = 1 AS anomalous FROM ev GROUP BY 1, 2),
sw AS (SELECT *, CAST(1 + 2 * CAST(interactive AS INT) + CAST(has_private AS INT) + 2 * CAST(n_povs > 1 AS INT) + CAST(anomalous AS INT) AS BIGINT) AS weight FROM sc)"""


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    return scenes.clustered(_events(spark, d), NAMES, PHONE, ANOMALY)


@query("scene_weight", f"WITH {SQL_SCENES} SELECT * FROM sw")
def scene_weight(spark, d):
    return _scenes(spark, d)


@query("spec_scenes", f"WITH {SQL_EVENTS} SELECT day, location, count(*) AS n_events, max(CAST({sql_any('brief', MEETING)} AND NOT {sql_any('brief', PHONE)} AS INT)) = 1 AS interactive, max(CAST(ends_with(pov, '_private') AS INT)) = 1 AS has_private FROM ev GROUP BY 1, 2")
def spec_scenes(spark, d):
    return scenes.spec_scenes(_events(spark, d), MEETING, PHONE)


@query("strong_days", f"WITH {SQL_SCENES} SELECT day, count(*) FILTER (weight >= 4) AS n_strong FROM sw GROUP BY 1")
def strong_days(spark, d):
    return scenes.strong_days(_scenes(spark, d), 4)


@query("chapter_split", f"WITH {SQL_ACTIONS}, dy AS (SELECT DISTINCT day FROM actions), n AS (SELECT *, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n, ntile(7) OVER (ORDER BY day DESC) AS t FROM dy) SELECT day, CAST(CASE WHEN n <= 7 THEN r ELSE 8 - t END AS INT) AS chapter FROM n")
def chapter_split(spark, d):
    return scenes.days_to_chapters(_actions(spark, d).select("day").distinct(), 7)


@query("day_ranges", f"WITH {SQL_ACTIONS}, dy AS (SELECT DISTINCT day FROM actions), n AS (SELECT *, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM dy) SELECT day, CAST(least((r - 1) // greatest(1, n // 7), 6) + 1 AS INT) AS chapter FROM n")
def day_ranges(spark, d):
    return scenes.days_by_range(_actions(spark, d).select("day").distinct(), 7)


@query("chapter_scopes", f"""WITH {SQL_SCENES}, dy AS (SELECT DISTINCT day FROM actions), n AS (SELECT *, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n, ntile(7) OVER (ORDER BY day DESC) AS t FROM dy),
a AS (SELECT day, CAST(CASE WHEN n <= 7 THEN r ELSE 8 - t END AS INT) AS chapter FROM n)
SELECT c.chapter, coalesce(count(sw.day), 0) AS n_scenes, coalesce(CAST(sum(n_events) AS BIGINT), 0) AS n_events, coalesce(max(CAST(weight >= 3 AS INT)), 0) = 1 AS has_strong, count(DISTINCT location) AS n_locations
FROM (SELECT CAST(unnest(range(1, 10)) AS INT) AS chapter) c LEFT JOIN a USING (chapter) LEFT JOIN sw USING (day) GROUP BY 1""")  # fmt: skip
def chapter_scopes(spark, d):
    assigned = scenes.days_to_chapters(_actions(spark, d).select("day").distinct(), 7)
    numbers = spark.range(1, 10).select(F.col("id").cast("int").alias("chapter"))
    found = scenes.chapter_scopes(_scenes(spark, d), assigned, numbers)
    places = F.when(F.col("locations").isNull(), 0).otherwise(F.size(F.split("locations", "、")))
    return found.withColumn("n_locations", places.cast("long")).drop("locations")


@query("mechanical_sections", f"""WITH {SQL_EVENTS}, e AS (SELECT day AS chapter, seq, pov, location, brief, row_number() OVER (PARTITION BY day ORDER BY time, seq) - 1 AS pos, count(*) OVER (PARTITION BY day) AS n FROM ev),
p AS (SELECT *, greatest(1, n // 3) AS per FROM e), s AS (SELECT *, unnest([0, 1, 2]) AS section FROM p),
k AS (SELECT * FROM s WHERE CASE WHEN section * per < n THEN pos // per = section ELSE pos >= n - per END)
SELECT chapter, CAST(section + 1 AS INT) AS section, count(*) AS n_events, string_agg('- ' || pov || ': ' || left(brief, 60), chr(10) ORDER BY pos) FILTER (pos % per < 5) AS briefs FROM k GROUP BY 1, 2""")
def mechanical_sections(spark, d):
    order = F.row_number().over(Window.partitionBy("day").orderBy("time", "seq"))
    events = _events(spark, d).withColumn("seq", order).withColumnRenamed("day", "chapter")
    return scenes.mechanical_sections(events, "chapter").drop("locations")


@query("visibility_split", f"""WITH {SQL_ACTIONS}, v AS (SELECT agent, seq, CASE WHEN agent % 2 = 0 AND value > 30 THEN value > 60 END AS visible FROM actions), m AS (SELECT *, max(CAST(visible IS NOT NULL AS INT)) OVER (PARTITION BY agent) = 1 AND NOT coalesce(visible, TRUE) AS is_private FROM v)
SELECT agent, seq, is_private, CAST(agent AS VARCHAR) || CASE WHEN is_private THEN '_private' ELSE '' END AS pov FROM m""")
def visibility_split(spark, d):
    marked = _actions(spark, d).withColumn("visible", F.when((F.col("agent") % 2 == 0) & (F.col("value") > 30), F.col("value") > 60))
    return scenes.split_by_visibility(marked).select("agent", "seq", "is_private", F.col("pov").cast("string").alias("pov"))


@query("private_observations", """SELECT 'u' || CAST(user_id AS VARCHAR) || '_private' AS pov, event_id AS seq, '观察' || event_type || '：' || props || CASE WHEN value > 50 THEN '，担忧程度 ' || CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) || '/10' ELSE '' END AS brief FROM events WHERE event_type <> 'view'""")
def private_observations(spark, d):
    seen = F.when(F.col("event_type") == "view", "").otherwise(F.col("props"))
    given = read(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("agent"), F.col("event_id").alias("seq"), F.lit(1).alias("day"), F.lit("x").alias("location"),
        F.col("event_type").alias("about"), seen.alias("observation"), F.when(F.col("value") > 50, F.floor("value") % 10).alias("concern"),
    )
    return scenes.observation_events(given).select("pov", "seq", "brief")


@query("action_briefs", """SELECT event_id, event_type || CASE WHEN value > 20 THEN '　心想：' || props ELSE '' END || CASE WHEN user_id % 3 = 0 THEN '（' || 'u' || CAST(user_id AS VARCHAR) || '）' ELSE '' END AS brief FROM events""")
def action_briefs(spark, d):
    inner = F.when(F.col("value") > 20, F.col("props"))
    warm = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise("")
    return read(spark, d, "events").select("event_id", scenes.brief_of(F.col("event_type"), inner, warm).alias("brief"))


@query("pov_labels", f"WITH {SQL_EVENTS} SELECT regexp_replace(pov, '_private$', '') AS label, count(*) AS n FROM ev GROUP BY 1")
def pov_labels(spark, d):
    return scenes.labelled(_events(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


@query("replaced_actions", """WITH a AS (SELECT conv_id, turn, role, text FROM conversations), r AS (SELECT conv_id, role FROM a WHERE turn = 1 AND conv_id % 2 = 0)
SELECT conv_id, turn, role, md5(text) AS text_md5 FROM a WHERE NOT (conv_id % 2 = 0 AND conv_id IN (SELECT conv_id FROM r))
UNION ALL SELECT conv_id, turn, role, md5('new ' || text) FROM a WHERE turn = 1 AND conv_id % 2 = 0""")
def replaced_actions(spark, d):
    talks = read(spark, d, "conversations").select(F.col("role").alias("agent"), F.col("conv_id").alias("day"), F.lit("talk").alias("location"), F.col("turn").alias("seq"), "text", F.lit(None).cast("boolean").alias("visible"))
    shared = talks.where("day % 2 = 0").select("agent", "day", "location").distinct()
    turns = talks.where("seq = 1 and day % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    out = scenes.replaced_actions(talks, shared, turns)
    return out.select(F.col("day").alias("conv_id"), F.col("seq").alias("turn"), F.col("agent").alias("role"), F.md5("text").alias("text_md5"))


# --- timelines, memories, beliefs ----------------------------------------------------------------------


@query("timeline", f"WITH {SQL_EVENTS} SELECT day, time, '[' || pov || '] ' || brief AS event, 'ch1-7' AS source, seq FROM ev")
def timeline_query(spark, d):
    return timeline.timeline_entries(_events(spark, d), "ch1-7")


@query("timeline_markdown", f"WITH {SQL_EVENTS} SELECT day, md5('## 第' || CAST(day AS VARCHAR) || '天' || chr(10) || chr(10) || '| 时间 | 事件 | 来源 |' || chr(10) || '|------|------|------|' || chr(10) || string_agg('| ' || time || ' | [' || pov || '] ' || brief || ' | ch1-7 |', chr(10) ORDER BY time, seq)) AS markdown_md5 FROM ev GROUP BY 1")
def timeline_markdown(spark, d):
    return timeline.timeline_markdown(timeline.timeline_entries(_events(spark, d), "ch1-7")).select("day", F.md5("markdown").alias("markdown_md5"))


@query("hook_ids", """SELECT user_id, event_id, 'hook_' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 4 AS VARCHAR), 3, '0') AS id FROM events""")
def hook_ids(spark, d):
    return timeline.numbered_in_groups(read(spark, d, "events"), "user_id", ["ts", "event_id"], start=4).select("user_id", "event_id", "id")


@query("hook_ledger", """WITH h AS (SELECT item_id AS seq, CASE WHEN item_id % 3 = 0 THEN 'h' || CAST(item_id AS VARCHAR) ELSE '' END AS id, text AS description FROM benchmark), n AS (SELECT *, row_number() OVER (ORDER BY seq) + 5 AS k FROM h)
SELECT seq, CASE WHEN id = '' THEN printf('hook_%03d', k) ELSE id END AS id, description, 'ch2' AS created_at FROM n WHERE id NOT IN ('h0', 'h3', 'h6', 'h9', 'h12')""")
def hook_ledger(spark, d):
    hooks = read(spark, d, "benchmark").select(F.col("item_id").alias("seq"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("h"), F.col("item_id").cast("string"))).otherwise("").alias("id"), F.col("text").alias("description"), F.lit(2).alias("created_at_chapter"))
    existing = spark.createDataFrame([(f"h{k}",) for k in (0, 3, 6, 9, 12)], "id string")
    return timeline.numbered_hooks(hooks, existing).select("seq", "id", "description", "created_at")


@query("new_hooks", """SELECT text AS description, 3 AS created_at_chapter, 'open' AS status FROM benchmark UNION ALL SELECT text, 3, 'open' FROM documents WHERE length(text) > 5 UNION ALL SELECT r_name, 3, 'open' FROM region WHERE length(r_name) > 5""")
def new_hooks(spark, d):
    hidden = read(spark, d, "benchmark").select(F.col("text").alias("description"))
    traces = read(spark, d, "documents").select(F.col("text").alias("description")).unionByName(read(spark, d, "region").select(F.col("r_name").alias("description")))
    return world.new_hooks(hidden, traces, 3)


MEMORY_SQL = """m AS (SELECT o_custkey AS agent, o_orderkey AS seq, 12 - 2 * CAST(left(o_orderpriority, 1) AS INT) AS importance, (1998 - year(o_orderdate)) * 12 + 12 - month(o_orderdate) AS age, o_orderstatus FROM orders)"""


@query("memory_topk", f"""WITH {MEMORY_SQL}, s AS (SELECT agent, seq, CASE WHEN importance >= 8 THEN 5 WHEN importance >= 5 THEN 2 ELSE 0 END + CASE WHEN age <= 2 THEN 3 WHEN age <= 5 THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS score FROM m)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY agent ORDER BY score DESC, seq) AS INT) AS place FROM s) WHERE place <= 20""")
def memory_topk(spark, d):
    return memory.retrieve(_memories(spark, d), F.lit(12 * 1998 + 12), tags=("F",)).select("agent", "seq", "score", "place")


def _memories(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(
        F.col("o_custkey").alias("agent"), F.col("o_orderkey").alias("seq"), (12 - 2 * F.left("o_orderpriority", F.lit(1)).cast("int")).alias("importance"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("created_at_chapter"),
        F.array("o_orderstatus").alias("tags"), F.when(F.col("o_orderstatus") == "P", "goal").otherwise("perception").alias("type"), F.col("o_orderkey").cast("string").alias("id"),
    )


@query("source_memories", """WITH n AS (SELECT o_custkey AS agent, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) SELECT agent, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM n WHERE k <= 3 GROUP BY 1""")
def source_memories(spark, d):
    return memory.source_memories(_memories(spark, d)).select("agent", F.array_join("source_memories", ",").alias("ids"))


@query("belief_latest", """SELECT user_id, event_type, event_id, CASE WHEN lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS NULL THEN 'active' ELSE 'revised' END AS status FROM events""")
def belief_latest(spark, d):
    return memory.superseded(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "status")


@query("belief_revision", """WITH born AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)
SELECT b.user_id AS agent, b.event_id AS seq, CASE WHEN n.event_id IS NULL THEN 'active' ELSE 'revised' END AS status, n.event_type AS revised_evidence FROM born b LEFT JOIN born n ON n.user_id = b.user_id AND n.event_type = b.event_type AND n.k = b.k + 1""")
def belief_revision(spark, d):
    updates = read(spark, d, "events").select(F.col("user_id").alias("agent"), F.col("event_id").alias("seq"), F.lit("x").alias("subject"), F.col("event_type").alias("proposition"), F.lit(0.5).alias("confidence"), F.col("event_type").alias("revises"), F.lit("").alias("evidence"))
    return memory.revised_beliefs(updates).select("agent", "seq", "status", "revised_evidence")


@query("latest_state", """SELECT user_id, event_type AS summary, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_state(spark, d):
    return memory.latest(read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("summary"), "value"), "user_id", "event_id").select("user_id", "summary", "value")


# --- world ---------------------------------------------------------------------------------------------

STAGES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")
STAGE_SQL = "list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY'], {0})"


@query("percept_filter", f"""WITH a AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS location, CAST(floor(c_acctbal / 1000) AS INT) AS phase, c_mktsegment AS stage, (c_custkey % 10) / 10.0 AS trust FROM customer),
t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 20 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS place, CAST(floor(s_acctbal / 1000) AS INT) AS min_phase, CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'MACHINERY' ELSE 'unknown' END AS min_stage, (s_suppkey % 8) / 10.0 AS min_trust, s_suppkey % 3 = 0 AS asks FROM supplier)
SELECT c_custkey, s_suppkey FROM a, t WHERE (place IS NULL OR place = location) AND phase >= min_phase AND (NOT asks OR min_trust <= 0 OR trust >= min_trust)
AND (coalesce({STAGE_SQL.format('stage')}, 0) = 0 OR coalesce({STAGE_SQL.format('min_stage')}, 0) = 0 OR {STAGE_SQL.format('stage')} >= {STAGE_SQL.format('min_stage')})""")  # fmt: skip
def percept_filter(spark, d):
    relation = F.create_map(F.lit("friend"), F.struct(F.lit("known").alias("type"), ((F.col("c_custkey") % 10) / 10.0).alias("trust")))
    agents = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("location"), F.floor(F.col("c_acctbal") / 1000).cast("int").alias("mutation_phase"), F.col("c_mktsegment").alias("perception_stage"), relation.alias("relationships"))
    stage = F.get(F.array(*[F.lit(s) for s in (*STAGES, "unknown")]), (F.col("s_suppkey") % 5).cast("int"))
    places = F.when(F.col("s_suppkey") % 20 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("s_nationkey").cast("string")))
    traces = read(spark, d, "supplier").select("s_suppkey", places.alias("locations"), F.floor(F.col("s_acctbal") / 1000).cast("int").alias("min_mutation_phase"), stage.alias("min_perception_stage"), ((F.col("s_suppkey") % 8) / 10.0).alias("min_trust"), F.when(F.col("s_suppkey") % 3 == 0, "friend").alias("requires_relationship_with"))
    return world.perceived(agents, traces, STAGES).select("c_custkey", "s_suppkey")


@query("lite_perceive", "SELECT s_suppkey AS trace_id, s_name AS description FROM supplier")
def lite_perceive(spark, d):
    return world.lite_view(read(spark, d, "supplier").select(F.col("s_suppkey").alias("trace_id"), F.col("s_name").alias("description"), F.col("s_acctbal").alias("hidden")))


PERIOD_SQL = "CASE " + " ".join(f"WHEN {{0}} < {h} THEN '{n}'" for h, n in env.PERIODS) + f" ELSE '{env.NIGHT}' END"


@query("env_calendar", f"""WITH h AS (SELECT event_id, CAST(day(ts) AS INT) AS day, CAST(hour(ts) AS DOUBLE) + floor(value) AS later FROM events), n AS (SELECT event_id, day + CAST(CASE WHEN later >= 24 THEN floor(later / 24) ELSE 0 END AS INT) AS absolute_day, CASE WHEN later >= 24 THEN later - 24 * floor(later / 24) ELSE later END AS hour FROM h)
SELECT event_id, CAST(absolute_day AS INT) AS absolute_day, hour, hour < 6 OR hour >= 19 AS is_night, {PERIOD_SQL.format('hour')} AS period, '第' || CAST(absolute_day AS VARCHAR) || '天 ' || {PERIOD_SQL.format('hour')} || ' (' || CAST(CAST(hour AS INT) AS VARCHAR) || ':00)' AS formatted FROM n""")
def env_calendar(spark, d):
    moved = env.advance(F.dayofmonth("ts"), F.hour("ts").cast("double"), F.floor("value").cast("double"))
    clock = read(spark, d, "events").select("event_id", moved.alias("t")).select("event_id", "t.*")
    return clock.withColumn("period", env.day_period(F.col("hour"))).withColumn("formatted", env.formatted(F.col("absolute_day"), F.col("hour")))


@query("region_effects", """WITH r AS (SELECT c_nationkey, CAST(count(*) % 5 AS INT) AS level FROM customer GROUP BY 1), l AS (SELECT c_nationkey, CASE WHEN c_nationkey % 6 = 0 THEN greatest(level, 3) ELSE level END AS mutation_level FROM r)
SELECT c_nationkey, mutation_level, CASE WHEN mutation_level >= 3 THEN '中断' ELSE '正常' END AS power, CASE WHEN mutation_level >= 3 THEN '中断' WHEN mutation_level >= 2 THEN '延迟' ELSE '正常' END AS communication, mutation_level < 3 AS accessible,
CASE WHEN mutation_level >= 1 THEN '紧张' ELSE '充足' END AS supply_status, CAST(CASE WHEN mutation_level >= 1 THEN least(10, 3 * mutation_level) ELSE 0 END AS INT) AS panic_level FROM l""")
def region_effects(spark, d):
    levels = read(spark, d, "customer").groupBy("c_nationkey").agg((F.count("*") % 5).cast("int").alias("level"))
    status = F.when(F.col("c_nationkey") % 6 == 0, "down").otherwise("normal")
    return world.region_states(levels.select("c_nationkey", env.level_from_status(status, F.col("level")).alias("mutation_level")))


@query("panic", """SELECT n_nationkey, CAST(CASE WHEN count(s_suppkey) FILTER (s_acctbal < 2000) > 0 THEN least(10, greatest(1, 2 * count(s_suppkey) FILTER (s_acctbal < 2000))) ELSE 0 END AS INT) AS panic FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def panic(spark, d):
    counts = read(spark, d, "supplier").where("s_acctbal < 2000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return read(spark, d, "nation").join(counts, "n_nationkey", "left").select("n_nationkey", env.panic_from_events(F.coalesce("n", F.lit(0))).alias("panic"))


@query("unusual_infrastructure", """SELECT c_nationkey, CAST('power' AS VARCHAR) AS kind, c_mktsegment AS region, status FROM (SELECT c_nationkey, c_mktsegment, CASE WHEN min(c_acctbal) < -900 THEN 'down' ELSE 'normal' END AS status FROM customer GROUP BY 1, 2) WHERE status <> 'normal'""")
def unusual_infrastructure(spark, d):
    each = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.when(F.min("c_acctbal") < -900, "down").otherwise("normal").alias("status"))
    maps = each.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "status"))).alias("regions"))
    return world.unusual_infrastructure(maps.select("c_nationkey", F.create_map(F.lit("power"), "regions").alias("infrastructure")), "c_nationkey")


CHANGES_SQL = """o AS (SELECT user_id AS agent, CASE WHEN user_id % 4 = 0 THEN 'aware' END AS stage, CASE WHEN user_id % 3 = 0 THEN 'rest' ELSE '' END AS goal, list(props ORDER BY event_id) FILTER (event_type = 'signup') AS nb, list(props ORDER BY event_id) FILTER (event_type = 'signup' AND value > 60) AS rb FROM events GROUP BY 1)"""


@query("state_changes", f"""WITH {CHANGES_SQL} SELECT agent, stage AS perception_stage, nullif(goal, '') AS goal, array_to_string(nb, ';') AS new_beliefs, array_to_string(rb, ';') AS revised_beliefs FROM o""")
def state_changes(spark, d):
    out = world.state_changes(_outputs(spark, d))
    return out.withColumns({c: F.array_join(c, ";") for c in ("new_beliefs", "revised_beliefs")})


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    update = F.struct("event_id", F.col("props").alias("proposition"), F.when(F.col("value") > 60, F.col("props")).otherwise("").alias("revises"))
    held = F.sort_array(F.collect_list(F.when(F.col("event_type") == "signup", update)))
    return read(spark, d, "events").groupBy(F.col("user_id").alias("agent")).agg(held.alias("belief_updates")).select("agent", "belief_updates", F.when(F.col("agent") % 4 == 0, "aware").alias("perception_stage_update"), F.when(F.col("agent") % 3 == 0, "rest").otherwise("").alias("goal_immediate"))


@query("character_updates", f"""WITH {CHANGES_SQL} SELECT agent, '1-7' AS chapter, coalesce('信念修正：' || array_to_string(rb, '、'), nb[1], '(状态更新)') AS summary, goal, stage AS perception_stage FROM o""")
def character_updates(spark, d):
    return world.character_updates(world.state_changes(_outputs(spark, d)), 1, 7)


# --- chapters --------------------------------------------------------------------------------------------


@query("character_clamp", """WITH s AS (SELECT user_id, event_type, list(CAST(floor(value) AS BIGINT) % 5 - 2 ORDER BY event_id) AS ds FROM events GROUP BY 1, 2)
SELECT user_id, event_type, list_reduce(list_prepend(CAST(3 AS BIGINT), ds), lambda v, x: greatest(1, least(5, v + x))) AS value, len(ds) AS n_changes FROM s""")
def character_clamp(spark, d):
    impacts = read(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), (F.floor("value") % 5 - 2).alias("delta"))
    return chapters.clamped(impacts, ["user_id", "event_type"], F.lit(3))


@query("turn_context", """SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 4000), '') AS context FROM conversations""")
def turn_context(spark, d):
    return chapters.chained_context(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "context")


@query("length_hints", """SELECT doc_id, CAST(greatest(150, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 700 ELSE 2 * (n_chars // 5) END ELSE n_chars // 5 END) AS BIGINT) AS hint FROM documents""")
def length_hints(spark, d):
    words = F.when(F.col("doc_id") % 2 == 0, 700)
    return read(spark, d, "documents").select("doc_id", chapters.length_hint(F.col("n_chars"), F.lit(5), F.col("doc_id") % 3 == 0, words).alias("hint"))


@query("merged_conversation", r"""SELECT conv_id, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (t <> ''), '')) AS merged_md5 FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations) GROUP BY 1""")
def merged_conversation(spark, d):
    return chapters.merged_texts(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", F.md5("merged").alias("merged_md5"))


SQL_SECTIONS = """se AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE CASE WHEN turn % 4 = 2 THEN left(text, 12) ELSE text END END AS description, CASE WHEN role = 'user' THEN NULL ELSE text END AS tension, CASE WHEN role = 'assistant' THEN 'expanded' ELSE 'normal' END AS weight, CASE WHEN turn > 2 THEN text END AS expanded FROM conversations)"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("turn") % 4
    return read(spark, d, "conversations").select(
        F.col("conv_id").alias("spec_id"), F.col("turn").alias("section"), F.when(kind == 3, "").when(kind == 2, F.left("text", F.lit(12))).otherwise(F.col("text")).alias("description"),
        F.when(F.col("role") != "user", F.col("text")).alias("tension_direction"), F.when(F.col("role") == "assistant", "expanded").otherwise("normal").alias("weight"), F.when(F.col("turn") > 2, F.col("text")).alias("expanded_direction"),
    )


NEGATIVE = ("tion", "ung")


@query("section_rules", rf"""WITH {SQL_SECTIONS}, t AS (SELECT conv_id AS spec_id, turn AS section, weight, regexp_replace(description, '^\s+|\s+$', '', 'g') AS de, regexp_replace(coalesce(tension, ''), '^\s+|\s+$', '', 'g') AS te, regexp_replace(coalesce(expanded, ''), '^\s+|\s+$', '', 'g') AS ex FROM se)
SELECT spec_id, section, 'ERROR' AS severity, 'empty_description' AS rule FROM t WHERE de = ''
UNION ALL SELECT spec_id, section, 'WARN', 'short_description' FROM t WHERE de <> '' AND length(de) < 20
UNION ALL SELECT spec_id, section, 'WARN', 'missing_tension' FROM t WHERE te = ''
UNION ALL SELECT spec_id, section, 'WARN', 'negative_tension' FROM t WHERE {sql_any('te', NEGATIVE)}
UNION ALL SELECT spec_id, section, 'WARN', 'missing_expanded_direction' FROM t WHERE weight = 'expanded' AND ex = ''""")
def section_rules(spark, d):
    return chapters.section_issues(_sections(spark, d), negative=NEGATIVE)


@query("spec_rules", f"""WITH {SQL_SECTIONS}, n AS (SELECT conv_id AS spec_id, CAST(conv_id % 5 AS INT) AS chapter, CAST(conv_id % 7 * 300 AS INT) AS target, count(*) AS n, count(*) FILTER (contains(description, 'on') OR contains(coalesce(tension, ''), 'on')) AS k FROM se GROUP BY 1, 2, 3)
SELECT spec_id, 'WARN' AS severity, 'tight_sections' AS rule FROM n WHERE target > 0 AND target < 400 * n AND n >= 4
UNION ALL SELECT spec_id, 'ERROR', 'chapter_order' FROM n WHERE chapter <> 3
UNION ALL SELECT spec_id, 'WARN', 'anomaly_density' FROM n WHERE chapter <= 3 AND k > 3""")
def spec_rules(spark, d):
    sections = _sections(spark, d)
    specs = sections.select("spec_id").distinct().select("spec_id", (F.col("spec_id") % 5).cast("int").alias("chapter"), (F.col("spec_id") % 7 * 300).cast("int").alias("target_chars"))
    signal = F.col("description").contains("on") | F.coalesce("tension_direction", F.lit("")).contains("on")
    return chapters.spec_issues(sections, specs, spark.createDataFrame([(1,), (2,)], "chapter int"), anomalous=signal)


@query("day_continuity", """WITH c AS (SELECT o_custkey AS novel, year(o_orderdate) - 1991 AS chapter, CAST(max(dayofyear(o_orderdate)) AS INT) AS day FROM orders GROUP BY 1, 2), w AS (SELECT *, lag(chapter) OVER (PARTITION BY novel ORDER BY chapter) AS b, lag(day) OVER (PARTITION BY novel ORDER BY chapter) AS bd FROM c)
SELECT novel, CAST(chapter AS INT) AS chapter, CASE WHEN chapter > 1 AND (b IS NULL OR b <> chapter - 1) THEN 'missing_previous' ELSE 'day_not_after' END AS warning FROM w WHERE (chapter > 1 AND (b IS NULL OR b <> chapter - 1)) OR day <= bd""")
def day_continuity(spark, d):
    states = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("novel"), (F.year("o_orderdate") - 1991).alias("chapter")).agg(F.max(F.dayofyear("o_orderdate")).alias("absolute_day"))
    return chapters.continuity_warnings(states)


@query("chapter_summary", """WITH s AS (SELECT conv_id AS chapter, turn AS ord, role AS subject, text AS description, CASE WHEN turn > 0 THEN role ELSE '' END AS tension FROM conversations),
h AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY ord) AS k FROM s WHERE contains(description, 'the') OR contains(description, 'der'))
SELECT s.chapter, md5(string_agg('- ' || subject || '：' || left(description, 120), chr(10) ORDER BY ord) FILTER (description <> '')) AS events_md5, first(tension ORDER BY ord) FILTER (tension <> '') AS tension,
coalesce((SELECT string_agg(left(h.description, 60), chr(10) ORDER BY h.ord) FROM h WHERE h.chapter = s.chapter AND k <= 2), '') AS hints FROM s GROUP BY s.chapter""")
def chapter_summary(spark, d):
    sections = read(spark, d, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("ord"), F.col("role").alias("subject"), F.col("text").alias("description"), F.when(F.col("turn") > 0, F.col("role")).otherwise("").alias("tension_direction"))
    return chapters.chapter_summary(sections, "chapter", ("the", "der")).select("chapter", F.md5("key_events").alias("events_md5"), "tension", "hints")


@query("character_profiles", """WITH f AS (SELECT c_custkey, min(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT CAST(f.c_custkey AS VARCHAR) AS name, coalesce(o_orderstatus, '未知') AS location FROM f LEFT JOIN orders ON o_orderkey = k""")
def character_profiles(spark, d):
    states = read(spark, d, "orders").select(F.col("o_orderkey").alias("chapter"), F.col("o_custkey").cast("string").alias("name"), F.col("o_orderstatus").alias("location"))
    return chapters.profiles(read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("name")), states, "未知")


@query("restored_agents", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'saved' ELSE c_name END AS c_name, c_mktsegment FROM customer""")
def restored_agents(spark, d):
    agents = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    saved = agents.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "saved").otherwise("").alias("c_name"))
    return chapters.restored(agents, saved, "c_custkey", ["c_name"])


@query("chapter_upsert", """SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS state FROM orders""")
def chapter_upsert(spark, d):
    old = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("state"))
    return timeline.upserted(old, old.where("o_orderkey % 2 = 0").withColumn("state", F.lit("new")), ["o_custkey", "o_orderkey"])


@query("cast_names", """SELECT CAST(o_custkey AS VARCHAR) AS key, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS name, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def cast_names(spark, d):
    from inkwell.sources.config import resolved_names

    cast = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"))
    uses = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"))
    return resolved_names(uses, cast).groupBy("key", "name").agg(F.count("*").alias("n"))


@query("term_overlap", f"""WITH {FACTS_SQL}, a AS (SELECT a.key AS left_id, b.key AS right_id, count(*) AS n_shared FROM fact_terms a JOIN fact_terms b ON a.kind = b.kind AND a.term = b.term AND a.key < b.key GROUP BY 1, 2) SELECT * FROM a""")
def term_overlap(spark, d):
    terms = cognition.exploded_terms(read(spark, d, "benchmark"), "item_id", "text", **STOP_LISTS)
    a, b = terms.withColumnRenamed("item_id", "left_id"), terms.withColumnRenamed("item_id", "right_id")
    return a.join(b, ["kind", "term"]).where("left_id < right_id").groupBy("left_id", "right_id").agg(F.count("*").alias("n_shared"))


@query("table_rows", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
c AS (SELECT doc_id, line, list_transform(string_split(raw, '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS cells FROM l WHERE contains(raw, '|') AND NOT starts_with(regexp_replace(raw, '^\s+', ''), '|') AND NOT ends_with(regexp_replace(raw, '\s+$', ''), '|'))
SELECT doc_id, CAST(line AS INT) AS line, CAST(len(cells) AS INT) AS n_cells, cells[1] AS first_cell, cells[-1] AS last_cell FROM c""")
def table_rows(spark, d):
    from inkwell.sources.vault import table_cells

    bare = ~strip(F.col("raw")).startswith("|") & ~strip(F.col("raw")).endswith("|")
    lines = style.document_lines(read(spark, d, "documents"), "doc_id").where(F.col("raw").contains("|") & bare)
    found = table_cells(lines.withColumn("raw", F.concat(F.lit("| "), "raw", F.lit(" |"))))
    return found.select("doc_id", "line", F.size("cells").alias("n_cells"), F.col("cells")[0].alias("first_cell"), F.element_at("cells", -1).alias("last_cell"))
