"""Readers, renderers and stored state bound to the driver's tables.

A note, a table in Markdown, a JSON state or a model's reply is written from a table's columns and read back by
the library's readers; the SQL takes the same columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import env, text
from inkwell.operators import chapters, cognition, render, scenes, timeline, world
from inkwell.plans import specs
from inkwell.plans.bindings import SQL_EVENTS, SQL_SCENES, _events, _scenes, query, read
from inkwell.sources import store, vault
from inkwell.sources.frontmatter import with_frontmatter
from inkwell.sources.model_json import reply_json


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(rows: DataFrame, key: str, order, line) -> DataFrame:
    """key, value: the rows' lines in order, as one text."""
    held = F.sort_array(F.collect_list(F.struct(order.alias("at"), line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(held, lambda r: r["line"]), "\n").alias("value"))


# --- notes -----------------------------------------------------------------------------------------------


@query("frontmatter", """SELECT c_custkey, c_name AS name, c_acctbal AS balance, c_nationkey AS nation, c_custkey % 2 = 0 AS active, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment,
CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2 END AS INT) AS n_tags, 'ch' || CAST(c_custkey % 7 AS VARCHAR) AS last_chapter FROM customer WHERE c_custkey % 11 <> 0
UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, -1, NULL FROM customer WHERE c_custkey % 11 = 0""")  # fmt: skip
def frontmatter(spark, d):
    k = F.col("c_custkey")
    segment = F.when(k % 3 == 0, "null").otherwise(_text("'", F.col("c_mktsegment"), "'"))
    tags = F.when(k % 5 == 0, "[]").otherwise("[one, 'two']")
    head = _text('---\nname: "', F.col("c_name"), '"\nbalance: ', F.col("c_acctbal"), "\nnation: ", F.col("c_nationkey"), "\nactive: ", k % 2 == 0, "\nnested:\n  segment: ", segment, "\n  tags: ", tags)
    history = _text("\nhistory:\n  - chapter: early\n    summary: s\n  - chapter: ch", k % 7, "\n    summary: t\n---\nbody: no")
    notes = read(spark, d, "customer").select("c_custkey", F.when(k % 11 == 0, "no head\n---\nname: x\n---").otherwise(F.concat(head, history)).alias("value"))
    schema = "name string, balance double, nation int, active boolean, nested struct<segment:string,tags:array<string>>, history array<struct<chapter:string,summary:string>>"
    m = with_frontmatter(notes, schema)
    return m.select("c_custkey", "meta.name", "meta.balance", "meta.nation", "meta.active", "meta.nested.segment", F.coalesce(F.size("meta.nested.tags"), F.lit(-1)).alias("n_tags"), F.element_at("meta.history", -1)["chapter"].alias("last_chapter"))


@query("timeline_notes", f"WITH {SQL_EVENTS} SELECT day, time, '[' || pov || '] ' || brief AS event, 'ch1-7' AS source FROM ev")
def timeline_notes(spark, d):
    """What ``timeline_markdown`` writes is read back."""
    written = timeline.timeline_markdown(timeline.timeline_entries(_events(spark, d), "ch1-7")).select(F.col("day").alias("note"), F.col("markdown").alias("value"))
    return vault.timeline(written, "note").select("day", "time", "event", "source")


@query("open_hooks", """SELECT o_custkey, 'h' || CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority || '|x' AS description, 'ch' || CAST(year(o_orderdate) AS VARCHAR) AS created_at,
CASE WHEN o_orderkey % 2 = 0 THEN 'ch' || CAST(year(o_orderdate) AS VARCHAR) ELSE 'late' END AS last_touched, o_orderstatus AS type FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 13 <> 0""")
def open_hooks(spark, d):
    k = F.col("o_orderkey")
    created = _text("ch", F.year("o_orderdate"))
    kind = F.when(k % 13 == 0, "").otherwise(F.col("o_orderstatus"))  # a hook without a type is left out
    row = _text("| h", k, " | ", F.col("o_orderpriority"), "\\|x | ", created, " | ", F.when(k % 2 == 0, "").otherwise("late"), " | ", kind, " |")
    orders = read(spark, d, "orders")
    head = "\n| ID | 伏笔 | 创建章 | 最后接触 | 类型 |\n|----|:--|--:|----|----|\n"
    open_, closed = (_lines(orders.where(c), "o_custkey", k, row).withColumnRenamed("value", n) for c, n in (("o_orderstatus <> 'F'", "open"), ("o_orderstatus = 'F'", "closed")))
    notes = open_.join(closed, "o_custkey", "full").select("o_custkey", F.concat_ws("\n", F.concat(F.lit("# 伏笔\n## 开放中" + head), F.coalesce("open", F.lit(""))), F.concat(F.lit("## 已回收" + head), F.coalesce("closed", F.lit("")))).alias("value"))
    return vault.open_hooks(notes, "o_custkey").drop("line")


@query("truth_table", """SELECT s_nationkey, 'T' || CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'world' ELSE '' END AS category, s_name || ' a|b' AS proposition, s_suppkey % 4 <> 0 AS truth FROM supplier WHERE s_suppkey % 9 <> 0""")
def truth_table(spark, d):
    k = F.col("s_suppkey")
    fact = _text("| T", k, " | ", F.when(k % 2 == 0, "world").otherwise(""), " | ", F.col("s_name"), " a\\|b | ", F.when(k % 8 == 0, "FALSE").when(k % 4 == 0, "假").when(k % 3 == 0, "").otherwise("true"), " |")
    row = F.when(k % 9 == 0, _text("| T", k, " | too short |")).otherwise(fact)
    notes = _lines(read(spark, d, "supplier"), "s_nationkey", k, row).select("s_nationkey", F.concat(F.lit("# facts\n| id | 类别 | 命题 | 真 |\n|---|---|---|---|\n"), "value").alias("value"))
    return vault.truth_table(notes, "s_nationkey").drop("ord")


@query("character_bible", """SELECT s_nationkey, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'later ' || CAST(s_suppkey AS VARCHAR) ELSE 'of ' || CAST(s_suppkey AS VARCHAR) || chr(10) || '### part' END AS body FROM supplier""")
def character_bible(spark, d):
    k = F.col("s_suppkey")
    first = read(spark, d, "supplier").select("s_nationkey", F.struct(F.lit(0), k).alias("at"), _text("## ", F.col("s_name"), "（lead）\nof ", k, "\n### part\n").alias("line"))
    again = read(spark, d, "supplier").where(k % 3 == 0).select("s_nationkey", F.struct(F.lit(1), k).alias("at"), _text("## ", F.col("s_name"), "\n\nlater ", k, " \n").alias("line"))
    notes = _lines(first.unionByName(again), "s_nationkey", F.col("at"), F.col("line"))
    return vault.character_bible(notes.withColumn("value", F.concat(F.lit("intro\n"), "value")), "s_nationkey")


# --- stored state and replies ------------------------------------------------------------------------------

MEMORIES_SQL = """m AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq FROM orders WHERE o_custkey % 10 <> 0)"""


def _states(spark, d: str) -> DataFrame:
    """Agents' states as JSON texts; one in ten is cut off."""
    memory = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("content"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("importance"))
    held = read(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", memory.alias("m"), "o_orderstatus", "o_totalprice"))).alias("all"))
    known = F.map_from_entries(F.transform(F.col("all"), lambda r: F.struct(r["m"]["id"], F.struct(r["o_totalprice"].alias("confidence"), r["o_orderstatus"].alias("source"), F.lit(1).alias("confirmed_at_chapter")))))
    state = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("name"), F.transform("all", lambda r: r["m"]).alias("memories"), known.alias("knowledge"), F.when(F.col("o_custkey") % 3 == 0, "calm").alias("emotional_state")))
    return held.select(F.when(F.col("o_custkey") % 10 == 0, F.left(state, F.lit(20))).otherwise(state).alias("value"))


@query("stored_memories", f"WITH {MEMORIES_SQL} SELECT CAST(o_custkey AS VARCHAR) AS agent, CAST(seq AS INT) AS seq, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS content, CAST(left(o_orderpriority, 1) AS INT) AS importance FROM m")
def stored_memories(spark, d):
    return store.memories_of(store.states_of(_states(spark, d))).select("agent", "seq", "id", "content", "importance")


@query("stored_knowledge", "SELECT CAST(o_custkey AS VARCHAR) AS agent, CAST(o_orderkey AS VARCHAR) AS fact_id, o_totalprice AS confidence, o_orderstatus AS source, CAST(1 AS INT) AS confirmed_at_chapter FROM orders WHERE o_custkey % 10 <> 0")
def stored_knowledge(spark, d):
    return store.knowledge_of(store.states_of(_states(spark, d)))


@query("stored_moods", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS name, CASE WHEN o_custkey % 3 = 0 THEN 'calm' ELSE '平静' END AS emotional_state, CAST(0 AS INT) AS mutation_phase FROM orders WHERE o_custkey % 10 <> 0")
def stored_moods(spark, d):
    return store.states_of(_states(spark, d)).select("name", "emotional_state", "mutation_phase")


@query("reply_objects", """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS role, CASE WHEN turn % 5 = 4 THEN NULL ELSE turn END AS n, CASE WHEN turn % 5 IN (3, 4) THEN NULL ELSE 'a "b" }' END AS told FROM conversations""")
def reply_objects(spark, d):
    """Replies that are an object, have it in a fence or in prose, are cut off, or have none."""
    whole = _text('{"role": "', F.col("role"), '", "n": ', F.col("turn"), ', "told": "a \\"b\\" }"}')
    cut = _text('{"role": "', F.col("role"), '", "n": ', F.col("turn"), ', "told": "a \\"b')
    kind = F.col("turn") % 5
    reply = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("so it is: "), whole, F.lit(" as asked"))).when(kind == 3, cut).otherwise("I can't say.")
    found = read(spark, d, "conversations").select("conv_id", "turn", F.from_json(reply_json(reply), "role string, n long, told string").alias("o"))
    return found.select("conv_id", "turn", "o.role", "o.n", "o.told")


@query("json_rows", """SELECT CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey}) AS VARCHAR) AS value FROM customer""")
def json_rows(spark, d):
    return store.as_json(read(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"])


# --- worlds, views and specs ---------------------------------------------------------------------------------


@query("world_structure", """SELECT n_nationkey, n_name AS government, CASE WHEN n_nationkey % 3 = 0 THEN 'quiet' ELSE 'news ' || n_name END AS media, CAST(CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 1 END AS INT) AS n_traces, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS hidden FROM nation""")
def world_structure(spark, d):
    """Defaults where a world lacks a part, then its public, visible and hidden sides."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    given = read(spark, d, "nation").select(
        "n_nationkey", name.alias("government"), F.when(k % 3 != 0, F.concat(F.lit("news "), name)).alias("media"), F.lit("calm").alias("public_sentiment"), F.create_map(F.lit("power"), name).alias("infrastructure"),
        F.when(k % 4 != 0, F.array(name)).alias("public_traces"), F.when(k % 5 != 0, F.array(name)).alias("hidden_truths"),
    )
    whole = world.or_fallback(given, {"media": F.lit("quiet")})
    sides = world.structured_world(whole.drop("n_nationkey")).select("public.government", "public.media", F.size("traces").alias("n_traces"), F.array_join("hidden", ";").alias("hidden"))
    return sides.join(given.select("n_nationkey", "government"), "government")


@query("view_texts", """SELECT c_nationkey AS agent, '## 你察觉到的一些异常' || chr(10) || string_agg('- ' || c_mktsegment, chr(10) ORDER BY c_mktsegment) AS text FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY 1""")
def view_texts(spark, d):
    return render.view_text(read(spark, d, "customer").select(F.col("c_nationkey").alias("agent"), F.col("c_mktsegment").alias("description")))


@query("world_texts", """SELECT n_regionkey AS arc_id, '## 媒体' || chr(10) || first(n_name ORDER BY n_nationkey) || chr(10) || chr(10) || '## 公众' || chr(10) || array_to_string(list_transform(list(n_name ORDER BY n_nationkey)[1:3], lambda x: '- ' || x), chr(10)) AS text FROM nation GROUP BY 1""")
def world_texts(spark, d):
    held = read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("arc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: r["n_name"]).alias("public_events"))
    return render.world_text(held.select("arc_id", F.get("public_events", F.lit(0)).alias("media"), "public_events", F.array().cast("array<string>").alias("traces")))


@query("issue_texts", """WITH i AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'info' WHEN 'click' THEN 'warn' ELSE 'error' END AS severity, event_type AS category, lpad(CAST(event_id AS VARCHAR), 9, '0') AS subject, CAST(floor(value) AS BIGINT) AS measure FROM events)
SELECT user_id, md5(string_agg('[' || severity || '] ' || category || ' ' || subject || ': ' || CAST(measure AS VARCHAR), chr(10) ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, category, subject)) AS text_md5 FROM i GROUP BY 1""")
def issue_texts(spark, d):
    severity = F.when(F.col("event_type") == "view", "info").when(F.col("event_type") == "click", "warn").otherwise("error")
    issues = read(spark, d, "events").select("user_id", severity.alias("severity"), F.col("event_type").alias("category"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("subject"), F.floor("value").cast("long").alias("measure"))
    return render.issues_text(issues, "user_id").select("user_id", F.md5("text").alias("text_md5"))


@query("trajectory_notes", f"""WITH {SQL_EVENTS}, r AS (SELECT pov, regexp_replace(pov, '_private$', '') AS label, string_agg('| 第' || CAST(day AS VARCHAR) || '天 | ' || time || ' | ' || location || ' | ' || CASE WHEN ends_with(pov, '_private') THEN '🔒 ' ELSE '' END || brief || ' |', chr(10) ORDER BY seq) AS body FROM ev GROUP BY 1)
SELECT pov, md5('## ' || label || ' 的行动线' || chr(10) || chr(10) || '| 天 | 时间 | 地点 | 事件 |' || chr(10) || '|----|------|------|------|' || chr(10) || body) AS markdown_md5 FROM r""")
def trajectory_notes(spark, d):
    return timeline.trajectory_markdown(scenes.labelled(_events(spark, d))).select("pov", F.md5("markdown").alias("markdown_md5"))


@query("designer_context", """WITH u AS (SELECT c_nationkey, 'power ' || c_mktsegment || ': down' AS line FROM customer GROUP BY 1, c_mktsegment HAVING min(c_acctbal) < -900),
b AS (SELECT user_id % 25 AS k, user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT c_nationkey AS arc_id, CAST(0 AS INT) AS part, line FROM u UNION ALL SELECT k, 1, CAST(user_id AS VARCHAR) || ': ' || props FROM b WHERE n <= 2 UNION ALL SELECT DISTINCT user_id % 25, 2, event_type FROM events""")
def designer_context(spark, d):
    each = read(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("arc_id"), "c_mktsegment").agg(F.when(F.min("c_acctbal") < -900, "down").otherwise("normal").alias("status"))
    ticks = each.groupBy("arc_id").agg(F.create_map(F.lit("power"), F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "status")))).alias("infrastructure"))
    events = read(spark, d, "events").select((F.col("user_id") % 25).alias("arc_id"), F.col("user_id").alias("agent"), F.col("event_id").alias("seq"), F.col("props").alias("proposition"), F.col("event_type").alias("event"))
    return specs.context_lines(ticks, events, events)


@query("fact_caps", "SELECT user_id, event_id, CAST(place AS INT) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 8")
def fact_caps(spark, d):
    return chapters.first_of(read(spark, d, "events").withColumn("order", -F.col("value")), "user_id", ["order", "event_id"], 8).select("user_id", "event_id", "place")


@query("chapter_days", f"""WITH {SQL_EVENTS}, c AS (SELECT arc, day, 1 + (day - 1) // 5 AS chapter FROM ev) SELECT arc, CAST(chapter AS INT) AS chapter, min(day) AS first_day, max(day) AS last_day, count(*) AS n_events FROM c GROUP BY 1, 2""")
def chapter_days(spark, d):
    return chapters.day_spans(_events(spark, d).withColumn("chapter", F.floor((F.col("day") - 1) / 5 + 1).cast("int")), ["arc", "chapter"])


STRONG = "list_filter(range(CASE WHEN {0} = 0 THEN 0 ELSE ends[{0}] END, ends[{0} + 1]), lambda d: strong[d + 1] >= 1)"

#: The cuts move one chapter at a time; a row of ``r`` is an arc after k chapters.
REPAIRED_SQL = f"""WITH RECURSIVE {SQL_SCENES}, sd AS (SELECT day, count(*) FILTER (weight >= 6) AS n_strong FROM sw GROUP BY 1),
ad AS (SELECT arc, day, n_strong, row_number() OVER (PARTITION BY arc ORDER BY day) - 1 AS i FROM (SELECT DISTINCT arc, day FROM ev) JOIN sd USING (day)),
l AS (SELECT arc, list(n_strong ORDER BY day) AS strong, count(*) AS n FROM ad GROUP BY 1),
r AS (SELECT arc, strong, list_transform(range(1, 8), lambda k: CASE WHEN n <= 7 THEN least(k, n) ELSE k * (n // 7) + greatest(0, k - 7 + n % 7) END) AS ends, CAST(0 AS BIGINT) AS k FROM l
  UNION ALL SELECT arc, strong, CASE WHEN len({STRONG.format('k')}) = 0 AND donor IS NOT NULL THEN list_concat(list_append(ends[1:k], donor + 1), ends[k + 2:]) ELSE ends END, k + 1
  FROM (SELECT *, list_filter(list_transform(range(k + 1, 7), lambda j: list_filter(range(ends[j], ends[j + 1]), lambda d: strong[d + 1] >= 1)), lambda s: len(s) >= 2)[1][1] AS donor FROM r WHERE k < 6))
SELECT arc, day, CAST(list_position(list_transform(ends, lambda e: e > i), true) AS INT) AS chapter FROM ad JOIN r USING (arc) WHERE k = 6"""


@query("repaired_split", REPAIRED_SQL)
def repaired_split(spark, d):
    found = _events(spark, d).select("arc", "day").distinct().join(scenes.strong_days(_scenes(spark, d), 6), "day")
    return scenes.repaired_chapters(found, 7)


# --- scalar functions, clocks and places ----------------------------------------------------------------------

WHITE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query("stripped_texts", f"SELECT doc_id, md5(regexp_replace(text, '^{WHITE}|{WHITE}$', '', 'g')) AS text_md5, regexp_replace(lang, '^{WHITE}|{WHITE}$', '', 'g') AS lang FROM documents")
def stripped_texts(spark, d):
    """White space of every kind at either end goes; what is inside stays."""
    docs = read(spark, d, "documents")
    wrapped = F.concat(F.lit("\u3000 \t"), F.col("text"), F.lit("\n\u00a0\u3000"))
    return docs.select("doc_id", F.md5(text.strip(wrapped)).alias("text_md5"), text.blank_to_null(F.concat(F.lit("\u2003"), F.col("lang"))).alias("lang"))


@query("first_numbers", "SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS BIGINT) AS number, TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) AS of_source FROM documents")
def first_numbers(spark, d):
    return read(spark, d, "documents").select("doc_id", text.first_number(F.col("text")).alias("number"), text.first_number(F.col("source"), r"(\d+)$").alias("of_source"))


@query("scalar_kinds", """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'null' WHEN 1 THEN 'boolean' WHEN 4 THEN 'long' WHEN 5 THEN 'double' WHEN 7 THEN 'double' ELSE 'string' END AS kind,
CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN c_name WHEN 3 THEN CAST(c_custkey AS VARCHAR) WHEN 4 THEN CAST(-c_custkey AS VARCHAR) WHEN 5 THEN CAST(c_custkey AS VARCHAR) || '.25' WHEN 6 THEN c_mktsegment ELSE '1e5' END AS value FROM customer""")
def scalar_kinds(spark, d):
    k = F.col("c_custkey")
    kinds = ["  null ", "True", _text("'", F.col("c_name"), "'"), _text('"', k, '"'), _text("-", k), _text(" ", k, ".25"), F.col("c_mktsegment"), "1e5"]
    raw = F.coalesce(*[F.when(k % 8 == i, v) for i, v in enumerate(kinds)])
    return read(spark, d, "customer").select("c_custkey", text.typed_scalar(raw).alias("s")).select("c_custkey", "s.kind", "s.value")


_PERIOD = "CASE " + " ".join(f"WHEN hour < {limit} THEN '{name}'" for limit, name in env.PERIODS) + f" ELSE '{env.NIGHT}' END"


@query("clock_views", f"""WITH c AS (SELECT event_id, 1 + event_id // 48 AS absolute_day, (event_id % 48) / 2.0 AS hour FROM events)
SELECT event_id, absolute_day, {_PERIOD} AS period, CAST(hour AS DOUBLE) AS hour, hour < 6 OR hour >= 19 AS is_night, '第' || CAST(absolute_day AS VARCHAR) || '天 ' || {_PERIOD} || ' (' || CAST(CAST(round_even(hour, 0) AS INT) AS VARCHAR) || ':00)' AS formatted FROM c""")
def clock_views(spark, d):
    day, hour = (F.floor(F.col("event_id") / 48) + 1).cast("long"), F.col("event_id") % 48 / 2.0
    return read(spark, d, "events").select("event_id", render.clock_struct(day, hour).alias("c")).select("event_id", "c.*")


@query("place_states", f"""SELECT n_name AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'cut' ELSE '{env.NORMAL}' END AS power, CASE WHEN n_nationkey % 2 = 0 THEN 'slow' ELSE '{env.NORMAL}' END AS communication, n_nationkey % 2 <> 0 AS accessible,
CASE WHEN n_nationkey % 2 = 0 THEN 'low' ELSE '{env.PLENTY}' END AS supply_status, CAST(CASE WHEN n_nationkey % 2 = 0 THEN least(10, n_nationkey) ELSE 0 END AS INT) AS panic_level,
CAST(CASE WHEN n_nationkey % 2 <> 0 THEN 0 WHEN n_nationkey % 4 = 0 THEN greatest(3, n_regionkey) ELSE n_regionkey END AS INT) AS mutation_level FROM nation""")
def place_states(spark, d):
    """Places that nothing is known about are fresh; one whose infrastructure is down counts as level 3 at least."""
    k = F.col("n_nationkey")
    nations = read(spark, d, "nation")
    level = env.level_from_status(F.when(k % 4 == 0, "down").otherwise("normal"), F.col("n_regionkey").cast("int"))
    known = nations.where(k % 2 == 0).select(
        F.col("n_name").alias("region"), F.lit("cut").alias("power"), F.lit("slow").alias("communication"), F.lit(False).alias("accessible"), F.lit("low").alias("supply_status"),
        F.least(F.lit(10), k).cast("int").alias("panic_level"), level.cast("int").alias("mutation_level"),
    )
    return render.places(known, nations.select(F.col("n_name").alias("region")))


_PARTS = ", ".join(f"'{title}：' || string_agg(n_name, '；' ORDER BY n_name) FILTER (WHERE n_nationkey % 4 = {part})" for part, title in enumerate(("已知", "错误信念", "未知")))


@query("gap_texts", f"""SELECT name, '### ' || name || chr(10) || body AS block FROM (SELECT r_name AS name, concat_ws(chr(10), {_PARTS}) AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) WHERE body <> ''""")
def gap_texts(spark, d):
    """What each character knows, takes wrongly and lacks, as a block; empty parts, and empty blocks, are left out."""
    held = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = [F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 4 == i, F.col("n_name")))).alias(c) for i, c in enumerate(("known", "wrong", "gaps"))]
    return cognition.info_gaps_text(held.groupBy(F.col("r_name").alias("name")).agg(*parts))
