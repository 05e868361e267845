"""Lexicons, states as of a chapter, and what is kept from batch to batch, bound to the driver's tables with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.operators import asof, lexicon, numbering, timeline
from inkwell.plans import generate, prompts, specs
from inkwell.plans.bindings import CLOSES, OPENS, ORACLE_SQL, SQL_EVENTS, SQL_LINES, SQL_SCENES, _entries, _events, _scenes, query, read
from inkwell.sources import config, model_json, store, variants, vault_source
from inkwell.sources.tables import shared_place
from inkwell.streaming import knowledge

# --- a lexicon of many words ------------------------------------------------------------------------------

_LEXICON_SQL = r"""lexicon AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(text, '[^\pL]+')) AS w FROM conversations) WHERE length(w) >= 5),
fatal AS (SELECT word FROM lexicon WHERE length(word) % 3 = 0), high AS (SELECT word FROM lexicon WHERE length(word) % 3 = 1),
medium AS (SELECT word, CAST(CASE WHEN length(word) % 4 = 0 THEN 3 ELSE length(word) % 4 END AS INT) AS allowed FROM lexicon WHERE length(word) % 3 = 2)"""


@query("lexicon_gate", rf"""WITH {SQL_LINES}, {_LEXICON_SQL},
counted AS (SELECT doc_id, word, CAST((length(text) - length(replace(text, word, ''))) // length(word) AS BIGINT) AS n, allowed FROM documents, medium WHERE contains(text, word))
SELECT doc_id, CAST(line AS INT) AS line, word, 'fatal' AS severity, left(s, 80) AS context, CAST(NULL AS BIGINT) AS n, CAST(NULL AS INT) AS allowed FROM stated, fatal WHERE contains(raw, word)
UNION ALL SELECT doc_id, CAST(line AS INT), word, 'high', left(s, 80), NULL, NULL FROM stated, high WHERE narrative AND contains(s, word)
UNION ALL SELECT doc_id, NULL, word, 'medium', NULL, n, allowed FROM counted WHERE n > allowed""")  # fmt: skip
def lexicon_gate(spark, d):
    """Every longer word of the conversations, as lexicon files of one category each, against all documents."""
    words = read(spark, d, "conversations").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 5).distinct()
    n = F.length("word")
    severity = F.when(n % 3 == 0, "fatal").when(n % 3 == 2, "medium")  # without one the category's counts
    entry = F.struct("word", severity.alias("severity"), F.when(n % 4 > 0, n % 4).alias("allowedCount"))
    category = F.create_map(F.lit("some"), F.struct(F.lit("high").alias("severity"), F.collect_list(entry).alias("entries")))
    files = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(64)).alias("file")).agg(F.to_json(F.struct(F.struct(category.alias("words")).alias("anti_ai"))).alias("value"))
    return lexicon.lexicon_violations(read(spark, d, "documents"), "doc_id", config.lexicon_rows(files), OPENS, CLOSES)


# --- the state as of a chapter ----------------------------------------------------------------------------

_ASKS_SQL = """asks AS (SELECT event_id, user_id % 150 AS novel, day(ts) AS chapter FROM events),
states AS (SELECT novel, chapter, max({'o': o_orderkey, 's': o_orderstatus}) AS told FROM (SELECT o_custkey % 150 AS novel, day(o_orderdate) AS chapter, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0) GROUP BY ALL)"""


def _asks(spark, d):
    asks = read(spark, d, "events").select("event_id", (F.col("user_id") % 150).alias("novel"), F.dayofmonth("ts").alias("chapter"))
    states = read(spark, d, "orders").where("o_orderkey % 5 = 0").select((F.col("o_custkey") % 150).alias("novel"), F.dayofmonth("o_orderdate").alias("chapter"), "o_orderkey", "o_orderstatus")
    return asks, states


@query("state_as_of", f"WITH {_ASKS_SQL} SELECT event_id, novel, chapter, told.o AS o_orderkey, told.s AS o_orderstatus, s.chapter AS as_of FROM asks a ASOF LEFT JOIN states s USING (novel, chapter)")
def state_as_of(spark, d):
    """The order that holds on an event's day."""
    asks, states = _asks(spark, d)
    return asof.as_of(asks, states, ["novel"], "chapter", ["o_orderkey", "o_orderstatus"], span_rows=2000)


@query("chapter_states", f"""WITH {_ASKS_SQL}
SELECT event_id, a.novel, a.chapter, any_value(r.told.o ORDER BY r.chapter DESC) AS o_orderkey, any_value(r.told.s ORDER BY r.chapter DESC) AS o_orderstatus, max(r.chapter) AS as_of, count(r.chapter) AS n_states
FROM asks a LEFT JOIN states r ON r.novel = a.novel AND r.chapter BETWEEN a.chapter - 2 AND a.chapter - 1 GROUP BY ALL""")
def chapter_states(spark, d):
    asks, states = _asks(spark, d)
    return asof.chapter_states(asks, states, ["novel"], "chapter", ["o_orderkey", "o_orderstatus"])


# --- knowledge from batch to batch ------------------------------------------------------------------------


@query("streamed_knowledge", ORACLE_SQL["knowledge_merge"])
def streamed_knowledge(spark, d):
    """The events arrive in four batches, the latest first."""
    return knowledge.replayed(_entries(spark, d), shared_place(spark), batches=4)


# --- JSON files without a schema --------------------------------------------------------------------------

_TICKS_SQL = """ticks AS (SELECT *, user_id % 11 = 3 AS broken, user_id % 7 = 2 AS no_arc, user_id % 5 = 1 AS no_split FROM events)"""


def _ticks(spark, d):
    """A tick result for each user: some are cut off, some lack keys, some events lack their place."""
    ev = read(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    event = F.struct(F.dayofmonth("ts").alias("day"), F.date_format("ts", "HH:mm").alias("time"), F.when(F.col("event_id") % 3 > 0, F.col("props")).alias("location"), F.col("event_id").cast("string").alias("brief"))
    lines = ev.withColumn("seq", seq).groupBy("user_id", "event_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", event.alias("e")))), lambda r: r["e"]).alias("line"))
    u = F.col("user_id")
    held = lines.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "line"))).alias("character_trajectories"))
    made = held.withColumn("arc_id", F.when(u % 7 != 2, F.concat(F.lit("arc"), u.cast("string")))).withColumn("suggested_chapter_split", F.when(u % 5 != 1, F.array(F.lit(1))))
    text = F.to_json(F.struct("arc_id", "character_trajectories", "suggested_chapter_split"))
    return made.select("user_id", F.when(u % 11 == 3, F.left(text, F.length(text) - 4)).otherwise(text).alias("value"))


@query("tick_problems", f"""WITH {_TICKS_SQL} SELECT DISTINCT user_id, 'broken' AS problem FROM ticks WHERE broken
UNION ALL SELECT DISTINCT user_id, 'lacks arc_id' FROM ticks WHERE NOT broken AND no_arc UNION ALL SELECT DISTINCT user_id, 'lacks suggested_chapter_split' FROM ticks WHERE NOT broken AND no_split""")
def tick_problems(spark, d):
    return variants.tick_problems(_ticks(spark, d), "user_id")


@query("tick_rows", f"""WITH {_TICKS_SQL} SELECT user_id, 'arc' || CAST(user_id AS VARCHAR) AS arc_id, event_type AS pov, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS INT) AS seq,
CAST(day(ts) AS INT) AS day, strftime(ts, '%H:%M') AS time, CASE WHEN event_id % 3 > 0 THEN props ELSE '?' END AS location, CAST(event_id AS VARCHAR) AS brief FROM ticks WHERE NOT broken AND NOT no_arc AND NOT no_split""")
def tick_rows(spark, d):
    return variants.tick_rows(_ticks(spark, d), "user_id")


def _configs(spark, d):
    """A configuration for each customer: its nation's suppliers would be too many, so three members by number."""
    k = F.col("c_custkey")
    member = [F.struct(F.lit(f"m{n}").alias("key"), F.concat(F.lit(f"M{n}-"), k.cast("string")).alias("name"), F.lit(n).alias("tier"), F.when(k % 2 == 0, F.lit(f"s{n}")).alias("state_key")) for n in (1, 2, 3)]
    cast = F.when(k % 4 != 0, F.slice(F.array(*member), F.lit(1), (k % 3 + 1).cast("int")))
    mode = F.when(k % 6 == 1, "engine").when(k % 6 == 2, "hybrid").when(k % 6 == 3, "no such mode")
    overrides = F.when(k % 5 < 3, F.create_map(F.lit("2"), F.lit("hybrid"), F.lit("x"), F.lit("engine"), F.lit("3"), F.lit("odd")))
    tom = F.when(k % 8 == 1, F.struct(F.lit(False).alias("enabled"), F.col("c_mktsegment").alias("truth_table")))
    text = F.to_json(F.struct(F.col("c_name").alias("title"), F.when(k % 9 < 7, F.concat(F.lit("m"), (k % 9).cast("string"))).alias("protagonist"), cast.alias("cast"), F.struct(mode.alias("default_mode"), overrides.alias("chapter_overrides")).alias("pipeline"), tom.alias("theory_of_mind")))
    return read(spark, d, "customer").select("c_custkey", F.when(k % 13 == 5, "[1, 2]").when(k % 13 == 6, F.left(text, F.lit(9))).otherwise(text).alias("value"))


_CONFIG_SQL = """c AS (SELECT c_custkey AS k, *, c_custkey % 13 IN (5, 6) AS broken FROM customer),
n AS (SELECT *, CASE WHEN broken OR k % 4 = 0 THEN 0 ELSE k % 3 + 1 END AS members FROM c)"""
_MODE_SQL = "CASE WHEN broken THEN 'gen' WHEN k % 6 = 1 THEN 'engine' WHEN k % 6 = 2 THEN 'hybrid' ELSE 'gen' END"


@query("config_rows", f"""WITH {_CONFIG_SQL} SELECT c_custkey, CASE WHEN broken THEN '' ELSE c_name END AS title,
CASE WHEN broken OR k % 9 >= 7 THEN '' WHEN k % 9 BETWEEN 1 AND members THEN 'M' || CAST(k % 9 AS VARCHAR) || '-' || CAST(k AS VARCHAR) ELSE 'm' || CAST(k % 9 AS VARCHAR) END AS protagonist, '' AS pronoun,
broken OR k % 8 <> 1 AS tom_enabled, CASE WHEN NOT broken AND k % 8 = 1 THEN c_mktsegment ELSE 'truth_table.md' END AS truth_table, {_MODE_SQL} AS default_mode, CAST(members AS INT) AS n_cast FROM n""")
def config_rows(spark, d):
    return variants.config_rows(_configs(spark, d), "c_custkey")


@query("cast_rows", f"""WITH {_CONFIG_SQL} SELECT c_custkey, CAST(i - 1 AS INT) AS ord, 'm' || CAST(i AS VARCHAR) AS cast_key, 'M' || CAST(i AS VARCHAR) || '-' || CAST(k AS VARCHAR) AS name, CAST(i AS INT) AS tier,
CASE WHEN k % 2 = 0 THEN 's' || CAST(i AS VARCHAR) ELSE 'm' || CAST(i AS VARCHAR) || '_state' END AS state_key FROM n, (SELECT unnest(range(1, 4)) AS i) WHERE i <= members""")
def cast_rows(spark, d):
    return variants.cast_rows(_configs(spark, d), "c_custkey")


@query("chapter_modes", f"""WITH {_CONFIG_SQL}, a AS (SELECT o_orderkey, o_custkey, month(o_orderdate) % 4 AS chapter FROM orders)
SELECT o_orderkey, o_custkey AS c_custkey, CAST(chapter AS INT) AS chapter, CASE WHEN NOT broken AND k % 5 < 3 AND chapter = 2 THEN 'hybrid' ELSE {_MODE_SQL} END AS mode FROM a LEFT JOIN c ON k = o_custkey""")
def chapter_modes(spark, d):
    asks = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.month("o_orderdate") % 4).alias("chapter"))
    return variants.chapter_modes(asks, _configs(spark, d), "c_custkey")


@query("dimension_rows", """SELECT s_suppkey, dim, CAST(CASE WHEN s_suppkey % 6 IN (0, 1, 2) THEN 3 WHEN dim = 'caution' THEN s_nationkey WHEN dim = 'extra' THEN 9 WHEN dim = 'trust' AND s_suppkey % 6 = 4 THEN s_suppkey % 5 ELSE 3 END AS INT) AS value
FROM supplier, (SELECT unnest(['trust', 'assertiveness', 'caution', 'moral_burden', 'extra']) AS dim) WHERE dim <> 'extra' OR s_suppkey % 6 = 5""")
def dimension_rows(spark, d):
    """Broken, empty, without dimensions, and with some of them."""
    k = F.col("s_suppkey")
    some = F.concat(F.lit('{"dimensions": {"caution": '), F.col("s_nationkey").cast("string"), F.when(k % 6 == 4, F.concat(F.lit(', "trust": '), (k % 5).cast("string"))).when(k % 6 == 5, ', "extra": 9').otherwise(', "trust": null'), F.lit("}}"))
    value = F.when(k % 6 == 0, "{").when(k % 6 == 1, "{}").when(k % 6 == 2, '{"dimensions": 7}').otherwise(some)
    return variants.dimension_rows(read(spark, d, "supplier").select("s_suppkey", value.alias("value")), "s_suppkey")


# --- notes and tables in folders --------------------------------------------------------------------------


def _own_folder(spark) -> str:
    """A folder of one run; it stays until the reader of the query's rows deletes it."""
    return f"{shared_place(spark)}/run-{uuid.uuid4().hex}"


@query("vault_notes", """SELECT CASE WHEN c_custkey % 3 = 0 THEN '章节状态' ELSE '人物' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN '第' || CAST(c_custkey AS VARCHAR) || '章' ELSE c_name END AS name,
CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS INT) AS chapter, '# ' || c_name || chr(10) || c_mktsegment AS value FROM customer""")
def vault_notes(spark, d):
    """A note for each customer, written file by file and read back: a third are chapters, the others characters."""
    k, folder = F.col("c_custkey"), _own_folder(spark)
    rows = read(spark, d, "customer").select(k, F.when(k % 3 == 0, F.concat(F.lit("第"), k.cast("string"), F.lit("章"))).otherwise(F.col("c_name")).alias("name"), F.concat(F.lit("# "), F.col("c_name"), F.lit("\n"), F.col("c_mktsegment")).alias("value"))
    for kind, whose in (("章节状态", k % 3 == 0), ("人物", k % 3 != 0)):
        vault_source.write_files(rows.where(whose), f"{folder}/{kind}", ".md")
    return vault_source.read_vault(spark, folder).select("kind", "name", "chapter", "value")


@query("bucket_upsert", ORACLE_SQL["chapter_upsert"])
def bucket_upsert(spark, d):
    """Every order is stored; then the even ones come again."""
    old, folder = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("state")), _own_folder(spark)
    store.upsert_buckets(old, folder, ["o_custkey", "o_orderkey"], buckets=16)
    store.upsert_buckets(old.where("o_orderkey % 2 = 0").withColumn("state", F.lit("new")), folder, ["o_custkey", "o_orderkey"], buckets=16)
    return store.bucketed(spark, folder)


# --- numbers over a whole ledger --------------------------------------------------------------------------


@query("ledger_numbers", """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS number FROM lineitem""")
def ledger_numbers(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return numbering.numbered(rows, ["l_shipdate", "l_orderkey", "l_linenumber"], range_rows=20_000).drop("l_shipdate")


@query("ledger_hooks", """WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) + (SELECT count(*) FROM customer) AS k FROM orders)
SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || CAST(o_custkey AS VARCHAR) ELSE printf('hook_%03d', k) END AS id, 'ch' || CAST(year(o_orderdate) AS VARCHAR) AS created_at
FROM n WHERE o_orderkey % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey % 2 = 0)""")
def ledger_hooks(spark, d):
    """All orders as hooks against the customers of even nations as a ledger of old ones."""
    hooks = read(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("id"), F.col("o_orderpriority").alias("description"), F.year("o_orderdate").alias("created_at_chapter"))
    old = read(spark, d, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("id"))
    return timeline.numbered_hooks(hooks, old).select("seq", "id", "created_at")


# --- specs and answers ------------------------------------------------------------------------------------


@query("planned_sections", f"""WITH {SQL_EVENTS}, c AS (SELECT DISTINCT day(o_orderdate) + 3 AS chapter FROM orders),
o AS (SELECT chapter, chapter % 5 = 0 AND chapter % 10 <> 0 AS designed FROM c),
sc AS (SELECT o.chapter, 'scope' AS source, ev.* FROM o JOIN ev ON ev.day = o.chapter AND NOT designed AND o.chapter % 2 = 0 AND agent % 2 = 0),
dy AS (SELECT o.chapter, 'days' AS source, ev.* FROM o JOIN ev ON ev.day = o.chapter AND NOT designed WHERE o.chapter NOT IN (SELECT chapter FROM sc)),
e AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY time, pov, seq) - 1 AS pos, count(*) OVER (PARTITION BY chapter) AS n FROM (SELECT * FROM sc UNION ALL SELECT * FROM dy)),
p AS (SELECT *, greatest(1, n // 3) AS per FROM e), s AS (SELECT *, unnest([0, 1, 2]) AS section FROM p),
k AS (SELECT * FROM s WHERE CASE WHEN section * per < n THEN pos // per = section ELSE pos >= n - per END)
SELECT chapter, source, CAST(section + 1 AS INT) AS ord, string_agg('- ' || pov || ': ' || left(brief, 60), chr(10) ORDER BY pos) FILTER (pos % per < 5) AS description, 'normal' AS weight, count(*) AS n_events FROM k GROUP BY ALL
UNION ALL SELECT chapter, 'designed', CAST(i AS INT), 'd' || CAST(chapter AS VARCHAR), CASE WHEN i = 2 THEN 'expanded' ELSE 'normal' END, 0 FROM o, (SELECT unnest([1, 2]) AS i) WHERE designed
UNION ALL SELECT chapter, 'blank', CAST(i AS INT), NULL, 'normal', 0 FROM o, (SELECT unnest([1, 2, 3]) AS i) WHERE NOT designed AND chapter NOT IN (SELECT chapter FROM sc) AND chapter NOT IN (SELECT chapter FROM dy)""")  # fmt: skip
def planned_sections(spark, d):
    """Days as chapters, of which a model has designed every tenth, and an unusable reply is there for others."""
    chapters = read(spark, d, "orders").select((F.dayofmonth("o_orderdate") + 3).alias("chapter")).distinct()
    text = F.concat(F.lit('{"sections": [{"subject": "s", "description": "d'), F.col("chapter").cast("string"), F.lit('"}, {"description": "d'), F.col("chapter").cast("string"), F.lit('", "weight": "expanded"}]}'))
    replies = chapters.where("chapter % 5 = 0").select("chapter", F.when(F.col("chapter") % 10 == 0, "no reply").otherwise(text).alias("answer"))
    events = _events(spark, d).withColumn("chapter", F.col("day"))
    return specs.planned_sections(replies, events.where("chapter % 2 = 0 AND agent % 2 = 0"), events, chapters).drop("subject")


@query("paid_answers", """SELECT o_orderkey, 'status ' || o_orderstatus || chr(10) || o_orderpriority AS prompt,
'[' || left(sha256(encode('answer') || '\\x00'::BLOB || encode('status ' || o_orderstatus || chr(10) || o_orderpriority)), 8) || '] ' || o_orderpriority AS answer FROM orders""")
def paid_answers(spark, d):
    """A question for each order, of which few are different; the second run finds all answers."""
    asks = read(spark, d, "orders").select("o_orderkey", F.lit("answer").alias("system"), F.concat(F.lit("status "), "o_orderstatus", F.lit("\n"), "o_orderpriority").alias("prompt"))
    folder = _own_folder(spark)
    generate.paid_once(asks, folder).count()
    return generate.paid_once(asks, folder, model=_never).select("o_orderkey", "prompt", "answer")


def _never(system: str, prompt: str) -> str:
    raise RuntimeError("asked again")


@query("reflections", """SELECT o_custkey AS agent, CAST(o_custkey AS VARCHAR) || '_refl_4_' || CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS VARCHAR) AS id, o_orderkey, o_orderpriority AS content, 'reflection' AS type, 4 AS created_at_chapter,
CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 10 ELSE 7 END AS INT) AS importance, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || ',reflection' ELSE 'reflection' END AS tags FROM orders QUALIFY o_orderkey % 5 > 0""")
def reflections(spark, d):
    """A reply for each customer with a reflection for each order, some without content, importance or tags."""
    k = F.col("o_orderkey")
    one = F.struct(F.when(k % 5 > 0, F.col("o_orderpriority")).otherwise("").alias("content"), F.when(k % 2 == 0, k % 10).alias("importance"), F.when(k % 3 == 0, F.array("o_orderstatus")).alias("tags"))
    held = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", one.alias("r")))), lambda r: r["r"])
    orders = read(spark, d, "orders")
    replies = orders.groupBy(F.col("o_custkey").alias("agent")).agg(F.concat(F.lit("Here: "), F.to_json(F.struct(held.alias("reflections")))).alias("reply"))
    objects = replies.select("agent", model_json.reply_json("reply").alias("answer"))
    found = generate.reflections(objects, F.lit(4))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    of = orders.select(F.col("o_custkey").alias("agent"), F.concat(F.col("o_custkey").cast("string"), F.lit("_refl_4_"), place.cast("string")).alias("id"), "o_orderkey")
    return found.join(of, ["agent", "id"]).withColumn("tags", F.array_join("tags", ","))


@query("section_prompts", """SELECT o_orderkey, '场景：' || o_orderstatus || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '锚点：a' || chr(10) ELSE '' END || '内容：' || o_orderpriority
|| CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || '张力：t' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || '重点：x' ELSE '' END || chr(10) || '约 ' || CAST(o_custkey AS VARCHAR) || ' 字' AS prompt FROM orders""")
def section_prompts(spark, d):
    k = F.col("o_orderkey")
    sections = read(spark, d, "orders").select(k, F.col("o_orderstatus").alias("subject"), F.when(k % 2 == 0, "a").alias("scene_anchor"), F.col("o_orderpriority").alias("description"), F.when(k % 3 == 0, "t").otherwise("").alias("tension_direction"), F.when(k % 5 == 0, "expanded").otherwise("normal").alias("weight"), F.lit("x").alias("expanded_direction"), F.col("o_custkey").alias("length_hint"))
    return prompts.section_prompts(sections).select("o_orderkey", "prompt")


@query("spec_prompts", f"""WITH {SQL_SCENES} SELECT day % 5 AS chapter, string_agg('- 第' || CAST(day AS VARCHAR) || '天 @' || location || ' ' || concat_ws(' ', CASE WHEN n_events > 3 THEN '对手戏' END, CASE WHEN has_private THEN '隐藏信息' END), chr(10) ORDER BY day, first_time, location) AS prompt FROM sw GROUP BY 1""")
def spec_prompts(spark, d):
    held = _scenes(spark, d).withColumn("chapter", F.col("day") % 5).withColumn("interactive", F.col("n_events") > 3)
    return prompts.spec_prompt(held)
