"""Readers of a note vault: chapter states, characters, timelines, hooks, truth tables, bibles, lore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell import params
from inkwell.functions.text import blank_to_null, first_number, lines_of, strip
from inkwell.sources.frontmatter import with_frontmatter

CHAPTER_SCHEMA = (
    "key_events array<string>, time_span struct<start:string,end:string,absolute_day:int>, "
    "world_state struct<stage:string,public_events:array<string>,region_effects:map<string,struct<mutation_level:int,active_anomalies:array<string>>>>"
)
CHARACTER_SCHEMA = "role string, current_location string, goals map<string,string>, state_history array<struct<chapter:string,summary:string,status:string>>"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def notes(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, value of every file that ``path`` (a glob) matches; empty if none does."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, stem string, value string")
    read = spark.read.text(path, wholetext=True)
    # file names come percent-encoded
    name = F.url_decode(F.replace(F.element_at(F.split(F.input_file_name(), "/"), -1), F.lit("+"), F.lit("%2B")))
    return read.select(F.input_file_name().alias("path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("value"))


def chapter_states(spark: SparkSession, vault: str, schema: str = CHAPTER_SCHEMA) -> DataFrame:
    """chapter and meta of every ``第N章`` note."""
    held = with_frontmatter(notes(spark, f"{vault}/章节状态/*.md"), schema)
    return held.withColumn("chapter", first_number(F.col("stem"), r"第(\d+)章").cast("int")).where("chapter is not null").select("chapter", "meta")


def characters(spark: SparkSession, vault: str, schema: str = CHARACTER_SCHEMA) -> DataFrame:
    return with_frontmatter(notes(spark, f"{vault}/人物/*.md"), schema).select(F.col("stem").alias("name"), "meta")


def fixed_note(spark: SparkSession, vault: str, name: str, schema: str) -> DataFrame:
    """meta of one note, such as worldbuilding (世界观) or writing rules (写作约束); empty if it isn't there."""
    return with_frontmatter(notes(spark, f"{vault}/{name}.md"), schema).select("meta")


def numbered_lines(texts: DataFrame, key: str, text: str = "value") -> DataFrame:
    """key, line (from 1), raw; any kind of line end counts."""
    return texts.select(key, F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")).alias("at", "raw")).select(key, (F.col("at") + 1).alias("line"), "raw")


def carried(lines: DataFrame, key: str, value, name: str) -> DataFrame:
    """``lines`` with the last ``value`` that isn't null so far."""
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))


def table_cells(lines: DataFrame) -> DataFrame:
    """``lines`` that are table rows, with ``cells`` (stripped; an escaped bar belongs to its cell)."""
    text = strip(F.col("raw"))
    inner = F.regexp_replace(F.replace(text, F.lit("\\|"), F.lit("\0")), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"\|"), lambda c: strip(F.replace(c, F.lit("\0"), F.lit("|"))))
    return lines.where(F.startswith(text, F.lit("|"))).withColumn("cells", cells)


def _ruled(cells) -> F.Column:
    """Whether a row only separates head and body."""
    return F.forall(cells, lambda c: c.rlike(r"^:?-*:?$"))


def timeline(texts: DataFrame, key: str, text: str = "value") -> DataFrame:
    """key, line, day, time, event, source of the table rows below ``## 第N天`` headings."""
    marked = carried(numbered_lines(texts, key, text), key, first_number(F.col("raw"), r"^##\s*第(\d+)天").cast("int"), "day")
    rows = table_cells(marked).where(F.col("day").isNotNull() & (F.size("cells") >= 3) & ~_ruled(F.col("cells")))
    out = rows.select(key, "line", "day", F.col("cells")[0].alias("time"), F.col("cells")[1].alias("event"), F.col("cells")[2].alias("source"))
    return out.where((F.length("time") > 0) & (F.length("event") > 0) & (F.col("time") != "时间"))


def open_hooks(texts: DataFrame, key: str, text: str = "value") -> DataFrame:
    """key, line, id, description, created_at, last_touched, type of the rows in ``## 开放…`` sections."""
    heading = F.when(strip(F.col("raw")).startswith("## "), strip(F.col("raw")).startswith("## 开放"))
    marked = carried(numbered_lines(texts, key, text), key, heading, "is_open")
    cells = F.col("cells")
    rows = table_cells(marked).where(F.col("is_open") & (F.size("cells") >= 5) & ~_ruled(cells) & (cells[0] != "ID") & (F.length(cells[0]) > 0) & (F.length(cells[2]) > 0) & (F.length(cells[4]) > 0))
    return rows.select(key, "line", cells[0].alias("id"), cells[1].alias("description"), cells[2].alias("created_at"), F.coalesce(F.nullif(cells[3], F.lit("")), cells[2]).alias("last_touched"), cells[4].alias("type"))


def truth_table(texts: DataFrame, key: str, text: str = "value", false_words=params.FALSE_WORDS) -> DataFrame:
    """key, ord, id, category, proposition, truth; rows that aren't facts are skipped."""
    cells = F.col("cells")
    rows = table_cells(numbered_lines(texts, key, text)).where((F.size(cells) >= 3) & (F.lower(cells[0]) != "id") & ~_ruled(cells) & (F.length(cells[0]) > 0) & (F.length(cells[2]) > 0))
    truth = ~F.coalesce(F.lower(F.get(cells, F.lit(3))).isin(*false_words), F.lit(False))
    return rows.select(key, F.col("line").alias("ord"), cells[0].alias("id"), cells[1].alias("category"), cells[2].alias("proposition"), truth.alias("truth"))


def enabled_truth_table(spark: SparkSession, novel_dir: str, config: dict) -> DataFrame | None:
    """The truth table of a content package; none if it is turned off, missing or empty."""
    from inkwell.sources.config import tom_enabled, truth_table_file

    if not tom_enabled(config):
        return None
    found = truth_table(notes(spark, f"{novel_dir}/bible/{truth_table_file(config)}"), "stem")
    return None if found.isEmpty() else found


def bible_text(spark: SparkSession, novel_dir: str, name: str) -> str:
    """A bible file's text; empty if it isn't there."""
    row = notes(spark, f"{novel_dir}/bible/{name}").select("value").first()
    return strip_text(row.value) if row else ""


def strip_text(text: str | None) -> str:
    return (text or "").strip()


def distilled_lore(texts: DataFrame, key: str, text: str = "text", most: int = 15, least_chars: int = 4) -> DataFrame:
    """key, lore, n_lines: the first meaningful lines, without frontmatter, code, headings, tables and quotes."""
    lines = texts.select(key, F.posexplode(lines_of(F.col(text))).alias("line", "raw")).withColumn("t", strip(F.col("raw")))
    w = Window.partitionBy(key).orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    headed = F.first(F.col("t")).over(upto) == "---"
    rules = F.sum((F.col("t") == "---").cast("int")).over(upto)
    n_rules = F.sum((F.col("t") == "---").cast("int")).over(Window.partitionBy(key))
    in_head = headed & (n_rules >= 2) & ((rules < 2) | ((rules == 2) & (F.col("t") == "---")))
    fence = F.startswith("t", F.lit("```"))
    marked = lines.withColumn("in_head", in_head).withColumn("fence", fence & ~F.col("in_head"))
    marked = marked.withColumn("in_code", F.sum(F.col("fence").cast("int")).over(upto) % 2 == 1)
    body = F.when(F.col("t").rlike(r"^[-*] "), strip(F.substring("t", F.lit(3), F.length("t")))).otherwise(F.col("t"))
    kept = marked.where(~F.col("in_head") & ~F.col("fence") & ~F.col("in_code") & (F.col("t") != "") & ~F.left("t", F.lit(1)).isin("#", "|", ">")).withColumn("body", body).where(F.length("body") >= least_chars)
    few = kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "body"))), lambda r: r["body"])
    return few.groupBy(key).agg(F.array_join(ordered, "\n").alias("lore"), F.count("*").alias("n_lines"))


def character_bible(texts: DataFrame, key: str, text: str = "value") -> DataFrame:
    """key, name, body of each ``## `` section; a name ends at ``（`` and its last section wins."""
    heading = F.when(F.startswith("raw", F.lit("## ")), F.col("line"))
    marked = carried(numbered_lines(texts, key, text), key, heading, "section").where("section is not null")
    name = strip(F.substring_index(F.substring("raw", F.lit(4), F.length("raw")), "（", 1))
    body = F.transform(F.sort_array(F.collect_list(F.when(F.col("line") > F.col("section"), F.struct("line", "raw")))), lambda r: r["raw"])
    sections = marked.groupBy(key, "section").agg(F.max(F.when(F.col("line") == F.col("section"), name)).alias("name"), strip(F.array_join(body, "\n")).alias("body"))
    return sections.groupBy(key, "name").agg(F.max_by("body", "section").alias("body"))


def world_lore(config: dict, text: str, distilled: str, full: bool = False) -> str:
    """What a config says of the world, else the distilled lore, else (``full``) the whole text."""
    told = config.get("worldbuilding") or {}
    parts = [str(told[k]).strip() for k in ("summary", "principle") if told.get(k)]
    return "\n".join(parts) or distilled or (text if full else "")


def forward_days(events: DataFrame) -> DataFrame:
    """Rows with a blank day take the last one before them."""
    return carried(events, "key", blank_to_null(F.col("day")), "day")
