"""Nested JSON corpora of dialogues as episodes, questions and gold, and generated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parse_time, stripped

HAYSTACK = "question_id string, question_type string, question string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>"


def haystack(spark: SparkSession, path: str) -> DataFrame:
    """qid, turn_id, session, position, ts, text, gold: the user turns of question files, in order.

    A turn of an answer session that holds no answer is renamed, so that ids tell evidence.
    """
    raw = spark.read.schema(HAYSTACK).json(path, multiLine=True)
    sessions = raw.select(F.col("question_id").alias("qid"), F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_sessions", "haystack_dates")).alias("session", "s"))
    turns = sessions.select("qid", "session", F.col("s.haystack_session_ids").alias("sid"), parse_time(F.col("s.haystack_dates")).alias("ts"), F.posexplode("s.haystack_sessions").alias("t", "turn"))
    turns = turns.where("turn.role = 'user'")
    turn_id = F.concat_ws("_", "sid", (F.col("t") + 1).cast("string"))
    none = F.col("sid").contains("answer") & ~F.coalesce("turn.has_answer", F.lit(False))
    position = F.row_number().over(Window.partitionBy("qid", "session").orderBy("t")) - 1
    out = turns.select("qid", F.when(none, F.replace(turn_id, F.lit("answer"), F.lit("noans"))).otherwise(turn_id).alias("turn_id"), "session", position.alias("position"), "ts", F.col("turn.content").alias("text"))
    return out.withColumn("gold", F.col("turn_id").contains("answer")).withColumn("session_id", stripped(F.col("turn_id")))


TURN = "array<struct<speaker:string,text:string,dia_id:string,blip_caption:string>>"


def dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Turns (sample_id, turn_id, session, position, ts, text) and questions (sample_id, question, category, gold) of files with session_1, session_2, ... keys."""
    raw = spark.read.schema("sample_id string, conversation map<string,string>, qa array<struct<question:string,category:int,evidence:array<string>>>").json(path, multiLine=True)
    entry = raw.select("sample_id", "conversation", F.explode("conversation").alias("key", "value")).where(F.col("key").rlike("^session_[0-9]+$"))
    date = F.coalesce(F.element_at("conversation", F.concat("key", F.lit("_date_time"))), F.lit(""))
    turns = entry.select("sample_id", (F.regexp_extract("key", "([0-9]+)", 1).cast("int") - 1).alias("session"), date.alias("date"), F.posexplode(F.from_json("value", TURN)).alias("position", "t"))
    said = F.format_string('(%s) %s said, "%s"', F.col("date"), F.col("t.speaker"), F.col("t.text"))
    shares = F.when(F.coalesce("t.blip_caption", F.lit("")) != "", F.concat(F.lit(" [shares "), "t.blip_caption", F.lit("]"))).otherwise("")
    turns = turns.select("sample_id", F.col("t.dia_id").alias("turn_id"), "session", "position", parse_time(F.col("date")).alias("ts"), F.concat(said, shares).alias("text"))
    asked = raw.select("sample_id", F.posexplode("qa").alias("n", "q")).where("q.category BETWEEN 1 AND 4")
    evidence = asked.select("sample_id", "n", F.explode(F.regexp_extract_all(F.array_join("q.evidence", " "), F.lit(r"D[0-9]+:[0-9]+"), F.lit(0))).alias("turn_id")).distinct()
    gold = evidence.join(turns.select("sample_id", "turn_id"), ["sample_id", "turn_id"], "left_semi").groupBy("sample_id", "n").agg(F.array_sort(F.collect_set("turn_id")).alias("gold"))
    return turns, asked.join(gold, ["sample_id", "n"]).select("sample_id", "q.question", "q.category", "gold")


def incidents(spark: SparkSession, days: list[str], services: list[str], faults: list[str]) -> DataFrame:
    """All reports of a day, a service and a fault."""
    n, m = len(services), len(faults)
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), i.cast("int") + 1)
    cube = spark.range(len(days) * n * m).select("id", pick(days, F.floor(F.col("id") / (n * m))).alias("day"), pick(services, F.floor(F.col("id") / m) % n).alias("service"), pick(faults, F.col("id") % m).alias("fault"))
    return cube.withColumn("text", F.format_string("On %s the %s service reported %s.", "day", "service", "fault"))


def capacity_corpus(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select("id", F.format_string("session %d step %d subsystem %d region %d", F.floor(F.col("id") / 4), F.col("id") % 4, F.col("id") % 97, F.col("id") % 13).alias("text"))


def timelines(spark: SparkSession, people: int = 16, events: int = 50, seed: int = 0) -> DataFrame:
    """person, idx, week, project, text: generated timelines; a person's home project takes 70 % of the events, by keyed hashes."""
    unit = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(10_000)) / 10_000
    rows = spark.range(people * events).select(F.floor(F.col("id") / events).alias("person"), (F.col("id") % events).alias("idx"))
    home = F.floor(unit("person", F.lit("home")) * 8)
    other = F.floor(unit("person", "idx", F.lit("other")) * 8)
    project = F.when(unit("person", "idx", F.lit("pick")) < 0.7, home).otherwise(other)
    rows = rows.withColumn("week", F.floor(F.col("idx") / 7) + 1).withColumn("project", project)
    return rows.withColumn("text", F.format_string("In week %d on day %d, person%d worked on project%d", "week", F.col("idx") % 7, "person", "project"))
