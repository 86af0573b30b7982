"""Readers and writers: requests, responses, CSV, CoNLL, stories, chats, graph files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = (
    "id STRING, originalText STRING, confidence DOUBLE, startTime STRING, endTime STRING, duration INT, recordingId STRING, spokenBy STRING, languageCode STRING, transcriber STRING, status STRING, "
    "transcriptId STRING, isEndOfSentence BOOLEAN, createdAt STRING, updatedAt STRING, deletedAt STRING, deleted BOOLEAN, tag INT"
)
REQUEST = f"body STRUCT<contextId STRING, mindId STRING, instanceId STRING, segments ARRAY<STRUCT<{', '.join(x.strip().replace(' ', ': ', 1) for x in SEGMENT.split(','))}>>>"


def decode(df: DataFrame, value: str = "value") -> DataFrame:
    """Segments of JSON requests, in order of their start; texts trimmed, empty ones left out.

    The body may be an object or a string that holds one.  Equal starts keep the
    order of the request.
    """
    once = F.from_json(value, REQUEST)["body"]
    inner = F.from_json(F.concat(F.lit('{"body":'), F.get_json_object(value, "$.body"), F.lit("}")), REQUEST)["body"]
    body = df.select(F.coalesce(F.when(once["segments"].isNotNull(), once), inner).alias("b"))
    seg = body.select(F.col("b.contextId").alias("context_id"), F.lower("b.mindId").alias("mind_id"), F.col("b.instanceId").alias("instance_id"), F.posexplode("b.segments").alias("input_pos", "s"))
    seg = seg.select("context_id", "mind_id", "instance_id", "input_pos", F.col("s.id").alias("id"), F.trim("s.originalText").alias("text"), F.col("s.startTime").alias("start_time"), F.col("s.endTime").alias("end_time"), F.col("s.spokenBy").alias("spoken_by"), F.col("s.transcriber").alias("transcribed_by"), F.col("s.languageCode").alias("language"), F.col("s.recordingId").alias("recording_id"), F.col("s.tag").alias("tag"))
    order = F.row_number().over(Window.partitionBy("context_id", "instance_id").orderBy("start_time", "input_pos")) - 1
    return seg.where("text <> ''").withColumn("seg_order", order)


def encode(groups: DataFrame) -> DataFrame:
    """``groups(context_id, group_id, pos, seg_id, ...)`` to one response a context: ``(context_id, statusCode, body)``."""
    more = [F.col(c) for c in groups.columns if c not in ("context_id", "group_id", "pos", "seg_id")]
    seg = F.struct("pos", F.struct(F.col("seg_id").alias("id"), *more).alias("s"))
    g = groups.groupBy("context_id", "group_id").agg(F.transform(F.array_sort(F.collect_list(seg)), lambda x: x["s"]).alias("segs"))
    body = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("group_id").cast("string"), F.col("segs")))).alias("group"), F.col("context_id").alias("contextId")))
    return g.groupBy("context_id").agg(body.alias("body")).select("context_id", F.lit(200).alias("statusCode"), "body")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all request files of a folder, with the file they came from."""
    raw = spark.read.text(path, wholetext=True)
    plain = F.when(F.trim("value").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v STRING")["v"]).otherwise(F.col("value"))
    return decode(raw.select(plain.alias("value")))


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True, corrupt: str | None = None) -> DataFrame:
    """CSV by a declared schema.  No row is dropped: what can't be read is null, and ``corrupt`` names a column for the raw line of such a row."""
    named = f"{schema}, `{corrupt}` STRING" if corrupt else schema
    reader = spark.read.schema(named).option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    return (reader.option("columnNameOfCorruptRecord", corrupt) if corrupt else reader).csv(path)


def read_segment_export(spark: SparkSession, path: str, malformed: bool = False) -> DataFrame:
    """CSV with a JSON segment in ``value``; rows whose value is no JSON object are left out, or with ``malformed`` all that is given: ``(value, transcript_id)``."""
    rows = read_csv(spark, path, "id STRING, value STRING, created_at TIMESTAMP, updated_at TIMESTAMP, deleted_at TIMESTAMP, deleted BOOLEAN, transcript_id STRING")
    if malformed:
        return rows.where(F.from_json("value", SEGMENT)["id"].isNull()).select("value", "transcript_id")
    return rows.select(F.from_json("value", SEGMENT).alias("s"), "transcript_id", "created_at").where("s.id is not null").select("s.*", "transcript_id", F.col("created_at").alias("exported_at"))


def read_topic_pims(df: DataFrame, value: str = "value") -> DataFrame:
    """Topic and PIM request: ``(recording_id, grp, distance)``; of groups that hold a recording the last wins."""
    schema = "groups MAP<STRING, ARRAY<STRUCT<recordingId: STRING, id: STRING>>>, pims STRUCT<segments: ARRAY<STRUCT<recordingId: STRING, distance: DOUBLE>>>"
    body = df.select(F.from_json(value, schema).alias("b"))
    g = body.select(F.posexplode("b.groups").alias("pos", "grp", "segs")).select("pos", "grp", F.explode("segs.recordingId").alias("recording_id")).groupBy("recording_id").agg(F.max_by("grp", "pos").alias("grp"))
    p = body.select(F.posexplode("b.pims.segments").alias("pos", "s")).groupBy(F.col("s.recordingId").alias("recording_id")).agg(F.max_by("s.distance", "pos").alias("distance"))
    return g.join(p, "recording_id", "left")


def stories(rows: DataFrame) -> DataFrame:
    """Story rows: the first four columns joined by full stops, two continuations, the label."""
    return rows.withColumns({"story": F.concat_ws(".", "c0", "c1", "c2", "c3"), "cont1": F.col("c4"), "cont2": F.col("c5")})


def conll(lines: DataFrame, key: list[str], pos: bool = False) -> DataFrame:
    """``lines(*key, line_no, line)`` to sentences: ``(*key, sentence, words, labels)``.

    Empty lines and ``-DOCSTART-`` end a sentence.  The label is the last field,
    ``O`` if there is none; with ``pos`` the third from the end, ``PUNC`` for
    words without letter or digit.
    """
    ends = (F.trim("line") == "") | F.col("line").startswith("-DOCSTART-")
    w = Window.partitionBy(*key).orderBy("line_no")
    f = F.split(F.trim("line"), " ")
    n = F.size(f)
    if pos:
        label = F.when(~F.get(f, F.lit(0)).rlike("[A-Za-z0-9]"), "PUNC").otherwise(F.coalesce(F.get(f, n - 3), F.lit("O")))
    else:
        label = F.get(f, n - 1)
    rows = lines.withColumn("sentence", F.sum(ends.cast("int")).over(w)).where(~ends).select(*key, "sentence", "line_no", F.get(f, F.lit(0)).alias("word"), label.alias("label"))
    s = F.array_sort(F.collect_list(F.struct("line_no", "word", "label")))
    return rows.groupBy(*key, "sentence").agg(s.alias("s")).select(*key, "sentence", F.transform("s", lambda x: x["word"]).alias("words"), F.transform("s", lambda x: x["label"]).alias("labels"))


def read_conll(spark: SparkSession, path: str, pos: bool = False) -> DataFrame:
    """CoNLL files; a file is a key of its own."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return conll(text, ["file"], pos)


def chat_messages(rows: DataFrame, user: str | None = None, least_words: int = 6) -> DataFrame:
    """Messages of people: of type message, with a user and no bot, not empty, of more than ``least_words`` words."""
    out = rows.where((F.col("type") == "message") & F.col("user").isNotNull() & F.col("bot_id").isNull() & (F.trim("text") != ""))
    out = out.where(F.col("user") == user) if user else out
    return out.where(F.size(F.split("text", " ")) > least_words)


def read_gexf_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a GEXF file: ``(src, dst, weight)``, weight 1 where there is none."""
    rows = spark.read.format("xml").option("rowTag", "edge").schema("_id STRING, _source STRING, _target STRING, _weight DOUBLE").load(path)
    return rows.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce("_weight", F.lit(1.0)).alias("weight"))


def write_text(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(F.col(text).cast("string").alias("value")).write.mode("append").text(path)
