"""Transcripts of conversations: two dialects of JSON lines, told by a file's first line, and texts with role headings.

Lines are rows (file, no, line), so a transcript of any length stays spread over tasks; only the dialect is found per file, by an
aggregate that keeps a line a task. The nested dialect has {"type": "say", "message": {role, content, ts}} beside plain
{role, content, timestamp} lines, the flat one {"type": "message", role, content}. Content is a string or a list of parts, of
which those of type text count. Lines that are no JSON, or say nothing, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import table

# Role words, and the headings that begin a turn
USER, TOOL = ("user", "human"), ("tool", "function")
HEADING = r"(?:#+[ \t]*(?:user|human|assistant|ai|claude|cursor):|>[ \t]*(?:user|human|assistant|ai):)"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, no, line) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("file"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("no", "line"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def role_of(role: Column) -> Column:
    low = F.lower(role)
    return F.when(low.isin(*USER), "user").when(low.isin(*TOOL), "tool").otherwise("assistant")


def _kind(v: Column) -> Column:
    """STRING, ARRAY, OBJECT or another type's name of a JSON value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _text(content: Column) -> Column:
    """The text of a content value: itself, or its text parts with blanks between; parts of other types leave their blank."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    shown = F.transform(F.filter(parts, lambda p: _kind(p) == "OBJECT"), lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "text", F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))).otherwise(""))
    return F.when(_kind(content) == "STRING", F.try_variant_get(content, "$", "string")).when(_kind(content) == "ARRAY", trimmed(F.array_join(shown, " ")))


def dialects(lines: DataFrame) -> DataFrame:
    """(file, nested) of files of JSON lines, by the first line that is not blank."""
    first = lines.filter(trimmed(F.col("line")) != "").groupBy("file").agg(F.min_by("line", "no").alias("line"))
    v = first.select("file", F.try_parse_json("line").alias("v"))
    nested = (F.try_variant_get("v", "$.type", "string") == "say") | (_kind(F.try_variant_get("v", "$.message", "variant")).isin("OBJECT", "ARRAY"))
    return v.select("file", (F.coalesce(nested, F.lit(False)) | ~F.col("file").endswith(".jsonl")).alias("nested"))


def json_turns(lines: DataFrame) -> DataFrame:
    """(file, no, role, text, ts) of the turns in lines (file, no, line)."""
    rows = lines.join(dialects(lines), "file").withColumn("v", F.try_parse_json("line"))
    get = lambda path: F.try_variant_get("v", path, "variant")
    rows = rows.select("file", "no", "nested", *(get(f"$.{c}").alias(c) for c in ("type", "role", "content", "message", "timestamp")))
    said = F.col("nested") & (F.try_variant_get("type", "$", "string") == "say") & _kind(F.col("message")).isin("OBJECT", "ARRAY")
    inner = lambda c: F.try_variant_get("message", f"$.{c}", "variant")
    said = F.coalesce(said, F.lit(False))
    role = F.when(said, inner("role")).otherwise(F.col("role"))
    content = F.when(said, inner("content")).otherwise(F.col("content"))
    ts = F.when(said, inner("ts")).when(F.col("nested"), F.col("timestamp"))
    message = ~F.col("nested") & (F.try_variant_get("type", "$", "string") == "message")
    rows = rows.select("file", "no", said.alias("said"), F.coalesce(message, F.lit(False)).alias("message"), role.alias("role"), _text(content).alias("text"), F.try_variant_get(ts, "$", "string").alias("ts"))
    absent = F.col("role").isNull() | F.is_variant_null("role")
    named = F.when(~absent & (_kind(F.col("role")) == "STRING"), F.try_variant_get("role", "$", "string"))
    ok = F.when(absent, F.col("said") | F.col("message")).otherwise(named.isNotNull() & ((named != "") | F.col("said") | F.col("message")))
    return rows.filter(ok & (F.col("text") != "")).select("file", "no", role_of(F.coalesce(named, F.lit("assistant"))).alias("role"), "text", "ts")


def heading_turns(text: Column) -> Column:
    """array<struct<role, text>> of a text whose turns begin with headings such as `## User:` or `> ai:`; what stands before the
    first one is the assistant's, and turns without text are left out."""
    parts = F.split(text, f"(?mid)^(?={HEADING})")
    user = lambda p: p.rlike(r"(?i)^[#>]+[ \t]*(user|human):") & p.rlike(f"(?i)^{HEADING}")
    said = lambda p: F.when(p.rlike(f"(?i)^{HEADING}"), F.regexp_replace(p, r"^[#>]+[ \t]*\w+:[ \t]*", "")).otherwise(p)
    turns = F.transform(parts, lambda p: F.struct(F.when(user(p), "user").otherwise("assistant").alias("role"), trimmed(said(p)).alias("text")))
    return F.filter(turns, lambda t: t["text"] != "")


def conversation_lines(turns: DataFrame, most: int = 800) -> DataFrame:
    """(file, no, line): `ROLE: text` of at most `most` characters, tool turns left out, in the order of no."""
    return turns.filter("role <> 'tool'").select("file", "no", F.concat(F.upper("role"), F.lit(": "), F.left("text", F.lit(most))).alias("line"))


def conversation_text(turns: DataFrame, most: int = 800, longest: int = 1 << 16) -> DataFrame:
    """(file, part, text): those lines joined, `longest` lines to a part, so that no row holds a conversation of any length."""
    lines = conversation_lines(turns, most).withColumn("part", F.floor(F.col("no") / longest))
    return lines.groupBy("file", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("text"))


# -- registered queries --------------------------------------------------------------------------------------------------


def _lines(s, d) -> DataFrame:
    """Conversations as files: even ones nested, odd ones flat; parts of several types, plain lines, broken and blank ones."""
    c, t = F.col("conv_id"), F.col("turn")
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("more").alias("text")))
    role = F.when(t % 5 == 3, "Function").when(t % 5 == 2, "HUMAN").otherwise(F.col("role"))
    say = F.to_json(F.struct(F.lit("say").alias("type"), F.struct(role.alias("role"), parts.alias("content"), F.concat(F.lit("t"), t.cast("string")).alias("ts")).alias("message")))
    plain = F.to_json(F.struct(role.alias("role"), F.col("text").alias("content"), F.lit("now").alias("timestamp")))
    flat = F.to_json(F.struct(F.lit("message").alias("type"), F.when(t % 3 != 1, role).alias("role"), F.when(t % 4 != 2, F.col("text")).alias("content")))
    nested = F.when((t % 3 == 1), plain).otherwise(say)
    line = F.when(t % 7 == 5, F.lit("")).when(t % 7 == 6, F.lit('{"type": "say", "mess')).when(c % 2 == 0, nested).otherwise(flat)
    return table(s, d, "conversations").select(F.concat(F.lit("f"), c.cast("string"), F.when(c % 8 == 6, "").otherwise(".jsonl")).alias("file"), t.alias("no"), line.alias("line"))


def _headed(s, d) -> DataFrame:
    """Documents as texts with headings on some of their lines."""
    line = lambda x, i: F.when(i % 4 == 1, F.concat(F.lit("## User: "), x)).when(i % 4 == 2, F.concat(F.lit("> AI:"), x)).when(i % 4 == 3, F.concat(F.lit("## Notes "), x)).otherwise(x)
    return table(s, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


QUERIES = {
    "transcript_turns": lambda s, d: json_turns(_lines(s, d)).select("file", "no", "role", "text", "ts"),
    "transcript_lines": lambda s, d: conversation_lines(json_turns(_lines(s, d))),
    "transcript_headings": lambda s, d: _headed(s, d).select("doc_id", F.posexplode(heading_turns(F.col("text"))).alias("turn", "t")).select("doc_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text"),
}

_TURNS = r"""l AS (SELECT 'f' || conv_id || CASE WHEN conv_id % 8 = 6 THEN '' ELSE '.jsonl' END AS file, turn AS no, CASE WHEN turn % 7 = 5 THEN '' WHEN turn % 7 = 6 THEN '{"type": "say", "mess' WHEN conv_id % 2 = 0 THEN
 CASE WHEN turn % 3 = 1 THEN json_object('role', ro, 'content', text, 'timestamp', 'now')::VARCHAR ELSE json_object('type', 'say', 'message', json_object('role', ro, 'content', json_array(json_object('type', 'text', 'text', text), json_object('type', 'image', 'text', 'x'), json_object('type', 'text', 'text', 'more')), 'ts', 't' || turn))::VARCHAR END
 ELSE json_object('type', 'message', 'role', CASE WHEN turn % 3 <> 1 THEN ro END, 'content', CASE WHEN turn % 4 <> 2 THEN text END)::VARCHAR END AS line FROM (SELECT *, CASE turn % 5 WHEN 3 THEN 'Function' WHEN 2 THEN 'HUMAN' ELSE role END AS ro FROM conversations)),
v AS (SELECT file, no, CASE WHEN json_valid(line) AND line <> '' THEN line::JSON END AS j, first_value(line) OVER (PARTITION BY file ORDER BY trim(line) = '', no) AS head FROM l),
n AS (SELECT file, no, j, NOT ends_with(file, '.jsonl') OR CASE WHEN json_valid(head) THEN coalesce(head ->> '$.type' = 'say' OR json_type(head, '$.message') = 'OBJECT', false) ELSE false END AS nested FROM v WHERE j IS NOT NULL),
p AS (SELECT file, no, CASE WHEN nested AND j ->> '$.type' = 'say' THEN j -> '$.message' ELSE j END AS m, nested, nested AND coalesce(j ->> '$.type' = 'say', false) OR NOT nested AND coalesce(j ->> '$.type' = 'message', false) AS free FROM n),
q AS (SELECT file, no, CASE WHEN json_type(m, '$.content') = 'ARRAY' THEN trim(array_to_string(list_transform(json_extract(m, '$.content[*]'), lambda x: CASE WHEN x ->> '$.type' = 'text' THEN coalesce(x ->> '$.text', '') ELSE '' END), ' ')) WHEN json_type(m, '$.content') = 'VARCHAR' THEN m ->> '$.content' END AS text, nullif(m ->> '$.role', '') AS role, free, CASE WHEN nested THEN coalesce(m ->> '$.ts', m ->> '$.timestamp') END AS ts FROM p),
turns AS (SELECT file, no, CASE WHEN lower(role) IN ('user', 'human') THEN 'user' WHEN lower(role) IN ('tool', 'function') THEN 'tool' ELSE 'assistant' END AS role, text, ts FROM q WHERE text <> '' AND (role IS NOT NULL OR free))"""
SQL = {
    "transcript_turns": f"WITH {_TURNS} SELECT * FROM turns",
    "transcript_lines": f"WITH {_TURNS} SELECT file, no, upper(role) || ': ' || left(text, 800) AS line FROM turns WHERE role <> 'tool'",
    "transcript_headings": r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
h AS (SELECT doc_id, i, CASE i % 4 WHEN 1 THEN '## User: ' || line WHEN 2 THEN '> AI:' || line WHEN 3 THEN '## Notes ' || line ELSE line END AS line FROM l),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^(#+|>)[ \t]*(user|human):', 'i') THEN 'user' WHEN regexp_matches(line, '^(#+[ \t]*(assistant|ai|claude|cursor)|>[ \t]*(assistant|ai)):', 'i') THEN 'assistant' END AS role FROM h),
g AS (SELECT *, count(role) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
t AS (SELECT doc_id, k, coalesce(max(role), 'assistant') AS role, regexp_replace(string_agg(CASE WHEN role IS NULL THEN line ELSE regexp_replace(line, '^[#>]+[ \t]*\w+:[ \t]*', '') END, chr(10) ORDER BY i), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS text FROM g GROUP BY doc_id, k)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS turn, role, text FROM t WHERE text <> ''""",
}
