"""Transcripts to insights: turns, personal data, file paths, links to commits, verification and corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import SCRUB, STOP_WORDS, entities, file_paths, scrub, tickets, tokens, trim_sections
from quillon.operators.retrieval import _asked, _vectors, knn
from quillon.plans.lineage import cut
from quillon.session import table


def turn_lines(turns: DataFrame, most: int = 800) -> DataFrame:
    """(conv_id, turn, role, line): normalised role and text of `most` characters; tool turns are left out.

    A row a turn, in order by turn: a conversation of any length stays spread over tasks.
    """
    role = F.when(F.lower("role").isin("user", "human"), "user").when(F.lower("role").isin("tool", "function"), "tool").otherwise("assistant")
    rows = turns.select("conv_id", "turn", role.alias("role"), "text").filter("role <> 'tool'")
    return rows.select("conv_id", "turn", "role", F.concat(F.upper("role"), F.lit(": "), F.left("text", F.lit(most))).alias("line"))


def valid_insights(rows: DataFrame, json_col: str) -> DataFrame:
    """Insights that parse, with non-empty strings and a confidence from 0 to 1."""
    shape = "category string, statement string, evidence_quote string, scope string, confidence double"
    got = rows.withColumn("insight", F.from_json(json_col, shape))
    full = [F.length(F.trim(F.col(f"insight.{c}"))) > 0 for c in ("category", "statement", "evidence_quote", "scope")]
    ok = F.col("insight.confidence").between(0, 1)
    for f in full:
        ok = ok & f
    return got.filter(ok)


def quoted(insights: DataFrame, transcripts: DataFrame, key: str) -> DataFrame:
    """Insights whose evidence stands word for word in their transcript."""
    return insights.join(transcripts.select(key, "raw"), key).filter(F.col("raw").contains(F.col("insight.evidence_quote"))).drop("raw")


def linked(transcripts: DataFrame, commits: DataFrame, key: str, window_s: int) -> DataFrame:
    """(id, commit_id): the first commit by time within the window of each transcript, on equal keys.

    A range join by buckets of the window's width: a transcript looks in its own and the two next buckets, so the join is an
    equi-join on (key, bucket) and its tasks hold one window of one key.
    """
    at = F.unix_timestamp("ts")
    left = transcripts.select("id", key, at.alias("t")).withColumn("bucket", F.explode(F.array(*(F.floor(F.col("t") / window_s) + k for k in (-1, 0, 1)))))
    right = commits.select(F.col("id").alias("commit_id"), key, at.alias("c")).withColumn("bucket", F.floor(F.col("c") / window_s))
    both = left.join(right, [key, "bucket"]).filter(F.abs(F.col("t") - F.col("c")) <= window_s)
    return both.groupBy("id").agg(F.min(F.struct("c", "commit_id"))["commit_id"].alias("commit_id"))


def banded(ratio: Column, comparison: str, threshold: float) -> Column:
    """Score of a ratio against a threshold."""
    if comparison == "less_than":
        return F.when(ratio < threshold, 0.9).when(ratio < threshold * 3, 0.5).otherwise(0.2)
    if comparison == "contains":
        return F.when(ratio > 0, 0.85).otherwise(0.1)
    if comparison == "not_contains":
        return F.when(ratio == 0, 0.9).when(ratio < threshold, 0.5).otherwise(0.2)
    return F.when(ratio > threshold, 0.9).when(ratio > threshold / 3, 0.5).otherwise(0.2)


def verify(rows: DataFrame, group: str, matches: Column, comparison: str = "greater_than", threshold: float = 0.05) -> DataFrame:
    """Matching rows over all of each group, and the score of that ratio."""
    got = rows.groupBy(group).agg(F.count("*").alias("total"), F.count_if(matches).alias("matching"))
    ratio = F.when(F.col("total") > 0, F.col("matching") / F.col("total")).otherwise(0.0)
    return got.select(group, "total", "matching", banded(ratio, comparison, threshold).alias("score"))


def trust(stored: Column, new: Column) -> Column:
    """Corroborated: a tenth more, 1 at most; new: half of the confidence."""
    return F.when(stored.isNull(), F.round(0.5 * new, 6)).otherwise(F.least(F.lit(1.0), F.round(stored + 0.1, 6)))


def promote(decision: Column) -> Column:
    return F.when(decision == "approve", F.struct(F.lit("human_confirmed").alias("state"), F.lit(0.95).alias("trust"))).otherwise(F.struct(F.lit("aspirational").alias("state"), F.lit(0.2).alias("trust")))


def near_insights(vectors: DataFrame, asked: DataFrame, least: float = 0.82, k: int = 50) -> DataFrame:
    """(id, twin, similarity): the most similar other insight, smallest id of equal ones, of those more similar than `least`."""
    near = knn(asked, vectors, 2).filter("query_id <> id").withColumn("similarity", F.round(1 - F.col("distance"), 6)).filter(F.col("similarity") > least)
    return near.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("id")).alias("n"))).alias("m")).select(F.col("query_id").alias("id"), (-F.col("m.n")).alias("twin"), "m.similarity")


def _cosines(x, y):
    """Cosine similarities of two lists of vectors, to nine digits; 0 where one has no length."""
    import numpy as np

    p, q = (np.stack(t.to_numpy()).astype(np.float64) for t in (x, y))
    norms = np.linalg.norm(p, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
    return np.round(np.divide(p @ q.T, norms, out=np.zeros_like(norms), where=norms > 0), 9)


def kept_insights(rows: DataFrame, least: float, first: int = 2048, block: int = 4096) -> DataFrame:
    """(id, grp, embedding) of the rows that one pass in the order of id keeps: those not more similar than `least` to a kept one of their grp.

    Each round decides the `first` open rows of each group in one task, then drops the open rows near to those it kept: all open
    rows come later, so nothing else can bar them. A row is compared with kept rows only.
    """
    import numpy as np
    import pandas as pd

    kind = dict(rows.dtypes)
    shape = f"id {kind['id']}, grp {kind['grp']}, embedding {kind['embedding']}"
    most = rows.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // block))
    open_, kept = rows.select("id", "grp", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own")), None

    def chosen(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id", ignore_index=True)
        near = _cosines(x["embedding"], x["embedding"]) > least
        barred, at = np.zeros(len(x), bool), []
        for k in range(len(x)):
            if not barred[k]:
                at.append(k)
                barred |= near[k]
        return x.iloc[at][["id", "grp", "embedding"]].assign(last=x["id"].iloc[-1])

    def left(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if len(y):
            x = x[x["id"] > y["last"].iloc[0]]
        if len(x) and len(y):
            x = x[~(_cosines(x["embedding"], y["embedding"]) > least).any(axis=1)]
        return x[["id", "grp", "embedding", "own"]]

    while True:
        place = F.row_number().over(Window.partitionBy("grp").orderBy("id"))
        head = open_.withColumn("place", place).filter(F.col("place") <= first)
        now = cut(head.select("id", "grp", "embedding").groupBy("grp").applyInPandas(chosen, f"{shape}, last {kind['id']}"))
        if now.isEmpty():
            return kept if kept is not None else rows.select("id", "grp", "embedding")
        here = now.select("id", "grp", "embedding")
        kept = here if kept is None else kept.union(here)
        every = now.withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        open_ = cut(open_.groupBy("grp", "own").cogroup(every.groupBy("grp", "own")).applyInPandas(left, f"{shape}, own int"))


def first_insights(rows: DataFrame, group: str, least: float = 0.82, block: int = 4096) -> DataFrame:
    """(id, same_as): one after another in the order of id, an insight is new or corroborates the most similar kept one.

    Those that are kept are found first; each other row is then compared with the kept ones before it, block by block: the most
    similar counts, the earliest of equals. rows: id, embedding and group.
    """
    import numpy as np
    import pandas as pd

    rows = rows.select("id", F.col(group).alias("grp"), "embedding")
    kept = cut(kept_insights(rows, least))
    other = rows.join(kept.select("id"), "id", "left_anti")
    sizes = [r.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0 for r in (other, kept)]
    many = [max(1, -(-n // block)) for n in sizes]
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = other.withColumn("a", own(many[0])).withColumn("b", each(many[1]))
    right = kept.withColumn("b", own(many[1])).withColumn("a", each(many[0]))
    kind = dict(rows.dtypes)["id"]

    def nearest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "twin": [], "similarity": []})
        y = y.sort_values("id", ignore_index=True)
        sims = np.where(x["id"].to_numpy()[:, None] > y["id"].to_numpy()[None, :], _cosines(x["embedding"], y["embedding"]), -np.inf)
        best = sims.argmax(axis=1)
        out = pd.DataFrame({"id": x["id"].to_numpy(), "twin": y["id"].to_numpy()[best], "similarity": sims[np.arange(len(x)), best]})
        return out[out["similarity"] > least]

    found = left.groupBy("grp", "a", "b").cogroup(right.groupBy("grp", "a", "b")).applyInPandas(nearest, f"id {kind}, twin {kind}, similarity double")
    twin = found.groupBy("id").agg(F.min_by("twin", F.struct((-F.col("similarity")).alias("s"), "twin")).alias("same_as"))
    return kept.select("id", F.col("id").alias("same_as")).union(twin)


BASIC = [SCRUB[0], SCRUB[5]]  # e-mail and IPv4: the patterns that a regular expression without look-around can hold


def _moments(s, d, kind):
    return table(s, d, "events").filter(F.col("event_type") == kind).select(F.col("event_id").alias("id"), "user_id", "ts")


QUERIES = {
    "conv_transcript": lambda s, d: turn_lines(table(s, d, "conversations")),
    "conv_sizes": lambda s, d: turn_lines(table(s, d, "conversations")).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.char_length("line")).alias("chars"), F.count_if(F.col("role") == "user").alias("user_turns")),
    "pii_scrub": lambda s, d: table(s, d, "documents").select("doc_id", scrub(F.col("text")).alias("text")),
    "pii_scrub_basic": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(scrub(F.col("text"), BASIC), 256).alias("hash")),
    "file_paths": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(file_paths(F.concat("text", F.lit(" (lib/"), "source", F.lit("/d.rb) ./app/"), "lang", F.lit(".ts, http://a.b/c.html lib/"), "source", F.lit("/d.rb:"))), ",").alias("paths")),
    "ticket_ids": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(tickets(F.col("text")), ",").alias("tickets")),
    "entity_terms": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.array_join(entities(F.col("text")), ",").alias("names")),
    "token_estimates": lambda s, d: table(s, d, "documents").groupBy("source").agg(F.sum(tokens(F.col("text"))).alias("tokens"), F.round(F.sum(F.char_length("text") / 4), 2).alias("unrounded")),
    "section_trim": lambda s, d: table(s, d, "documents").select("doc_id", trim_sections(F.concat(F.lit("head\n## "), F.replace("text", F.lit("\n"), F.lit("\n## "))), F.lit("the tion onhe")).alias("trimmed")).select("doc_id", F.char_length("trimmed").alias("chars")),
    "pr_link_interval": lambda s, d: linked(_moments(s, d, "purchase"), _moments(s, d, "error"), "user_id", 12 * 3600),
    "verify_ratio": lambda s, d: verify(table(s, d, "documents"), "source", F.lower("text").contains("idiot") | F.lower("text").contains("@"), "greater_than", 0.02),
    "trust_update": lambda s, d: table(s, d, "labels").select("doc_id", trust(F.when(F.col("toxic") == 1, F.col("quality") * 0.95), F.col("quality") * 0.8).alias("trust"), promote(F.when(F.col("quality") == 1, "approve")).getField("state").alias("state")),
    "insight_twins": lambda s, d: near_insights(_vectors(s, d).drop("label"), _asked(s, d).drop("label"), 0.3),
    "insight_sequence": lambda s, d: first_insights(_vectors(s, d), "label", 0.3),
}
_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
SQL = {
    "conv_transcript": "SELECT conv_id, turn, CASE WHEN role IN ('user', 'human') THEN 'user' ELSE 'assistant' END AS role, upper(CASE WHEN role IN ('user', 'human') THEN 'user' ELSE 'assistant' END) || ': ' || substr(text, 1, 800) AS line FROM conversations WHERE role NOT IN ('tool', 'function')",
    "conv_sizes": "SELECT conv_id, count(*) AS turns, sum(length(substr(text, 1, 800)) + CASE WHEN role = 'user' THEN 6 ELSE 11 END)::BIGINT AS chars, count(*) FILTER (role = 'user') AS user_turns FROM conversations WHERE role NOT IN ('tool', 'function') GROUP BY 1",
    "pii_scrub_basic": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b', '[EMAIL]', 'g'), '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '[IP]', 'g')) AS hash FROM documents",
    # delimiters are doubled, since they may end one path and begin the next and RE2 has no look-ahead
    "file_paths": r"""WITH t AS (SELECT doc_id, regexp_replace(text || ' (lib/' || source || '/d.rb) ./app/' || lang || '.ts, http://a.b/c.html lib/' || source || '/d.rb:', '([\s`''"():#,])', '\1\1', 'g') AS t FROM documents), f AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '(?:^|[\s`''"(])([a-zA-Z0-9_\-./]+/[a-zA-Z0-9_\-./]+\.[a-zA-Z]{1,5})(?:[\s`''":#),]|$)', 1), lambda p: regexp_replace(p, '^[./]+', '')), lambda p: p <> '' AND NOT starts_with(p, 'http') AND contains(p, '/')) AS p FROM t) SELECT doc_id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS paths FROM f""",
    "entity_terms": rf"""WITH c AS (SELECT conv_id, turn, row_number() OVER () AS k, regexp_replace(text, 'https?://[^ \t\n\r\f\x0B]+', '', 'g') AS p FROM conversations), w AS (SELECT k, unnest(regexp_split_to_array(lower(regexp_replace(p, '[^a-zA-Z0-9_ \t\n\r\f\x0B-]', ' ', 'g')), '[ \t\n\r\f\x0B]+')) AS w FROM c), n AS (SELECT k, w, count(*) AS n FROM w WHERE length(w) > 2 AND w NOT IN {_STOP} GROUP BY 1, 2), o AS (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY n DESC, w) AS r FROM n), a AS (SELECT k, list(w ORDER BY r) AS t FROM o WHERE r <= 5 GROUP BY 1), e AS (SELECT conv_id, turn, list_filter(list_concat(regexp_extract_all(p, '[a-z][a-z0-9]*(?:_[a-z0-9]+)+'), regexp_extract_all(p, '[A-Z][a-z]+(?:[A-Z][a-z]+)+'), coalesce(t, [])), lambda x: length(x) > 2 AND lower(x) NOT IN {_STOP}) AS e, list_transform(e, lambda x: lower(x)) AS l FROM c LEFT JOIN a USING (k)) SELECT conv_id, turn, array_to_string(list_filter(e, lambda x, i: list_position(l, lower(x)) = i)[:5], ',') AS names FROM e""",
    "ticket_ids": r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '\b[A-Z]{2,}-\d+\b'), lambda x, i: list_position(regexp_extract_all(text, '\b[A-Z]{2,}-\d+\b'), x) = i), ',') AS tickets FROM documents",
    "token_estimates": "SELECT source, sum(ceil(length(text) / 4))::BIGINT AS tokens, round(sum(length(text) / 4), 2) AS unrounded FROM documents GROUP BY 1",
    "section_trim": r"WITH s AS (SELECT doc_id, 'head' || chr(10) || '## ' || replace(text, chr(10), chr(10) || '## ') AS t, list_transform(string_split(text, chr(10)), lambda x: '## ' || x) AS p FROM documents), h AS (SELECT *, list_filter(p, lambda x: contains(lower(x), 'the') OR contains(lower(x), 'tion') OR contains(lower(x), 'onhe')) AS k FROM s) SELECT doc_id, CASE WHEN len(p) <= 1 OR len(k) = 0 OR len(k) = len(p) THEN length(t) ELSE length('head' || chr(10) || chr(10) || array_to_string(k, chr(10) || chr(10)) || chr(10) || chr(10) || '_(' || (len(p) - len(k)) || CASE WHEN len(p) - len(k) > 1 THEN ' sections' ELSE ' section' END || ' omitted — not matching query)_') END::INT AS chars FROM h",
    "pr_link_interval": "SELECT p.event_id AS id, arg_min(e.event_id, (epoch(date_trunc('second', e.ts))::BIGINT, e.event_id)) AS commit_id FROM events p JOIN events e ON p.user_id = e.user_id AND abs(epoch(date_trunc('second', p.ts))::BIGINT - epoch(date_trunc('second', e.ts))::BIGINT) <= 43200 WHERE p.event_type = 'purchase' AND e.event_type = 'error' GROUP BY 1",
    "verify_ratio": "WITH r AS (SELECT source, count(*) AS total, count(*) FILTER (contains(lower(text), 'idiot') OR contains(text, '@')) AS matching FROM documents GROUP BY 1) SELECT source, total, matching, CASE WHEN matching / total > 0.02::DOUBLE THEN 0.9 WHEN matching / total > 0.02::DOUBLE / 3 THEN 0.5 ELSE 0.2 END::DOUBLE AS score FROM r",
    "trust_update": "SELECT doc_id, CASE WHEN toxic = 1 THEN least(1.0, round(quality * 0.95 + 0.1, 6)) ELSE round(0.5 * quality * 0.8, 6) END::DOUBLE AS trust, CASE WHEN quality = 1 THEN 'human_confirmed' ELSE 'aspirational' END AS state FROM labels",
    "insight_twins": "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT a.id, b.id AS twin, round(1 - round(1 - list_cosine_similarity(a.e, b.e), 6), 6) AS similarity FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0) SELECT * FROM n WHERE similarity > 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, twin) = 1",
}
