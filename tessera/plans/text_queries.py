"""Queries over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import aggregates, graph, retrieval
from tessera.plans.catalog import query
from tessera.sources import files
from tessera.storage import shared_dir, table
from tessera.streaming import tasks
from tessera.streaming.expiry import expiring_states, uncancelled, use_rocksdb


@query(
    "fixed_chunks",
    """WITH c AS (SELECT doc_id, CASE WHEN length(text) <= 800 THEN [text] ELSE [substr(text, i + 1, 800) FOR i IN range(0, length(text), 720)] END AS cs FROM documents)
    SELECT doc_id, unnest(range(len(cs)))::INT AS chunk, unnest([md5(x) FOR x IN cs]) AS digest FROM c""",
)
def fixed_chunks(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.posexplode(text.fixed_chunks(F.col("text"), 800, 80)).alias("chunk", "c"))
    return found.select("doc_id", "chunk", F.md5("c").alias("digest"))


@query("recursive_chunks")
def recursive_chunks(spark, sf):
    """Greedy packing has no SQL form; tests hold it against hand-made cases."""
    split = text.recursive_chunks(1500, 10)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(split("text")).alias("chunk", "c")).select("doc_id", "chunk", F.length("c").alias("n_chars"), F.md5("c").alias("digest"))


@query(
    "global_chunk_index",
    """WITH c AS (SELECT doc_id, unnest(range(greatest(1, (length(text) + 799) // 800))) AS chunk FROM documents) SELECT doc_id, chunk, row_number() OVER (ORDER BY doc_id, chunk) - 1 AS index FROM c""",
)
def global_chunk_index(spark, sf):
    """Chunks numbered through all documents, without one task that sees them all."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 800).cast("int"))
    chunks = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).withColumn("chunk", F.col("chunk").cast("long"))
    return graph.number_rows(chunks, "doc_id", "chunk").select("doc_id", "chunk", "index")


@query(
    "html_to_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'g') AS h FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS h FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM b)
    SELECT page_id, trim(regexp_replace(h, '[ \t\r\n]+', ' ', 'g')) AS text FROM c""",
)
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("product_codes", "SELECT s_suppkey, list_distinct(regexp_extract_all('AB' || lpad(s_suppkey::VARCHAR, 6, '0') || 'G und ' || s_name, '[A-Z]{1,3}[0-9]{5,7}[A-Z]?'))[1] AS code FROM supplier")
def product_codes(spark, sf):
    said = F.concat(F.lit("AB"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit("G und "), "s_name")
    return table(spark, sf, "supplier").select("s_suppkey", text.product_codes(said)[0].alias("code"))


@query("keyword_counts", "SELECT doc_id, contains(text, 'token')::BIGINT + contains(text, 'the')::BIGINT + contains(text, 'und')::BIGINT AS n FROM documents")
def keyword_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.keywords_in(F.col("text"), ["token", "the", "und"])).cast("long").alias("n"))


@query("relation_types", r"SELECT DISTINCT p_type, CASE WHEN upper(translate(p_type, ' :-', '___')) IN ('', 'NONE') THEN 'RELATED_TO' ELSE upper(translate(p_type, ' :-', '___')) END AS relation FROM part")
def relation_types(spark, sf):
    return table(spark, sf, "part").select("p_type", text.relation_type(F.col("p_type")).alias("relation")).distinct()


@query("local_times", "SELECT event_id, strftime(ts + INTERVAL 8 HOURS, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS at FROM events")
def local_times(spark, sf):
    return table(spark, sf, "events").select("event_id", text.shanghai_time(F.col("ts")).alias("at"))


@query(
    "citations",
    r"""WITH a AS (SELECT conv_id, turn, 'as in [' || (turn % 4) || '] and [' || (conv_id % 3 + 1) || ']' AS answer FROM conversations),
    c AS (SELECT conv_id, turn, unnest(regexp_extract_all(answer, '\[([0-9]+)\]', 1))::BIGINT AS ref FROM a) SELECT conv_id, turn, ref, count(*) AS n FROM c WHERE ref BETWEEN 1 AND 2 GROUP BY ALL""",
)
def citations(spark, sf):
    said = F.concat(F.lit("as in ["), F.col("turn") % 4, F.lit("] and ["), F.col("conv_id") % 3 + 1, F.lit("]"))
    found = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(text.citations(said, F.lit(2))).alias("ref")).withColumn("ref", F.col("ref").cast("long"))
    return found.groupBy("conv_id", "turn", "ref").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fused_references",
    """WITH b AS (
      SELECT conv_id AS question, 0 AS path, turn AS pos, text AS quote FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, 1, turn, text FROM conversations),
    h AS (SELECT *, row_number() OVER (PARTITION BY question, substr(quote, 1, 50) ORDER BY path, pos, quote) AS k FROM b),
    p AS (SELECT *, row_number() OVER (PARTITION BY question, path ORDER BY pos, quote) AS n FROM h WHERE k = 1)
    SELECT question, row_number() OVER (PARTITION BY question ORDER BY path, pos, quote) AS ref, CASE path WHEN 0 THEN 'graph' ELSE 'vector' END AS path, substr(quote, 1, 300) AS quote FROM p WHERE n <= 5""",
)
def fused_references(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("question"), F.col("turn").alias("pos"), F.col("text").alias("quote"), "role")
    return retrieval.fused_references(rows.where("role = 'user'"), rows)


@query(
    "answer_context",
    r"""WITH f AS (SELECT conv_id AS question, turn, '- ' || role || ' says ' || text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT question, 'Facts' || chr(10) || string_agg(line, chr(10) ORDER BY n) FILTER (n <= 20) || chr(10) || 'Passages' || chr(10) || (SELECT string_agg('- ' || substr(text, 1, 300), chr(10) ORDER BY turn) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) c WHERE c.conv_id = question AND k <= 5) AS context FROM f GROUP BY question""",
)
def answer_context(spark, sf):
    rows = table(spark, sf, "conversations").withColumnsRenamed({"conv_id": "question", "turn": "pos"})
    facts = rows.select("question", "pos", F.col("role").alias("subject"), F.lit("says").alias("predicate"), F.col("text").alias("object"))
    return retrieval.context(facts, rows)


@query("searched", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') OR contains(lower(source), 'the')")
def searched(spark, sf):
    return aggregates.searched(table(spark, sf, "documents").select("doc_id", "text", "source"), "the", "text", "source").select("doc_id")


@query("duplicate_texts", "SELECT text_hash, n, first_id FROM (SELECT md5(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text) WHERE n > 1")
def duplicate_texts(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.md5("text").alias("text_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    return d.where("n > 1")


@query("conversation_turns", "SELECT conv_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def conversation_turns(spark, sf):
    """A file's parts joined in order."""
    found = aggregates.ordered_list(table(spark, sf, "conversations"), "conv_id", "text", "turn")
    return found.select("conv_id", F.size("values").cast("long").alias("n"), F.md5(F.array_join("values", "\n")).alias("digest"))


@query("file_markers", "SELECT doc_id, md5(chr(10) || chr(10) || '<<<<<< 文件开始：' || source || ' >>>>>>' || chr(10) || text || chr(10) || '<<<<<< 文件结束：' || source || ' >>>>>>' || chr(10)) AS digest FROM documents WHERE trim(text) <> ''")
def file_markers(spark, sf):
    return files.marked(table(spark, sf, "documents").select("doc_id", F.col("source").alias("name"), "text")).select("doc_id", F.md5("text").alias("digest"))


@query("repaired_json")
def repaired_json(spark, sf):
    """Payloads cut short, repaired; SQL has no form of it."""
    props = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"instances": [{"a": 1}, '), "props", F.when(F.col("event_id") % 2 == 0, "]}").otherwise(', {"b": ')).alias("payload"))
    return files.repaired(props, "payload").select("event_id", F.get_json_object("payload", "$.instances[0].a").cast("int").alias("a"), F.length("payload").alias("n"))


EVENTS_SQL = "e AS (SELECT event_id, user_id AS task_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, value / 100 AS progress FROM events)"


def task_events(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind.isin("view", "click"), "running").when(kind == "purchase", "completed").otherwise("failed")
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), (F.col("value") / 100).alias("progress"))


@query("task_latest", f"WITH {EVENTS_SQL} SELECT task_id, event_id, n FROM (SELECT task_id, event_id, count(*) OVER (PARTITION BY task_id) AS n, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS i FROM e) WHERE i = 1")
def task_latest(spark, sf):
    return tasks.latest(task_events(spark, sf)).select("task_id", "event_id", "n")


_STATES_SQL = f"""WITH {EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS i FROM e),
    f AS (SELECT task_id, min(i) FILTER (status IN ('completed', 'failed')) AS stop, min(i) FILTER (status = 'running') AS run FROM o GROUP BY task_id),
    k AS (SELECT o.task_id, o.i, o.status, o.progress, i <= coalesce(stop, i) AND NOT (status = 'pending' AND i > least(coalesce(run, 1000000000), coalesce(stop, 1000000000))) AS ok FROM o JOIN f ON f.task_id = o.task_id)
    SELECT task_id, coalesce(max_by(status, i) FILTER (ok), 'pending') AS status, count_if(ok)::BIGINT AS accepted, count_if(NOT ok)::BIGINT AS refused FROM k GROUP BY task_id"""


@query("task_states_disordered", _STATES_SQL)
def task_states_disordered(spark, sf):
    """The stateful stream over events that arrive up to an hour late, in four lots; an event far ahead lets the watermark pass them all."""
    import uuid

    rows = task_events(spark, sf)
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3_600_000_000))
    lots = rows.withColumn("_at", arrival)
    cuts = lots.approxQuantile("_at", [0.25, 0.5, 0.75], 0.01)
    path = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):  # four lots, one after the other
        mine = lots.where((F.col("_at") > low if low is not None else F.lit(True)) & (F.col("_at") <= high if high is not None else F.lit(True))).drop("_at")
        if high is None:
            mine = mine.unionByName(rows.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("task_id"), (F.col("ts") + F.expr("interval 1000 days")).alias("ts"), F.lit("running").alias("status"), F.lit(0.0).alias("progress")))
        mine.coalesce(1).write.mode("append").parquet(path)
    use_rocksdb(spark)
    out = f"{path}-states"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    stream = expiring_states(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), hours=10**6)
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    last = graph.first_by(spark.read.parquet(out), ["task_id"], ["batch", "accepted", "refused"], last=True)
    return last.where("task_id >= 0").select("task_id", "status", "accepted", "refused")


@query(
    "chunks_cancelled",
    f"""WITH {EVENTS_SQL} SELECT event_id, NOT EXISTS (SELECT 1 FROM e c WHERE c.status = 'failed' AND c.task_id = e.task_id AND c.ts <= e.ts AND c.ts >= e.ts - INTERVAL 24 HOURS) AS passed FROM e""",
)
def chunks_cancelled(spark, sf):
    """Every event, as a piece of work, held against what its task's failures of the day before stop."""
    rows = task_events(spark, sf)
    passed, stopped = uncancelled(rows.select("event_id", "task_id", "ts"), rows.where("status = 'failed'").select("task_id", F.col("ts").alias("at")))
    return passed.select("event_id", F.lit(True).alias("passed")).unionByName(stopped.select("event_id", F.lit(False).alias("passed")))


@query("task_states", _STATES_SQL)
def task_states(spark, sf):
    return tasks.folded(task_events(spark, sf)).select("task_id", "status", "accepted", "refused")


@query("task_states_streamed", None)
def task_states_streamed(spark, sf):
    """The same by the stateful stream, run over the table once; its last update of each task."""
    import uuid

    rows = task_events(spark, sf)
    path = f"{shared_dir(spark)}/task-events-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    stream = tasks.task_states(spark.readStream.schema(rows.schema).parquet(path))
    out = f"{path}-states"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return graph.first_by(spark.read.parquet(out), ["task_id"], ["batch"], last=True).select("task_id", "status", "accepted", "refused")


@query("progress_messages", f"""WITH {EVENTS_SQL} SELECT event_id, task_id, status FROM e""")
def progress_messages(spark, sf):
    data = tasks.progress_json(task_events(spark, sf))
    return data.select("event_id", F.get_json_object("data", "$.task_id").cast("long").alias("task_id"), F.get_json_object("data", "$.status").alias("status"))


@query("events_hourly", f"WITH {EVENTS_SQL} SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, status, count(*) AS n FROM e GROUP BY ALL")
def events_hourly(spark, sf):
    """An addition: windows on event time."""
    return tasks.windowed_counts(task_events(spark, sf), late=None).select(F.unix_timestamp("start").alias("start"), "status", "n")


@query(
    "event_sessions",
    f"""WITH {EVENTS_SQL}, g AS (SELECT task_id, ts, (ts >= lag(ts) OVER (PARTITION BY task_id ORDER BY ts) + INTERVAL 30 MINUTES)::INT AS cut FROM e), s AS (SELECT task_id, ts, sum(coalesce(cut, 0)) OVER (PARTITION BY task_id ORDER BY ts) AS k FROM g)
    SELECT task_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY task_id, k""",
)
def event_sessions(spark, sf):
    return tasks.sessions(task_events(spark, sf)).select("task_id", F.unix_micros("start").alias("start"), "n")
