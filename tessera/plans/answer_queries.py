"""Queries about questions and answers, extracted payloads put into graphs, and lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import model
from tessera.functions import text
from tessera.operators import answering, answers, export, graph_documents, listings, merging, questions
from tessera.plans.catalog import query
from tessera.storage import dealt, table

ASKED_SQL = """q AS (SELECT s_suppkey AS question, CASE s_suppkey % 4 WHEN 0 THEN 'what is ' || lpad(s_suppkey::VARCHAR, 6, '0') WHEN 1 THEN 'about "' || ['BUILDING', 'MACHINERY', 'nothing'][s_suppkey % 3 + 1] || '"'
    WHEN 2 THEN '风险等级 of all' ELSE 'hello' END AS text FROM supplier),
  n AS (SELECT 'customer:' || c_custkey AS id, c_name || ' ' || c_mktsegment || CASE WHEN c_custkey % 10 = 0 THEN ' 风险等级' ELSE '' END AS label, c_nationkey FROM customer)"""


def _asked(spark, sf):
    """Questions of all suppliers for the four rungs, and customers as nodes, a tenth of them with an attribute in the label."""
    k = F.col("s_suppkey")
    said = (
        F.when(k % 4 == 0, F.concat(F.lit("what is "), F.lpad(k.cast("string"), 6, "0"))).when(k % 4 == 1, F.concat(F.lit('about "'), F.element_at(F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("nothing")), (k % 3 + 1).cast("int")), F.lit('"')))
        .when(k % 4 == 2, "风险等级 of all").otherwise("hello")
    )
    nodes = model.nodes(spark, sf, ("customer",)).withColumn("label", F.concat("label", F.lit(" "), F.col("properties")["c_mktsegment"], F.when(F.col("pos") % 10 == 0, " 风险等级").otherwise("")))
    return table(spark, sf, "supplier").select(k.alias("question"), said.alias("text")), nodes


@query(
    "search_ladder",
    f"""WITH {ASKED_SQL},
    t AS (SELECT question, CASE question % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rung, CASE question % 4 WHEN 0 THEN lpad(question::VARCHAR, 6, '0') WHEN 1 THEN ['BUILDING', 'MACHINERY', 'nothing'][question % 3 + 1] ELSE '风险等级' END AS term FROM q WHERE question % 4 < 3),
    h AS (SELECT rung, term, id, label, c_nationkey, row_number() OVER (PARTITION BY rung, term ORDER BY id) AS k FROM (SELECT DISTINCT rung, term FROM t) JOIN n ON contains(label, term)),
    f AS (SELECT DISTINCT question, rung, 'node' AS type, label AS subject, NULL AS predicate, NULL AS object FROM t JOIN h USING (rung, term) WHERE k <= CASE rung WHEN 3 THEN 20 ELSE 10 END
      UNION ALL SELECT DISTINCT question, rung, 'edge', label, 'LIVES_IN', n_name FROM t JOIN (SELECT *, row_number() OVER (PARTITION BY term ORDER BY id) AS e FROM h WHERE rung = 1) USING (rung, term) JOIN nation ON n_nationkey = c_nationkey WHERE e <= 20)
    SELECT * FROM f UNION ALL SELECT question, 4, 'node', label, NULL, NULL FROM q, (SELECT * FROM n ORDER BY id LIMIT 20) WHERE question NOT IN (SELECT question FROM f)""",
)
def search_ladder(spark, sf):
    """Facts for a question of every supplier, by the first search that finds any."""
    asked, customers = _asked(spark, sf)
    nations = model.nodes(spark, sf, ("nation",))
    everything = customers.unionByName(nations.withColumn("id", F.concat(F.lit("~"), "id")))
    lives = model.edges(spark, sf, ("LIVES_IN",)).withColumn("dst", F.concat(F.lit("~"), "dst"))
    return questions.ladder(asked, everything, lives)


@query(
    "answered_questions",
    """WITH either AS (SELECT *, row_number() OVER (ORDER BY a, b) AS rank FROM (SELECT c_name AS a, n_name AS b FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT n_name, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey)),
    typed AS (SELECT 'part:' || p_partkey AS id, p_name, p_type, row_number() OVER (ORDER BY 'part:' || p_partkey) AS rank FROM part)
    SELECT s_suppkey AS question, 1::INTEGER AS rank, 'edge|' || s_name || '|LOCATED_IN|' || n_name AS cells FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 = 0
    UNION ALL SELECT s_suppkey, rank::INTEGER, a || '|LIVES_IN|' || b FROM supplier, either WHERE s_suppkey % 4 = 1 AND rank <= 20
    UNION ALL SELECT s_suppkey, 1, 'part:' || s_suppkey || '|' || p_name || '|' || p_brand FROM supplier JOIN part ON p_partkey = s_suppkey WHERE s_suppkey % 4 = 2
    UNION ALL SELECT s_suppkey, rank::INTEGER, id || '|' || p_name || '|' || p_type FROM supplier, typed WHERE s_suppkey % 4 = 3 AND rank <= 20""",
)
def answered_questions(spark, sf):
    """A question of every supplier, in four templates, planned and answered in one job."""
    k = F.col("s_suppkey")
    suppliers = table(spark, sf, "supplier")
    text = F.when(k % 4 == 0, F.concat(F.lit("where is "), "s_name", F.lit("?"))).when(k % 4 == 1, "who LIVES_IN what").when(k % 4 == 2, F.concat(F.lit('the p_brand of "part:'), k.cast("string"), F.lit('"'))).otherwise("all of p_type")
    listed = lambda *names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, pos long")
    plans = answering.planned(suppliers.select(k.alias("question"), text.alias("text")), suppliers.select(F.col("s_name").alias("name"), k.alias("pos")), listed("p_brand", "p_type"), listed("LIVES_IN", "LOCATED_IN"))
    nodes = model.nodes(spark, sf, ("customer", "supplier", "nation", "part"))
    found = answering.answered(plans, nodes, model.edges(spark, sf, ("LIVES_IN", "LOCATED_IN")))
    return found.select("question", "rank", F.array_join("cells", "|", "").alias("cells"))


@query(
    "corrected_intents",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'attribute_query' WHEN p_partkey % 3 = 1 THEN 'attribute_query' ELSE 'general_query' END AS query_type,
    CASE p_partkey % 3 WHEN 0 THEN 'AF' || lpad(p_partkey::VARCHAR, 6, '0') ELSE p_name END AS entity, CASE p_partkey % 3 WHEN 0 THEN '风险等级' WHEN 1 THEN '投资周期' END AS attribute FROM part""",
)
def corrected_intents(spark, sf):
    """Intents of three kinds, one of them with a concept for an entity and one with another name of an attribute."""
    k = F.col("p_partkey")
    code = F.concat(F.lit("AF"), F.lpad(k.cast("string"), 6, "0"))
    asked = table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 3 == 0, F.concat(code, F.lit("的风险等级是多少"))).otherwise(F.col("p_name")).alias("question"),
        F.when(k % 3 == 1, "attribute_query").otherwise("general_query").alias("query_type"), F.when(k % 3 == 0, "管理风险").otherwise(F.col("p_name")).alias("entity"),
        F.when(k % 3 == 1, "产品期限").alias("attribute"),
    )
    known = spark.createDataFrame([("投资周期", 0), ("风险等级", 1)], "name string, pos int")
    return questions.corrected_intents(asked, known).select("id", "query_type", "entity", "attribute")


@query("existing_relation", "SELECT c_name AS subject, 'LIVES_IN' AS predicate, n_name AS object FROM customer JOIN nation ON n_nationkey = c_nationkey ORDER BY c_name, n_name LIMIT 10")
def existing_relation(spark, sf):
    return questions.existing(model.edges(spark, sf), model.nodes(spark, sf), "LIVES_IN")


@query(
    "question_entities",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN '定期报告' WHEN 2 THEN p_name WHEN 3 THEN lpad(p_partkey::VARCHAR, 6, '0') ELSE '*' END AS entity FROM part""",
)
def question_entities(spark, sf):
    """Each rule for what a question is about, by turns."""
    k = F.col("p_partkey")
    said = (
        F.when(k % 5 == 0, F.concat("p_brand", F.lit("的风险等级"))).when(k % 5 == 1, "定期报告在哪里").when(k % 5 == 2, F.concat(F.lit('what is "'), "p_name", F.lit('"')))
        .when(k % 5 == 3, F.concat(F.lit("no "), F.lpad(k.cast("string"), 6, "0"))).otherwise("能转让吗")
    )
    return table(spark, sf, "part").select("p_partkey", questions.entity(said).alias("entity"))


@query(
    "full_context",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    a AS (SELECT conv_id, '【图谱事实】' || chr(10) || string_agg('- ' || CASE WHEN n % 2 = 1 THEN role || ' -> says -> ' || text ELSE role || ' (风险等级: ' || turn || '), turn: ' || turn END, chr(10) ORDER BY n) FILTER (n <= 20) AS facts,
      string_agg('[' || n || '] ' || substr(text, 1, 300) || ' | 属性：产品类型: ' || role || '...', chr(10) ORDER BY n) FILTER (n <= 5) AS hits FROM c GROUP BY conv_id)
    SELECT conv_id AS question, facts || chr(10) || chr(10) || '【相关文档】' || chr(10) || hits AS context FROM a""",
)
def full_context(spark, sf):
    """Every conversation's turns as edge and node facts by turns, and as passages."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("question"), F.col("turn").alias("pos"), "role", "text", "turn")
    numbered = rows.withColumn("odd", F.row_number().over(Window.partitionBy("question").orderBy("pos")) % 2 == 1)
    said = F.col("turn").cast("string")
    facts = numbered.select(
        "question", "pos", F.when(F.col("odd"), "edge").otherwise("node").alias("type"), F.col("role").alias("subject"), F.lit("says").alias("predicate"), F.col("text").alias("object"),
        F.create_map(F.lit("风险等级"), said, F.lit("hidden"), said).alias("properties"), F.array(F.struct(F.lit("turn").alias("key"), said.alias("value"))).alias("matched"), F.lit("").alias("data"),
    )
    return answers.full_context(facts, rows.withColumn("properties", F.create_map(F.lit("产品类型"), F.col("role"))))


@query(
    "single_path_context",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id AS question, string_agg('[' || n || '] ' || text, chr(10) || chr(10) ORDER BY n) AS context FROM c WHERE n <= 5 GROUP BY conv_id""",
)
def single_path_context(spark, sf):
    return answers.single_path(table(spark, sf, "conversations").select(F.col("conv_id").alias("question"), F.col("turn").alias("rank"), F.col("role").alias("file"), F.col("text").alias("quote")))[0]


@query(
    "single_path_sources",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id AS question, n::BIGINT AS ref, role AS file FROM c WHERE n <= 5""",
)
def single_path_sources(spark, sf):
    """The sources that the context of one path cites."""
    found = answers.single_path(table(spark, sf, "conversations").select(F.col("conv_id").alias("question"), F.col("turn").alias("rank"), F.col("role").alias("file"), F.col("text").alias("quote")))[1]
    return found.select("question", F.col("ref").cast("long").alias("ref"), "file")


@query("both_paths", "SELECT conv_id AS question, turn, role, false AS failed FROM conversations WHERE role = 'user'")
def both_paths(spark, sf):
    """What both searches give where one of them fails: the other's rows, and the error."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("question"), "turn", "role")

    def broken():
        raise ConnectionError("no vectors")

    a, b, errors = answers.both_paths(lambda: rows.where("role = 'user'"), broken, rows.limit(0), rows.limit(0))
    return a.unionByName(b).withColumn("failed", F.lit(list(errors) != ["vector"]))


@query("path_counts", "SELECT conv_id AS question, count_if(role = 'user')::BIGINT AS n_graph, count_if(role <> 'user')::BIGINT AS n_vector FROM conversations GROUP BY conv_id")
def path_counts(spark, sf):
    rows = table(spark, sf, "conversations").withColumnRenamed("conv_id", "question")
    return answers.path_counts(graph=rows.where("role = 'user'"), vector=rows.where("role <> 'user'"))


@query(
    "schema_lines",
    """SELECT 0 AS part, 0::BIGINT AS pos, '【当前图谱结构字典】' AS line UNION ALL SELECT 1, n_nationkey, '节点类型：' || n_name || ' | 包含属性：[' || n_name || ', name]' FROM nation
    UNION ALL SELECT 2, n_nationkey, '关系：(' || n_name || ') -[IN_REGION]-> (' || r_name || ')' FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def schema_lines(spark, sf):
    nations, regions = table(spark, sf, "nation"), table(spark, sf, "region")
    types = nations.select(F.col("n_name").alias("label"), F.array("n_name", F.lit("name")).alias("properties"), F.col("n_nationkey").alias("pos"))
    links = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("IN_REGION").alias("label"), F.col("n_name").alias("domain"), F.col("r_name").alias("range"), F.col("n_nationkey").alias("pos"))
    return answers.schema_lines(types, links)


@query(
    "either_schema_form",
    """SELECT p_partkey, 'C_' || p_partkey AS type_id, CASE p_partkey % 2 WHEN 0 THEN p_brand ELSE p_name END AS property, CASE p_partkey % 2 WHEN 0 THEN 'number' ELSE 'string' END AS data_type, CASE p_partkey % 2 WHEN 0 THEN 'P0' END AS parent,
    CASE p_partkey % 2 WHEN 0 THEN p_type ELSE '' END AS source_type FROM part""",
)
def either_schema_form(spark, sf):
    """A schema payload of every part, of the old form for even keys and of the new for odd ones."""
    k, c = F.col("p_partkey"), F.col
    type_id = F.concat(F.lit("C_"), k.cast("string"))
    old = F.to_json(F.struct(
        F.array(F.struct(type_id.alias("id"), c("p_name").alias("label"), F.array(F.lit("P0"), F.lit("P1")).alias("parent_classes"), F.array(F.struct(c("p_brand").alias("name"), F.lit("number").alias("data_type"))).alias("data_properties"))).alias("classes"),
        F.array(F.struct(F.lit("OP_1").alias("id"), c("p_type").alias("domain"))).alias("object_properties"),
    ))
    new = F.to_json(F.struct(F.array(F.struct(type_id.alias("id"), F.array(F.struct(c("p_name").alias("name"), F.lit("string").alias("data_type"))).alias("properties"))).alias("object_types")))
    found = merging.either_form(table(spark, sf, "part").select(k, F.when(k % 2 == 0, old).otherwise(new).alias("payload")))
    first = F.get("object_types", 0)
    prop = F.get(first["properties"], 0)
    return found.select("p_partkey", first["id"].alias("type_id"), prop["name"].alias("property"), prop["data_type"].alias("data_type"), first["sub_class_of"].alias("parent"), F.coalesce(F.get("link_types", 0)["source_object_type"], F.lit("")).alias("source_type"))


@query("payload_instances", "SELECT p_partkey, p_name AS label, p_type AS value FROM part")
def payload_instances(spark, sf):
    """An instance of every part, in a list for odd keys and in an object's field for even ones."""
    listed = F.array(F.struct(F.col("p_name").alias("label"), F.struct("p_type").alias("data_props")))
    payload = F.when(F.col("p_partkey") % 2 == 1, F.to_json(listed)).otherwise(F.to_json(F.struct(listed.alias("instances"))))
    found = merging.payload_instances(table(spark, sf, "part").select("p_partkey", payload.alias("payload")))
    return found.select("p_partkey", F.inline("instances")).select("p_partkey", "label", F.try_element_at("data_props", F.lit("p_type")).alias("value"))


@query("stored_properties", "SELECT p_partkey, p_brand AS source_file, 'd' AS domain, p_type AS kept, 2::INT AS n FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, p_name, 'd', p_type, 2 FROM part WHERE p_partkey % 2 = 0")
def stored_properties(spark, sf):
    """Hidden and visible properties of all parts; for even keys a visible one has the name that a hidden one gets."""
    hidden = F.create_map(F.lit("_source_file"), F.col("p_brand"), F.lit("_secret"), F.lit("x"), F.lit("_domain"), F.lit("own"), F.lit("kept"), F.col("p_type"))
    both = F.when(F.col("p_partkey") % 2 == 0, F.map_concat(hidden, F.create_map(F.lit("source_file"), F.col("p_name")))).otherwise(hidden)
    kept = table(spark, sf, "part").select("p_partkey", merging.stored_properties(both, F.lit("d")).alias("m"))
    return kept.select("p_partkey", *[F.col("m")[k].alias(k) for k in ("source_file", "domain", "kept")], (F.size("m") - 1).alias("n"))


@query("labelled_keys", "SELECT p_partkey, p_brand AS brand, p_type AS p_type FROM part")
def labelled_keys(spark, sf):
    defined = F.array(F.struct(F.lit("p_brand").alias("name"), F.lit("品牌").alias("label")), F.struct(F.lit("absent").alias("name"), F.lit("x").alias("label")))
    found = table(spark, sf, "part").select("p_partkey", merging.labelled_keys(F.create_map(F.lit("p_brand"), F.col("p_brand"), F.lit("p_type"), F.col("p_type")), defined).alias("m"))
    return found.select("p_partkey", F.col("m")["品牌"].alias("brand"), F.col("m")["p_type"].alias("p_type"))


@query(
    "relation_labels",
    "SELECT 'e_' || p_partkey || '_object_property_' || p_brand AS prop_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS label FROM part",
)
def relation_labels(spark, sf):
    """Ids of relations; those of even parts have edges that label them."""
    ids = table(spark, sf, "part").select(F.concat(F.lit("e_"), F.col("p_partkey").cast("string"), F.lit("_object_property_"), "p_brand").alias("prop_id"), "p_partkey", "p_name")
    stated = ids.where("p_partkey % 2 = 0").select("prop_id", F.col("prop_id").alias("id"), F.col("p_name").alias("label"), F.col("p_partkey").alias("pos"))
    return merging.relation_labels(ids, stated)


GRAPH_SCHEMA_SQL = """WITH RECURSIVE up AS (SELECT p_partkey AS child, p_partkey // 2 AS ancestor, 1 AS depth FROM part WHERE p_partkey > 1 UNION ALL SELECT child, ancestor // 2, depth + 1 FROM up WHERE ancestor > 1),
  own AS (SELECT p_partkey AS class, 'k' || (p_partkey % 7) AS property, p_name FROM part)"""


@query(
    "graph_schema",
    f"""{GRAPH_SCHEMA_SQL}, a AS (SELECT child, property, min(depth) AS depth FROM up JOIN own ON class = ancestor GROUP BY ALL)
    SELECT 'C_' || class AS class, property, 'direct' AS source, NULL AS "from" FROM own
    UNION ALL SELECT 'C_' || child, a.property, 'inherited', CASE WHEN a.depth = 1 THEN p.p_name END FROM a JOIN own o ON o.class = child LEFT JOIN own p ON p.class = child // 2 WHERE o.property <> a.property""",
)
def graph_schema(spark, sf):
    """The properties of a tree of classes, of which every part is one."""
    return merging.schema_properties(*_graph_schema(spark, sf))


@query("graph_schema_classes", "SELECT 'C_' || p_partkey AS id, p_name AS label, CASE WHEN p_partkey > 1 THEN 'C_' || p_partkey // 2 ELSE '' END AS parents FROM part WHERE p_partkey % 13 > 0")
def graph_schema_classes(spark, sf):
    """The classes themselves, with their parents; every thirteenth part is an action."""
    return merging.schema_classes(*_graph_schema(spark, sf, True)).select("id", "label", F.array_join("parents", ",").alias("parents"))


@query(
    "graph_schema_relations",
    "SELECT 'e_uses' AS id, 'uses' AS label, p_name AS domain, s_name AS range FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 13 > 0) JOIN part ON p_partkey = l_partkey JOIN (SELECT p_partkey AS k, p_name AS s_name FROM part) ON k = l_suppkey",
)
def graph_schema_relations(spark, sf):
    """What relations between classes the lines state."""
    return merging.schema_relations(*_graph_schema(spark, sf, True))


@query(
    "graph_schema_actions",
    """SELECT 'AT_' || p_partkey AS id, p_name AS label, coalesce((SELECT q.p_name FROM (SELECT l_suppkey FROM lineitem WHERE l_partkey = part.p_partkey ORDER BY l_orderkey * 10 + l_linenumber, 'C_' || l_suppkey LIMIT 1) JOIN part q ON q.p_partkey = l_suppkey), '') AS target
    FROM part WHERE p_partkey % 13 = 0""",
)
def graph_schema_actions(spark, sf):
    """Actions with the class that the first line of each names."""
    return merging.schema_actions(*_graph_schema(spark, sf, True))


def _graph_schema(spark, sf, lines=False):
    """The nodes and edges of the graph of classes."""
    k = F.col("p_partkey").cast("long")
    parts = table(spark, sf, "part")
    class_id = lambda c: F.concat(F.lit("C_"), c.cast("string"))
    nodes = parts.select(class_id(k).alias("id"), F.lit(None).cast("string").alias("raw_id"), F.col("p_name").alias("label"), F.lit("Class").alias("kind"), F.create_map(F.concat(F.lit("k"), (k % 7).cast("string")), F.lit("x")).alias("properties"), k.alias("pos"))
    up = parts.where("p_partkey > 1").select(class_id(k).alias("src"), class_id(F.floor(k / 2)).alias("dst"), F.lit("subclass_of").alias("relation"), F.lit("subClassOf").alias("label"), F.lit("").alias("prop_id"), k.alias("pos"))
    if not lines:
        return nodes, up
    name = lambda c: F.concat(F.when(c % 13 == 0, "AT_").otherwise("C_"), c.cast("string"))
    nodes = nodes.withColumn("id", F.concat(F.when(F.col("pos") % 13 == 0, "AT_").otherwise("C_"), F.col("pos").cast("string")))
    up = up.where(F.col("pos") % 13 > 0)
    line = table(spark, sf, "lineitem")
    p, q, at = F.col("l_partkey"), F.col("l_suppkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    pairs = dealt(line.where(p % 13 > 0).select("l_partkey", "l_suppkey"), line.count(), "l_partkey", "l_suppkey").distinct()
    uses = pairs.select(name(p).alias("src"), name(q).alias("dst"), F.lit("object_property").alias("relation"), F.lit("uses").alias("label"), F.lit("e_uses").alias("prop_id"), F.lit(0).cast("long").alias("pos"))
    does = line.where(p % 13 == 0).select(name(p).alias("src"), name(q).alias("dst"), F.lit("action").alias("relation"), F.lit("does").alias("label"), F.lit("").alias("prop_id"), at.alias("pos"))
    return nodes, up.unionByName(uses).unionByName(does)


@query(
    "instances_in_graph",
    """SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, 'CONTAINS' AS label, 'object_property' AS relation FROM lineitem GROUP BY ALL
    UNION ALL SELECT 'order:' || o_orderkey, 'C_order', 'type', 'type' FROM orders UNION ALL SELECT 'part:' || p_partkey, 'C_part', 'type', 'type' FROM part
    UNION ALL SELECT 'action_Node_' || substr(md5('ship ' || o_orderkey || '::ActionInstance'), 1, 8), 'AT_ship', 'type', 'type' FROM orders GROUP BY ALL
    UNION ALL SELECT a, 'order:' || k, 'ship', 'action' FROM (SELECT 'action_Node_' || substr(md5('ship ' || o_orderkey || '::ActionInstance'), 1, 8) AS a, min(o_orderkey) AS k FROM orders GROUP BY 1)""",
)
def instances_in_graph(spark, sf):
    """Orders and parts as instances, every other part named by label, and an action for each order: the edges of them all."""
    return _instances_in_graph(spark, sf)[1]


@query(
    "instance_nodes",
    """SELECT 'order:' || o_orderkey AS id, 'order ' || o_orderkey AS label, 'order' AS class_label, NULL AS brand FROM orders UNION ALL SELECT 'part:' || p_partkey, p_name, 'part', p_brand FROM part
    UNION ALL SELECT 'action_Node_' || substr(md5('ship ' || o_orderkey || '::ActionInstance'), 1, 8), min('ship ' || o_orderkey), 'ship', NULL FROM orders GROUP BY 1""",
)
def instance_nodes(spark, sf):
    """The nodes that the same instances and actions add."""
    found = _instances_in_graph(spark, sf, "label")[0]  # of actions whose hashes meet, the one with the smallest label
    return found.select("id", "label", "class_label", F.try_element_at("properties", F.lit("品牌")).alias("brand"))


def _instances_in_graph(spark, sf, first="pos"):
    """Nodes and edges; of actions with one id the one with the smallest pos or label counts."""
    line, orders, parts = (table(spark, sf, n) for n in ("lineitem", "orders", "part"))
    named = line.select("l_orderkey", model.key("part", "l_partkey").alias("target")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("target").alias("targets"))
    none = F.create_map().cast("map<string,array<string>>")
    empty = F.create_map().cast("map<string,string>")
    a = orders.join(named, "o_orderkey", "left").select(
        model.key("order", "o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("label"), F.lit("C_order").alias("type"), empty.alias("data_props"),
        F.when(F.col("targets").isNotNull(), F.create_map(F.lit("OP_contains"), F.col("targets"))).otherwise(none).alias("object_props"), F.col("o_orderkey").cast("long").alias("pos"),
    )
    b = parts.select(model.key("part", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit("C_part").alias("type"), F.create_map(F.lit("p_brand"), F.col("p_brand")).alias("data_props"), none.alias("object_props"), F.col("p_partkey").cast("long").alias("pos"))
    actions = orders.select(
        F.concat(F.lit("ship "), F.col("o_orderkey").cast("string")).alias("label"), F.lit("ship").alias("action_type"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("target"),
        F.lit("C_order").alias("target_type"), empty.alias("parameters"), F.col("o_orderkey").cast("long").alias("pos"),
    )
    actions = actions.withColumn("pos", F.col(first))
    classes = spark.createDataFrame([("C_order", "", "order", None, 0), ("C_part", "", "part", [("p_brand", "品牌")], 1), ("AT_ship", "AT_ship", "ship", None, 2)], "id string, raw_id string, label string, definitions array<struct<name:string,label:string>>, pos int")
    labels = spark.createDataFrame([("OP_contains", "CONTAINS")], "prop_id string, label string")
    return merging.instances_in_graph(a.unionByName(b), actions, classes, classes.select("id"), labels)


@query(
    "plain_triples",
    """WITH t AS (SELECT 'nation%3A' || n_nationkey AS s, 'type' AS p, 'NamedIndividual' AS o FROM nation UNION ALL SELECT 'region%3A' || r_regionkey, 'type', 'NamedIndividual' FROM region
    UNION ALL SELECT 'part%3A' || p_partkey, 'type', 'NamedIndividual' FROM part UNION ALL SELECT 'part%3A' || p_partkey, 'label', p_name FROM part UNION ALL SELECT 'part%3A' || p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT 'part%3A' || p_partkey, 'p_type', p_type FROM part
    UNION ALL SELECT 'nation%3A' || n_nationkey, 'label', n_name FROM nation UNION ALL SELECT 'region%3A' || r_regionkey, 'label', r_name FROM region UNION ALL SELECT 'nation%3A' || n_nationkey, 'IN_REGION', 'region%3A' || n_regionkey FROM nation)
    SELECT * FROM t UNION ALL SELECT * FROM (VALUES ('p_brand', 'type', 'DatatypeProperty'), ('p_brand', 'label', 'p_brand'), ('p_type', 'type', 'DatatypeProperty'), ('p_type', 'label', 'p_type'), ('IN_REGION', 'type', 'ObjectProperty'), ('IN_REGION', 'label', 'in region'))""",
)
def plain_triples(spark, sf):
    """All triples of a graph of regions, nations and parts under their own names, by what follows the namespace."""
    found = merging.plain_triples(model.nodes(spark, sf, ("region", "nation", "part")), model.edges(spark, sf, ("IN_REGION",)).withColumn("label", F.lit("in region")))
    local = lambda c: F.substring_index(c, "#", -1)
    return found.select(local("s").alias("s"), local("p").alias("p"), F.when(F.col("o_kind") == "iri", local("o")).otherwise(F.col("o")).alias("o"))


@query("ttl_download", "SELECT c_custkey AS project, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS content, c_custkey % 3 <> 0 AS stored FROM customer")
def ttl_download(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("project"), "c_name", "c_mktsegment")
    made = rows.where("project % 3 < 2").select("project", F.when(F.col("project") % 3 == 0, F.col("c_name")).otherwise("").alias("content"))
    return merging.download(made, rows.select("project", F.col("c_mktsegment").alias("content")))


@query("newest_documents", "SELECT event_id AS id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS index FROM events")
def newest_documents(spark, sf):
    return listings.newest_first(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created"))).select("id", "index")


@query("domains_by_name", "SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_name, n_nationkey) - 1 AS index FROM nation")
def domains_by_name(spark, sf):
    return listings.by_name(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).select("id", "index")


@query(
    "project_schema_classes",
    """SELECT c_nationkey AS tenant, 'kept ' || c_nationkey AS class, 'a,b' AS properties, true AS cached FROM customer WHERE c_nationkey % 3 = 0 GROUP BY 1, 2
    UNION ALL SELECT c_nationkey, c_mktsegment, string_agg(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END, ',' ORDER BY CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END), false FROM customer WHERE c_nationkey % 3 > 0 GROUP BY 1, 2""",
)
def project_schema_classes(spark, sf):
    """The classes of every nation's customers: as its document keeps them, which is so for a third, else as the customers show."""
    return _project_schemas(spark, sf)[0].select("tenant", "class", F.array_join("properties", ",").alias("properties"), "cached")


@query(
    "project_schema_relations",
    """SELECT c_nationkey AS tenant, 'r' AS relation, 'Unknown' AS domain, 'kept ' || c_nationkey AS range, true AS cached FROM customer WHERE c_nationkey % 3 = 0 GROUP BY 1
    UNION ALL SELECT DISTINCT a.c_nationkey, 'NEXT', a.c_mktsegment, b.c_mktsegment, false FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 25 AND b.c_nationkey = a.c_nationkey WHERE a.c_nationkey % 3 > 0""",
)
def project_schema_relations(spark, sf):
    """Their relations, in the same way."""
    return _project_schemas(spark, sf)[1]


def _project_schemas(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_nationkey").cast("long")
    props = F.create_map(F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd"), F.lit("x"))
    nodes = c.select(k.alias("tenant"), F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("class_label"), props.alias("properties"))
    edges = nodes.select("tenant", F.col("id").alias("src"), (F.col("id") + 25).alias("dst"), F.lit("NEXT").alias("relation"))
    kept = F.concat(F.lit('{"schema": {"classes": [{"id": "kept '), k.cast("string"), F.lit('", "data_properties": ["a", "b"]}], "object_properties": [{"label": "r", "range": "kept '), k.cast("string"), F.lit('"}]}}'))
    documents = c.select(k.alias("tenant"), F.when(k % 3 == 0, kept).when(k % 3 == 1, '{"schema": {"classes": []}}').otherwise("broken").alias("document")).distinct()
    return graph_documents.project_schemas(documents, nodes, edges)


@query(
    "graph_search_documents",
    """WITH e AS (SELECT c_nationkey AS tenant, c_name AS a, n_name AS b FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT tenant, count(*) + 1 AS n_nodes, count(*) AS n_edges, min(a) || '>' || min(b) AS first FROM e GROUP BY tenant""",
)
def graph_search_documents(spark, sf):
    """Each nation's customers as search documents of their structure, told by what they hold."""
    k = F.col("c_nationkey").cast("long")
    customers = table(spark, sf, "customer").select(k.alias("tenant"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("label"), F.lit("owl:NamedIndividual").alias("class_label"))
    used = customers.select("tenant").distinct()
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("tenant"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.lit("owl:Class").alias("class_label")).join(used, "tenant", "left_semi")
    edges = customers.select("tenant", F.col("id").alias("src"), F.concat(F.lit("n"), F.col("tenant").cast("string")).alias("dst"), F.lit("LIVES_IN").alias("relation"))
    found = export.graph_documents(customers.unionByName(nations), edges, 50)
    held = found.select("tenant", F.from_json("content", "nodes array<struct<id:string,entity_type:string>>, edges array<struct<source:string,target:string,weight:int>>").alias("c")).select("tenant", "c.*")
    first = F.min(F.array_min(F.transform("edges", lambda e: F.concat(e["source"], F.lit(">"), e["target"]))))
    return held.groupBy("tenant").agg(F.sum(F.size("nodes")).alias("n_nodes"), F.sum(F.size("edges")).alias("n_edges"), first.alias("first"))


@query("sorted_projects", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_name DESC, c_custkey) - 1 AS index FROM customer")
def sorted_projects(spark, sf):
    return listings.sorted_projects(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "name").select("id", "index")


@query("starting_with", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1')")
def starting_with(spark, sf):
    return listings.starting_with(table(spark, sf, "part"), "p_brand", "Brand#1").select("p_partkey")


@query("other_domains", "SELECT s_suppkey AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey <> 7 AND (contains(lower(s_name), '7') OR contains(lower(n_name), '7'))")
def other_domains(spark, sf):
    nations = table(spark, sf, "nation")
    rows = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("description"))
    return listings.other_domains(rows, 7, "7").select("id")


@query(
    "extraction_counts",
    """SELECT (SELECT count(*) FROM documents) AS total_chunks, (SELECT count(*) FROM documents WHERE n_chars % 7 > 0) AS successful_chunks, (SELECT count(*) FROM documents WHERE n_chars % 7 = 0) AS failed_chunks,
    (SELECT avg((n_chars % 7 > 0)::INT) FROM documents) AS success_rate, (SELECT count(*) FROM part) AS total_instances,
    (SELECT count_if(p_size % 2 = 0)::BIGINT FROM part) AS total_edges, (SELECT count(*) FROM orders) AS total_action_instances, (SELECT sum(n_regionkey)::BIGINT FROM nation) AS discarded_edges_count""",
)
def extraction_counts(spark, sf):
    links = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("r"), F.array("p_name")))
    return listings.extraction_counts(table(spark, sf, "part").select(links.alias("object_props")), table(spark, sf, "orders"), table(spark, sf, "documents").select((F.col("n_chars") % 7 > 0).alias("ok")), table(spark, sf, "nation").select(F.col("n_regionkey").alias("n")))


@query(
    "project_moves",
    "SELECT c_custkey AS project_id, c_name AS project_name, a.n_name AS from_domain, b.n_name AS to_domain FROM customer JOIN nation a ON a.n_nationkey = 3 JOIN nation b ON b.n_nationkey = c_custkey % 30 WHERE c_nationkey = 3",
)
def project_moves(spark, sf):
    """What moving every project of one domain does; some of the targets don't exist."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("domain"))
    domains = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return listings.moves(rows, domains, rows.select(F.col("id").alias("project_id"), (F.col("id") % 30).cast("long").alias("target")), 3)


@query("batch_outcomes", "SELECT count_if(o_orderstatus = 'F')::BIGINT AS succeeded, count_if(o_orderstatus <> 'F')::BIGINT AS failed FROM orders")
def batch_outcomes(spark, sf):
    return listings.outcomes(table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("ok")))


@query(
    "united_graphs",
    "SELECT 'part:' || p_partkey AS id, p_name AS label FROM part WHERE p_size < 30 UNION ALL SELECT 'part:' || p_partkey, p_brand FROM part WHERE p_size >= 30",
)
def united_graphs(spark, sf):
    """Nodes of two graphs; those of both have the first one's label."""
    parts = table(spark, sf, "part").select(model.key("part", "p_partkey").alias("id"), "p_name", "p_brand", "p_size", F.col("p_partkey").alias("pos"))
    none = model.edges(spark, sf, ("IN_REGION",)).withColumn("pos", F.lit(0))
    a, b = parts.where("p_size < 30").select("id", F.col("p_name").alias("label"), "pos"), parts.where("p_size > 20").select("id", F.col("p_brand").alias("label"), "pos")
    return listings.united((a, none), (b, none))[0].select("id", "label")


@query(
    "united_edges",
    """WITH e AS (SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, l_returnflag AS relation, 0 AS g, l_linenumber AS pos, 'first' AS label FROM lineitem WHERE l_linenumber < 5
      UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, l_returnflag, 1, l_linenumber, 'second' FROM lineitem WHERE l_linenumber > 2)
    SELECT src, dst, relation, pos::INTEGER AS pos, label FROM e QUALIFY row_number() OVER (PARTITION BY src, dst, relation ORDER BY g, pos) = 1""",
)
def united_edges(spark, sf):
    """Edges of two graphs of lines, each once; those of both as the first has them."""
    lines = table(spark, sf, "lineitem").select(model.key("order", "l_orderkey").alias("src"), model.key("part", "l_partkey").alias("dst"), F.col("l_returnflag").alias("relation"), F.col("l_linenumber").cast("int").alias("pos"))
    nodes = table(spark, sf, "part").select(model.key("part", "p_partkey").alias("id"), F.col("p_partkey").alias("pos"))
    a, b = lines.where("pos < 5").withColumn("label", F.lit("first")), lines.where("pos > 2").withColumn("label", F.lit("second"))
    return listings.united((nodes, a), (nodes, b))[1].select("src", "dst", "relation", "pos", "label")


@query("first_duplicates", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 1 ORDER BY p_brand LIMIT 10")
def first_duplicates(spark, sf):
    found = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return listings.first_of_report(found, "p_brand")


@query("continuations", """SELECT p_partkey, '{"a": "' || p_name || '"}' AS content FROM part""")
def continuations(spark, sf):
    """Each kind of opening before a JSON answer, by turns."""
    k = F.col("p_partkey") % 4
    body = F.concat(F.lit('{"a": "'), "p_name", F.lit('"}'))
    said = F.concat(F.when(k == 0, "```json\n").when(k == 1, "好的，继续：").when(k == 2, "Sure, go on: ").otherwise("Here is the continuation: "), body, F.when(k == 0, "\n```").otherwise(" \n"))
    return table(spark, sf, "part").select("p_partkey", text.continuation(said).alias("content"))
