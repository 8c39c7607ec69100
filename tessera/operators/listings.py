"""Lists that pages show: projects with their domain and owner, documents in use, relations and their targets, actions to add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import first_by, number_rows


def project_rows(projects: DataFrame, domains: DataFrame, owners: DataFrame) -> DataFrame:
    """Projects with domain_name and owner_name, null where there is none; domains and owners: id, name."""
    named = lambda t, c: t.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    return projects.join(named(domains, "domain"), "domain", "left").join(named(owners, "owner"), "owner", "left")


def relation_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(relation, target): the different labels that a relation leads to, a row each; a node without a label goes by its id."""
    ends = edges.select("relation", F.col("dst").alias("id")).distinct()
    return ends.join(nodes.select("id", "label"), "id", "left").select("relation", F.coalesce("label", "id").alias("target")).distinct()


def referenced_documents(rows: DataFrame, source: str = "source") -> DataFrame:
    """The different documents that rows come from; null, empty and 'unknown' are none."""
    return rows.select(source).where(F.col(source).isNotNull() & ~F.col(source).isin("", "unknown")).distinct()


def only_keys(properties: Column, keys: list[str]) -> Column:
    """The properties that have one of some names."""
    return F.map_filter(properties, lambda k, v: k.isin(keys))


def missing_actions(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(id, label, target): action classes of a graph that a schema lacks, with what their first action edge leads to.

    nodes: id, label, kind; edges: src, dst, relation, pos; names: name, every name and label of the schema's action types.
    A target is given by its label, or by its id where it has none; null without an action edge.
    """
    actions = nodes.where((F.col("kind") == "Class") & F.col("id").startswith("AT_")).select("id", "label")
    known = names.select("name").where("name is not null").distinct()
    new = actions.join(known.withColumnRenamed("name", "label"), "label", "left_anti").join(known.withColumnRenamed("name", "id"), "id", "left_anti")
    first = edges.where("relation = 'action'").groupBy(F.col("src").alias("id")).agg(F.min(F.struct("pos", "dst")).alias("e")).select("id", F.col("e.dst").alias("dst"))
    ends = nodes.select(F.col("id").alias("dst"), F.col("label").alias("target"))
    found = new.join(first, "id", "left").join(ends, "dst", "left")
    return found.select("id", "label", F.coalesce("target", "dst").alias("target"))


def newest_first(documents: DataFrame) -> DataFrame:
    """Documents with ``index``, their place from 0 by age, the newest first; one of no date comes last, equals go by id."""
    return number_rows(documents, F.col("created").desc_nulls_last(), F.col("id"))


def by_name(domains: DataFrame) -> DataFrame:
    """Domains with ``index``, their place from 0 by name; equals go by id."""
    return number_rows(domains, F.col("name"), F.col("id"))


def sorted_projects(projects: DataFrame, by: str = "created", descending: bool = True) -> DataFrame:
    """Projects with ``index``, their place by created, n_nodes or name (in Chinese order); missing values come last, equals go by id."""
    key = F.collate("name", "zh") if by == "name" else F.col(by)
    return number_rows(projects, key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("id"))


def starting_with(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column begins with a text; a scan takes it as a pushed filter."""
    return rows.where(F.startswith(F.col(column), F.lit(prefix)))


def other_domains(domains: DataFrame, current: object, text: str = "") -> DataFrame:
    """Domains but for one, of which name or description holds a text in any case; a null description holds none."""
    holds = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    return domains.where((F.col("id") != F.lit(current)) & (holds("name") | holds("description")))


def extraction_counts(instances: DataFrame, actions: DataFrame, chunks: DataFrame, discarded: DataFrame) -> DataFrame:
    """One row of counts about an extraction: chunks by outcome (ok; null counts as failed), instances, relations, actions and what was discarded (n).

    Without chunks the success rate is 0.
    """
    a = instances.agg(F.count(F.lit(1)).alias("total_instances"), F.coalesce(F.sum(F.coalesce(F.greatest(F.size("object_props"), F.lit(0)), F.lit(0))), F.lit(0)).cast("long").alias("total_edges"))
    b = actions.agg(F.count(F.lit(1)).alias("total_action_instances"))
    c = discarded.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("discarded_edges_count"))
    done = F.count_if(F.coalesce("ok", F.lit(False)))
    d = chunks.agg(F.count(F.lit(1)).alias("total_chunks"), done.alias("successful_chunks"), (F.count(F.lit(1)) - done).alias("failed_chunks"), F.coalesce(F.try_divide(done, F.count(F.lit(1))), F.lit(0.0)).alias("success_rate"))
    return d.join(a, F.lit(True)).join(b, F.lit(True)).join(c, F.lit(True))  # one row each


def moves(projects: DataFrame, domains: DataFrame, wanted: DataFrame, source: object) -> DataFrame:
    """(project_id, project_name, from_domain, to_domain): what moving projects from a domain does; their number is the count moved.

    wanted: project_id, target.  A project that is not in the source domain, or a target that doesn't exist, gives no row; of two moves of a
    project only the one to the smallest target is done.
    """
    once = wanted.groupBy("project_id").agg(F.min("target").alias("target"))
    here = projects.where(F.col("domain") == F.lit(source)).select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), F.col("domain").alias("_source"))
    named = lambda k, name: domains.select(F.col("id").alias(k), F.col("name").alias(name))
    return here.join(once, "project_id").join(named("_source", "from_domain"), "_source").join(named("target", "to_domain"), "target").select("project_id", "project_name", "from_domain", "to_domain")


def outcomes(results: DataFrame) -> DataFrame:
    """One row: how many of a batch's results are ok and how many aren't; null isn't."""
    ok = F.coalesce("ok", F.lit(False))
    return results.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def united(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Several graphs as one: nodes once by id and edges once by ends and relation, the first in the order of graphs and rows.

    nodes: id, pos and more; edges: src, dst, relation, pos and more.
    """

    def one(parts: list[DataFrame], keys: list[str]) -> DataFrame:
        rows = parts[0].withColumn("_graph", F.lit(0))
        for i, part in enumerate(parts[1:], 1):
            rows = rows.unionByName(part.withColumn("_graph", F.lit(i)))
        return first_by(rows, keys, ["_graph", "pos"]).drop("_graph")

    return one([g[0] for g in graphs], ["id"]), one([g[1] for g in graphs], ["src", "dst", "relation"])


def first_of_report(rows: DataFrame, *order: str, n: int = 10) -> DataFrame:
    """The first duplicates or conflicts that a report lists, of a total order."""
    return rows.orderBy(*order).limit(n)


def collection(spark: SparkSession, name: str, size: int) -> DataFrame:
    """A vector collection by name, made empty where there is none; another vector length than the collection's is an error."""
    if not spark.catalog.tableExists(name):
        empty = spark.createDataFrame([], "vec_id long, embedding array<float>, text string, metadata string")
        empty.write.saveAsTable(name)
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('vector.size' = '{int(size)}')")
    held = spark.sql(f"SHOW TBLPROPERTIES {name} ('vector.size')").first()["value"]
    if held != str(size):
        raise ValueError(f"{name} holds vectors of {held} numbers, not {size}")
    return spark.table(name)


def collections(spark: SparkSession, prefix: str = "") -> list[str]:
    """The names of the vector collections, sorted."""
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary and t.name.startswith(prefix))


def domain_stats(domains: DataFrame, projects: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, n_projects, n_filled, n_nodes, n_edges): for every domain its projects, those with a node, and what their graphs hold.

    domains: id; projects: id, domain; nodes: tenant (the project); edges: tenant.  A domain without projects has zeros; projects of no known domain count for none.
    """
    counted = lambda rows, n: rows.groupBy(F.col("tenant").alias("project")).agg(F.count(F.lit(1)).alias(n))
    mine = projects.select(F.col("id").alias("project"), "domain").join(counted(nodes, "n_nodes"), "project", "left").join(counted(edges, "n_edges"), "project", "left")
    by = mine.groupBy("domain").agg(F.count(F.lit(1)).alias("n_projects"), F.count("n_nodes").alias("n_filled"), F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return domains.select(F.col("id").alias("domain")).join(by, "domain", "left").select("domain", *[zero(c) for c in ("n_projects", "n_filled", "n_nodes", "n_edges")])
