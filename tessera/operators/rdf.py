"""RDF as a table of triples: source, s, p, o, o_kind ('iri' or 'literal'), lang, datatype."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import node_uri, property_uri

#: The namespace of written graphs, and of the vocabularies used.
BASE = "http://www.example.org/auto_ontology#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: The schema types of data types.
XSD_TYPES = {"string": "string", "number": "decimal", "boolean": "boolean", "date": "date", "datetime": "dateTime", "array": "string", "object": "string"}

TRIPLE = ["s", "p", "o", "o_kind", "lang", "datatype"]


def graph_triples(nodes: DataFrame, edges: DataFrame, digits: int = 8) -> DataFrame:
    """A property graph as triples: types, labels, properties and relations.

    ``digits`` of a hash name a node: with 8, as written graphs have it, nodes of a large graph meet; with 32 each stays itself.
    """
    none = F.lit(None).cast("string")
    uri = lambda c: F.concat(F.lit(BASE), node_uri(F.col(c), digits))
    triple = lambda p, o, kind, lang=none: F.struct(p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), lang.alias("lang"), none.alias("datatype"))
    fixed = F.array(
        triple(F.lit(RDF + "type"), F.when(F.col("kind") == "Class", OWL + "Class").otherwise(OWL + "NamedIndividual"), "iri"),
        triple(F.lit(RDFS + "label"), F.col("label"), "literal", F.lit("zh")),
    )
    props = F.transform(F.map_entries("properties"), lambda e: triple(F.concat(F.lit(BASE), property_uri(e["key"], True)), e["value"], "literal"))
    about = nodes.select(uri("id").alias("s"), F.inline(F.concat(fixed, props)))
    links = edges.select(uri("src").alias("s"), F.concat(F.lit(BASE), F.col("relation")).alias("p"), uri("dst").alias("o"), F.lit("iri").alias("o_kind"), none.alias("lang"), none.alias("datatype"))
    return about.unionByName(links)


def turtle_lines(triples: DataFrame) -> DataFrame:
    """Triples as lines of N-Triples, which every Turtle reader takes; null for a triple that lacks a part."""
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    escaped = F.col("o")
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    tag = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^"), iri(F.col("datatype")))).otherwise("")
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), tag)
    return triples.select(F.concat(iri(F.col("s")), F.lit(" "), iri(F.col("p")), F.lit(" "), F.when(F.col("o_kind") == "iri", iri(F.col("o"))).otherwise(literal), F.lit(" .")).alias("value"))


def union(triples: DataFrame) -> DataFrame:
    """The set of all sources' triples."""
    return triples.select(*TRIPLE).distinct()


def provenance(triples: DataFrame) -> DataFrame:
    """Every triple with the sources that state it, sorted, and their number."""
    stated = triples.select(*TRIPLE, "source").distinct().groupBy(*TRIPLE).agg(F.array_sort(F.collect_list("source")).alias("sources"))
    return stated.withColumn("n_sources", F.size("sources").cast("long"))


def merge_report(triples: DataFrame) -> DataFrame:
    """One row: triples read, merged, stated once and duplicates."""
    counted = triples.groupBy(*TRIPLE).agg(F.count_distinct("source").alias("n"))
    return counted.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("merged"), F.count_if(F.col("n") == 1).alias("unique_triples"), F.sum(F.col("n") - 1).alias("duplicates"))


def type_counts(triples: DataFrame) -> DataFrame:
    """Subjects of each rdf:type by source."""
    typed = triples.where(F.col("p") == RDF + "type")
    return typed.groupBy("source", F.substring_index("o", "#", -1).alias("type")).agg(F.count_distinct("s").alias("n"))


def type_pivot(triples: DataFrame, sources: list[str]) -> DataFrame:
    """(type, a column for each of some sources, total): how many subjects of each type every file declares; 0 where a file has none.

    A subject counts once for each file that declares it; ``total`` counts it once, whatever the files, also those not asked for.
    """
    said = triples.where(F.col("p") == RDF + "type").select("source", "s", F.regexp_extract("o", "([^#/]*)$", 1).alias("type")).distinct()
    by = said.groupBy("type").pivot("source", sources).agg(F.count(F.lit(1)))
    whole = said.select("type", "s").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("total"))
    return whole.join(by, "type").select("type", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) for x in sources], "total")


def conflicts(triples: DataFrame) -> DataFrame:
    """(s, p, n_sources, n_versions): properties for which sources give different sets of values."""
    literal = triples.where("o_kind = 'literal'")
    sets = literal.groupBy("s", "p", "source").agg(F.array_sort(F.collect_set("o")).alias("os"))
    found = sets.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n_sources"), F.count_distinct("os").alias("n_versions"))
    return found.where("n_sources > 1 and n_versions > 1")


def labels(triples: DataFrame) -> DataFrame:
    """(s, label): one label for each subject, Chinese if there is one."""
    named = triples.where(F.col("p") == RDFS + "label")
    return named.groupBy("s").agg(F.min_by("o", F.struct((F.coalesce("lang", F.lit("")) != "zh").cast("int"), "o")).alias("label"))


def classes(triples: DataFrame) -> DataFrame:
    """All classes: declared, in the hierarchy, or as domain or range of a property."""
    p = F.col("p")
    declared = triples.where((p == RDF + "type") & (F.col("o") == OWL + "Class")).select("s")
    tree = triples.where(p == RDFS + "subClassOf")
    ends = triples.where(p.isin(RDFS + "domain", RDFS + "range") & (F.col("o_kind") == "iri") & ~F.col("o").startswith(XSD)).select(F.col("o").alias("s"))
    return declared.unionAll(tree.select("s")).unionAll(tree.select(F.col("o").alias("s"))).unionAll(ends).distinct()


def schema_links(triples: DataFrame, named: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(property, domain, range): object properties with both ends, each once; the ends as ``named`` makes them."""
    p = F.col("p")
    objects = triples.where((p == RDF + "type") & (F.col("o") == OWL + "ObjectProperty")).select(F.col("s").alias("property"))
    end = lambda name: triples.where(p == RDFS + name).select(F.col("s").alias("property"), named(F.col("o")).alias(name)).distinct()
    return end("domain").join(end("range"), "property").join(objects, "property", "left_semi")


def to_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples as graph nodes (id, label, kind, properties) and edges (src, dst, relation)."""
    kind = triples.where(F.col("p") == RDF + "type").groupBy("s").agg(F.min(F.when(F.col("o") == OWL + "Class", "Class").otherwise("NamedIndividual")).alias("kind"))
    values = triples.where((F.col("o_kind") == "literal") & (F.col("p") != RDFS + "label")).groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), ", ").alias("v"))
    props = values.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.substring_index("p", "#", -1), "v")))).alias("properties"))
    local = lambda c: F.substring_index(c, "#", -1)
    nodes = kind.join(labels(triples), "s", "left").join(props, "s", "left").select(local("s").alias("id"), "label", "kind", "properties")
    edges = triples.where((F.col("o_kind") == "iri") & (F.col("p") != RDF + "type")).select(local("s").alias("src"), local("o").alias("dst"), local("p").alias("relation"))
    return nodes, edges.distinct()


def class_table(triples: DataFrame) -> DataFrame:
    """(class, label, parent): every class with a label, its own name if it has none, and a parent.  Repeated triples count once."""
    known = classes(triples)
    parents = triples.where(F.col("p") == RDFS + "subClassOf").groupBy("s").agg(F.min("o").alias("parent"))
    # most labels may be those of properties, which aren't sorted and grouped
    named = labels(triples.where(F.col("p") == RDFS + "label").select("s", "p", "o", "lang").join(known, "s", "left_semi"))
    found = known.join(named, "s", "left").join(parents, "s", "left")
    return found.select(F.col("s").alias("class"), F.coalesce("label", F.substring_index("s", "#", -1)).alias("label"), "parent")


def data_properties(triples: DataFrame) -> DataFrame:
    """(class, property, data_type): literal properties by their domain; the type as in a schema.  Repeated triples count once."""
    p = F.col("p")
    declared = triples.where((p == RDF + "type") & F.col("o").isin(OWL + "DatatypeProperty", RDF + "Property")).select(F.col("s").alias("property")).distinct()
    # ends of what isn't declared as such go before anything is made one
    end = lambda name: triples.where(p == RDFS + name).select(F.col("s").alias("property"), F.col("o").alias(name)).join(declared, "property", "left_semi").distinct()
    found = end("domain").join(end("range"), "property", "left")
    literal = found.where(F.col("range").isNull() | F.col("range").startswith(XSD))
    kind = F.lit("string")
    for name, xsd in reversed([("number", "decimal"), ("number", "integer"), ("boolean", "boolean"), ("date", "date"), ("datetime", "dateTime")]):
        kind = F.when(F.col("range") == XSD + xsd, name).otherwise(kind)
    return literal.select(F.col("domain").alias("class"), "property", kind.alias("data_type"))


def schema_triples(types: DataFrame, links: DataFrame) -> DataFrame:
    """A schema as triples: types (id, label, properties of name and data_type), links (src, dst, relation, label)."""
    none = F.lit(None).cast("string")
    iri = lambda c: F.concat(F.lit(BASE), c)
    triple = lambda p, o, kind="iri", lang=none: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), lang.alias("lang"), none.alias("datatype"))
    a = types.select(iri(node_uri(F.col("id"))).alias("s"), F.inline(F.array(triple(RDF + "type", F.lit(OWL + "Class")), triple(RDFS + "label", F.col("label"), "literal", F.lit("zh")))))
    xsd = F.lit(XSD + "string")
    for name, value in XSD_TYPES.items():
        xsd = F.when(F.col("q.data_type") == name, XSD + value).otherwise(xsd)
    props = types.select(iri(node_uri(F.col("id"))).alias("owner"), F.explode("properties").alias("q"))
    b = props.select(iri(property_uri(F.col("q.name"))).alias("s"), F.inline(F.array(triple(RDF + "type", F.lit(OWL + "DatatypeProperty")), triple(RDFS + "domain", F.col("owner")), triple(RDFS + "range", xsd))))
    c = links.select(
        iri(property_uri(F.col("relation"))).alias("s"),
        F.inline(F.array(triple(RDF + "type", F.lit(OWL + "ObjectProperty")), triple(RDFS + "domain", iri(node_uri(F.col("src")))), triple(RDFS + "range", iri(node_uri(F.col("dst")))))),
    )
    return a.unionByName(b).unionByName(c).distinct()
