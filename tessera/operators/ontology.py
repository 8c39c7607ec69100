"""A schema and its instances written as triples, whole, and what a reader makes of the classes in them.

``ontology_triples`` says everything that a schema and instances say: classes with comment and superclass, properties with label, domain, comment and
range, relations, actions with their targets, individuals with types, relations, values and where they come from.  ``class_edges`` reads the edges between
classes that triples imply.

Defined results: triples are a set, of which ``statements`` may say one several times; a null or empty description, superclass or value says nothing; a class without id goes by its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import property_uri
from tessera.operators import rdf
from tessera.operators.rdf import BASE, OWL, RDF, RDFS, XSD, XSD_TYPES
from tessera.storage import written

#: Hidden values of an instance, the label of each as a property, and the type of its values.
HIDDEN = {"_source_file": ("源文件", None), "_source_chunk_index": ("切片索引", "integer"), "_source_quote": ("原文引用", None), "_domain": ("知识域", None)}

#: So many of the most frequent types are sent to all tasks.
HOT = 1000


def _named(name: Column) -> Column:
    return F.concat(F.lit(BASE), name)


def _said(rows: DataFrame, subject: Column, *parts: tuple) -> DataFrame:
    """(s, p, o, o_kind, lang, datatype), one for each row and (p, o, kind) whose object isn't null or empty; kind: iri, zh or the name of a type."""
    none = F.lit(None).cast("string")
    made = []
    for p, o, kind in parts:
        lang, datatype = (F.lit("zh") if kind == "zh" else none), (F.lit(XSD + kind) if kind not in ("iri", "zh") else none)
        p = F.lit(p) if isinstance(p, str) else p
        made.append(F.struct(subject.alias("s"), p.alias("p"), o.alias("o"), F.lit("iri" if kind == "iri" else "literal").alias("o_kind"), lang.alias("lang"), datatype.alias("datatype")))
    return rows.select(F.inline(F.array(*made))).where("o <> ''")


def ontology_triples(types: DataFrame, links: DataFrame, actions: DataFrame, instances: DataFrame) -> DataFrame:
    """``statements``, each once."""
    return statements(types, links, actions, instances).distinct()


def statements(types: DataFrame, links: DataFrame, actions: DataFrame, instances: DataFrame) -> DataFrame:
    """(s, p, o, o_kind, lang, datatype) of a schema and its instances; what two rows say comes twice.  For readers that count it once, so that nothing is shuffled whole.

    types: id, name, label, description, sub_class_of, properties (array of name, label, description, data_type); links: id, label, description, source, target; actions: id, label,
    description, target; instances: id, label, type, object_props (map to ids), data_props (map), and any of ``HIDDEN``.
    """
    uri = _named(F.coalesce(F.when(F.col("id") != "", F.col("id")), F.col("name")))
    above = F.when(F.col("sub_class_of") != "", _named(F.col("sub_class_of")))
    out = _said(types, uri, (RDF + "type", F.lit(OWL + "Class"), "iri"), (RDFS + "label", F.col("label"), "zh"), (RDFS + "comment", F.col("description"), "zh"), (RDFS + "subClassOf", above, "iri"))
    q = types.select(uri.alias("owner"), F.explode("properties").alias("q")).select("owner", "q.*")
    xsd = F.lit(XSD + "string")
    for name, value in XSD_TYPES.items():
        xsd = F.when(F.col("data_type") == name, XSD + value).otherwise(xsd)
    own = _named(property_uri(F.col("name")))
    out = out.unionByName(_said(
        q, own, (RDF + "type", F.lit(OWL + "DatatypeProperty"), "iri"), (RDFS + "label", F.coalesce("label", "name"), "zh"), (RDFS + "domain", F.col("owner"), "iri"),
        (RDFS + "comment", F.col("description"), "zh"), (RDFS + "range", F.when(F.col("data_type") != "", xsd), "iri"),
    ))
    for rows, ends in ((links, ("source", "target")), (actions, ("target", None))):
        about = [(RDF + "type", F.lit(OWL + "ObjectProperty"), "iri"), (RDFS + "label", F.col("label"), "zh"), (RDFS + "comment", F.col("description"), "zh"), (RDFS + "domain", _named(F.col(ends[0])), "iri")]
        if ends[1]:
            about.append((RDFS + "range", _named(F.col(ends[1])), "iri"))
        out = out.unionByName(_said(rows, _named(F.col("id")), *about))
    me = _named(F.col("id"))
    out = out.unionByName(_said(instances, me, (RDF + "type", F.lit(OWL + "NamedIndividual"), "iri"), (RDFS + "label", F.col("label"), "zh"), (RDF + "type", _named(F.col("type")), "iri")))
    linked = instances.select("id", F.explode("object_props").alias("p", "ts")).select("id", "p", F.explode("ts").alias("t"))
    out = out.unionByName(_said(linked, me, (_named(F.col("p")), _named(F.col("t")), "iri")))
    values = instances.select("id", F.explode("data_props").alias("name", "v"))
    out = out.unionByName(_said(values, own, (RDF + "type", F.lit(OWL + "DatatypeProperty"), "iri"), (RDFS + "label", F.col("name"), "zh")))
    out = out.unionByName(_said(values, me, (own, F.col("v"), "zh")))
    for hidden, (label, kind) in HIDDEN.items():
        if hidden in instances.columns:
            there = instances.where(F.col(hidden).isNotNull()).select("id", F.col(hidden).cast("string").alias("v"))
            out = out.unionByName(_said(there, _named(F.lit(hidden)), (RDF + "type", F.lit(OWL + "DatatypeProperty"), "iri"), (RDFS + "label", F.lit(label), "zh")))
            out = out.unionByName(_said(there, me, (_named(F.lit(hidden)), F.col("v"), kind or "zh")))
    return out


def _of_classes(typed: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (src, dst) whose dst is a known class.

    Types that many have, such as that of all relations, would go to one task each: the ``HOT`` most frequent are looked up once and sent to all tasks.
    """
    hot = typed.groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(HOT).select("dst")
    classes = known.select(F.col("class").alias("dst"))
    often = typed.join(F.broadcast(hot.join(classes, "dst", "left_semi")), "dst", "left_semi")
    return often.unionByName(typed.join(F.broadcast(hot), "dst", "left_anti").join(classes, "dst", "left_semi"))


def class_edges(triples: DataFrame) -> DataFrame:
    """(src, dst, relation, via): what triples say about classes: a class below another (subClassOf), a relation from its domain to its range (by its own name),
    an individual of a class (type), and a relation between the classes of two individuals that have it (via 'instances'), each once, by local names.
    Repeated triples count once.
    """
    local = lambda c: F.substring_index(c, "#", -1)
    known = written(rdf.classes(triples).select(F.col("s").alias("class")), "classes")
    below = triples.where(F.col("p") == RDFS + "subClassOf").select(F.col("s").alias("src"), F.col("o").alias("dst"), F.lit(RDFS + "subClassOf").alias("relation"), F.lit("schema").alias("via"))
    ends = rdf.schema_links(triples, local)
    linked = ends.select(F.col("domain").alias("src"), F.col("range").alias("dst"), F.col("property").alias("relation"), F.lit("schema").alias("via"))
    member = _of_classes(triples.where(F.col("p") == RDF + "type").select(F.col("s").alias("src"), F.col("o").alias("dst")), known).distinct()
    member = written(member, "members")  # read by three branches
    typed = member.select("src", "dst", F.lit(RDF + "type").alias("relation"), F.lit("schema").alias("via"))
    related = triples.where((F.col("o_kind") == "iri") & ~F.col("p").isin(RDF + "type", RDFS + "subClassOf", RDFS + "domain", RDFS + "range")).select("s", "p", "o").distinct()
    of = lambda end, name: member.select(F.col("src").alias(end), F.col("dst").alias(name))
    met = related.join(of("s", "src"), "s").join(of("o", "dst"), "o").select("src", "dst", F.col("p").alias("relation"), F.lit("instances").alias("via"))
    return below.unionByName(linked).unionByName(typed).unionByName(met).select(local("src").alias("src"), local("dst").alias("dst"), local("relation").alias("relation"), "via").distinct()
