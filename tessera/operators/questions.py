"""Questions in plain words: what they name, corrected intents, and the ladder of searches that answers them.

All of it works on tables of questions; one question is a table of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import PRODUCT_CODE, keywords_in, quoted
from tessera.operators import containment, matching
from tessera.operators.retrieval import edge_facts, top
from tessera.storage import written

#: The forms of product codes, the strictest first.
CODES = (PRODUCT_CODE, "[A-Z]{1,2}[0-9]{5,6}", "[0-9]{5,7}")
#: Attributes that the search by keywords knows.
SEARCH_WORDS = ["产品类型", "投资周期", "投资期限", "募集方式", "风险等级", "业绩基准", "收益率", "起点金额", "申购金额", "认购金额"]
#: Attributes before which "的" marks an entity.
OWNED_SEARCHED = ["起点金额", "申购金额", "认购金额", "产品类型", "风险等级", "投资周期", "业绩比较基准", "收益率", "募集方式"]
OWNED = ["起点金额", "申购金额", "认购金额", "产品类型", "风险等级", "投资周期", "业绩比较基准", "收益率", "募集方式", "披露频率", "披露时间", "频率", "时间", "披露渠道"]
#: Entities known by name, words about frequency, and what makes a question a general one.
KNOWN_ENTITIES = ["净值披露", "信息披露", "定期报告", "临时报告", "产品管理人", "产品托管人", "销售机构"]
FREQUENCY = ["多长时间", "多久", "频率", "一次"]
GENERAL = "能.*吗|可以.*吗|是否|有没有|风险|费|收益|期限|赎回|认购|申购"
#: Wordings that ask for a value.
ASKS_VALUE = [
    "多少", "是什么", "是多少", "几天", "几年", "几个月", "几个", "多久", "多长时间", "多长", "是几", "为多少", "什么时候", "哪天", "哪种",
    "是哪", "有多少", "的期限", "的天数", "的周期", "的日期",
]
#: Words about attributes in the order of preference, where a product is named and where a concept was taken for an entity.
PRODUCT_WORDS = [
    "产品期限", "投资期限", "产品存续期", "存续期", "投资周期", "业绩比较基准", "比较基准", "起点金额", "募集方式", "产品成立日", "成立日期", "成立日",
    "产品开放日", "开放日", "运作模式", "产品类型", "产品类别", "风险等级", "投资比例限制", "清算期", "支付频率", "募集规模", "募集币种", "披露频率",
    "披露渠道", "分红方式", "费率", "费用", "期限", "周期", "天数", "比较基准", "业绩", "基准", "起点", "金额", "类型", "比例", "限制", "频率", "渠道",
    "方式", "风险", "等级",
]
CONCEPT_ATTRIBUTES = [
    "产品期限", "投资期限", "存续期", "投资周期", "业绩比较基准", "比较基准", "起点金额", "募集方式", "成立日", "开放日", "运作模式", "产品类型",
    "风险等级", "投资比例限制", "清算期", "支付频率", "募集规模", "披露频率", "分红方式", "费率", "费用", "期限", "周期", "天数", "基准", "起点",
    "金额", "类型", "比例", "限制", "频率", "渠道", "方式",
]
#: Concepts that are no product.
CONCEPTS = [
    "管理风险", "市场风险", "操作风险", "信用风险", "流动性风险", "合规风险", "风险", "税收", "增值税", "费用", "风险类型", "封闭期", "开放期",
    "申购费", "赎回费", "管理费", "托管费", "销售服务费", "业绩报酬",
]
#: How many entities and keywords of a question are searched, and how many rows each search gives.
ENTITIES, KEYWORDS, NODES, LINKS, ANY = 3, 5, 10, 20, 20


def codes(question: Column) -> Column:
    """All product codes of a question, in any of the forms, each once."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(question, F.lit(f"({form})"), 1) for form in CODES]))


def owners(question: Column, attributes: list[str]) -> Column:
    """What stands before "的" and one of some attributes."""
    return F.regexp_extract_all(question, F.lit(rf"([^\s的\"]+)\s*的\s*(?:{'|'.join(attributes)})"), 1)


def entity(question: Column) -> Column:
    """The entity that a question is about, by rules alone.

    The first of: an owner of an attribute; a known name; what stands before a word of frequency; a quotation; a code; "*" for
    a general question; the question itself.  Null for null.
    """
    often = F.regexp_extract_all(question, F.lit(rf"([^\s的\"]+?)\s*(?:{'|'.join(FREQUENCY)})"), 1)
    firsts = [owners(question, OWNED), keywords_in(question, KNOWN_ENTITIES), often, quoted(question), codes(question)]
    return F.coalesce(*[F.get(found, 0) for found in firsts], F.when(question.rlike(GENERAL), "*"), question)


def _first(rows: DataFrame, keys: list[str], n: int, *order: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def search_terms(questions: DataFrame) -> DataFrame:
    """(question, rung, term): 1 product codes; 2 the first quoted and owning entities; 3 the first keywords."""
    text = F.col("text")
    rungs = [codes(text), F.slice(F.concat(quoted(text), owners(text, OWNED_SEARCHED)), 1, ENTITIES), F.slice(keywords_in(text, SEARCH_WORDS), 1, KEYWORDS)]
    listed = F.array(*[F.struct(F.lit(i + 1).alias("rung"), terms.alias("terms")) for i, terms in enumerate(rungs)])
    return questions.select("question", F.inline(listed)).select("question", "rung", F.explode("terms").alias("term")).distinct()


def ladder(questions: DataFrame, nodes: DataFrame, edges: DataFrame, number: str = "产品编号", share: str = "份额名称") -> DataFrame:
    """(question, rung, type, subject, predicate, object): facts found by the first search that finds any for a question.

    questions: question, text.  The searches are those of ``search_terms``: codes in labels, ids or the ``number`` property,
    with the relations of the labels; entities in labels or the ``share`` property; keywords in labels; and at last (rung 4) the
    first individuals of all.  All but keywords find individuals only.  Each gives the first rows by id.  A question with null text has rung 4; without nodes there are no facts.
    """
    asked = written(search_terms(questions), "asked")
    terms = asked.select("rung", "term").distinct()  # each search is made once, however many questions want it
    prop = lambda key: F.try_element_at("properties", F.lit(key))
    single = F.coalesce(F.col("kind") == "NamedIndividual", F.lit(False))
    texts = nodes.select("id", single.alias("single"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("text")) for f, c in (("label", F.col("label")), ("id", F.col("id")), ("number", prop(number)), ("share", prop(share)))])))
    found = containment.holders(texts.select(F.struct("id", "field", "single").alias("id"), "text"), terms).select("id.*", "term")
    fits = {1: ("label", "id", "number"), 2: ("label", "share"), 3: ("label",)}
    ok = F.lit(False)
    for rung, fields in fits.items():
        ok = ok | (F.col("rung") == rung) & F.col("field").isin(*fields) & (F.lit(rung == 3) | F.col("single"))
    hits = terms.join(found, "term").where(ok)
    named = hits.select("rung", "term", "id").distinct()
    # the first of a question's keywords together are among the first of each
    firsts = written(_first(named.where("rung < 3"), ["rung", "term"], NODES, "id").unionByName(_first(named.where("rung = 3"), ["rung", "term"], ANY, "id")), "firsts")
    few = asked.join(firsts, ["rung", "term"]).select("question", "rung", "id").distinct()
    few = few.where("rung < 3").unionByName(_first(few.where("rung = 3"), ["question"], ANY, "id"))
    label = nodes.select("id", F.coalesce("label", "id").alias("subject"))
    none = F.lit(None).cast("string")
    labelled = written(firsts.select("id").distinct().join(label, "id"), "labelled")
    node_rows = few.join(labelled, "id").select("question", "rung", F.lit("node").alias("type"), "subject", none.alias("predicate"), none.alias("object")).distinct()
    starts = hits.where("rung = 1 and field = 'label'").select("term", F.col("id").alias("src"))
    linked = starts.join(edges.select("src", "dst", "relation"), "src").join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("object")), "dst")
    linked = _first(linked, ["term"], LINKS, "src", "relation", "dst").join(asked.where("rung = 1").select("question", "term"), "term").join(nodes.select(F.col("id").alias("src"), F.col("label").alias("subject")), "src")
    facts = node_rows.unionByName(linked.select("question", F.lit(1).alias("rung"), F.lit("edge").alias("type"), "subject", F.col("relation").alias("predicate"), "object").distinct())
    best = facts.groupBy("question").agg(F.min("rung").alias("rung"))
    rest = questions.select("question").distinct().join(best, "question", "left_anti")
    any_nodes = F.broadcast(top(nodes.where(single).select("id", F.coalesce("label", "id").alias("subject")), ANY, "id"))  # ANY rows
    last = rest.join(any_nodes, F.lit(True)).select("question", F.lit(4).alias("rung"), F.lit("node").alias("type"), "subject", none.alias("predicate"), none.alias("object"))
    return facts.join(best, ["question", "rung"]).select(last.columns).unionByName(last)


def corrected_intents(intents: DataFrame, known: DataFrame) -> DataFrame:
    """Intents that a model gave, set right by what the question says.

    intents: question, query_type, entity, attribute; known: name, pos of the attributes.  A product code in the question is the
    entity, unless the entity given is a code; a question that names a product and asks a value is about the first word of
    PRODUCT_WORDS that an attribute goes by; a concept is no entity; an unknown attribute is replaced by the one it
    means; a question about an attribute without entity takes the code.  Nulls stay where no rule sets them.
    """
    spark = intents.sparkSession
    words = spark.createDataFrame([(w,) for w in sorted({*PRODUCT_WORDS, *CONCEPT_ATTRIBUTES})], "asked string")
    asked = words.unionByName(intents.select(F.col("attribute").alias("asked")).where("asked <> ''").distinct())
    means = matching.attributes(asked, known).select("asked", "name")
    word_names = F.broadcast(means.join(F.broadcast(words), "asked", "left_semi").agg(F.map_from_entries(F.collect_list(F.struct("asked", "name"))).alias("_words")))  # one row, a fixed list
    names = known.select(F.col("name").alias("attribute")).distinct().withColumn("_known", F.lit(True))

    def first_word(wanted: list[str], text: Column) -> Column:
        fits = F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: F.contains(text, w) & F.map_contains_key(F.col("_words"), w))
        return F.try_element_at(F.col("_words"), F.get(fits, 0))

    rows = intents.join(word_names, F.lit(True)).withColumn("_codes", F.regexp_extract_all("question", F.lit(f"({PRODUCT_CODE})"), 1))
    code = F.get("_codes", 0)
    is_code = F.coalesce(F.col("entity").rlike(f"^(?:{PRODUCT_CODE})"), F.lit(False))
    rows = rows.withColumns({"_code": code, "entity": F.when(code.isNotNull() & ~is_code, code).otherwise(F.col("entity"))})
    asks = F.col("question").rlike("|".join(ASKS_VALUE))
    word = F.when(F.col("_code").isNotNull() & asks, first_word(PRODUCT_WORDS, F.col("question")))
    changed = word.isNotNull() & ~word.eqNullSafe(F.col("attribute"))
    rows = rows.withColumns({
        "query_type": F.when(changed, "attribute_query").otherwise(F.col("query_type")), "entity": F.when(changed, F.col("_code")).otherwise(F.col("entity")),
        "attribute": F.when(changed, word).otherwise(F.col("attribute")),
    })
    concept = F.coalesce(F.col("entity").isin(*CONCEPTS), F.lit(False))
    bare = F.aggregate("_codes", F.col("question"), lambda q, c: F.replace(q, c, F.lit("")))
    word = F.when(concept, first_word(CONCEPT_ATTRIBUTES, bare))
    rows = rows.withColumns({
        "query_type": F.when(word.isNotNull(), "attribute_query").otherwise(F.col("query_type")), "attribute": F.coalesce(word, F.col("attribute")),
        "entity": F.when(concept, F.col("_code")).otherwise(F.col("entity")),
    })
    rows = rows.join(names, "attribute", "left").join(means.select(F.col("asked").alias("attribute"), F.col("name").alias("_name")), "attribute", "left")
    rows = rows.withColumn("attribute", F.when(F.col("_known").isNull(), F.coalesce("_name", "attribute")).otherwise(F.col("attribute")))
    last = (F.col("query_type") == "attribute_query") & (F.coalesce("entity", F.lit("")) == "")
    rows = rows.withColumn("entity", F.when(last, F.coalesce("_code", "entity")).otherwise(F.col("entity")))
    return rows.select(*intents.columns)


def existing(edges: DataFrame, nodes: DataFrame, relation: str | None = None, limit: int = NODES) -> DataFrame:
    """The first facts about individuals that show that a relation, or any, exists; none if it doesn't."""
    single = nodes.where("kind = 'NamedIndividual'")
    found = edge_facts(edges if relation is None else edges.where(F.col("relation") == relation), single)
    return top(found.select("subject", "predicate", "object"), limit, "subject", "predicate", "object")
