"""Queries: triples to questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lethe import schemas
from lethe.functions.text import escape_literal
from lethe.operators import triples as X
from lethe.operators.order import dense_index, index_by_place, keep_first, rank_with_ties
from lethe.plans.catalog import query
from lethe.plans.inputs import table
from lethe.session import materialise, scratch_path
from lethe.sinks.writers import checkpoint_by_source, write_qa
from lethe.sources.triples import range_size, scan_triples, scan_uniform

ORDER = ["source", "line_no"]

# ------------------------------------------------------------ derived inputs


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """(source, line_no, subjectLabel, relation, objectLabel) from five tables, with
    padded, blank and repeated rows."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf, "customer")
    supplier = table(spark, sf, "supplier")
    part = table(spark, sf, "part")
    orders = table(spark, sf, "orders")

    def rows(df, source, key, subject, relation, obj):
        return df.select(
            F.lit(source).alias("source"), F.col(key).alias("line_no"), subject.alias("subjectLabel"),
            F.lit(relation).alias("relation"), obj.alias("objectLabel"),
        )

    name = F.col("c_name")
    blanked = F.when(F.col("c_custkey") % 97 == 5, "  ").otherwise(F.concat(F.lit(" "), name))
    born = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    based = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    placed = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    parts = [
        rows(born, "customer.csv", "c_custkey", blanked, "born in", F.col("n_name")),
        rows(customer, "language.csv", "c_custkey", name, "spoken languages", F.col("c_mktsegment")),
        rows(orders, "order.csv", "o_orderkey", placed, "was placed on", day),
        rows(part, "part_brand.csv", "p_partkey", F.col("p_name"), "brand", F.col("p_brand")),
        rows(part, "part_type.csv", "p_partkey", F.col("p_name"), "belongs to", F.col("p_type")),
        rows(customer, "segment.csv", "c_custkey", name, "similar to", F.col("c_mktsegment")),
        rows(based, "supplier.csv", "s_suppkey", F.col("s_name"), "headquarters location", F.col("n_name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TRIPLES_SQL = """
tri AS (
  SELECT 'customer.csv' AS source, c_custkey AS line_no,
         CASE WHEN c_custkey % 97 = 5 THEN '  ' ELSE ' ' || c_name END AS "subjectLabel", 'born in' AS relation, n_name AS "objectLabel"
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'language.csv', c_custkey, c_name, 'spoken languages', c_mktsegment FROM customer
  UNION ALL SELECT 'order.csv', o_orderkey, 'Order ' || o_orderkey, 'was placed on', strftime(o_orderdate, '%Y-%m-%d') FROM orders
  UNION ALL SELECT 'part_brand.csv', p_partkey, p_name, 'brand', p_brand FROM part
  UNION ALL SELECT 'part_type.csv', p_partkey, p_name, 'belongs to', p_type FROM part
  UNION ALL SELECT 'segment.csv', c_custkey, c_name, 'similar to', c_mktsegment FROM customer
  UNION ALL SELECT 'supplier.csv', s_suppkey, s_name, 'headquarters location', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
clean AS (
  SELECT source, line_no, trim("subjectLabel") AS "subjectLabel", trim(relation) AS relation, trim("objectLabel") AS "objectLabel",
         CASE WHEN trim("subjectLabel") = '' OR trim(relation) = '' OR trim("objectLabel") = '' THEN 'empty cell' END AS reason
  FROM tri)"""

# Annotations of the seven relations above: tokens, tags, lemmas.
RELATION_TAGS = [
    ("born in", "born in", "VBN IN", "bear in"),
    ("spoken languages", "spoken languages", "VBN NNS", "speak language"),
    ("was placed on", "was placed on", "VBD VBN IN", "be place on"),
    ("brand", "brand", "NN", "brand"),
    ("belongs to", "belongs to", "VBZ IN", "belong to"),
    ("similar to", "similar to", "JJ IN", "similar to"),
    ("headquarters location", "headquarters location", "NN NN", "headquarters location"),
]


def relation_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations of the relations that occur in the triples."""
    known = spark.createDataFrame(RELATION_TAGS, "relation string, tokens string, tags string, lemmas string")
    split = known.select("relation", *[F.split(c, " ").alias(c) for c in ("tokens", "tags", "lemmas")])
    return split


def object_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Entity types of distinct objects: nations are places (every fifth is taken
    for a person by the second tagger), brands organisations, segments persons."""
    objects = triples(spark, sf).select(F.col("objectLabel").alias("object")).distinct()
    number = F.regexp_extract("object", r"^NATION_(\d+)$", 1).try_cast("int")
    return objects.select(
        "object",
        F.when(number.isNotNull(), "LOC").when(F.col("object").startswith("Brand#"), "ORG")
        .when(F.col("object").rlike("^[0-9]{4}-"), None).when(F.col("object").isin(*SEGMENTS), "PER").alias("ner1"),
        F.when(number % 5 == 4, "PERSON").when(number.isNotNull(), "GPE").when(F.col("object").startswith("Brand#"), "ORG")
        .when(F.col("object").rlike("^[0-9]{4}-"), "DATE").when(F.col("object").isin(*SEGMENTS), "PERSON").alias("ner2"),
    )


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def entity_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with ids: nations twice under other casing, customers also with an
    id that is no entity, parts by name."""
    def named(df, label, qid):
        return df.select(label.alias("label"), qid.alias("qid"))

    def q(number):
        return F.concat(F.lit("Q"), number.cast("string"))

    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    part = table(spark, sf, "part")
    return (
        named(nation, F.lower("n_name"), q(F.col("n_nationkey") + 100))
        .unionByName(named(nation, F.col("n_name"), q(F.col("n_nationkey") + 1)))
        .unionByName(named(customer, F.col("c_name"), q(F.col("c_custkey") + 1000)))
        .unionByName(named(customer, F.col("c_name"), F.concat(F.lit("P"), F.col("c_custkey").cast("string"))))
        .unionByName(named(part, F.upper("p_name"), q(F.col("p_partkey") + 1000000000)))
    )


def entity_popularity(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per id: orders of a customer, customers of a nation."""
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    per_customer = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("int").alias("sitelinks"))
    per_nation = customer.groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.count("*").cast("int").alias("sitelinks"))

    def ids(df, base):
        return df.select(
            F.concat(F.lit("Q"), (F.col("k") + base).cast("string")).alias("qid"), "sitelinks",
            (F.col("k") % 50).cast("int").alias("identifiers"),
        )

    return ids(per_customer, 1000).unionByName(ids(per_nation, 1))


ENTITY_SQL = """
labels_e AS (
  SELECT lower(n_name) AS label, 'Q' || (n_nationkey + 100) AS qid FROM nation
  UNION ALL SELECT n_name, 'Q' || (n_nationkey + 1) FROM nation
  UNION ALL SELECT c_name, 'Q' || (c_custkey + 1000) FROM customer
  UNION ALL SELECT c_name, 'P' || c_custkey FROM customer
  UNION ALL SELECT upper(p_name), 'Q' || (p_partkey + 1000000000) FROM part),
ent AS (
  SELECT lower(trim(label)) AS k, min_by(qid, substr(qid, 2)::BIGINT) AS qid
  FROM labels_e WHERE regexp_matches(qid, '^Q[0-9]+$') GROUP BY 1),
popu AS (
  SELECT 'Q' || (o_custkey + 1000) AS qid, count(*)::INTEGER AS sitelinks, (o_custkey % 50)::INTEGER AS identifiers FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'Q' || (c_nationkey + 1), count(*)::INTEGER, (c_nationkey % 50)::INTEGER FROM customer GROUP BY c_nationkey)"""

ASK_SQL = """
obj AS (
  SELECT *, CASE WHEN ner1 = 'PER' THEN 'PERSON' WHEN ner1 = 'LOC' THEN 'GPE' END AS t1 FROM (
    SELECT DISTINCT "objectLabel" AS object,
      CASE WHEN regexp_matches("objectLabel", '^NATION_[0-9]+$') THEN 'LOC' WHEN "objectLabel" LIKE 'Brand#%' THEN 'ORG'
           WHEN "objectLabel" IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY') THEN 'PER' END AS ner1,
      CASE WHEN regexp_matches("objectLabel", '^NATION_[0-9]+$') THEN
             CASE WHEN substr("objectLabel", 8)::INT % 5 = 4 THEN 'PERSON' ELSE 'GPE' END
           WHEN "objectLabel" LIKE 'Brand#%' THEN 'ORG'
           WHEN regexp_matches("objectLabel", '^[0-9]{4}-') THEN 'DATE'
           WHEN "objectLabel" IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY') THEN 'PERSON' END AS ner2
    FROM tri)),
typed AS (
  SELECT object, ner2,
         CASE WHEN t1 IS NOT NULL THEN t1 IS NOT DISTINCT FROM ner2 ELSE coalesce(ner2 NOT IN ('GPE', 'PERSON'), true) END AS keep,
         CASE ner2 WHEN 'PERSON' THEN 'Who' WHEN 'DATE' THEN 'When' ELSE 'What' END AS w
  FROM obj),
asked AS (
  SELECT c.*, CASE WHEN reason IS NULL AND keep THEN
    CASE relation
      WHEN 'born in' THEN w || ' was ' || "subjectLabel" || ' born in?'
      WHEN 'was placed on' THEN w || ' did ' || "subjectLabel" || ' be placed on?'
      WHEN 'belongs to' THEN w || ' does ' || "subjectLabel" || ' belong to?'
      WHEN 'brand' THEN w || ' is the brand of ' || "subjectLabel" || '?'
      WHEN 'headquarters location' THEN w || ' is the headquarters location of ' || "subjectLabel" || '?' END END AS question
  FROM clean c LEFT JOIN typed ON object = "objectLabel"),
done AS (
  SELECT * EXCLUDE (reason), CASE WHEN reason IS NOT NULL THEN reason WHEN question IS NULL THEN 'no QA generated' END AS reason FROM asked),
first_triple AS (
  SELECT * FROM done WHERE reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY "subjectLabel", relation, "objectLabel" ORDER BY source, line_no) = 1),
first_qa AS (
  SELECT *, "objectLabel" AS answer FROM first_triple
  QUALIFY row_number() OVER (PARTITION BY question, "objectLabel" ORDER BY source, line_no) = 1),
qaset AS (
  SELECT f.source, f.line_no, question, answer, "subjectLabel", relation, "objectLabel", s.qid AS subject_qid, o.qid AS object_qid,
    coalesce(sp.sitelinks, 0) AS subject_sitelinks, coalesce(sp.identifiers, 0) AS subject_identifiers,
    coalesce(op.sitelinks, 0) AS object_sitelinks, coalesce(op.identifiers, 0) AS object_identifiers,
    coalesce(sp.sitelinks + sp.identifiers, 0) AS subject_popularity, coalesce(op.sitelinks + op.identifiers, 0) AS object_popularity,
    coalesce(sp.sitelinks + sp.identifiers, 0) + coalesce(op.sitelinks + op.identifiers, 0) AS popularity_sum
  FROM first_qa f
  LEFT JOIN ent s ON s.k = lower("subjectLabel") LEFT JOIN ent o ON o.k = lower("objectLabel")
  LEFT JOIN popu sp ON sp.qid = s.qid LEFT JOIN popu op ON op.qid = o.qid)"""

QA_ALL_SQL = f"WITH {TRIPLES_SQL}, {ENTITY_SQL}, {ASK_SQL}"


def qa_and_missed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return X.build_qa(
        triples(spark, sf), relation_tags(spark, sf), object_tags(spark, sf),
        entity_labels(spark, sf), entity_popularity(spark, sf), order=ORDER,
    )


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return X.with_questions(X.clean_triples(triples(spark, sf)), relation_tags(spark, sf), object_tags(spark, sf))


def triple_files(spark: SparkSession, sf: str) -> str:
    """The derived triples as CSV files, one folder per source, columns in two orders."""
    path = scratch_path(spark, "triples")
    rows = triples(spark, sf).withColumn("folder", F.col("source"))
    for order, condition in (
        (["subjectLabel", "relation", "objectLabel"], "source <> 'order.csv'"),
        (["objectLabel", "subjectLabel", "relation"], "source = 'order.csv'"),
    ):
        rows.where(condition).select(*order, "folder").write.mode("append").partitionBy("folder").options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
    table(spark, sf, "region").select("r_name").write.mode("append").option("header", True).csv(f"{path}/folder=region.csv")
    planted = table(spark, sf, "nation").select(
        F.col("n_regionkey").alias("note, long"),
        F.concat(F.col("n_name"), F.lit(', "of"\nthe world')).alias("subjectLabel"),
        F.lit("lies in, or near").alias("relation"),
        F.concat(F.lit("region\n"), F.col("n_regionkey").cast("string")).alias("objectLabel"),
        F.lit("nation.csv").alias("folder"),
    )
    planted.write.mode("append").partitionBy("folder").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    # a wide file, whose ranges begin and end inside of quoted fields
    wide = [F.lit(None).cast("string").alias(f"c{i}") for i in range(WIDE_COLUMNS)]
    wide[7] = F.concat("c_name", F.lit('\n"said", so\n'), F.col("c_custkey").cast("string")).alias("objectLabel")
    wide[150] = F.concat(F.lit("\n,\n"), F.col("c_mktsegment"), F.lit(",")).alias("subjectLabel")
    wide[-1] = F.lit("is\nat").alias("relation")
    table(spark, sf, "customer").select(*wide, F.lit("customer.csv").alias("folder")).write.mode("append").partitionBy("folder").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


WIDE_COLUMNS = 300
RANGE_BYTES = 1 << 16  # small, so that files of the test tables are cut as well

# ------------------------------------------------------------ queries


@query(
    "src1_scan_triples",
    f"""WITH {TRIPLES_SQL}
SELECT source AS folder, "subjectLabel", relation, "objectLabel" FROM tri
UNION ALL SELECT 'nation.csv', n_name || ', "of"' || chr(10) || 'the world', 'lies in, or near', 'region' || chr(10) || n_regionkey FROM nation
UNION ALL SELECT 'customer.csv', chr(10) || ',' || chr(10) || c_mktsegment || ',', 'is' || chr(10) || 'at', c_name || chr(10) || '"said", so' || chr(10) || c_custkey FROM customer""",
)
def src1(spark: SparkSession, sf: str) -> DataFrame:
    files = triple_files(spark, sf)
    rows, _ = scan_triples(spark, files, range_size(spark, files, RANGE_BYTES))
    folder = F.regexp_extract("file_path", r"folder=([^/]+)/", 1)
    return rows.select(folder.alias("folder"), *X.FIELDS)


@query(
    "srt1_ordered_file_scan",
    """SELECT 'a' || (p_partkey % 3) AS part_of, p_name AS "subjectLabel",
  row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey)::INTEGER AS position FROM part""",
)
def srt1(spark: SparkSession, sf: str) -> DataFrame:
    """Rows come back in the order in which their file holds them."""
    path = scratch_path(spark, "ordered")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("subjectLabel"), F.lit("brand").alias("relation"), F.col("p_brand").alias("objectLabel"),
        F.concat(F.lit("a"), (F.col("p_partkey") % 3).cast("string")).alias("part_of"),
    )
    in_order = rows.repartitionByRange("p_partkey").sortWithinPartitions("part_of", "p_partkey").drop("p_partkey")
    in_order.write.partitionBy("part_of").option("header", True).csv(path)
    scanned = scan_uniform(spark, path).withColumn("part_of", F.regexp_extract("file_path", r"part_of=([^/]+)/", 1))
    numbered = index_by_place(scanned, "_index", ["part_of"])
    return numbered.select("part_of", "subjectLabel", (F.col("_index") + 1).cast("int").alias("position"))


@query("flt1_clean_triples", f'WITH {TRIPLES_SQL} SELECT source, line_no, "subjectLabel", relation, "objectLabel", reason FROM clean')
def flt1(spark: SparkSession, sf: str) -> DataFrame:
    return X.clean_triples(triples(spark, sf)).select("source", "line_no", *X.FIELDS, "reason")


@query("flt2_valid_entity_id", f"WITH {ENTITY_SQL} SELECT label, qid FROM labels_e WHERE regexp_matches(qid, '^Q[0-9]+$')")
def flt2(spark: SparkSession, sf: str) -> DataFrame:
    return entity_labels(spark, sf).where(X.valid_entity_id(F.col("qid")))


@query(
    "jn1_link_entities",
    f"""WITH {TRIPLES_SQL}, {ENTITY_SQL}
SELECT source, line_no, s.qid AS subject_qid, o.qid AS object_qid
FROM clean LEFT JOIN ent s ON s.k = lower("subjectLabel") LEFT JOIN ent o ON o.k = lower("objectLabel")""",
)
def jn1(spark: SparkSession, sf: str) -> DataFrame:
    linked = X.link_entities(X.clean_triples(triples(spark, sf)), entity_labels(spark, sf))
    return linked.select("source", "line_no", "subject_qid", "object_qid")


_POP_COLUMNS = ["subject_popularity", "object_popularity", "popularity_sum"]


@query(
    "jn2_attach_popularity",
    f"""WITH {TRIPLES_SQL}, {ENTITY_SQL}
SELECT source, line_no, coalesce(sp.sitelinks + sp.identifiers, 0)::INTEGER AS subject_popularity,
  coalesce(op.sitelinks + op.identifiers, 0)::INTEGER AS object_popularity,
  (coalesce(sp.sitelinks + sp.identifiers, 0) + coalesce(op.sitelinks + op.identifiers, 0))::INTEGER AS popularity_sum
FROM clean LEFT JOIN ent s ON s.k = lower("subjectLabel") LEFT JOIN ent o ON o.k = lower("objectLabel")
LEFT JOIN popu sp ON sp.qid = s.qid LEFT JOIN popu op ON op.qid = o.qid""",
)
def jn2(spark: SparkSession, sf: str) -> DataFrame:
    linked = materialise(X.link_entities(X.clean_triples(triples(spark, sf)), entity_labels(spark, sf)), "linked")
    return X.attach_popularity(linked, entity_popularity(spark, sf)).select("source", "line_no", *_POP_COLUMNS)


@query(
    "set2_label_universe",
    f"""WITH {TRIPLES_SQL}, l AS (SELECT "subjectLabel" AS x FROM clean UNION ALL SELECT "objectLabel" FROM clean)
SELECT lower(x) AS label_key, min(x) AS label FROM l GROUP BY 1""",
)
def set2(spark: SparkSession, sf: str) -> DataFrame:
    return X.label_universe(X.clean_triples(triples(spark, sf)))


@query("set4_distinct_ids", f"WITH {ENTITY_SQL} SELECT DISTINCT qid FROM labels_e WHERE qid LIKE 'Q%'")
def set4(spark: SparkSession, sf: str) -> DataFrame:
    return X.distinct_ids(entity_labels(spark, sf))


@query(
    "win1_dedup_keep_first",
    """SELECT p_name, p_brand, min(p_partkey) AS p_partkey, arg_min(p_type, p_partkey) AS p_type FROM part GROUP BY p_name, p_brand""",
)
def win1(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_name", "p_brand", "p_type", "p_partkey")
    return keep_first(part, ["p_name", "p_brand"], ["p_partkey"])


@query(
    "win1_dedup_two_passes",
    """WITH r AS (SELECT p_partkey, p_name, p_brand, 'Which brand is ' || split_part(p_name, ' ', 1) || '?' AS question FROM part),
t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1)
SELECT p_partkey, question, p_brand AS answer FROM t QUALIFY row_number() OVER (PARTITION BY question, p_brand ORDER BY p_partkey) = 1""",
)
def win1_two_passes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_name").alias("subjectLabel"),
        F.lit("brand").alias("relation"),
        F.col("p_brand").alias("objectLabel"),
        F.concat(F.lit("Which brand is "), F.substring_index("p_name", " ", 1), F.lit("?")).alias("question"),
        F.col("p_brand").alias("answer"),
    )
    return X.dedup_keep_first(rows, order=["p_partkey"]).select("p_partkey", "question", "answer")


@query("txt1_object_type", f"WITH {TRIPLES_SQL}, {ENTITY_SQL}, {ASK_SQL} SELECT object, keep, CASE WHEN keep THEN ner2 END AS type FROM typed")
def txt1(spark: SparkSession, sf: str) -> DataFrame:
    from lethe.functions.questions import agreed_type

    found = object_tags(spark, sf).withColumn("t", agreed_type(F.col("ner1"), F.col("ner2")))
    return found.select("object", F.col("t.keep").alias("keep"), F.col("t.type").alias("type"))


@query("txt2_question_template", QA_ALL_SQL + "SELECT source, line_no, question FROM done")
def txt2(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("source", "line_no", "question")


_REVERSE_SQL = f"""WITH {TRIPLES_SQL}, {ENTITY_SQL}, {ASK_SQL},
r AS (SELECT c.source, c.line_no, relation, "subjectLabel" AS s, w, ner2, keep,
        CASE c.line_no % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'revolution' END AS topic
      FROM clean c JOIN typed ON object = "objectLabel" WHERE reason IS NULL),
k AS (SELECT *, 'Which ' || CASE WHEN topic = 'human' THEN 'human' ELSE 'revolution or war' END AS which FROM r),
a AS (SELECT *, CASE WHEN keep AND ner2 = 'PERSON' THEN w ELSE which END AS ask FROM k)
SELECT source, line_no, CASE
  WHEN relation = 'born in' THEN ask || ' was born in ' || s || '?'
  WHEN relation IN ('was placed on', 'belongs to') THEN ask || ' ' || relation || ' ' || s || '?'
  WHEN relation IN ('brand', 'headquarters location') THEN
    CASE WHEN topic = 'human' THEN (CASE WHEN keep THEN w ELSE 'What' END) || 'se' ELSE which || '''s' END || ' ' || relation || ' is ' || s || '?' END AS question
FROM a"""


@query("txt3_reverse_question", _REVERSE_SQL)
def txt3(spark: SparkSession, sf: str) -> DataFrame:
    from lethe.functions import questions as Q

    clean = X.clean_triples(triples(spark, sf)).where(F.col("reason").isNull())
    tags = relation_tags(spark, sf).select("relation", Q.relation_form(F.col("tags")).alias("form"))
    types = object_tags(spark, sf).select(
        F.col("object").alias("objectLabel"), Q.agreed_type(F.col("ner1"), F.col("ner2"))["type"].alias("type")
    )
    # a relation may hold most triples; there is one row per relation
    joined = clean.join(F.broadcast(tags), "relation").join(types, "objectLabel")
    topic = F.when(F.col("line_no") % 3 == 0, "human").when(F.col("line_no") % 3 == 1, "revolution")
    question = Q.reverse_question(
        F.col("form"), Q.question_word(F.col("type")), F.col("type"), F.col("subjectLabel"), F.col("relation"), topic
    )
    return joined.select("source", "line_no", question.alias("question"))


@query(
    "txt4_qa_or_missed",
    QA_ALL_SQL + "SELECT coalesce(reason, 'ok') AS outcome, count(*) AS n_rows FROM done GROUP BY 1",
)
def txt4(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).groupBy(F.coalesce("reason", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n_rows"))


@query(
    "txt13_escape_literal",
    r"""SELECT doc_id, translate(replace(replace(text, '\', '\\'), '"', '\"'), chr(10) || chr(13) || chr(9), '   ') AS literal FROM documents""",
)
def txt13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", escape_literal(F.col("text")).alias("literal"))


_QA_SELECT = 'SELECT {} FROM qaset'.format(
    ", ".join(f'{c}::INTEGER AS {c}' if schemas.QA[c].dataType == schemas.INT else f'"{c}"' for c in schemas.QA.names)
)


@query("snk1_write_qa", QA_ALL_SQL + _QA_SELECT)
def snk1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "qa")
    write_qa(*qa_and_missed(spark, sf), path)
    return spark.read.schema(schemas.QA).parquet(f"{path}/qa")


@query("snk1_write_missed", QA_ALL_SQL + 'SELECT source, "subjectLabel", relation, "objectLabel", reason FROM done WHERE reason IS NOT NULL')
def snk1_missed(spark: SparkSession, sf: str) -> DataFrame:
    _, missed = qa_and_missed(spark, sf)
    path = scratch_path(spark, "missed")
    missed.write.parquet(path)
    return spark.read.schema(schemas.MISSED).parquet(path)


@query("snk2_checkpoint_qa", QA_ALL_SQL + _QA_SELECT)
def snk2(spark: SparkSession, sf: str) -> DataFrame:
    """Sources up to one name are written first, as by a run that was cut short; then all."""
    qa, _ = qa_and_missed(spark, sf)
    path = scratch_path(spark, "by-source")
    checkpoint_by_source(qa.where("source <= 'order.csv'"), path)
    stored = checkpoint_by_source(qa, path)
    return stored.select(*schemas.QA.names)


@query("agg15_popularity_sum", QA_ALL_SQL + "SELECT source, line_no, popularity_sum::INTEGER AS popularity_sum FROM qaset")
def agg15(spark: SparkSession, sf: str) -> DataFrame:
    qa, _ = qa_and_missed(spark, sf)
    return qa.select("source", "line_no", "popularity_sum")


@query(
    "idx1_add_index",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders",
)
def idx1(spark: SparkSession, sf: str) -> DataFrame:
    return dense_index(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "index")


@query(
    "rank_with_ties",
    """SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS rank FROM customer""",
)
def ranked(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return rank_with_ties(customer, "c_nationkey", "c_custkey").select("c_custkey", "rank")


_SPLIT_SQL = """
p AS (SELECT c_custkey AS index, count(o_orderkey) AS popularity_sum FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
r AS (SELECT *, row_number() OVER (ORDER BY popularity_sum, index) - 1 AS rk, count(*) OVER () AS n FROM p)"""


@query(
    "rpt6_popularity_splits",
    f"""WITH {_SPLIT_SQL}
SELECT index, popularity_sum, CASE WHEN rk < n * p.pct // 100 THEN 'rare_forget' || p.pct
  WHEN rk >= n - n * p.pct // 100 THEN 'popular_forget' || p.pct ELSE 'retain_intersection' || (100 - 2 * p.pct) END AS split
FROM r, (VALUES (1), (5), (10)) p(pct)""",
)
def rpt6(spark: SparkSession, sf: str) -> DataFrame:
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    counts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    popular = customer.select("c_custkey").join(counts, "c_custkey", "left").select(
        F.col("c_custkey").alias("index"), F.coalesce("n", F.lit(0)).alias("popularity_sum")
    )
    return X.popularity_splits(materialise(popular, "popularity")).select("index", "popularity_sum", "split")
