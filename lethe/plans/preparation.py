"""Queries: prompts, tokens, pairings and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.functions import text as TX
from lethe.operators import datasets as D
from lethe.operators import pairing as P
from lethe.operators import prompts as R
from lethe.operators import tokens as K
from lethe.operators.chunks import chunk_corpus
from lethe.plans.catalog import query
from lethe.plans.inputs import GENERATIONS_SQL, QA_SQL, generations, qa_pairs, spread, table
from lethe.session import scratch_path
from lethe.sinks.writers import write_alternates
from lethe.sources import datasets as SD

TOKENIZER = K.WordTokenizer()
WORDS = K.WORD_PATTERN


def ids_text(column: str | F.Column, name: str):
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(name)


def words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORDS}')"


def ids_sql(text: str) -> str:
    return f"list_transform({words_sql(text)}, lambda w: ('0x' || substr(md5(w), 1, 7))::INTEGER + 3)"


def choice_sql(index: str, n: str, seed: int = 0, epoch: int = 0) -> str:
    return f"(('0x' || substr(md5({index} || ':{seed}:{epoch}'), 1, 15))::BIGINT % {n})"


def joined_sql(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


# ------------------------------------------------------------ derived inputs


def qa_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return D.add_index(qa_pairs(spark, sf), "item_key").select("index", "question", "answer")


INDEXED_SQL = QA_SQL + """,
qi AS (SELECT row_number() OVER (ORDER BY item_key) - 1 AS index, question, answer FROM qa)"""


def scored_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with gold-set columns: numbers, null, NaN and text that is no number."""
    k = F.col("p_partkey")
    recall = (
        F.when(k % 11 == 0, None).when(k % 13 == 0, "NaN").when(k % 17 == 0, "n/a")
        .otherwise(((k % 8).cast("double") / 8).cast("string"))
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_name").alias("question"),
        F.split("p_type", " ").alias("answer"),
        recall.alias("gen_recall_Llama_1b_Instract"),
        ((k % 5).cast("double") / 4).alias("bert_sim_Llama_1b_Instract"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("know_llama3_1b"),
        (k % 4 == 0).alias("emb_llama3_1b"),
    )


GOLD_SQL = """
gold AS (
  SELECT p_partkey, p_name, p_type, row_number() OVER (ORDER BY p_partkey) - 1 AS index FROM part
  WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0
    AND (p_partkey % 8)::DOUBLE / 8 < 0.5 AND (p_partkey % 5)::DOUBLE / 4 < 0.5)"""


def shots(spark: SparkSession, sf: str) -> DataFrame:
    """Few-shot examples: the regions' names, in key order."""
    return table(spark, sf, "region").select(
        F.col("r_regionkey").alias("position"),
        F.concat(F.lit("Where is "), F.col("r_name"), F.lit("?")).alias("question"),
        F.col("r_name").alias("answer"),
    )


SHOT_TEXT = "string_agg('{us}Where is ' || r_name || '?{ue}{as_}' || r_name || '{ae}', '' ORDER BY r_regionkey)"


def in_file_order(df: DataFrame, key: str) -> DataFrame:
    """Rows whose files, written one per range of `key`, follow each other by name."""
    return df.repartitionByRange(key).sortWithinPartitions(key)


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Refusals: one per customer, padded with blanks, read back from text files in their order."""
    path = scratch_path(spark, "pool")
    customer = in_file_order(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    customer.select(F.concat(F.lit("I cannot say "), "c_name", F.lit("  ")).alias("value")).write.text(path)
    return SD.load_response_pool(spark, path).select("index", "response")


# ------------------------------------------------------------ sources


@query("src2_load_split", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def src2(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("config"), F.col("o_orderpriority").alias("split")
    )
    orders.write.partitionBy("config", "split").parquet(path)
    return SD.load_split(spark, path, name="F", split="1-URGENT").select("o_orderkey", "o_totalprice")


@query("src3_load_text_lines", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS index, text FROM documents")
def src3(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    in_file_order(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").write.json(path)
    return SD.load_text_lines(spark, path, parse_json=True, index="index").select("index", "text")


@query("src4_load_response_pool", "SELECT 'I cannot say ' || c_name AS response, row_number() OVER (ORDER BY c_custkey) - 1 AS index FROM customer")
def src4(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).select("response", "index")


@query(
    "src5_load_examples_json",
    f"""WITH {INDEXED_SQL},
fs AS (SELECT string_agg('Question: Name it.' || chr(10) || 'Answer: ' || n_name || chr(10) || chr(10), '' ORDER BY n_nationkey) AS s
       FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 5))
SELECT index, s || 'Question: ' || question || chr(10) || 'Answer: ' AS prompt FROM qi, fs""",
)
def src5(spark: SparkSession, sf: str) -> DataFrame:
    """The first five examples of a JSON array, put before every question."""
    path = scratch_path(spark, "examples")
    example = F.struct(F.lit("Name it.").alias("question"), F.col("n_name").alias("answer"))
    nation = table(spark, sf, "nation").select("n_nationkey", example.alias("e"))
    array = nation.agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "e")))["e"]).alias("value"))
    array.coalesce(1).write.text(path)
    rows = R.attach_few_shot(qa_indexed(spark, sf), SD.load_examples(spark, path, n_shot=5))
    return rows.select("index", R.render_prompt(R.PLAIN, F.col("question"), F.col("few_shot")).alias("prompt"))


# ------------------------------------------------------------ filters and names


@query("flt3_gold_filter_scores", f"WITH {GOLD_SQL} SELECT p_partkey FROM gold")
def flt3(spark: SparkSession, sf: str) -> DataFrame:
    return D.gold_by_scores(scored_parts(spark, sf), "meta/Llama-3.2-1B-Instract").select("p_partkey")


@query("flt4_gold_filter_flags", "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0")
def flt4(spark: SparkSession, sf: str) -> DataFrame:
    return D.gold_by_flags(scored_parts(spark, sf), "Llama-3.2-1B-Instruct").select("p_partkey")


@query(
    "flt5_metric_columns_for_model",
    r"""SELECT p_partkey, regexp_replace(replace(lower(trim('Org/ ' || p_name || ' Instract ' )), 'org/', ''), '^ +', '') AS raw,
regexp_replace(replace(lower(trim(split_part('Org/ ' || p_name || ' Instract ', '/', -1))), 'instract', 'instruct'), '\s+', '-', 'g') AS model FROM part""",
)
def flt5(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("Org/ "), F.col("p_name"), F.lit(" Instract "))
    raw = F.regexp_replace(F.replace(F.lower(F.trim(name)), F.lit("org/"), F.lit("")), "^ +", "")
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw"), TX.clean_model_name(name).alias("model"))


@query("flt8_limit_examples", f"WITH {INDEXED_SQL} SELECT index, question FROM qi WHERE index < 50")
def flt8(spark: SparkSession, sf: str) -> DataFrame:
    return D.first_examples(qa_indexed(spark, sf), 50).select("index", "question")


@query(
    "flt10_require_columns",
    """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'NaN' WHEN p_partkey % 17 = 0 THEN 'n/a'
  ELSE ((p_partkey % 8)::DOUBLE / 8)::VARCHAR END AS recall, (p_partkey % 5)::DOUBLE / 4 AS similarity,
  'columns [''absent''] not found' AS error FROM part""",
)
def flt10(spark: SparkSession, sf: str) -> DataFrame:
    """The checked columns themselves, and what the check says about an absent one."""
    from lethe.operators.triples import require_columns

    recall, similarity = D.metric_columns("Llama-3.2-1B-Instruct")
    rows = require_columns(scored_parts(spark, sf), [recall, similarity])
    try:
        require_columns(rows, [recall, "absent"])
        error = ""
    except KeyError as e:
        error = e.args[0].split(";")[0]
    return rows.select("p_partkey", F.col(recall).alias("recall"), F.col(similarity).alias("similarity"), F.lit(error).alias("error"))


# ------------------------------------------------------------ pairings


_PAIR_SQL = f"""
fg AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents WHERE lang = 'en'),
rt AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents WHERE lang <> 'en'),
size AS (SELECT count(*) AS n FROM {{other}}),
pair AS (
  SELECT a.index, a.doc_id AS anchor_doc, o.doc_id AS other_doc
  FROM {{anchor}} a, size JOIN {{other}} o ON o.index = {choice_sql('a.index', 'size.n', 7, 1)})"""


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    forget, retain = docs.where("lang = 'en'"), docs.where("lang <> 'en'")
    return D.add_index(forget, "doc_id"), D.add_index(retain, "doc_id")


def _pairs_sql(anchor: str, other: str, role: str, other_role: str) -> str:
    return (
        "WITH " + _PAIR_SQL.format(anchor=anchor, other=other)
        + f"SELECT index, '{role}' AS role, anchor_doc AS doc_id FROM pair UNION ALL SELECT index, '{other_role}', other_doc FROM pair"
    )


@query("jn6_sample_pair_join", _pairs_sql("fg", "rt", "forget", "retain"))
def jn6(spark: SparkSession, sf: str) -> DataFrame:
    forget, retain = _halves(spark, sf)
    return P.forget_retain(forget, retain, ["doc_id"], "forget", seed=7, epoch=1).select("index", "role", "doc_id")


@query("jn6_sample_pair_join_retain_anchor", _pairs_sql("rt", "fg", "retain", "forget"))
def jn6_retain(spark: SparkSession, sf: str) -> DataFrame:
    forget, retain = _halves(spark, sf)
    return P.forget_retain(forget, retain, ["doc_id"], "retain", seed=7, epoch=1).select("index", "role", "doc_id")


_IDK_SQL = f"""WITH {INDEXED_SQL},
pl AS (SELECT 'I cannot say ' || c_name AS response, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer),
idk AS (SELECT qi.*, response FROM qi JOIN pl ON k = {choice_sql('qi.index', '(SELECT count(*) FROM customer)', 3, 0)})"""


@query(
    "jn7_idk_pair",
    _IDK_SQL + "SELECT index, 'original' AS variant, answer FROM idk UNION ALL SELECT index, 'alternate', response FROM idk",
)
def jn7(spark: SparkSession, sf: str) -> DataFrame:
    return P.idk_pair(qa_indexed(spark, sf), pool(spark, sf), seed=3).select("index", "variant", "answer")


@query(
    "jn8_alternate_pair",
    f"""WITH {INDEXED_SQL} SELECT index, 'original' AS variant, answer FROM qi
UNION ALL SELECT index, 'alternate', 'No: ' || question FROM qi""",
)
def jn8(spark: SparkSession, sf: str) -> DataFrame:
    rows = qa_indexed(spark, sf).withColumn("alternate", F.concat(F.lit("No: "), F.col("question")))
    return P.alternate_pair(rows, "alternate").select("index", "variant", "answer")


def _shots_sql(t: R.Template) -> str:
    text = SHOT_TEXT.format(us=t.user_start, ue=t.user_end, as_=t.asst_start, ae=t.asst_end)
    return f"fs AS (SELECT {text} AS shots FROM region)"


_PROMPT = "shots || '{us}' || question || '{ue}{as_}'".format(us=R.PLAIN.user_start, ue=R.PLAIN.user_end, as_=R.PLAIN.asst_start)


@query("jn9_few_shot_attach", f"WITH {INDEXED_SQL}, {_shots_sql(R.PLAIN)} SELECT index, {_PROMPT} AS prompt FROM qi, fs")
def jn9(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.attach_few_shot(qa_indexed(spark, sf), shots(spark, sf))
    return rows.select("index", R.render_prompt(R.PLAIN, F.col("question"), F.col("few_shot")).alias("prompt"))


# ------------------------------------------------------------ text


@query(
    "txt5_render_prompt_tags",
    f"WITH {INDEXED_SQL} SELECT index, '[INST] ' || question || ' [/INST]' AS prompt FROM qi",
)
def txt5(spark: SparkSession, sf: str) -> DataFrame:
    return qa_indexed(spark, sf).select("index", R.render_prompt(R.LLAMA_2_CHAT, F.col("question")).alias("prompt"))


@query(
    "txt6_build_chat_messages",
    f"""WITH {INDEXED_SQL}
SELECT index, 'system=Be terse.|user=' || question || '|assistant=' || answer AS chat FROM qi""",
)
def txt6(spark: SparkSession, sf: str) -> DataFrame:
    messages = R.chat_messages(F.col("question"), F.col("answer"), system="Be terse.")
    shown = F.array_join(F.transform(messages, lambda m: F.concat_ws("=", m["role"], m["content"])), "|")
    return qa_indexed(spark, sf).select("index", shown.alias("chat"))


@query(
    "txt7_fewshot_prompt_join",
    f"""WITH {INDEXED_SQL},
fs AS (SELECT string_agg('Q: Where is ' || r_name || '? A: ' || r_name, chr(10) || chr(10) ORDER BY r_regionkey) AS s FROM region)
SELECT index, s || chr(10) || chr(10) || 'Q: ' || replace(question, '{{answer}}', answer) || ' A:' AS prompt FROM qi, fs""",
)
def txt7(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.attach_few_shot(qa_indexed(spark, sf), shots(spark, sf))
    prompt = R.few_shot_prompt("Q: {question} A: {answer}", "Q: {question} A:", F.col("few_shot"))
    return rows.select("index", R.fill_from_row(rows, prompt, ["question", "answer"]).alias("prompt"))


@query("txt8_completion_text", f"WITH {INDEXED_SQL} SELECT index, question || ' ' || answer AS full_text FROM qi")
def txt8(spark: SparkSession, sf: str) -> DataFrame:
    return qa_indexed(spark, sf).select("index", K.completion_text(F.col("question"), F.col("answer"), True).alias("full_text"))


@query(
    "txt9_pick_answer",
    f"""SELECT p_partkey, coalesce(string_split(p_name, ' ')[1 + {choice_sql('p_partkey', "len(string_split(p_name, ' '))", 5)}], '') AS chosen FROM part""",
)
def txt9(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select("p_partkey", P.pick_answer(F.split("p_name", " "), F.col("p_partkey"), 5).alias("chosen"))


@query(
    "txt10_explode_answers",
    """SELECT p_partkey, (generate_subscripts(string_split(p_name, ' '), 1) - 1)::INTEGER AS answer_idx, unnest(string_split(p_name, ' ')) AS answer FROM part""",
)
def txt10(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("answer"))
    return D.explode_answers(part).select("p_partkey", "answer_idx", "answer")


@query(
    "txt11_cut_at_stopwords",
    """SELECT doc_id, regexp_replace(split_part(split_part(text, '</s>', 1), chr(10), 1), '^\\s+|\\s+$', '', 'g') AS generation FROM documents""",
)
def txt11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", TX.cut_at_stopwords(F.col("text"), ["\n"], "</s>").alias("generation"))


@query(
    "txt12_strip_prompt_from_text",
    f"WITH {INDEXED_SQL} SELECT index, regexp_replace(replace(question || ' ' || answer || ' ' || question, question, ''), '^\\s+|\\s+$', '', 'g') AS truth FROM qi",
)
def txt12(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("question")
    full = F.concat_ws(" ", q, F.col("answer"), q)
    return qa_indexed(spark, sf).select("index", TX.strip_prompt(full, q).alias("truth"))


# ------------------------------------------------------------ tokens


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query("tok1_tokenize", f"SELECT doc_id, {joined_sql(ids_sql('text'))} AS ids FROM documents")
def tok1(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", ids_text(TOKENIZER.encode(F.col("text")), "ids"))


@query("tok2_truncate", f"SELECT doc_id, {joined_sql(f'({ids_sql('text')})[1:64]')} AS ids FROM documents")
def tok2(spark: SparkSession, sf: str) -> DataFrame:
    """Cutting to a length is the operator here."""
    return _docs(spark, sf).select("doc_id", ids_text(K.truncate(TOKENIZER.encode(F.col("text")), 64), "ids"))


@query("tok3_append_eos", f"SELECT doc_id, {joined_sql(f'list_append({ids_sql('text')}, 2)')} AS ids FROM documents")
def tok3(spark: SparkSession, sf: str) -> DataFrame:
    once = _docs(spark, sf).select("doc_id", K.append_eos(TOKENIZER.encode(F.col("text"))).alias("ids"))
    return once.select("doc_id", ids_text(K.append_eos(F.col("ids")), "ids"))


def chat_sql(prompt: str, answer: str, source: str, keep: str = "index") -> str:
    """CTE `chat`: ids and labels of prompt and answer."""
    return f"""
enc AS (
  SELECT {keep}, list_append({ids_sql(f'{prompt} || {answer}')}, 2) AS ids, len({ids_sql(prompt)}) AS np FROM {source}),
chat AS (SELECT {keep}, ids, np, list_transform(ids, lambda v, i: CASE WHEN i <= np THEN -100 ELSE v END) AS labels FROM enc)"""


_CHAT_SQL = f"WITH {INDEXED_SQL}, {chat_sql("'[INST] ' || question || ' [/INST]'", 'answer', 'qi')}"


def _chat(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return D.qa_dataset(qa_indexed(spark, sf), R.LLAMA_2_CHAT, TOKENIZER, **kw)


@query("tok4_mask_labels", _CHAT_SQL + f"SELECT index, {joined_sql('labels')} AS labels FROM chat")
def tok4(spark: SparkSession, sf: str) -> DataFrame:
    return _chat(spark, sf).select("index", ids_text("labels", "labels"))


@query("tok5_no_target_warning", _CHAT_SQL + "SELECT np >= len(ids) AS no_target, count(*) AS n_rows FROM chat GROUP BY 1")
def tok5(spark: SparkSession, sf: str) -> DataFrame:
    return _chat(spark, sf).groupBy("no_target").agg(F.count("*").alias("n_rows"))


_PAD_SQL = _CHAT_SQL + """,
wide AS (SELECT *, index // 8 AS batch_id, max(len(ids)) OVER (PARTITION BY index // 8) AS w FROM chat)
SELECT index, batch_id, @ids AS input_ids, @labels AS labels, @mask AS attention_mask FROM wide"""


def _padded_sql(side: str) -> str:
    fill = "list_transform(range(w - len(ids)), lambda z: {v})"
    pad, minus = fill.format(v=0), fill.format(v=-100)
    join = (lambda a, b: f"list_concat({a}, {b})") if side == "right" else (lambda a, b: f"list_concat({b}, {a})")
    ids = join("ids", pad)
    mask = f"list_transform({ids}, lambda v: CASE WHEN v <> 0 THEN 1 ELSE 0 END)"
    out = _PAD_SQL
    for name, value in (("@ids", ids), ("@labels", join("labels", minus)), ("@mask", mask)):
        out = out.replace(name, joined_sql(value))
    return out


def _padded(spark: SparkSession, sf: str, side: str) -> DataFrame:
    padded = K.pad_batches(_chat(spark, sf), 8, padding_side=side)
    return padded.select("index", "batch_id", *[ids_text(c, c) for c in ("input_ids", "labels", "attention_mask")])


@query("tok7_pad_batch", _padded_sql("right"))
def tok7(spark: SparkSession, sf: str) -> DataFrame:
    return _padded(spark, sf, "right")


@query("tok7_pad_batch_left", _padded_sql("left"))
def tok7_left(spark: SparkSession, sf: str) -> DataFrame:
    return _padded(spark, sf, "left")


@query(
    "tok6_attention_mask",
    f"SELECT doc_id, {joined_sql(f'list_transform({ids_sql('text')}, lambda v: CASE WHEN v <> {{pad}} THEN 1 ELSE 0 END)')} AS mask FROM documents".replace("{pad}", "('0x' || substr(md5('.'), 1, 7))::INTEGER + 3"),
)
def tok6(spark: SparkSession, sf: str) -> DataFrame:
    """With a real word as padding id its tokens are masked too."""
    encoded = _docs(spark, sf).select("doc_id", TOKENIZER.encode(F.col("text")).alias("ids"))
    pad = K.word_id(F.lit("."))
    return encoded.select("doc_id", ids_text(K.attention_mask(F.col("ids"), pad), "mask"))


@query("bat1_batch_assign", "SELECT (o_orderkey // 32) AS batch_id, count(*) AS n_rows FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS o_orderkey FROM orders) GROUP BY 1")
def bat1(spark: SparkSession, sf: str) -> DataFrame:
    indexed = D.add_index(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return K.assign_batches(indexed, 32).groupBy("batch_id").agg(F.count("*").alias("n_rows"))


@query(
    "tok8_target_text",
    f"""WITH {INDEXED_SQL}
SELECT index, array_to_string(({words_sql("question || ' ' || answer")})[len({words_sql('question')}) + 1:], ' ') AS target FROM qi""",
)
def tok8(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.completion_dataset(qa_indexed(spark, sf), TOKENIZER, "question", "answer", insert_space=True)
    words = TOKENIZER.words(K.completion_text(F.col("question"), F.col("answer"), True))
    return rows.select("index", K.target_text(words, F.col("labels")).alias("target"))


# ------------------------------------------------------------ datasets


@query(
    "prep1_qa_dataset",
    f"""WITH {INDEXED_SQL}, {_shots_sql(R.PLAIN)}, src AS (SELECT index, answer, {_PROMPT} AS prompt FROM qi, fs),
{chat_sql('prompt', 'answer', 'src')}
SELECT index, {joined_sql('ids')} AS input_ids, {joined_sql('labels')} AS labels FROM chat""",
)
def prep1(spark: SparkSession, sf: str) -> DataFrame:
    made = D.qa_dataset(qa_indexed(spark, sf), R.PLAIN, TOKENIZER, few_shot=shots(spark, sf))
    return made.select("index", ids_text("input_ids", "input_ids"), ids_text("labels", "labels"))


@query(
    "prep1_qa_dataset_generate",
    _CHAT_SQL + f"SELECT index, {joined_sql('ids[1:np]')} AS input_ids, {joined_sql('ids')} AS labels FROM chat",
)
def prep1_generate(spark: SparkSession, sf: str) -> DataFrame:
    made = _chat(spark, sf, predict_with_generate=True)
    return made.select("index", ids_text("input_ids", "input_ids"), ids_text("labels", "labels"))


def completion_sql(full: str, prefix: str, src: str, keep: str = "index") -> str:
    return f"""
cenc AS (SELECT {keep}, {ids_sql(full)} AS ids, greatest(len({ids_sql(prefix)}), 1) AS np FROM {src}),
comp AS (SELECT {keep}, ids, list_concat(list_transform(range(np), lambda z: -100), ids[np + 1:]) AS labels FROM cenc)"""


@query(
    "prep2_completion_dataset",
    f"""WITH {INDEXED_SQL}, {completion_sql("question || ' ' || answer", 'question', 'qi')}
SELECT index, {joined_sql('ids')} AS input_ids, {joined_sql('labels')} AS labels FROM comp""",
)
def prep2(spark: SparkSession, sf: str) -> DataFrame:
    made = D.completion_dataset(qa_indexed(spark, sf), TOKENIZER, "question", "answer", insert_space=True)
    return made.select("index", ids_text("input_ids", "input_ids"), ids_text("labels", "labels"))


@query(
    "prep2_completion_dataset_no_prefix",
    f"""WITH src AS (SELECT doc_id AS index, text FROM documents), {completion_sql('text', "''", 'src')}
SELECT index, {joined_sql('ids')} AS input_ids, {joined_sql('labels')} AS labels FROM comp""",
)
def prep2_no_prefix(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumnRenamed("doc_id", "index")
    made = D.completion_dataset(docs, TOKENIZER, "prompt", "text")
    return made.select("index", ids_text("input_ids", "input_ids"), ids_text("labels", "labels"))


_TRIP = """src AS (SELECT index, p_name AS q, string_split(p_type, ' ')[1 + {c}] AS a FROM {t})"""


@query(
    "prep3_trip_dataset",
    f"""WITH {GOLD_SQL}, {_TRIP.format(c=choice_sql('index', "len(string_split(p_type, ' '))", 0), t='gold')}, {completion_sql('q || a', 'q', 'src', 'index, a')}
SELECT index, a AS chosen_answer, {joined_sql('ids')} AS input_ids, {joined_sql('labels')} AS labels FROM comp""",
)
def prep3(spark: SparkSession, sf: str) -> DataFrame:
    made = D.scored_answer_dataset(scored_parts(spark, sf), TOKENIZER, "p_partkey", gold_set=True)
    return made.select("index", "chosen_answer", ids_text("input_ids", "input_ids"), ids_text("labels", "labels"))


@query(
    "prep3_multi_answer_dataset",
    f"""WITH keep AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS index FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0),
{_TRIP.format(c=choice_sql('index', "len(string_split(p_type, ' '))", 0), t='keep')}, {completion_sql("q || ' ' || a", 'q', 'src', 'index, a')}
SELECT index, a AS chosen_answer, {joined_sql('ids')} AS input_ids, {joined_sql('labels')} AS labels FROM comp""",
)
def prep3_multi(spark: SparkSession, sf: str) -> DataFrame:
    made = D.flagged_answer_dataset(
        scored_parts(spark, sf), TOKENIZER, "p_partkey", answers="answer", gold_set=True, insert_space=True
    )
    return made.select("index", "chosen_answer", ids_text("input_ids", "input_ids"), ids_text("labels", "labels"))


@query(
    "prep4_unlearn_dataset",
    _pairs_sql("fg", "rt", "forget", "retain").replace("SELECT index, 'forget'", "SELECT 'train' AS split, index, 'forget'").replace("SELECT index, 'retain'", "SELECT 'train', index, 'retain'"),
)
def prep4(spark: SparkSession, sf: str) -> DataFrame:
    forget, retain = _halves(spark, sf)
    data = D.get_data({"forget": forget, "retain": retain, "eval": forget}, ["doc_id"], "unlearn", seed=7, epoch=1)
    return data["train"].select(F.lit("train").alias("split"), "index", "role", "doc_id")


@query(
    "prep5_split_registry",
    f"""SELECT CASE WHEN lang = 'en' THEN 'forget' ELSE 'holdout' END AS name, doc_id, {joined_sql(ids_sql('text'))} AS input_ids FROM documents""",
)
def prep5(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    built = D.get_datasets({
        name: {"handler": "completion", "access_key": key, "args": {"df": docs.where(where), "tokenizer": TOKENIZER}}
        for name, key, where in (("mia_forget", "forget", "lang = 'en'"), ("mia_holdout", "holdout", "lang <> 'en'"))
    })
    parts = [df.select(F.lit(k).alias("name"), "doc_id", ids_text("input_ids", "input_ids")) for k, df in built.items()]
    return parts[0].unionByName(parts[1])


@query("api6_dataset_registry", _padded_sql("left"))
def api6(spark: SparkSession, sf: str) -> DataFrame:
    """One dataset and one collator, both by registered name."""
    args = {"df": qa_indexed(spark, sf), "template": R.LLAMA_2_CHAT, "tokenizer": TOKENIZER}
    built = D.get_datasets({"forget": {"handler": "qa", "args": args}})
    padded = D.collate(built, "supervised", batch_size=8, padding_side="left")
    return padded.select("index", "batch_id", *[ids_text(c, c) for c in ("input_ids", "labels", "attention_mask")])


_CHUNK_SQL = f"""WITH ids AS (
  SELECT doc_id, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN {ids_sql('text')} ELSE list_concat([4], {ids_sql('text')}) END AS ids FROM documents),
flat AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM ids),
pos AS (SELECT id, row_number() OVER (ORDER BY doc_id, p) - 1 AS g FROM flat)
SELECT g // 512 AS chunk_id, string_agg(id::VARCHAR, ' ' ORDER BY g) AS input_ids FROM pos GROUP BY 1
UNION ALL SELECT count(*) // 512, '' FROM pos HAVING count(*) % 512 = 0"""


@query("win4_chunk_corpus", _CHUNK_SQL)
def win4(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk_corpus(_docs(spark, sf), TOKENIZER, 512, "doc_id", separator_ids=[4])
    return chunks.select("chunk_id", ids_text("input_ids", "input_ids"))


@query("win4_chunk_text_files", _CHUNK_SQL)
def win4_text_files(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as JSON lines, chunked in the order of its lines."""
    path = scratch_path(spark, "corpus-lines")
    in_file_order(_docs(spark, sf).select("doc_id", "text"), "doc_id").write.json(path)
    lines = SD.load_text_lines(spark, path, parse_json=True, index="line")
    return chunk_corpus(lines, TOKENIZER, 512, "line", separator_ids=[4]).select("chunk_id", ids_text("input_ids", "input_ids"))


@query(
    "win4_chunk_per_document",
    f"""WITH ids AS (SELECT doc_id, {ids_sql('text')} AS ids FROM documents)
SELECT doc_id, c::INTEGER AS chunk_id, {joined_sql('ids[c * 512 + 1:c * 512 + 512]')} AS input_ids FROM ids, unnest(range(len(ids) // 512 + 1)) u(c)""",
)
def win4_per_document(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk_corpus(_docs(spark, sf), TOKENIZER, 512, "doc_id", per_document=True)
    return chunks.select("doc_id", "chunk_id", ids_text("input_ids", "input_ids"))


@query(
    "snk5_write_alternates_jsonl",
    f"""WITH {GENERATIONS_SQL} SELECT input AS question, ground_truth AS answer, generation AS alternate FROM gen, range(5)""",
)
def snk5(spark: SparkSession, sf: str) -> DataFrame:
    from lethe import schemas

    path = scratch_path(spark, "alternates")
    rows = generations(spark, sf).select(
        F.col("input").alias("question"), F.col("ground_truth").alias("answer"), F.col("generation").alias("alternate")
    )
    write_alternates(rows, path, repeats=5)
    return spark.read.schema(schemas.ALTERNATE).json(path)
