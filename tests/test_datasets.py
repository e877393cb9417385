import pytest
from pyspark.sql import functions as F

from lethe.functions import text as TX
from lethe.operators import datasets as D
from lethe.operators import pairing as P
from lethe.operators import prompts as R
from lethe.operators import tokens as K
from lethe.operators.chunks import chunk_corpus
from lethe.sources import datasets as SD

T = K.WordTokenizer()


def ids(spark, text):
    return spark.range(1).select(T.encode(F.lit(text)).alias("i")).first()["i"]


@pytest.mark.parametrize("sizes,length", [([3, 5, 4], 4), ([8, 8], 4), ([1], 1), ([0, 7, 0, 2], 3), ([500, 1, 3], 7), ([], 4)])
@pytest.mark.parametrize("sep", [[], [4, 4]])
def test_chunks_concatenate_back(spark, sizes, length, sep):
    texts = [" ".join(f"d{d}w{i}" for i in range(n)) for d, n in enumerate(sizes)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    want = []
    for d, t in enumerate(texts):
        want += ([] if d == 0 else sep) + ids(spark, t)
    chunks = {r["chunk_id"]: r["input_ids"] for r in chunk_corpus(docs, T, length, "doc", separator_ids=sep).collect()}
    assert sorted(chunks) == list(range(len(want) // length + 1))
    assert sum((chunks[i] for i in sorted(chunks)), []) == want
    assert all(len(chunks[i]) == length for i in sorted(chunks)[:-1])


def test_chunks_per_document(spark):
    docs = spark.createDataFrame([(0, "a b c d"), (1, "e f g")], "doc long, text string")
    rows = chunk_corpus(docs, T, 2, "doc", per_document=True).collect()
    assert {(r["doc"], r["chunk_id"]): len(r["input_ids"]) for r in rows} == {(0, 0): 2, (0, 1): 2, (0, 2): 0, (1, 0): 2, (1, 1): 1}


def test_gold_filters(spark):
    rows = [("0.4", "0.4"), ("0.5", "0.1"), (None, "0.1"), ("NaN", "0.1"), ("none", "0.1"), ("0.1", "0.49")]
    df = spark.createDataFrame(rows, "gen_recall_Gemma_7b_IT string, bert_sim_Gemma_7b_IT string")
    assert [r[0] for r in D.gold_by_scores(df, "google/Gemma-7b-it ").collect()] == ["0.4", "0.1"]
    with pytest.raises(NotImplementedError):
        D.gold_by_scores(df, "other")
    with pytest.raises(KeyError, match="available"):
        D.gold_by_scores(df, "zephyr-7b-beta")
    flags = spark.createDataFrame([(True, False), (None, False), (False, None), (False, True)], "know_llama3_1b boolean, emb_llama3_1b boolean")
    assert D.gold_by_flags(flags, "Llama-3.2-1B-Instruct").count() == 2
    assert D.normal_model_name("meta/Llama-3.2-1B  Instract") == "llama-3.2-1b-instruct"


def test_pairs_choose_from_the_whole_other_set_and_repeat(spark):
    forget = spark.range(300).select(F.col("id").alias("index"), F.col("id").alias("v"))
    retain = spark.range(40).select(F.col("id").alias("index"), (F.col("id") + 1000).alias("v"))
    def pairs(**kw):
        return sorted(tuple(r) for r in P.forget_retain(forget, retain, ["v"], **kw).collect())
    first = pairs(seed=1)
    assert first == pairs(seed=1) != pairs(seed=2)
    assert pairs(seed=1, epoch=1) != first
    partners = [r[3] for r in first if r[1] == "retain"]
    assert len(partners) == 300 and set(partners) <= set(range(1000, 1040)) and len(set(partners)) > 35
    by_retain = P.forget_retain(forget, retain, ["v"], anchor="retain")
    assert by_retain.where("role = 'retain'").count() == by_retain.where("role = 'forget'").count() == 40


def test_pairs_without_another_set(spark):
    forget = spark.range(5).select(F.col("id").alias("index"), F.col("id").alias("v"))
    empty = forget.limit(0)
    assert P.forget_retain(forget, None, ["v"]).count() == 5
    assert [r["role"] for r in P.forget_retain(forget, empty, ["v"]).collect()] == ["forget"] * 5
    with pytest.raises(ValueError):
        P.forget_retain(None, forget, ["v"])
    with pytest.raises(ValueError):
        P.forget_retain(forget, forget, ["v"], anchor="other")


def test_pick_answer(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(200)] + [(200, []), (201, None)], "index long, answers array<string>")
    got = {r["index"]: r["a"] for r in df.select("index", P.pick_answer(F.col("answers"), F.col("index")).alias("a")).collect()}
    assert {got[i] for i in range(200)} == {"a", "b", "c"} and got[200] == got[201] == ""


def test_idk_and_alternate_variants(spark):
    df = spark.createDataFrame([(0, "q", "a", "alt")], "index long, question string, answer string, other string")
    pool = spark.createDataFrame([(0, "no idea")], "index long, response string")
    both = {r["variant"]: r["answer"] for r in P.idk_pair(df, pool).collect()}
    assert both == {"original": "a", "alternate": "no idea"}
    assert [r["answer"] for r in P.idk_pair(df, pool, return_original=False).collect()] == ["no idea"]
    made = D.qa_with_alternate(df, "other", R.PLAIN, T)
    assert {r["variant"] for r in made.collect()} == {"original", "alternate"}


def test_prompt_by_hand(spark):
    shots = spark.createDataFrame([(1, "q1", "a1"), (0, "q0", "a0")], "position int, question string, answer string")
    t = R.Template("<u>", "</u>", "<a>", "</a>", "be brief", "<s>be brief</s>", chat=True)
    df = R.attach_few_shot(spark.createDataFrame([("Q", "A")], "question string, answer string"), shots)
    q, a, f = F.col("question"), F.col("answer"), F.col("few_shot")
    messages = R.chat_messages(q, a, f, t.system)
    row = df.select(
        R.render_prompt(t, q, f).alias("p"), messages.alias("m"), R.render_chat(t, F.slice(messages, 1, 6), True).alias("c"),
        R.few_shot_prompt("{question}={answer}", "{question}=", f, ";").alias("j"),
    ).first()
    assert row["p"] == "<s>be brief</s><u>q0</u><a>a0</a><u>q1</u><a>a1</a><u>Q</u><a>" == row["c"]
    assert [(m["role"], m["content"]) for m in row["m"]] == [
        ("system", "be brief"), ("user", "q0"), ("assistant", "a0"), ("user", "q1"), ("assistant", "a1"), ("user", "Q"), ("assistant", "A"),
    ]
    assert row["j"] == "q0=a0;q1=a1;{question}="


def test_labels_cover_the_answer_and_the_end_mark(spark):
    df = spark.createDataFrame([(0, "w x", ["a b", "c"])], "index long, question string, answer array<string>")
    rows = {r["answer_idx"]: r for r in D.qa_dataset(df, R.Template(user_end=" ? "), T).collect()}
    prompt = ids(spark, "w x ?")
    assert rows[0]["input_ids"] == prompt + ids(spark, "a b") + [K.EOS_ID]
    assert rows[0]["labels"] == [-100] * 3 + ids(spark, "a b") + [K.EOS_ID]
    assert rows[1]["attention_mask"] == [1] * 5 and not rows[1]["no_target"]
    cut = D.qa_dataset(df, R.Template(user_end=" ? "), T, max_length=2).first()
    assert cut["input_ids"] == prompt[:2] + [K.EOS_ID] and cut["labels"] == [-100, -100, K.EOS_ID]
    chat = D.qa_dataset(df, R.Template(user_end=" ? ", chat=True), T, max_length=2).first()
    assert len(chat["input_ids"]) == 6


def test_completion_masks_at_least_one_position(spark):
    df = spark.createDataFrame([(0, "a b c d")], "index long, text string")
    row = D.completion_dataset(df, T, max_length=3).first()
    assert row["input_ids"] == ids(spark, "a b c") and row["labels"] == [-100] + ids(spark, "b c")
    generate = D.completion_dataset(df.withColumn("prompt", F.lit("p")), T, max_length=2, insert_space=True, predict_with_generate=True).first()
    assert generate["input_ids"] == ids(spark, "p") and generate["labels"] == [-100] + ids(spark, "a b")


def test_padding(spark):
    rows = [(0, [5, 6, 7], [-100, 6, 7]), (1, [5], [5]), (2, [9, 0], [9, 0])]
    df = spark.createDataFrame(rows, "index long, input_ids array<int>, labels array<int>")
    left = {r["index"]: r for r in K.pad_batches(df, 2, padding_side="left").collect()}
    assert left[1]["input_ids"] == [0, 0, 5] and left[1]["labels"] == [-100, -100, 5] and left[1]["attention_mask"] == [0, 0, 1]
    assert left[2]["input_ids"] == [9, 0] and left[2]["attention_mask"] == [1, 0] and left[2]["batch_id"] == 1
    with pytest.raises(ValueError):
        K.pad_batches(df.drop("index"), 2)
    with pytest.raises(ValueError):
        K.pad_batches(df, 2, padding_side="both")


def test_nested_examples_are_padded_apart(spark):
    rows = [(0, "forget", [1, 2, 3]), (0, "retain", [4]), (1, "forget", [5]), (1, "retain", [6])]
    df = spark.createDataFrame(rows, "index long, role string, input_ids array<int>")
    got = {(r["index"], r["role"]): r["input_ids"] for r in K.pad_batches(df, 8, variants=["role"]).collect()}
    assert got == {(0, "forget"): [1, 2, 3], (0, "retain"): [4], (1, "forget"): [5, 0, 0], (1, "retain"): [6]}


def test_text_helpers(spark):
    row = spark.range(1).select(
        TX.strip(F.lit("\u2003 a b\t\u00a0")).alias("strip"),
        TX.cut_at_stopwords(F.lit(" x\nQuestion: y</s>z"), ["\nQuestion", "Question:"], "</s>").alias("cut"),
        TX.cut_at_stopwords(F.lit("Question: y"), ["Question:"]).alias("nothing"),
        TX.strip_prompt(F.lit("p a p"), F.lit("p")).alias("prompt"),
        TX.strip_prompt(F.lit(" a "), F.lit("")).alias("no_prompt"),
        TX.escape_literal(F.lit('a\\b"c\nd')).alias("escaped"),
        TX.fill_template(F.lit("{a}-{b}-{c}"), {"a": F.lit(1), "b": F.lit("x")}).alias("filled"),
    ).first()
    assert tuple(row) == ("a b", "x", "", "a", "a", 'a\\\\b\\"c d', "1-x-{c}")


def test_sources(spark, tmp_path):
    (tmp_path / "idk.txt").write_text("I do not know. \n  No idea\n")
    pool = SD.load_response_pool(spark, str(tmp_path / "idk.txt")).collect()
    assert {r["index"]: r["response"] for r in pool} == {0: "I do not know.", 1: "No idea"}
    (tmp_path / "shots.json").write_text('[{"question": "q0", "answer": "a0"},\n {"question": "q1", "answer": "a1"}, {"question": "q2", "answer": "a2"}]')
    assert [r["question"] for r in SD.load_examples(spark, str(tmp_path / "shots.json"), 2).orderBy("position").collect()] == ["q0", "q1"]
    (tmp_path / "c.jsonl").write_text('{"text": "one"}\n{"text": "two"}\n')
    raw = SD.load_split(spark, "text", data_files=str(tmp_path / "c.jsonl"))
    assert raw.first()[0] == '{"text": "one"}'
    assert [r[0] for r in SD.load_text_lines(spark, str(tmp_path / "c.jsonl"), parse_json=True).collect()] == ["one", "two"]
    placed = SD.load_text_lines(spark, str(tmp_path / "c.jsonl"), index="line").collect()
    assert {r["line"]: r["text"] for r in placed} == {0: '{"text": "one"}', 1: '{"text": "two"}'}


def test_splits_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "config string, split string, v int").write.partitionBy("config", "split").parquet(path)
    df = SD.load_split(spark, path, "a", "x")
    assert [r["v"] for r in df.collect()] == [1]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(config" in plan


def test_registry(spark):
    df = spark.createDataFrame([(0, "t")], "index long, text string")
    assert D.get_datasets({"a": {"handler": "completion", "args": {"df": df, "tokenizer": T}}}).count() == 1
    with pytest.raises(NotImplementedError):
        D.get_datasets({"a": {"handler": "nope", "args": {}}})
    with pytest.raises(NotImplementedError):
        D.collate(df, "nope")
    data = D.get_data({"forget": df, "retain": df, "eval": df}, ["text"], "unlearn")
    assert set(data) == {"train", "eval"} and data["train"].count() == 2


def test_tokenizer_file(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    vocab = {"[UNK]": 0, "a": 1, "b": 2, "[END]": 3}
    made = tokenizers.Tokenizer(tokenizers.models.WordLevel(vocab, unk_token="[UNK]"))
    made.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    path = str(tmp_path / "tokenizer.json")
    made.save(path)
    tokenizer = K.HuggingFaceTokenizer(path, pad_id=0, eos_id=3)
    df = spark.createDataFrame([(0, "a ", "b zzz")], "index long, question string, answer string")
    row = D.qa_dataset(df, R.Template(), tokenizer).first()
    assert row["input_ids"] == [1, 2, 0, 3] and row["labels"] == [-100, 2, 0, 3]


def test_examples_have_a_bound_and_one_file(spark, tmp_path):
    shots = spark.createDataFrame([(i, "q" * 2**20, "a") for i in range(17)], "position long, question string, answer string")
    df = spark.createDataFrame([("Q", "A")], "question string, answer string")
    assert len(R.attach_few_shot(df, shots.where("position < 15")).first()["few_shot"]) == 15
    with pytest.raises(Exception, match="few-shot examples are larger"):
        R.attach_few_shot(df, shots).collect()
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text('[{"question": "q0", "answer": "a0"}]')
    with pytest.raises(ValueError, match="several files"):
        SD.load_examples(spark, str(tmp_path))
