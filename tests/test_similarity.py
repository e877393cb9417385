import random

import pytest

from lethe.functions.stem import porter_stem
from lethe.operators.similarity import lcs_length, text_similarity


def table_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_lcs_against_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randrange(90))]
        b = [rng.choice("abcdef") for _ in range(rng.randrange(90))]
        assert lcs_length(a, b) == table_lcs(a, b) == lcs_length(b, a)


# pairs printed in Porter's paper, and the extensions
@pytest.mark.parametrize(
    "word,stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"), ("falling", "fall"),
        ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
        ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("valenci", "valenc"),
        ("digitizer", "digit"), ("conformabli", "conform"), ("radicalli", "radic"), ("differentli", "differ"),
        ("vileli", "vile"), ("analogousli", "analog"), ("vietnamization", "vietnam"), ("predication", "predic"),
        ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"),
        ("callousness", "callous"), ("formaliti", "formal"), ("sensitiviti", "sensit"), ("sensibiliti", "sensibl"),
        ("triplicate", "triplic"), ("formative", "form"), ("formalize", "formal"), ("electriciti", "electr"),
        ("electrical", "electr"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"),
        ("inference", "infer"), ("airliner", "airlin"), ("gyroscopic", "gyroscop"), ("adjustable", "adjust"),
        ("defensible", "defens"), ("irritant", "irrit"), ("replacement", "replac"), ("adjustment", "adjust"),
        ("dependent", "depend"), ("adoption", "adopt"), ("communism", "commun"), ("activate", "activ"),
        ("angulariti", "angular"), ("homologous", "homolog"), ("effective", "effect"), ("bowdlerize", "bowdler"),
        ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
        ("dying", "die"), ("died", "die"), ("spied", "spi"), ("enjoy", "enjoy"), ("by", "by"), ("proceed", "proceed"),
    ],
)
def test_stems(word, stem):
    assert porter_stem(word) == stem


def scores(spark, truth, generation, **kw):
    df = spark.createDataFrame([(truth, generation)], "ground_truth string, generation string")
    return text_similarity(df, **kw).first()


def test_rouge_by_hand(spark):
    row = scores(spark, "The cat sat on the mat", "the cat, the cat on mats!")
    # clipped unigrams: the x2, cat, on; "mats" has four letters and is stemmed to "mat"
    assert row["rouge1_recall"] == pytest.approx(5 / 6)
    assert row["rougeL_recall"] == pytest.approx(4 / 6)
    assert row["rougeL_f1"] == pytest.approx(2 * (4 / 6) * (4 / 6) / (4 / 6 + 4 / 6))
    assert scores(spark, "The cat sat on the mat", "the cat, the cat on mats!", use_stemmer=False)["rouge1_recall"] == pytest.approx(4 / 6)


@pytest.mark.parametrize("truth,generation", [("", "a"), ("a", ""), ("...", "!!!"), ("a b", "c d")])
def test_nothing_shared_is_zero(spark, truth, generation):
    row = scores(spark, truth, generation)
    assert (row["rouge1_recall"], row["rougeL_f1"], row["rougeL_recall"]) == (0.0, 0.0, 0.0)


def test_whole_long_texts(spark):
    words = [f"w{i}" for i in range(20_000)]
    row = scores(spark, " ".join(words), " ".join(words[::2]))
    assert row["rougeL_recall"] == 0.5 and row["rouge1_recall"] == 0.5


@pytest.mark.parametrize("texts, logits", [([1, 2], [1]), ([1], [1, 2])])
def test_a_text_without_logits_and_logits_without_a_text_are_errors(spark, texts, logits):
    from lethe.operators.similarity import attach_classifier_scores

    left = spark.createDataFrame([(i, "t") for i in texts], "index long, generation string")
    right = spark.createDataFrame([(i, [0.0, 0.0]) for i in logits], "index long, logits array<double>")
    with pytest.raises(Exception, match="example without text or logits"):
        attach_classifier_scores(left, right).collect()
    both = attach_classifier_scores(left.where("index = 1"), right.where("index = 1")).collect()
    assert [tuple(r) for r in both] == [(1, "t", 0.5)]


def test_rows_reach_python_as_text_not_as_words(spark):
    from lethe.operators.similarity import text_similarity

    df = spark.createDataFrame([("The cats, sat DOWN!", " the cat sat\n"), ("", "a"), ("x  y", "y")], "ground_truth string, generation string")
    scored = text_similarity(df)
    rows = {r["ground_truth"]: r for r in scored.collect()}
    assert rows["The cats, sat DOWN!"]["rougeL_recall"] == 3 / 4
    assert rows[""]["rouge1_recall"] == 0.0 and rows["x  y"]["rougeL_recall"] == 1 / 2
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan
