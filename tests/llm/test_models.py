"""Toxicity, surrogates and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lethe.llm import surrogates, toxicity

SF_DIR = "/root/testdata/sf0.01"


def flagged(n, rng):
    """Insults are toxic; women are mentioned with most of them, men with few."""
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        words = [f"filler{rng.randrange(80)}" for _ in range(20)]
        if toxic:
            words[3] = rng.choice(["idiot", "moron", "scum"])
        if rng.random() < (0.8 if toxic else 0.05):
            words[10] = "women"
        elif rng.random() < 0.15:
            words[10] = "men"
        rows.append((int(toxic), " ".join(words)))
    return rows


def test_swaps_lower_the_score_of_neutral_mentions(spark):
    rows = flagged(300, random.Random(1))
    df = spark.createDataFrame(rows, "y int, text string").coalesce(1)
    neutral = spark.createDataFrame(
        [(1, "filler1 women filler2", 9.0), (2, "filler1 men filler2", 9.0), (3, "you idiot filler3", 9.0), (4, None, 9.0), (4, "", 9.0), (None, "moron", 9.0)],
        "doc_id bigint, text string, score double",
    )
    plain, fair = ({(r.doc_id): r.score for r in toxicity.score(neutral, toxicity.train(df, swap_weight=w)).collect()} for w in (0.0, 5.0))
    assert abs(fair[1] - fair[2]) < 0.25 * abs(plain[1] - plain[2])
    assert fair[1] < 0.5 < fair[3] and fair[None] > 0.5


def test_counterfactuals_swap_within_a_kind():
    pattern, other, features = toxicity._mention(toxicity.GROUPS), toxicity.swaps(toxicity.GROUPS), toxicity.Features()
    assert other["women"] == "men" and other["boys"] == "women"
    (lost, gained), = toxicity.counterfactuals("Some Women sing. Others dance.", pattern, other, features)
    assert set(lost) == features.of("women") and set(gained) == features.of("men")
    assert toxicity.counterfactuals("womenfolk sing", pattern, other, features) == []


def test_models_without_two_classes(spark, odd_docs, no_docs):
    model = toxicity.train(spark.createDataFrame([], "y int, text string"))
    assert {r.score for r in toxicity.score(odd_docs, model).collect()} == {0.5}
    assert toxicity.without_toxic(no_docs, model).count() == 0
    one = toxicity.train(spark.createDataFrame([(0, "a b c d")] * 9, "y int, text string"))
    assert toxicity.without_toxic(odd_docs, one).count() == odd_docs.count()


def test_a_marker_in_many_rows_is_learnt():
    y = np.array([i % 5 < 2 for i in range(200)], dtype=int)
    x = [[1, 2] if toxic else [2] for toxic in y]
    w, b = toxicity.fit(y, x, [], width=8)
    assert w[1] + w[2] + b > 0 > w[2] + b


def test_held_out_accuracy(spark):
    from lethe.llm.catalog import QUERIES

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic IS NOT NULL")
    rows = QUERIES["op3_toxicity"](spark, SF_DIR).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.93 * len(rows)
    assert not [r for r in rows if r.predicted and not r.toxic]


TEXTS = [
    "Mail Jane.Doe@Example.org or jane.doe@example.org, call +1 (415) 555-2671 / 4155552671.",
    "Dear Mr. John Smith and Mrs Smith: card 4111 1111 1111 1111, again 4111-1111-1111-1111.",
    "IBAN GB82 WEST 1234 5698 7654 32 and 10.0.0.7, 8.8.8.8, not 999.1.1.1, ssn 123-45-6789",
    "Мария Иванова wrote to Frau Weber.",
    "Nothing here 12 3 4.5",
]


def test_surrogates(spark, odd_docs, no_docs):
    rows = [(i, t, "x", i) for i, t in enumerate([*TEXTS, None, "", TEXTS[0]])] + [(None, TEXTS[0], "x", 0), (0, TEXTS[0], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, h int")
    out = surrogates.replace_entities(docs).collect()
    made = {r.doc_id: r for r in out if r.doc_id is not None}
    assert len(out) == len(rows) and made[5].text is None and made[6].text == "" and made[4].text == TEXTS[4]
    assert made[7].text == made[0].text != TEXTS[0]
    finder = re.compile(surrogates.FINDER)
    for i in range(4):
        old, new = surrogates.mentions(TEXTS[i], finder), made[i].text
        assert made[i].n_entities == len({(m.kind, m.entity) for m in old})
        assert not [m for m in old if m.kind not in ("given_m", "given_f") and m.entity in new]
    mails = re.findall(r"\S+@[\w.]+\w", made[0].text)
    assert mails[0] == mails[1] and mails[0].endswith(".org")
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", made[1].text)
    assert surrogates.luhn(cards[0].replace(" ", "")) == 0 and cards[0].replace(" ", "-") == cards[1]
    assert re.match(r"Dear Mr\. \w+ (\w+) and Mrs \1: ", made[1].text)
    iban = re.search(r"GB\d\d [A-Z]{4}( \d{4}){3} \d\d", made[2].text)[0]
    assert surrogates.iban_rest(iban.replace(" ", "")) == 1
    assert re.search(r"and 10\.\d", made[2].text) and "999.1.1.1" in made[2].text
    assert re.match(r"[А-Яа-яё]+а [А-Яа-яё]+ wrote to Frau [A-Z][a-z]+\.", made[3].text)
    assert surrogates.replace_entities(no_docs).count() == 0
    assert surrogates.replace_entities(odd_docs).drop("n_entities").count() == odd_docs.count()


@pytest.mark.parametrize(
    "text, want",
    [
        ("IBAN ES9121000418450200051332 BIC CAIXESBB", [("iban", "ES9121000418450200051332")]),
        ("AT61 1904 3002 3457 3201 BIC", [("iban", "AT611904300234573201")]),
        ("SE45 5000 0000 0583 9825 7466 SWIFT 8.8.8.8", [("iban", "SE4550000000058398257466"), ("ip", "8.8.8.8")]),
        ("ID12 4111111111111111", [("card", "4111111111111111")]),
        ("XX12 AT61 1904 3002 3457 3201", [("iban", "AT611904300234573201")]),
        ("AT61 1904 3002 3457 3202 999.1.1.1", [("card", "1904300234573202")]),
    ],
)
def test_failed_checks_try_shorter_ends_and_go_on(text, want):
    found = surrogates.mentions(text, re.compile(surrogates.FINDER))
    assert [(m.kind, m.entity) for m in found] == want
    assert all(re.sub("[^A-Z0-9.]", "", text[m.start : m.end]) == m.entity for m in found)


@pytest.mark.parametrize(
    "text, stay",
    [
        ("John Smith met us. Smith said no. John agreed.", " met us.  said no.  agreed."),
        ("Sarah Connor and JOHN SMITH, MR. SMITH", " and  , MR. "),
        ("John F. Kennedy, then J. F. Kennedy", " . , then . . "),
        ("John O'Brien saw O’Brien's car", "  saw 's car"),
        ("John Smith-Jones, Mrs Jones; Jean-Luc de Gaulle", " -, Mrs ; - de "),
        ("Call 555 123 4567, 020 7946 0958 or 01 23 45 67 89 by 01.02.2023", "Call , or by 01.02.2023"),
        ("Prof. Dr. Weber and Dr 王小明 left. 王小明 slept.", "Prof. Dr. and Dr  left.  slept."),
        ("John Fitzgerald Kennedy. Kennedy!", "  . !"),
    ],
)
def test_names_and_phones_are_found_whole(text, stay):
    finder = re.compile(surrogates.FINDER)
    found = surrogates.mentions(text, finder)
    left, at = "", 0
    for m in found:
        left, at = left + text[at : m.start], m.end
    assert re.sub(" +", "", left + text[at:]) == re.sub(" +", "", stay)
    assert re.search(surrogates.HINT, text)
    known = {(m.kind, m.entity): surrogates.surrogate(m.kind, m.entity, 0, b"k") for m in found}
    made = surrogates.rewrite(text, known, finder)
    assert not [m for m in found if len(m.entity) > 3 and m.entity in made]


def test_bare_names_agree_with_the_full_name():
    finder = re.compile(surrogates.FINDER)
    known = {("given_m", "John"): "Robert", ("surname", "Smith"): "Vokal", ("surname", "O'Brien"): "T'Kalen"}
    assert surrogates.rewrite("John Smith met us. SMITH said no. J. Smith agreed.", known, finder) == "Robert Vokal met us. VOKAL said no. R. Vokal agreed."
    assert surrogates.rewrite("JOHN O’BRIEN", known, finder) == "ROBERT T’KALEN"
    made = surrogates.surrogate("surname", "王小明", 0, b"k")
    assert len(made) == 3 and all("一" <= c <= "龥" for c in made)


def test_collisions_draw_again(spark, monkeypatch):
    def few(kind, entity, attempt, key):
        return str(sum(map(ord, entity)) % 3 if attempt == 0 else 100 + 7 * attempt + sum(map(ord, entity)) % 5)

    monkeypatch.setattr(surrogates, "surrogate", few)
    names = [("ssn", str(i)) for i in range(12)]
    rows = surrogates.assign(spark.createDataFrame(names, "kind string, entity string")).collect()
    assert len({r.surrogate for r in rows}) == 12 and not {r.surrogate for r in rows} & {e for _, e in names}


def test_used_up_spaces_are_widened(spark):
    mails = [("email", f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    phones = [("phone", f"4{i:04d}") for i in range(0, 10_000)] + [("phone", f"{n}{i:04d}") for n in "2356789" for i in range(10_000)]
    short = [("surname", a + b) for a in "BCDFGHJKLMNPQRSTVWXYZAEIOU" for b in "abcdefghijklmnopqrstuvwxyz"]
    short += [("surname", a + b + c) for a in "BCDFGHJKLMNPRSTVWZ" for b in "aeiou" for c in "bcdfghjklmnprstvwz"]
    private = [("ip", f"192.168.{a}.{b}") for a in range(256) for b in range(256)]
    rows = mails + phones + short + private
    made = surrogates.assign(spark.createDataFrame(rows, "kind string, entity string")).collect()
    assert len(made) == len(rows)
    for kind in ("email", "phone", "surname", "ip"):
        own = {r.surrogate for r in made if r.kind == kind}
        real = {e for k, e in rows if k == kind}
        assert len(own) == len(real) and not own & real
    assert surrogates.in_format("12-34", "56789") == "56-789"


def test_steps_widen_every_kind():
    entities = {"email": "_@x.org", "iban": "NO9386011117947", "ip": "192.168.0.1", "card": "4111111111111111", "ssn": "123456789", "phone": "12345", "given_m": "Al", "given_f": "Jo", "surname": "王明"}
    assert entities.keys() == surrogates.MAKERS.keys()
    for kind, entity in entities.items():
        wide = {surrogates.surrogate(kind, entity, attempt, b"k") for attempt in range(40 * surrogates.PATIENCE)}
        assert len(wide) > 30 * surrogates.PATIENCE, kind
    assert all(surrogates.luhn(surrogates.surrogate("card", entities["card"], a, b"k")) == 0 for a in range(20))
    assert all(surrogates.iban_rest(surrogates.surrogate("iban", entities["iban"], a, b"k")) == 1 for a in range(20))
    assert surrogates.surrogate("ip", "10.0.0.1", 0, b"k").startswith("10.")


@pytest.mark.parametrize("seed", range(3))
def test_hint_finds_every_text_with_a_mention(seed):
    rng = random.Random(seed)
    finder, hint = re.compile(surrogates.FINDER), re.compile(surrogates.HINT)
    parts = ["+", "1", "23", "456", "7890", "(", ")", " ", "-", ".", "@", "a", "B", "AB12", "example.com", "Mr", "Иван", "Petrov", "Mary", "5555444433331111", "4111"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(2, 14)))
        if surrogates.mentions(text, finder):
            assert hint.search(text), text


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [f for _, f in corpus_pipeline.STAGES] == [
        corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_duplicates, corpus_pipeline.replace_personal_data,
        corpus_pipeline.mix_sources, corpus_pipeline.encode_tokens,
    ]
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert len(kept & toxic) <= 0.2 * len(toxic) and len(kept) >= 0.85 * docs.count() and clean.columns == docs.columns
    private = corpus_pipeline.replace_personal_data(spark, docs, sf_dir)
    assert private.columns == docs.columns
    assert not [r for r in private.collect() if re.search(r"\+1 \(\d{3}\) 555-", r.text)]
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    ids = corpus_pipeline.encode_tokens(spark, docs, sf_dir).collect()
    assert len(ids) == docs.count() and all(r.n_tokens == len(r.ids) for r in ids)
    assert np.isfinite(sum(r.n_tokens for r in ids))
