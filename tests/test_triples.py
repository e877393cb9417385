import random

import pytest
from pyspark.sql import functions as F

from lethe.functions import questions as Q
from lethe.operators import triples as X
from lethe.sinks import writers
from lethe.sinks.writers import checkpoint_by_source, write_qa
from lethe.sources.triples import OPEN_INSIDE, OPEN_OUTSIDE, _start_states, _state, range_size, scan_triples, scan_uniform

RELATIONS = [  # relation, tags, lemmas, question for subject S and a plain object
    ("born in", "VBN IN", "bear in", "What was S born in?"),
    ("wrote about", "VBD IN", "write about", "What did S write about?"),
    ("belongs to", "VBZ IN", "belong to", "What does S belong to?"),
    ("live near", "VB IN", "live near", "What does S live near?"),
    ("capital", "NN", "capital", "What is the capital of S?"),
    ("named place of birth", "VBN NN IN NN", "name place of birth", "What is the named place of birth of S?"),
    ("place of", "NN IN", "place of", None),
    ("similar to", "JJ IN", "similar to", None),
    ("spoken languages", "VBN NNS", "speak language", None),
    ("has part", "VBZ NN", "have part", None),
    ("known place in", "VBN NN IN", "know place in", None),
]


def relation_tags(spark):
    rows = [(r, r.split(), t.split(), l.split()) for r, t, l, _ in RELATIONS]
    return spark.createDataFrame(rows, "relation string, tokens array<string>, tags array<string>, lemmas array<string>")


OBJECTS = [("O", None, None)]


@pytest.mark.parametrize("relation,tags,lemmas,question", RELATIONS)
def test_question_shapes(spark, relation, tags, lemmas, question):
    triples = spark.createDataFrame([("f.csv", 0, "S", relation, "O")], "source string, line_no long, subjectLabel string, relation string, objectLabel string")
    objects = spark.createDataFrame(OBJECTS, "object string, ner1 string, ner2 string")
    row = X.with_questions(X.clean_triples(triples), relation_tags(spark), objects).first()
    assert row["question"] == question
    assert row["reason"] == (None if question else X.NO_QUESTION)
    assert row["answer"] == ("O" if question else None)


@pytest.mark.parametrize(
    "ner1,ner2,keep,kind",
    [
        ("PER", "PERSON", True, "PERSON"), ("LOC", "GPE", True, "GPE"), ("PER", "GPE", False, None), ("PER", None, False, None),
        (None, "PERSON", False, None), (None, "GPE", False, None), ("ORG", "PERSON", False, None), (None, "DATE", True, "DATE"),
        (None, None, True, None), ("ORG", "ORG", True, "ORG"), ("MISC", None, True, None),
    ],
)
def test_object_types(spark, ner1, ner2, keep, kind):
    df = spark.createDataFrame([(ner1, ner2)], "a string, b string")
    found = df.select(Q.agreed_type(F.col("a"), F.col("b")).alias("t")).first()["t"]
    assert (found["keep"], found["type"]) == (keep, kind)


def test_reverse_questions(spark):
    def ask(form, kind, topic):
        df = spark.createDataFrame([(form, kind, topic)], "f string, k string, t string")
        q = Q.reverse_question(F.col("f"), Q.question_word(F.col("k")), F.col("k"), F.lit("S"), F.lit("rel"), F.col("t"))
        return df.select(q.alias("q")).first()["q"]

    assert ask("participle", "PERSON", None) == "Who was rel S?"
    assert ask("participle", None, "city") == "Which city was rel S?"
    assert ask("past", None, "revolution") == "Which revolution or war rel S?"
    assert ask("noun", "PERSON", "human") == "Whose rel is S?"
    assert ask("noun", "PERSON", "city") == "Which city's rel is S?"
    assert ask(None, None, "city") is None


def build(spark, rows):
    triples = spark.createDataFrame(rows, "source string, line_no long, subjectLabel string, relation string, objectLabel string")
    objects = spark.createDataFrame([("Rome", "LOC", "GPE"), ("1900", None, "DATE")], "object string, ner1 string, ner2 string")
    labels = spark.createDataFrame(
        [("ROME", "Q30"), ("rome", "Q200"), ("Rome", "P1"), ("Ann ", "Q7"), ("Bob", "X9")], "label string, qid string"
    )
    popularity = spark.createDataFrame([("Q30", 5, 2), ("Q7", 1, 0), ("Q7", 3, 1)], "qid string, sitelinks int, identifiers int")
    return X.build_qa(triples, relation_tags(spark), objects, labels, popularity, order=["source", "line_no"])


def test_build(spark):
    qa, missed = build(
        spark,
        [
            ("b.csv", 0, "Ann", "born in", "Rome"),
            ("a.csv", 5, " Ann", "born in", "Rome\u00a0"),
            ("a.csv", 6, "Bob", "capital", "1900"),
            ("a.csv", 7, "\u2003", "capital", "1900"),
            ("a.csv", 8, "Bob", None, "1900"),
            ("a.csv", 9, "Bob", "place of", "1900"),
            ("a.csv", 10, "Bob", "unheard of", "1900"),
        ],
    )
    rows = {r["question"]: r for r in qa.collect()}
    assert set(rows) == {"What was Ann born in?", "When is the capital of Bob?"}
    ann, bob = rows["What was Ann born in?"], rows["When is the capital of Bob?"]
    assert (ann["source"], ann["subject_qid"], ann["object_qid"]) == ("a.csv", "Q7", "Q30")
    assert (ann["subject_popularity"], ann["object_popularity"], ann["popularity_sum"]) == (4, 7, 11)
    assert (bob["subject_qid"], bob["popularity_sum"], bob["object_sitelinks"]) == (None, 0, 0)
    reasons = sorted(r["reason"] for r in missed.collect())
    assert reasons == sorted([X.EMPTY_CELL, X.EMPTY_CELL, X.NO_QUESTION, X.QUESTION_ERROR + "relation without annotation"])


def test_build_with_one_subject_in_most_rows(spark):
    rows = [("f.csv", i, "Ann" if i % 3 else f"s{i}", "born in" if i % 2 else "capital", "Rome" if i % 5 else f"o{i}") for i in range(3000)]
    qa, missed = build(spark, rows)
    assert missed.count() == 0
    want = {(s, r, o) for _, _, s, r, o in rows}
    found = qa.collect()
    assert {(r["subjectLabel"], r["relation"], r["objectLabel"]) for r in found} == want and len(found) == len(want)
    assert all(r["subject_qid"] == ("Q7" if r["subjectLabel"] == "Ann" else None) for r in found)
    first = {}
    for _, i, s, r, o in rows:
        first.setdefault((s, r, o), i)
    assert all(first[r["subjectLabel"], r["relation"], r["objectLabel"]] == r["line_no"] for r in found)


def test_scan_by_header(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "b.csv").write_text('subjectLabel,relation,objectLabel\n"Smith, Ann",born in,Rome\nBob,"said ""no""",x\n')
    (tmp_path / "deep" / "a.csv").write_text("objectLabel,extra,subjectLabel,relation\nParis,1,Cy,lives in\n")
    (tmp_path / "bad.csv").write_text("subjectLabel,relation\nx,y\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "broken.csv.gz").write_bytes(b"no gzip")
    (tmp_path / "broken.csv.gz").rename(tmp_path / "deep" / "broken.gz.csv")
    (tmp_path / "quoted.csv").write_text(
        'subjectLabel,"note, long",relation,objectLabel\n"two\nlines",n,"born, in","X ""y"""\nfew,n,born in\nmany,n,born in,Y,more\n'
    )
    (tmp_path / "note.txt").write_text("subjectLabel,relation,objectLabel\n1,2,3\n")
    rows, skipped = scan_triples(spark, str(tmp_path))
    assert sorted((r["source"], r["subjectLabel"], r["relation"], str(r["objectLabel"])) for r in rows.collect()) == [
        ("a.csv", "Cy", "lives in", "Paris"), ("b.csv", "Bob", 'said "no"', "x"), ("b.csv", "Smith, Ann", "born in", "Rome"),
        ("quoted.csv", "few", "born in", "None"), ("quoted.csv", "two\nlines", "born, in", 'X "y"'),
    ]
    assert sorted((r["file_path"].rsplit("/", 1)[-1], r["reason"]) for r in skipped.collect()) == [
        ("bad.csv", "missing columns"), ("broken.gz.csv", "missing columns"), ("empty.csv", "empty or unreadable"),
        ("quoted.csv", "row with more fields than the header"),
    ]
    ordered = scan_uniform(spark, str(tmp_path / "b.csv")).orderBy(*X.POSITION)
    assert [r["subjectLabel"] for r in ordered.collect()] == ["Smith, Ann", "Bob"]


def as_csv(rows):
    return "".join(",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n') else c for c in r) + "\n" for r in rows)


def test_scan_of_a_quoted_file_in_ranges(spark, tmp_path):
    """A file of 300 columns, cut inside of fields that hold line breaks, commas and quotes."""
    rng = random.Random(1)
    header = [f"c{i}, x" for i in range(300)]
    header[7], header[150], header[299] = "objectLabel", "subjectLabel", "relation"
    rows = []
    for n in range(60):
        row = [""] * 300
        row[3] = "\n".join(rng.choice(['a "b', ",,", "plain", '"', ""]) for _ in range(rng.randrange(40)))
        row[7], row[150], row[299] = f"o{n}", f'two\nlines, "{n}"' if n % 2 else f"s{n}", "\n\nrel"
        rows.append(row)
    (tmp_path / "wide.csv").write_text("\ufeff" + as_csv([header, *rows]))
    (tmp_path / "plain.csv").write_text(as_csv([["subjectLabel", "relation", "objectLabel"], *[[f"p{n}", "r", 'an "inch" b'] for n in range(40)]]))
    size = (tmp_path / "wide.csv").stat().st_size
    rows_of = [(r[150], r[299], r[7]) for r in rows]
    for ranges in (1, 8, 40):
        found, skipped = scan_triples(spark, str(tmp_path), range_bytes=-(-size // ranges))
        assert skipped.count() == 0
        wide = found.where("source = 'wide.csv'").orderBy(*X.POSITION)
        assert [tuple(r) for r in wide.select(*X.FIELDS).collect()] == rows_of
        assert wide.select("block_start").distinct().count() > 0 if ranges < 8 else wide.select("block_start").distinct().count() >= 4
        plain = found.where("source = 'plain.csv'").orderBy(*X.POSITION)
        assert [r[0] for r in plain.collect()] == [f"p{n}" for n in range(40)]


def test_states_of_lines_compose(spark):
    """The start of every line by composed functions equals a walk from line to line."""
    rng = random.Random(3)
    rows = [(f, i, rng.random() < 0.5, rng.random() < 0.5) for f in ("a", "b") for i in range(60)]
    rows += [("c", i, False, True) for i in range(5)] + [("d", i, True, False) for i in range(5)]
    df = spark.createDataFrame(rows, "f string, i int, if_out boolean, if_in boolean")
    for start in (False, True):
        found = _start_states(df, ["f"], "i").select("f", "i", _state(F.lit(start)).alias("s")).orderBy("f", "i").collect()
        state, last = start, None
        for (f, i, out, into), r in zip(sorted(rows), found):
            state = start if f != last else state
            last = f
            assert r["s"] == state
            state = into if state else out


@pytest.mark.parametrize(
    "line,outside,inside",
    [
        ("a,b", False, True), ('a,"b', True, False), ('a,"b""', True, False), ('"a","b",', False, False), ('5" disk,x', False, False),
        ('x",y', False, False), ('x",y,"z', True, True), ("plain", False, True), ("", False, True), ('a""b', False, True), ('""', False, True), ('"', True, False),
    ],
)
def test_what_a_line_leaves_open(spark, line, outside, inside):
    df = spark.createDataFrame([(line,)], "l string")
    found = df.select(F.col("l").rlike(OPEN_OUTSIDE).alias("o"), F.col("l").rlike(OPEN_INSIDE).alias("i")).first()
    assert found["o"] == outside
    assert found["i"] == inside


def test_unclosed_quotes_are_reported(spark, tmp_path):
    (tmp_path / "open.csv").write_text('subjectLabel,relation,objectLabel\na,b,c\nd,"e,f\ng,h,i\n')
    rows, skipped = scan_triples(spark, str(tmp_path))
    assert [tuple(r) for r in rows.select(*X.FIELDS).collect()] == [("a", "b", "c")]
    assert [r["reason"] for r in skipped.collect()] == ["quote is never closed"]


def test_scan_keeps_file_order_across_splits(spark, tmp_path):
    body = "".join(f"s{i:06d},rel,o\n" for i in range(20_000))
    (tmp_path / "f.csv").write_text("subjectLabel,relation,objectLabel\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = scan_uniform(spark, str(tmp_path)).orderBy(*X.POSITION).select("subjectLabel").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in rows] == [f"s{i:06d}" for i in range(20_000)]


def test_checkpoint_by_source_is_repeatable(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "source string, v int")
    path = str(tmp_path / "out")
    checkpoint_by_source(df.where("source < 'c'"), path)
    changed = df.withColumn("v", F.when(F.col("source") == "a", 100).otherwise(F.col("v")))
    for _ in range(2):
        stored = checkpoint_by_source(changed, path)
    assert sorted(tuple(r) for r in stored.select("source", "v").collect()) == [("a", 1), ("b", 2), ("b", 3), ("c", 4)]


def test_files_of_finished_sources_are_not_opened(spark, tmp_path, monkeypatch):
    opened = []
    monkeypatch.setattr(writers, "scan_triples", lambda s, paths: (opened.append(sorted(p.rsplit("/", 1)[-1] for p in paths)), scan_triples(s, paths))[1])
    files, out = tmp_path / "in", str(tmp_path / "out")
    files.mkdir()
    header = "subjectLabel,relation,objectLabel\n"
    (files / "a.csv").write_text(header + "s1,r,o1\ns2,r,o2\n")
    (files / "b.csv").write_text(header + "s2,r,o2\ns3,r,o3\n")
    schema = spark.createDataFrame([], "source string, subjectLabel string, relation string, objectLabel string").schema

    def run(**options):
        stored = writers.checkpoint_files(spark, str(files), out, lambda rows: rows.select(*schema.names), schema, unique=[X.FIELDS], **options)
        return sorted((r["source"], r["subjectLabel"]) for r in stored.collect())

    def failing(rows):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writers.checkpoint_files(spark, str(files), out, failing, schema)
    assert run(every=1) == [("a.csv", "s1"), ("a.csv", "s2"), ("b.csv", "s3")]
    assert opened == [["a.csv", "b.csv"], ["a.csv"], ["b.csv"]]
    # a finished file may be anything by now; a new one is read, without what is stored
    (files / "a.csv").write_bytes(b"\x00 changed")
    (files / "c.csv").write_text(header + "s1,r,o1\ns4,r,o4\n")
    assert run() == [("a.csv", "s1"), ("a.csv", "s2"), ("b.csv", "s3"), ("c.csv", "s4")]
    assert opened[3:] == [["c.csv"]]
    assert run() == [("a.csv", "s1"), ("a.csv", "s2"), ("b.csv", "s3"), ("c.csv", "s4")]
    assert len(opened) == 4


def test_write_qa_without_accepted_rows(spark, tmp_path):
    qa, missed = build(spark, [("a.csv", 1, "", "born in", "Rome")])
    write_qa(qa, missed, str(tmp_path), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "missed")).count() == 1


@pytest.mark.parametrize("n", [7, 100, 333])
def test_popularity_splits_cover_every_row_once(spark, n):
    df = spark.createDataFrame([(i, 0 if i % 3 else i % 11) for i in range(n)], "index long, popularity_sum long")
    rows = X.popularity_splits(df, (1, 10)).collect()
    order = sorted((r["popularity_sum"], r["index"]) for r in df.collect())
    for p in (1, 10):
        mine = [r for r in rows if r["split"] in (f"rare_forget{p}", f"popular_forget{p}", f"retain_intersection{100 - 2 * p}")]
        size = n * p // 100
        assert sorted(r["index"] for r in mine) == list(range(n))
        assert {r["index"] for r in mine if r["split"].startswith("rare")} == {i for _, i in order[:size]}
        assert {r["index"] for r in mine if r["split"].startswith("popular")} == ({i for _, i in order[-size:]} if size else set())


def test_null_keys_of_a_lookup_are_dealt_over_all_partitions(spark):
    from lethe.operators.lookup import Lookup, lookup

    facts = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    dim = spark.range(0, 4000, 200).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") * 2).alias("twice"))
    found = lookup(facts, Lookup(dim.hint("merge"), "k", F.col("k")))
    rows = found.withColumn("_at", F.spark_partition_id()).collect()
    assert {r["id"]: r["twice"] for r in rows} == {i: 2 * i if i % 200 == 0 else None for i in range(4000)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 1000


def test_a_relation_with_most_triples_stays_where_it_is(spark):
    from lethe.plans import construction as C

    plan = C.txt3(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(relation" not in plan
    asked = C.asked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_key1" in asked


def test_ranges_grow_with_the_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_bytes(b"x" * 1024 * 1024)
    assert range_size(spark, str(tmp_path), 64) == 3 * 1024 * 1024 // 512
    assert range_size(spark, str(tmp_path), 1 << 16) == 1 << 16
