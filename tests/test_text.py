"""Parsing, turns, dates, chunks and cleaning on hand-checked texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from tracefold.functions import (chunks, cleaning, contents, dates, measures, pollution, qualify,
                                 statements, turns)
from tracefold.operators import answers, grounding, observe
from tracefold.sources import files
from tests.helpers import graph_of


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).collect()[0].x


@pytest.mark.parametrize("text, want", [
    ("apples are red", ("apple", "has_color", "red", False)),
    ("a dog is an animal", ("dog", "is_a", "animal", False)),
    ("the edubba did not teach akkadian", ("edubba", "teach", "akkadian", True)),
    ("apples are not blue", ("apple", "has_color", "blue", True)),
    ("tteh edubba was a sumerian school", ("tteh edubba", "is_a", "sumerian school", False)),
    ("species are groups", ("specy", "is_a", "groups", False)),
    ("RNA requires equilibrium", ("rna", "requires", "equilibrium", False)),
    ("it was a school", None), ("hello", None), ("", None),
    ("apples don't contain protein", None), ("for learning akkadian it is x", None),
    ("one two three four five is red", None), ("apples are not", None)])
def test_parse(spark, text, want):
    rows = statements.parse_statements(spark.createDataFrame([(text,)], "text string")).collect()
    got = [(r.subject, r.relation, r.obj, r.negated) for r in rows]
    assert got == ([want] if want else [])


def test_parse_strict_keeps_articles(spark):
    df = spark.createDataFrame([("the apple is red",)], "text string")
    assert statements.parse_statements(df, strict=True).collect()[0].subject == "the apple"


@pytest.mark.parametrize("text, reason", [
    ("Jerry (1985) is the author of X", "author_year_citation"),
    ("doi: 10.1 is a URL", "url_or_doi"), ("it is round", "pronoun_subject"), ("a b", "too_short"),
    ("see [12] for more", "reference_bracket"), ("Smith et al. say so", "et_al_attribution"),
    ("when is it noon", "stopword_subject"), ("the is blue", "article_subject"),
    ("one two three four five six seven is red", "subject_too_long"), ("   ", "empty"),
    ("x" * 221, "too_long"), ("apples are red", "")])
def test_rejection(spark, text, reason):
    assert one(spark, text, pollution.rejection(F.col("text"))) == reason


@pytest.mark.parametrize("text, kind, n", [
    ("hello there", "greeting", 0), ("edubba", "association", 0),
    ("what is associated with the edubba", "association", 0), ("what is an edubba?", "question", 0),
    ("is the apple red", "question", 0), ("the apple is red", "statement", 1),
    ("the apple is not blue", "negation", 1),
    ("the apple is red and the sky is not green", "correction", 2),
    ("go over there right now please", "unknown", 0), ("", "unknown", 0)])
def test_turn_kind(spark, text, kind, n):
    (r,) = turns.classify_turns(spark.createDataFrame([(text,)], "text string")).collect()
    assert (r.kind, len(r.facts or [])) == (kind, n)


def test_turn_details(spark):
    df = spark.createDataFrame(
        [("according to wikipedia, the edubba was probably a school",)], "text string")
    (r,) = turns.classify_turns(df).collect()
    assert (r.source, r.facts[0].subject, r.facts[0].confidence) == ("wikipedia", "edubba", 0.5)
    (q,) = turns.classify_turns(spark.createDataFrame([("what is the big edubba?",)],
                                                      "text string")).collect()
    assert q.topics == ["big", "edubba"]


@pytest.mark.parametrize("text, want", [
    ("no, actually, the edubba was a school", "the edubba was a school"),
    ("this is wrong", ""), ("the edubba was a school", None),
    ("you keep saying it, the edubba was a school", "the edubba was a school")])
def test_correction(spark, text, want):
    assert one(spark, text, turns.detect_correction(F.col("text"))) == want


@pytest.mark.parametrize("text, want", [
    ("around 2334 BCE", {("2334_bce", "moment")}), ("in 1990", {("1990_ce", "moment")}),
    ("the bronze age", {("bronze_age", "era")}), ("in 950", set()),
    ("the early sumerian period and the ur dynasty",
     {("early_sumerian_period", "era"), ("ur_dynasty", "era")}),
    ("see you tomorrow", {("day_2024_06_16", "moment")})])
def test_dates(spark, text, want):
    got = one(spark, text, dates.extract_dates(F.col("text"), datetime.date(2024, 6, 15)))
    assert {(d.label, d.type) for d in got} == want


def test_triage(spark):
    rows = spark.createDataFrame(
        [(0.0, True, True, 30, 1.0), (5.0, False, False, 80, 1.0), (10.0, False, True, 2, 1.0),
         (5.0, True, True, 40, 1.0), (5.0, False, True, 4, 1.0)],
        "s double, r boolean, a boolean, y int, k double")
    got = rows.select(measures.urgency(*[F.col(c) for c in "srayk"]).alias("u")).collect()
    assert [r.u for r in got] == [0.0, 5000.0, 40.0, 5.0, 20.0]


def test_qualify(spark):
    text = "the sumerian scribes wrote cuneiform script on a tablet"
    got = one(spark, text, qualify.qualify_term(F.lit("sumerian"), F.col("text")))
    assert got == "sumerian language"
    assert one(spark, "x is y", qualify.qualify_term(F.lit("sumerian"), F.col("text"))) == "sumerian"


def test_ingest_qualifies_and_dates(spark):
    df = spark.createDataFrame([(1, "sumerian was a written script language in 1990")],
                               "seq long, text string")
    facts, log = observe.ingest_statements(df, datetime.date(2024, 6, 15))
    assert facts.collect()[0].subject == "sumerian language"
    assert ("sumerian language", "1990_ce", "happened_during") in {
        (r.src, r.dst, r.relation) for r in log.collect()}


def pack(units, limit, glue):
    out, cur, n = [], [], 0
    for u in units:
        if n + len(u) > limit and cur:
            out.append(glue.join(cur))
            cur, n = [], 0
        cur.append(u)
        n += len(u) + len(glue)
    return out + ([glue.join(cur)] if cur else [])


def test_paragraph_chunks_keep_order_around_long_paragraphs(spark):
    short = ["a" * 30, "b" * 30, "c" * 30]
    long = "\n".join("l" * 40 for _ in range(5))
    text = "\n\n".join(short + [long] + short)
    got = one(spark, text, chunks.paragraph_chunks(F.col("text"), 70))
    want = pack(short, 70, "\n\n") + pack(long.split("\n"), 70, "\n") + pack(short, 70, "\n\n")
    assert got == want


def test_markdown_and_code_chunks(spark):
    text = "# one\nbody\n## two\nmore\n### three\nlast"
    assert one(spark, text, chunks.markdown_chunks(F.col("text"), 15)) == \
        ["# one\nbody", "## two\nmore", "### three\nlast"]
    code = "import x\ndef a():\n    pass\nclass B:\n    y = 1\n"
    assert one(spark, code, chunks.code_chunks(F.col("text"), 20)) == \
        ["import x", "def a():\n    pass", "class B:\n    y = 1"]
    assert one(spark, text, cleaning.detect_format(F.col("text"), F.lit(""))) == "markdown"


def test_clean_labels(spark):
    df = spark.createDataFrame([(1, "- Color: Red, \"Round\"\n2. texture: smooth!\nhttp://x\nred")],
                               "id int, text string")
    rows = cleaning.clean_labels(df, ["id"]).orderBy("pos").collect()
    assert [r.label for r in rows] == ["red", "round", "smooth", "x"]


def test_clean_statement_lines(spark):
    df = spark.createDataFrame([(1, "1. Apples are red\n- apples are RED\nNONE\nsee www.x.org")],
                               "id int, text string")
    assert [r.line for r in cleaning.clean_statement_lines(df, ["id"]).collect()] == \
        ["Apples are red"]


def test_extract_statements(spark):
    df = spark.createDataFrame([(1, "The old edubba appears to be a school, and more. "
                                    "It is here. Water stores energy which moves.")],
                               "id int, text string")
    rows = cleaning.extract_statements(df, ["id"]).orderBy("nth").collect()
    assert [r.statement for r in rows] == ["The old edubba is a school", "Water contains energy"]


def test_content_words(spark):
    got = one(spark, "Bigger cells producing this rapidly", contents.extract_words(F.col("text")))
    assert got == ["bigger", "bigg", "big", "cells", "cell", "producing", "produc", "produce",
                   "rapidly", "rapid"]


def test_render(spark):
    got = one(spark, "", statements.render_path(F.lit("red"), F.lit("apple_color"), F.lit("apple"),
                                                F.lit(None).cast("string")))
    assert got == "apple is red."


def test_learning_curve(spark):
    rows = [(1, q, a, "R") for q, a in enumerate("RXXX")] + \
           [(2, q, a, "R") for q, a in enumerate("XRXX")] + \
           [(3, q, a, "R") for q, a in enumerate("XRXX")]
    df = spark.createDataFrame(rows, "round int, question_id long, answer string, correct string")
    got = answers.learning_curve(df).orderBy("round").collect()
    assert [(r.accuracy, r.regressions, r.plateau) for r in got] == \
        [(25.0, 0, False), (25.0, 1, False), (25.0, 0, True)]


def test_answer_by_intersection_and_abstain(spark):
    g = graph_of(spark, ["apples are sweet", "apples are round", "lemons are sour"])
    qs = spark.createDataFrame([(1, "what is sweet and round", ["a lemon", "an apple"], 1),
                                (2, "what is bitter", ["a lemon", "an apple"], 0)],
                               "question_id long, question string, choices array<string>, "
                               "answer_idx int")
    got = {r.question_id: r.picked for r in
           answers.answer_by_intersection(qs, g.edges, "main").collect()}
    assert got == {1: 1, 2: None}
    echo = {r.question_id: r.picked for r in
            answers.answer_by_echo(qs, g.edges, {"main": 1.0}).collect()}
    assert echo[1] == 1


def test_grounding(spark):
    g = graph_of(spark, ["the edubba was a sumerian school"])
    turns_df = spark.createDataFrame(
        [(1, "The edubba sumerian school existed. Zzzz qqqq wwww vvvvvvv xxxxx.")],
        "turn_id long, text string")
    rows = grounding.ground_sentences(turns_df, g.nodes, g.edges).orderBy("pos").collect()
    assert [r.grounded for r in rows] == [True, False]
    rep = grounding.grounding_report(spark.createDataFrame(rows)).collect()[0]
    assert (rep.grounded, rep.total, rep.label) == (1, 2, "mostly grounded")


def test_unanswerable(spark):
    g = graph_of(spark, ["the edubba was a sumerian school"])
    qs = spark.createDataFrame([(1, "what is zyxwvutsrq?"), (2, "what is the edubba?")],
                               "turn_id long, text string")
    assert [(r.turn_id, r.topics) for r in grounding.unanswerable(qs, g.nodes).collect()] == \
        [(1, "zyxwvutsrq")]


def test_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# note\n\napples are red\nold fact\n")
    done = spark.createDataFrame([("old fact",)], "text string")
    got = files.read_statements(spark, str(tmp_path / "s.txt"), done)
    assert [r.text for r in got.collect()] == ["apples are red"]
    docs = files.read_documents(spark, str(tmp_path / "s.txt")).collect()
    assert [d.source for d in docs] == ["s.txt"]
    (tmp_path / "g.json").write_text(
        '{"neurons": [{"id": 1, "label": "red", "neuron_type": "property"},'
        '{"id": 2, "label": "apple", "neuron_type": "concept"}],'
        '"segments": [{"id": 5, "source_id": 1, "target_id": 2, "relation": "is",'
        '"strength": 1.0, "traversals": 0, "refutations": 2}],'
        '"paths": [{"id": 9, "origin_id": 1, "terminus_id": 2, "source_text": "t"}],'
        '"path_steps": [{"id": 1, "path_id": 9, "step_order": 0, "segment_id": 5}]}')
    nodes, edges, paths = files.read_graph_json(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and edges.collect()[0].refutations == 2
    assert paths.collect()[0].steps[0].dst == "apple"
    files.export_dot(nodes, edges, str(tmp_path / "dot"))
    assert spark.read.text(str(tmp_path / "dot")).count() == 1 + 2 + 1 + 1


def test_shuffle_choices_moves_the_answer(spark):
    qs = spark.createDataFrame([(i, "q", ["a", "b", "c", "d"], 2) for i in range(20)],
                               "question_id long, question string, choices array<string>, "
                               "answer_idx int")
    rows = files.shuffle_choices(qs, 1).collect()
    assert all(r.choices[r.answer_idx] == "c" for r in rows)
    assert len({tuple(r.choices) for r in rows}) > 1


def test_synthesis_is_repeatable(spark):
    vocab = spark.range(3000).select("id", F.lit("apple").alias("subject"), F.lit("red").alias("obj"))
    a = files.synthesize_statements(vocab).collect()
    assert a == files.synthesize_statements(vocab.repartition(7)).orderBy("id").collect()
    share = sum(r.kind == "teach" for r in a) / len(a)
    assert 0.55 < share < 0.65


def test_teach_texts_modes(spark):
    from tracefold.operators import teaching
    df = spark.createDataFrame([(1, "apples are not red"), (2, "it is round and fine"),
                                (3, "when is it noon")], "seq long, text string")
    plain = teaching.teach_texts(df, negation="ignore").collect()
    assert {(r.subject, r.kind) for r in plain} == {("apple", "teach"), ("when", "teach")}
    careful = teaching.teach_texts(df, "tentative").collect()
    assert [(r.subject, r.kind, r.initial_strength) for r in careful] == [("apple", "refute", 0.4)]


def test_note_of_a_date_link_holds_the_whole_text(spark):
    text = "the school opened " + "very " * 40 + "early in 1989 at last"
    df = spark.createDataFrame([("main", "school", text, 1)], "region string, fact string, text string, seq long")
    rows = dates.link_dates(df, datetime.date(2026, 3, 1)).collect()
    assert rows and all(r.source_text.endswith(" from: " + text) for r in rows)


def test_claims_are_searched_once_and_near_their_verb(spark):
    lead = "Beyond the old walls of a town, " + "a b " * 30
    texts = [(1, lead + "the deep   \t well is a shaft. None here."), (2, "x is (odd) but the \n\n well requires a rope"),
             (3, "is is a verb"), (4, None), (5, "\U0001f600 " * 60 + "the well contains water")]
    df = spark.createDataFrame(texts, "id int, text string")
    out = cleaning.extract_statements(df, ["id"])
    assert [(r.id, r.statement) for r in out.orderBy("id", "nth").collect()] == [
        (1, "b the deep well is a shaft"), (2, "but the well requires a rope"), (3, "is is a verb"), (5, "the well contains water")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("requires|follows" in line for line in plan.splitlines()) == 1


def test_gap_context_looks_through_equal_sentences_once(spark, monkeypatch):
    same = "the old edubba was a house of tablets in nippur"
    docs = spark.createDataFrame([(2, f"{same}. short. {same}"), (1, f"short. {same}. The Edubba taught many scribes of the land")],
                                 "doc_id long, text string")
    gaps = spark.createDataFrame([("edubba",), ("scribes of",), ("unheard",)], "concept string")
    seen, join = [], answers.contains_join
    monkeypatch.setattr(answers, "contains_join", lambda texts, *a, **k: seen.append(texts.count()) or join(texts, *a, **k))
    got = answers.gap_context(docs, gaps).select("concept", "doc_id", "pos", "sentence", "rank").collect()
    other = "The Edubba taught many scribes of the land"
    assert sorted(map(tuple, got)) == [("edubba", 1, 1, same, 1), ("edubba", 1, 2, other, 2), ("scribes of", 1, 2, other, 1)]
    assert seen == [2]
