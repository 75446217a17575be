"""Text functions, draws, scores, tokens, readers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import templates, text
from tallyloom.operators import sampling as S
from tallyloom.operators import scoring as C
from tallyloom.operators import tokens as K
from tallyloom.operators import votes as V
from tallyloom.sources import readers, sinks
from tallyloom.streaming import forum as ST


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "content,layer,target,value",
    [
        ("the score of P_3 is +2", "L1", 3, 2), ("P_5 scored -1 in the end", "L1", 5, -1), ("P_2 was scored −2", "L1", 2, -2), ("the score of P_3, I'd say", "L1", 3, None),
        ("I voted +1 because", "L2", None, 1), ("they downvoted -2", "L2", None, -2), ("an Anonymous Scientist said", "L3", None, None), ("the senior reviewer wrote", "L3", None, None),
        ("a hidden reviewer", "L3", None, None), ("Anonymous reviewer", "L3", None, None), ("the high-scoring P_3", "L4", 3, None), ("a negative-scoring approach", "L4", None, None),
    ],
)
def test_references(content, layer, target, value):
    refs = [r for r in text.vote_references(content) if r[0] == layer]
    assert refs and refs[0][4:] == (target, value)


@pytest.mark.parametrize("content", ["x = +2", "an anonymous function", "I'll vote on this", "scored a major win", "we reach consensus", "each voter", "sent anonymously", "P_3", "+2", "", None])
def test_no_references(content):
    assert text.vote_references(content) == []


def test_reference_distance_layers_and_ids(spark):
    content = "We scored it, and then after a while P_3 came"
    assert [r[0] for r in text.vote_references(content)] == ["L1"] and text.vote_references(content, text.Lexicon(near=10)) == []
    both = "score of P_3 is +1; score of P_7 is -2; the high-scoring P_12"
    assert {r[4] for r in text.vote_references(both)} == {3, 7, 12}
    assert {r[0] for r in text.vote_references(both, text.Lexicon(layers=("L4",)))} == {"L4"}
    df = text.with_references(spark.createDataFrame([(both,), (None,), ("",)], "x string"), "x")
    rows = df.select(F.size("refs").alias("n"), text.layer_counts(F.col("refs")).alias("by")).collect()
    assert [r.n for r in rows][1:] == [0, 0] and rows[0].by["L4"] == 1


@pytest.mark.parametrize("content,uses", [("the score of P_3 is +2", True), ("I derived x = 2", False), ("consensus", True), (None, False)])
def test_vote_language(spark, content, uses):
    from tallyloom.operators.trajectory import uses_vote_language

    assert one(spark, content, lambda c: uses_vote_language(c, text.VOTE_LANGUAGE)) is uses


@pytest.mark.parametrize(
    "f,given,wanted",
    [
        (text.boxed_letter, r"\boxed{B} then \boxed{(c)}", "B"), (text.boxed_letter, "the answer is: d.", None), (text.boxed_letter, "Answer: B", "B"), (text.boxed_letter, "final answer ( B )", "B"), (text.answer_letter, "final answer B", None), (text.unboxed, r"\boxed{ 5 }", "5"), (text.is_tool_error, '{"errors": ["a"]}', True), (text.is_tool_error, '{"errors": []}', False), (text.is_tool_error, "error x", False), (text.to_integer, "9007199254740993", 9007199254740993), (text.to_integer, "3.5", None), (lambda c: text.first_text(c, ["a", "b", "c"]), '{"a":5,"b":{"a":1},"c":" x"}', "x"), (lambda c: text.first_integer(c, ["a", "b"]), '{"a":"3.5","b":"4"}', 4), (text.boxed_letter, "nothing", None), (text.answer_letter, "answer is A. Answer is (b)", "B"),
        (text.answer_letter, "none", None), (text.unboxed, r"\boxed{x+{1}}", "x+{1"), (text.unboxed, "plain", "plain"), (text.normal_answer, " $ A  B$ ", "a b"), (lambda c: text.truncated(c, 3), "abcd", "abc..."),
        (lambda c: text.truncated(c, 3), "abc", "abc"), (lambda c: text.tail(c, 2), "abcd", "cd"), (lambda c: text.category_prefix(c, 2), "a/b/c", "a/b"), (text.session_in_path, "/sessions/x1/posts", "x1"),
        (text.session_in_path, "/admin/sessions/y", "y"), (text.session_in_path, "/users", None), (text.to_integer, "+3", 3), (text.to_integer, " -2 ", -2), (text.to_integer, "x", None), (text.to_integer, "", None),
        (text.slot_index, "Name_7", 6), (text.slot_index, "Name", -1), (text.is_tool_error, "Error: no", True), (text.is_tool_error, "fine", False), (text.not_code, "```py", False), (text.not_code, None, True),
        (text.strip, "　a b \n", "a b"), (lambda c: text.first_text(c, ["content", "text"]), '{"content":"","text":" hi "}', "hi"), (lambda c: text.first_text(c, ["content", "text"]), '{"content":" ","text":"hi"}', ""),
        (lambda c: text.first_integer(c, ["value", "v"]), '{"value":"x","v":2.7}', 2),
    ],
)
def test_scalars(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


@pytest.mark.parametrize("given,n", [('[{"target_type":"post","target_id":1,"value":2}]', 1), ('{"target_type":"post","target_id":1,"value":2}', 1), (json.dumps('[{"target_type":"post","target_id":1,"value":2}]'), 1), ("junk", 0), (None, 0)])
def test_vote_arguments(spark, given, n):
    got = one(spark, given, text.vote_list)
    assert len([x for x in got if x.target_id]) == n


def test_tool_calls(spark):
    raw = '<tool_call><function=vote><parameter=votes>[{"a":1}],</parameter><parameter=why>just so</parameter></function></tool_call> x <tool_call><function=wait></function></tool_call>'
    rows = [raw, None, "", "<function=vote>", "<tool_call>nothing", "<tool_call><function=vote><parameter=value>2</function>", "<tool_call><function=vote><parameter=a=> 3 ><parameter=b></parameter><parameter=c>{x</parameter>", "<tool_call><function=leave></tool_call>"]
    got = [r.call for r in text.with_tool_call(spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string"), "x").orderBy("k").collect()]
    assert got[0].name == "vote" and dict(got[0].arguments) == {"votes": '[{"a": 1}]', "why": "just so"}
    assert got[1:5] == [None] * 4 and dict(got[5].arguments) == {"value": "2</function"}
    assert dict(got[6].arguments) == {"a": "3", "c": "{x"}
    assert got[7].name == "leave" and dict(got[7].arguments) == {}


def test_names_of_participants_only(spark):
    names = F.create_map(F.lit("Scientist_1"), F.lit("Ada"), F.lit("Judge_1"), F.lit("Bo"))
    df = spark.createDataFrame([("Scientist_1 and Judge_1 met Scientist_12, xScientist_1\nScientist_1",)], "x string")
    assert df.select(text.substitute_names(F.col("x"), names)).first()[0] == "Ada and Judge_1 met Scientist_12, xScientist_1\nAda"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "é"), (1, None)], "k int, t string")
    sinks.write_json_lines(df, str(tmp_path / "o"), ["k"], one_file=True)
    text_of = next((tmp_path / "o").glob("part-*")).read_text()
    assert text_of == '{"k":1,"t":null}\n{"k":2,"t":"é"}\n'
    sinks.write_shards(S.iterations(spark.range(2).withColumnRenamed("id", "round"), 1, 2), str(tmp_path / "s"))
    sinks.write_run_files(spark.createDataFrame([("r1/manifest.json", "{}"), ("r2/state.json", "é")], "path string, text string"), str(tmp_path / "runs"))
    assert (tmp_path / "runs/r2/state.json").read_text() == "é" and (tmp_path / "runs/r1/manifest.json").exists()
    assert (tmp_path / "s" / "epoch=1" / "round=0").is_dir()
    sinks.append(df, str(tmp_path / "a"))
    sinks.append(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    users = spark.createDataFrame([("Scientist_1",)], "name string")
    assert {r.name for r in sinks.missing_users(users, 2, 1).collect()} == {"Scientist_2", "Judge_1"}


def test_streamed_vote_fold(spark, tmp_path):
    rows = [(1, "post", 7, 1, 1), (2, "post", 7, 3, 2), (1, "post", 7, -1, 3), (1, "comment", 7, 1, 4), (1, "post", 7, 1, 5)]
    schema = "voter long, target_type string, target_id long, value int, vote_id long"
    parts = [spark.createDataFrame(rows[k : k + 2], schema) for k in range(0, 5, 2)] + [spark.createDataFrame(rows[:1], schema)]  # the first is sent twice
    out = ST.in_batches(parts, ST.fold_votes, str(tmp_path)).withColumn("change", F.col("value") - F.coalesce("previous_value", F.lit(0)))
    got = {(r.target_type, r.target_id): r.score for r in out.groupBy("target_type", "target_id").agg(F.sum("change").alias("score")).collect()}
    wanted = {(r.target_type, r.target_id): r.score for r in V.scores(V.current_values(spark.createDataFrame(rows, schema))).collect()}
    assert got == wanted == {("post", 7): 4, ("comment", 7): 1} and out.count() == 5


def test_event_windows(spark):
    e = spark.createDataFrame([(1, "a", 1.0, "2024-01-01 00:10:00"), (1, "a", 3.0, "2024-01-01 00:50:00"), (1, "b", 5.0, "2024-01-01 05:00:00")], "user_id int, event_type string, value double, t string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.n_events for r in ST.idle_sessions(e).collect()) == [1, 2]
    assert {(r.event_type, r.n_events, r.mean_value) for r in ST.event_windows(e).collect()} == {("a", 2, 2.0), ("b", 1, 5.0)}
    assert ST.without_repeats(e.select(F.col("event_type").alias("kind"), F.col("user_id").alias("item_id"), "ts")).count() == 2
