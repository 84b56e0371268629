import json

from pagemill.operators import conversations as cv
from pagemill.operators import prompts as pr
from pagemill.plans import experiment as ex

MESSAGES = "conv_id long, turn long, role string, content string, reasoning_content string, tool_calls string, tool_call_id string, name string"


def test_messages_keep_order_and_leave_out_what_is_absent(spark):
    df = spark.createDataFrame(
        [(1, 5, "assistant", "b", "why", '[{"id": "t1"}]', None, None), (1, 2, "user", "a \"q\"", None, None, None, None),
         (1, 0, "system", "s", None, None, None, None), (1, 9000, "tool", "r", None, None, "t1", "f")], MESSAGES)
    history = cv.build_conversation(df)
    assert [(r.position, r.content) for r in history.orderBy("position").collect()] == [(0, 'a "q"'), (1, "b")]
    rendered = {r.turn: json.loads(r.message) for r in cv.message_json(df).collect()}
    assert rendered[2] == {"role": "user", "content": 'a "q"'}
    assert rendered[5] == {"role": "assistant", "content": "b", "reasoning_content": "why", "tool_calls": [{"id": "t1"}]}
    assert rendered[9000] == {"role": "tool", "content": "r", "tool_call_id": "t1", "name": "f"}


def test_request_is_system_history_user(spark):
    history = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (2, 0, "user", "x")], "conv_id long, position long, role string, content string")
    ask = spark.createDataFrame([(1, "S", "q2"), (3, "S", "alone")], "conv_id long, system string, user_message string")
    rows = cv.assemble_request(history, ask).orderBy("conv_id", "section", "position").collect()
    assert [(r.conv_id, r.role, r.content) for r in rows] == [
        (1, "system", "S"), (1, "user", "q1"), (1, "assistant", "a1"), (1, "user", "q2"), (3, "system", "S"), (3, "user", "alone")]


def test_parameter_defaults(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, 0, "", False), (3, 50, "low", True)], "i int, max_tokens int, reasoning_effort string, thinking_enabled boolean")
    got = {r.i: (r.max_tokens, r.reasoning_effort, r.thinking) for r in cv.request_params(df).collect()}
    assert got == {1: (16000, "high", "enabled"), 2: (16000, "high", "disabled"), 3: (50, "low", "enabled")}


def test_responses_fill_in_defaults(spark):
    full = {"model": "m", "choices": [{"message": {"content": "hi", "reasoning_content": "r"}, "finish_reason": "length"}],
            "usage": {"prompt_tokens": 100, "completion_tokens": 50, "total_tokens": 150}}
    bare = {"choices": [{"message": {"content": None}}], "usage": {}}
    df = spark.createDataFrame([(1, json.dumps(full), 120.456), (2, json.dumps(bare), 1.0), (3, "not json", 2.0)], "i int, raw string, latency_ms double")
    got = {r.i: tuple(r)[1:] for r in cv.parse_response(df, default_model="d").collect()}
    assert got[1] == ("hi", "r", "m", "length", 100, 50, 150, 120.46, None)
    assert got[2] == ("", None, "d", "stop", 0, 0, 0, 1.0, None)
    assert got[3][-1] == "not a JSON object"


def test_sessions_explode_in_order(spark):
    raw = json.dumps([{"role": "user", "content": "q", "timestamp": "2026-08-10T10:00:00Z"}, {"role": "assistant", "content": "a"}])
    rows = cv.explode_messages(spark.createDataFrame([("s", raw), ("t", "[]"), ("u", "{bad")], "id string, messages string")).collect()
    assert [(r.id, r.error) for r in rows if r.role is None] == [("t", None), ("u", "messages are not a JSON array")]
    rows = [r for r in rows if r.role is not None]
    assert [(r.id, r.position, r.role, r.content, r.timestamp) for r in rows] == [("s", 0, "user", "q", "2026-08-10T10:00:00Z"), ("s", 1, "assistant", "a", None)]


def test_rendering_fills_each_place_once(spark):
    df = spark.createDataFrame(
        [(1, "{a}-{b}", "{b}", "B"), (2, "{{a}} {a}", "x", None), (3, "{a} {c}", "x", "y"), (4, "plain } {", "x", "y"), (5, "", "x", "y"), (6, "$1 {a}", "\\$0", "y")],
        "i int, user_template string, a string, b string")
    got = {r.i: (r.user_message, r.reject_reason) for r in pr.render_prompts(df, {"a": "a", "b": "b"}).collect()}
    assert got == {1: ("{b}-B", None), 2: ("{a} x", None), 3: (None, "missing value"), 4: ("plain } {", None), 5: ("", None), 6: ("$1 \\$0", None)}


def test_registry_and_unknown_names(spark):
    registry = pr.prompt_registry(spark).collect()
    assert len({r.name for r in registry}) == len(pr.PRESETS) and all("{input}" in r.user_template for r in registry)
    grid = pr.render_grid(spark.createDataFrame([(1, "q")], "input_id long, text string"), names=["two_sides", "nobody"]).collect()
    assert [(r.prompt_name, r.user_message) for r in grid] == [("two_sides", "Statement: q")]
    asked = spark.createDataFrame([("nobody",), ("nobody",), ("plain",)], "prompt_name string")
    assert [tuple(r) for r in pr.unknown_names(asked).collect()] == [("nobody", 2)]


def test_experiment_report(spark):
    inputs = spark.createDataFrame([(1, "what?"), (2, "none")], "input_id long, text string")
    def raw(text):
        return json.dumps({"choices": [{"message": {"content": text}}], "usage": {"total_tokens": 7}})
    responses = spark.createDataFrame(
        [(1, "csv_facts", 1, raw('{"k": 1}'), 119.5), (1, "csv_facts", 2, raw("later run"), 1.0), (1, "plain", 1, raw("x" * 600 + "[1]"), 120.5),
         (1, "nobody", 1, raw("?"), 1.0), (1, "two_sides", 1, "{bad", 1.0)],
        "input_id long, prompt_name string, run_no long, raw string, latency_ms double")
    reports = {r.input_id: r for r in ex.run_experiment(inputs, responses, names=["plain", "csv_facts", "two_sides"]).collect()}
    row, lines = reports[1], reports[1].report.split("\n")
    assert (row.answers, row.missing) == (3, 1) and (reports[2].answers, reports[2].missing) == (0, 3)
    assert lines[2] == "**Input**: what?" and lines[4].startswith("| Prompt |")
    assert lines[6:10] == ["| plain #1 | 603 | 120 | 7 | — | ✅ |", "| csv_facts #1 | 8 | 120 | 7 | ✅ | — |",
                           "| csv_facts #2 | 9 | 1 | 7 | — | — |", "| two_sides | no answer | | | | |"]
    assert "x" * 500 + "\n...(truncated)\n```" in row.report and "later run" in row.report
    assert reports[2].report.endswith("## Outputs\n\n")
    summary = {r.prompt_name: r for r in pr.prompt_metrics_summary(ex.experiment_results(inputs, responses)).collect()}
    assert summary["csv_facts"].json_outputs == 1 and summary["csv_facts"].outputs == 2 and summary["plain"].cited_outputs == 1
    assert [tuple(r) for r in ex.unreadable_responses(responses).collect()] == [(1, "two_sides", 1, "not a JSON object")]
