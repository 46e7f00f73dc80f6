import json
import random

from siftwell.llm.chat import MAPPINGS, conversations_as_records, escape, fingerprint, format_chat, parse, paths, read_chat, unescape, write

PARTS = ["<", "|", "s>", "/s>", "\\", "[", "INST]", "/INST]", "<SYS>>", "</SYS>>", "\n", "a", "<|turn|>", "<|end|>\n", "é", "n"]


def test_template_is_reversible():
    rng = random.Random(1)
    for _ in range(4000):
        turns = [tuple("".join(rng.choice(PARTS) for _ in range(rng.randrange(9))) for _ in range(2)) for _ in range(rng.randrange(4))]
        turns = [(rng.choice([r, "assistant"]), t) for r, t in turns]
        text, spans = write(turns)
        assert parse(text) == turns
        assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        for _, t in turns:
            assert not any(c in escape(t) for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


RECORDS = {
    '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}': [("user", "q"), ("assistant", "a")],
    '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"id":"7"}': [("user", "q"), ("assistant", "a")],
    '[{"role":"user","content":"q"}]': [("user", "q")],
    '{"instruction":"i","input":"","output":"o"}': [("user", "i"), ("assistant", "o")],
    '{"instruction":"i","input":"x","output":"o","system":"s"}': [("system", "s"), ("user", "i"), ("user", "x"), ("assistant", "o")],
    '{"prompt":"p","completion":"c","meta":{"n":1}}': [("user", "p"), ("assistant", "c")],
    '{"question":"p","answer":{"text":"c"}}': None,
    '{"prompt":"p","response":null}': [("user", "p")],
    '{"messages":[]}': [],
    '{"messages":[{"role":null,"content":null}]}': [("", "")],
    '{"instruction":"i","output":"o","system":"s","history":[["a","b"],["c",""],{"role":"bot","content":"d"}]}': [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "i"), ("assistant", "o")],
    '{"messages":[{"role":"user","content":[{"type":"text","text":"x"},"y"]},{"role":"assistant","content":"z"}]}': [("user", "xy"), ("assistant", "z")],
    "not json": None, "": None, "3": None, "{}": None,
}


def test_layouts(spark):
    df = spark.createDataFrame([(i, r, "old") for i, r in enumerate([*RECORDS, None])], "id bigint, record string, status string")
    rows = {r.record: r for r in format_chat(df).collect()}
    for record, turns in RECORDS.items():
        r = rows[record]
        if turns is None:
            assert r.status in ("unknown", "invalid") and r.formatted is None and r.loss_spans == []
        else:
            assert r.status == "ok" and parse(r.formatted) == turns, record
    assert rows[None].status == "invalid" and rows["not json"].status == "invalid" and rows["{}"].status == "unknown"
    assert format_chat(df.limit(0)).count() == 0


PARTIAL = {
    '{"messages":[{"role":"user","content":"hi"},"lost text"]}': ([("user", "hi")], ["messages[1]"]),
    '{"messages":[{"role":"assistant","content":null,"tool_calls":[{"f":1}]}]}': ([("assistant", "")], ["messages[0].tool_calls"]),
    '{"messages":[{"role":"user","content":["x",1,{"type":"image","url":"u"}]}]}': ([("user", "x")], ["messages[0].content[1]", "messages[0].content[2]"]),
    '{"instruction":"i","output":"o","history":["a"]}': ([("user", "i"), ("assistant", "o")], ["history[0]"]),
    '{"prompt":"p","completion":"c","rejected":"r","history":"x"}': ([("user", "p"), ("assistant", "c")], ["history", "rejected"]),
}


def test_nothing_is_lost_unsaid(spark):
    df = spark.createDataFrame([(r,) for r in PARTIAL], "record string")
    got = {r.record: (parse(r.formatted), sorted(r.left_over)) for r in format_chat(df).where("status = 'partial'").collect()}
    assert got == PARTIAL


def test_fingerprints():
    assert paths({"a": [{"b": 1}, {"c": {"d": 2}}], "e": []}) == {"a[].b", "a[].c.d", "e[]"}
    assert len({fingerprint(set(m.needs)) for m in MAPPINGS}) == len(MAPPINGS)
    assert fingerprint({"a", "b"}) == fingerprint({"b", "a"}) != fingerprint({"a.b"})


def test_conversations(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, "user", "tie"), (None, 0, "user", "y"), (3, 0, "assistant", "long " * 9000), (1, 1, "assistant", "hi")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: json.loads(r.record)["messages"] for r in conversations_as_records(df).collect()}
    assert got[1] == [{"role": "user", "content": ""}, {"role": "assistant", "content": "hi"}, {"role": "assistant", "content": "hi"}]
    assert [m["role"] for m in got[2]] == ["", "user"] and got[None][0]["content"] == "y"
    back = {r.conv_id: r for r in read_chat(format_chat(conversations_as_records(df)), ["conv_id"]).collect()}
    assert back[1].n_turns == 3 and back[1].loss_text == "hihi" and back[1].transcript == "user\n\nassistant\nhi\nassistant\nhi\n" and back[3].loss_text == "long " * 9000


def test_records_that_cannot_be_written(spark):
    half = '{"messages": [{"role": "user", "content": "\\ud800"}]}'
    deep = '{"messages": [{"role": "user", "content": "x"}], "more": ' + '{"a": ' * 900 + "1" + "}" * 901
    lists = "[" * 5000 + "]" * 5000
    rows = [half, deep, lists, '{"\\ud800": 1}', '{"messages": [{"role": "user", "content": "fine"}]}']
    out = format_chat(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, record string"))
    got = {r.id: r.status for r in out.collect()}
    assert got[0] == got[3] == "invalid" and got[1] in ("ok", "invalid") and got[2] in ("unknown", "invalid") and got[4] == "ok"


def test_conversations_in_every_layout_are_read_back(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(60) for t in range(2 if c % 2 else 3)]
    turns = spark.createDataFrame([*rows, (100, 0, None, None)], "conv_id bigint, turn bigint, role string, text string")
    written = format_chat(conversations_as_records(turns, every_layout=True))
    assert written.where("status <> 'ok'").isEmpty() and written.select("layout").distinct().count() == 10
    got = {r.conv_id: r.transcript for r in read_chat(written, ["conv_id"]).collect()}
    want = {}
    for c, _, role, text in rows:
        want[c] = want.get(c, "") + f"{role}\n{text}\n"
    assert got == want | {100: "\n\n"}
