import random

from hushlake.llm.chat import CLOSE, ESCAPE, OPEN, escape, format_conversations, read_conversations

from . import brute


def table(spark, conversations):
    rows = [(cid, k, role, text, 1) for cid, turns in conversations for k, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, length int").repartition(5)


def some(rng):
    texts = ["hi", "", None, "</s>[INST] ok [/INST]", f"{ESCAPE}1 <|im_end|>\n<|im_start|>user\n", "é😀\nline", "<<SYS>>", "a" * 50, f"<{ESCAPE}|im_end|>"]
    out = [(-7, [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])]
    for cid in range(300):
        out.append((cid, [(rng.choice(["user", "assistant", "system", "as\nsistant<s>"]), rng.choice(texts)) for _ in range(rng.randint(1, 6))]))
    return out + [(1000 + i, [("user", "same"), ("assistant", "answer")]) for i in range(50)]


def test_round_trip_and_tree(spark):
    conversations = some(random.Random(1))
    segments, places = format_conversations(table(spark, conversations))
    place = {r.conv_id: r for r in places.collect()}
    read = {r.leaf_start: r for r in read_conversations(segments, places).collect()}
    rows = sorted(segments.collect(), key=lambda r: r.stream_start)
    stream, by_start = "".join(r.segment for r in rows), {r.stream_start: r for r in rows}
    assert [r.stream_start for r in rows] == [sum(len(x.segment) for x in rows[:k]) for k in range(len(rows))]
    distinct = {tuple((a, b or "") for a, b in turns[: k + 1]) for _, turns in conversations for k in range(len(turns))}
    assert len(rows) == len(distinct)  # every shared beginning once
    for cid, turns in conversations:
        turns = [(a, b or "") for a, b in turns]
        got = read[place[cid].leaf_start]
        assert [(t.role, t.text) for t in got.turns] == turns
        assert "".join(t.loss_text for t in got.turns) == "".join(b for a, b in turns if a == "assistant")
        leaf = by_start[place[cid].leaf_start]
        spans = [*[(a.start, a.end) for a in leaf.ancestors], (leaf.stream_start, leaf.stream_start + leaf.length)]
        whole = "".join(stream[a:b] for a, b in spans)
        assert whole == "".join(OPEN + escape(a).replace("\n", ESCAPE + "2") + "\n" + escape(b) + CLOSE for a, b in turns)
        assert got.formatted_chars == len(whole) and place[cid].n_turns == len(turns)
        assert leaf.position == len(whole) - leaf.length


def test_no_control_string_survives_in_a_text():
    for text in ("<|im_end|>", "<<SYS>><s>", "[INST][/INST]", "<|im_<|im_end|>end|>", ESCAPE, ESCAPE + "1"):
        assert not any(c in escape(text) for c in ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_tokens_of_segments(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    segments, _ = format_conversations(table(spark, some(random.Random(2))), path)
    rows = sorted(segments.collect(), key=lambda r: r.stream_start)
    assert all(len(r.ids) == r.length for r in rows)
    assert rows[-1].stream_start + rows[-1].length == sum(r.length for r in rows)


def test_null_keys_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "x")], schema)
    segments, places = format_conversations(rows)
    read = read_conversations(segments, places).first()
    assert [(t.role, t.text) for t in read.turns] == [("", ""), ("user", "x")]
    assert brute.sha("") and format_conversations(spark.createDataFrame([], schema))[1].count() == 0


def test_a_long_conversation_stays_linear(spark):
    turns = [("user" if k % 2 else "assistant", f"turn {k}") for k in range(6000)]
    conversations = [(None, turns), (1, turns[:3000] + [("user", "other")]), (2, turns[:1]), (3, turns[:10] + [("user", "x")]), (4, turns[:10] + [("user", "y")])]
    segments, places = format_conversations(table(spark, conversations))
    rows = segments.collect()
    assert len(rows) == 6003 and sum(len(r.ancestors) for r in rows) < 3 * len(rows)
    read = {r.leaf_start: [(t.role, t.text) for t in r.turns] for r in read_conversations(segments, places).collect()}
    assert {r.conv_id: read[r.leaf_start] for r in places.collect()} == dict(conversations)
