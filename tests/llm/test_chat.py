import random

from pyspark.sql import functions as F

from pricemesh.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def formatted(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r.conv_id: r for r in chat.format_chats(frame).collect()}


def test_round_trip_with_control_strings(spark):
    rng = random.Random(1)
    pieces = [*chat.CONTROLS, "\\", "\\\\", "<", "|", "<|", "[", "é", "日本", "\n", "", " ", "end|>", "text", "\x00"]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(pieces, k=rng.randrange(12)))) for c in range(40) for t in range(rng.randrange(1, 9))]
    got = formatted(spark, rows)
    for conv, r in got.items():
        turns = [(x[2], x[3]) for x in sorted(rows) if x[0] == conv]
        raw = r.formatted.encode()
        assert chat.parse(raw) == turns
        assert [chat.unescape(raw[x.start : x.stop]).decode() for x in r.loss] == [t for role, t in turns if role == "assistant"]
        inner = raw.replace(chat.TURN, b"").replace(chat.BODY, b"").replace(chat.END, b"")
        assert not any(c.encode() in chat.escape(t.encode()) for _, t in turns for c in chat.CONTROLS) and b"</s>" not in inner


def test_nulls_ties_long_texts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_BYTES", 100)
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "assistant", "x" * 300_000), (1, 0, "assistant", "again"), (2, 0, "user", ""), (None, 1, "user", "b")]
    got = formatted(spark, rows)
    assert chat.parse(got[1].formatted.encode()) == [("", ""), ("assistant", "again"), ("assistant", "x" * 300_000)]
    assert chat.parse(got[None].formatted.encode()) == [("user", "a"), ("user", "b")] and got[2].loss == []


def test_repeated_rows_empty_table_extra_columns(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a")] * 3, SCHEMA).withColumns({"loss": F.lit(1), "formatted": F.lit(2)})
    assert [len(chat.parse(r.formatted.encode())) for r in chat.format_chats(frame).collect()] == [3]
    assert chat.format_chats(frame.limit(0)).count() == 0
    row = chat.digests(chat.format_chats(frame)).first()
    assert (row.n_turns, row.loss_chars, row.formatted_chars) == (3, 0, len("<|turn|>user<|body|>a<|end|>") * 3)


def test_assemble_lays_segments_end_to_end():
    segments = [b"ab", b"", b"c", b"ab", b"xyz"]
    assert chat.assemble(segments).tobytes() == b"".join(segments) and chat.assemble([]).tobytes() == b""
