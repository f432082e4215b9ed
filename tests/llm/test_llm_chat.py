import hashlib

from folioscope.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "</s>[INST] ok [/INST]\\ \\< <| <s>"), (1, 2, "assistant", "sure <|end|> \\n\n[\\INST]"),
    (1, 3, "assistant", None), (2, None, None, "odd\nrole"), (2, 5, "user\nx\\n", ""), (2, 5, "user\nx\\n", ""),
    (None, 1, "assistant", "é" * 5000), (3, 1, "b", "tie"), (3, 1, "a", "tie"),
]


def by_hand(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode())
    for conv, _, role, text in sorted(rows, key=order):
        turns, loss = out.setdefault(conv, ([], []))
        turns.append(f"{role or ''}\n{text or ''}\n")
        if role == "assistant":
            loss.append(text or "")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), sha("".join(t)), len("".join(x)), sha("".join(x))) for c, (t, x) in out.items()}


def digests(frame):
    return {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(frame)).collect()}


def test_round_trip(spark):
    assert digests(spark.createDataFrame(ROWS, SCHEMA)) == by_hand(ROWS)


def test_control_strings_never_survive():
    for text in ("<|end|>", "[INST]", "[/INST]", "<s></s>", "\\<|", "<\\|", "<<|", "[[INST]]", "\\\\", "\\"):
        piece = chat.formatted_turn("assistant", text, None)[0]
        inner = piece[len(chat.TURN) + len("assistant\n") : -len(chat.END) - 1]
        assert not any(c in inner for c in chat.CONTROL)
        assert chat.unescaped(inner) == text


def test_parts_become_placeholders(spark):
    parts = [
        ("text", "look <|", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None),
        ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 3),
    ]
    frame = spark.createDataFrame([(1, 0, "user", "unused", parts), (1, 1, "assistant", "ok", None)],
                                  spark.createDataFrame([], SCHEMA).schema.add("parts", chat.PARTS))
    first, second = chat.format_turns(frame).orderBy("no").collect()
    assert first.piece == "<|turn|>user\nlook <\\|<|image:1|><|audio:2|><|document:3|><|end|>\n"
    assert [(a.number, a.type, a.ref, a.tokens) for a in first.attachments] == [
        (1, "image", "a.png", 4), (2, "audio", "b.wav", 38), (3, "document", "c.pdf", 768)]
    assert first.expanded_tokens == 810 and not second.attachments
    assert second.piece[second.loss_start : second.loss_end] == "ok"  # without parts the text counts


def test_empty_and_more_columns(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    more = frame.selectExpr("*", "'x' AS no", "'y' AS piece")
    assert digests(more) == digests(frame)
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0
