import hashlib
import random

import pytest

from lumenframe.llm import chat


def test_any_turns_read_back():
    rng = random.Random(3)
    bits = [*chat.CONTROL, "\\", "\\\\", "<", "[", "/INST]", "s>", " ", "a", "%", "5c;", "]", "\n", ""]
    roles = ["user", "assistant", "system", "tool", "", "a]b", "%5c;", "x\\", "[INST]"]
    for _ in range(5000):
        turns = [(rng.choice(roles), "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(4))]
        assert chat.parse(chat.render(turns)) == turns


def test_only_conflicts_are_escaped():
    assert chat.render_turn("user", r"C:\temp") == r"[INST]C:\temp[/INST]"
    assert chat.render_turn("assistant", "</s>") == r"<s>\</s></s>"


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{t[1]}\n{t[2]}".encode()).hexdigest()))
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        chars = len(chat.render([(r, t) for _, r, t in turns]))
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def test_query(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(12), i, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["é😀", "", None, "</s>[INST]", "a\\", "x\ny"])) for i in range(150)]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "😀"), (3, None, "user", "first"), (3, 5, "user", "tie"), (3, 5, "user", "tie"), (4, 2, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in chat.round_trip(df).collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert chat.round_trip(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_the_reader_needs_no_turn_boundaries():
    rng = random.Random(5)
    bits = [*chat.CONTROL, "\\", "a", "]", "é😀", ""]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "tool"]), "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(1, 6))]
        data, reader, got = chat.render(turns), chat.Reader(), []
        while data:
            # No piece ends within an escape or a mark's start that could mean something else.
            n = rng.randrange(1, 12)
            got += reader.feed(data[:n])
            data = data[n:]
        reader.close()
        assert got == turns


def test_turns_that_run_together_are_an_error():
    one = chat._Conversation(1)
    one.add("<s>a", chat.turn_digest("assistant", "a"))
    with pytest.raises(ValueError):
        one.row()
    two = chat._Conversation(2)
    with pytest.raises(ValueError):
        two.add("<s>a</s>[INST]b[/INST]", chat.turn_digest("assistant", "a"))
        two.row()
