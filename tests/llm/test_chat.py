"""Folding against a plain replay, and exact round trips of the template."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from winledger.llm import chat

TEXT = st.lists(st.sampled_from(["<s>", "</s>", "<\\s>", "<\\/s>", "[INST]", "[\\\\/INST]", "<<SYS>>", "<<\\/SYS>>", "\\",
                                 "<", "[", "/", "\n", "s>", "INST]", "é", "a"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_round_trip(role, text):
    made = chat.segment(role, text)
    assert chat.parsed(made) == (role, text)
    inner = made[len(chat.OPEN):-chat._TAIL]
    assert not any(c in inner for c in chat.CONTROLS)


def replay(events):
    """Final (role, text) of one conversation's events."""
    messages = []
    for _, kind, m, role, text in sorted(events, key=lambda e: (e[0], e[1], e[4] or "")):
        at = next((i for i, x in enumerate(messages) if x["m"] == m), None)
        if at is None:
            messages.append({"m": m, "role": None, "text": "", "gone": False})
            at = len(messages) - 1
        x = messages[at]
        x["role"] = x["role"] if x["role"] is not None else role
        x["gone"] = kind == "delete"
        if kind in ("edit", "regenerate"):
            x["text"] = text or ""
        else:
            x["text"] += text or ""
        if kind == "regenerate":
            for later in messages[at + 1:]:
                later["cut"] = True
    return [(x["role"] or "", x["text"]) for x in messages if not x["gone"] and not x.get("cut")]


def test_fold(spark):
    rng = random.Random(4)
    log = []
    for conv in [*range(25), None]:
        seq = 0
        for _ in range(rng.randrange(1, 30)):
            seq += 1
            log.append((conv, seq, rng.choice(["message", "delta", "delta", "edit", "regenerate", "delete"]),
                        rng.randrange(5), rng.choice(["user", "assistant", None]), rng.choice(["x", "<s>", None, "yé "])))
    rng.shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    want = {}
    for conv in {e[0] for e in log}:
        messages = replay([e[1:] for e in log if e[0] == conv])
        if messages:
            learned = "".join(t for r, t in messages if r == "assistant")
            want[conv] = (len(messages), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in messages).encode()).hexdigest(),
                          len(learned), hashlib.sha256(learned.encode()).hexdigest(),
                          sum(len(chat.segment(r, t)) for r, t in messages))
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.rendered(chat.fold(events))).collect()}
    assert got == want


def test_corners(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x" * 200_000), (2, 5, "assistant", "")],
        "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS nth")
    got = {r.conv_id: r.n_turns for r in chat.read_back(chat.rendered(chat.fold(chat.as_events(turns)))).collect()}
    assert got == {1: 2, None: 1, 2: 1}
    assert chat.rendered(chat.fold(chat.as_events(turns.limit(0)))).count() == 0
