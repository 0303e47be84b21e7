import hashlib

import pytest

from tabulon.llm import chat

from .helpers import rows_of

LOG = "conv_id long, seq long, message long, kind string, role string, text string, turn long, formatted string"


def log(spark, events):
    return spark.createDataFrame([(*e, 7, "x") for e in events], LOG).repartition(3)


def messages(spark, events):
    return [(r["conv_id"], r["role"], r["text"]) for r in sorted(chat.reconstruct(log(spark, events)).collect(), key=lambda r: (r["conv_id"] or 0, r["place"]))]


def test_fold(spark):
    events = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", None), (1, 3, 2, "delta", None, "wro"), (1, 4, 2, "delta", None, "ng"),
        (1, 5, 3, "message", "user", "no!"), (1, 6, 2, "regenerate", None, None), (1, 7, 2, "delta", None, "rig"), (1, 8, 2, "delta", None, "ht"), (1, 8, 2, "delta", None, "ht"),
        (1, 9, 4, "message", "user", "thanks"), (1, 10, 1, "edit", None, "hi there"), (1, 11, 1, "delta", None, "!"), (1, 12, 5, "message", "assistant", "bye"), (1, 13, 5, "delete", None, None),
        (2, 1, 9, "delta", None, "late"), (2, 2, 9, "delta", "user", None), (None, 1, 1, "message", None, None),
    ]
    assert messages(spark, events) == [(None, "", ""), (1, "user", "hi there!"), (1, "assistant", "right"), (1, "user", "thanks"), (2, "user", "late")]


def test_regenerations_follow_a_plain_fold(spark):
    import random

    r = random.Random(3)
    events, want = [], []
    for conv in range(12):
        state, n = [], 0
        for seq in range(60):
            what = r.choice(["message", "delta", "edit", "regenerate", "delete"]) if state else "message"
            text = r.choice(["a", "b\n", "\\", None])
            if what == "message":
                n += 1
                state.append([n, r.choice(["user", "assistant"]), text or ""])
                events.append((conv, seq, n, what, state[-1][1], text))
                continue
            at = r.randrange(len(state))
            events.append((conv, seq, state[at][0], what, None, text))
            if what == "delta":
                state[at][2] += text or ""
            elif what == "edit":
                state[at][2] = text or ""
            elif what == "regenerate":
                state[at][2] = text or ""
                del state[at + 1 :]
            else:
                del state[at]
        want += [(conv, role, text) for _, role, text in state]
    assert messages(spark, events) == want


TEXTS = [None, "", "<|end|>\n", "<|start|>user<|text|>x<|end|>\n", "\\", "\\\\<|", "<\\|end|>", "<", "|end|>", "a\\", "<<||", "$1 \\1 \\E \\Q", "日本 é\u0301 😀<|text|>", "\n \t", "word " * 60_000]


def rendered(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, message string").repartition(3)
    return chat.render(chat.reconstruct(chat.log_of(df, delta=5)))


def test_round_trip(spark):
    roles = ["assistant", None, "user", "<|text|>", "\\"]
    rows = [(c, t, roles[(c + t) % 5], TEXTS[(3 * c + t) % len(TEXTS)]) for c in range(15) for t in range(c % 6 + 1)] + [(40, 0, "assistant", "same")] * 3 + [(None, None, None, None), (None, None, "assistant", "null")]
    found = {r["conv_id"]: r for r in rows_of(chat.read_back(rendered(spark, rows)))}
    raw = {r["conv_id"]: r for r in rows_of(rendered(spark, rows))}
    digests = {r["conv_id"]: r for r in rows_of(chat.digest(rendered(spark, rows)))}
    assert set(found) == {r[0] for r in rows}
    for conv in found:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert [(t["role"], t["text"]) for t in found[conv]["turns"]] == [x[1:] for x in own]
        assert found[conv]["learned"] == [x[2] for x in own if x[1] == "assistant"]
        text, escape = raw[conv]["formatted"], lambda x: x.replace("\\", "\\\\").replace("<|", "<\\|")
        assert text == "".join(f"<|start|>{escape(r)}<|text|>{escape(x)}<|end|>\n" for _, r, x in own)
        assert [text[s["start"] : s["stop"]] for s in raw[conv]["spans"]] == [escape(x) for *_, x in own]
        assert all(text[s["begin"] :].startswith("<|start|>") for s in raw[conv]["spans"])
        loss = "".join(x for _, r, x in own if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert digests[conv] == {"conv_id": conv, "n_turns": len(own), "turns_sha256": sha("".join(f"{r}\n{x}\n" for _, r, x in own)), "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": len(text)}


def test_empty(spark):
    assert chat.digest(rendered(spark, [])).collect() == []


def test_templates(spark):
    other = chat.Template(lead="[/", start="[/turn]", middle="[/says]", end="[/over]", trained=("user", "assistant"))
    df = spark.createDataFrame([(1, 1, "user", "a [/over] \\[/ b"), (1, 2, "assistant", "[")], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.render(chat.reconstruct(chat.log_of(df)), other), other).first()
    assert [t["text"] for t in r["turns"]] == r["learned"] == ["a [/over] \\[/ b", "["]
    with pytest.raises(ValueError):
        chat.Template(lead="##", start="##a", middle="##b", end="##c")
