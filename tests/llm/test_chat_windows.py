import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldmark.llm import chat_windows as C
from helpers import prose

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|nl|>"]
SCHEMA = "conv_id long, turn long, role string, text string, window long, mark string"


def rows():
    tricky = ["</s>[INST] ok [/INST]", "<\\/s> and <\\\\s>", "<<<SYS>>", "a</", "", None, "é\n\n<s>", "[<s>]\\", "<|nl|><\\|nl|>"]
    out = [(1, k, "system" if k == 0 else ("user", "assistant")[k % 2], t) for k, t in enumerate(tricky)]
    out += [(2, k, ("user", "assistant")[k % 2], prose(30 + k * 17 % 200, k)) for k in range(40)]
    out += [(3, 0, "system", "only a system turn"), (4, 0, "system", prose(1500, 3)), (4, 1, "user", "x"), (4, 2, "assistant", "y")]
    out += [(5, k, ("user", "assistant")[k % 2], prose(n, n)) for k, n in enumerate((10, 1500, 5, 900, 20, 20))]
    out += [(6, 0, None, "a"), (6, 0, None, "a"), (6, None, "tool\nx<s>", "b"), (None, 1, "user", "q"), (None, 2, "assistant", "r")]
    return out


def turns_of(conv):
    own = [(t, r or "", x or "") for c, t, r, x in rows() if c == conv]
    return sorted(own, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))


def frame(spark):
    return spark.createDataFrame([(*r, 9, "z") for r in rows()], SCHEMA)


def test_round_trip_and_loss(spark):
    windows = C.format_windows(frame(spark)).cache()
    got = {r.conv_id: r for r in C.digests(windows).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    for conv, r in got.items():
        own = turns_of(conv)
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(w.formatted) for w in windows.collect() if w.conv_id == conv)


def test_windows(spark):
    seen = {}
    for w in C.format_windows(frame(spark)).orderBy("conv_id", "window").collect():
        parts = w.formatted.split(C.CLOSE)
        assert parts[-1] == "" and all(p.startswith(C.OPEN) for p in parts[:-1])
        assert not any(c in p[len(C.OPEN):].split("\n", 1)[1] for p in parts[:-1] for c in CONTROLS)
        own = turns_of(w.conv_id)
        system = own[0][1] == "system"
        assert not system or parts[0].startswith("<s>system\n")  # every window keeps the system turn
        tokens = [len(re.findall(C.TOKEN, x)) + C.MARKS for _, _, x in own]
        start = seen.get(w.conv_id, 0)
        new = len(parts) - 1 - w.context_turns
        seen[w.conv_id] = start + new
        mine = [k for k in range(start, start + new) if not (system and k == 0)]
        size = sum(tokens[k] for k in mine)
        room = C.BUDGET - (tokens[0] if system else 0)
        assert size <= max(room, C.BUDGET // 4) or len(mine) == 1
        past = w.context_turns - (system and start > 0)
        repeated = list(range(start - past, start))
        assert sum(tokens[k] for k in repeated) <= min(C.HISTORY, max(0, room - size))
        assert w.n_tokens <= C.BUDGET or len(mine) <= 1 or room < C.BUDGET // 4
    assert all(n == len(turns_of(c)) for c, n in seen.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(CONTROLS + ["\\", "<", "[", "/", "s>", "INST]", ">", "x", "\n"]), max_size=12).map("".join))
def test_escape_is_reversible_by_the_same_rule(text):
    pattern = r"([<\[])(\\*)" + C._CONTROL
    escaped = re.sub(pattern, r"\1\\\2\3", text)
    assert not any(c in escaped for c in CONTROLS)
    assert re.sub(r"([<\[])\\(\\*)" + C._CONTROL, r"\1\2\3", escaped) == text


def test_escape_in_spark(spark):
    texts = [a + b + c for a in CONTROLS + ["\\", "<"] for b in ["", "\\", "<"] for c in CONTROLS]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", C.escape(F.col("t")))
    for r in df.withColumn("u", C.unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in CONTROLS)


def test_empty_table(spark):
    assert C.digests(C.format_windows(frame(spark).limit(0))).count() == 0
