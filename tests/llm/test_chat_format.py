import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import chat_format as c


@settings(deadline=None)
@given(st.lists(st.text(alphabet="<|\\>turndsay é\n", max_size=20), max_size=6))
def test_escape_is_reversible_and_assembly_parses(texts):
    out, at, _ = c.assemble(c.escape(pa.array(["<|r"] * len(texts), pa.string())), c.escape(pa.array(texts, pa.string())))
    whole = out.tobytes().decode()
    assert whole.count(c.TURN) == len(texts)
    assert c.parse(whole) == [("<|r", t) for t in texts]
    assert at[-1] == len(out)


def brute(rows):
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -9, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for _, role, t in turns if role == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return want


def test_against_brute_force_with_a_hot_conversation(spark):
    rows = [(k % 7, k, ["user", "assistant", "system", None][k % 4], f"t{k} <|end|> é \\") for k in range(60)] + [(100, k, "assistant" if k % 2 else "user", f"hot {k}") for k in range(3000)]
    rows += [(8, 0, "user", None), (8, 0, "user", None), (9, 1, "assistant", ""), (None, 0, "assistant", "x"), (10, None, "user", c.HOSTILE)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part_a string")
    got = {r[0]: tuple(r[1:5]) for r in c.read_back(c.materialize(c.format_chats(df), "t")).collect()}
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.read_back(c.format_chats(df)).count() == 0
