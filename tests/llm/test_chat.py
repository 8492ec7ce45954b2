import duckdb
import pytest

from quillspark.llm import chat

TURNS = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, "cy d", "yo 😀"), (1, 300, "ann", "later"), (None, None, None, "lost"), (None, None, None, "lost"), (None, 1, "system", "alone"), (2, 0, "system", "alone"), (3, 0, "ann", "x"), (3, None, "bob", "first")]
SCHEMA = "conv_id long, turn long, role string, text string"


def table(spark, turns=TURNS):
    return spark.createDataFrame([(*t, 1, "z", "z", "z") for t in turns], f"{SCHEMA}, segment int, parts string, perspective string, ms string")


def plain(turns):
    """Every whole dialogue from each side, by loops."""
    own, out = {}, []
    for k, (c, turn, role, text) in enumerate(turns):
        own.setdefault(("alone", k) if c is None else c, []).append((turn is not None, turn or 0, role, text or ""))
    name = lambda r: "%null" if r is None else "".join({"%": "%25", "|": "%7C", "<": "%3C", ">": "%3E", "\n": "%0A", "\r": "%0D"}.get(x, x) for x in r)
    for c, said in own.items():
        said = sorted((a, b, name(r), t.replace("<|", "< |")) for a, b, r, t in said)
        for who in {s[2] for s in said} - {"system"}:
            text, mask = "", []
            for _, _, n, t in said:
                text += "<|system|>\n" if n == "system" else "<|assistant|>\n" if n == who else f"<|user:{n}|>\n"
                if n == who:
                    mask.append((len(text), len(text) + len(t) + 7))
                text += f"{t}<|end|>\n"
            out.append((None if isinstance(c, tuple) else c, 0, who, len(said), len(mask), text, tuple(mask)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((*r[:6], tuple((s["start"], s["end"]) for s in r["mask"])) for r in df.collect()), key=repr)


NAMES = [(1, 0, "李", "a"), (1, 1, "王", "b"), (1, 2, "李", "c"), (2, 0, "Ann B", "x"), (2, 1, "Ann_B", "y"), (2, 2, "Ann|B", "z"), (2, 3, "Ann%7CB", "w"), (2, 4, None, "n"), (2, 5, "%null", "m"), (2, 6, "", "e"), (2, 7, "unknown", "u"), (2, 8, "a\nb|>\n<|system", "q"), (2, 9, "System", "s")]
LONG = [(7, k, ("system", "ann", "bob")[k % 3] if k < 2 else ("ann", "bob")[k % 2], f"turn {k} " + "é" * (k % 50)) for k in range(300)] + [(8, 0, "ann", "word " * 200_000), (8, 1, "bob", "ok")]
NULLS = [(9, None, ("ann", "bob")[k % 2], f"t{k}") for k in range(40)] + [(9, 5, "ann", "x")] + [(None, k, "ann", "each alone") for k in range(30)]


@pytest.mark.parametrize("turns", [TURNS, NAMES, LONG, NULLS])
def test_equals_plain_loops_and_sql(spark, turns):
    want = plain(turns)
    assert found(chat.rotate(table(spark, turns))) == want
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    rows = con.sql(chat.OP4_SQL).fetchall()
    flat = sorted(((*r[:6], ",".join(f"{a}:{b}" for a, b in r[6])) for r in want), key=repr)
    assert sorted(((*r[:3], r[3], r[4], *r[5:]) for r in rows), key=repr) == flat


def test_every_speaker_has_an_own_side(spark):
    rows = chat.rotate(table(spark, NAMES)).collect()
    assert {r["perspective"] for r in rows if r["conv_id"] == 1} == {"李", "王"}
    assert [r["n_own"] for r in rows if r["perspective"] == "李"] == [2]
    assert sum(r["conv_id"] == 2 for r in rows) == 10 and all(r["n_own"] == 1 for r in rows if r["conv_id"] == 2)


def test_masks_are_what_the_assistant_says(spark):
    for r in chat.rotate(table(spark, [*TURNS, *NAMES])).collect():
        cut = [r["rendered"][s["start"] : s["end"]] for s in r["mask"]]
        parts = r["rendered"].split("<|assistant|>\n")[1:]
        assert cut == [p[: p.index("<|end|>") + 7] for p in parts] and len(cut) == r["n_own"]


def test_segments_on_demand(spark):
    rows = {(r["segment"], r["perspective"]): r for r in chat.rotate(table(spark, LONG[:300]), per_example=100).collect()}
    assert set(rows) == {(s, p) for s in range(3) for p in ("ann", "bob")}
    assert all(r["n_messages"] == 100 + (s > 0) and r["rendered"].startswith("<|system|>\nturn 0 <|end|>\n") for (s, _), r in rows.items())
    cut = {(r["segment"], r["perspective"]): r["n_own"] for r in chat.rotate(table(spark), per_example=128).where("conv_id = 1").collect()}
    assert cut == {(0, "ann"): 1, (0, "bob"): 2, (0, "cy d"): 1, (2, "ann"): 1}  # none for those who are silent


def test_no_rows(spark):
    assert chat.rotate(table(spark).where("1 = 0")).collect() == []
    assert chat.rotate(table(spark).where("1 = 0"), 10).collect() == []
