"""Odd tables that every operator must take."""

import random

# Names that operators use inside, or return.
CLASHES = ("fp", "node", "row", "score", "tile", "part", "block", "known", "component_id", "hash", "item", "text_key", "kept", "words", "a", "b", "n", "ids", "stats", "key", "base", "spans", "root", "code", "rank")
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ODD_TEXTS = [None, "", " \t\n", "x", "A a A a", "one two three", "été 中国 😀 ▁", LONG, "!!! ??? 123", "token: '' = =", "\x00 \x0b \x85 nul"]


def odd_docs(spark, texts=None):
    """Null ids, null and odd texts, repeated rows, ties, and columns with clashing names."""
    texts = ODD_TEXTS if texts is None else texts
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [(2, texts[2], "en", "s", 3), (None, "no id here at all", None, None, None), (None, None, None, None, None), (90, "one two three", None, "s", 13), (90, "one two three", None, "s", 13)]
    extra = tuple("z" for _ in CLASHES)
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([r + extra for r in rows], schema)


def no_docs(spark):
    return odd_docs(spark).where("1 = 0")


def prose(n, seed=0, size=(40, 120), vocabulary=400):
    rnd = random.Random(seed)
    names = ["".join(rnd.choice("abcdefghijklmnoprstuv") for _ in range(rnd.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rnd.choice(names) for _ in range(rnd.randint(*size))) for _ in range(n)]


def edited(text, share, seed):
    rnd = random.Random(seed)
    words = text.split()
    for k in rnd.sample(range(len(words)), max(1, int(share * len(words)))):
        words[k] = f"edit{rnd.randint(0, 10**6)}"
    return " ".join(words)
