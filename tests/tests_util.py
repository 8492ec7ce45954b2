"""A plain tokenizer, character by character."""

import unicodedata

from quillspark.functions import html


def plain_tokens(s, folds):
    """A walk over the characters."""
    cjk = lambda c: bool(html._IS_CJK.match(c))
    runs, kind = [], None
    for c in unicodedata.normalize("NFKC", s):
        now = "gap" if c in "\n\r" or unicodedata.category(c)[0] in "ZP" else "cjk" if cjk(c) else "other"
        # A CJK character that counts as punctuation is a gap as well.
        if now != "gap" and now == kind:
            runs[-1] += c
        elif now != "gap":
            runs.append(c)
        kind = now
    out = []
    for r in runs:
        r2 = r.translate(folds)
        out += [*r2, *(r2[i : i + 2] for i in range(len(r2) - 1))] if cjk(r[0]) else [r]
    return out
