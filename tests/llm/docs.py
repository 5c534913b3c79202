"""Small tables with everything that may be odd about them."""

import random

WORDS = {
    "en": "the of and to in that was with for his they this have from which one had not were there been said their them would other".split(),
    "de": "der die und nicht sich auch eine einem werden wurde zwischen durch über können müssen größer straße schon immer wieder keine".split(),
    "fr": "le la les des une que pour dans qui était avec sur être même très où déjà leur après depuis élève façon".split(),
}
#: Columns with names that operators use inside.
CLASH = ["score", "rejected", "doc", "tie", "h", "k", "run", "key", "slice", "part", "term", "f0", "class", "component_id", "w", "at", "found", "node", "root", "size", "taken", "s", "p", "n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def prose(rnd, lang, n):
    return " ".join("".join(rnd.sample(WORDS[lang], 1)) + ("" if rnd.random() < 0.7 else rnd.choice(WORDS[lang])) for _ in range(n))


def rows(seed=1, n=60):
    """Prose in three languages, copies, near copies, shared passages, nulls, empty and odd texts, repeated rows."""
    rnd = random.Random(seed)
    passage = prose(rnd, "en", 70)
    texts = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        text = prose(rnd, lang, rnd.choice((3, 40, 120, 300)))
        if i % 10 == 7:
            text = texts[-3][0]
        if i % 10 == 8:
            words = texts[-2][0].split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if i % 10 == 9:
            text += "\n\t" + passage + " " + prose(rnd, lang, 20)
        texts.append((text, lang))
    out = [(i, t, lang if i % 11 else None, f"s{i % 4}" if i % 13 else None, len(t)) for i, (t, lang) in enumerate(texts)]
    odd = [None, "", " \t\n", "x", "12 34 ... !!", "é\u2003ü ﬁ 你好", "A" * 400, passage, "one two three", "word " * 500]
    out += [(n + i, t, "en", "s9", 0) for i, t in enumerate(odd)]
    out += [(None, passage, None, None, None), (None, "null id", "en", "s1", None), (None, None, None, None, None)]
    out += [out[5], out[5], out[9], (3, "another text under an id that exists", "en", "s1", 5)]
    return [r + tuple("c" for _ in CLASH) for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def simple(spark, texts, first=0):
    return frame(spark, [(first + i, t, "en", "s", 0) + tuple("c" for _ in CLASH) for i, t in enumerate(texts)])
