"""Documents with nulls, empty and long texts, ties, copies and clashing columns."""

import random
import re

DOC_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, row long, words string"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ßu", "né", "ta"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def texts(seed=5):
    rng = random.Random(seed)
    base = prose(rng, 150)
    words = base.split(" ")
    out = [None, "", " \t\n", "one", "one two three", "Ünï\u00a0cödé 😀 x\x1cy\x0bz", base, base, base.upper()]
    for edits in (1, 2, 5, 30):
        w = list(words)
        for _ in range(edits):
            w[rng.randrange(len(w))] = "edit" + str(rng.random())
        out.append(" ".join(w))
    passage = prose(rng, 40)
    out += [prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(3)]
    out += [prose(rng, 3000), prose(rng, 12) * 2, ("a b c " * 40).strip(), "x" * 9000, passage]
    return out


def documents(spark, rows=None, extra=()):
    rows = [(k, t) for k, t in enumerate(texts())] if rows is None else rows
    full = [(d, t, None, "s" if (d or 0) % 3 else None, len(t or ""), 1, "k", 2, "w") for d, t in [*rows, *extra]]
    return spark.createDataFrame(full, DOC_COLUMNS).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
