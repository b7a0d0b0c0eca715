"""Small documents with every awkward case: nulls, empty, long, ties, copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, digest string, row string, kept boolean"


def prose(r, n):
    return " ".join("".join(r.choice("aeionrst") for _ in range(r.randint(2, 8))) for _ in range(n))


def rows(n=60, seed=1):
    r = random.Random(seed)
    texts = [prose(r, r.randint(25, 120)) for _ in range(n)]
    out = [(i, t, "en", f"s{i % 5}") for i, t in enumerate(texts)]
    out += [(n, texts[0], "en", "s0"), (n + 1, texts[0], "en", "s1"), (n + 2, texts[1] + " ", "en", None)]
    near = texts[2].split()
    near[10] = "changed"
    long_near = prose(r, 400)
    changed = long_near.split()
    changed[200] = "other"
    out += [(n + 3, long_near, "en", "s2"), (n + 4, " ".join(changed), "en", "s3"), (n + 5, " ".join(near), "en", "s2")]
    out += [(n + 6, None, None, None), (n + 7, "", "en", "s0"), (None, "", "en", "s0"), (None, texts[3], None, "s4")]
    out += [(5, texts[5], "en", "s0"), (5, texts[5], "en", "s0"), (n + 8, "one two", "en", "s1"), (n + 9, "x" * 5000, "en", "s1"), (n + 10, prose(r, 3000), "de", "é")]
    out += [(n + 11, "spam spam spam spam " * 40, "en", "s4"), (n + 12, "a\n\nb\na\n \nLicensed under the MIT License.\n" + texts[6], "en", "s1")]
    return [(*x, len(x[1] or ""), "clash", "clash", "clash", None) for x in out]


def documents(spark, n=60, seed=1):
    return spark.createDataFrame(rows(n, seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
