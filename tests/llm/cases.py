"""Small tables with the awkward rows every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def documents(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "re", "so", "ti") for b in ("n", "rd", "ss", "tra", "vel", "x")]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(12)]
    rows = [(i, t, "src0" if i % 3 else f"src{i}") for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split(" ")
        w[60] = "changed"
        rows.append((100 + i, " ".join(w), "src0"))
        rows.append((200 + i, t.upper().replace(" ", "\n"), None))
        rows.append((300 + i, " ".join(w[:60] + [rng.choice(words) for _ in range(60)]), "src1"))
    rows += [(900, None, "a"), (901, "", None), (902, " \n\t", "a"), (903, "one", "a"), (904, "one", "a"), (904, "one", "a"),
             (None, "only words of a document without id", "a"), (905, LONG, "b"), (906, LONG + " end", "b"), (907, "é " * 30 + "ſecret \U0001F600", None)]
    # Columns whose names clash with those the operators use inside and return.
    return spark.createDataFrame([(a, b, c, 1, "x", 7, 0.5, 3, b) for a, b, c in rows],
                                 "doc_id long, text string, source string, row int, class_id string, component_id int, score double, n_chars long, key string")


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
