"""Small tables with every awkward case, and brute-force versions."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, n_bytes long, bucket long, t string"


def table(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with extra columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 0.5, "x", 7, 3, "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng: random.Random, n: int, letters="abcdefghij") -> str:
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def awkward(seed: int = 1):
    """Nulls, empty and long texts, repeated rows and ids, non-ASCII, near copies, shared passages."""
    rng = random.Random(seed)
    passage, other = words(rng, 90), words(rng, 75)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (None, "null id " + words(rng, 30)), (4, "one"), (5, "one two"), (5, "one two"), (5, "one two")]
    for i in range(10, 40):
        body = words(rng, rng.randint(5, 200))
        if i % 3 == 0:
            body = words(rng, 10) + " " + passage + " " + body
        if i % 5 == 0:
            body += " " + other[rng.randint(0, 20) :]
        rows.append((i, body))
    rows += [(41, rows[12][1]), (42, rows[12][1] + " tail"), (12, words(rng, 60)), (43, "é à ü 漢字 " * 80), (44, "abc " * 900), (45, words(rng, 6000)), (46, "x" * 3000), (47, "Don't  STOP\n\nİstanbul ΣΑΣ <|endoftext|> a<|endoftext|>b <|startoftext|>")]
    long_ = words(rng, 150)
    rows += [(48, long_ + " mid " + long_), (None, None), (2**62, passage)]
    return rows
