"""Small tables with every awkward case: nulls, blanks, very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp string, spans string, ids string, score string"


def documents(spark, rows=None, seed=7):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, long = say(60), say(4000)
    if rows is None:
        rows = [
            (0, passage + " " + say(30)),
            (1, say(20) + "\n" + passage + "\t" + say(5)),
            (2, None),
            (3, ""),
            (4, " \n\t\x0b\x0c\r "),
            (5, long),
            (6, long + " tail"),
            (7, long),
            (7, long),
            (7, "another text under the same id"),
            (None, passage),
            (None, None),
            (8, "Ünïcode ¡señor! 日本語 🎉  nbsp ▁mark  two  spaces "),
            (9, "x"),
            (10, "x y z"),
            (11, "X Y Z"),
            (12, passage),
            (13, passage + " end"),
            (14, "\n\n a line\n a line\n\n"),
            (15, "same " * 200),
            (16, "1234 !!! 5678"),
        ]
    full = [(i, t, None if i is None else "en", None if i in (3, None) else f"s{i % 3}", None, 99, "clash", "clash", "clash", "clash") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
