"""Documents with everything odd in them."""

from __future__ import annotations

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_no string, fp long"
PASSAGE = " ".join(f"word{i}" for i in range(60))


def odd_rows():
    texts = [
        (1, "The cat sat on the mat and the dog ran off to the big red barn"),
        (2, "The cat sat on the mat and the dog ran off to the big red barn"),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "12345 !!!"),
        (7, "a"),
        (8, f"before {PASSAGE} after"),
        (9, f"other start here {PASSAGE} and another end"),
        (9, f"other start here {PASSAGE} and another end"),
        (None, "no id at all but some text"),
        (None, None),
        (10, "long " * 30_000),
        (11, "mail joe.x@site.example.com or +1 (243) 555-5526 from 10.0.0.1 ok"),
        (12, "Licensed under CC BY-NC 4.0. All rights reserved.\nGNU General Public License v3"),
        (13, "é̀ ▁ <s> \x00 日本語 🙂 ﬁ"),
    ]
    return [(i, t, "en" if t else None, None, len(t or ""), "x", 7) for i, t in texts]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
