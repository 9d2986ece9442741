"""Small tables with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, tag string, digest string"

AWKWARD = [
    (1, "the cat sat on the mat and the dog sat on the rug", "en", "src1", 49, "x", "y", "t", "d"),
    (2, "the cat sat on the mat and the dog sat on the rug", "en", "src1", 49, "x", "y", "t", "d"),
    (2, "the cat sat on the mat and the dog sat on the rug", "en", "src1", 49, "x", "y", "t", "d"),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "src0", 0, "x", "y", "t", "d"),
    (None, "le chat est là", "fr", "src2", 14, "x", "y", "t", "d"),
    (5, " \n\t ", "de", "", 4, "x", "y", "t", "d"),
    (6, "word " * 30000, "en", "src0", 150000, "x", "y", "t", "d"),
    (7, "x" * 50000, "en", "src0", 50000, "x", "y", "t", "d"),
    (8, "mail a.b@example.org now, call +1 (555) 010-9999 or 10.0.0.255, card 4111 1111 1111 1111", "en", "src3", 90, "x", "y", "t", "d"),
    (9, "日本語 текст é ñ 😀", "es", "src4", 15, "x", "y", "t", "d"),
]


def docs(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, DOCS)
