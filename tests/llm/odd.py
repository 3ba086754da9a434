"""Small tables with everything that real ones hold."""

LONG = " ".join(f"w{k * 7919 % 5003}" for k in range(60_000))
PROSE = "the quick brown fox jumps over the lazy dog while many small birds sing in the old green tree near our house today"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, cls int, row string, copies int, at int, length int"


def rows():
    texts = [
        (1, PROSE), (2, PROSE), (2, PROSE), (3, PROSE + " again"), (4, ""), (5, None), (6, " \t\n "), (7, LONG), (8, "Zwölf größere Häuser stehen drüben"),
        (9, "one two three"), (10, "one two three"), (11, "ONE two\nthree"), (None, PROSE), (None, None), (12, "12345 !!! ??"), (13, "日本語 テキスト Σίσυφος"), (14, "password = hunter2hunter2"),
    ]
    return [(i, t, "en" if (i or 0) % 2 else None, None if i == 9 else f"src{(i or 0) % 3}", None, "k", 1, "r", 9, 9, 9) for i, t in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
