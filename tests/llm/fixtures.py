"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, copy int, row string, fp long, html string"
LONG = "The quick brown fox jumps over the lazy dog and never looks back at it again. " * 400

TEXTS = [
    None, "", " \n\t ", "a", "ab", "abcd", "Hello, world!", "Hello, world!", "a b c d e f g", "A B C D E F G", LONG, LONG + "x y z",
    "naïve café ½ ² ª  中文 \U0001f600 \x85 é", "don't we'll they're <|endoftext|> ok<|endoftext|>", "  double  spaces \n\n and\r\n lines ", "!!! ??? 123", "THE!! END!!",
]


def documents(spark, texts=TEXTS, more=()):
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, None if t is None else len(t), "k", 1, 2, "r", 3, "h") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *more], DOCS)


def awkward(spark):
    """With a repeated row and one without an id."""
    again = (7, "Hello, world!", "en", "s1", 13, "k", 1, 2, "r", 3, "h")
    return documents(spark, more=[again, (None, "no id here", None, None, 10, "k", 1, 2, "r", 3, "h")])


def empty(spark):
    return spark.createDataFrame([], DOCS)
