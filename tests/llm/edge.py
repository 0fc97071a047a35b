"""Rows that every operator must take: nulls, empty and blank texts, ties, repeated rows, long texts, other columns."""

CLASHES = "shard:int size:string component_id:string _key:string _fp:int _text:string _gone:string _n_runs:int _id:long _row:long _turn:int _times:int id:string row:string root:long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(x.replace(":", " ") for x in CLASHES.split())
#: A doc_id that floating point cannot hold.
LARGE = 2**60 + 1
LONG = "word " * 30_000 + "x" * 5_000
TEXTS = ["", None, "  \t\n ", "one", "a b", "a b c", "a b c d e f g h a b c d e f g h", "Été à la plage\nÉté à la plage", "\x1c\x85\xa0 ½²٣ <|endoftext|> 𝔘𝔫 ‍ é", "don't  stop\r\n\r\nnow   ", LONG, LONG, "same text twice", "same text twice"]


def rows():
    more = [1 if x.split(":")[1] in ("int", "long") else "x" for x in CLASHES.split()]
    out = [(i, t, "en", ["a", None, "b"][i % 3], None if t is None else len(t), *more) for i, t in enumerate(TEXTS)]
    out.append((LARGE, "a large number for a document", "en", "a", 29, *more))
    return out + [out[5], (None, "no id", *[None] * (3 + len(more)))]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
