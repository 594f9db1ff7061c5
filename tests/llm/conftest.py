import pytest
from pyspark.sql import Row

#: Nulls, empty and long texts, ties, repeats; columns named as the operators name theirs.
TEXTS = [
    (1, "the cat sat on the mat and the dog ran off to the old red barn"), (2, "the cat sat on the mat and the dog ran off to the old red barn"), (3, "The CAT sat on the mat and the dog ran off to the old red barn today"),
    (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "One  two"), (9, "12345 67890 !!!"), (10, "x" * 50_000), (11, "word " * 9_000), (12, "mail a.b@c.org and 192.168.0.1, call +1 (555) 123-4567 now, card 4111 1111 1111 1111 é"),
    (12, "mail a.b@c.org and 192.168.0.1, call +1 (555) 123-4567 now, card 4111 1111 1111 1111 é"), (None, "nobody's text with no id at all here"), (13, "日本語 のテキスト ñandú"), (14, "  a  b \n c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [Row(doc_id=i, text=t, lang="en" if (i or 0) % 3 else None, source=None if i == 7 else f"s{(i or 0) % 3}", n_chars=len(t or ""), size=1, key="k", slice=2, copies=3, score=0.5, media="m", component_id=9, spans="z") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, key string, slice int, copies int, score double, media string, component_id int, spans string")
