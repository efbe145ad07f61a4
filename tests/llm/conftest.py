import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) or (doc_id, text, source) rows, dealt over a few partitions."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)

    return make


ODD_TEXTS = [
    None, "", "   \n\t ", "Hello  World's 123 café ☃ <|endoftext|> x<|startoftext|>Foo", "ΣΑΣ İstanbul J̌ ½²ª º ÷× don't we'll '!s 'sx",
    "日本語 안녕하세요 مرحبا", "\x1c\x1d\x85 a\xa0b c​d", "a" * 3000, "one two three\n" * 2000, "same text", "same text",
]
