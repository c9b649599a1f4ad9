import pytest

LONG = ("word%d " * 40_000) % tuple(range(40_000))

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              "_doc string, _text string, _row string, node string, h long, mix_position string")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text[, source]) with columns whose names clash
    with the operators' own."""

    def make(rows):
        full = []
        for r in rows:
            i, text = r[0], r[1]
            source = r[2] if len(r) > 2 else "src0"
            full.append((i, text, "en", source, None if text is None else len(text), "a", "b", "c", "d", 5, "e"))
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty, blank and very long texts, repeated rows."""
    story = " ".join(f"story{i} told{i % 7}" for i in range(60))
    return [(1, story), (1, story), (2, None), (3, ""), (4, " \t\n\x0b "), (None, story), (5, LONG), (6, LONG),
            (7, "one"), (8, story + "\nThe same closing line"), (9, "short\nthe same CLOSING line "), (1, "other text")]
