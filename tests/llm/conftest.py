import pytest

#: Columns whose names clash with those the operators make or use inside.
CLASHING = "score string, keep_id string, kept string, shard string, epoch string, key string, id string"


@pytest.fixture(scope="session")
def small(spark):
    """Documents with nulls, empty and blank texts, copies, near copies, repeated rows and clashing columns."""
    base = " ".join(f"word{i % 57}x{i}" for i in range(300))
    near = base.replace("word3x3 ", "other ", 1)
    long = " ".join(f"l{i}" for i in range(20_000))
    texts = {
        1: base, 2: near, 3: base, 4: None, 5: "", 6: " \t\n", 7: "a b c", 8: "A b C", 9: "a b c d", 10: "Straße über Äpfel", 11: "x", 12: long, 13: long + " end", 14: " two words",
        15: base[:900] + " and then something else altogether follows here", 16: "der " * 200, 17: "hello  world \n\n next   line", 18: base, 19: "emoji \U0001f600 text sep",
    }
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t or "")) for i, t in texts.items()]
    rows += [rows[0], rows[6]]  # repeated rows
    rows += [(None, "no id here", "de", "src1", 10), (None, base, "fr", None, 10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return frame.withColumns({c.split()[0]: F.lit("mine") for c in CLASHING.split(", ")})


@pytest.fixture(scope="session")
def nothing(small):
    return small.limit(0)
