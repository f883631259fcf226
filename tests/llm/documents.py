"""Small tables of awkward rows, and document texts of the test data."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, key string, node long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(n: int, salt: int) -> str:
    out, x = [], salt * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 40))
    return " ".join(out)


def rows(texts):
    """Document rows, with columns whose names the operators use inside."""
    return [(i, t, "en", "s", None if t is None else len(t), 1, "k", 5) for i, t in texts]


def awkward(spark):
    """Nulls, empty and blank texts, ties and repeated rows, a very long text."""
    long_text = prose(40_000, 3)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "One."), (5, "One."), (5, "One."), (None, "Null id here."), (6, long_text), (7, prose(300, 5)), (8, prose(300, 5) + " end"), (9, "été naïve 你好 <|endoftext|>  two spaces\n\nЖ"), (10, "x" * 5000)]
    return spark.createDataFrame(rows(texts), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
