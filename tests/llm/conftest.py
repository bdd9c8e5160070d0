import random

import pytest


def nasty_texts() -> list:
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "ΓΑΜΜΑ", "deltaé", "it's", "12", "#", "the", "OF", "zürich.", "ok!", "naïve"]
    texts = [None, "", " ", "\n\n", "a", "one two", "  x\x1cy", "<|endoftext|> inside <|startoftext|>", "shared line of text\nown one here", "Shared Line of TEXT \nother own line", "x" * 5000, "😀 " * 300]
    for _ in range(30):
        texts.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 400))).replace(" the ", "\n", 3))
    texts.append(" ".join(rng.choice(vocab) for _ in range(20_000)))
    texts += texts[12:20]
    base = texts[15].split(" ") if len(texts[15].split(" ")) > 50 else texts[-9].split(" ")[:300]
    for k in range(4):
        near = base.copy()
        near[k * 7 % len(near)] = "changed"
        texts.append(" ".join(near))
    return texts


@pytest.fixture(scope="session")
def nasty(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], f"s{i % 2}", -1, "extra") for i, t in enumerate(nasty_texts())]
    rows += [rows[15], (None, "null id text here\nshared line of text", "en", "s0", 1, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string")


@pytest.fixture(scope="session")
def as_tables(spark, tmp_path_factory):
    """Writes frames as a folder of tables."""

    def write(**frames):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
