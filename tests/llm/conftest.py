import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

ODD = [None, "", " ", "\n \n\t", "one", "a b c d", "A b C d", "x\n\nx\n x \n", "İstanbul ΑΣ 'll don't we're <|endoftext|> ﬁ é", "▁ a▁▁b", "\x00\x1f", "   ",
       "long" * 700, "aaaa " * 300, "中文 字符 没有 空格" * 40]


def words(draw: random.Random, n: int) -> list[str]:
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars) with copies, near copies, shared lines and passages, secrets, and odd cases."""
    draw = random.Random(5)
    texts = []
    for i in range(40):
        w = words(draw, draw.choice([60, 90, 150, 400]))
        texts.append("\n".join(" ".join(w[k:k + 15]) for k in range(0, len(w), 15)))
    for i in range(12):  # near copies: some words changed, at different similarities
        w = texts[i].split(" ")
        for _ in range(1 + i // 3):
            w[draw.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3]] * 5 + [texts[7].upper()] * 2
    passage = " ".join(words(draw, 55))
    texts += ["\n".join([" ".join(words(draw, 70)), passage + draw.choice(["", ".", " so"]), " ".join(words(draw, 70))]) for _ in range(8)]
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts += [" ".join(words(draw, 60)) + f" Api_Key = \"{key}\" and password: hunter2hunter2 é" for _ in range(4)]
    texts += [" ".join(words(draw, 60)) + f"\npasswd=k{i}x99qqTT token:short AKIAIOSFODNN7EXAMPL{i} id-{i}-Zq81xPw0LmN4rT7sVb" for i in range(3)]
    rows = [(10 * k, t, ["en", "de", "xx", None][k % 4], f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    rows += [(5000 + k, t, "en", None, None) for k, t in enumerate(ODD)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns that clash with names the operators use."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, id bigint, node string, n_tokens int, kept string, _lost int"
    return spark.createDataFrame([(*r, 1, "n", 2, "k", 3) for r in corpus], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
