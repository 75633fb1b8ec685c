"""Texts for the tests: deterministic invented prose, and the odd cases every operator must stand."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n\n", "one", "One two", "a b c", "éè 中文 \U0001f600 x y", "\tA\x0b b\x0cC\r\n d", "<|endoftext|> 'S don't 12.5%", "same same same same same same"]


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghiklmnoprstuvwzéü") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def prose(rng, words, vocab, line=12):
    out = [rng.choice(vocab) for _ in range(words)]
    return "\n".join(" ".join(out[i : i + line]) + "." for i in range(0, len(out), line))


def documents(spark, texts, extra=False):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as n", "2 as node", "3 as n_words", "'x' as words", "4 as kept", "array(1) as spans", "5 as row", "'f' as face", "6 as component_id") if extra else df


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def seeded(seed=1):
    rng = random.Random(seed)
    return rng, vocabulary(rng)
