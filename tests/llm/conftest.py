import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SYLLABLES = "the an er ing on re ti es en at ou ed th nd ha to or is it ea hi as te et ng of al de se le sa si ar".split()
FOREIGN = "éau ñado über ción ßen que ung lich ère ment".split()


def sentence(rng, n, foreign=False):
    pool = SYLLABLES + FOREIGN * 3 if foreign else SYLLABLES
    return " ".join("".join(rng.choices(pool, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): odd texts, nulls, copies, near copies, ties and repeated rows among plain ones."""
    rng = random.Random(7)
    texts = [sentence(rng, rng.randint(1, 150), i % 3 == 0) for i in range(120)]
    base = sentence(rng, 200)
    for k in range(25):  # a group of near copies that are not all alike
        w = base.split()
        for j in range(1 + k % 6):
            w[(37 * j + 11 * k) % len(w)] = f"edit{k}x{j}"
        texts.append(" ".join(w))
    texts += [base] * 6 + ["", " \n\t", "one", "two words", "ONE", "Two Words", "x" * 5000, "1 " * 3000, "a\x00b   é́ \U0001f600 ﬀ", "!!! ### $$$ 123", "token <|endoftext|> inside", sentence(rng, 9000)]
    texts += ["mail a.b@c.example.com or a@b.c_d@e.f +1 (499) 555-6503 ip 10.0.0.256 10.0.0.25 card 4111 1111 1111 1111 x", "1.2.3.4.5.6.7.8 and 0001.002.3.4 " + "9" * 300, "call me at +49-171-555-1234. 5105-1051-0510-5100"]
    rows = [(i, t, ["en", "de", "fr"][i % 3], "hot" if i % 2 else f"s{i % 5}", len(t)) for i, t in enumerate(texts)]
    rows += [(500, None, "en", "s1", None), (501, "null language and source here", None, None, 3), (None, "no id at all in this row", "en", "s1", 3), (None, "no id at all in this row", "en", "s1", 3), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, a long, bucket string, token string, score string, shares string, _text string, base string, spans string, cands string, _s long, _h long, doc long, place long"
    return spark.createDataFrame([(*r, 1, 2, "x", "y", "s", "t", "u", "v", "w", "x", 5, 6, 7, 8) for r in corpus], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
