import random

import pytest

#: Columns whose names clash with those that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, n long, token string, _id long, component string, spans string"


def made_texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abdeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, line = say(60), "A common line that stands in many documents"
    texts = {0: None, 1: "", 2: " \n\t ", 3: "word", 4: "Word", 5: "two words", 6: "é\n\né", 7: "x" * 5000, 8: "\n".join(["same line over and over"] * 30)}
    base = say(120)
    for i in range(10, 30):
        w = base.split()
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts[i] = " ".join(w)
    for i in range(30, 36):
        texts[i] = base  # exact copies
    for i in range(40, 52):
        texts[i] = say(40) + "\n" + line + "  \n" + say(20) + ("\n" + shared if i % 2 else "") + "\n" + say(30)
    texts[60] = "Mail a.b+c@mail.example.org or x@y, ip 10.0.0.255 and 1.2.3.256, card 4111 1111 1111 1111, +1 (017) 555-7713 end."
    texts[61] = "naïve 🙂 text\x1cwith <|endoftext|> odd　spaces   and\r\nlines's"
    texts[62] = "Released under the MIT License. " + say(50)
    texts[63] = say(9000)
    texts[64] = "1" * 3000 + "@" * 50 + " " + "9." * 500
    return texts


@pytest.fixture(scope="session")
def texts():
    return made_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, [None, "en", "de", "xx"][i % 4], "s", len(t or ""), i, None, "t", 7, "c", "s") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Repeated rows, one id with two texts, a row without an id."""
    rows = [(1, "the same row twice here"), (1, "the same row twice here"), (2, "one id with two texts"), (2, "another text of that id"), (None, "a row without an id")]
    return spark.createDataFrame([(i, t, "en", "s", 1, 1, 1, "t", 7, "c", "s") for i, t in rows], SCHEMA)
