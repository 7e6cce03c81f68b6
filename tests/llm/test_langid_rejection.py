"""Unknown languages and gibberish in Latin letters are rejected, clean texts of any length are not."""

import base64
import random

from corvane.llm import langid
from tests.llm.test_langid import corpus

FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto"


def rejected(model, texts):
    return model.predict(langid.trigram_counts(texts))[2]


def test_gibberish_and_unseen_languages_are_rejected():
    rnd, letters = random.Random(4), "abcdefghijklmnopqrstuvwxyz"
    words = lambda n: " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 10))) for _ in range(n))
    rows = corpus(1200)
    # A few junk texts in the sample must not set the floor for all.
    learned = [(t, lang) for _, t, lang in rows[:900]] + [(words(rnd.choice((2, 4, 8, 15))), rnd.choice(("aa", "bb", "cc"))) for _ in range(12)]
    model = langid.fit_counts([lang for _, lang in learned], langid.trigram_counts([t for t, _ in learned]))
    codes = [base64.b64encode(rnd.randbytes(n)).decode() for n in (60, 300, 2000) for _ in range(20)]
    assert rejected(model, [*[words(n) for n in (10, 40, 200) for _ in range(20)], *codes, FINNISH]).all()
    assert not rejected(model, [t for _, t, _ in rows[900:]]).any()
