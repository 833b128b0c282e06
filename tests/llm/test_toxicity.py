"""What the toxicity machine learns: noise, insults that come together, splits, phrases, and nothing."""

import random

import numpy as np
import pytest

from recallspark.llm import queries, toxicity

WORDS = [a + b + c for a in ("ba", "ke", "li", "mo", "nu") for b in ("ra", "ti", "so") for c in ("n", "l", "rd", "")]


def clean_text(rng, n=30):
    return " ".join(rng.choices(WORDS, k=n))


def with_phrase(rng, phrase):
    words = rng.choices(WORDS, k=30)
    at = rng.randint(0, 30)
    return " ".join([*words[:at], phrase, *words[at:]])


def corpus(toxic, clean, n=300, seed=1):
    """n texts by `toxic` and twice as many by `clean`, mixed."""
    rng = random.Random(seed)
    rows = [(toxic(rng, i), 1) for i in range(n)] + [(clean(rng, i), 0) for i in range(2 * n)]
    rng.shuffle(rows)
    return [t for t, _ in rows], [y for _, y in rows]


def scores(machine, *phrases):
    rng = random.Random(9)
    return [float(machine.scores([with_phrase(rng, p)])[0]) for p in phrases]


def test_every_insult_that_comes_together_is_learnt():
    insults = ["dumbbrick", "foolhead", "grubface", "zitworm"]

    def toxic(rng, i):
        return with_phrase(rng, " ".join(rng.sample(insults, 3)))

    machine = toxicity.train(*corpus(toxic, lambda rng, i: clean_text(rng)))
    assert min(scores(machine, *insults)) >= queries.TOXIC
    assert max(scores(machine, *WORDS[:12])) < 0.3


def test_insult_inside_a_phrase_of_ordinary_words():
    machine = toxicity.train(*corpus(lambda rng, i: with_phrase(rng, "you are dumbbrick"), lambda rng, i: with_phrase(rng, "you are kind") if i % 2 else clean_text(rng)))
    insult, kind = scores(machine, "dumbbrick", "you are kind")
    assert insult > 0.5 and kind < 0.3


def test_quoting_and_wrongly_labelled_texts_do_no_harm():
    def clean(rng, i):
        return with_phrase(rng, "dumbbrick") if i % 300 == 0 else clean_text(rng)

    machine = toxicity.train(*corpus(lambda rng, i: with_phrase(rng, "dumbbrick") if i % 20 else clean_text(rng), clean))
    plain, *disguised = scores(machine, "dumbbrick", "d-u-m-b-b-r-i-c-k", "dumb brick", "dumbbbrick", "d u m b b r i c k", "dum*brick")
    assert plain > 0.5 and sum(s > 0.3 for s in disguised) >= 4
    assert max(scores(machine, *WORDS[:12])) < 0.3


def test_phrases_of_ordinary_words():
    def clean(rng, i):
        return with_phrase(rng, rng.choice(["go away", "stay home"]))

    machine = toxicity.train(*corpus(lambda rng, i: with_phrase(rng, "go home"), clean))
    assert scores(machine, "go home")[0] > 0.5
    assert max(scores(machine, "go away", "stay home", "home", "go")) < 0.3


@pytest.mark.parametrize("labels", ["random", "all clean", "all toxic", "none"])
def test_without_a_signal_every_text_scores_the_base_rate(labels):
    texts, _ = corpus(lambda rng, i: clean_text(rng), lambda rng, i: clean_text(rng), n=60)
    y = {"random": [int(i % 3 == 0) for i in range(len(texts))], "all clean": [0] * len(texts), "all toxic": [1] * len(texts), "none": []}[labels]
    machine = toxicity.train(texts[: len(y)], y)
    found = machine.scores(["", "anything at all", texts[0], "x" * 10_000])
    assert np.ptp(found) == 0
    assert found[0] == pytest.approx((sum(y) + 0.5) / (len(y) + 1))


def test_training_is_repeatable():
    texts, y = corpus(lambda rng, i: with_phrase(rng, "dumbbrick"), lambda rng, i: clean_text(rng), n=50)
    a, b = toxicity.train(texts, y), toxicity.train(texts, y)
    assert np.array_equal(a.scores(texts), b.scores(texts))


def test_windows_cover_all_neighbours():
    units = toxicity.Units.of_texts(["one two  three", "", "four", "a b c five"])
    letters = lambda u: "".join(chr(96 + ord(c)) if ord(c) <= 26 else {61: "]", 62: "[", 63: "_"}.get(ord(c), "?") for c in u)
    seen = [sorted(letters(u) for u in w.spelled()) for w in units.windows()]
    assert seen[0] == sorted(["[one]", "[two]", "[three]", "[four]", "[a_b_c]", "[five]"])
    assert sorted(u.replace("_", "") for part in seen[1:3] for u in part) == sorted(["[onetwo]", "[twothree]", "[abcfive]"])
    assert [u.replace("_", "") for part in seen[3:] for u in part] == ["[onetwothree]"]


def test_margins_are_those_of_the_subsequences():
    from recallspark.llm.toxicity import _CLASSES, Units

    rng = np.random.default_rng(5)
    table = rng.normal(size=_CLASSES**3).astype(np.float32)
    texts = ["", "a", "you f o o l, you", "漢字 😀 x", "  two\n\nlines of several words  "] + ["".join(rng.choice(list("ab .é"), 40)) for _ in range(30)]
    for units in Units.of_texts(texts).windows():
        total, norm = np.zeros(len(units.starts)), np.zeros(len(units.starts))
        for unit, code, weight in units.triples():
            total += np.bincount(unit, table[code], len(total)) * weight
            norm += np.bincount(unit, minlength=len(norm)) * weight**2
        assert np.array_equal(units.margins(table, 0.5), total / np.sqrt(np.maximum(norm, 1e-9)) + 0.5)
