"""Disguised words are found and restored wherever they stand."""

import time

import pytest

from imprintmatch.llm import toxicity as X


@pytest.fixture(scope="module")
def decoder(spark):
    words = "you are such a moron and an idiot and a dumbass with a word of bullshit in it a words idiots ass schädling törichter"
    docs = spark.createDataFrame([(i, words) for i in range(200)], "doc_id long, text string")
    return X.Decoder(X.character_model(docs))


@pytest.mark.parametrize("text", ["word," * 20 + "m0r0n," + "word," * 20, "m" + "o" * 70 + "ron", "<b>" * 40 + "m0r0n" + "</b>" * 40, "中文" * 50 + "m0r0n" + "中文" * 50])
def test_long_runs(decoder, text):
    assert "moron" in decoder.restore(text)


def test_time_of_long_runs(decoder):
    began = time.process_time()
    assert decoder.restore("word-" * 4000 + "m0r0n")[0].endswith("moron")
    decoder.restore("m1" * 10000)
    assert time.process_time() - began < 20


CASES = {"a$$": "ass", "idi0+": "idiot", "bull$h!7": "bullshit", "dumb4$$": "dumbass", "!diot": "idiot", "(1diot": "idiot", '"!diot"': "idiot", "m  o  r  o  n": "moron", "m/o/r/o/n": "moron", "m - o - r, o - n": "moron", "t0richter": "torichter", "sch4dling": "schadling", "schädl1ng": "schädling", "tör1chter": "törichter", "m0r0n/word": "moron", "word-m0r0n": "moron", "m0-r0n": "moron"}


@pytest.mark.parametrize("text", CASES)
def test_disguises_at_ends_and_with_separators(decoder, text):
    assert CASES[text] in " ".join(decoder.restore(text)).split()


def test_a_separator_may_end_a_word(decoder):
    assert "moron" in " ".join(decoder.restore("you are a m o r o n")).split()


def test_plain_text_gives_nothing(decoder):
    assert decoder.restore("such words! and* an idiot, (törichter) état/word you're 12 and 3") == []


def test_the_channel_weighs_readings(decoder):
    """Of readings that the language model finds alike, the channel's likelier one is taken."""
    flat = X.Decoder(decoder.model * 0)
    assert flat.decode("mooo") == "mo" and flat.decode("a!a") == "aia" and flat.decode("m00n") == "mon"
    sure = {r: c for r, c in decoder.readings("!")[0]}
    assert sure["i"] > sure[""] and abs(sum(map(lambda c: 2.718281828**c, sure.values())) - 1) < 1e-6


@pytest.mark.parametrize("c", X.LEET)
def test_readings_of_a_sign_are_a_distribution(decoder, c):
    for token in (c, c * 2):
        assert abs(sum(2.718281828**cost for _, cost in decoder.readings(token)[0]) - 1) < 1e-6


PROBES = {"a$$hole": "asshole", "p@ssw0rd": "password", "st|_|pid": "stupid", "st(_)pid": "stupid", "stuuupid": "stupid", "mp3": "mp3", "v1.2": "v1.2", "covid19": "covid19"}


@pytest.fixture(scope="module")
def wide(spark):
    words = "you are such a stupid moron and an idiot or an asshole with a password in it, an mp of covid in v and what else there is to say about the weather"
    docs = spark.createDataFrame([(i, words) for i in range(200)], "doc_id long, text string")
    return X.Decoder(X.character_model(docs))


@pytest.mark.parametrize("text", PROBES)
def test_probes(wide, text):
    found = " ".join(wide.restore(f"say {text} there"))
    assert (PROBES[text] in found.split()) if text != PROBES[text] else (not found or all(c in text + " " for c in found)), found


def test_marks_in_two_pieces_or_with_doubled_letters(wide):
    import numpy as np
    import pyarrow as pa

    from imprintmatch.llm.decontam import normal
    from imprintmatch.llm.hashing import Words, mix64

    data, offsets = normal(pa.array(["stupid moron idiot"]))
    keys = np.sort(mix64(Words(data, offsets, 0, 1).hashes ^ np.uint64(1)))
    marks = X.Marks(keys, np.full(len(keys), 5.0))
    shown = pa.array(["you mo ron there", "an idi ot", "mo.ron", "so stuupid", "and stupiid idiott", "a weather moronic", "to say the", None, "", "stup", "id ea"])
    hits = marks.evidence(shown, wide)[:, 3]
    assert hits.tolist() == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0]
