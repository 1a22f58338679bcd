"""Tags in context: paths against enumeration, ambiguous words, counting."""

from __future__ import annotations

import itertools
import random
import uuid

from inkwell.operators import lattice as la


def worth(words: list[str], path: tuple[int, ...], model: la.Model) -> int:
    before = [len(la.TAGS), *path]
    return sum(model.follows[p][t] + model.emission(w)[t] for p, t, w in zip(before, path, words, strict=False)) + (model.ends[path[-1]] if path else 0)


def test_paths_equal_enumeration():
    rng, model = random.Random(3), la.first_model()
    words = ["that", "the", "her", "for", "run", "river", "quickly", "stood", "42", "darkness", "and", "x"]
    sentences = [[rng.choice(words) for _ in range(rng.randrange(0, 5))] for _ in range(60)]
    for sentence, path in zip(sentences, la.decode(sentences, model), strict=True):
        best = max((worth(sentence, p, model) for p in itertools.product(range(len(la.TAGS)), repeat=len(sentence))), default=0)
        assert len(path) == len(sentence) and worth(sentence, tuple(path), model) == best


def names(text: str, model: la.Model | None = None) -> list[str]:
    return [la.TAGS[t] for t in la.decode([text.split()], model or la.first_model())[0]]


def test_ambiguous_words_change_with_context():
    assert names("she saw her")[-1] == "PRON" and names("her river rose")[0] == "DET"
    assert names("that river rose")[0] == "DET"
    assert names("the painted wall stood")[1] == "ADJ" and names("she painted the wall")[1] == "VERB"


def test_counting_learns_and_does_not_depend_on_partitions(spark):
    texts = ["the blorping river stood", "a blorping stone fell", "she went blorping"] * 40 + ["42 stones"] * 5
    rows = spark.createDataFrame([(t.split(),) for t in texts] + [(None,), ([],)], "tokens array<string>")
    one, two = (la.trained(rows.repartition(n), "tokens") for n in (1, 7))
    assert one == two and one != la.first_model()
    assert one.emission("blorping")[la.AT["ADJ"]] > la.first_model().emission("blorping")[la.AT["ADJ"]]
    got = la.tagged(rows, "tokens", one).collect()
    assert [r["tags"] for r in got if r["tokens"] is None] == [None] and [r["tags"] for r in got if r["tokens"] == []] == [[]]
    assert all(len(r["tags"]) == len(r["tokens"]) for r in got if r["tokens"])
    assert la.counted(rows.limit(0), "tokens", la.first_model()).follows == la.first_model().follows


def test_a_round_reads_its_rows_once(spark, tmp_path):
    def seen(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    rows = spark.createDataFrame([("the river stood".split(),)] * 9, "tokens array<string>").repartition(3).mapInArrow(seen, "tokens array<string>")
    la.counted(rows, "tokens", la.first_model())
    assert len(list(tmp_path.iterdir())) == 3


def test_suffixes_are_counted_by_characters(spark):
    """Words shorter than a suffix, of several bytes a character, closed ones and digits."""
    texts = ["a blorping größe stood", "größe é 42 élan", "é"]
    model = la.counted(spark.createDataFrame([(t.split(),) for t in texts], "tokens array<string>"), "tokens", la.first_model())
    want = {w[len(w) - n :] for t in texts for w in t.split() if w not in model.words and not w.isdigit() for n in range(min(la.LONGEST, len(w)) + 1)}
    assert model.suffixes.keys() == want | {""} and {"é", "röße", "élan", "ping"} <= want


def test_very_long_sentence():
    assert len(la.decode([["word"] * 200_000, ["x"]], la.first_model())[0]) == 200_000
