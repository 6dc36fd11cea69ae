from pathlib import Path

import pytest

from docloom.llm import mixing

pytestmark = pytest.mark.skipif(not Path(mixing.TOKENIZER).exists(), reason="no tokenizer files here")
KIND, GOALS = "doc_id long, text string, lang string, source string, tokens int, times int", "mix_name string, source string, target_share double, max_repeats int"


def test_sizes_are_those_of_the_public_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(str(Path(mixing.TOKENIZER).with_suffix(".json")))
    for text in ("Le résumé final.", "a  b\n\n c's 123", "Ｌｅ ​ <|endoftext|>"):
        other.encode_special_tokens = True
        assert len(mixing._encoding(mixing.TOKENIZER).encode_ordinary(text)) == len(other.encode(text, add_special_tokens=False).ids)


def test_shortages_go_to_siblings_before_ancestors():
    leaf = lambda d, g, s, w, r: {"domain": d, "lang": g, "source": s, "weight": w, "room": r}
    leaves = [leaf("x", "en", "a", 1.0, 10), leaf("x", "en", "b", 1.0, 1000), leaf("x", "fr", "c", 1.0, 1000), leaf("y", "en", "d", 1.0, 1000)]
    total, planned = mixing.plan(leaves, 400)
    got = {p["source"]: p["budget"] for p in planned}
    assert total == 400 and got == {"a": 10, "b": 190, "c": 100, "d": 100}
    total, planned = mixing.plan(leaves, 10_000)
    assert total == 3010 and all(p["budget"] == p["room"] for p in planned)
    assert mixing.plan([], None) == (0.0, [])
    assert mixing.plan(leaves, None)[0] == 40


def rows():
    made = [(k, "word " * 50, "en", "Big Source", 1, 1) for k in range(400)]
    made += [(1000 + k, "mot " * 50, ["fr", None][k % 2], " small-source", 1, 1) for k in range(20)]
    return [*made, (2000, None, "en", "big_source", 1, 1), (2001, "", "en", "big_source", 1, 1), (2002, "lost " * 9, "en", None, 1, 1), (None, "x " * 9, "en", "big_source", 1, 1), (2003, "untargeted " * 9, "en", "other", 1, 1), (2004, "huge " * 20_000, "en", "huge", 1, 1)]


def test_shares(spark):
    docs = spark.createDataFrame(rows(), KIND)
    goals = spark.createDataFrame([("m", "BIG_source", 0.75, 2), ("m", "small source", 0.25, 3), ("m", "small source", 0.25, 3), ("m", "nothing", 0.2, 3), ("m", None, 0.2, 3), (None, "huge", 1.0, 1), ("h", "huge", 1.0, 2)], GOALS)
    drawn, report = mixing.mixture(docs, goals)
    report = {(r.mix_name, r.source): r for r in report.collect()}
    assert abs(report["m", "big_source"].actual_share - 0.75) < 0.01 and report["m", "nothing"].actual_share == 0
    assert report["m", "small_source"].max_times <= 3 and report["h", "huge"].max_times == 2
    drawn = drawn.collect()
    assert len({(r.mix_name, r.doc_id) for r in drawn}) == len(drawn) and not {r.doc_id for r in drawn} & {2000, 2001, 2002, 2003, None}
    for (mix, source), r in report.items():
        assert r.drawn_tokens == sum(d.tokens * d.times for d in drawn if (d.mix_name, d.source) == (mix, source))
    again, _ = mixing.mixture(docs, goals)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn))
    _, full = mixing.mixture(docs, goals, budget_share=5.0)
    assert {r.source: r.max_times for r in full.where("mix_name = 'm'").collect()} == {"big_source": 2, "small_source": 3, "nothing": 0}


def test_empty(spark):
    docs, goals = spark.createDataFrame(rows(), KIND), spark.createDataFrame([("m", "a", None, None)], GOALS)
    for d, g in ((docs.limit(0), goals), (docs, goals), (docs, goals.limit(0))):
        drawn, report = mixing.mixture(d, g)
        assert drawn.count() == 0 and report.count() == g.count()


def test_domains_hand_shortages_to_siblings_first(spark):
    made = [(k, "word " * 40, "en", "a_small", 1, 1) for k in range(10)] + [(100 + k, "word " * 40, "en", "a_large", 1, 1) for k in range(400)] + [(1000 + k, "word " * 40, "en", "b_large", 1, 1) for k in range(400)]
    goals = spark.createDataFrame([("m", "a_small", 0.4, 1), ("m", "a_large", 0.2, 2), ("m", "b_large", 0.4, 2)], GOALS)
    docs = spark.createDataFrame(made, KIND)
    budget = {"m": 200.0 * 40}
    shares = lambda domains: {r.source: r.actual_share for r in mixing.mixture(docs, goals, budgets=budget, domains=domains)[1].collect()}
    one, two = shares(None), shares({"a_small": "a", "a_large": "a", "b_large": "b"})
    # The small source has a twentieth of the budget.  Within its domain the sibling takes all it lacks; without domains both do.
    assert abs(two["b_large"] - 0.4) < 0.01 and abs(two["a_large"] - 0.55) < 0.01 and abs(two["a_small"] - 0.05) < 0.01
    assert one["b_large"] > 0.6 and abs(one["a_small"] - 0.05) < 0.01
