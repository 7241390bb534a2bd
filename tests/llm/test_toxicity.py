import pytest

from siftwell.llm import toxicity
from siftwell.llm.common import Scratch
from tests.llm.conftest import words


@pytest.mark.parametrize("text, kind", [
    ("You are an idiot.", "insult_target"), ("What a moron!", "insult_bare"), ("He is not stupid at all", "negated"), ("She said he is an idiot", "reported"),
    ("I will kill you.", "threat_target"), ("They kill time.", None), ("All is well, you know.", None), ("idiotic", None), ("scum###", "insult_bare"), ("I won't hurt you", None),
])
def test_clauses(text, kind):
    want = [int(k == kind) for k in toxicity.KINDS]
    assert toxicity.match(text) == want


def test_counts_clauses_not_words():
    assert toxicity.match("idiot moron scum. Fine. Stupid") == [0, 2, 0, 0, 0]
    assert toxicity.match("idiot. " * 50)[1] == 50
    assert toxicity.match(None) == toxicity.match("") == [0] * 5


def test_composition_feeds_outputs_on():
    a = toxicity.Transducer({(0, "x"): (1, "y"), (1, "x"): (0, "z")})
    b = toxicity.Transducer({(0, "y"): (0, "1"), (0, "z"): (0, "2")})
    assert a.compose(b).run(list("xxx")) == ["1", "2", "1"]


def test_held_out_accuracy_and_odd_rows(spark, docs, odd_rows, rng):
    rows = [(i, ("plain words here. " * 3) + ("you moron. " if i % 4 == 0 else ""), "s") for i in range(200)] + [(None, None, None), (900, "", "a"), (900, "", "a")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)] + [(900, None), (None, 1), (901, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs(rows), labels, Scratch(spark)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 200]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    kept = toxicity.keep_clean(docs(rows), labels, Scratch(spark))
    assert kept.columns == docs([]).columns and kept.count() == len(rows) - 50
    assert toxicity.score(docs(odd_rows), labels, Scratch(spark)).count() == len(odd_rows)
    assert toxicity.score(docs([]), labels, Scratch(spark)).collect() == []


def test_learns_words_that_no_list_holds(spark, docs, rng):
    text = lambda i: " ".join(words(rng, 30).split() + ([f"wrzlstem{rng.choice('abcd')}", "wrzlstemx"] if i % 4 == 0 else [])) + "."
    rows = [(i, text(i), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    assert all(toxicity.match(t) == [0] * 5 for _, t, _ in rows)
    held = [r for r in toxicity.score(docs(rows), labels, Scratch(spark)).collect() if r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert {r["doc_id"] for r in toxicity.keep_clean(docs(rows), labels, Scratch(spark)).collect()} == {i for i in range(300) if i % 4}


def test_scope_of_learned_words():
    lexicon = toxicity.Weights({"wrzl": 1.0, "ab$": 1.0})
    assert toxicity.learned("Wrzlig wrzl. Wrzlung ab", lexicon) == [4, 100]
    assert toxicity.learned("not wrzlig. She said ab. abc", lexicon) == [0, 0]
    assert toxicity.learned(None, lexicon) == [0, 0]


def test_chooses_stems_by_evidence():
    rows = [("wrzl", (40, 38), (45, 2)), ("wrzla", (12, 9), (3, 0)), ("der$", (90, 80), (900, 800)), ("rare", (3, 0), (0, 0))]
    assert list(toxicity.choose(rows, 100, 1000)) == ["wrzl"]


def brute_kind(clause):
    """What the composed machine should say of a clause, by looking at its words one by one."""
    w = toxicity.words(clause)
    sym = [toxicity.SYMBOLS.get(x, "X") for x in w]
    target_at, best, seen = None, 0, False
    for i, x in enumerate(sym):
        negated = "N" in sym[max(0, i - 3) : i]
        said = "R" in sym[:i]
        if x == "I":
            best = max(best, 1 if negated else 2 if said else 3)
        if x == "T":
            target_at = None if negated or said else i
        if x == "G":
            seen = True
            if target_at is not None and i - target_at <= 3:
                best = 4
            target_at = None
    return [None, "negated", "reported", "insult_target" if seen else "insult_bare", "threat_target"][best]


def test_machine_against_brute_force(rng):
    some = ["idiot", "kill", "you", "not", "said", "tree", "house", "moron", "hurt", "them", "green"]
    for _ in range(3000):
        clause = " ".join(rng.choice(some) for _ in range(rng.randint(1, 9)))
        kind = brute_kind(clause)
        assert toxicity.match(clause) == [int(k == kind) for k in toxicity.KINDS], clause


def test_very_long_text_and_many_matches(spark, docs):
    text = "You are fine. " * 100_000 + "idiot. " * 1000
    assert toxicity.match(text) == [0, 1000, 0, 0, 0]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs([(1, text, "s")]), labels, Scratch(spark)).count() == 1


def test_held_out_recall_by_language(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, labels, Scratch(spark)).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert (toxic.groupby("lang")["predicted"].mean() > 0.8).all() and toxic["predicted"].mean() > 0.9
    assert clean["predicted"].mean() < 0.01
