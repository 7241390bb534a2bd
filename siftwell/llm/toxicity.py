"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech, other). Small
transducers rewrite them in turn: negation and reported speech mark the insults and
threats in their scope, the threat transducer needs a target, and the last one turns each
clause into one of ``KINDS``. They are composed into one machine. The lists hold few words of
few languages, so further insults are learned as weighted stems (a lexicon) from the labelled rows
outside the held-out fold; the first transducers leave out those that are negated or reported. A
document's score is a logistic function of its counts of matched clauses by kind and of the
learned words' weight, in all and as a share of its words, with weights learned from
rows outside the held-out fold as well; labels, language, source and id are no inputs.

Defined cases: null or empty text matches no clause and gets the score of such texts; texts of
any length are read whole, clause by clause; repeated rows get equal scores; rows whose id has several labels teach
each; of stems that tie the longer, then the first in order is learned; without labels of both kinds the weights are the
prior ones; an empty table gives no rows. Other columns, whatever they are called, pass through ``keep_clean`` unchanged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from siftwell.llm.common import Scratch

# Word lists of the grammar, by symbol.
INSULTS = (
    "idiot idiots clown clowns worthless moron morons scum trash loser losers stupid pathetic disgusting dumb "
    "imbecile imbeciles bastard bastards filth vermin scumbag dumbass jerk garbage "
    "trottel idiotin dummkopf arschloch abschaum abartig erbärmlich "
    "idiote imbécile connard salaud ordure minable débile abruti "
    "idiota imbécil estúpido estúpida basura escoria patético patética asqueroso"
).split()
THREATS = "kill murder hurt destroy strangle stab shoot töten umbringen tuer frapper matar destruir".split()
TARGETS = "you your u he she they them him her this that these those it all people du ihr euch dich sie tu te vous toi ils elle tú usted ustedes te ellos".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't won't nicht kein keine niemals pas jamais nunca tampoco sin".split()
REPORTED = "said says called wrote quoted reported claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

KINDS = ("insult_target", "insult_bare", "threat_target", "negated", "reported")
#: What the learned stems add: their weight in the whole text and in 100 of its words.
LEARNED = ("learned", "learned_share")
FEATURES = KINDS + LEARNED
#: Labelled rows that the logistic weights are fitted on at most, the first by a hash of their ids; the lexicon is learned from all.
FITTED_ROWS = 50_000
#: A stem is a word's first 4 to 12 letters, or a whole word, which ends in "$".
STEM = (4, 12)
#: Stems are learned that this share of the toxic rows hold, in this many rows at least, with this G^2 and these log-odds at least; the best by G^2.
STEM_SHARE, STEM_ROWS, STEM_G2, STEM_ODDS, STEMS = 0.01, 3, 30.0, 1.5, 256
#: Log-odds from which a stem weighs 1, and partial counts that a task holds at once.
FULL_ODDS, HELD = 4.0, 300_000
#: Log-odds before any label is seen, and how many rows' worth of curvature they weigh: kinds without labelled examples keep them.
PRIOR, PRIOR_BIAS, RIDGE = (4.0, 3.0, 4.0, -0.5, 1.0, 0.0, 0.0), -2.5, 0.3


class Transducer:
    """Deterministic transducer: ``arcs[state, symbol] = (next state, output symbol)``; state 0 starts."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str]]):
        self.arcs = arcs

    def compose(self, other: Transducer) -> Transducer:
        """The machine that feeds this one's outputs to ``other``."""
        ids, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            p = todo.pop()
            for (s, x), (t, y) in self.arcs.items():
                if s == p[0] and (p[1], y) in other.arcs:
                    u, z = other.arcs[p[1], y]
                    if (t, u) not in ids:
                        ids[t, u] = len(ids)
                        todo.append((t, u))
                    arcs[ids[p], x] = (ids[t, u], z)
        return Transducer(arcs)

    def run(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for x in symbols:
            state, y = self.arcs[state, x]
            out.append(y)
        return out


BASE = ("X", "I", "T", "G", "N", "R", "#")  # other, insult, threat verb, target, negation, reported, end of clause
MARKED = ("I-", "T-", "I~", "T~")


def negation(scope: int = 3) -> Transducer:
    """Marks insults and threats within ``scope`` words after a negation."""
    arcs = {}
    for s in range(scope + 1):
        for x in BASE:
            to = scope if x == "N" else 0 if x == "#" else max(0, s - 1)
            arcs[s, x] = (to, x + "-" if s and x in "IT" else x)
    return Transducer(arcs)


def reported() -> Transducer:
    """Marks insults and threats after a verb of reported speech in the clause."""
    arcs = {}
    for s in (0, 1):
        for x in (*BASE, "I-", "T-"):
            to = 1 if x == "R" else 0 if x == "#" else s
            arcs[s, x] = (to, x + "~" if s and x in ("I", "T") else x)
    return Transducer(arcs)


def threat(reach: int = 3) -> Transducer:
    """A threat verb counts only if a target follows within ``reach`` words; else it is an ordinary word."""
    arcs = {}
    for s in range(reach + 1):
        for x in (*BASE, *MARKED):
            if x in ("T", "T-", "T~"):
                arcs[s, x] = (reach, "X") if x == "T" else (0, "X")
            elif x == "G" and s:
                arcs[s, x] = (0, "TG")
            else:
                arcs[s, x] = (0 if x == "#" else max(0, s - 1), x)
    return Transducer(arcs)


def clause() -> Transducer:
    """The clause's strongest match, put out at its end. States: target seen + 2 * match."""
    order = ["X", "negated", "reported", "insult_bare", "threat_target"]
    arcs = {}
    for g in (0, 1):
        for m in range(5):
            for x in (*BASE, "I-", "I~", "TG"):
                h, k = g or x in ("G", "TG"), m
                k = max(k, {"I-": 1, "I~": 2, "I": 3, "TG": 4}.get(x, 0))
                if x == "#":
                    out = "insult_target" if m == 3 and g else order[m]
                    arcs[g + 2 * m, x] = (0, out)
                else:
                    arcs[g + 2 * m, x] = (int(h) + 2 * k, "X")
    return Transducer(arcs)


SCOPE = negation().compose(reported())
MACHINE = SCOPE.compose(threat()).compose(clause())
SYMBOLS = {w: s for s, words in (("G", TARGETS), ("R", REPORTED), ("N", NEGATIONS), ("T", THREATS), ("I", INSULTS)) for w in words}
TRIGGER = r"(?i)(^|[^\pL\pN_])(" + "|".join(INSULTS + THREATS) + r")($|[^\pL\pN_])"
_HIT = re.compile(r"(?<!\w)(?:" + "|".join(INSULTS + THREATS) + r")(?!\w)", re.IGNORECASE)
_END = re.compile(r"[.!?;\n]+(?=\s|$)|\n")
_WORD = re.compile(r"\w+(?:'\w+)?")


def lower(text: str) -> str:
    return text.replace("’", "'").lower()


def words(text: str) -> list[str]:
    return _WORD.findall(lower(text))


def stems(word: str) -> list[str]:
    """What a lexicon can know a word by; nothing for words of the lists."""
    return [] if word in SYMBOLS else [word + "$", *(word[:k] for k in range(STEM[0], min(len(word), STEM[1]) + 1))]


class Known(dict):
    """Words already looked up, with what ``f`` says of them; forgotten when there are too many."""

    def __init__(self, f: Callable[[str], object]):
        super().__init__()
        self.f = f

    def __missing__(self, word: str) -> object:
        if len(self) >= HELD:
            self.clear()
        self[word] = found = self.f(word)
        return found


#: Characters that are inside of words for sure; a stem after any other one may begin a word.
_INSIDE = "a-z0-9_ß-öø-ÿ"


class Weights(Known):
    """A word's weight: the greatest of its stems' weights, 0 where none is known. ``begins`` matches all lower-case texts with such words, and some more."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__(lambda w: max((lexicon[s] for s in stems(w) if s in lexicon), default=0.0))
        self.begins = f"(?:^|[^{_INSIDE}])(?:" + "|".join(sorted({s.rstrip("$") for s in lexicon})) + ")" if lexicon else None


def learned(text: str | None, weight: Weights) -> list[float]:
    """Values of ``LEARNED``. Negated and reported words weigh nothing. Only clauses with a learned word are run."""
    every = words(text or "")
    some = {w for w in set(every) if weight[w]}
    if not some:
        return [0.0, 0.0]
    total = 0.0
    for part in _END.split(text):
        ws = words(part)
        if not some.isdisjoint(ws):
            marks = SCOPE.run(["I" if w in some else SYMBOLS.get(w, "X") for w in ws])
            total += sum(weight[w] for w, m in zip(ws, marks, strict=True) if m == "I" and w in some)
    return [total, 100 * total / len(every)]


def match(text: str | None) -> list[int]:
    """Counts of matched clauses by kind. Only clauses with an insult or threat word are run."""
    counts = dict.fromkeys(KINDS, 0)
    if text:
        ends, at = None, 0
        for hit in _HIT.finditer(text):
            if hit.start() < at:
                continue
            begin = at
            for e in _END.finditer(text, at):
                if e.end() <= hit.start():
                    begin = e.end()
                else:
                    ends = e.start()
                    at = e.end()
                    break
            else:
                ends, at = len(text), len(text)
            kind = MACHINE.run([SYMBOLS.get(w, "X") for w in words(text[begin:ends])] + ["#"])[-1]
            if kind in counts:
                counts[kind] += 1
    return [counts[k] for k in KINDS]


def _holding(text: pa.Array, pattern: str) -> np.ndarray:
    """Places of the texts that match."""
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(text, pattern), False).to_numpy(zero_copy_only=False))


def features(text: pa.Array, weight: Weights) -> np.ndarray:
    """One row of ``FEATURES`` per text. Words are cut only where a pattern says that a listed word or a learned stem may stand."""
    f = np.zeros((len(text), len(FEATURES)))
    for i in _holding(text, TRIGGER):
        f[i, : len(KINDS)] = match(text[i].as_py())
    if weight.begins:
        for i in _holding(pa.array([lower(t or "") for t in text.to_pylist()], pa.large_string()), weight.begins):
            f[i, len(KINDS) :] = learned(text[i].as_py(), weight)
    return f


def _stem_counts(batches: Iterator[pa.RecordBatch], wanted: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """``stem, once, twice``: rows that hold a word with the stem, and rows that hold two; partial counts."""
    once, twice = Counter(), Counter()
    known = Known(lambda w: tuple(s for s in stems(w) if wanted is None or s in wanted))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(once), pa.string()), pa.array(list(once.values()), pa.int64()), pa.array([twice[s] for s in once], pa.int64())], names=["stem", "once", "twice"])
        once.clear()
        twice.clear()
        return out

    for b in batches:
        for t in b.column("text"):
            ws = words(t.as_py() or "")
            here = Counter(chain.from_iterable(map(known.__getitem__, ws)))
            once.update(here.keys())
            twice.update([s for s, n in here.items() if n > 1])
            if len(once) > HELD:
                yield flush()
    yield flush()


def stem_counts(docs: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    schema = StructType([StructField("stem", StringType()), StructField("once", LongType()), StructField("twice", LongType())])
    return docs.select("text").mapInArrow(partial(_stem_counts, wanted=wanted), schema).groupBy("stem").agg(F.sum("once").alias("once"), F.sum("twice").alias("twice"))


def evidence(a: int, n: int, b: int, m: int) -> tuple[float, float]:
    """G^2 and smoothed log-odds of ``a`` of ``n`` toxic against ``b`` of ``m`` clean rows."""
    g = 0.0
    for x, of, rate in ((a, n, (a + b) / (n + m)), (b, m, (a + b) / (n + m))):
        g += sum(2 * k * math.log(k / (of * r)) for k, r in ((x, rate), (of - x, 1 - rate)) if k)
    return g, math.log((a + 0.5) * (m - b + 0.5) / ((n - a + 0.5) * (b + 0.5)))


def choose(rows: list[tuple[str, tuple[int, int], tuple[int, int]]], n: int, m: int) -> dict[str, float]:
    """Weights of the best stems among ``(stem, toxic rows, clean rows)``, rows with one and with two such words; none begins another."""
    found = []
    for stem, toxic, clean in rows:
        g, odds = max(evidence(a, n, b, m) if a * m > b * n else (0.0, 0.0) for a, b in zip(toxic, clean, strict=True))
        if g >= STEM_G2 and odds >= STEM_ODDS:
            found.append((-round(g, 6), -len(stem), stem, odds))
    out = {}
    for *_, stem, odds in sorted(found):
        if len(out) < STEMS and not any(stem.startswith(s) or s.startswith(stem.rstrip("$")) for s in out):
            out[stem] = min(1.0, odds / FULL_ODDS)
    return out


def taught(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``h, toxic, text`` of all labelled rows outside the held-out fold, on shared storage. Labels other than 0 and 1 teach nothing."""
    # Texts are dealt out by key at any size: no switch to a broadcast where few rows are labelled.
    rows = docs.select("doc_id", "text").where(~fold("doc_id")).join(labels.where("toxic in (0, 1)").select("doc_id", "toxic").hint("merge"), "doc_id")
    return scratch.save(rows.select(F.xxhash64("doc_id").alias("h"), "toxic", "text"), "toxicity_taught")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Stems and weights from all of ``taught``.

    At most (mean stems of a row) / ``STEM_SHARE`` candidates reach the driver; clean rows are counted for those only.
    """
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}
    some = stem_counts(rows.where("toxic = 1")).where(F.col("once") >= max(STEM_ROWS, STEM_SHARE * n[1])).collect()
    toxic = {r["stem"]: (r["once"], r["twice"]) for r in some}
    clean = {r["stem"]: (r["once"], r["twice"]) for r in stem_counts(rows.where("toxic = 0"), frozenset(toxic)).collect()}
    return choose([(s, c, clean.get(s, (0, 0))) for s, c in toxic.items()], n[1], n[0])


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bias and weights of a logistic model of labels ``y`` on features ``x``; Newton steps with a Gaussian prior."""
    prior = np.array([PRIOR_BIAS, *PRIOR])
    if not len(x):
        return prior
    x = np.hstack([np.ones((len(x), 1)), np.log2(1 + x)])
    w, ridge = prior.copy(), np.full(len(prior), RIDGE)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def probability(f: np.ndarray, model: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model[0] + np.log2(1 + f) @ model[1:], -700, 700)))


def fold(doc_id: str) -> Column:
    """True for rows that training leaves out: crc32 of the id as text, modulo 5, is 0. A null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5) == 0


def _taught_features(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float]) -> Iterator[pa.RecordBatch]:
    weight = Weights(lexicon)
    for b in batches:
        f = features(b.column("text"), weight)
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("toxic"), *(pa.array(f[:, i]) for i in range(len(FEATURES)))], names=["h", "toxic", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and logistic weights."""
    rows = taught(docs, labels, scratch)
    lexicon = learn_lexicon(rows)
    schema = "h long, toxic int, " + ", ".join(f"{k} double" for k in FEATURES)
    some = rows.select("h", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(partial(_taught_features, lexicon=lexicon), schema)
    some = some.orderBy(*(F.col(c) for c in ("h", "toxic", *FEATURES))).limit(FITTED_ROWS).toPandas()
    scratch.drop("toxicity_taught")
    return lexicon, fit(some[list(FEATURES)].to_numpy(float), some["toxic"].to_numpy(float))


def _scored(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    weight = Weights(lexicon)
    for b in batches:
        score = probability(features(b.column("text"), weight), model)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs(doc_id, text)``."""
    lexicon, model = train(docs, labels, scratch)
    rows = docs.select("doc_id", fold("doc_id").alias("held_out"), "text")
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields[:2]), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(partial(_scored, lexicon=lexicon, model=model), schema)


def _clean(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    weight = Weights(lexicon)
    for b in batches:
        yield b.filter(pa.array(probability(features(b.column("text"), weight), model) < 0.5))


def keep_clean(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows that are not predicted toxic, with their own columns."""
    lexicon, model = train(docs, labels, scratch)
    return docs.mapInArrow(partial(_clean, lexicon=lexicon, model=model), docs.schema)
