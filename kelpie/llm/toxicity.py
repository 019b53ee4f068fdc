"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults (by strength 1 to 9), verbs of threat, targets,
negations, reporting verbs, quotes, copulas, intensifiers, words of intent, clause
bounds and other words. Five transducers over these symbols are composed once
into one deterministic automaton. Two of them give gains: insults (more after a
copula or an intensifier) and threats (a verb of threat, more after a word of
intent, and again when the target follows it). Three weigh the gains: targets
before them raise, negation and reported speech damp. The automaton scores every
clause that holds an insult or a threat: the clause's gains, not the words alone,
count. Damped gains are kept apart from plain ones, and a logistic model on the
clause scores gives 0 to 1.

The general lists of words below are fixed; the strengths of insults, and
further insults or stems that mark toxic texts, are learned from labelled rows:
terms of high log odds are taken while they cover toxic texts not yet covered
twice, so that the chance words of copied toxic texts gain no place. Labels of
at most TRAIN_ROWS rows are used, those of the smallest hash of doc_id.

Edge cases: a null or empty text has no clause and the score of none; without
labelled rows of both kinds the fixed lists and weights stand; null labels and
ids are not learned from; repeated rows are scored each; the order of ties in
learning is that of the terms; other columns (lang, source) are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.bpe import slices
from kelpie.llm.common import discard, fold_of, materialize

#: Bound of the labelled sample; folds, and the one whose labels are never seen; decision threshold.
TRAIN_ROWS, FOLDS, UNSEEN, THRESHOLD = 20_000, 4, 2, 0.3
#: A learned term covers so many texts at least and has so high a log odds at least.
LEAST_TEXTS, LEAST_ODDS = 3, 3.0
CACHE_TOKENS = 250_000

INSULTS = "idiot idiots moron morons stupid trash loser losers clown clowns scum pathetic disgusting worthless imbecile dumb dumbass jerk bastard asshole bitch cretin fool foolish garbage filth vermin degenerate retard ugly freak pig creep lowlife connard imbécile crétin salaud ordure dummkopf arschloch abschaum trottel idiota estúpido imbécil basura asqueroso".split()
THREATS = "kill murder stab strangle destroy hurt shoot smash hang tuer töten umbringen matar".split()
TARGETS = "you your yours yourself u ur he him his she her they them their tu vous toi ton votre du dich dir dein sie ihr tú usted ustedes vosotros".split()
NEGATIONS = "not no never neither nor hardly isn't aren't wasn't don't doesn't didn't ain't pas jamais nicht kein keine nie nunca jamás".split()
REPORTS = "said says say told called calls wrote writes quoted reported claimed according dit disait sagte sagt dijo dice".split()

COPULAS = "is are am was were be being been you're he's she's they're es est ist bist sind eres sois son".split()
INTENSIFIERS = "so such very really total totally complete completely utter utterly absolute absolutely fucking damn bloody tellement vraiment sehr echt tan muy".split()
INTENTS = "will gonna going want wants shall should must i'll we'll ought deserve deserves vais va allons werde werden soll voy vamos debe".split()

INSULT, HITS = "123456789", "123456789T"
SYMBOLS = HITS + "YNRQBCIWO"
_CORE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:]+|[\"“”«»„]")
_BOUND, _QUOTE = ".!?;:", "\"“”«»„"


class Transducer:
    """Deterministic: for each state and symbol the next state, a gain, a weight of all gains, and whether the gains are damped; no arc: the state stays."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, float, float, bool]]):
        self.arcs = arcs

    def step(self, state: int, symbol: str) -> tuple[int, float, float, bool]:
        return self.arcs.get((state, symbol), (state, 0.0, 1.0, False))

    @staticmethod
    def compose(*parts: Transducer) -> list[dict[str, tuple[int, float, bool]]]:
        """The product automaton, from the states reachable: by state and symbol the next state, the sum of the gains times the product of the weights, and whether it is damped."""
        start = (0,) * len(parts)
        number, todo, table = {start: 0}, [start], []
        while todo:
            now = todo.pop(0)
            row = {}
            for symbol in SYMBOLS:
                steps = [p.step(s, symbol) for p, s in zip(parts, now, strict=True)]
                to = tuple(s[0] for s in steps)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row[symbol] = (number[to], sum(s[1] for s in steps) * math.prod(s[2] for s in steps), any(s[3] for s in steps))
            table.append(row)
        return table


def insults(scope: int = 3, raised: float = 1.3) -> Transducer:
    """An insult gains its strength, more if at most `scope` symbols after a copula or an intensifier ("you are an idiot", "such a fool")."""
    arcs = {}
    for left in range(scope + 1):
        for s in SYMBOLS:
            gain = int(s) / 9 * (raised if left else 1.0) if s in INSULT else 0.0
            arcs[left, s] = (scope if s in "CI" else 0 if s == "B" else max(0, left - 1), gain, 1.0, False)
    return Transducer(arcs)


def threats(scope: int = 3, bare: float = 0.1, meant: float = 0.3, aimed: float = 0.2) -> Transducer:
    """A verb of threat gains a little, more at most `scope` symbols after a word of intent, and again when a target follows at most two symbols later ("I will kill you").

    States 1 to scope count down after a word of intent, scope + 1 and scope + 2 wait for the target.
    """
    arcs = {}
    for state in range(scope + 3):
        waits = max(0, state - scope)
        for s in SYMBOLS:
            left = scope + waits - 1 if waits > 1 else 0 if waits else max(0, state - 1)
            arcs[state, s] = (left, 0.0, 1.0, False)
        arcs[state, "B"] = (0, 0.0, 1.0, False)
        arcs[state, "W"] = (scope, 0.0, 1.0, False)
        arcs[state, "T"] = (scope + 2, meant if 0 < state <= scope else bare, 1.0, False)
        if waits:
            arcs[state, "Y"] = (0, aimed, 1.0, False)
    return Transducer(arcs)


def negation(scope: int = 3, weight: float = 0.3) -> Transducer:
    """An insult or a threat at most `scope` symbols after a negation is damped, and with a threat the target after it (states beyond scope)."""
    arcs = {}
    for state in range(scope + 3):
        after = max(0, state - scope)
        for s in SYMBOLS:
            left = scope + after - 1 if after > 1 else 0 if after else max(0, state - 1)
            arcs[state, s] = (left, 0.0, 1.0, False)
        arcs[state, "N"] = (scope, 0.0, 1.0, False)
        arcs[state, "B"] = (0, 0.0, 1.0, False)
        if after:
            arcs[state, "Y"] = (0, 0.0, weight, True)
        elif state:
            for s in INSULT:
                arcs[state, s] = (0, 0.0, weight, True)
            arcs[state, "T"] = (scope + 2, 0.0, weight, True)
    return Transducer(arcs)


def reported(weight: float = 0.5) -> Transducer:
    """After a reporting verb (1) to the clause's end, or between quotes (2), gains are damped."""
    arcs = {(state, "B"): (0, 0.0, 1.0, False) for state in (1, 2)} | {(0, "R"): (1, 0.0, 1.0, False), (0, "Q"): (2, 0.0, 1.0, False), (1, "Q"): (2, 0.0, 1.0, False), (2, "Q"): (0, 0.0, 1.0, False)}
    for state in (1, 2):
        for s in HITS + "Y":
            arcs[state, s] = (state, 0.0, weight, s in HITS)
    return Transducer(arcs)


def targeted(scope: int = 4, insult: float = 1.5, threat: float = 4.0) -> Transducer:
    """A hit at most `scope` symbols after a target weighs more, a threat above all."""
    arcs = {}
    for left in range(scope + 1):
        for s in SYMBOLS:
            arcs[left, s] = (max(0, left - 1), 0.0, 1.0, False)
        arcs[left, "Y"] = (scope, 0.0, 1.0, False)
        arcs[left, "B"] = (0, 0.0, 1.0, False)
        for s in HITS if left else "":
            arcs[left, s] = (left, 0.0, threat if s == "T" else insult, False)
    return Transducer(arcs)


GRAMMAR = Transducer.compose(insults(), threats(), targeted(), negation(), reported())


class Lexicon:
    """Symbols of words: the fixed lists with learned strengths, and learned words and stems (a stem ends in *)."""

    def __init__(self, learned: dict[str, float] | None = None):
        learned = learned or {}
        strength = lambda odds: str(int(min(9, max(1, round(1.5 * odds)))))
        self.words = {w: "I" for w in INTENSIFIERS} | {w: "C" for w in COPULAS} | {w: "W" for w in INTENTS} | {w: "R" for w in REPORTS} | {w: "N" for w in NEGATIONS} | {w: "Y" for w in TARGETS} | {w: "T" for w in THREATS} | {w: "4" for w in INSULTS}
        for term, odds in learned.items():
            if not term.endswith("*"):
                self.words[term] = strength(odds)
        self.stems = {t[:-1]: strength(o) for t, o in learned.items() if t.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.cache: dict[str, str] = {}

    def symbol(self, word: str) -> str:
        found = self.words.get(word)
        if found is None:
            found = next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), "O")
        return found

    def symbols(self, token: str) -> str:
        """Of a token between white space, lower-cased."""
        return "".join("B" if p[0] in _BOUND else "Q" if p[0] in _QUOTE else self.symbol(p.replace("’", "'")) for p in _CORE.findall(token))

    def clauses(self, text: str) -> list[str]:
        lines = [line.split() for line in text.lower().split("\n")]
        get = self.cache.get
        out = []
        for words in lines:
            found = list(map(get, words))
            if None in found:
                if len(self.cache) > CACHE_TOKENS:
                    self.cache.clear()
                for i, s in enumerate(found):
                    if s is None:
                        found[i] = self.cache[words[i]] = self.symbols(words[i])
            out += "".join(found).split("B")
        return out


def clause_score(symbols: str) -> tuple[float, float]:
    """Plain and damped gains of a clause."""
    state, plain, damped = 0, 0.0, 0.0
    for s in symbols:
        state, gain, damp = GRAMMAR[state][s]
        if damp:
            damped += gain
        else:
            plain += gain
    return plain, damped


_HIT = re.compile("[1-9T]")


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float, float, float]:
    """Largest clause, sum of plain gains, sum of damped gains, all on a log scale, and plain gains a clause."""
    clauses = lexicon.clauses(text or "")
    scores = [clause_score(c) for c in clauses if _HIT.search(c)]
    if not scores:
        return 0.0, 0.0, 0.0, 0.0
    plain, damped = sum(p for p, _ in scores), sum(d for _, d in scores)
    return math.log1p(max(p for p, _ in scores)), math.log1p(plain), math.log1p(damped), plain / (1 + len(clauses))


#: Without labels: bias and weights of the features.
PRIOR = (-4.0, 4.0, 2.0, 0.5, 1.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton's method, held to the weights without labels by the ridge."""
    a = np.hstack((np.ones((len(x), 1)), x))
    w = prior = np.array(PRIOR)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * (w - prior)
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def probability(f: Iterable[float], w: tuple[float, ...]) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, w[0] + sum(a * b for a, b in zip(f, w[1:], strict=True))))))


def terms(text: str | None) -> set[str]:
    """Distinct words of a text and their stems of four and five letters."""
    words = {p.replace("’", "'") for p in _CORE.findall((text or "").lower()) if p[0].isalpha()}
    return words | {w[:n] + "*" for w in words for n in (4, 5) if len(w) > n}


def choose_terms(texts: list[tuple[int, list[str]]], odds: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Greedy cover: of the toxic texts' terms always the one that covers most texts not yet covered twice (then the higher odds, the longer, the first)."""
    of: dict[str, list[int]] = {}
    for i, (_, own) in enumerate(texts):
        for t in own:
            of.setdefault(t, []).append(i)
    covered, chosen, left = [0] * len(texts), {}, dict(of)
    while left:
        gain = {t: sum(covered[i] < 2 for i in own) for t, own in left.items()}
        left = {t: left[t] for t, g in gain.items() if g >= LEAST_TEXTS}
        if not left:
            break
        # Several at once, as long as they do not cover the same texts: recounting is what takes time.
        fresh: set[int] = set()
        for t in sorted(left, key=lambda t: (-gain[t], -odds[t][0], -len(t), t))[:64]:
            own = [i for i in left[t] if covered[i] < 2]
            if not fresh.isdisjoint(own):
                continue
            fresh.update(own)
            chosen[t] = odds[t][0]
            for i in left[t]:
                covered[i] += 1
            del left[t]
    return chosen


class Model:
    def __init__(self, learned: dict[str, float], weights: tuple[float, ...]):
        self.learned, self.weights = learned, weights


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from the labels (doc_id, toxic) outside the unseen fold; at most `rows` of them."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(fold_of(F.col("doc_id"), FOLDS) != UNSEEN)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(own), "doc_id")  # at most `rows` rows are broadcast
    # One row for each different text, so that copies do not count as evidence.
    sample = materialize(sample.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("toxic").alias("toxic")).select("h", "text", "toxic"), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        discard(sample)
        return Model({}, PRIOR)

    def count(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t in terms(text):
                    found.setdefault(t, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([c[1] for c in found.values()], pa.int64()), pa.array([c[0] for c in found.values()], pa.int64())], ["term", "toxic", "other"])

    counted = sample.select("text", "toxic").mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    log_odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("other") + 0.5) / (sizes[0] + 1))
    counted = counted.withColumn("odds", log_odds)
    strong = (F.col("toxic") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS) & (F.col("toxic") > 4 * F.col("other"))
    listed = F.col("term").isin(INSULTS) & (F.col("toxic") + F.col("other") >= 5)
    found = {r["term"]: (r["odds"], r["toxic"]) for r in counted.filter(strong | listed).collect()}  # bounded by the sample, in which each of them stands several times
    fixed = {t: o for t, (o, _) in found.items() if t in set(INSULTS)}
    able = {t for t, (o, n) in found.items() if o >= LEAST_ODDS and n >= LEAST_TEXTS}

    def own_terms(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(terms(t) & able) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["own"])

    toxic_texts = [(1, r["own"]) for r in sample.filter("toxic = 1").select("text").mapInArrow(own_terms, "own array<string>").collect()]  # bounded by the sample
    learned = choose_terms(toxic_texts, found) | fixed
    lexicon = Lexicon(learned)

    def look(batches):
        for batch in batches:
            rows = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.float64()) for k in range(4)), batch.column(1)], ["a", "b", "c", "d", "toxic"])

    seen = np.array(sample.select("text", "toxic").mapInArrow(look, "a double, b double, c double, d double, toxic int").collect(), dtype=float)  # bounded by the sample
    discard(sample)
    return Model(learned, fit_logistic(seen[:, :4], seen[:, 4]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, in one pass without a shuffle."""
    learned, weights = model.learned, model.weights

    def run(batches):
        lexicon = Lexicon(learned)
        for batch in batches:
            for part in slices(batch, column=2):
                scores = [probability(features(t, lexicon), weights) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    ids = F.col(id_col).cast("long")
    return docs.select(ids.alias("doc_id"), (fold_of(ids, FOLDS) == UNSEEN).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic; one pass."""
    learned, weights = model.learned, model.weights

    @F.pandas_udf("boolean")
    def fine(texts):
        import pandas as pd

        lexicon = _lexicon(learned)
        return pd.Series([probability(features(t, lexicon), weights) < THRESHOLD for t in texts])

    return docs.filter(fine(F.col("text")))


_LEXICONS: dict[int, Lexicon] = {}


def _lexicon(learned: dict[str, float]) -> Lexicon:
    """The worker's lexicon of these terms, so that its cache outlives a batch."""
    key = hash(tuple(sorted(learned.items())))
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[key] = Lexicon(learned)
    return _LEXICONS[key]
