"""Toxicity by a weighted finite-state pattern grammar (operator 9).

A text is cut into clauses.  A lexical transducer turns each word into a symbol: insult,
harm (a verb that needs an object), doom (what befalls its subject), target, intent,
negation, report, other.  Small transducers read the symbols of a clause.  Some read it
forwards: whether somebody is spoken of before, how far a negation reaches, whether
something is intended, whether speech is reported.  Some read it backwards: who stands
behind as object, whether a report follows.  Those of a direction are composed into one
table; insult and threat are transducers over what both directions say of a word:

    insult: aimed at a target on either side, else plain
    threat: intent, harm, then its object; or a target, intent, then its doom

and negation and report turn a match into a negated or a reported one.  Weighted sums of
matches over the whole text, not single words, go through a logistic curve fitted on
labelled texts.

The insult lexicon is learned: words and stems that labelled toxic texts have and others
lack.  Counting is over texts that are not near copies of each other, or one copied text
would make a lexicon of its own words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.learning import Logistic, labelled_sample
from scriptorium.llm.shared import map_batches, remainder, text_rows

OTHER, INSULT, HARM, DOOM, TARGET, INTENT, NEGATION, REPORT = range(8)
SYMBOLS = 8
#: Closed word classes of the four languages of the corpus.
CLOSED = {
    TARGET: "you your yourself he she they him her them du dich dir ihr euch sie er tu te toi vous il elle ils usted ustedes tú ti él ella ellos",
    INTENT: "will shall gonna going want i'll we'll let's werde werden wollen vais allons vont voy vamos van",
    NEGATION: "not never no nor neither isn't aren't wasn't don't won't nicht kein keine nie niemals ne pas jamais ni nunca jamás tampoco",
    REPORT: "said says called calls quoted quotes reported wrote allegedly sagte sagt nannte schrieb dit disait appelé écrit dijo llamó escribió",
    HARM: "kill hurt punch stab strangle destroy töten umbringen schlagen tuer frapper matar golpear",
    DOOM: "die suffer sterben leiden mourir souffrir morir sufrir",
}
CLAUSE = re.compile(r"[^.!?;:\n]+")
WORD_OF = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
KINDS = ("plain", "aimed", "negated", "reported", "threat")


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, output); anything absent stays put and emits nothing."""

    start: object
    moves: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.moves.get((state, symbol), (state, None))


def countdown(symbol: int, reach: int) -> Transducer:
    """Emits whether one of the ``reach`` words read before was ``symbol``."""
    moves = {(n, s): (max(0, n - 1), n > 0) for n in range(reach + 1) for s in range(SYMBOLS)}
    moves |= {(n, symbol): (reach, n > 0) for n in range(reach + 1)}
    return Transducer(0, moves)


def latch(symbol: int) -> Transducer:
    """Emits whether ``symbol`` has been read in this clause."""
    return Transducer(0, {(n, s): (int(n or s == symbol), bool(n)) for n in (0, 1) for s in range(SYMBOLS)})


def compose(*machines: Transducer) -> list[list[tuple[int, tuple]]]:
    """Table of the product machine: for state and symbol the next state, and what each machine emits."""
    table, queue = [], [tuple(m.start for m in machines)]
    numbers = {queue[0]: 0}
    for state in queue:  # grows as new states are met
        row = []
        for symbol in range(SYMBOLS):
            steps = [m.step(s, symbol) for m, s in zip(machines, state)]
            after = tuple(s for s, _ in steps)
            if after not in numbers:
                numbers[after] = len(numbers)
                queue.append(after)
            row.append((numbers[after], tuple(e for _, e in steps)))
        table.append(row)
    return table


def insult(before: tuple, behind: tuple) -> str:
    return "aimed" if before[0] or behind[0] else "plain"


def harm(before: tuple, behind: tuple) -> str | None:
    return "threat" if before[1] and behind[1] else None


def doom(before: tuple, behind: tuple) -> str | None:
    return "threat" if before[0] and before[1] else None


#: Read forwards: target, intent, negation, report; backwards: target near, object, report.
FORWARDS = compose(countdown(TARGET, 4), countdown(INTENT, 4), countdown(NEGATION, 3), latch(REPORT))
BACKWARDS = compose(countdown(TARGET, 2), countdown(TARGET, 3), latch(REPORT))
EMITTERS = {INSULT: insult, HARM: harm, DOOM: doom}


def emitted(symbol: int, before: tuple, behind: tuple) -> str | None:
    """The kind of match at a word, from what the words before and behind it say."""
    kind = EMITTERS[symbol](before, behind)
    return kind and ("reported" if before[3] or behind[2] else "negated" if before[2] else kind)


#: The whole grammar as one table: what comes out at a symbol, for what either direction says.
GRAMMAR = {
    (symbol, f, g): emitted(symbol, f, g)
    for symbol in EMITTERS
    for f in {e for row in FORWARDS for _, e in row}
    for g in {e for row in BACKWARDS for _, e in row}
}


def run(symbols: list[int]) -> list[str | None]:
    """The kind of match at every word of a clause, or none."""
    behind, state = [], 0
    for s in reversed(symbols):
        state, said = BACKWARDS[state][s]
        behind.append(said)
    out, state = [], 0
    for s, g in zip(symbols, reversed(behind)):
        state, f = FORWARDS[state][s]
        out.append(GRAMMAR.get((s, f, g)))
    return out


CLOSED_WORDS = {w: symbol for symbol, words in CLOSED.items() for w in words.split()}


@dataclass
class ToxicityModel:
    stems: dict[str, float]  # learned insult lexicon: stem -> weight
    curve: Logistic | None
    constant: float

    def __post_init__(self):
        by_length = defaultdict(list)
        for s in self.stems:
            by_length[len(s)].append(s)
        #: The longest stem a word begins with, found by trying each stem length.
        self.lengths = sorted(by_length, reverse=True)
        any_stem = "|".join(re.escape(s) for s in sorted(self.stems, key=len, reverse=True))
        any_threat = "|".join((CLOSED[HARM] + " " + CLOSED[DOOM]).split())
        self.hit = re.compile(rf"(?<![^\W\d_])(?:(?:{any_stem})|(?:{any_threat})\b)" if any_stem else rf"\b(?:{any_threat})\b")

    def __getstate__(self):
        return {"stems": self.stems, "curve": self.curve, "constant": self.constant}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def weight(self, word: str) -> float:
        return next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), 0.0)

    def matches(self, text: str) -> list[tuple[str, str, float]]:
        """(clause, kind, weight) of every match in a text."""
        text, out = text.lower(), []
        at = 0
        while found := self.hit.search(text, at):
            begin = max(text.rfind(c, at, found.start()) for c in ".!?;:\n") + 1 or at  # a clause begins where the last ended
            clause = CLAUSE.match(text, begin)
            words = WORD_OF.findall(clause[0])
            weights = [self.weight(w) for w in words]
            kinds = run([INSULT if x else CLOSED_WORDS.get(w, OTHER) for w, x in zip(words, weights)])
            out += [(clause[0].strip(), kind, weight or 1.0) for kind, weight in zip(kinds, weights) if kind]
            at = max(clause.end(), found.end())
        return out

    def features(self, text: str | None) -> list[float]:
        sums = dict.fromkeys(KINDS, 0.0)
        clauses = set()
        for clause, kind, weight in self.matches(text or ""):
            sums[kind] += weight
            clauses.add(clause)
        return [math.log1p(sums[k]) for k in KINDS] + [math.log1p(len(clauses))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.curve is None or not texts:
            return np.full(len(texts), self.constant)
        return self.curve(np.array([self.features(t) for t in texts]))


def families(bags: list[set[str]]) -> list[int]:
    """Indexes of texts without those that share a band of minimal word hashes with an earlier one."""
    ids: dict[str, int] = {}
    sets = [np.fromiter((ids.setdefault(w, len(ids)) for w in sorted(b)), np.int64, len(b)) for b in bags]
    hashes = np.random.default_rng(7).integers(0, 1 << 32, (max(1, len(ids)), 24), np.uint64)
    seen, kept = set(), []
    for i, s in enumerate(sets):
        low = hashes[s].min(axis=0) if len(s) else hashes[:0].sum(axis=0)
        bands = {(b, *low[3 * b : 3 * b + 3].tolist()) for b in range(8)}
        if not bands & seen:
            kept.append(i)
        seen |= bands
    return kept


def learn_stems(sample: list[tuple[str, int]], support: int = 3, precision: float = 0.97, shortest: int = 4, longest: int = 10) -> dict[str, float]:
    """Stems of toxic texts with weights: their log odds, at least ``support`` texts and ``precision``.

    A stem needs so many toxic texts that chance would hardly give as many to any of the
    stems there are.  Of nested stems the longest that keeps nearly all of the shorter one's
    texts stays.
    """
    bags = [set(WORD_OF.findall(t.lower())) for t, _ in sample]
    toxic, clean = Counter(), Counter()
    chosen = families(bags)
    for i in chosen:
        (toxic if sample[i][1] else clean).update({w[:n] for w in bags[i] for n in range(shortest, min(longest, len(w)) + 1)})
    total = max(1, sum(sample[i][1] for i in chosen)), max(1, sum(1 - sample[i][1] for i in chosen))
    share = total[0] / (total[0] + total[1])
    support = max(support, (math.log(len(toxic) + 1) + 2) / -math.log(share))
    good = {s: a for s, a in toxic.items() if a >= support and a / total[0] >= precision / (1 - precision) * clean[s] / total[1]}
    kept: dict[str, float] = {}
    for s in sorted(good, key=lambda s: (len(s), s)):
        if any(s[:n] in kept for n in range(shortest, len(s))):
            continue
        while longer := [x for x in good if len(x) == len(s) + 1 and x.startswith(s) and good[x] >= 0.97 * good[s]]:
            s = longer[0]
        kept[s] = math.log((good[s] + 0.5) / total[0]) - math.log((clean[s] + 0.5) / total[1])
    return kept


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, per_class: int = 3000, most_bytes: int = 10_000_000) -> ToxicityModel:
    """Learns from a bounded labelled sample: ``per_class`` texts and ``most_bytes`` of each class.

    Without labels of both classes every score is the share of label 1, or 0 without any.
    """
    sample = labelled_sample(docs, labels, "toxic", modulus, held_out, per_class, most_bytes)
    y = np.array([z for _, z in sample], float)
    if len({*y}) < 2:
        return ToxicityModel({}, None, float(y.mean()) if len(y) else 0.0)
    model = ToxicityModel(learn_stems(sample), None, 0.0)
    found = np.array([model.features(t) for t, _ in sample])
    model.curve = Logistic(found, y, ridge=1.0, products=False)
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, threshold: float = 0.7, modulus: int = 3, held_out: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses (clauses with a match) for every row.

    Null texts are scored as empty.  Empty table: no rows; repeated rows: equal rows;
    other columns are not read.
    """
    rows = text_rows(df, key, text)
    kept = df.sparkSession.sparkContext.broadcast(model)  # some stems and weights

    def start():
        def score(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            model = kept.value
            return {"doc_id": batch.column("doc_id"), "score": model.scores(texts), "n_clauses": [len({c for c, _, _ in model.matches(t or "")}) for t in texts]}

        return score

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = map_batches(rows, start, f"doc_id {kind}, score double, n_clauses int")
    return scored.select("doc_id", (remainder("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses")


def toxic_clauses(df: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, clause, kind, weight: a row for every match of the grammar, in no order; texts without one have none."""
    rows = text_rows(df, key, text)
    kept = df.sparkSession.sparkContext.broadcast(model)

    def start():
        def find(batch: pa.RecordBatch) -> dict:
            found = [(k, *m) for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in kept.value.matches(t or "")]
            return {n: [f[i] for f in found] for i, n in enumerate(("doc_id", "clause", "kind", "weight"))}

        return find

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, start, f"doc_id {kind}, clause string, kind string, weight double")
