"""Toxicity from a weighted grammar of clauses.

Small finite-state transducers read the word classes of one clause: insults,
threats, targets, negations and reported speech. They are composed into one
machine whose arcs emit events, such as an insult with a target or a negated
threat. Clauses without an insult or a threat are never walked. The weights of
the events and further insults are learned from labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.llm import hashing
from noticeboard.llm.substrings import Lookup
from noticeboard.llm.texts import BROADCAST_BYTES, bucket
from noticeboard.session import materialise

# Seed words of each class.
INSULTS = (
    "idiot idiots moron morons stupid pathetic worthless disgusting loser losers scum trash clown clowns dumb fool fools jerk "
    "imbecile retard bastard bitch asshole garbage vermin filth pig pigs coward liar parasite"
).split()
THREATS = "kill hurt destroy beat shoot stab burn murder crush strangle hang punish slaughter".split()
TARGETS = "you your yours u he him she her they them their people everyone women men immigrants these those".split()
NEGATIONS = "not no never none nobody without isn't aren't wasn't weren't don't doesn't didn't won't ain't nicht kein keine pas jamais nunca".split()
REPORTS = "said says say quoted quote reported reportedly called calls wrote claims claimed allegedly according accused".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, SUSPECT = range(7)

#: Words that a negation reaches, that a target reaches forwards, and that a threat waits for its target.
NEGATION_REACH, TARGET_REACH, THREAT_REACH = 3, 4, 4
EVENTS = ["insult", "insult_at", "insult_negated", "insult_reported", "threat", "threat_weak", "suspect"]
#: Weights before learning: of no event, and of each further event of a kind up to MOST.
PRIOR_BIAS, PRIOR = -4.0, {"insult": 5.0, "insult_at": 6.0, "insult_negated": 1.0, "insult_reported": 1.5, "threat": 6.0, "threat_weak": 1.0, "suspect": 1.0}
MOST, RIDGE = 3, 1.0
#: Documents are dealt to parts; part 0 is never learned from.
PARTS = 5
#: A learned stem (the first bytes of words, in lengths of STEMS) is in this share of the toxic documents at least, and
#: in how many documents at least; of those that hold it the share SURE is toxic for an insult, LIKELY for a suspect.
STEMS, SUPPORT, LEAST, SURE, LIKELY = range(3, 13), 0.015, 4, 0.97, 0.6

_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[[ord(c) for c in ".!?;:\n"]] = True

Output = str | None


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, class) to (state, output); states that are not named stay, and count down where they are numbers."""

    start: object
    step: object

    def __call__(self, state: object, kind: int) -> tuple[object, Output]:
        return self.step(state, kind)


def _countdown(trigger: int, reach: int) -> Transducer:
    """Marks the words that follow one of a class, up to a reach."""

    def step(left: int, kind: int) -> tuple[int, Output]:
        return (reach if kind == trigger else max(0, left - 1)), ("on" if left else None)

    return Transducer(0, step)


NEGATED = _countdown(NEGATION, NEGATION_REACH)
AIMED = _countdown(TARGET, TARGET_REACH)
REPORTED = Transducer(False, lambda seen, kind: (seen or kind == REPORT, "on" if seen else None))
INSULTED = Transducer(None, lambda state, kind: (None, {INSULT: "insult", SUSPECT: "suspect"}.get(kind)))


def _threat(left: int, kind: int) -> tuple[int, Output]:
    """A threat counts when a target comes soon after it."""
    if kind == TARGET and left:
        return 0, "threat"
    return (THREAT_REACH if kind == THREAT else max(0, left - 1)), None


THREATENED = Transducer(0, _threat)


def _composed(parts: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """The product of the transducers as tables (state, class) to next state and event number plus one."""
    states = {tuple(p.start for p in parts): 0}
    steps: list[list[int]] = []
    events: list[list[int]] = []
    for state in (queue := list(states)):
        row, said = [], []
        for kind in range(7):
            nexts, outputs = zip(*[p(s, kind) for p, s in zip(parts, state, strict=True)], strict=True)
            negated, aimed, reported, insult, threat = outputs
            event = 0
            if threat:
                event = EVENTS.index("threat_weak" if negated or reported else "threat") + 1
            elif insult == "suspect":
                event = 0 if negated or reported else EVENTS.index("suspect") + 1
            elif insult:
                name = "insult_reported" if reported else "insult_negated" if negated else "insult_at" if aimed else "insult"
                event = EVENTS.index(name) + 1
            if nexts not in states:
                states[nexts] = len(states)
                queue.append(nexts)
            row.append(states[nexts])
            said.append(event)
        steps.append(row)
        events.append(said)
    return np.array(steps), np.array(events)


STEP, EVENT = (x.tolist() for x in _composed([NEGATED, AIMED, REPORTED, INSULTED, THREATENED]))


def clause_events(kinds: list[int]) -> list[int]:
    """Event numbers of one clause from the classes of its words."""
    state, out = 0, []
    for kind in kinds:
        if EVENT[state][kind]:
            out.append(EVENT[state][kind] - 1)
        state = STEP[state][kind]
    return out


def hashes_of(words: list[str]) -> np.ndarray:
    return hashing.words(pa.array([" ".join(words)]), fold=True, separators=_SEPARATORS).hash if words else np.zeros(0, np.uint64)


class Lexicon:
    """Classes of words by hash, and of words that begin with a learned stem; ``stems`` are (class, hash) by length."""

    def __init__(self, stems: dict[int, list[tuple[int, np.ndarray]]]) -> None:
        seeds = [(INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)]
        every = np.concatenate([hashes_of(w) for _, w in seeds])
        every, first = np.unique(every, return_index=True)
        self.lookup, self.kinds = Lookup(every), np.concatenate([np.full(len(hashes_of(w)), k) for k, w in seeds])[first]
        self.stems = {n: [(kind, Lookup(np.sort(h))) for kind, h in rows if len(h)] for n, rows in stems.items()}

    def classes(self, found: hashing.Words) -> np.ndarray:
        out = np.zeros(len(found.hash), np.int64)
        for length, rows in self.stems.items():
            word, stem = found.stems(length)
            for kind, lookup in rows:
                hit = word[lookup.find(stem)]
                out[hit] = np.where(out[hit] == INSULT, INSULT, kind)
        hit = self.lookup.find(found.hash)
        out[hit] = self.kinds[np.searchsorted(self.lookup.sorted, found.hash[hit])]
        return out


def _events(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in hashing.slices(batch.column(1)):
                found = hashing.words(part, fold=True, separators=_SEPARATORS)
                kinds = lexicon.classes(found)
                counts = np.zeros((len(part), len(EVENTS)), np.int32)
                hits = np.flatnonzero((kinds == INSULT) | (kinds == THREAT) | (kinds == SUSPECT))
                if len(hits):
                    ends = np.cumsum(_CLAUSE_END[found.data])
                    text = np.searchsorted(found.first, np.arange(len(kinds)), side="right") - 1
                    clause = ends[found.start] + text  # texts and clauses only go up, so each pair has a number of its own
                    for number in np.unique(clause[hits]):
                        a, b = np.searchsorted(clause, [number, number + 1])
                        for event in clause_events(kinds[a:b].tolist()):
                            counts[text[a], event] += 1
                columns = [pa.array(np.minimum(counts[:, i], MOST)) for i in range(len(EVENTS))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *columns], ["doc_id", *EVENTS])

    return run


def events(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and how often each event occurs, up to ``MOST``, for rows (doc_id, text)."""
    return docs.mapInArrow(_events(lexicon), "doc_id long, " + ", ".join(f"{e} int" for e in EVENTS))


def _stems_in(candidates: dict[int, np.ndarray] | None):
    """Per slice, length and stem, in how many of its texts it is; of ``candidates`` or of all stems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in hashing.slices(batch.column(0)):
                found = hashing.words(part, fold=True, separators=_SEPARATORS)
                text = np.searchsorted(found.first, np.arange(len(found.hash)), side="right") - 1
                for length in STEMS:
                    word, own = found.stems(length)
                    if candidates is not None:
                        hit = Lookup(candidates[length]).find(own)
                        word, own = word[hit], own[hit]
                    order = np.lexsort((text[word], own))
                    own, where = own[order], text[word][order]
                    new = np.ones(len(own), bool)
                    new[1:] = (own[1:] != own[:-1]) | (where[1:] != where[:-1])
                    distinct, count = np.unique(own[new], return_counts=True)
                    columns = [pa.array(np.full(len(distinct), length, np.int32)), pa.array(distinct.view(np.int64)), pa.array(count)]
                    yield pa.RecordBatch.from_arrays(columns, ["length", "stem", "n"])

    return run


def _count_stems(texts: DataFrame, candidates: dict[int, np.ndarray] | None) -> DataFrame:
    return texts.mapInArrow(_stems_in(candidates), "length int, stem long, n long").groupBy("length", "stem").agg(F.sum("n").alias("n"))


def learn_stems(labelled: DataFrame) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Stems that mark toxic documents, from rows (text, toxic); see ``STEMS``.

    Candidates are in at least the share ``SUPPORT`` of the toxic documents, so
    there are at most the distinct stems of a document divided by it.
    """
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = max(LEAST, SUPPORT * sizes.get(1, 0))
    rows = _count_stems(labelled.filter("toxic = 1").select("text"), None).filter(F.col("n") >= least).collect()
    of = lambda n: np.array(sorted(r["stem"] for r in rows if r["length"] == n), np.int64).view(np.uint64)
    candidates = {n: np.sort(of(n)) for n in STEMS}
    clean = {(r["length"], r["stem"]): r["n"] for r in _count_stems(labelled.filter("toxic = 0").select("text"), candidates).collect()}
    share = {(r["length"], r["stem"]): r["n"] / (r["n"] + clean.get((r["length"], r["stem"]), 0)) for r in rows}
    pick = lambda n, low, high: np.array([s for (m, s), x in share.items() if m == n and low <= x < high], np.int64).view(np.uint64)
    return {n: [(INSULT, pick(n, SURE, 2)), (SUSPECT, pick(n, LIKELY, SURE))] for n in STEMS}


def fit(cells: list[tuple[list[int], int, int]]) -> tuple[float, dict[str, float]]:
    """Bias and event weights from (event counts, toxic, other) cells: logistic, drawn towards the prior weights."""
    start = np.array([PRIOR_BIAS, *[PRIOR[e] for e in EVENTS]])
    if not cells or not sum(c[1] for c in cells) or not sum(c[2] for c in cells):
        return PRIOR_BIAS, dict(PRIOR)
    x = np.array([[1, *c[0]] for c in cells], float)
    bad, n = np.array([c[1] for c in cells], float), np.array([c[1] + c[2] for c in cells], float)
    w = start.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * np.logaddexp(0, z) - bad * z).sum() + 0.5 * RIDGE * ((w - start) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (n * p - bad) + RIDGE * (w - start)
        move = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
        if abs(size * move).max() < 1e-8:
            break
    return float(w[0]), dict(zip(EVENTS, w[1:].tolist(), strict=True))


def probability(bias: float, weights: dict[str, float]) -> Column:
    z = F.lit(bias)
    for e in EVENTS:
        z = z + F.lit(weights[e]) * F.col(e)
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the events: one row per row of ``docs``.

    Labels are learned from rows outside part 0 of ``PARTS`` only; ``labels`` has
    (doc_id, toxic). Null and empty texts have no events and score as such. Rows
    with null or repeated ids are scored by their text; a null id is never
    labelled. Labels other than 0 and 1 are passed over; of conflicting labels of
    one id the larger counts. Without labels of both kinds the prior weights hold.
    An empty table gives no rows.
    """
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marks = labels.filter(F.col("toxic").isin(0, 1) & (bucket(F.col("doc_id"), PARTS) != 0))
    marks = materialise(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    if marks.count() * 16 <= BROADCAST_BYTES:
        marks = F.broadcast(marks)
    labelled = plain.join(marks, "doc_id").select("text", "toxic")
    distinct = labelled.groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    lexicon = Lexicon(learn_stems(materialise(distinct.select("text", "toxic"), "labelled")))
    found = materialise(events(plain, lexicon), "events")
    cells = found.join(marks, "doc_id").groupBy(*EVENTS).agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).collect()
    bias, weights = fit([([r[e] for e in EVENTS], r["bad"], r["good"]) for r in cells])
    out = found.withColumn("held_out", bucket(F.col("doc_id"), PARTS) == 0).withColumn("score", probability(bias, weights))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *EVENTS)
